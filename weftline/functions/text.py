"""Text normal forms and recognizers that SQL queries share."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A canonical decimal number as text.
DECIMAL = r"^(0|-?[1-9][0-9]*|-?(0|[1-9][0-9]*)\.[0-9]*[1-9])$"


def folded(column: Column) -> Column:
    """Unicode NFC, white space as one space, trimmed, case-folded."""

    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()).casefold())

    return F.pandas_udf(fold, "string")(column)


def is_decimal(column: Column) -> Column:
    return column.rlike(DECIMAL)


def display_round(column: Column, digits: int = 0) -> Column:
    """Half away from zero, as shown to a reader."""
    return F.round(column.cast("decimal(38, 12)"), digits)


def strip_ansi(column: Column) -> Column:
    return F.regexp_replace(column, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def extract_html(column: Column) -> Column:
    """A model's answer without thinking and fences, from the doctype or html tag to the last closing html tag."""
    bare = F.regexp_replace(column, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(bare, r"(?s)```(?:html)?\s*\n(.*?)```", 1)
    body = F.when(F.length(fenced) > 0, fenced).otherwise(bare)
    found = F.regexp_extract(body, r"(?is)(<!doctype html.*</html>|<html.*</html>)", 1)
    return F.when(F.length(found) > 0, found)


def hsl_bucket(hex6: Column) -> Column:
    """The colour family of #rrggbb: three greys, or one of 12 hues by three lightnesses."""
    part = lambda i: F.conv(F.substring(hex6, i, 2), 16, 10).cast("double") / 255
    r, g, b = part(1), part(3), part(5)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, d = (high + low) / 2, high - low
    s = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - high - low)).otherwise(d / (high + low))
    hue = F.when(d == 0, 0.0).when(high == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    level = F.least(F.lit(2), F.floor(light * 3)).cast("int")
    return F.when((s < 0.12) | (light < 0.06) | (light > 0.94), F.concat(F.lit("achr:"), level)).otherwise(F.format_string("h%02d_l%d", F.floor(F.pmod(hue, F.lit(360.0)) / 30).cast("int"), level))
