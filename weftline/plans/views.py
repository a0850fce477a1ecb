"""Named views: one definition each, read by Spark as a DataFrame and by the SQL oracle as a common table expression.

A definition names its inputs in braces. ``VIEW(name, text)`` holds in both dialects up to the function names in
``NAMES``; ``VIEW(name, text, duck=...)`` gives the oracle its own text; ``FRAME(name, function, duck)`` builds the
Spark side with the DataFrame API from ``(spark, sf_dir, input frames...)``. The function of a view in ``SHARED`` may give
a list of frames, which are its parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.shared import version, written

#: Function names in Spark and in DuckDB.
NAMES = {"PCT(": ("percentile(", "quantile_cont("), "SHA(": ("sha2_256(", "sha256("), "XOR(": ("bitwise_xor(", "xor(")}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass
class View:
    name: str
    text: str | None
    duck: str
    frame: Callable[..., DataFrame] | None = None
    inputs: tuple[str, ...] = ()


VIEWS: dict[str, View] = {}


def _inputs(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x for x in re.findall(r"\{(\w+)\}", text) if len(x) > 2))


def VIEW(name: str, text: str, duck: str | None = None) -> None:  # noqa: N802
    VIEWS[name] = View(name, text, duck or text, None, _inputs(text))


def FRAME(name: str, frame: Callable[..., DataFrame], duck: str, inputs: str = "") -> None:  # noqa: N802
    VIEWS[name] = View(name, None, duck, frame, tuple(inputs.split()))


def _spark_text(text: str) -> str:
    text = re.sub(r"SHA\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"sha2(\1, 256)", text)
    text = re.sub(r"XOR\(([^,()]+), ([^,()]+)\)", r"(\1 ^ \2)", text)
    return text.replace("PCT(", "percentile(")


#: Views that many queries read: written to the shared folder at their first use in a session, and again when a table
#: below them has changed. Plans end there, too.
SHARED = {"nodes", "css_all", "pair_scores", "cells", "merged"}
_shared: dict[tuple, DataFrame] = {}


def dataframe(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    made = {} if made is None else made
    if name in SHARED and name not in made:
        key = (spark.sparkContext.applicationId, sf_dir, name, *[version(spark, f"{sf_dir}/{t}.parquet") for t in sorted(_tables(name))])
        if key not in _shared:
            _shared[key] = written(_build(spark, sf_dir, name, made), name)
        made[name] = _shared[key]
    return _build(spark, sf_dir, name, made)


def _tables(name: str, seen: set[str] | None = None) -> set[str]:
    """The tables that a view stands on."""
    seen = set() if seen is None else seen
    if name in VIEWS:
        for x in VIEWS[name].inputs:
            if x not in seen:
                seen.add(x)
                _tables(x, seen)
    return {x for x in seen | {name} if x in TABLES} | ({"pages", "documents"} if seen & {"cards", "texts"} else set())


def _build(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame]) -> DataFrame:
    if name not in made:
        if name in TABLES and name not in VIEWS:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            view = VIEWS[name]
            frames = {x: dataframe(spark, sf_dir, x, made) for x in view.inputs}
            made[name] = view.frame(spark, sf_dir, *frames.values()) if view.frame else spark.sql(_spark_text(view.text), **frames)
    return made[name]


def oracle(name: str) -> str:
    """The DuckDB text of a view with all views below it."""
    order: list[str] = []

    def walk(x: str) -> None:
        if x in VIEWS and x not in order:
            for y in dict.fromkeys((*VIEWS[x].inputs, *_inputs(VIEWS[x].duck))):
                walk(y)
            order.append(x)

    walk(name)
    parts = []
    for x in order:
        text = VIEWS[x].duck
        for k, (_, d) in NAMES.items():
            text = text.replace(k, d)
        parts.append(f"{x} AS ({re.sub(r'{(\w+)}', lambda m: m[1] if m[1] in VIEWS or m[1] in TABLES else m[0], text)})")
    return f"WITH RECURSIVE {', '.join(parts)} SELECT * FROM {name}"
