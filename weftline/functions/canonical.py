"""Canonical JSON (RFC 8785) of nested columns as Spark expressions, built from their types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType

#: Characters with an escape of their own. All others below U+0020 are \u and four digits.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
#: The largest whole number that a reader of doubles keeps.
SAFE = 2**53 - 1


def utf16(text: Column) -> Column:
    """What orders strings by their UTF-16 units, as names of members are; order by code points puts U+FFFD before U+1F600."""
    return F.hex(F.encode(text, "UTF-16BE"))


def quoted(text: Column) -> Column:
    plain = text
    for c in ('\\', '"'):
        plain = F.replace(plain, F.lit(c), F.lit(ESCAPES[c]))
    full = plain
    for k in range(32):
        c = chr(k)
        full = F.replace(full, F.lit(c), F.lit(ESCAPES.get(c, f"\\u{k:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F]"), full).otherwise(plain), F.lit('"'))


def number(x: Column) -> Column:
    """The shortest decimal that reads back as this double, fixed from 1e-6 to below 1e21 and with an exponent beyond.

    Both zeros are 0; what is not finite is an error. Of the roundings to 1 to 17 digits the first that reads back counts,
    as not all Java versions write the shortest.
    """
    size = F.abs(x)
    tries = F.concat(*[F.array(F.format_string(f"%.{k}e", size)) for k in range(17)])
    parts = F.split(F.get(F.filter(tries, lambda t: t.cast("double") == size), F.lit(0)), "e")

    def text(parts: Column) -> Column:
        digits, e = F.regexp_replace(F.replace(parts[0], F.lit("."), F.lit("")), "(?<=.)0+$", ""), parts[1].cast("int")
        n = F.length(digits)
        point = lambda k: F.concat(F.substr(digits, F.lit(1), k), F.lit("."), F.substr(digits, k + 1))
        fixed = F.when(e >= n - 1, F.rpad(digits, F.greatest(e + 1, F.lit(1)), "0")).when(e >= 0, point(e + 1)).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
        far = F.concat(F.when(n > 1, point(F.lit(1))).otherwise(digits), F.lit("e"), F.when(e > 0, "+").otherwise(""), e.cast("string"))
        return F.when((e >= -6) & (e < 21), fixed).otherwise(far)

    shown = F.get(F.transform(F.array(parts), text), F.lit(0))  # one evaluation of the roundings
    finite = ~F.isnan(x) & (size != float("inf"))
    return F.when(x == 0, "0").when(finite, F.concat(F.when(x < 0, "-").otherwise(""), shown)).otherwise(F.raise_error(F.lit("a number of a canonical document is finite")))


def decimal_text(x: Column) -> Column:
    """The canonical decimal: no exponent, no zeros at its end, no sign of zero."""
    t = x.cast("string")
    t = F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    return F.when(x == 0, "0").otherwise(t)


def canonical_json(x: Column, kind: DataType) -> Column:
    """The canonical document of a column of this type.

    Members go by the UTF-16 units of their names; arrays keep their order. A null is ``null``, also as a member, and a null
    column is the text ``null``. Decimals and dates are strings. A whole number beyond 2^53 is an error, as is a map with a
    key that is no string and a type without a place in JSON.
    """
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        items = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(x.getField(f.name), f.dataType)) for f in fields]
        out = F.when(x.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *items) if items else F.lit(""), F.lit("}")))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        member = lambda e: F.struct(utf16(e["key"]).alias("o"), F.concat(quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType)).alias("t"))
        members = F.array_sort(F.transform(F.map_entries(x), member))
        out = F.concat(F.lit("{"), F.array_join(F.transform(members, lambda m: m["t"]), ","), F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: canonical_json(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, StringType):
        out = quoted(x)
    elif isinstance(kind, BooleanType):
        out = x.cast("string")
    elif isinstance(kind, IntegralType):
        out = F.when(x.cast("long").between(-SAFE, SAFE), x.cast("string")).when(x.isNotNull(), F.raise_error(F.lit("a whole number of a canonical document is below 2^53")))
    elif isinstance(kind, FloatType | DoubleType):
        out = F.when(x.isNotNull(), number(x.cast("double")))
    elif isinstance(kind, DecimalType):
        out = quoted(decimal_text(x))
    elif isinstance(kind, DateType):
        out = quoted(x.cast("string"))
    elif isinstance(kind, NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def digest(document: Column) -> Column:
    return F.sha2(document.cast("binary"), 256)
