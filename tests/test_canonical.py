"""Canonical documents: fixed vectors of the published rule, and doubles and nested values against their definition."""

import datetime
import json
import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftline.functions import canonical


def es(x):
    """The published rule for numbers, from the shortest digits as Python finds them."""
    if x == 0:
        return "0"
    m, e = (repr(abs(x)) if "e" in repr(abs(x)) else repr(abs(x)) + "e0").split("e")
    whole, _, part = m.partition(".")
    digits, e = whole + part, int(e) + len(whole) - 1
    e -= len(digits) - len(digits.lstrip("0"))
    digits = digits.lstrip("0").rstrip("0")
    n = len(digits)
    if -7 < e + 0 < 21 and e >= -6:
        t = digits + "0" * (e + 1 - n) if e >= n - 1 else digits[: e + 1] + "." + digits[e + 1 :] if e >= 0 else "0." + "0" * (-e - 1) + digits
    else:
        t = digits[0] + ("." + digits[1:] if n > 1 else "") + "e" + ("+" if e > 0 else "") + str(e)
    return "-" * (x < 0) + t


def test_numbers(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.0, 0.1, 1e21, 1e20, 999999999999999900000.0, 1e-6, 1e-7, 123456.789, 5e-324, 1.7976931348623157e308, 2e23, 1e23, 9007199254740993.0, 4.35, 333333333.33333329, 2.0**-1022]
    xs += [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3000)] + [round(rng.uniform(-1e4, 1e4), rng.randint(0, 6)) for _ in range(1000)]
    xs = [x for x in xs if math.isfinite(x)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", canonical.number(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if r.t != es(r.x)] == []
    # fixed vectors of RFC 8785, appendix B
    fixed = {"0000000000000001": "5e-324", "7fefffffffffffff": "1.7976931348623157e+308", "4340000000000000": "9007199254740992", "4430000000000000": "295147905179352830000", "44b52d02c7e14af5": "9.999999999999997e+22",
             "44b52d02c7e14af6": "1e+23", "444b1ae4d6e2ef4e": "999999999999999700000", "444b1ae4d6e2ef50": "1e+21", "3eb0c6f7a0b5ed8c": "9.999999999999997e-7", "3eb0c6f7a0b5ed8d": "0.000001", "41b3de4355555553": "333333333.3333332", "becbf647612f3696": "-0.0000033333333333333333"}
    rows = [(struct.unpack(">d", bytes.fromhex(k))[0], v) for k, v in fixed.items()]
    assert [r.v for r in spark.createDataFrame(rows, "x double, v string").select("v", canonical.number(F.col("x")).alias("t")).filter("t <> v").collect()] == []


def test_not_finite_and_too_large(spark):
    for value, kind in ((math.nan, "double"), (-math.inf, "double"), (2**53, "long")):
        df = spark.createDataFrame([(value,)], f"x {kind}")
        with pytest.raises(Exception, match="canonical document"):
            df.select(canonical.canonical_json(F.col("x"), df.schema["x"].dataType)).collect()
    df = spark.createDataFrame([(b"a",)], "x binary")
    with pytest.raises(TypeError):
        canonical.canonical_json(F.col("x"), df.schema["x"].dataType)


def test_decimals(spark):
    xs = ["0.000000000000000001", "-12.500000000000000000", "0", "100", "-0.0", "99999999999999999999"]
    df = spark.createDataFrame([(Decimal(x),) for x in xs], "x decimal(38,18)")
    assert [r[0] for r in df.select(canonical.decimal_text(F.col("x"))).collect()] == ["0.000000000000000001", "-12.5", "0", "100", "0", "99999999999999999999"]


def test_nested_documents(spark):
    kind = "d struct<b: int, a: string, `é`: array<struct<y: double, x: decimal(10,4)>>, Z: map<string, map<string, boolean>>, t: date, n: string>"
    text = 'q"\\/\b\t\n\f\r\x00\x1f\x7f é€😀'
    docs = [
        ((1, text, [(1.50, Decimal("52.5200")), (None, None), None, (-0.0, Decimal("-0.0"))], {"😀": {"b": True, "a": False}, "�": {}, "": None, "é": {}}, datetime.date(2026, 1, 2), None),),
        ((None, "", [], {}, None, "x"),),
        (None,),
    ]
    df = spark.createDataFrame(docs, kind)
    got = [r[0] for r in df.select(canonical.canonical_json(F.col("d"), df.schema["d"].dataType)).collect()]
    said = json.dumps(text, ensure_ascii=False)
    assert got[0] == '{"Z":{"":null,"é":{},"😀":{"a":false,"b":true},"�":{}},"a":' + said + ',"b":1,"n":null,"t":"2026-01-02","é":[{"x":"52.52","y":1.5},{"x":null,"y":null},null,{"x":"0","y":0}]}'
    assert got[1:] == ['{"Z":{},"a":"","b":null,"n":"x","t":null,"é":[]}', "null"]
    assert json.loads(got[0])["a"] == text
