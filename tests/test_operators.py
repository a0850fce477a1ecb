import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import grouped
from weftline.sources import documents
from weftline.streaming import votes


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        cost = rng.integers(0, 20, (4, 6)).astype(float)
        got = grouped.assignment(cost)
        assert len(set(got)) == 4
        assert cost[range(4), got].sum() == min(cost[range(4), list(p)].sum() for p in itertools.permutations(range(6), 4))


def test_bradley_terry_orders_by_wins():
    wins = np.array([[0, 8, 9], [2, 0, 7], [1, 3, 0]], float)
    s = grouped.strengths(wins)
    assert s[0] > s[1] > s[2]
    assert abs(np.log(s).mean()) < 1e-9


def test_leaf_order_joins_near_leaves():
    d = np.array([[0, 9, 1, 9], [9, 0, 9, 2], [1, 9, 0, 9], [9, 2, 9, 0]], float)
    order = grouped.leaf_order(d)
    assert abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1


def test_token_bucket_blocks_a_burst():
    rows = pd.DataFrame({"voter": 1, "event_id": range(32), "t": [0.0] * 31 + [60.0]})
    got = votes.take(rows, votes.TOKENS, None)[0]
    assert got["allowed"].tolist() == [True] * 30 + [False, True]


def test_streamed_bucket_equals_the_batch(spark, tmp_path):
    rows = pd.DataFrame({"voter": [1] * 40 + [2] * 5, "event_id": range(45), "t": [float(i) for i in range(40)] + [0.0] * 5})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("voter long, event_id long, t double").parquet(str(tmp_path / "in"))
    query = votes.token_bucket_stream(source).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    key = ["voter", "event_id"]
    want = votes.token_bucket(spark.createDataFrame(rows)).toPandas().sort_values(key, ignore_index=True)
    assert spark.table("bucket").toPandas().sort_values(key, ignore_index=True).equals(want)


def test_documents_roundtrip(spark, tmp_path):
    pair = {"batch_id": "b", "variant": "min", "config_a": "z", "config_b": "a", "kind": "cross", "channels": ["c"], "pairs": [{"slot_a": 1, "slot_b": 2, "s": {"c": 0.5, "d": None}, "diagnostics": {}}]}
    (tmp_path / "p.json").write_text(json.dumps(pair))
    rows = documents.pair_scores(documents.read_documents(spark, "pairs", str(tmp_path / "p.json"))).orderBy("channel").collect()
    assert [(r.config_a, r.config_b, r.slot_a, r.slot_b, r.channel, r.s) for r in rows] == [("a", "z", 2, 1, "c", 0.5), ("a", "z", 2, 1, "d", None)]
    old, new = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert [tuple(r) for r in documents.insert_absent(old, new, ["k"]).collect()] == [(2, "z")]
    assert documents.canonical(spark.sql("SELECT double('-0.0') AS b, double('NaN') AS c, 1 AS a")).first().value == '{"a":1,"b":0.0}'
    lines = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"hi"}}]}',), ("",), ("data: [DONE]",)], "value string")
    assert [(r.content, r.done) for r in documents.stream_lines(lines).collect()] == [("hi", False), (None, True)]


def test_text_functions(spark):
    good, bad = "0 52 52.52 13.405 -13.405 -0.5".split(), "-0 05 1.50 1. 1e5 +5 .5 00 -0.0 52.520".split()
    df = spark.createDataFrame([(x,) for x in good + bad], "x string")
    assert [r.x for r in df.filter(text.is_decimal(F.col("x"))).collect()] == good
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x")).alias("y")).first().y
    assert one(text.folded, "  Straße \n É ") == "strasse é"
    assert one(text.extract_html, "<think>x</think>Here:\n```html\n<html><p>a</p></html>\n```\nbye") == "<html><p>a</p></html>"
    assert one(text.extract_html, "sorry") is None
    assert one(text.hsl_bucket, "ff0000") == "h00_l1" and one(text.hsl_bucket, "808080") == "achr:1"
    assert float(one(lambda c: text.display_round(c, 0), "2.5")) == 3
