"""Channels and grouped operators against values made by hand or by brute force."""

import hashlib
import itertools
import json
import lzma
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from weftline.operators import features, grouped
from weftline.plans import aggregates, channels, views

HTML = """<html><head><style>a{color:#f00;width:10px} .b{background: rgb(0, 0, 255); color: white; width:calc(1px + 2em)}</style></head>
<body><div class="btn-x btn__y main">x</div><script>let a = 'q' + 1; // no
if (a === `t`) { a?.b(); }</script></body></html>"""


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    rows = [(0, "u", HTML), (1, "v", "plain"), (2, "w", HTML.replace("#f00", "#0f0"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def vector(spark, folder, view, slot=0):
    return {r.token: r.value for r in views.dataframe(spark, folder, view).filter(f"slot = {slot}").collect()}


def test_vectors_of_a_card(spark, made):
    assert vector(spark, made, "color_buckets") == {"h0_l1": 1, "h8_l1": 1, "achr:2": 1}
    assert vector(spark, made, "css_units") == {"unit:px": 2, "unit:em": 1, "fn:rgb": 1, "fn:calc": 1, "colfmt:hex3": 1, "colfmt:rgb": 1}
    assert vector(spark, made, "css_properties") == {"color": 2, "width": 2, "background": 1}
    assert vector(spark, made, "naming_values") == pytest.approx({"style:utility": 1 / 3, "style:bem": 1 / 3, "style:single": 1 / 3, "class_density": 3 / 6, "mean_len": 15 / 3 / 20, "uniq_ratio": 1})
    words = ["kw:let", "NAME", "op:=", "STR", "op:+", "NUM", "op:;", "kw:if", "op:(", "NAME", "op:===", "TMPL", "op:)", "op:{", "NAME", "op:?.", "NAME", "op:(", "op:)", "op:;", "op:}"]
    want: dict = {}
    for a, b in itertools.pairwise(words):
        want[f"{a} {b}"] = want.get(f"{a} {b}", 0) + 1
    assert vector(spark, made, "script_bigrams") == want
    scores = {(r.slot_a, r.slot_b): r.s for r in views.dataframe(spark, made, "x_color_pairs").collect()}
    assert scores == {(0, 1): None, (0, 2): pytest.approx(2 / 3, abs=1e-6), (1, 2): None}


def test_parents_are_the_open_elements(spark):
    cards = spark.createDataFrame([(0, "c", 0, 1, "<a><b><br><c></c></b><d></d></a><e></e>")], "batch long, config string, config_ord int, slot long, html string")
    rows = {r.tag: r for r in features.dom_nodes(cards).collect()}
    place = {r.pos: t for t, r in rows.items()}
    assert {t: place.get(r.parent) for t, r in rows.items()} == {"a": None, "b": "a", "br": "b", "c": "b", "d": "a", "e": None}


def test_shared_views_follow_their_tables(spark, tmp_path):
    def write(n):
        spark.createDataFrame([(i, "u", f"<p class='c{i}'>text {i} text</p>") for i in range(n)], "page_id long, url string, html string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
        return views.dataframe(spark, str(tmp_path), "nodes").count()

    first = write(3)
    time.sleep(0.05)
    assert (first, write(5)) == (3, 5)


def test_strengths_leave_zeros_out():
    wins = np.array([[0, 3, 2, 0], [1, 0, 2, 0], [0, 0, 0, 0], [0, 0, 0, 0.0]])
    got = grouped.strengths(wins)
    assert got[2] == 0 and np.exp(np.log(got[got > 0]).mean()) == pytest.approx(1) and got[0] > got[1] > 0


def test_merged_clusters_go_last():
    d = np.array([[0, 0.5, 0.1, 0.9], [0.5, 0, 0.6, 0.4], [0.1, 0.6, 0, 0.8], [0.9, 0.4, 0.8, 0]])
    assert grouped.leaf_order(d) == [0, 2, 1, 3]
    assert grouped.leaf_order(np.array([[0, 0.9, 0.9], [0.9, 0, 0.1], [0.9, 0.1, 0]])) == [0, 1, 2]
    assert grouped.leaf_order(np.zeros((0, 0))) == []


def test_pooled_permutation_is_near_the_exact_p(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(0.4, 1, 12)
    exact = np.mean([abs(np.dot(s, d)) >= abs(d.sum()) - 1e-9 for s in itertools.product((-1, 1), repeat=12)])
    blocks = spark.createDataFrame(pd.DataFrame({"unit": [16] * 12, "block": range(12), "run_min": 0.0, "run_q": d})).repartition(3)
    got = grouped.pooled_permutation(blocks).first()
    assert got.p == pytest.approx(exact, abs=0.02) and got.t_obs == pytest.approx(d.mean(), abs=1e-6)


def test_registry():
    assert len(aggregates.REGISTRY) == 22 and set(aggregates.CHANNELS) <= set(aggregates.REGISTRY)
    assert set(aggregates.SETS) | set(aggregates.VECTORS) | {"d-pqgram", "d-geom"} == set(aggregates.CHANNELS)
    assert json.dumps(channels.JS_WORDS)


def test_assignments_follow_their_rule(spark):
    rows = [("ab" * 32, i, f"config {i}", 4) for i in range(5)] + [("ab" * 32, 5, "u\u0308", 3), ("ab" * 32, 6, "\u00fc", 3)]
    got = {r.config_ord: r for r in grouped.assignment_table(spark.createDataFrame(rows, "manifest_hash string, config_ord int, config_id string, n int")).collect()}
    for r in got.values():
        n = 3 if r.config_ord > 4 else 4
        allowed = [x for x in range(2**n) if abs(bin(x).count("1") * 2 - n) <= 1]
        assert (r.omega_size, r.omega_value) == (len(allowed), allowed[r["rank"]]) and int(r.bits, 2) == r.omega_value and len(r.bits) == n
    assert got[5].seed_assign == got[6].seed_assign and len({r.seed_assign for r in got.values()}) == 6
    digest = hashlib.sha256(b"assign\0" + b"\xab" * 32 + b"\0config 0\0\x04").digest()
    assert got[0].seed_assign == str(sum(b << 8 * i for i, b in enumerate(digest[:8])))


def test_compression_distance(spark):
    texts = {0: "abc " * 200, 1: "abc " * 190 + "xyz", 2: "".join(chr(97 + i * i % 23) for i in range(900)), 3: None, 4: ""}
    cards = spark.createDataFrame(list(texts.items()), "slot long, html string")
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "slot_a long, slot_b long")
    got = {(r.slot_a, r.slot_b): r.s for r in grouped.compression_distance(pairs, cards).collect()}
    size = lambda x: len(lzma.compress(x.encode(), preset=6))
    for (a, b), s in got.items():
        x, y = texts[a], texts[b]
        if not x or not y:
            assert s is None
        else:
            d = sum((size(p) - min(size(x), size(y))) / max(size(x), size(y)) for p in (x + y, y + x)) / 2
            assert s == pytest.approx(1 - min(max(d, 0), 1), abs=1e-6)
    assert len(got) == 10 and got[0, 1] > got[0, 2]


def test_compression_pairs_of_a_batch_equal_those_of_given_pairs(spark):
    texts = ["abc " * 200, "abc " * 190 + "xyz", None, "", "e\u0301" * 90]
    cards = spark.createDataFrame([(i // 5, f"c{i % 2}", i % 2, i, texts[i % 5]) for i in range(10)], "batch long, config string, config_ord int, slot long, html string")
    got = {(r.slot_a, r.slot_b): r.s for r in grouped.compression_pairs(cards).collect()}
    assert len(got) == 20 and all(a // 5 == b // 5 for a, b in got)
    pairs = spark.createDataFrame(list(got), "slot_a long, slot_b long")
    assert got == {(r.slot_a, r.slot_b): r.s for r in grouped.compression_distance(pairs, cards).collect()}


@pytest.mark.parametrize("n", [1, 70_000, 1 << 18])
def test_a_dictionary_that_holds_the_text_gives_the_size_of_the_preset(n):
    rng = np.random.default_rng(n)
    x = bytes(rng.choice(np.frombuffer(b"<div class='abc'> text", np.uint8), n))
    assert n <= grouped.dictionary(n) <= 1 << 23 and grouped.compressed(x.decode()) == len(lzma.compress(x, preset=6))


def test_sizes_are_those_of_the_preset_where_a_search_ends_early(spark):
    x = "\n".join(f"<li id={i:06d}>{i}</li>" for i in range(1000))
    y = "\n".join(f"<li>{i * 65537 % 1_000_003:06d}</li>" for i in range(1000))
    size = lambda t: len(lzma.compress(t.encode(), preset=6))
    assert grouped.compressed(x + y) == size(x + y)
    cards = spark.createDataFrame([(0, "c0", 0, 0, x), (0, "c1", 1, 1, y)], "batch long, config string, config_ord int, slot long, html string")
    d = sum((size(p) - min(size(x), size(y))) / max(size(x), size(y)) for p in (x + y, y + x)) / 2
    assert [tuple(r) for r in grouped.compression_pairs(cards).collect()] == [(0, 1, round(1 - d, 6))]


def test_cosines_are_sums_in_the_order_of_tokens():
    lists = [[("b", 0.1), ("a", 3.0)], [("a", 3.0), ("b", 0.1)], None, [("c", 2.0), ("a", 1e-3), ("b", 7.7)]]
    column = pa.chunked_array([pa.array([x and [{"token": t, "value": v} for t, v in x] for x in lists], pa.list_(pa.struct([("token", pa.string()), ("value", pa.float64())])))])
    s, n = features.cosines(column)
    assert n.tolist() == [2, 2, 0, 3] and s[0, 1] == 1.0
    assert s[0, 3] == (3.0 * 1e-3 + 0.1 * 7.7) / np.sqrt((9.0 + 0.1 * 0.1) * ((1e-3 * 1e-3 + 7.7 * 7.7) + 4.0))
    with pytest.raises(ValueError):
        features.cosines(pa.chunked_array([pa.array([[{"token": "a", "value": 1.0}, {"token": "a", "value": 2.0}]])]))
