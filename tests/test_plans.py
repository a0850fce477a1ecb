"""Plans of views on many channels, and pairs of a batch, against values found plainly."""

import itertools
import re

import numpy as np
import pytest

from weftline.operators import features, grouped, hypotheses
from weftline.plans import aggregates, views

PAGES = [(i, "u", "".join(f"<{t}><{u} class='c{i}'>x</{u}></{t}>" for t in ("div", "p", "ul")[: i % 4] for u in ("b", "li")[: i % 3])) for i in range(24)]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def test_no_plan_holds_all_channels(spark, pages):
    made = {}
    frames = [views.dataframe(spark, pages, x, made) for x in views.VIEWS["pair_scores"].inputs]
    parts = aggregates.pair_scores(spark, pages, *frames)
    assert len(parts) == len(aggregates.CHANNELS)
    exchanges = [len(re.findall(r"Exchange ", x._jdf.queryExecution().executedPlan().toString())) for x in parts]
    assert max(exchanges) < 30
    assert {r.channel for r in views.dataframe(spark, pages, "pair_scores").select("channel").distinct().collect()} == set(aggregates.CHANNELS)


def test_pairs_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    sets = [set(rng.integers(0, 30, rng.integers(0, 25)).tolist()) for _ in range(9)]
    rows = [(i // 5, f"c{i % 3}", i % 3, i, sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "batch long, config string, config_ord int, slot long, tokens array<long>")
    got = {(r.slot_a, r.slot_b): (r.kind, r.shared, r.s) for r in features.jaccard_pairs(df).collect()}
    place = lambda i: (i % 3, i)
    want = {}
    for i, j in itertools.combinations(range(9), 2):
        if i // 5 == j // 5:
            a, b = sorted((i, j), key=place)
            x, y = sets[a], sets[b]
            want[a, b] = ("self" if i % 3 == j % 3 else "cross", len(x & y), len(x & y) / len(x | y) if x and y else None)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert [got[k][2] for k in sorted(want)] == pytest.approx([want[k][2] for k in sorted(want)])


def test_overlap_equals_a_loop_without_a_broadcast(spark):
    rng = np.random.default_rng(5)
    grids = rng.integers(0, 50, (7, 640)) * (rng.random((7, 640)) < 0.3)
    grids[3] = 0
    cards = spark.createDataFrame([(0, f"c{i}", i, i) for i in range(7)], "batch long, config string, config_ord int, slot long")
    cells = spark.createDataFrame([(i, t, int(v)) for i in range(7) for t, v in enumerate(grids[i]) if v], "slot long, token int, v long")
    found = features.overlap_pairs(cards, cells)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        x, y = grids[r.slot_a], grids[r.slot_b]
        assert r.s == (pytest.approx(np.minimum(x, y).sum() / np.maximum(x, y).sum()) if x.any() and y.any() else None)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 7])
def test_assignments_of_many_units_equal_one_by_one(n):
    rng = np.random.default_rng(n)
    value = rng.integers(0, 97, (60, n)).astype(float)
    value[:25] = rng.integers(0, 7, (25, n))  # many ties
    cost = np.rint((value[:, :, None] - np.linspace(0, 97, 24)) ** 2 * 1e6)
    assert grouped.first_assignments(cost).tolist() == [grouped.first_assignment(c) for c in cost]


def test_hours_need_no_task_for_each_unit(spark):
    rows = [(u, p, float((u * 31 + p * 17) % 97)) for u in range(40) for p in range(1 + u % 6)]
    found = grouped.hourly_assignment(spark.createDataFrame(rows, "unit long, point long, value double"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.unit, r.point): (r.hour, r.cost) for r in found.collect()}
    for u in range(40):
        value = np.array([v for x, _, v in rows if x == u])
        cost = (value[:, None] - np.linspace(0, 97, 24)) ** 2
        for p, h in enumerate(grouped.first_assignment(np.rint(cost * 1e6))):
            assert got[u, p] == (h, pytest.approx(cost[p, h], abs=1e-6))


def test_draws_are_summed_once(spark):
    blocks = spark.createDataFrame([(u, b, 1.0, 2.0 + b) for u in range(4) for b in range(3)], "unit long, block long, run_min double, run_q double")
    tables = spark.createDataFrame([("channel", "c", "u", 0, [0.5, 0.25])], "kind string, target string, unit string, observed int, t array<double>")
    family = spark.createDataFrame([("channel", "c", 0)], "kind string, target string, ord int")
    for found in (grouped.pooled_permutation(blocks, draws=70), hypotheses.pooled(tables, family, draws=70)):
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
