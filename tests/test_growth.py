"""Plans whose memory or time grew faster than the tables: what must not come back, and plain values of what replaced it."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest

from weftline.operators import features, grouped, spans
from weftline.plans import catalog, views  # noqa: F401  all views


def plan(df) -> list[str]:
    return re.findall(r"[A-Z]\w+", df._jdf.queryExecution().executedPlan().toString())


def test_no_row_is_made_for_an_assignment(spark):
    rows = [(u, k, (7 * u + 3 * k) % 11, (5 * u + k) % 13, (u + k) % 2) for u in range(4) for k in range(u + 1)]
    blocks = spark.createDataFrame(rows, "unit long, block int, run_min long, run_q long, bit int")
    made = {"block_groups": blocks}
    found = views.dataframe(spark, "", "exploratory_p", made)
    assert not [x for x in plan(found) if x.endswith("Join")]
    want = {}
    for u in range(1, 4):
        unit, n = [r for r in rows if r[0] == u], u + 1
        t = [sum(r[3] - r[2] if (o >> r[1]) % 2 == r[4] else r[2] - r[3] for r in unit) / n for o in range(2**n) if abs(n - 2 * o.bit_count()) <= 1]
        seen = sum(r[3] - r[2] for r in unit) / n
        want[u] = (round(seen, 6), len(t), round(sum(abs(x) >= abs(seen) - 1e-9 for x in t) / len(t), 6))
    assert {r.unit: (r.t_obs, r.omega_size, r.p) for r in found.collect()} == want
    assert views.dataframe(spark, "", "t_table", made).count() == sum(x[1] for x in want.values())


def test_best_lines_without_a_window(spark):
    rows = [(o, k, float((3 * o + 5 * k * k) % 7)) for o in range(20) for k in range(1, 2 + o % 7)]
    found = views.dataframe(spark, "", "label_binding", {"lineitem": spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double")})
    assert "Window" not in plan(found)
    want = {}
    for o in range(20):
        mine = [r for r in rows if r[0] == o]
        if pairs := [(abs(a[1] - b[1]), b[2] - a[2], a[1], b[1]) for a, b in itertools.permutations(mine, 2) if a[2] > b[2]]:
            want[o] = min(pairs)[2:]
    assert {r.l_orderkey: (r.max_line, r.min_line) for r in found.collect()} == want


def test_values_of_a_line_are_not_expanded(spark):
    lines = [(1, 1, "high 3° low 2°"), (1, 2, "high 3° high 3° low 3°"), (1, 3, "max 1° max 2° low 0°"), (1, 4, "max/min 4°"), (1, 5, "low 4°")]
    found = views.dataframe(spark, "", "fact_binding", {"fact_lines": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, line string")})
    assert "Expand" not in plan(found)
    want = {1: ("bound", 3, 2, 0), 2: ("ambiguous", 3, 3, 0), 3: ("several", None, 0, 0), 4: ("not-shown", None, None, 1), 5: ("single", None, 4, 0)}
    assert {r.l_linenumber: (r.state, r.high, r.low, r.n_void) for r in found.collect()} == want


def test_grids_are_compared_a_few_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pairs = spark.createDataFrame([(i, i + 1, rng.random(64).tolist(), rng.random(64).tolist()) for i in range(40)], "a long, b long, x array<float>, y array<float>")
    whole = grouped.structural_similarity(pairs)
    assert "MapInArrow" in plan(whole)
    monkeypatch.setattr(grouped, "PAIRS_HELD", 7)
    assert sorted(whole.collect()) == sorted(grouped.structural_similarity(pairs).collect())


def test_pages_and_texts_are_cut_by_plain_rules(spark):
    html = ["<P>a\U0001f600bc</p>  /* x */ <b class='q.w'>1.5 \"s\" .cls it's</b>", "abc", "", "<a><b/><b></b></a><c></c>" * 3]
    cards = spark.createDataFrame([(0, f"c{i}", i, i, h) for i, h in enumerate(html)], "batch long, config string, config_ord int, slot long, html string")
    normal = [r[0] for r in cards.orderBy("slot").select(features.normal_html(cards.html)).collect()]
    shingles = features.char_shingles(cards)
    assert "MapInArrow" in plan(shingles)
    assert {r.slot: len(set(r.tokens)) for r in shingles.collect()} == {i: len({t[j : j + 5] for j in range(len(t) - 4)}) for i, t in enumerate(normal)}
    want = {}
    for i, h in enumerate(html):
        t = [features.kind_of(x) for x in re.findall(features.LEXER, h)]
        g = [hashlib.sha256("\n".join(t[j : j + 5]).encode()).hexdigest()[:16] for j in range(len(t) - 4)]
        w = min(4, len(g))
        want[i] = {min(g[j : j + w]) for j in range(len(g) - w + 1)} if g else set()
    assert {r.slot: {f"{x % 2**64:016x}" for x in r.tokens} for r in features.winnowed(cards).collect()} == want
    texts = spark.createDataFrame([(0, "en", "s", i, t) for i, t in enumerate(["a b c d 1x f", "A b c d 2 f g", "one two", None])], "batch long, variant string, config string, slot long, text string")
    found = features.text_pairs(texts)
    assert not [x for x in plan(found) if x.endswith("Join")]
    assert {(r.slot_a, r.slot_b): (r.shared, r.n_a, r.n_b) for r in found.collect() if r.slot_b < 3} == {(0, 1): (2, 2, 3), (0, 2): (None, 2, None), (1, 2): (None, 3, None)}


def test_grams_of_a_page_are_made_in_its_batch(spark):
    rng = np.random.default_rng(2)
    pages = {s: [(p, "abc"[rng.integers(3)], None if p == 0 or rng.random() < 0.1 else int(rng.integers(p))) for p in range(rng.integers(0, 12))] for s in range(5)}
    cards = spark.createDataFrame([(0, f"c{s}", s, s) for s in pages], "batch long, config string, config_ord int, slot long")
    nodes = spark.createDataFrame([(s, *n) for s, page in pages.items() for n in page], "slot long, pos int, tag string, parent int")
    found = features.dice_pairs(cards, features.elements(nodes))
    assert "Window" not in plan(found)

    def bag(page):
        tag, up, out = {p: t for p, t, _ in page}, {p: q for p, _, q in page}, Counter()
        for p, t, q in page:
            if q is not None:
                mine = [x for x, _, y in page if y == q]
                i, top = mine.index(p), tag.get(up[q], "*")
                before = (["*", "*"] + [tag[x] for x in mine[:i]])[-2:]
                out[top, tag[q], *before, t] += 1
                if p == mine[-1]:
                    out[top, tag[q], before[1], t, "*"] += 1
                    out[top, tag[q], t, "*", "*"] += 1
            if p not in up.values():
                out[tag.get(q, "*"), t, "*", "*", "*"] += 1
        return out

    bags = {s: bag(page) for s, page in pages.items()}
    for r in found.collect():
        x, y = bags[r.slot_a], bags[r.slot_b]
        assert r.shared == (x & y).total()
        assert r.s == (pytest.approx(2 * (x & y).total() / (x.total() + y.total())) if x and y else None)


def test_a_unit_of_lines_is_ordered_once(spark):
    lines = spark.createDataFrame([(1, 1, "high 3° low 2°"), (2, 1, None)], "unit long, k int, line string")
    found = plan(spans.bound_extremes(spans.fact_spans(lines, ["unit", "k"]), lines, "unit", "k"))
    assert found.count("Sort") == 1 and not [x for x in found if x.endswith("Join")]


def test_a_page_travels_as_its_boxes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pages = {s: rng.permutation(3000)[: rng.integers(0, 60)].tolist() for s in range(6)} | {6: []}
    cards = spark.createDataFrame([(0, f"c{s}", s, s) for s in pages], "batch long, config string, config_ord int, slot long")
    nodes = spark.createDataFrame([(0, f"c{s}", s, s, p) for s, page in pages.items() for p in page], "batch long, config string, config_ord int, slot long, pos int")
    made = {"cards": cards, "nodes": nodes}
    found = views.dataframe(spark, "", "layout_iou_pairs", made)
    assert "Generate" not in plan(found)  # no row for a box and cell
    monkeypatch.setattr(features, "BOXES_HELD", 7)
    want = features.overlap_pairs(cards, views.dataframe(spark, "", "occupancy", made))
    got = sorted(views.dataframe(spark, "", "layout_iou_pairs", {"cards": cards, "nodes": nodes}).collect())
    assert len(got) == 21 and got == sorted(want.collect()) == sorted(found.collect())
