"""Randomization tests against direct enumeration."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import hypotheses


def direct(observed, score, scalar, least):
    """T of each assignment by sets of runs; ``score`` by pairs of runs (block, side), or ``scalar`` by run."""
    out = []
    omega = [bits for bits in itertools.product((0, 1), repeat=5) if sum(bits) in (2, 3)]
    for bits in omega:
        sides = ([], [])
        for k in range(5):
            first, second = (0, 1) if omega[observed][k] == 0 else (1, 0)  # which outcome ran first and second
            sides[0].append((k, first if bits[k] == 0 else second))
            sides[1].append((k, second if bits[k] == 0 else first))
        means = []
        for side in sides:
            values = [score[frozenset(p)] for p in itertools.combinations(side, 2)] if score else [scalar[r] for r in side]
            values = [v for v in values if v is not None]
            means.append(sum(values) / len(values) if len(values) >= least else None)
        out.append(None if None in means else means[1] - means[0])
    return out


def same(a, b):
    return len(a) == len(b) and all((x is None or np.isnan(x)) == (y is None) and (y is None or abs(x - y) < 1e-12) for x, y in zip(a, b, strict=True))


def case(rng, hole):
    runs = [(k, v) for k in range(5) for v in (0, 1)]
    value = lambda: None if rng.random() < hole else rng.random()
    return {frozenset(p): value() for p in itertools.combinations(runs, 2)}, {r: value() for r in runs}


def test_tables_equal_enumeration():
    rng = random.Random(7)
    number = lambda r: 2 * r[0] + r[1]
    undefined = 0
    for _ in range(60):
        score, scalar = case(rng, rng.choice([0, 0.2, 0.6]))
        observed = rng.randrange(20)
        entries = [{"i": min(map(number, p)), "j": max(map(number, p)), "s": s} for p, s in score.items()]
        want = direct(observed, score, None, 4)
        undefined += None in want
        assert same(hypotheses.t_table(observed, entries, 4), want)
        assert same(hypotheses.t_table(observed, [{"i": number(r), "j": number(r), "s": s} for r, s in scalar.items()], 1), direct(observed, None, scalar, 1))
    assert undefined
    assert same(hypotheses.t_table(0, [], 1), [None] * 20)


def test_units_exact_and_pooled(spark):
    rng = random.Random(11)
    slots, pairs, scalars, want = [], [], [], {}
    ids = iter(rng.sample(range(10_000), 200))
    for batch, config in ((0, 0), (0, 1), (7, 3)):
        got = {(k, v): s for v in (0, 1) for k, s in enumerate(sorted(next(ids) for _ in range(5)))}
        slots += [(batch, config, v, s) for (k, v), s in got.items()]
        score, scalar = case(rng, 0)
        want[f"u-{batch}-{config}"] = score, scalar
        for p, s in score.items():
            a, b = sorted(p)
            pairs += [("v-x", got[a], got[b], s), ("c-null", got[b], got[a], None if p == frozenset([(0, 0), (1, 0)]) else s), ("c-none", got[a], got[b], None)]
        scalars += [(got[r], "brightness", x + r[1]) for r, x in scalar.items()]
    slots += [(8, 0, v, next(ids)) for v in (0, 0, 0, 0, 0, 1, 1, 1, 1)] + [(9, 0, v, next(ids)) for v in (0, 0, 0, 0, 0, 0, 1, 1, 1, 1)]  # units without all runs
    pairs.append(("v-x", slots[-1][3], slots[-2][3], 0.5))
    runs = hypotheses.unit_runs(spark.createDataFrame(slots, "batch long, config_ord int, side int, slot long"))
    seen = {r.unit: r.observed for r in runs.select("unit", "observed").distinct().collect()}
    assert set(seen) == set(want)
    tables = hypotheses.t_tables(runs, spark.createDataFrame(pairs, "channel string, slot_a long, slot_b long, s double"), spark.createDataFrame(scalars, "slot long, scalar string, v double"))
    by = {(r.target, r.unit): (r.observed, r.t) for r in tables.collect()}
    for unit, (score, scalar) in want.items():
        assert same(by["v-x", unit][1], direct(seen[unit], score, None, 4))
        assert same(by["brightness", unit][1], direct(seen[unit], None, {r: x + r[1] for r, x in scalar.items()}, 1))
    for r in hypotheses.exploratory(tables).collect():
        o, t = by[r.target, r.unit]
        assert r.p == (None if None in t else sum(abs(x) >= abs(t[o]) - 1e-12 for x in t) / 20)
        assert r.hypothesis_id == f"H-exploratory-{r.unit}-{'channel' if r.kind == 'channel' else 'l1'}-{r.target}"
    family = spark.createDataFrame([("channel", "v-x", 0), ("channel", "c-null", 1), ("channel", "c-none", 2), ("l1-scalar", "brightness", 3), ("l1-scalar", "absent", 4)], "kind string, target string, ord int")
    out = {r.target: r for r in hypotheses.pooled(tables, family).collect()}
    for target in ("v-x", "brightness", "c-null"):
        ts = [by[target, u] for u in want]
        t_obs = sum(t[o] for o, t in ts) / 3
        exact = np.mean([abs(sum(c) / 3) >= abs(t_obs) - 1e-9 for c in itertools.product(*[t for _, t in ts])])
        assert abs(out[target].t_obs - t_obs) < 1e-8 and abs(out[target].p - exact) < 0.02, (target, exact)
    assert (out["c-none"].p, out["c-none"].n_null, out["c-none"].n_units, out["absent"].p, out["absent"].n_units, out["c-none"].place) == (None, 3, 3, None, 0, None)
    order = sorted((r for r in out.values() if r.p is not None), key=lambda r: r.place)
    worst = 0
    for i, r in enumerate(order):
        worst = max(worst, min(1.0, (5 - i) * r.p))
        assert r.place == i + 1 and abs(r.p_holm - worst) < 1e-12
    again = {r.target: r.p for r in hypotheses.pooled(tables.repartition(3), family).collect()}
    assert again == {k: r.p for k, r in out.items()}
