"""Facts as spans against a quadratic scan, and bindings against all combinations."""

import itertools
import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from weftline.operators import spans

PIECES = ["high", "LOW", "max", "maximum", "hi", "lo", "12°c", "-3.5 °", "−7℃", "3–5°", "13:00", "3 pm", "12 AM", "15h", "9:30°", "7", "and", "12:45", "2.25°f", "min", "18°", "highest", ","]


def scan(line):
    """All hits of all patterns, then the leftmost longest one by looking at every hit again and again."""
    if line is None:
        return []
    line, found, out, end = line.lower(), [], [], 0
    for pattern, category, expression in spans.PATTERNS:
        found += [(m.start(), m.end(), pattern, category) for m in re.finditer(expression, line)]
    while rest := [h for h in found if h[0] >= end]:
        start = min(h[0] for h in rest)
        stop = max(h[1] for h in rest if h[0] == start)
        same = [h for h in rest if h[:2] == (start, stop)]
        kinds = {h[3] for h in same}
        name = "temperature" if "temperature" in kinds else "max-label" if "max" in kinds else "min-label" if "min" in kinds else "hourly-label"
        hit, value, hour = line[start:stop], None, None
        if name == "temperature":
            value = re.match(spans.NUMBER, hit)[0] if re.match(spans.NUMBER, hit) else re.search(spans.NUMBER, hit)[0]
            value = "-" + value[1:] if value[0] in spans.MINUS else value
        if name == "hourly-label":
            k = int(re.match(r"\d+", hit)[0])
            hour = k % 12 + 12 * ("pm" in hit) if hit.endswith("m") else k
        out.append((start, stop, min(h[2] for h in same), name, None if value is None else Decimal(value), None if value is None else len(value.partition(".")[2]), hour))
        end = stop
    return out


def bound(lines):
    """The rule over all combinations of labels and values."""
    base, facts = 0, []
    for k, line in enumerate(lines):
        facts += [(s[3], (k, s[0]), base + s[0], s[4]) for s in scan(line)]
        base += len(line or "")
    temps = [f for f in facts if f[0] == "temperature"]
    high, low = ([f for f in facts if f[0] == x] for x in ("max-label", "min-label"))
    far = lambda a, b: (0 if a[1][0] == b[1][0] else 2, abs(a[2] - b[2]))
    if not temps:
        return ("E-empty", "not-found", None, None)
    if high and low:
        branch, options = "double-label", []
        for a, x, b, y in itertools.product(high, temps, low, temps):
            if x[1] != y[1]:
                p, q = far(a, x), far(b, y)
                options.append(((p[0] + q[0], p[1] + q[1]), p, q, x[1], y[1], a[1], b[1], x, y))
        pair = min(options)[-2:] if options else (None, None)
    elif high or low:
        branch, pair = "single-label", (None, None)
        if len(temps) < 3:
            t = min((far(a, x), x[1], a[1], x) for a in high or low for x in temps)[-1]
            rest = [x for x in temps if x[1] != t[1]]
            other = rest[0] if rest else None
            pair = (t, other) if high else (other, t)
    else:
        branch, pair = "no-label", (None, None)
        if len(temps) < 3:
            pair = min(temps, key=lambda x: (-x[3], x[1])), min(temps, key=lambda x: (x[3], x[1]))
    state = "ambiguous" if None in pair or pair[0][3] == pair[1][3] else "bound"
    return (branch, state, *(x and (*x[1], x[3]) for x in pair))


def lines_of(seed, n):
    rng = random.Random(seed)
    return [(u, k, None if rng.random() < 0.03 else " ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7)))) for u in range(n) for k in range(rng.randint(1, 4))]


def test_spans_equal_a_quadratic_scan(spark):
    rows = lines_of(1, 400)
    got = spans.fact_spans(spark.createDataFrame(rows, "unit long, k int, line string"), ["unit", "k"]).collect()
    want = [(u, k, *s) for u, k, line in rows for s in scan(line)]
    assert sorted((r.unit, r.k, r.start, r.stop, r.pattern, r.namespace, r.value, r.decimals, r.hour) for r in got) == sorted(want, key=lambda x: x[:4]) and len(want) > 1000
    assert not any(r.voided for r in got)


def test_same_spans_merge_and_both_labels_are_void(spark):
    x = [(0, -3, "a", 3, "max", "abc"), (0, -3, "b", 3, "min", "abc"), (1, -5, "a", 6, "max", "bcdef"), (3, -1, "a", 4, "min", "d"), (3, -2, "b", 5, "max", "de")]
    df = spark.createDataFrame([(x,)], "x array<struct<start int, longest int, pattern string, stop int, category string, hit string>>")
    got = df.select(F.explode(spans.leftmost_longest(F.col("x"))).alias("y")).select("y.*").collect()
    assert [(r.start, r.stop, r.pattern, r.categories) for r in got] == [(0, 3, "a", ["max", "min"]), (3, 5, "b", ["max"])]


def test_bindings_equal_all_combinations(spark):
    rows = lines_of(2, 500)
    lines = spark.createDataFrame(rows, "unit long, k int, line string").fillna("", ["line"])
    got = {r.unit: r for r in spans.bound_extremes(spans.fact_spans(lines, ["unit", "k"]), lines, "unit", "k").collect()}
    units = {u: [line or "" for _, _, line in g] for u, g in itertools.groupby(rows, lambda r: r[0])}
    seen = set()
    for u, texts in units.items():
        branch, state, high, low = bound(texts)
        r = got[u]
        assert (r.branch, r.state) == (branch, state), (u, texts)
        assert ((r.max_line, r.max_start, r.max_value) if r.max_line is not None else None, (r.min_line, r.min_start, r.min_value) if r.min_line is not None else None) == (high, low), (u, texts)
        seen.add((branch, state))
    assert len(seen) >= 7
