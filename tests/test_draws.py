"""Draws by weight against plain ones, and their shares."""

import collections
import hashlib
import math

from pyspark.sql import functions as F

from weftline.operators import draws


def h(*of):
    return int(hashlib.sha256(":".join(str(x) for x in of).encode()).hexdigest()[:15], 16)


def plain_pairs(asks, pool):
    out, by = [], collections.defaultdict(list)
    for variant, config, votes in pool:
        by[variant].append((hashlib.sha256(config.encode()).hexdigest()[:2], config, max(10**9 // (1 + (votes or 0)), 1)))
    for ask, variant in asks:
        line = sorted(by[variant])
        if len(line) < 2:
            continue
        left, a = (h("issue", "a", ask) * sum(w for *_, w in line)) >> 60, 0
        while left >= line[a][2]:
            left -= line[a][2]
            a += 1
        b = (a + 1 + ((h("issue", "b", ask) * (len(line) - 1)) >> 60)) % len(line)
        out.append((ask, variant, line[a][1], line[b][1]))
    return sorted(out)


def test_pairs_equal_a_plain_walk_and_their_shares(spark):
    pool = [("q", f"c{i}", i * i % 37) for i in range(300)] + [("min", f"c{i}", 10_000_000_000 if i else 0) for i in range(5)] + [("one", "c", 1)]
    pool[7] = ("q", "c7", None)
    asks = [(i, ("q", "min", "one", "none")[i % 4]) for i in range(4000)]
    of_pool = spark.createDataFrame(pool, "variant string, config string, votes long")
    pairs = draws.issue_pairs(spark.createDataFrame(asks, "ask long, variant string").repartition(7), of_pool)
    got = sorted(tuple(r) for r in pairs.collect())
    assert got == plain_pairs(asks, pool) and len(got) == 2000 and all(a != b for *_, a, b in got)
    hot = collections.Counter(a for _, v, a, _ in got if v == "min")
    assert hot["c0"] == 1000  # all others weigh a 10 ** 9th
    others = collections.Counter(b for _, v, _, b in got if v == "min")
    assert set(others) == {"c1", "c2", "c3", "c4"} and min(others.values()) > 200
    weight = {c: 1 / (1 + (n or 0)) for v, c, n in pool if v == "q"}
    fresh = {c for c, w in weight.items() if w == 1}
    want, seen = sum(weight[c] for c in fresh) / sum(weight.values()), sum(a in fresh for _, v, a, _ in got if v == "q") / 1000
    assert abs(seen - want) < 4 * math.sqrt(want * (1 - want) / 1000)


def test_shares_are_exact(spark):
    cases = [(2**60 - 1, 10**18), (2**60 - 1, 7), (0, 5), (2**59, 3), (384307168202282325, 3)]
    got = spark.createDataFrame(cases, "h long, n long").select(draws.share(F.col("h"), F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == [h * n >> 60 for h, n in cases]


def test_pairs_without_rows(spark):
    none = spark.createDataFrame([], "variant string, config string, votes long")
    asks = spark.createDataFrame([(1, "q")], "ask long, variant string")
    assert draws.issue_pairs(asks, none).count() == 0 and draws.issue_pairs(asks.limit(0), none).count() == 0


def test_sample_without_replacement(spark):
    rows = [(f"g{i % 3}" if i % 3 else "hot", i, [0.5, 1.0, 4.0, None, 0.0][i % 5], "mine") for i in range(3000)]
    data = spark.createDataFrame(rows, "grp string, item long, weight double, place string").drop("place").repartition(9)
    taken = draws.weighted_sample(data, "grp", "item", "weight", 40)
    got = sorted((r.grp, r.place, r.item) for r in taken.collect())
    want = []
    for grp in ("hot", "g1", "g2"):
        keys = sorted((-math.log((h("draw", grp, i) + 0.5) / 2**60) / w, i) for g, i, w, _ in rows if g == grp and w)
        want += [(grp, k, i) for k, (_, i) in enumerate(keys[:40], 1)]
    assert got == sorted(want)
    assert "WindowGroupLimit" in taken._jdf.queryExecution().executedPlan().toString()
    by = collections.Counter(rows[i][2] for _, _, i in got)
    assert by[4.0] > by[1.0] and set(by) <= {0.5, 1.0, 4.0}
