"""Importance resampling, conversation tries, source mixing: against brute force, and SQL against Spark."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing, resampling, sql, tries
from weftline.llm._ranges import repeated, running


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def drawn(docs, target, percent=25, least=20):
    rows, s, t = [(i, *features(x)) for i, x in docs], Counter(), Counter()
    for _, _, f in rows:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    n, m, out = sum(s.values()), sum(t.values()), []
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in range(10000)]
    for i, words, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([words, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is not None, x[1] or 0, x[2], x[3]))
    for k, x in enumerate(able[: percent * len(able) // 100], 1):
        x[5] = k
    return sorted((tuple(x[1:]) for x in out), key=str)


def test_features_of_odd_texts():
    long = "x" * 700
    texts = pa.array(["Ünï ÀB a_b 12c", None, "", "a" * 600 + " b " + long, "one", " , ", "\x00a\x7fb\x80c"])
    words, of, buckets = resampling.feature_buckets(texts)
    for i, text in enumerate(texts.to_pylist()):
        assert (words[i], sorted(buckets[of == i].tolist())) == (features(text)[0], sorted(features(text)[1]))


def test_resampling_equals_brute_force(spark, docs, empty):
    target = spark.createDataFrame([(0, "changed word word abc"), (1, None), (2, "word x y")], "item_id long, text string")
    odd = spark.createDataFrame([(None, "word " * 30)] * 40 + [(None, "other " * 30)] * 30 + [(5, "word " * 30)] * 3, "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    got = resampling.resample(rows.withColumn("score", F.lit("taken")), target).collect()
    assert sorted((tuple(r) for r in got), key=str) == drawn([tuple(r) for r in rows.collect()], ["changed word word abc", None, "word x y"])
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(docs, target.limit(0)).filter("rank is not null").count() == len([1 for r in docs.collect() if features(r.text)[0] >= 20]) // 4
    assert resampling.drawn_documents(docs, target, percent=50).columns == [*docs.columns, "rank"]


def nodes_of(rows):
    turns, family = defaultdict(list), {}
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        family[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, q in family.items():
        ends[tuple(q)].append(c)
        for d in range(len(q) + 1):
            members[tuple(q[:d])].append(c)
            if d:
                children[tuple(q[: d - 1])].add(tuple(q[:d]))
    leaves, saved, out = {}, {}, []
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in children[n]) or 1
        saved[n] = sum(saved[x] for x in children[n]) + (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], digest))
    return sorted(out, key=str)


def talks(seed=0, n=300):
    rng, rows = random.Random(seed), []
    for c in range(n):
        shared = rng.choice([0, 0, 1, 2, 12])
        for t in range(rng.randint(1, 12)):
            text = f"turn {t}" if t < shared else rng.choice([f"own {c} {t} é", "", None, "same"])
            rows.append((c if c % 9 else 10 * n + c, rng.choice([t, None]) if c % 17 == 3 else t, rng.choice(["user", None]) if c % 13 == 1 else "user", text))
    rows += [(None, 0, "user", "lost")] * 3 + [(7000, 0, "user", "twice")] * 4 + [(7001, t, "user", f"turn {t}") for t in range(400)] + [(7003, t, "user", f"turn {t}") for t in range(390)]
    return rows + [(20000 + c, 0, "user", "turn 0") for c in range(500)]


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_trie_equals_brute_force(spark, limit):
    rows = talks()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("d", F.lit(1)).repartition(7)
    assert sorted((tuple(r) for r in tries.prefix_trie(table, limit).collect()), key=str) == nodes_of(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert tries.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, 0, "user", "x")], [(None, 0, "u", "x")], [(6, 0, "user", "a"), (8, 1, "user", "b")], [(5 * c, 0, "user", "same") for c in range(200)]):
        assert sorted((tuple(r) for r in tries.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=str) == nodes_of(rows)


def test_digests_of_long_lists(spark):
    rows = [(g % 3 - 1, g, 3 * i - 50) for g, n in ((1, 1), (2, 4000), (3, 40), (4, 3000), (5, 2)) for i in range(n)]
    got = {r.k2: r.digest for r in tries.list_digests(spark.createDataFrame(rows, "k1 long, k2 long, conv_id long").repartition(3), 200).collect()}
    assert got == {g: hashlib.sha256(",".join(str(c) for _, k, c in rows if k == g).encode()).hexdigest() for g in range(1, 6)}


def test_louds_round_trip():
    rng = np.random.default_rng(3)
    parent = np.array([-1, -1, *(rng.integers(0, i) for i in range(2, 200))])
    level = np.zeros(200, np.int64)
    for i in range(2, 200):
        level[i] = level[parent[i]] + 1
    key = np.arange(200) * 7 + 1
    mixed = rng.permutation(200)
    trie = tries.Louds(level[mixed], key[mixed], -key[mixed], key[np.maximum(parent, 0)][mixed] * (parent >= 0)[mixed], -key[np.maximum(parent, 0)][mixed] * (parent >= 0)[mixed])
    order = mixed[trie.order]
    assert len(trie.bits) == 401 and trie.bits.sum() == 200
    assert [order[p] if p >= 0 else -1 for p in trie.parents()] == parent[order].tolist()
    assert trie.children().tolist() == np.bincount(parent[2:], minlength=200)[order].tolist()
    want = np.ones(200, np.int64)
    for i in range(199, 1, -1):
        want[parent[i]] += want[i]
    assert trie.sums(np.ones(200, np.int64)).tolist() == want[order].tolist()


def test_trie_shards_store_all_light_nodes(spark):
    table = spark.createDataFrame(talks(1, 80), "conv_id long, turn long, role string, text string")
    nodes = tries.Nodes(table)
    found = tries.trie_shards(nodes.light).collect()
    assert sum(r.n_nodes for r in found) == nodes.light.count()
    for r in found:
        bits = np.unpackbits(np.frombuffer(r.louds, np.uint8))[: 2 * r.n_nodes + 1]
        assert bits.sum() == r.n_nodes and len(r.k1) == len(r.k2) == r.n_nodes


def test_running_goes_on_over_ranges(spark):
    rows = [(c, t, (c * 31 + t * 17) % 1009, t) for c, n in ((1, 5000), (2, 1), (3, 300), (4, 4000)) for t in range(n)]
    df = spark.createDataFrame(rows, "c long, t long, a long, b long").repartition(5)
    got = defaultdict(list)
    for r in running(df, "c", [F.col("t")], "test", ("a", "b")).collect():
        got[r.c].append((r.place, r.a, r.b, r.r1, r.r2))
    for v in got.values():
        x = y = 0
        for i, (place, a, b, r1, r2) in enumerate(sorted(v), 1):
            x, y = x ^ a, y ^ b
            assert (place, r1, r2) == (i, x, y)
    assert {c: len(v) for c, v in got.items()} == {1: 5000, 2: 1, 3: 300, 4: 4000}


def test_repeated_rows(spark):
    df = spark.createDataFrame([("a", 3), ("b", 25_003), ("c", 1)], "x string, n long")
    got = {r.x: (r.n, r.lo, r.hi, r.kinds) for r in repeated(df, "n", "i").groupBy("x").agg(F.count("i").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.countDistinct("i").alias("kinds")).collect()}
    assert got == {"a": (3, 1, 3, 3), "b": (25_003, 1, 25_003, 25_003), "c": (1, 1, 1, 1)}


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sizes)
    w = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    goal, capped = dict.fromkeys(names, 0.0), set()
    excess = share * sum(sizes.values())
    while excess > 1e-9 and len(capped) < len(names):
        free = sum(w[x] for x in names if x not in capped)
        for x in names:
            if x not in capped:
                goal[x] += excess * w[x] / free
        excess = 0.0
        for x in names:
            if x not in capped and goal[x] >= most * sizes[x]:
                excess, goal[x] = excess + goal[x] - most * sizes[x], most * sizes[x]
                capped.add(x)
    return goal


def test_mix_meets_its_targets(spark, docs, empty):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 3, 8, 30, 200]), rng.choice(["a", "b", "c", "é", "z", "𐀀", "￮", None])) for i in range(4000)]
    rows += [(None, "x y z", "hot")] * 3000 + [(7, None, "hot"), (8, "\x1c \x85 a\x0bb", "hot"), (9, "", "none"), (9, None, "none")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(-1)).withColumn("n", F.lit(0)).repartition(6)
    got = mixing.mix_sources(table).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.source or "", r["size"]) for r in got) == sorted((i or -1, s or "", count(t)) for i, t, s in rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    want = targets_by_hand(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert abs(r.copies - r.target / r.source_size) < 1 if r.source_size else r.taken == 0
    for x in sizes:
        assert abs(taken[x] - want[x]) <= largest[x] / 2 + 1
    again = mixing.mix_sources(table.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_sources(docs).count() == docs.count()


def test_mix_is_fair(spark):
    """Over many seeds every document is taken as often as its source is due, large or small."""
    rows = [(i, "w " * n, s) for i, n in enumerate([1, 2, 5, 9, 40, 1, 2, 5, 9, 40]) for s in ("a", "b")]
    table, taken = spark.createDataFrame(rows, "doc_id long, text string, source string").cache(), Counter()
    for seed in range(10):
        for r in mixing.mix_sources(table, weights=(1, 1), share=0.5, seed=seed).collect():
            taken[r["size"]] += r.copies
    assert all(0.2 < taken[n] / (10 * 4) < 0.8 for n in (1, 2, 5, 9, 40))


def test_mix_runs_no_python(spark, docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sql_gives_the_same_rows(spark, docs):
    con = duckdb.connect()
    documents = [(r.doc_id, r.text) for r in docs.collect()]
    conversations = talks(2, 60)
    target = [(0, "changed word abc"), (1, None)]
    for name, rows, schema in (("documents", documents, "doc_id BIGINT, text VARCHAR"), ("benchmark", target, "item_id BIGINT, text VARCHAR"), ("conversations", conversations, "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR")):
        con.execute(f"CREATE TABLE {name} ({schema})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    assert sorted(con.execute(sql.OP11).fetchall(), key=str) == drawn(documents, [t for _, t in target])
    assert sorted(con.execute(sql.OP12).fetchall(), key=str) == nodes_of(conversations)
