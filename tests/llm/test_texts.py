"""Operators on texts against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontam, langid, licenses, lmscore, neardup, packing, quality, substring
from weftline.llm._blocks import in_blocks
from weftline.llm._store import keep
from weftline.llm._words import hash_words, inside, split_words, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_windows():
    texts = [None, "", " a  b\n", "x\x0by z", "one two three four"]
    offsets, codes, words = split_words(pa.array(texts))
    got = [[words[c].as_py() for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    h = hash_words(["p", "q", "r"] * 10)
    for width in (1, 2, 3, 7, 20):
        w = window_hashes(h, width)
        assert len(w) == 31 - width and len(set(w.tolist())) == min(3, len(w))
    ok = inside(np.array([0, 0, 4, 5, 30]), 3)
    assert np.flatnonzero(ok).tolist() == [0, 1, *range(5, 28)]


def test_names_are_equal_for_equal_words():
    words = np.random.default_rng(1).integers(0, 2, 300).astype(np.uint64)
    for width in (1, 2, 5, 7, 20):
        own = [tuple(words[i : i + width]) for i in range(301 - width)]
        got = substring.names(words, width)
        assert len(got) == len(own) and len(set(zip(own, got.tolist()))) == len(set(own)) == len(set(got.tolist()))
    assert len(substring.names(words[:4], 5)) == 0


@pytest.mark.parametrize(("block_bytes", "most"), [(4000, 20_000), (1 << 23, 20_000), (4000, 3)])
def test_substring_dedup_equals_brute_force(spark, docs, block_bytes, most):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    new = " ".join(f"n{k}" for k in range(30))
    rows += [(-5, rows[10][1]), (10, rows[10][1]), (-9, new), (15, new), (15, "different " + new[::-1]), (15, new), (None, rows[3][1]), (None, None)]
    line = " ".join(f"line{k}" for k in range(14))  # a common line in different company
    rows += [(1000 + i, f"a{i} b{i} c{i} d{i} e{i} {line} f{i % 4} g{i} h{i} i{i} j{i}") for i in range(40)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {(r.doc_id, r.text): r.key for r in data.select("doc_id", "text", substring.row_key().alias("key")).collect()}
    seen, want = set(), collections.Counter()
    for i, text in sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], keys[r])):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    found = substring.mark_repeats(data, substring._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", block_bytes=block_bytes, group_suffixes=most)
    assert collections.Counter(tuple(r) for r in found.collect()) == want


def test_repeated_spans(spark):
    words = [f"w{k}" for k in range(60)]
    data = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[10:40]) + " y"), (3, " ".join(words[:19]))], "doc_id long, text string")
    assert [tuple(r) for r in substring.repeated_spans(data).collect()] == [(2, 1, 30)]


def test_substring_stage_keeps_columns(docs, empty):
    out = substring.remove_repeats(docs.withColumn("block", F.lit("mine")).withColumn("row", F.lit(1)))
    assert out.columns == [*docs.columns, "block", "row"] and out.count() == docs.count()
    assert out.filter("doc_id = 120").first().text is None
    assert substring.substring_digest(empty).count() == 0 and substring.remove_repeats(empty).count() == 0


def test_near_duplicates_equal_brute_force(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    text = pa.array([t for _, t in rows])
    offsets, s, n = neardup.shingles(text)
    idf = neardup.idf_table(*neardup.frequencies(docs))
    w = neardup.weights(s, n, idf).astype(float)
    bags = [dict(zip(s[a:b].tolist(), w[a:b].tolist())) for a, b in zip(offsets, offsets[1:])]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            low = sum(min(v, bags[j].get(k, 0)) for k, v in bags[i].items())
            if bags[i] and bags[j] and low >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - low) - 1e-9:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    want = {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}
    assert len(set(want.values())) < len(rows) - 10
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_large_buckets_are_parted_and_nothing_is_lost(spark):
    keys = spark.createDataFrame([(i, [1, 2, 3, i % 5, 7, 8]) for i in range(60)] + [(100 + i, [9, *[i + 1000] * 5]) for i in range(8)], "doc_id long, keys array<long>").cache()
    parts = collections.defaultdict(set)
    for r in neardup.buckets(keys, most=10).collect():
        parts[r.bucket].add(r.doc_id)
    assert all(2 <= len(x) <= 16 for x in parts.values())
    label = {i: i for i in [*range(60), *range(100, 108)]}
    for members in parts.values():
        low = {label[m] for m in members}
        label = {k: min(low) if v in low else v for k, v in label.items()}
    assert len(set(label.values())) == 2


@pytest.mark.parametrize("sent", [neardup.MOST_SENT, -1])
def test_star_of_edits_in_large_buckets_stays_whole(spark, monkeypatch, sent):
    monkeypatch.setattr(neardup, "MOST_SENT", sent)
    monkeypatch.setattr(neardup, "idf_table", lambda df, n: np.ones(1 << neardup.DF_BITS, np.float32))
    rng = np.random.default_rng(8)
    centre, rows = [f"w{k}" for k in range(100)], []
    for i in range(6000):  # each is 0.81 like the centre; most are 0.65 like each other
        words = list(centre)
        for k in (rng.integers(4, 48), rng.integers(52, 96)):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
    data = spark.createDataFrame([*rows, (9999, " ".join(centre))], "doc_id long, text string")
    keys = neardup.band_keys(data, np.ones(1 << neardup.DF_BITS, np.float32)).collect()
    own = set(enumerate(next(r["keys"] for r in keys if r.doc_id == 9999)))
    meet = {r.doc_id for r in keys if own & set(enumerate(r["keys"]))}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(data).collect()}
    assert len(meet) > 5900 and len({got[i] for i in meet}) == 1


def test_edits_of_a_hot_text_are_found_like_others(spark):
    rng = np.random.default_rng(9)
    vocab = [f"v{k}" for k in range(5000)]
    texts = [list(rng.choice(vocab, 100)) for _ in range(3)]

    def edit(words):  # plain Jaccard 86 / 106 = 0.81
        return [f"new{rng.integers(1 << 40)}" if k in (30, 70) else w for k, w in enumerate(words)]

    rows = [texts[0]] * 300 + [edit(texts[0]) for _ in range(5)] + [texts[1]] + [edit(texts[1]) for _ in range(150)] + [texts[2], edit(texts[2])]
    rows += [list(rng.choice(vocab, 60)) for _ in range(400)]
    data = spark.createDataFrame([(i, " ".join(map(str, w))) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(data).collect()}
    assert got == {i: 0 if i < 305 else 305 if i < 456 else 456 if i < 458 else i for i in range(len(rows))}


def test_blocks_hold_every_pair_of_the_rest(spark):
    rows = [(b, 100 * b + i, i < n_out, 30 - n_out, n_out) for b, n_out in ((1, 7), (2, 1), (3, 25)) for i in range(30)]
    rest = spark.createDataFrame(rows, "bucket long, doc_id long, outer boolean, n_in long, n_out long")
    groups, met = collections.defaultdict(list), set()
    for r in neardup._to_all(rest, 10).collect():
        groups[r.bucket].append((r.doc_id, r.lead))
    for members in groups.values():
        assert len({i for i, _ in members}) == len(members)
        met |= {frozenset((i, j)) for i, lead in members if lead for j, _ in members if i != j}
    outer = {r[1] for r in rows if r[2]}
    assert met == {frozenset((i[1], j[1])) for i in rows for j in rows if i[0] == j[0] and i[1] != j[1] and outer & {i[1], j[1]}}


def test_consistent_samples_estimate_the_weighted_similarity():
    rng = np.random.default_rng(4)
    s = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = rng.uniform(0.1, 2, 400), rng.uniform(0.1, 2, 400)
    got = neardup.samples(np.array([0, 400, 800]), np.concatenate([s, s]), np.concatenate([a, b]), 600)
    assert abs((got[0] == got[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.08


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)], "a long, b long")
    assert {r.doc_id: r.class_id for r in neardup.components(chain).collect()} == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


def test_rows_that_share_a_doc_id_are_documents_of_their_own(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a, "x"), (5, b, "y"), (7, b, "z"), (8, a, "w"), (None, a, "n"), (9, None, "p"), (9, None, "q"), (9, "", "r"), (7, b, "z")]
    data = spark.createDataFrame(rows, "doc_id long, text string, nth string").withColumn("head", F.lit(1)).withColumn("h1", F.lit(2))
    got = collections.Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(data).collect())
    assert got == {(5, None): 1, (5, 5): 1, (7, 5): 2, (8, None): 1, (None, None): 1, (9, 9): 3}
    kept = neardup.keep_one(data)
    assert kept.columns == data.columns
    assert sorted((r.doc_id or 0, r.nth) for r in kept.collect()) == [(0, "n"), (5, "y"), (9, "p"), (9, "q"), (9, "r")]


def test_neardup_without_rows(empty):
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_tiles_catch_reordered_passages():
    a = np.arange(1, 21, dtype=np.uint64)
    assert decontam.tiles(a, np.concatenate([a[10:], a[:10]])) in ([(0, 10, 10), (10, 0, 10)], [(10, 0, 10), (0, 10, 10)])
    assert decontam.tiles(a, a[::-1].copy()) == []
    assert decontam.tiles(np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64)) == [(0, 0, 5)]


def test_longest_matches_equal_a_table():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = (rng.integers(0, 3, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        free_a, free_b = rng.random(len(a)) > 0.2, rng.random(len(b)) > 0.2
        best = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, 1 + min(len(a) - i, len(b) - j)) if free_a[i : i + k].all() and free_b[j : j + k].all() and (a[i : i + k] == b[j : j + k]).all()), default=0)
        assert decontam._longest(a, b, free_a, free_b, 2, min(len(a), len(b))) == (best if best >= 2 else 0)


@pytest.mark.parametrize("most_sent", [0, 1_000_000])
def test_decontamination_equals_brute_force(spark, most_sent, monkeypatch):
    monkeypatch.setattr(decontam.candidate_pairs, "__defaults__", (decontam.LEAST_TILE, decontam.COVERAGE, most_sent))
    rng = np.random.default_rng(7)
    items = [(0, "ha " * 20), (1, "la di " * 10), (2, "one two"), (3, ""), (4, None)] + [(10 + i, " ".join(rng.choice(list("abcdef"), rng.integers(3, 30)))) for i in range(20)]
    docs = [(1, "so ha " + "ha " * 25), (2, "la di " * 12), (3, "zero one two three"), (4, "one three two"), (5, None), (6, "ha ha"), (6, "la di " * 30), (None, "la di " * 11)]
    docs += [(100 + i, " ".join(rng.choice(list("abcdef"), rng.integers(3, 60)))) for i in range(30)]
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = (decontam.tokens(pa.array([x], pa.string()))[1] for x in (item, text))
            covered = sum(x[2] for x in decontam.tiles(a, b, min(5, len(a)))) if len(a) and len(b) else 0
            if len(a) and covered >= 0.6 * len(a):
                want.add((d, i))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and {(1, 0), (2, 1), (3, 2), (6, 1), (None, 1)} <= want and (4, 2) not in want


@pytest.mark.parametrize("most_sent", [0, 1_000_000])
def test_decontamination(spark, docs, empty, most_sent, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "too short"), (3, None), (1, " ".join(words))], "item_id long, text string")
    moved = words[20:] + ["x"] + words[:20]
    planted = spark.createDataFrame([(900, "Intro: " + " ".join(words).upper() + "!"), (901, "a b c " + " ".join(moved)), (902, " ".join(words[:15])), (903, " ".join(words[::-1]))], "doc_id long, text string")
    data = docs.select("doc_id", "text").union(planted)
    monkeypatch.setattr(decontam.candidate_pairs, "__defaults__", (decontam.LEAST_TILE, decontam.COVERAGE, most_sent))
    got = {(r.doc_id, r.item_id): (r.n_covered, r.n_tiles) for r in decontam.contaminated(data, items).collect()}
    assert got == {(900, 1): (40, 1), (901, 1): (40, 2)}, got
    assert {r.doc_id for r in decontam.remove_contaminated(data, items).collect()} == {r.doc_id for r in data.collect()} - {900, 901}
    assert decontam.contaminated(empty, items).count() == 0 and decontam.remove_contaminated(docs, items.limit(0)).count() == docs.count()


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    item, rows = " ".join(f"w{i}" for i in range(30)), []
    for i in (6, None):
        rows += [(i, "clean words of its own", 1), (i, f"before {item} after", 2), (i, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    left = decontam.remove_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert collections.Counter(map(tuple, left.collect())) == collections.Counter(r for r in rows if r[2] != 2)


def test_rows_without_ids_are_dealt_and_drawn_by_their_texts(spark):
    texts = [f"line {k} of words\nand more {k * k}" for k in range(3000)]
    rows = spark.createDataFrame([(None if k % 2 else 5, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert 350 <= len(licenses.corpus_paragraphs(rows, 400)) <= 400
    assert 350 <= len(langid.training_sample(rows, 400)) <= 450
    blocks = [r["count"] for r in in_blocks(rows, 16).groupBy("block").count().collect()]
    assert len(blocks) == 16 and max(blocks) < 2 * 3000 / 16
    same = spark.createDataFrame([(None, "one text")] * 20_000, "doc_id long, text string").withColumn("piece", F.lit(0)).withColumn("length", F.lit(2).cast("long"))
    groups = [r["count"] for r in packing.place(keep(same, "same"), group_pieces=4000).groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(groups) == 5 and max(groups) < 4400


def test_base_counts():
    text = "a b c\na b c\nd # e\n\n  \nd # e a b c"
    found = quality.base_counts(pa.array([text, None, "", "x " * 10])).to_dict("list")
    assert found["n_words"] == [15, 0, 0, 10] and found["n_dup_lines"] == [1, 0, 0, 0] and found["n_symbols"] == [2, 0, 0, 0]
    assert found["word_chars"] == [15, 0, 0, 10] and found["n_repeat_words"] == [15, 0, 0, 10]


def test_perplexity_probabilities_sum_to_one_and_bands_reject(spark):
    rows = [(i, "the cat sat on the mat and the dog ran to the cat " * 5 + "abcdefgh"[i % 8], "en") for i in range(60)] + [(99, "zqx jvk wqz xkj " * 15, "en"), (100, None, None), (101, "", "en")]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.train(data)
    chars = [*sorted({c for r in rows for c in r[1] or ""}), quality.END]
    for before in ("the", " ca", "zzz"):
        grams = np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate(before + x)) for x in chars], np.uint64)
        assert (10 ** model.logs("en", grams)).sum() < 1.001
    seen = np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate("the" + x)) for x in chars], np.uint64)
    assert (10 ** model.logs("en", seen)).sum() > 0.9
    got = {r.doc_id: r.kept for r in quality.quality_report(data).collect()}
    assert len(got) == 63 and not got[100] and not got[101]
    natural = spark.createDataFrame([(i, " ".join(f"{a}{b}" for a, b in zip("the cat sat on a mat".split() * 12, "xyzw" * 18)) + str(i), "en") for i in range(40)] + [(99, "ЖЩЫ ЪЭЮ ЯФЦ " * 30, "en")], "doc_id long, text string, lang string")
    kept = quality.quality_report(natural).filter("base_failed = false")
    assert kept.filter("doc_id = 99").count() == 0 or not kept.filter("doc_id = 99").first().kept
    out = quality.filter_documents(data.withColumn("kept", F.lit("mine")))
    assert out.columns == ["doc_id", "text", "lang", "kept"]


def plain_kneser_ney(texts):
    """log10 of a character after three others, by dictionaries and one gram after the other."""
    order, grams = 4, collections.Counter()
    for t in set(texts):
        chars = quality.PAD * 3 + " ".join(t.split()) + quality.END
        grams.update(chars[i : i + 4] for i in range(len(chars) - 3))
    counts = {order: grams}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def discount(k, n):
        of = collections.Counter(counts[k].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
        i = min(n, 3)
        d = i - (i + 1) * y * of[i + 1] / of[i] if of[i] and of[i + 1] else 0.5
        return min(max(d, 0.05), i - 0.05)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, n = len(g), counts[len(g)].get(g, 0)
        beside = [m for h, m in counts[k].items() if h[:-1] == g[:-1]]
        if not beside:
            return p(g[1:])
        left = sum(discount(k, m) for m in beside) / sum(beside)
        return (n - discount(k, n) if n else 0) / sum(beside) + left * p(g[1:])

    known = {}
    return lambda g: known.setdefault(g, math.log10(p(g)))


def test_perplexity_equals_plain_kneser_ney(spark):
    rng = random.Random(3)
    words = ["Aa", "bab.", "cab", "abba", "Ca", "b", "éa", "日本", "a,"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(25)]
    data = spark.createDataFrame([(t, "en") for t in texts + texts[:5]], "text string, lang string")
    plain, asked = plain_kneser_ney(texts), [*texts[:6], "Unseen XY words", "", "cab  Ca\n\nabba"]
    want = []
    for t in asked:
        chars = quality.PAD * 3 + " ".join(t.split()) + quality.END
        want.append(-np.mean([plain(chars[i : i + 4]) for i in range(len(chars) - 3)]))
    assert quality.train(data).log_perplexity(asked, "en") == pytest.approx(want, abs=1e-5)


def test_shuffled_words_are_rejected_and_sound_text_is_kept(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice(["ba", "de", "ki", "lo", "mu", "n", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(4, 10))).capitalize() + "."
    rows = [(i if i % 3 else None, " ".join(sentence() for _ in range(rng.randint(15, 30))), "en", "sound") for i in range(300)]
    for i, (_, text, _, _) in enumerate(rows[:60]):
        words = text.split()
        rng.shuffle(words)
        rows.append((1000 + i, " ".join(words), "en", "salad"))
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")
    kept = {r.kind: r["count"] for r in quality.filter_documents(data).groupBy("kind").count().collect()}
    assert kept["sound"] > 0.95 * 300 and kept.get("salad", 0) < 0.5 * 60


def test_copies_of_one_text_do_not_narrow_the_band(spark):
    rng = np.random.default_rng(5)
    words = {x: ["".join(rng.choice(list(x), rng.integers(3, 9))) for _ in range(300)] for x in ("abcdefgh", "nopqrstu")}
    text = lambda x: " ".join(rng.choice(words[x], 120))
    rows = [(i, text("abcdefgh"), "de") for i in range(60)] + [(1000 + i, text("nopqrstu"), "en") for i in range(540)]
    copy = text("abcdefgh")
    data = spark.createDataFrame([(int(i), str(t), x) for i, t, x in rows + [(2000 + i, copy, "de") for i in range(300)]], "doc_id long, text string, lang string")
    assert quality.quality_report(data).filter("lang = 'de' and kept").count() == 360
    assert quality.filter_documents(data).filter("lang = 'de'").count() == 360


def test_quality_without_rows(empty):
    assert quality.quality_report(empty).count() == 0 and quality.filter_documents(empty).count() == 0


def test_language_accuracy_held_out(spark, empty):
    rng = np.random.default_rng(2)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["str", "och", "ung"], "cc": ["ção", "é", "ñu"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[x], 3)) for _ in range(rng.integers(3, 200))), x) for i, x in enumerate(rng.choice(list(sounds), 600))]
    rows += [(1000, None, "aa"), (1001, "12 ½ ② !", "bb"), (1002, "kalomi kakalo", None)]
    data = spark.createDataFrame([(int(i), None if t is None else str(t), None if x is None else str(x)) for i, t, x in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_report(data).collect()}
    truth = {int(i): x for i, _, x in rows[:600]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got) and len(got) == 603
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.language_report(empty).count() == 0


def test_licences(spark, empty):
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    plain = ["The people of the town were licensed to sell fish.", "All of it was reserved for the guests under the tree.", "Software is fun."]
    rows = [(i, f"{plain[i % 3]}\n{line}\nmore words here") for i, line in enumerate(lines)] + [(50 + i, p) for i, p in enumerate(plain * 20)] + [(200, None), (201, "")]
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 1): family for i, family in enumerate(lines.values())}
    assert licenses.scan(empty).count() == 0


def test_scores(spark, docs, empty):
    held = langid.held_out(docs, 5, 1)
    got = {r.doc_id: r for r in lmscore.score_documents(docs, ~held, block_bytes=20_000).collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = {r.doc_id: [*WORD.findall(low(r.text)), "\n"] for r in docs.collect()}
    c = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs=1e-6)
        assert got[i].score < 0
    assert lmscore.score_documents(empty, F.lit(True)).count() == 0


def test_attention_gradients_and_single_scoring():
    rng = np.random.default_rng(0)
    home = np.arange(50) % lmscore.CLASSES
    model = lmscore.Attention.fresh(home, np.zeros(50, np.float32))
    model.p = {k: w.astype(np.float64) for k, w in model.p.items()}
    offsets = np.array([0, 1, 40, 140])
    ids = rng.integers(0, 50, 140)
    x, y = model.windows(offsets, ids)
    assert y[y >= 0].tolist() == ids.tolist() and len(y) == 1 + 2 + 5
    loss = lambda: -_log_p(model, x, y)
    g = model.gradients(x, y)
    for k in ("Q", "V", "O", "A", "C", "P", "E"):
        flat, grad = model.p[k].reshape(-1), g[k].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-4), 3):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-5 == pytest.approx(grad[i], rel=1e-2, abs=1e-5)
    later = ids.copy()
    later[139] = (ids[139] + 1) % 50  # the last id changes no score before it
    a, b = model.log_p(offsets, ids), model.log_p(offsets, later)
    assert a[:139] == pytest.approx(b[:139]) and a[139] != b[139]
    assert np.allclose(model.logits(x)[(y >= 0).ravel()], model.forward(x)[-1][(y >= 0).ravel()], atol=1e-4)


def _log_p(model, x, y):
    z = model.forward(x)[-1]
    z = z - z.max(1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(1, keepdims=True))
    real = y.ravel() >= 0
    return logp[np.arange(len(z)), model.home[y.ravel()]][real].mean()


def test_scores_of_all_ids_sum_to_one_and_learn(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(120)]
    after = {w: list(rng.choice(words, 3)) for w in words}
    rows = []
    for i in range(300):
        text = [str(rng.choice(words))]
        while len(text) < 60:
            text.append(str(rng.choice(after[text[-1]])))
        rows.append((i, " ".join(text)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = lmscore.score_documents(data, F.col("doc_id") % 5 != 1).filter("doc_id % 5 = 1").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]  # held-out texts, whose words follow each other by rule
    size = 40
    attention = lmscore.Attention.fresh(np.arange(size) % 7, np.log(np.full(size, 7 / size, np.float32)))
    mass = np.bincount(attention.home, minlength=lmscore.CLASSES)
    attention.inner = np.log(1 / mass[attention.home])
    pairs = rng.integers(0, 4, (size + 1, size)) * (rng.random((size + 1, size)) < 0.3)
    keys = np.arange(size + 1)[:, None] * lmscore.CLASSES + attention.home[None]
    pair = np.unique(keys)
    total, kinds = np.bincount(np.searchsorted(pair, keys.ravel()), pairs.ravel()), np.bincount(np.searchsorted(pair, keys.ravel()), (pairs > 0).ravel())
    model = lmscore.Model(attention, pair, total, kinds)
    p = []
    for last in range(size):
        ids = np.array([3, 9, 1, last])
        p.append(model.log10_p(np.array([0, 4]), ids, np.array([size, 3, 9, 1]), pairs[[size, 3, 9, 1], ids])[3])
    x, y = attention.windows(np.array([0, 4]), np.array([3, 9, 1, 0]))
    z = attention.logits(x)[3]
    assert sum(10 ** np.array(p)) == pytest.approx(np.exp(z[:7]).sum() / np.exp(z).sum(), rel=1e-4)  # other classes have no id


def test_steps_are_taken_on_all_documents(spark):
    tokenizer = lmscore.default_tokenizer()
    letters = np.random.default_rng(4).integers(97, 123, (300, 12))
    words = [" ".join("".join(map(chr, r)) for r in row.reshape(3, 4)) for row in letters]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    size = lmscore.encoder(tokenizer).size + 1
    fresh = lmscore.Attention.fresh(np.arange(size) % lmscore.CLASSES, np.zeros(size, np.float32))
    got = lmscore.descend(docs, fresh, tokenizer, 10, task_bytes=2000)  # ten at first, the rest in a few tasks
    offsets, ids = lmscore._ids(pa.record_batch({"text": words}), tokenizer)
    seen = np.unique(np.delete(ids, offsets[1:] - 1))
    assert len(seen) > 100 and (got.p["E"][seen] != fresh.p["E"][seen]).any(1).all()
    unseen = np.setdiff1d(np.arange(size), seen)
    assert (got.p["E"][unseen] == fresh.p["E"][unseen]).all()


def test_the_model_keeps_every_gram(spark):
    letters = np.random.default_rng(8).integers(97, 123, (30, 1500))  # so many grams that some would meet in 2 ** 24 slots
    texts = ["".join(map(chr, row)) for row in letters]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    grams = quality.count_grams(docs)
    model = quality.kneser_ney(grams)
    kinds = np.unique(np.array([r.gram for r in grams.collect()], np.int64).view(np.uint64))
    for k in range(1, quality.ORDER + 1):
        each = np.unique(kinds & np.uint64((1 << 16 * k) - 1))
        assert model.find("en", k, each)[0].all()
        if k > 1:
            assert model.find("en", 16 + k, np.unique(each >> np.uint64(16)))[0].all()
    entries = sum(len(np.unique(kinds & np.uint64((1 << 16 * k) - 1))) for k in range(1, 5)) + sum(len(np.unique((kinds & np.uint64((1 << 16 * k) - 1)) >> np.uint64(16))) for k in range(2, 5)) + 1
    assert sum(n for _, n in model.sizes) == entries
