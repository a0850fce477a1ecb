"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of shingles are counted in 2 ** DF_BITS hashed buckets over all distinct texts (a table of fixed
   size); idf is capped at 1 for shingles in fewer than COMMON of all documents, so that only common passages weigh less.
2. Each distinct text gets BANDS x ROWS weighted samples and as many of its plain set of shingles; each band's samples
   hash to a key.
3. Texts that share a key form a bucket; buckets with the same members count once. A bucket of more than BUCKET texts
   is parted by keys of other bands, again and again; what stays large is parted by a hash in runs of about half of
   BUCKET that share their first text. So no bucket is dropped and none grows with the corpus.
4. In each bucket weighted and plain Jaccard similarities of all texts are exact, and either is enough: frequent
   shingles weigh little, so in a large group of near copies the edits would outweigh what they share. A forest of the
   links found is emitted.
5. Texts of a large bucket outside of its largest class are compared with the bucket's texts of most links, round by
   round, and those left in the end with all texts of the bucket, block by block. So every two texts that share a band
   are compared, or known to be in one class.
6. Classes are the connected components of links, and of exact copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm._store import keep, on_driver
from weftline.llm._words import inside, mix, owner, slices, window_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 4
DF_BITS, COMMON = 18, 0.05
BUCKET = 2000
#: Other bands by which a large bucket is parted.
SPLIT_BANDS = 4
#: Times that large buckets are parted by keys before their texts are parted in runs.
DEPTH = 3
#: Texts of most links with which the others of a large bucket are compared in a round.
REPRESENTATIVES = 64
#: Rows of a table by bucket up to which it is sent to all tasks, and the parts that buckets have beyond that.
MOST_SENT, PARTS = 200_000, 64
#: Texts compared in one task's group of buckets.
GROUP_TEXTS = 2000
NO_ID = -(1 << 63)


def shingles(text, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(offsets, hashes, counts)`` of the distinct shingles of each text, ascending; a shorter text is one shingle."""
    offsets, h = word_hashes(text)
    ok = inside(offsets, width)
    s, d = window_hashes(h, width)[ok], owner(offsets)[: len(ok)][ok]
    short = [i for i in np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < width))]
    if short:
        s = np.concatenate([s, [window_hashes(h[offsets[i] : offsets[i + 1]], int(offsets[i + 1] - offsets[i]))[0] for i in short]]).astype(np.uint64)
        d = np.concatenate([d, short])
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(s)))
    return np.searchsorted(d[at], np.arange(len(offsets))), s[at], n


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """``(df by bucket, documents)`` over all distinct texts: copies count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in slices(batches):
            offsets, s, _ = shingles(batch.column("text"))
            pair = np.unique((owner(offsets) << DF_BITS) | (s >> np.uint64(64 - DF_BITS)).astype(np.int64))
            total += np.bincount(pair & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
            rows += int((np.diff(offsets) > 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], ["bucket", "n"])

    got = on_driver(docs.select("text").distinct().mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    df, at = np.zeros(1 << DF_BITS, np.int64), got["bucket"].to_numpy()
    df[at[at >= 0]] = got["n"][at >= 0]
    return df, int(got["n"][at < 0].sum())


def idf_table(df: np.ndarray, documents: int) -> np.ndarray:
    """Weight of each bucket: log(documents / df) over log(1 / COMMON), at most 1 and at least a twentieth."""
    share = np.maximum(df, 1) / max(documents, 1)
    return np.clip(np.log(1 / np.minimum(share, 1)) / np.log(1 / COMMON), 0.05, 1.0).astype(np.float32)


def weights(s: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[(s >> np.uint64(64 - DF_BITS)).astype(np.int64)]


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def samples(offsets: np.ndarray, s: np.ndarray, w: np.ndarray, n_samples: int) -> np.ndarray:
    """Improved consistent weighted samples (texts x n_samples) as 64-bit values; every text needs a shingle.

    For each shingle and sample: r and c from Gamma(2, 1), b uniform, t = floor(ln w / r + b), and the shingle with
    the least ln c - r (t - b) - r is drawn, with its t.
    """
    gamma = _gamma_quantiles()
    r_table, c_table = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
    out = np.empty((len(offsets) - 1, n_samples), np.uint64)
    cut = np.flatnonzero(np.diff(offsets[:-1] // 65536)) + 1  # so much at a time stays in the cache
    for a, z in zip([0, *cut], [*cut, len(offsets) - 1], strict=True):
        at, x = offsets[a:z] - offsets[a], s[offsets[a] : offsets[z]]
        log_w, n = np.log(w[offsets[a] : offsets[z]]).astype(np.float32), np.diff(offsets[a : z + 1])
        for k in range(n_samples):
            with np.errstate(over="ignore"):
                h = mix(x + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            r = r_table[h & np.uint64(0xFFFF)]
            b = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
            t = np.floor(log_w / r + b)
            low = c_table[(h >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - b) - r
            hit = np.flatnonzero(low == np.repeat(np.minimum.reduceat(low, at), n))
            first = hit[np.searchsorted(hit, at)]
            out[a:z, k] = mix(x[first] ^ (t[first].astype(np.int64).view(np.uint64) << np.uint64(1)))
    return out


def plain_samples(offsets: np.ndarray, s: np.ndarray, n_samples: int) -> np.ndarray:
    """MinHash samples (texts x n_samples) of the sets of shingles; every text needs a shingle."""
    out = np.empty((len(offsets) - 1, n_samples), np.uint64)
    cut = np.flatnonzero(np.diff(offsets[:-1] // 65536)) + 1
    for a, z in zip([0, *cut], [*cut, len(offsets) - 1], strict=True):
        at, x = offsets[a:z] - offsets[a], s[offsets[a] : offsets[z]]
        for k in range(n_samples):
            with np.errstate(over="ignore"):
                out[a:z, k] = np.minimum.reduceat(mix(x + np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)), at)
    return out


def band_keys(docs: DataFrame, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, keys``: a key for each band, weighted ones and then plain ones; texts without words have no row."""
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            offsets, s, n = shingles(batch.column("text"))
            some = np.flatnonzero(np.diff(offsets) > 0)
            if not len(some):
                continue
            at = np.append(offsets[some], offsets[-1])
            got = np.concatenate([samples(at, s, weights(s, n, held.value), bands * rows), plain_samples(at, s, bands * rows)], 1)
            keys = np.stack([window_hashes(got[:, j * rows : (j + 1) * rows].ravel(), rows)[::rows] for j in range(2 * bands)], 1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * 2 * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), lists], ["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<long>")


def _sized(rows: DataFrame) -> DataFrame:
    count = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("members"), F.min("doc_id").alias("head"))
    alike = count.filter("n > 1").groupBy("members", "n", "head").agg(F.min("bucket").alias("bucket"))
    return rows.join(alike.select("bucket", "n", "head"), "bucket")


def whole_buckets(keys: DataFrame) -> DataFrame:
    """``bucket, doc_id, n, head`` of the stored ``doc_id, keys``: all sets of n texts, at least two, that share a band."""
    return keep(_sized(keys.select("doc_id", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "doc_id")), "buckets")


def buckets(keys: DataFrame, most: int = BUCKET, whole: DataFrame | None = None) -> DataFrame:
    """``bucket, doc_id`` of the stored ``doc_id, keys``: sets of at least two and at most ``most`` texts."""
    rows = whole_buckets(keys) if whole is None else whole
    done = rows.filter(F.col("n") <= most).select("bucket", "doc_id")
    for depth in range(DEPTH):
        large = rows.filter(F.col("n") > most)
        if large.isEmpty():
            return done
        own = F.pmod("bucket", F.size("keys"))  # which bands, depends on the bucket
        picked = [F.struct(F.lit(i).alias("i"), F.get("keys", F.pmod(own + depth * SPLIT_BANDS + i, F.size("keys")).cast("int")).alias("key")) for i in range(SPLIT_BANDS)]
        parts = large.join(keys, "doc_id").select("bucket", "doc_id", F.explode(F.array(*picked)).alias("x"))
        rows = keep(_sized(parts.select(F.xxhash64("bucket", "x.i", "x.key", F.lit(depth)).alias("bucket"), "doc_id")), "buckets")
        done = done.union(rows.filter(F.col("n") <= most).select("bucket", "doc_id"))
    large = rows.filter((F.col("n") > most) & (F.col("doc_id") != F.col("head")))
    run = F.pmod(F.xxhash64("doc_id", F.lit("run")), F.ceil(2 * F.col("n") / most))
    runs = large.select(F.xxhash64("bucket", run).alias("bucket"), "doc_id", "head")
    return done.union(runs.select("bucket", "doc_id")).union(runs.select("bucket", F.col("head").alias("doc_id")).distinct())


def similar_pairs(offsets: np.ndarray, s: np.ndarray, w: np.ndarray, members: np.ndarray, least: float, first: int = 0) -> list[tuple[int, int]]:
    """A forest of the links between ``members`` (text numbers): pairs whose weighted or plain Jaccard similarity is enough.

    The members before the place ``first`` are compared with those from there on only.
    """
    sizes = offsets[members + 1] - offsets[members]
    at = np.concatenate([np.arange(offsets[m], offsets[m + 1]) for m in members])
    _, code = np.unique(s[at], return_inverse=True)
    weight, starts = w[at], np.cumsum(sizes) - sizes
    total = np.add.reduceat(weight, starts)
    root, links = np.arange(len(members)), []
    mine = np.zeros(code.max() + 1)
    for i in range(max(first, 1), len(members)):
        own = slice(starts[i], starts[i] + sizes[i])
        mine[code[own]] = weight[own]
        met = mine[code[: starts[i]]]
        common = np.add.reduceat(np.minimum(met, weight[: starts[i]]), starts[:i])
        plain = np.add.reduceat((met > 0).view(np.int8), starts[:i], dtype=np.int64)
        mine[code[own]] = 0
        alike = (common >= least * (total[:i] + total[i] - common) - 1e-9) | (plain >= least * (sizes[:i] + sizes[i] - plain) - 1e-9)
        for j in np.flatnonzero(alike):
            a, b = root[i], root[j]
            if a != b:
                links.append((i, int(j)))
                root[root == a] = b
    return [(int(members[i]), int(members[j])) for i, j in links]


def verified_links(docs: DataFrame, found: DataFrame, idf: np.ndarray, least: float = SIMILARITY) -> DataFrame:
    """``a, b``: links between different texts of the buckets ``found``; where it has ``lead``, only of texts with such."""
    found = found if "lead" in found.columns else found.withColumn("lead", F.lit(True))
    held = docs.sparkSession.sparkContext.broadcast(idf)
    n_groups = max(8, -(-found.count() // GROUP_TEXTS))

    def compare(table: pa.Table) -> pa.Table:
        offsets, s, n = shingles(table.column("text"))
        w, ids, bucket = weights(s, n, held.value).astype(float), table.column("doc_id").to_numpy(), table.column("bucket").to_numpy()
        lead = table.column("lead").to_numpy()
        order = np.lexsort((ids, lead, bucket))
        a, b = [], []
        for members in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            for i, j in similar_pairs(offsets, s, w, members, least, int((~lead[members]).sum())) if len(members) > 1 else []:
                a.append(ids[i])
                b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    texts = docs.select("doc_id", "text").hint("merge").join(found, "doc_id").withColumn("group", F.pmod(F.xxhash64("bucket"), F.lit(n_groups)).cast("int"))
    return texts.groupBy("group").applyInArrow(compare, "a long, b long").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``doc_id, class_id`` of the stored ``a, b``: the least doc_id that links lead to.

    Each round every text takes the least class among its neighbours, then the class of its class; rounds end when
    nothing changes, after about the logarithm of the longest chain.
    """
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("class_id")), "classes")
    while True:
        near = both.join(label, both["b"] == label["doc_id"]).groupBy("a").agg(F.min("class_id").alias("m"))
        step = label.join(near, label["doc_id"] == near["a"]).select("doc_id", F.col("class_id").alias("was"), F.least("class_id", "m").alias("via"))
        jump = label.select(F.col("doc_id").alias("via"), F.col("class_id").alias("far"))
        new = keep(step.join(jump, "via", "left").select("doc_id", "was", F.least("via", F.coalesce("far", "via")).alias("class_id")), "classes")
        label, changed = new.select("doc_id", "class_id"), new.filter("class_id <> was")
        if changed.isEmpty():
            return label


def _joined(rows: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the stored ``few`` rows that buckets have: sent to all tasks up to MOST_SENT of them, beyond that
    dealt by bucket and a part of ``by``, so that the rows of a hot bucket are not in one task."""
    if few.count() <= MOST_SENT:
        return rows.join(F.broadcast(few), on, how)
    part = rows.withColumn("part", F.pmod(F.xxhash64(by, F.lit("part")), F.lit(PARTS)).cast("int"))
    each = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return part.join(each.hint("merge"), [*on, "part"], how).drop("part")


def _outside(large: DataFrame, links: DataFrame) -> DataFrame:
    """``bucket, doc_id, outer, n_in, n_out``: the large buckets with texts outside of their largest class (outer)."""
    classes = components(links)
    of = large.select("bucket", "doc_id").join(classes, "doc_id", "left").select("bucket", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    of = keep(of, "classed")
    sizes = of.groupBy("bucket", "class_id").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "class_id")).alias("main"), F.sum("n").alias("n"))
    main = main.select("bucket", F.col("main.class_id").alias("main"), F.col("main.n").alias("n_in"), (F.col("n") - F.col("main.n")).alias("n_out")).filter("n_out > 0")
    rows = _joined(of, keep(main, "main"), ["bucket"], "doc_id")
    return keep(rows.select("bucket", "doc_id", (F.col("class_id") != F.col("main")).alias("outer"), "n_in", "n_out"), "outside")


def _to_representatives(rest: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """``bucket, doc_id, lead``: runs of the outer texts with their bucket's representatives, which lead."""
    run = F.pmod(F.xxhash64("doc_id", F.lit("run")), F.ceil(2 * F.col("n_out") / most))
    outer = _joined(rest.filter("outer"), reps, ["bucket", "doc_id"], "doc_id", "left_anti")
    runs = outer.select("bucket", "doc_id", run.alias("run"))
    led = _joined(runs.select("bucket", "run").distinct(), reps, ["bucket"], "run")
    return runs.withColumn("lead", F.lit(False)).unionByName(led.withColumn("lead", F.lit(True))).select(F.xxhash64("bucket", "run").alias("bucket"), "doc_id", "lead")


def _to_all(rest: DataFrame, most: int) -> DataFrame:
    """``bucket, doc_id, lead``: each block of outer texts (which lead) with each block of the others of its bucket."""
    blocks = lambda n: F.ceil(2 * F.col(n) / most).cast("int")
    rows = rest.select("bucket", "doc_id", "outer", blocks("n_in").alias("n_in"), blocks("n_out").alias("n_out"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.when(F.col("outer"), F.col("n_out")).otherwise(F.col("n_in"))).cast("int"))
    up_to = lambda n: F.expr(f"case when {n} > 0 then sequence(0, {n} - 1) else array() end")
    name = lambda i, kind, j: F.xxhash64("bucket", i, F.lit(kind), j).alias("bucket")
    outer, inner = rows.filter("outer"), rows.filter("not outer")
    each = lambda of, numbers: of.select("*", F.explode(numbers).alias("k"))
    parts = [
        each(outer, up_to("n_in")).select(name(F.col("at"), "in", F.col("k")), "doc_id", F.lit(True).alias("lead")),
        each(inner, up_to("n_out")).select(name(F.col("k"), "in", F.col("at")), "doc_id", F.lit(False).alias("lead")),
        each(outer, F.expr("sequence(at, n_out - 1)")).select(name(F.col("at"), "out", F.col("k")), "doc_id", F.lit(True).alias("lead")),
        each(outer, up_to("at")).select(name(F.col("k"), "out", F.col("at")), "doc_id", F.lit(False).alias("lead")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def complete_links(texts: DataFrame, large: DataFrame, links: DataFrame, idf: np.ndarray, least: float = SIMILARITY, most: int = BUCKET) -> DataFrame:
    """``links`` (stored) with those that the buckets ``large`` lack, so that their classes are those of all pairs."""
    if large.isEmpty():
        return links
    used, before = None, None
    while True:
        rest = _outside(large, links)
        left = rest.filter("outer").count()
        if not left:
            return links
        if before is not None and 2 * left > before:  # few of the rest are like any representative
            more = keep(verified_links(texts, keep(_to_all(rest, most), "blocks"), idf, least), "more-links")
            return keep(links.union(more).distinct(), "links")
        degree = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
        ranked = rest.join(degree, "doc_id", "left").select("bucket", "doc_id", F.coalesce("degree", F.lit(0)).alias("degree"))
        ranked = ranked if used is None else _joined(ranked, used, ["bucket", "doc_id"], "doc_id", "left_anti")
        order = Window.partitionBy("bucket").orderBy(F.desc("degree"), F.xxhash64("doc_id"))
        reps = keep(ranked.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= REPRESENTATIVES).select("bucket", "doc_id"), "representatives")
        used, before = reps if used is None else used.union(reps), left
        more = keep(verified_links(texts, keep(_to_representatives(rest, reps, most), "runs"), idf, least), "more-links")
        links = keep(links.union(more).distinct(), "links")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id``: each document with the least doc_id of its group of near duplicates.

    Exact copies of a text with words are in its class. Null texts, and texts without words, are alone. A null doc_id is
    the least one. Rows that share a doc_id and not the text are documents of their own, each in its text's class; an
    empty table gives an empty result.
    """
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return classified(docs, least).select(back("doc_id"), back("class_id"))


def classified(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, h1, h2, worded, class_id, head``: each row, by the hashes of its text, with its class; ``head`` is true
    for the text of a class with the least (doc_id, h1, h2). Null ids are NO_ID."""
    known, hashes = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_hashes()
    ids = keep(docs.select(known.alias("doc_id"), *hashes, F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded")), "text-ids")
    repeated = _repeated(ids)  # then texts go by a number of their own, else by their doc_id
    number = F.xxhash64("doc_id", "h1", "h2") if repeated else F.col("doc_id")
    lead = F.min(F.struct("doc_id", number.alias("number"))).alias("x")
    first = keep(ids.filter("worded").groupBy("h1", "h2").agg(lead).select("h1", "h2", "x.doc_id", F.col("x.number").alias("first")), "first")
    rows = docs.select(known.alias("doc_id"), "text", *hashes).select(number.alias("doc_id"), "text")
    df, n = frequencies(rows)
    idf = idf_table(df, n)
    texts = first.select(F.col("first").alias("doc_id"))
    keys = keep(band_keys(rows, idf), "keys").join(texts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keys = keep(keys, "band-keys")
    whole = whole_buckets(keys)
    found = keep(buckets(keys, BUCKET, whole), "found")
    single = rows.dropDuplicates(["doc_id"]) if repeated else rows
    links = keep(verified_links(single, found, idf, least), "links")
    links = complete_links(single, whole.filter(F.col("n") > BUCKET), links, idf, least)
    classes = components(links)
    heads = first.join(classes.withColumnRenamed("doc_id", "first"), "first", "left").withColumn("class_id", F.coalesce("class_id", "first"))
    leads = heads.groupBy("class_id").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("lead"))
    heads = heads.join(leads, "class_id").select("h1", "h2", F.col("lead.doc_id").alias("class_id"), (F.col("lead") == F.struct("doc_id", "h1", "h2")).alias("head"))
    alone = ids.filter("not worded").withColumn("class_id", F.col("doc_id")).withColumn("head", F.lit(True))
    return ids.filter("worded").join(heads, ["h1", "h2"]).select(*alone.columns).union(alone)


def text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.hash("text", F.lit(1)).alias("h2")]


def _repeated(ids: DataFrame) -> bool:
    return not ids.groupBy("doc_id").count().filter("count > 1").isEmpty()


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` in all columns with one document of each class: the one with the least doc_id, once.

    Of rows with that doc_id and different texts of the class the one with the least hash stays; rows without words all
    stay. Columns of any name are kept.
    """
    rows = classified(docs, least)
    heads = keep(rows.filter("head and doc_id = class_id").select("doc_id", "h1", "h2", "worded").distinct(), "heads")
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    packed = docs.select(known, *text_hashes(), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    on = [packed["doc_id"] == heads["doc_id"], packed["h1"].eqNullSafe(heads["h1"]), packed["h2"].eqNullSafe(heads["h2"])]
    kept = packed.join(heads, on).select(packed["doc_id"], packed["h1"], packed["h2"], "worded", "row")
    if _repeated(packed.select("doc_id")):
        same = Window.partitionBy("doc_id", "h1", "h2").orderBy(F.lit(0))
        kept = kept.withColumn("nth", F.row_number().over(same)).filter("nth = 1 or not worded")
    return kept.select("row.*")
