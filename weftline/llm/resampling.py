"""Documents drawn to resemble a target: importance weights over hashed word runs, highest perturbed scores first.

Features are counted into a fixed array of buckets, a document's weight is the mean log ratio of its features' buckets,
and a Gumbel draw by document makes the highest scores a sample without replacement. Scores are whole numbers: their
histogram, summed from the top, gives each score's first rank and the score at which the draw ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm._ranges import in_ranges, repeated, rows_before
from weftline.llm._store import keep, on_driver
from weftline.llm._words import LONG_WORD, slices, text_bytes, word_spans

#: Buckets of features, least words of a document that can be drawn, percent drawn, seed of the draws.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: A-Z as a-z, and the bytes outside of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after that.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_APART = np.array([b < 0x30 or 0x39 < b < 0x61 or 0x7A < b < 0x80 for b in range(256)])


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def span_crcs(flat: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 of the bytes of each span, one byte of all spans at a time; ``before``: the CRC of what precedes each."""
    n = end - start
    c = np.full(len(n), 0xFFFFFFFF, np.uint32) if before is None else ~before
    todo, k = np.flatnonzero((n > 0) & (n < LONG_WORD)), 0
    while len(todo):
        now = c[todo]
        c[todo] = _CRC[(now ^ flat[start[todo] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        k += 1
        todo = todo[n[todo] > k]
    c = ~c
    for i in np.flatnonzero(n >= LONG_WORD):
        c[i] = zlib.crc32(flat[start[i] : end[i]].tobytes(), 0 if before is None else int(before[i]))
    return c


def feature_buckets(text, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, owner, buckets)``: the number of words of each text, and of each feature its text and bucket.

    The features are all words and all pairs of words in a row, joined by a space.
    """
    flat, bounds = text_bytes(text)
    flat = _LOWER[flat]
    offsets, start, end = word_spans(flat, bounds, _APART)
    words = np.diff(offsets)
    of = np.repeat(np.arange(len(words)), words)
    single = span_crcs(flat, start, end)
    first = np.flatnonzero(of[1:] == of[:-1]) if len(of) > 1 else np.empty(0, np.int64)
    spaced = ~single[first]
    spaced = ~(_CRC[(spaced ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (spaced >> np.uint32(8)))
    pair = span_crcs(flat, start[first + 1], end[first + 1], spaced)
    return words, np.concatenate([of, of[first]]), np.concatenate([single, pair]) % np.uint32(n_buckets)


def bucket_counts(docs: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; a task adds up all that it reads, and sends a row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_buckets, np.int64)
        for batch in slices(batches):
            held += np.bincount(feature_buckets(batch.column("text"), n_buckets)[2], minlength=n_buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["bucket", "n"])

    found = on_driver(docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    out = np.zeros(n_buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def bucket_gains(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) by bucket."""
    s, t = bucket_counts(docs, n_buckets).astype(float), bucket_counts(target, n_buckets).astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets)))).astype(np.int64)


def draw_value(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel draw, floored: from the first 32 bits of sha256 of ``seed:doc_id`` (no id: nothing)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row."""
    held = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, of, buckets = feature_buckets(batch.column("text"), len(held.value))
            n = np.bincount(of, minlength=len(words))
            total = np.zeros(len(words), np.int64)
            np.add.at(total, of, held.value[buckets])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + draw_value(F.col("doc_id"), seed))


def first_ranks(histogram: pd.DataFrame, k: int) -> pd.DataFrame:
    """``score, above`` of the scores that reach the first k ranks; ``above`` documents have a higher score."""
    by = histogram.sort_values("score", ascending=False, ignore_index=True)
    above = by["n"].cumsum() - by["n"]
    return pd.DataFrame({"score": by["score"], "above": above})[above < k]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; the drawn rows have a rank from 1.

    Of the documents with ``least_words`` the highest ``percent`` percent (floored) by score are drawn, ties by doc_id, a
    null id first. A null or empty text has no features, weight 0 and is not drawn; rows alike in id, features and weight
    stand one after another; without a target text, or without documents, all gains come from the one side. Empty tables
    give no rows. The driver holds a number for each bucket and each score: scores lie within some 100,000 whole numbers,
    as the logarithms of counts and draws do.
    """
    spark = docs.sparkSession
    rows = keep(scored(docs, bucket_gains(docs, target, n_buckets), seed), "scored")
    able = F.col("n_words") >= least_words
    histogram = on_driver(rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    k = int(histogram["n"].sum()) * percent // 100
    columns = ("doc_id", "n_features", "weight", "score")
    if not k:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    ranks = first_ranks(histogram, k)
    cutoff = int(ranks["score"].min())
    able = able & (F.col("score") >= cutoff)
    alike = rows.filter(able).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    ranged = in_ranges(alike, [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")], "drawn")
    before = rows_before(ranged, ["score"], F.col("n"))  # a row for each score and each range at most
    within = Window.partitionBy("score", "part").orderBy("doc_id", "n_features", "weight")
    at = ranged.withColumn("row", F.sum("n").over(within) - F.col("n"))
    at = at.join(F.broadcast(before), ["score", "part"]).join(F.broadcast(spark.createDataFrame(ranks, "score long, above long")), "score")
    at = repeated(at, "n", "i").withColumn("rank", F.col("above") + F.col("before") + F.col("row") + F.col("i"))
    drawn = at.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return drawn.unionByName(rows.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, in all their columns, with ``rank`` (of several rows of one id the first)."""
    found = resample(docs, target, **options).filter("rank is not null").groupBy(F.col("doc_id").alias("of")).agg(F.min("rank").alias("rank"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("of"))).drop("of")
