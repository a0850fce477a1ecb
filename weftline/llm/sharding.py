"""Shards of near equal bytes by sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm._store import keep

#: Samples drawn for each range; the driver holds RANGES x this many keys of two longs.
SAMPLES_PER_RANGE = 40
#: Bytes of documents in one range at most; with at least RANGES_PER_SHARD ranges a shard.
RANGE_BYTES = 1 << 30
RANGES_PER_SHARD = 16
#: Share of a shard up to which a group of equal texts stays together.
WHOLE = 0.05


def _sample(keyed: DataFrame, rate: float, where=None) -> pd.DataFrame:
    """Keys drawn with a chance in proportion to their size, by a hash and so alike in each attempt."""
    u = F.pmod(F.xxhash64("k1", "k2", F.lit("splitter")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = keyed.filter(u < F.col("size") * F.lit(rate))
    if where is not None:
        rows = rows.filter(where)
    got = rows.select("k1", "k2", "size").toPandas()
    return got.assign(weight=np.maximum(got["size"], 1 / rate)).sort_values(["k1", "k2"], ignore_index=True)


def _quantiles(sample: pd.DataFrame, n: int) -> pd.DataFrame:
    """n - 1 boundaries of near equal weight; equal ones once."""
    if sample.empty or n < 2:
        return sample[["k1", "k2"]].head(0)
    ends = sample["weight"].cumsum()
    at = np.searchsorted(ends, np.arange(1, n) * (ends.iloc[-1] / n))
    return sample.loc[np.minimum(at, len(sample) - 1), ["k1", "k2"]].drop_duplicates().reset_index(drop=True)


def _ranges(bounds: pd.DataFrame):
    """A function of the key: how many boundaries are at or below it."""
    b1, b2 = bounds["k1"].to_numpy(np.int64), bounds["k2"].to_numpy(np.int64)

    @F.pandas_udf("int")
    def number(k1: pd.Series, k2: pd.Series) -> pd.Series:
        n, first = len(k1), np.concatenate([b1, k1.to_numpy(np.int64)])
        second, row = np.concatenate([b2, k2.to_numpy(np.int64)]), np.arange(len(b1) + n) >= len(b1)
        order = np.lexsort((row, second, first))
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(~row[order])
        return pd.Series(out[len(b1) :]).astype("int32")

    return number("k1", "k2")


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, text: str = "text", samples: int = SAMPLES_PER_RANGE, keep_columns: bool = True) -> DataFrame:
    """Adds ``size``, ``text_crc32``, ``shard`` and ``slot`` to ``docs``, or to ``doc_id`` alone without ``keep_columns``.

    Records are ordered by (hash of the text, ``doc_id``), so that equal texts are neighbours; boundaries are quantiles
    of a size-weighted sample; ranges that hold more than twice their share are divided by splitters of their own.
    A group of equal texts of at most WHOLE of a shard's share stays together and takes the shard in which the middle of
    its bytes falls; each record of a larger group does so by itself. So shards differ by such a group at most. Slots
    count from 0 in key order. A null text has no bytes (size 16) and the checksum 0; null ``doc_id`` sorts first;
    repeated rows each take a slot; an empty table gives an empty result. Columns of these names in ``docs`` must be
    renamed before (ValueError).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    clash = {"size", "text_crc32", "shard", "slot"} & set(docs.columns)
    if keep_columns and clash:
        raise ValueError(f"docs has columns named {sorted(clash)}")
    ids = docs.select(
        F.col("doc_id"), F.xxhash64(body).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k2"),
        (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = shard_keys(keep(ids, "shard-keys"), n_shards, samples)
    thin = placed.select("doc_id", "size", "text_crc32", "shard", "slot")
    if not keep_columns:
        return thin
    # the text stays where it is until here; repeated rows keep their multiplicity by number
    same = Window.partitionBy("doc_id", "text_crc32").orderBy("slot", "shard")
    numbered = thin.withColumn("nth", F.row_number().over(same))
    again = Window.partitionBy("doc_id", "text_crc32").orderBy(F.lit(0))
    packed = docs.select(F.col("doc_id"), F.crc32(body.cast("binary")).alias("text_crc32"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rest = packed.withColumn("nth", F.row_number().over(again))
    on = rest["doc_id"].eqNullSafe(numbered["doc_id"]) & (rest["text_crc32"] == numbered["text_crc32"]) & (rest["nth"] == numbered["nth"])
    return rest.join(numbered, on).select("row.*", "size", numbered["text_crc32"], "shard", "slot")


def shard_keys(keyed: DataFrame, n_shards: int, samples: int = SAMPLES_PER_RANGE) -> DataFrame:
    """``shard`` and ``slot`` for a stored table of (``k1``, ``k2``, ``size``, ...)."""
    spark = keyed.sparkSession
    total = keyed.agg(F.sum("size").alias("b")).first().b or 0
    n_ranges = max(n_shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    large = keyed.groupBy("k1").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > WHOLE * total / n_shards)
    large = F.broadcast(large.select("k1", F.lit(True).alias("large")))  # fewer than n_shards / WHOLE
    marked = keyed.join(large, "k1", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    keyed = keep(marked.withColumn("own", F.col("k2")).withColumn("k2", F.when(F.col("large"), F.col("k2")).otherwise(F.lit(0))), "shard-groups")
    share = max(total / n_ranges, 1)
    bounds = _quantiles(_sample(keyed, n_ranges * samples / max(total, 1)), n_ranges)
    while True:
        ranged = keyed.withColumn("range", _ranges(bounds))
        sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.max("size").alias("most")).toPandas()
        over = sizes[(sizes["bytes"] > 2 * share) & (sizes["bytes"] > 2 * sizes["most"])]
        if over.empty:
            break
        within = ranged.filter(F.col("range").isin(*map(int, over["range"])))
        more = _sample(within, samples / share)
        new = pd.concat([bounds, _quantiles(more, int(np.ceil(over["bytes"].sum() / share)) * 2)]).drop_duplicates()
        if len(new) == len(bounds):
            break
        bounds = new.sort_values(["k1", "k2"], ignore_index=True)
    sizes = sizes.sort_values("range")
    sizes["before"] = sizes["bytes"].cumsum() - sizes["bytes"]
    starts = spark.createDataFrame([(int(r), int(b)) for r, b in zip(sizes["range"], sizes["before"], strict=True)], "range int, before long")
    order = Window.partitionBy("range").orderBy("k1", "own", "size")
    begun = F.col("before") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = Window.partitionBy("range", "k1")
    middle = F.when(F.col("large"), F.col("begun") + F.col("size") / 2).otherwise(F.min("begun").over(group) + F.sum("size").over(group) / 2)
    cut = (
        ranged.join(F.broadcast(starts), "range")  # a row for each range
        .withColumn("row", F.row_number().over(order))
        .withColumn("begun", begun)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * F.lit(n_shards / max(total, 1)))).cast("int"))
    )
    cut = keep(cut.drop("before", "begun"), "shard-cut")
    pieces = cut.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).toPandas()
    pieces = pieces.sort_values(["shard", "range"])
    pieces["base"] = pieces.groupby("shard")["n"].cumsum() - pieces["n"] - pieces["first"]
    bases = spark.createDataFrame([tuple(map(int, x)) for x in pieces[["range", "shard", "base"]].to_numpy()], "range int, shard int, base long")
    return cut.join(F.broadcast(bases), ["range", "shard"]).withColumn("slot", F.col("base") + F.col("row"))
