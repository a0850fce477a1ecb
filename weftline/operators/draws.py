"""Seeded draws by weight, with DataFrame functions only: the same rows give the same draws, whatever the partitions.

A draw comes from a hash of the seed and of what is drawn or what asks, so that each row draws by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whole-number weight of an item without votes; another one's is divided by its votes and one.
UNIT = 10**9
_BITS = 60


def hashed(seed: str, *of: Column) -> Column:
    """A whole number under 2 ** 60 from the seed and the values (null: empty)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in of])
    return F.conv(F.substring(F.sha2(text, 256), 1, _BITS // 4), 16, 10).cast("bigint")


def _part(a: Column, b: Column, of: Column) -> Column:
    """``floor(a * b / of)`` of whole numbers; the rest is taken off first, because quotients of decimals are rounded."""
    a, b, of = (c.cast("decimal(19,0)") for c in (a, b, of))
    return ((a * b - a * b % of) / of).cast("bigint")


def share(h: Column, n: Column) -> Column:
    """``floor(h / 2 ** 60 * n)``: a place from 0 to n - 1."""
    return _part(h, n, F.lit(1 << _BITS))


def weighted_sample(items: DataFrame, group: str, item: str, weight: str, k: int, seed: str = "draw") -> DataFrame:
    """The columns of ``items`` with ``place`` (from 1) of the k of each group drawn without replacement.

    The chance of being drawn next is in proportion to ``weight``: the greatest keys ``ln(u) / weight`` are taken. Weights
    that are null or not above 0 are never drawn; equal items of a group draw alike, and ties go to the least item. Each
    partition keeps its own k rows of a group before the shuffle, so that a hot group sends k rows a partition.
    """
    u = (hashed(seed, F.col(group), F.col(item)).cast("double") + 0.5) / float(1 << _BITS)
    keyed = items.filter(F.col(weight) > 0).withColumn("_key", F.ln(u) / F.col(weight))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_key").desc(), F.col(item)))
    return keyed.withColumn("place", place).filter(F.col("place") <= k).drop("_key")


def placed(pool: DataFrame) -> DataFrame:
    """``variant, config, w, nth, below, n, total`` of ``variant, config, votes``: each one's number and the weights before
    it, in the order of a hash range (256 of them) and then of the config, and the size and weight of its variant.

    Running sums are taken within ranges and over the sums of ranges, so that no variant is in one task.
    """
    w = F.floor(F.lit(UNIT) / (1 + F.coalesce("votes", F.lit(0)))).cast("bigint")
    ranged = pool.select("variant", "config", F.greatest(w, F.lit(1)).alias("w"), F.substring(F.sha2("config", 256), 1, 2).alias("range"))
    sums = ranged.groupBy("variant", "range").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("mass"))
    before, whole = Window.partitionBy("variant").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("variant")
    first = sums.select(
        "variant", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("nth0"), F.coalesce(F.sum("mass").over(before), F.lit(0)).alias("below0"),
        F.sum("rows").over(whole).alias("n"), F.sum("mass").over(whole).alias("total"),
    )
    inner = Window.partitionBy("variant", "range").orderBy("config")
    own = ranged.withColumn("r", F.row_number().over(inner) - 1).withColumn("s", F.sum("w").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    return own.join(first, ["variant", "range"]).select("variant", "config", "w", (F.col("nth0") + F.col("r")).alias("nth"), (F.col("below0") + F.col("s")).alias("below"), "n", "total")


def issue_pairs(asks: DataFrame, pool: DataFrame, seed: str = "issue") -> DataFrame:
    """``ask, variant, config_a, config_b`` for each row of ``asks`` (``ask, variant``).

    ``pool`` has ``variant, config, votes``, each config once in a variant. Side a is drawn in proportion to
    1 / (1 + votes), side b evenly from the other configs of the variant. Asks of a variant of less than two configs get
    no pair. Side a's point on the line of all weights is looked up by equal cells, as many as there are configs: a config
    is listed in each cell that it reaches into, at most twice the pool in all, and an ask joins its cell.
    """
    line = placed(pool).filter("n >= 2")
    cell = lambda point: _part(point, F.col("n"), F.col("total"))
    cells = line.withColumn("cell", F.explode(F.sequence(cell(F.col("below")), cell(F.col("below") + F.col("w") - 1))))
    sizes = line.groupBy("variant").agg(F.first("n").alias("n"), F.first("total").alias("total"))
    point = asks.select("ask", "variant").join(sizes, "variant").withColumn("point", share(hashed(seed, F.lit("a"), F.col("ask")), F.col("total")))
    point = point.select("ask", "variant", "point", cell(F.col("point")).alias("cell"))
    a = point.join(cells, ["variant", "cell"]).filter("point >= below AND point < below + w")
    step = 1 + share(hashed(seed, F.lit("b"), F.col("ask")), F.col("n") - 1)
    a = a.select("ask", "variant", F.col("config").alias("config_a"), F.pmod(F.col("nth") + step, F.col("n")).alias("nth"))
    return a.join(line.select("variant", "nth", F.col("config").alias("config_b")), ["variant", "nth"]).select("ask", "variant", "config_a", "config_b")
