"""Paired randomization tests of a family of hypotheses: tables of all assignments of a unit, exact and pooled p, Holm."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.grouped import balanced

#: Blocks of a unit, draws of the pooled test, and the least number of pairs that a mean similarity needs.
BLOCKS, DRAWS, PAIRS_MIN = 5, 10_000, 4


@lru_cache(maxsize=8)
def assignments(n: int) -> np.ndarray:
    """The bits of the balanced assignments of ``n`` blocks, a row each in ascending order, leading bit first."""
    return np.array([[x >> (n - 1 - k) & 1 for k in range(n)] for x in balanced(n)])


def t_table(observed: int, entries: list, least: int, n: int = BLOCKS) -> np.ndarray:
    """T of each assignment: the second side's mean minus the first one's, NaN where a side has under ``least`` values.

    An entry ``i, j, s`` is the value of two runs, or with ``i`` = ``j`` of one; run 2k + v is block k's outcome of side
    v under the observed assignment. An outcome stays with its place in time, so that side v holds it under another
    assignment if that has the same bit for the block, and else the other side does.
    """
    bits = assignments(n)
    flipped = bits ^ bits[observed]
    second = np.stack([flipped, 1 - flipped], -1).reshape(len(bits), 2 * n)
    some = [e for e in entries if e["s"] is not None and not np.isnan(e["s"])]
    i, j, s = (np.array([e[c] for e in some], t) for c, t in (("i", int), ("j", int), ("s", float)))
    both, none = second[:, i] * second[:, j], (1 - second[:, i]) * (1 - second[:, j])
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = [np.where(m.sum(1) >= least, m @ s / m.sum(1), np.nan) for m in (none, both)]
    return mean[1] - mean[0]


def unit_runs(slots: DataFrame, n: int = BLOCKS) -> DataFrame:
    """``unit, batch, slot, i, observed`` of the units with all runs, of ``batch, config_ord, side, slot``.

    A unit is a batch's configuration with both sides; the slots of a side are its blocks in order. The observed
    assignment is drawn by a hash of the unit.
    """
    place = F.row_number().over(Window.partitionBy("batch", "config_ord", "side").orderBy("slot")) - 1
    unit = F.concat_ws("-", F.lit("u"), "batch", "config_ord")
    runs = slots.select(unit.alias("unit"), "batch", "config_ord", "slot", "side", place.alias("block"))
    runs = runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("batch", "config_ord"))).withColumn("least", F.max("block").over(Window.partitionBy("batch", "config_ord")))
    return runs.filter((F.col("n") == 2 * n) & (F.col("least") == n - 1)).select("unit", "batch", "slot", (F.col("block") * 2 + F.col("side")).cast("int").alias("i"), (F.crc32("unit") % len(balanced(n))).cast("int").alias("observed"))


def t_tables(runs: DataFrame, pairs: DataFrame, scalars: DataFrame) -> DataFrame:
    """``kind, target, unit, observed, t`` of each target and unit that has a value or a null score; ``t`` has null where T is
    not defined.

    ``pairs`` are ``channel, slot_a, slot_b, s``, ``scalars`` ``slot, scalar, v``. A unit has as many entries as pairs of
    its runs.
    """
    a, b = (runs.select("unit", "observed", F.col("slot").alias(f"slot_{x}"), F.col("i").alias(k)) for x, k in (("a", "i"), ("b", "j")))
    entry = F.struct("i", "j", "s").alias("e")
    of_pairs = pairs.join(a, "slot_a").join(b.drop("observed"), ["slot_b", "unit"]).select(F.lit("channel").alias("kind"), F.col("channel").alias("target"), "unit", "observed", entry)
    of_scalars = scalars.join(runs, "slot").select(F.lit("l1-scalar").alias("kind"), F.col("scalar").alias("target"), "unit", "observed", "i", F.col("i").alias("j"), F.col("v").alias("s")).select("kind", "target", "unit", "observed", entry)
    listed = of_pairs.union(of_scalars).groupBy("kind", "target", "unit", "observed").agg(F.array_sort(F.collect_list("e")).alias("entries"))

    def tables(observed: pd.Series, kind: pd.Series, entries: pd.Series) -> pd.Series:
        rows = (t_table(o, e, PAIRS_MIN if k == "channel" else 1) for o, k, e in zip(observed, kind, entries, strict=True))
        return pd.Series([[None if np.isnan(x) else float(x) for x in t] for t in rows])

    return listed.select("kind", "target", "unit", "observed", F.pandas_udf(tables, "array<double>")("observed", "kind", "entries").alias("t"))


def name_of(kind: Column, target: Column, unit: Column | None = None) -> Column:
    short = F.when(kind == "channel", "channel").otherwise("l1")
    return F.concat_ws("-", F.lit("H-pooled"), short, target) if unit is None else F.concat_ws("-", F.lit("H-exploratory"), unit, short, target)


def exploratory(tables: DataFrame) -> DataFrame:
    """``hypothesis_id, kind, target, unit, t_obs, p``: p is the share of assignments whose \\|T\\| reaches the observed one;
    null where any T is."""
    t, seen = F.col("t"), F.get("t", F.col("observed"))
    hits = F.size(F.filter(t, lambda x: F.abs(x) >= F.abs(seen) - 1e-12))
    p = F.when(~F.exists(t, lambda x: x.isNull()), hits / F.size(t))
    return tables.select(name_of(F.col("kind"), F.col("target"), F.col("unit")).alias("hypothesis_id"), "kind", "target", "unit", seen.alias("t_obs"), p.alias("p"))


def seed_of(hypothesis_id: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(unicodedata.normalize("NFC", hypothesis_id).encode()).digest()[:8], "little"))


def drawn(seed: np.uint64, unit: str, draws: int, size: int) -> np.ndarray:
    """The assignment of a unit in each draw, from a hash of the hypothesis' seed, the unit and the draw, so that tasks need
    no common stream and a rerun draws the same."""
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
    with np.errstate(over="ignore"):
        x = np.arange(1, draws + 1, dtype=np.uint64) * odd[0] + (seed ^ seed_of(unit))
        x = (x ^ (x >> np.uint64(30))) * odd[1]
        x = (x ^ (x >> np.uint64(27))) * odd[2]
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def pooled(tables: DataFrame, family: DataFrame, draws: int = DRAWS) -> DataFrame:
    """``hypothesis_id, kind, target, n_units, n_null, t_obs, p, place, p_holm`` of each row of ``family`` (``kind, target, ord``).

    The statistic is the mean of T over all units. Each unit's assignment is drawn anew ``draws`` times; p = (b + 1) /
    (draws + 1) with b draws that reach the observed one. A hypothesis has no p if T isn't defined for one of its
    units' assignments, or without units. Holm's steps leave out hypotheses without p and keep the size of the whole
    family. A task adds up its own units: what is shuffled is a sum for each hypothesis, draw and task.
    """

    def sums(frames):
        held: dict = {}
        for rows in frames:
            for r in rows.itertuples(index=False):
                t = np.array([np.nan if x is None else x for x in r.t], float)
                total, n, n_null = held.get((r.hypothesis_id, len(t)), (np.zeros(draws + 1), 0, 0))
                if np.isnan(t).any():
                    held[r.hypothesis_id, len(t)] = total, n + 1, n_null + 1
                else:
                    held[r.hypothesis_id, len(t)] = total + t[np.append(r.observed, drawn(seed_of(r.hypothesis_id), r.unit, draws, len(t)))], n + 1, n_null
        for (name, _), (total, n, n_null) in held.items():
            yield pd.DataFrame({"hypothesis_id": name, "draw": np.arange(-1, draws), "total": total, "n": n, "n_null": n_null})

    named = tables.select(name_of(F.col("kind"), F.col("target")).alias("hypothesis_id"), "unit", "observed", "t")
    parts = named.mapInPandas(sums, "hypothesis_id string, draw int, total double, n long, n_null long")
    total = parts.groupBy("hypothesis_id", "draw").agg(F.round(F.sum("total"), 9).alias("total"), F.sum("n").alias("n"), F.sum("n_null").alias("n_null"))
    seen = F.max(F.when(F.col("draw") < 0, F.col("total"))).over(Window.partitionBy("hypothesis_id")).alias("seen")  # read twice, the sums would be made twice
    hits = total.select("hypothesis_id", "draw", "total", seen, "n", "n_null").filter("draw >= 0").groupBy("hypothesis_id", "seen", "n", "n_null").agg(F.count_if(F.abs("total") >= F.abs("seen") - 1e-9).alias("b"))
    ok = F.col("n_null") == 0
    found = hits.select("hypothesis_id", F.col("n").alias("n_units"), "n_null", F.when(ok, F.round(F.col("seen") / F.col("n"), 9)).alias("t_obs"), F.when(ok, (F.col("b") + 1) / (draws + 1)).alias("p"))
    whole = family.select(name_of(F.col("kind"), F.col("target")).alias("hypothesis_id"), "kind", "target", "ord").join(found, "hypothesis_id", "left").fillna(0, ["n_units", "n_null"])
    # a family is a fixed list, so that one task orders it
    w = Window.orderBy(F.col("p").asc_nulls_last(), "ord")
    ranked = whole.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("place", F.when(F.col("p").isNotNull(), F.row_number().over(w)))
    step = F.least(F.lit(1.0), (F.col("k") - F.col("place") + 1) * F.col("p"))
    holm = F.max(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("p_holm", F.when(F.col("p").isNotNull(), holm)).select("hypothesis_id", "kind", "target", "n_units", "n_null", "t_obs", "p", "place", "p_holm")
