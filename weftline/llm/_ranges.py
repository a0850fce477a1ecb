"""Total orders over partitions: places and running values of rows of which many may share a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm._store import keep

#: Rows made of one row in one task at most.
CHUNK = 10_000
_LANES = ("r1", "r2")


def in_ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A written table in ranges of ``order``, each row with its range's number ``part``: a key of many rows spans ranges."""
    return keep(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def rows_before(ranged: DataFrame, group: list[str], n: Column) -> DataFrame:
    """``group, part, before``: the sum of ``n`` in the group's earlier parts; a row for each part of a group."""
    parts = ranged.groupBy(*group, "part").agg(F.sum(n).alias("n"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*group, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def repeated(df: DataFrame, n: str, index: str) -> DataFrame:
    """Each row ``n`` times, with the number 1 to n as ``index``; rows repeated very often are dealt to many tasks first."""
    few = df.filter(F.col(n) <= CHUNK).withColumn(index, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))
    starts = df.filter(F.col(n) > CHUNK).withColumn("chunk_at", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"), F.lit(CHUNK).cast("long"))))
    last = F.least(F.col("chunk_at") + (CHUNK - 1), F.col(n).cast("long"))
    many = starts.repartition(F.col("chunk_at")).withColumn(index, F.explode(F.sequence("chunk_at", last))).drop("chunk_at")
    return few.unionByName(many)


def running(df: DataFrame, key: str, order: list[Column], name: str, lanes: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``place``, from 1 in each ``key`` (long) by ``order``, and the running exclusive or ``r1, r2`` of two long
    columns. Rows are sorted over ranges, so that a key of any size is spread; each range tells the driver of its first
    and its last key, and what earlier ranges hold of these is added."""
    rows = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, edges, schema = TaskContext.get().partitionId(), None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            new = np.concatenate([[held is None or keys[0] != held[0]], keys[1:] != keys[:-1]])
            starts = np.flatnonzero(new)
            first = np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(keys)]])))
            carried = np.cumsum(new) == 0
            place = np.arange(1, len(keys) + 1) - first + np.where(carried, held[1] if held else 0, 0)
            runs = []
            for i, lane in enumerate(lanes or ()):
                acc = np.bitwise_xor.accumulate(batch.column(lane).to_numpy())
                runs.append(acc ^ np.where(first > 0, acc[first - 1], 0) ^ np.where(carried, held[2 + i] if held else 0, 0))
            if not edges and (ends := np.flatnonzero(new)[0 if held else 1 :][:1]).size:  # the first key ends here
                at = int(ends[0]) - 1
                edges.append((keys[at], place[at], *(r[at] for r in runs)) if at >= 0 else held)
            held = (keys[-1], place[-1], *(r[-1] for r in runs))
            yield _row(batch, place, runs, part, len(keys), False)
        if schema is not None:
            edges.append(held)
            blank = pa.RecordBatch.from_arrays([pa.array([int(e[0]) for e in edges], f.type) if f.name == key else pa.nulls(len(edges), f.type) for f in schema], schema=schema)
            yield _row(blank, np.array([e[1] for e in edges], np.int64), [np.array([e[2 + i] for e in edges], np.int64) for i in range(len(lanes or ()))], part, len(edges), True)

    ranged = keep(rows.mapInArrow(run, f"{fields}, place long, {''.join(f'{x} long, ' for x in _LANES[: len(lanes or ())])}part int, edge boolean"), name)
    found, carry = {}, []
    for r in sorted(ranged.filter("edge").select(key, "place", "part", *_LANES[: len(lanes or ())]).collect(), key=lambda r: r.part):  # two a range at most
        so_far = found.setdefault(r[key], [0, 0, 0])
        if so_far[0]:
            carry.append((r[key], r.part, *so_far))
        found[r[key]] = [so_far[0] + r.place, *(x ^ r[y] for x, y in zip(so_far[1:], _LANES[: len(lanes or ())], strict=False)), *([0, 0] if not lanes else [])]
    rows = ranged.filter("not edge").drop("edge")
    if not carry:
        return rows.drop("part")
    added = df.sparkSession.createDataFrame(carry, f"`{key}` long, part int, n_before long, b1 long, b2 long")
    rows = rows.join(F.broadcast(added), [key, "part"], "left").withColumn("place", F.col("place") + F.coalesce("n_before", F.lit(0)))
    for x, b in zip(_LANES[: len(lanes or ())], ("b1", "b2"), strict=False):
        rows = rows.withColumn(x, F.col(x).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long"))))
    return rows.drop("part", "n_before", "b1", "b2")


def _row(batch: pa.RecordBatch, place: np.ndarray, runs: list[np.ndarray], part: int, n: int, edge: bool) -> pa.RecordBatch:
    columns = [*batch.columns, pa.array(place, pa.int64()), *(pa.array(r, pa.int64()) for r in runs), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge))]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "place", *_LANES[: len(runs)], "part", "edge"])
