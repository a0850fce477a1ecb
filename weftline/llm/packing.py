"""Packing token sequences by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._store import keep
from weftline.llm._words import slices
from weftline.llm.tokens import default_tokenizer, encoder, with_end

#: Pieces packed together in one task.
GROUP_PIECES = 4096
CAPACITY = 4096


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every whole text with ``end_id``; only longer ones are cut.

    ids are unsigned 32-bit little-endian. A null or empty text is one piece of the end id.
    """
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            offsets, ids = with_end(*enc.encode(batch.column("text")), end_id)
            n = -(-np.diff(offsets) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(np.diff(offsets)[row] - start, capacity)
            begin = offsets[row] + start
            body = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([body[4 * a : 4 * (a + k)] for a, k in zip(begin, length, strict=True)], pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin, offset, fill)``: each length goes where the sum over gaps of squared counts of open bins becomes least.

    Among equal choices the smallest gap wins, and an open bin before a new one.
    """
    counts = np.zeros(capacity + 1, np.int64)  # of open bins, by gap; full bins (gap 0) don't count
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, size in enumerate(lengths.tolist()):
        # leaving gap g costs 1 - 2 n(g), entering g - size costs 1 + 2 n(g - size), a full bin costs nothing
        change = 2 * counts[: capacity + 1 - size] - 2 * counts[size:] + 2
        change[0] = -2 * counts[size] + 1
        change[counts[size:] == 0] = np.iinfo(np.int64).max
        left = capacity - size
        new = 2 * counts[left] + 1 if left else 0
        best = int(change.argmin())
        if change[best] <= new:
            gap = best + size
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if gap - size:
            counts[gap - size] += 1
            open_bins[gap - size].append(b)
    return bins, offsets, np.array(fill, np.int64)


def place(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``sequence_id, offset`` for a stored table of (``doc_id``, ``piece``, ``length``, ...).

    Pieces are dealt by a hash of id and row into groups of about ``group_pieces``, each packed by one task, longest first: that
    order leaves the short pieces to fill the gaps. The bins that a group leaves open waste under one in a thousand.
    """
    n_groups = max(1, round(pieces.count() / group_pieces))
    row = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())  # of a stored table, so that it stays the same
    keyed = pieces.withColumn("group", F.pmod(row, F.lit(n_groups)).cast("long"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"
    columns = pieces.columns

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        b, at, _ = sum_of_squares(rows["length"].to_numpy(np.int64), capacity)
        return rows[columns].assign(sequence_id=rows["group"].to_numpy(np.int64) * (1 << 32) + b, offset=at)

    return keyed.groupBy("group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``; ``ids`` too unless ``with_ids`` is false.

    Repeated rows, and rows without an id, are documents of their own. Columns but ``doc_id`` and ``text`` are left out.
    """
    pieces = cut_pieces(docs, capacity, tokenizer, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return place(keep(pieces if with_ids else pieces.drop("ids"), "pieces"), capacity)


def pack_digest(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
