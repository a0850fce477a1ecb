"""Blocks of documents: groups of bounded text size by a hash of id and text, the unit of Arrow work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes aimed at in one block.
BLOCK_BYTES = 8 << 20


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES, text: str = "text") -> int:
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first().b or 0
    return max(8, -(-total // block_bytes))


def row_key() -> Column:
    """A hash of ``doc_id`` and ``text``: rows without an id, or with the same one, are told apart by their texts."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")


def in_blocks(docs: DataFrame, n_blocks: int, key: str | None = None) -> DataFrame:
    """Adds the block number, by :func:`row_key` or the column that has it."""
    return docs.withColumn("block", F.pmod(F.xxhash64(F.col(key) if key else row_key()), F.lit(n_blocks)).cast("int"))
