"""Removal of repeated passages with prefix-partitioned suffix trees.

A suffix is what follows a place in a text, cut off after ``width`` words. Suffixes are split into groups by a prefix of
variable length: the anchor, the ``prefix`` words with the least hash among the first ``width``, or all ``width`` words
where more than GROUP_SUFFIXES suffixes have an anchor, so that no group outgrows a task. (Anchors rather than leading
words: neighbouring suffixes mostly share one and travel as one run of words instead of ``width`` words each.) Each
group's subtree is built level by level: places get the same name for 2, 4, 8, ... words if both halves have the same
names, so that names compare words and not hashes of windows. Inner nodes of depth ``width`` are the repeats; all
leaves below one but the earliest are removed.

Anchors of one block only lead to leaves and their suffixes are never sent; what a block repeats in itself is settled
there, so that a passage of any frequency adds at most one suffix for each block to a group; and texts that copy an
earlier document's are settled before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.llm._blocks import BLOCK_BYTES, block_count, in_blocks, row_key
from weftline.llm._words import first_places, gather, inside, owner, span_hashes, text_bytes, window_hashes, word_spans

WIDTH = 20
#: Words of an anchor.
PREFIX = 11
#: Suffixes that may share an anchor before the prefix is extended to the whole window.
GROUP_SUFFIXES = 20_000
NO_ID = -(1 << 63)
COPY, VALUE = 0, 1


def names(words: np.ndarray, width: int) -> np.ndarray:
    """A number for the ``width`` words from each place on: equal numbers for equal words."""
    n, have, level = len(words) - width + 1, 1, pd.factorize(words)[0].astype(np.int64)
    if n <= 0:
        return np.empty(0, np.int64)
    out, reached = None, 0
    while True:
        if width & have:
            out = level if out is None else _joined(out, level, reached)
            reached += have
        if 2 * have > width:
            return out[:n]
        level, have = _joined(level, level, have), 2 * have


def _joined(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    m = min(len(left), len(right) - gap)
    return pd.factorize(left[:m] * (int(right.max(initial=0)) + 1) + right[gap : gap + m])[0]


class _Block:
    """The texts of one block in ascending order (doc_id, key); windows of copies of earlier documents are known."""

    def __init__(self, table: pa.Table, notes: pa.Table, width: int):
        ids, keys = pc.fill_null(table.column("doc_id"), NO_ID).to_numpy(), table.column("key").to_numpy()
        order = np.lexsort((keys, ids))
        self.order, self.ids, self.keys = order, ids[order], keys[order]
        self.text = table.column("text").combine_chunks().take(pa.array(order))
        kinds, values = notes.column("kind").to_numpy(), notes.column("value").to_numpy()
        self.copy = np.isin(self.keys, values[kinds == COPY]) & self.text.is_valid().to_numpy(zero_copy_only=False)
        self.values = np.unique(values[kinds == VALUE])
        self.width = width
        self.flat, bounds = text_bytes(self.text)
        self.offsets, self.start, self.end = word_spans(self.flat, bounds)
        self.words = span_hashes(self.flat, self.start, self.end)
        self.inner = inside(self.offsets, width)
        self.copied = self.copy[owner(self.offsets)[: len(self.inner)]]
        valid = self.inner & ~self.copied
        #: Places of windows that no earlier one of the block equals, and of those that one does.
        at = np.flatnonzero(valid)
        again = self._again(at)
        self.first, self.again = at[~again], at[again]

    def _again(self, at: np.ndarray) -> np.ndarray:
        """Which of the windows at these places have an equal one before; hashes find them, words decide."""
        codes, kinds = pd.factorize(window_hashes(self.words, self.width)[at])
        lead = first_places(codes, len(kinds))[codes]
        twice = np.flatnonzero(lead < np.arange(len(at)))
        a, b = at[twice], at[lead[twice]]
        if all((self.words[a + k] == self.words[b + k]).all() for k in range(self.width)):
            return lead < np.arange(len(at))
        return pd.Series(names(self.words, self.width)[at]).duplicated().to_numpy(bool)

    def anchors(self, prefix: int) -> np.ndarray:
        """The anchor of each window, as a hash whose last bit is free."""
        least, span, have = window_hashes(self.words, prefix), self.width - prefix + 1, 1
        while have * 2 <= span:
            least, have = np.minimum(least[: len(least) - have], least[have:]), have * 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        return least & ~np.uint64(1)

    def removed(self, repeats: np.ndarray) -> np.ndarray:
        """Which words the windows at these places, those of copies, and those that the block has before, cover."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        for at in (repeats, self.again, np.flatnonzero(self.inner & self.copied)):
            edge[at] += 1
            edge[at + self.width] -= 1  # places of one set are different
        return np.cumsum(edge)[:-1] > 0

    def kept(self, removed: np.ndarray) -> list[bytes]:
        """The words of each text that are left, joined by one space."""
        left = np.flatnonzero(~removed)
        size = self.end[left] - self.start[left] + 1
        ends, out = gather(np.append(self.flat, np.uint8(32)), self.start[left], size)
        out[ends[1:] - 1] = 32
        body, at = out.tobytes(), ends[np.searchsorted(left, self.offsets)]
        return [body[a : max(a, z - 1)] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _parts(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def find_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, key`` of the rows whose whole text a smaller doc_id has too."""
    ids = docs.filter("text is not null").select("doc_id", row_key().alias("key"), F.coalesce("doc_id", F.lit(NO_ID)).alias("at"), F.xxhash64("text").alias("h1"), F.hash("text", F.lit(1)).alias("h2"), F.octet_length("text").alias("h3"))
    first = ids.groupBy("h1", "h2", "h3").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").drop("last")
    return ids.join(first, ["h1", "h2", "h3"]).filter("at > first").select("doc_id", "key")


def mark_repeats(docs: DataFrame, out, schema: str | StructType, width: int = WIDTH, prefix: int = PREFIX, block_bytes: int = BLOCK_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Apply ``out(block, removed, table)`` to each block of ``docs``, where ``removed`` tells which words go."""
    n_blocks = block_count(docs, block_bytes)
    n_parts = max(32, 2 * n_blocks)
    blocks = in_blocks(docs.withColumn("key", row_key()), n_blocks, "key").repartition(n_blocks, "block")
    notes = "block int, kind int, value long"
    copies = in_blocks(find_copies(docs), n_blocks, "key").select("block", F.lit(COPY).alias("kind"), F.col("key").alias("value"))
    join = lambda right, f, to: blocks.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(f, to)

    def send_anchors(table: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(table, right, width)
        codes, kinds = pd.factorize(b.anchors(prefix)[b.first])
        return pa.table({"part": _parts(kinds, n_parts), "block": _number(table, len(kinds)), "value": kinds.view(np.int64), "n": np.bincount(codes, minlength=len(kinds)).astype(np.int32)})

    def match_anchors(table: pa.Table) -> pa.Table:
        """The anchors of several blocks go back to each; the last bit tells that the prefix is to be the whole window."""
        value, block, n = (table.column(c).to_numpy() for c in ("value", "block", "n"))
        codes, kinds = pd.factorize(value)
        many = np.bincount(codes, minlength=len(kinds)) > 1
        hot = np.bincount(codes, n, len(kinds)) > group_suffixes
        back = many[codes]
        found = value[back] | hot[codes[back]]
        return pa.table({"block": block[back], "kind": pa.array(np.full(len(found), VALUE), pa.int32()), "value": found})

    def send_suffixes(table: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(table, right, width)
        known = np.sort(b.values.view(np.uint64))
        lead = b.anchors(prefix)[b.first]
        at = np.minimum(np.searchsorted(known & ~np.uint64(1), lead), max(len(known) - 1, 0))
        wanted = known[at] & ~np.uint64(1) == lead if len(known) else np.zeros(len(lead), bool)
        place, lead, hot = b.first[wanted], lead[wanted], (known[at[wanted]] & np.uint64(1)).astype(bool) if len(known) else np.empty(0, bool)
        lead[hot] = window_hashes(b.words, width)[place[hot]]
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 1) | (lead[1:] != lead[:-1])
        run = np.flatnonzero(new)
        n = np.diff(np.append(run, len(place))) + width - 1
        ends, words = gather(b.words, place[run], n)
        sent = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(run), [None, pa.py_buffer(8 * ends.astype(np.int64)), pa.py_buffer(words.tobytes())])
        of = np.searchsorted(b.offsets, place[run], "right") - 1
        return pa.table({"part": _parts(lead[run], n_parts), "block": _number(table, len(run)), "at": place[run].astype(np.int32), "doc_id": b.ids[of], "key": b.keys[of], "words": sent.cast(pa.binary())})

    def grow_trees(table: pa.Table) -> pa.Table:
        """The leaves, but for the earliest, below each node of full depth."""
        doc, key, at, block = (table.column(c).to_numpy() for c in ("doc_id", "key", "at", "block"))
        sent = table.column("words").combine_chunks()
        size = pc.binary_length(sent).to_numpy().astype(np.int64) // 8
        begin = np.cumsum(size) - size
        name = names(np.frombuffer(b"".join(sent.to_pylist()), np.uint64), width)
        n = size - width + 1
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        node, place = name[begin[row] + step], at[row] + step
        order = np.lexsort((place, key[row], doc[row], node))  # rows alike in id and text are in one block, in order
        later = order[1:][node[order][1:] == node[order][:-1]]
        return pa.table({"block": block[row[later]], "kind": pa.array(np.full(len(later), VALUE), pa.int32()), "value": place[later].astype(np.int64)})

    def finish(table: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(table, right, width)
        return out(b, b.removed(b.values), table)

    anchors = join(copies, send_anchors, "part int, block int, value long, n int")
    shared = anchors.groupBy("part").applyInArrow(match_anchors, notes)
    suffixes = join(copies.union(shared), send_suffixes, "part int, block int, at int, doc_id long, key long, words binary")
    repeats = suffixes.groupBy("part").applyInArrow(grow_trees, notes)
    return join(copies.union(repeats), finish, schema)


def _number(table: pa.Table, n: int) -> pa.Array:
    return pa.array(np.full(n, table.column("block")[0].as_py()), pa.int32())


def _ids(b: _Block) -> pa.Array:
    return pa.array(b.ids, mask=b.ids == NO_ID)


def _digest(b: _Block, removed: np.ndarray, table: pa.Table) -> pa.Table:
    gone = np.concatenate([[0], np.cumsum(removed)])[b.offsets]
    return pa.table({
        "doc_id": _ids(b), "n_words": np.diff(b.offsets).astype(np.int64), "n_removed": np.diff(gone).astype(np.int64),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in b.kept(removed)], pa.string()),
    })


def substring_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document.

    Null texts have no words. Rows with one doc_id, null among them, come in the order of a hash of their texts, and each
    loses only what an earlier row, or an earlier place of its own, has. An empty table gives an empty result.
    """
    thin = docs.select(F.col("doc_id").cast("long"), "text")
    return mark_repeats(thin, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", width)


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, start, length``: the runs of words (from 0) of each document that repeat earlier passages."""

    def spans(b: _Block, removed: np.ndarray, table: pa.Table) -> pa.Table:
        row = owner(b.offsets)
        new = removed.copy()
        new[1:] &= ~removed[:-1] | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        length = np.bincount(np.cumsum(new)[removed] - 1, minlength=len(start))
        return pa.table({"doc_id": _ids(b).take(pa.array(row[start])), "start": start - b.offsets[row[start]], "length": length.astype(np.int64)})

    return mark_repeats(docs.select(F.col("doc_id").cast("long"), "text"), spans, "doc_id long, start long, length long", width)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` in all its columns, each text without its repeated passages.

    A text that loses words has the others joined by one space and may become empty; other texts stay as they are.
    """

    def out(b: _Block, removed: np.ndarray, table: pa.Table) -> pa.Table:
        gone = np.diff(np.concatenate([[0], np.cumsum(removed)])[b.offsets]) > 0
        left = pa.array([x if g else None for x, g in zip(b.kept(removed), gone.tolist(), strict=True)], pa.binary()).cast(pa.string())
        return pa.table({"row": table.column("row").take(pa.array(b.order)), "text": pc.if_else(pa.array(gone), left, b.text)})

    packed = docs.select(F.col("doc_id").cast("long"), "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"))
    schema = StructType([packed.schema["row"], StructField("text", StringType())])
    done = mark_repeats(packed, out, schema, width)
    return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
