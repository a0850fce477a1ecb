"""Prefix trie of conversations: shared beginnings as nodes, with sums over subtrees.

A node is told by 128 bits: the exclusive or, over its turns, of hashes of their place, role and text. Spark groups the
turns by node. Nodes of one conversation are chains and need no trie. The others are cut where at most ``limit`` turns
lie below a node; these subtrees, dealt out by their top's hash, become level-order tries in numpy (LOUDS: a bit for each
child and an end bit for each node, and the labels in level order), whose sums go from the last level to the first. The
few nodes above are merged after them, from the sums of the tops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._ranges import running
from weftline.llm._store import keep

#: Of each FAMILY conversations, c - c % FAMILY (floored) lends its beginning to the others: up to MOST_HEAD - 1 turns.
FAMILY, MOST_HEAD = 5, 9
#: Turns below a node from which on it is merged above; at most UPPER_WIDTH nodes of a level are.
LIGHT, UPPER_WIDTH = 2_000, 65_536
#: Shared nodes aimed at in one shard, and shards at least.
SHARD_NODES, LEAST_SHARDS = 50_000, 256
#: Bytes of joined ids that one row of a long list has.
PIECE = 1 << 20


def original_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, x1, x2, bytes``: turns in order (null first; equal ones by role, then by the text's SHA-256)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(F.lit(1), role, text).alias("x1"), F.xxhash64(F.lit(2), role, text).alias("x2"),
    )
    return running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "turns").select("conv_id", "place", "x1", "x2", "bytes")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(convs, rows)``: ``conv_id, length`` of all rebuilt conversations, and their turns ``conv_id, length, d, x1, x2, bytes``."""
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_HEAD))
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    plans = sizes.withColumn("head", head).withColumn("first", first)
    lent = sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    own = F.col("conv_id") == F.col("first")
    plans = plans.join(lent, "first", "left").withColumn("lent", F.when(own, 0).otherwise(F.least("head", F.coalesce("n_first", F.lit(0)))))
    plans = plans.withColumn("cut", F.when(own, 0).otherwise(F.col("head"))).withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("cut"), F.lit(0)))
    plans = keep(plans.select("conv_id", "first", "lent", "cut", "length"), "plans")
    rest = turns.join(plans.select("conv_id", "lent", "cut", "length"), "conv_id").filter("place > cut").select("conv_id", "length", (F.col("place") - F.col("cut") + F.col("lent")).alias("d"), "x1", "x2", "bytes")
    heads = turns.filter(F.col("place") < MOST_HEAD).withColumnRenamed("conv_id", "first")
    borrowed = plans.filter("lent > 0").select("conv_id", "first", "lent", "length").join(heads, "first").filter("place <= lent").select("conv_id", "length", F.col("place").alias("d"), "x1", "x2", "bytes")
    return plans.select("conv_id", "length"), rest.unionByName(borrowed)


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id, length, d, k1, k2, p1, p2, bytes``: the node that each turn ends at, and its parent's."""
    rows = rows.withColumn("y1", F.xxhash64(F.lit(1), "x1", "d")).withColumn("y2", F.xxhash64(F.lit(2), "x2", "d")).drop("x1", "x2")
    sums = running(rows, "conv_id", [F.col("d")], "prefixes", ("y1", "y2"))
    return sums.select("conv_id", "length", "d", F.col("r1").alias("k1"), F.col("r2").alias("k2"), F.col("r1").bitwiseXOR(F.col("y1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("y2")).alias("p2"), "bytes")


class Louds:
    """Subtrees in level order: ``order`` of the given nodes, ``bits``, and ``levels``, the bounds of the levels."""

    def __init__(self, level: np.ndarray, k1: np.ndarray, k2: np.ndarray, p1: np.ndarray, p2: np.ndarray):
        n = len(level)
        a, b = np.concatenate([k1, p1]), np.concatenate([k2, p2])
        at = np.lexsort((b, a))
        kind = np.empty(2 * n, np.int64)
        kind[at] = np.cumsum(np.concatenate([[True], (np.diff(a[at]) != 0) | (np.diff(b[at]) != 0)])[: 2 * n]) - 1
        of = np.full(2 * n, -1)
        of[kind[:n]] = np.arange(n)
        above = np.where(level > 0, of[kind[n:]], -1)
        depths = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[depths], np.arange((level.max() if n else -1) + 2))
        rank, self.order, self.levels = np.full(n + 1, -1), np.empty(n, np.int64), bounds
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            nodes = depths[lo:hi]
            nodes = nodes[np.lexsort((k2[nodes], k1[nodes], rank[above[nodes]]))]
            self.order[lo:hi] = nodes
            rank[nodes] = np.arange(lo, hi)
        children = np.bincount(rank[above[self.order]] + 1, minlength=n + 1)  # of the place above all tops, and of each node
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(children + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """The parent of each node, both by their places in level order; -1 for tops: how many lists end before its bit."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def children(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Over each node's subtree; values and sums by places in level order."""
        out, up = values.copy(), self.parents()
        for lo, hi in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(out, up[lo:hi], out[lo:hi])
        return out


def _rolled(table: pa.Table) -> pa.Table:
    """The nodes of whole subtrees with ``n_children, n_leaves, saved``: ``leaves0, children0, saved0`` come from below."""
    column = {x: table.column(x).to_numpy() for x in ("level", "k1", "k2", "p1", "p2", "n_convs", "bytes", "children0", "leaves0", "saved0")}
    trie = Louds(*(column[x] for x in ("level", "k1", "k2", "p1", "p2")))
    by = {x: v[trie.order] for x, v in column.items()}
    children = trie.children()
    leaves = trie.sums(by["leaves0"] + (children + by["children0"] == 0))
    saved = trie.sums(by["saved0"] + (by["n_convs"] - 1) * by["bytes"])
    out = table.take(pa.array(trie.order)).select(["level", "k1", "k2", "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs"])
    for name, v in (("n_children", children + by["children0"]), ("n_leaves", leaves), ("saved_tokens", saved)):
        out = out.append_column(name, pa.array(v.astype(np.int64)))
    return out


_ROLLED = "level long, k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _succinct(table: pa.Table) -> pa.Table:
    trie = Louds(*(table.column(x).to_numpy() for x in ("level", "k1", "k2", "p1", "p2")))
    k1, k2 = (pa.array([table.column(x).to_numpy()[trie.order]], pa.list_(pa.int64())) for x in ("k1", "k2"))
    return pa.table({"shard": table.column("shard")[:1], "n_nodes": pa.array([len(trie.order)], pa.int64()), "louds": pa.array([np.packbits(trie.bits).tobytes()]), "k1": k1, "k2": k2})


def trie_shards(light: DataFrame) -> DataFrame:
    """``shard, n_nodes, louds, k1, k2``: each shard's trie as packed bits (2 n + 1) and labels in level order, for storing."""
    return light.groupBy("shard").applyInArrow(_succinct, "shard int, n_nodes long, louds binary, k1 array<long>, k2 array<long>")


class Nodes:
    """The nodes of a prefix trie as written tables.

    ``light``: shared nodes in shards; ``upper``: those above, with the root; ``single``: nodes of one conversation.
    """

    def __init__(self, conversations: DataFrame, limit: int = LIGHT):
        self.convs, rebuilt = rebuilt_turns(original_turns(conversations))
        whole = self.convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"), F.sum("length").alias("turns")).first()
        self.n, self.least, self.turns = whole.n, whole.m, whole.turns or 0
        limit = max(limit, self.turns // UPPER_WIDTH)
        self.rows = prefixes(rebuilt)
        found = self.rows.groupBy("d", "k1", "k2").agg(
            F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("length") - F.col("d") + 1).alias("below"),
        )
        nodes = keep(found, "nodes")
        shared = nodes.filter("n_convs > 1").select("k1", "k2", F.col("conv_id").alias("m"), (F.col("below") <= limit).alias("light"))
        path = self.rows.join(shared, ["k1", "k2"]).groupBy("conv_id").agg(
            F.count(F.lit(1)).alias("shared"), F.count_if(F.col("m") < F.col("conv_id")).alias("others"), F.max(F.when(F.col("m") < F.col("conv_id"), F.col("m"))).alias("before"),
            F.min(F.when(F.col("light"), F.struct("d", "k1", "k2"))).alias("top"),
        )
        self.paths = keep(path, "paths")
        at = nodes.join(self.paths, "conv_id", "left")
        parent = F.when(F.col("d") == F.coalesce("others", F.lit(0)) + 1, F.coalesce("before", F.lit(self.least))).otherwise(F.col("conv_id"))
        self.nodes = keep(at.select("d", "k1", "k2", "p1", "p2", "bytes", "n_convs", "conv_id", "below", parent.alias("parent_conv_id"), F.coalesce("shared", F.lit(0)).alias("shared"), "top"), "placed")
        self.single = self.nodes.filter("n_convs = 1")
        chains = self.single.filter("d = shared + 1").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("chains"))
        several = self.nodes.filter("n_convs > 1").withColumn("light", F.coalesce(F.col("top.d") <= F.col("d"), F.lit(False)))
        several = several.join(chains.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "chains"), ["k1", "k2"], "left")
        depth, ends = F.col("d").alias("depth"), F.coalesce("chains", F.lit(0))
        shape = [(F.col("d") - F.coalesce("top.d", F.lit(0))).alias("level"), "k1", "k2", "p1", "p2", "conv_id", depth, "parent_conv_id", "n_convs", "bytes", ends.alias("children0"), ends.alias("leaves0"), F.lit(0).cast("long").alias("saved0")]
        n_shards = max(LEAST_SHARDS, -(-self.turns // SHARD_NODES))
        self.light = several.filter("light").select(F.pmod(F.xxhash64("top.k1", "top.k2"), F.lit(n_shards)).cast("int").alias("shard"), *shape)
        heavy = several.filter("not light").withColumn("top", F.lit(None).cast("struct<d:long,k1:long,k2:long>"))
        self.upper = heavy.select(*shape)
        if self.n:
            zero = F.lit(0).cast("long")
            of_root = self.single.filter("d = 1").agg(F.count(F.lit(1)).alias("chains"))
            blank = [zero.alias(x) for x in ("level", "k1", "k2", "p1", "p2")]
            root = of_root.select(*blank, F.lit(self.least).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(self.n).cast("long").alias("n_convs"), zero.alias("bytes"), F.col("chains").alias("children0"), F.col("chains").alias("leaves0"), zero.alias("saved0"))
            self.upper = self.upper.unionByName(root)

    def rolled(self) -> DataFrame:
        """Shared nodes with their sums, the root among them."""
        light = keep(self.light.groupBy("shard").applyInArrow(_rolled, _ROLLED), "light")
        tops = light.filter("level = 0").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        upper = self.upper.join(tops.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "tops", "leaves", "saved"), ["k1", "k2"], "left")
        for to, more in (("children0", "tops"), ("leaves0", "leaves"), ("saved0", "saved")):
            upper = upper.withColumn(to, F.col(to) + F.coalesce(more, F.lit(0)))
        return light.unionByName(upper.drop("tops", "leaves", "saved").withColumn("shard", F.lit(-1)).groupBy("shard").applyInArrow(_rolled, _ROLLED))

    def ends(self) -> DataFrame:
        """``k1, k2, conv_id``: the conversations that end at shared nodes or at the root."""
        last = self.rows.filter("d = length").join(self.paths.select("conv_id", F.col("shared").alias("s")), "conv_id").filter("s = length").select("k1", "k2", "conv_id")
        zero = F.lit(0).cast("long")
        return last.unionByName(self.convs.filter("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))


def list_digests(ends: DataFrame, piece_bytes: int = PIECE) -> DataFrame:
    """``k1, k2, digest``: SHA-256 of each group's ids in order, joined by commas. Ids are sorted over ranges and hashed as
    they come; a list that spans ranges goes on as pieces of text."""

    names = [("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("piece", pa.string()), ("digest", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, text, size, seq, in_pieces, done = TaskContext.get().partitionId(), None, [], 0, 0, True, []

        def piece() -> tuple:
            return *now, part, seq, ",".join(text), None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip((n for n, _ in names), r, strict=True)) for r in done], pa.schema(names))

        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            ids = pc.cast(batch.column("conv_id"), pa.string()).to_pylist()
            cuts = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if (key := (int(k1[a]), int(k2[a]))) != now:
                    if now is not None:
                        done.append(piece() if in_pieces else (*now, part, 0, None, hashlib.sha256(",".join(text).encode()).hexdigest()))
                        in_pieces = False  # only a range's first and last list can be part of a longer one
                    now, text, size, seq = key, [], 0, 0
                text += ids[a:b]
                size += sum(map(len, ids[a:b]))
                if size > piece_bytes:
                    done.append(piece())
                    text, size, seq, in_pieces = [], 0, seq + 1, True
                if len(done) >= 10_000 or size == 0:
                    yield out()
                    done = []
        if now is not None:
            done.append(piece())
            yield out()

    schema = "k1 long, k2 long, part int, seq long, piece string, digest string"
    ranged = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    found = keep(ranged.mapInArrow(run, schema), "ends")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, begun = None, None, False
        for batch in batches:
            done = []
            for k1, k2, piece in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "piece")), strict=True):
                if (k1, k2) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest, begun = (k1, k2), hashlib.sha256(), False
                if piece:
                    digest.update((("," if begun else "") + piece).encode())
                    begun = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["k1", "k2", "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([digest.hexdigest()])], ["k1", "k2", "digest"])

    pieces = found.filter("piece is not null").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part", "seq").select("k1", "k2", "piece")
    return found.filter("digest is not null").select("k1", "k2", "digest").unionByName(pieces.mapInArrow(join, "k1 long, k2 long, digest string"))


def prefix_trie(conversations: DataFrame, limit: int = LIGHT) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (``conv_id, turn, role, text``).

    ``conv_id`` is its least member, ``depth`` its turns, ``parent_conv_id`` its parent's ``conv_id``; ``n_convs`` members,
    ``n_children``, ``n_leaves`` (nodes without children in its subtree), ``saved_tokens`` (over the subtree, bytes of the
    last text for each member but one) and ``ends_sha256`` of the members that have no more turns. Null roles and texts are
    empty, null turns come first, equal turns by role and then by the text's SHA-256; repeated rows are turns of their own;
    rows without a conv_id belong to no conversation. No conversations: no root. ``limit`` moves work, not results.
    """
    nodes = Nodes(conversations, limit)
    empty = hashlib.sha256(b"").hexdigest()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    last = F.col("below") == 1
    single = nodes.single.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(empty)).alias("ends_sha256"),
    )
    shared = nodes.rolled().join(list_digests(nodes.ends()), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(empty)))
    return shared.select(*columns).unionByName(single.select(*columns))
