"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._store import keep, on_driver
from weftline.llm._words import hash_words, inside, owner, slices, split_words, window_hashes

#: Shortest tile in tokens, and the share of an item's tokens that tiles must cover.
LEAST_TILE, COVERAGE = 5, 0.6
#: Distinct seeds of a benchmark up to which they are sent to all tasks (8 bytes each); beyond, seeds are joined.
NO_ID = -(1 << 63)
MOST_SENT = 1_000_000
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def tokens(text) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, hashes)`` of the tokens of each text: words in lower case without other signs than letters and digits."""
    offsets, codes, words = split_words(text)
    plain = [_OTHER.sub("", w.lower()) for w in words.to_pylist()]
    real = np.array([bool(w) for w in plain], bool)
    keep = real[codes] if len(codes) else np.empty(0, bool)
    hashes = hash_words(plain)[codes[keep]] if len(plain) else np.empty(0, np.uint64)
    return np.concatenate([[0], np.cumsum(keep)])[offsets], hashes


def seeds(offsets: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, n)``: the runs of ``width`` tokens in each text, each hash once for each text, and how often."""
    ok = inside(offsets, width)
    got = window_hashes(h, width)[ok]
    rows = owner(offsets)[: len(ok)][ok]
    order = np.lexsort((got, rows))
    rows, got = rows[order], got[order]
    first = np.flatnonzero(np.concatenate([[True], (got[1:] != got[:-1]) | (rows[1:] != rows[:-1])])) if len(got) else np.empty(0, np.int64)
    return rows[first], got[first], np.diff(np.append(first, len(got)))


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Running Karp-Rabin greedy string tiling: ``(start in item, start in text, length)``.

    Runs of a search length are hashed and compared; the longest matches of unmarked tokens are marked first, earlier
    places before later ones, and the search length falls to the longest match left until it is below ``least``.
    """
    n, m, found = len(item), len(text), []
    free_item, free_text = np.ones(n, bool), np.ones(m, bool)
    length = _longest(item, text, free_item, free_text, least, min(n, m))
    while length >= least:
        a, b = window_hashes(item, length), window_hashes(text, length)
        places: dict[int, list[int]] = {}
        for j in np.flatnonzero(np.isin(b, a)).tolist():
            places.setdefault(int(b[j]), []).append(j)
        for i in range(n - length + 1):
            for j in places.get(int(a[i]), ()):
                if free_item[i : i + length].all() and free_text[j : j + length].all() and (item[i : i + length] == text[j : j + length]).all():
                    free_item[i : i + length] = False
                    free_text[j : j + length] = False
                    found.append((i, j, length))
                    break
        length = _longest(item, text, free_item, free_text, least, length - 1)
    return found


def _longest(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, least: int, most: int) -> int:
    """The length of the longest match of unmarked tokens, at most ``most``; 0 where none has ``least``.

    Hashes of runs tell whether a length has a match; where it has, so has each shorter one.
    """

    def hashes(values: np.ndarray, free: np.ndarray, length: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return window_hashes(values, length)[taken[length:] == taken[:-length]]

    low, high = least - 1, most
    while low < high:
        mid = (low + high + 1) // 2
        if np.isin(hashes(item, free_item, mid), hashes(text, free_text, mid)).any():
            low = mid
        else:
            high = mid - 1
    return low if low >= least else 0


@lru_cache(maxsize=4096)
def _item_tokens(text: str) -> np.ndarray:
    return tokens(pa.array([text]))[1]


def candidate_pairs(docs: DataFrame, items: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE, most_sent: int = MOST_SENT) -> DataFrame:
    """``doc_id, key, item_id`` that share enough seeds to reach ``coverage``; ``docs`` has ``doc_id, key, text``.

    A tile of L tokens has at least L / least seeds in it, so an item with fewer places whose seed the document has
    than coverage x tokens / least can't do. The seed of an item of fewer than ``least`` tokens is all of it.
    """
    spark = docs.sparkSession

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, tokens_of = tokens(batch.column("text"))
            n = np.diff(offsets)
            for width in np.unique(np.minimum(n[n > 0], least)).tolist():
                rows, h, places = seeds(offsets, tokens_of, width)
                own = np.minimum(n[rows], least) == width
                rows = rows[own]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array(h[own].view(np.int64)), pa.array(n[rows]), pa.array(places[own]), pa.array(np.full(len(rows), width))], ["item_id", "seed", "n", "places", "width"])

    of_items = keep(items.select("item_id", "text").mapInArrow(item_seeds, "item_id long, seed long, n long, places long, width long").distinct(), "item-seeds")
    widths = sorted(r.width for r in of_items.select("width").distinct().collect())  # 1 to ``least``
    known = None
    if of_items.count() <= most_sent:
        known = spark.sparkContext.broadcast(np.unique(on_driver(of_items.select("seed"))["seed"].to_numpy(np.int64)))
        of_items = F.broadcast(of_items)

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, tokens_of = tokens(batch.column("text"))
            for width in widths:
                ok = inside(offsets, width)
                h, rows = window_hashes(tokens_of, width)[ok].view(np.int64), owner(offsets)[: len(ok)][ok]
                if known is not None:
                    at = np.searchsorted(known.value, h)
                    at[at == len(known.value)] = 0
                    hit = known.value[at] == h if len(known.value) else np.zeros(len(h), bool)
                    rows, h = rows[hit], h[hit]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), batch.column("key").take(pa.array(rows)), pa.array(h)], ["doc_id", "key", "seed"])

    of_docs = docs.select("doc_id", "key", "text").mapInArrow(doc_seeds, "doc_id long, key long, seed long").distinct()
    shared = of_docs.join(of_items, "seed").groupBy("doc_id", "key", "item_id", "n").agg(F.sum("places").alias("shared"))
    return shared.filter(F.col("shared") * F.least(F.lit(least), "n") >= F.col("n") * coverage).select("doc_id", "key", "item_id")


def _row(docs: DataFrame) -> list[Column]:
    """What tells a row's text from others: its id, and a hash for rows that share one."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(docs["text"]).alias("key")]


def found_rows(docs: DataFrame, items: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, key, item_id, n_tokens, n_covered, n_tiles, coverage`` of texts and the items that tiles cover enough of."""
    rows = docs.select(*_row(docs), "text").filter("text is not null").dropDuplicates(["doc_id", "key"])
    items = items.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct()
    pairs = candidate_pairs(rows, items, least, coverage)
    texts = pairs.join(rows, ["doc_id", "key"]).join(items.withColumnRenamed("text", "item"), "item_id")
    schema = "doc_id long, key long, item_id long, n_tokens long, n_covered long, n_tiles long"

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            offsets, h = tokens(batch.column("text"))
            n, covered, count = [], [], []
            for k, item in enumerate(batch.column("item").to_pylist()):
                want, text = _item_tokens(item), h[offsets[k] : offsets[k + 1]]
                shortest = min(least, len(want))
                got = tiles(want, _around(want, text, shortest), shortest)
                n.append(len(want))
                covered.append(sum(x[2] for x in got))
                count.append(len(got))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("item_id"), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(count, pa.int64())], ["doc_id", "key", "item_id", "n_tokens", "n_covered", "n_tiles"])

    found = texts.select("doc_id", "key", "item_id", "text", "item").mapInArrow(tile, schema)
    return found.withColumn("coverage", F.col("n_covered") / F.col("n_tokens")).filter(F.col("coverage") >= coverage)


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, n_tokens, n_covered, n_tiles, coverage`` of the pairs in which tiles cover enough of the item.

    Reordered passages are several tiles and count alike. Null texts have no tokens; items without tokens are
    never found, and those of fewer than ``least`` only as a whole; of rows that share a doc_id any may match; repeated items are one.
    """
    found = found_rows(docs, items, least, coverage)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_covered", "n_tokens", "n_tiles", "coverage")).alias("x"))
    return best.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "item_id", "x.n_tokens", "x.n_covered", "x.n_tiles", "x.coverage")


def _around(item: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """The tokens of ``text`` that a run of ``least`` tokens of the item covers; gaps become one token that matches none."""
    if len(text) < least:
        return text
    covered = np.zeros(len(text) + 1, np.int64)
    hit = np.flatnonzero(np.isin(window_hashes(text, least), window_hashes(item, least)))
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + least, -1)
    inside_runs = np.cumsum(covered)[:-1] > 0
    keep = inside_runs.copy()
    keep[1:] |= inside_runs[:-1]  # a token after each run stands for the gap
    out = np.where(inside_runs, text, np.uint64(0))
    return out[keep]


def remove_contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, in all their columns, in whose own text no item was found.

    Of rows that share a doc_id, null among them, each goes or stays by its text; repeated rows do so together; rows
    with a null text stay.
    """
    found = found_rows(docs, items, least, coverage).select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key")).distinct()
    doc_id, key = _row(docs)
    return docs.join(found, (doc_id == F.col("found_id")) & (key == F.col("found_key")) & docs["text"].isNotNull(), "left_anti")
