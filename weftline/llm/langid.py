"""Language identification with a byte convolutional network, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._store import keep
from weftline.llm._words import slices

UNDETERMINED = "und"
#: Bytes of one window; a text is a row of windows, the last one filled up with zero bytes.
WINDOW = 256
#: Filters of each width, and values of a byte.
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 16, 8
#: Labelled documents that training takes of each language at about most, and windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 1500, 3
#: Documents that the driver trains on at most, whatever the number of languages.
MOST_TRAIN = 60_000
_LETTER = regex.compile(r"\p{L}")
#: Languages up to which their counts are sent to all tasks.
MOST_LANGS = 10_000


@dataclass
class ByteNet:
    """Byte values, one filter bank over the widest context (shorter filters end in zeros), bias, output layer."""

    langs: list[str]
    embed: np.ndarray
    bank: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        k, n = max(WIDTHS), FILTERS * len(WIDTHS)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        net = cls(langs, f(256, DEPTH, scale=0.5), f(k * DEPTH, n, scale=0.25), np.zeros(n, np.float32), f(n, len(langs), scale=0.1), np.zeros(len(langs), np.float32))
        net.bank *= net.mask()
        net.embed[0] = 0
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """Which weights a filter has: those within its width."""
        k = max(WIDTHS)
        return np.concatenate([np.repeat(np.arange(k) < w, DEPTH)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)

    def contexts(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, widest context x depth)."""
        k, x = max(WIDTHS), self.embed[np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))]
        flat = np.ascontiguousarray(x).reshape(len(windows), -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, k * DEPTH, axis=1)[:, ::DEPTH]
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = self.contexts(windows)
        a = (c.reshape(-1, c.shape[2]) @ self.bank).reshape(len(windows), -1, self.bank.shape[1])
        at = a.argmax(1)
        return np.take_along_axis(a, at[:, None], 1)[:, 0] + self.bias, at, c

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Of each window; a few hundred at a time so that the contexts stay small."""
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for i in range(0, len(windows), 256):
            c = self.contexts(windows[i : i + 256])
            a = (c.reshape(-1, c.shape[2]) @ self.bank).reshape(c.shape[0], -1, self.bank.shape[1]).max(1)
            out[i : i + 256] = np.maximum(a + self.bias, 0) @ self.out + self.out_bias
        return out

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 4e-3, seed: int = 11) -> ByteNet:
        """Adam on cross-entropy, each language with the same weight."""
        rng, names = np.random.default_rng(seed), ("embed", "bank", "bias", "out", "out_bias")
        m, v, step, mask = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0, self.mask()
        weight = (len(labels) / np.maximum(np.bincount(labels, minlength=len(self.langs)), 1) / len(self.langs)).astype(np.float32)
        k = max(WIDTHS)
        for _ in range(epochs):
            for i in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
                x, y = windows[i], labels[i]
                pre, at, c = self.pooled(x)
                h = np.maximum(pre, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p *= (weight[y] / len(y))[:, None]
                back = (p @ self.out.T) * (pre > 0)
                chosen = c[np.arange(len(y))[:, None], at]  # (batch, filters, context)
                g = {"out": h.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "bank": np.einsum("bf,bfk->kf", back, chosen) * mask}
                spread = (back[:, :, None] * self.bank.T[None]).reshape(len(y), -1, k, DEPTH)
                seen = np.pad(x, ((0, 0), (0, k - 1)))[np.arange(len(y))[:, None, None], at[:, :, None] + np.arange(k)]
                g["embed"] = np.zeros_like(self.embed)
                np.add.at(g["embed"], seen.ravel(), spread.reshape(-1, DEPTH))
                g["embed"][0] = 0
                step += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                    setattr(self, n, (getattr(self, n) - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        return self


def byte_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(windows, n)``: all texts cut into windows in turn, and how many each has (one at least)."""
    n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    for t, a in zip(texts, (np.cumsum(n) - n) * WINDOW, strict=True):
        out[a : a + len(t)] = np.frombuffer(t, np.uint8)
    return out.reshape(-1, WINDOW), n


def training_sample(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """``(text part, lang)`` from about ``docs_per_lang`` documents of each language, drawn by a hash of id and text; of
    MOST_TRAIN documents at most."""
    counts = keep(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    counts = F.broadcast(counts) if counts.count() <= MOST_LANGS else counts
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = (F.pmod(F.xxhash64("doc_id", "text", F.lit("place")), F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.greatest(F.length("text") - WINDOW * TRAIN_WINDOWS, F.lit(0))).cast("int")
    parts = labelled.select("lang", u.alias("u"), F.col("text").substr(at + 1, F.lit(WINDOW * TRAIN_WINDOWS)).alias("part"))
    rows = parts.join(counts, "lang").filter(F.col("u") * F.col("n") < docs_per_lang).orderBy("u", "part").limit(MOST_TRAIN).select("part", "lang").collect()
    return sorted((r.part, r.lang) for r in rows)


def train(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS) -> ByteNet | None:
    """Fit on ``doc_id, text, lang``; None where no document has a language and a letter."""
    rows = [(t, x) for t, x in training_sample(labelled.filter("lang is not null and text is not null"), docs_per_lang) if _LETTER.search(t)]
    if not rows:
        return None
    langs = sorted({x for _, x in rows})
    rng, parts, labels = np.random.default_rng(3), [], []
    for text, lang in rows:
        raw = text.encode()
        for k in range(0, max(1, len(raw) - WINDOW // 2), WINDOW):
            piece = raw[k : k + WINDOW]
            if rng.random() < 0.3:  # short texts occur too
                piece = piece[: rng.integers(16, WINDOW)]
            parts.append(piece)
            labels.append(langs.index(lang))
    return ByteNet.fresh(langs).fit(byte_windows(parts)[0], np.array(labels))


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``doc_id, lang_pred, score``: the mean log probability over all windows of the whole text decides.

    ``score`` is the share of the language in the softmax of that mean. Null texts and texts without a letter are
    ``und`` with the score 0, as are all texts where there was nothing to learn from.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size: 256 x 8 byte values, 48 filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            named = np.array([bool(model and t and _LETTER.search(t)) for t in texts], bool)
            best, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if named.any():
                windows, n = byte_windows([t.encode() for t, ok in zip(texts, named, strict=True) if ok])
                z = model.logits(windows).astype(float)
                z -= np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) + z.max(1, keepdims=True)
                mean = np.add.reduceat(z, np.cumsum(n) - n) / n[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                best[named] = np.array(model.langs, object)[p.argmax(1)]
                score[named] = p.max(1) / p.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame, modulus: int = 4, remainder: int = 2):
    """Whether crc32 of doc_id as text leaves ``remainder``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from documents that aren't held out, predict all: ``doc_id, held_out, lang_pred, score``."""
    net = train(docs.filter(~held_out(docs)).select("doc_id", "text", "lang"))
    found = predict(docs, net)
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score")
