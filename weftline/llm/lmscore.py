"""Language-model scores of whole texts: a causal self-attention model over subword ids, and a unigram base.

p(id | all before) = p(class | all before) x p(id | class, id before). The attention model gives the first; the second
comes from counts of pairs with absolute discounting, what is discounted going to p(id | class). Classes are clusters of
ids by their neighbours, with a class for each of the most frequent ids. Words, ids and pairs are counted over all
training documents, classes come from all pairs, and gradient steps are taken on all of them: some in one task, then the
rest in as many tasks as they fill, whose weights are averaged. Windows of WINDOW ids overlap: each
id is scored once, by one of a window's last QUERIES places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm._blocks import block_count, in_blocks
from weftline.llm._store import keep, on_driver
from weftline.llm._words import hash_words, slices, word_hashes
from weftline.llm.tokens import default_tokenizer, encoder, with_end

WINDOW, QUERIES, DEPTH, HIDDEN, CLASSES, SINGLE = 32, 24, 16, 32, 64, 32
PAST = WINDOW - QUERIES
#: The training documents and the text that gradient steps start on, in one task; text of one task of the rest.
FIRST_DOCS, FIRST_BYTES, TASK_BYTES = 1500, 4 << 20, 4 << 20
LEAST_STEPS = 2000
#: What is taken from the count of each pair.
DISCOUNT = 0.75
#: Text in one block.
BLOCK_BYTES = 14 << 20
#: Of text looked at together, so that a task stays small beside the rest of an executor.
PART_BYTES = 1 << 20
_ROW = 16  # weights in one row of what tasks send to be averaged


def end_word() -> int:
    """The key of the end of a text among words; no word has a line break."""
    return int(_word_keys(hash_words(["\n"]))[0])


def _word_keys(h: np.ndarray) -> np.ndarray:
    """Keys of words are even, those of pairs odd."""
    return (h & ~np.uint64(1)).view(np.int64)


def _pair_keys(offsets: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(before, keys)`` of all ids; ``size`` stands before the first of a text and is that of the vocabulary with its end."""
    before = np.concatenate([[size], ids[:-1]]) if len(ids) else ids
    before[offsets[:-1]] = size
    return before, (before * (size + 1) + ids) * 2 + 1


@dataclass
class Attention:
    """One causal head, a hidden layer and a softmax over classes; ``inner`` has log p(id | class) of each id."""

    p: dict[str, np.ndarray]
    home: np.ndarray
    inner: np.ndarray

    @classmethod
    def fresh(cls, home: np.ndarray, inner: np.ndarray, seed: int = 1) -> Attention:
        rng, n = np.random.default_rng(seed), len(home)
        f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        d = DEPTH
        p = {"E": f(d, n + 2).T.copy(), "P": 0.1 * f(d, WINDOW).T.copy(), "Q": f(d, d), "K": f(d, d), "V": f(d, d), "O": f(d, d), "A": f(d, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "B": f(HIDDEN, d), "C": f(d, CLASSES), "c": np.zeros(CLASSES, np.float32)}
        return cls(p, home, inner)

    def windows(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(inputs, targets)``: ids of all windows (start id, then the text), -1 where there is no target."""
        start, none = len(self.home), len(self.home) + 1
        length = np.diff(offsets)
        n = -(-length // QUERIES)
        row = np.repeat(np.arange(len(length)), n)
        first = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * QUERIES  # the first query's place
        place = first[:, None] + np.arange(-PAST, QUERIES)
        at = offsets[row][:, None] + place
        ids = np.append(ids, 0)
        x = np.where(place == 0, start, ids[np.clip(at - 1, 0, len(ids) - 1)])
        x[(place < 0) | (place >= length[row][:, None])] = none
        q = place[:, PAST:]
        y = np.where(q < length[row][:, None], ids[np.clip(at[:, PAST:], 0, len(ids) - 1)], -1)
        return x, y

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        by = lambda a, w: (a.reshape(-1, w.shape[0]) @ w).reshape(*a.shape[:-1], -1)  # noqa: E731  one product
        e = p["E"][x] + p["P"]
        xq = np.ascontiguousarray(e[:, PAST:])
        k, v, q = by(e, p["K"]), by(e, p["V"]), by(xq, p["Q"] * _SCALE)
        s = q @ k.transpose(0, 2, 1)
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= _MASK
        s *= (x != len(self.home) + 1)[:, None]
        s /= s.sum(-1, keepdims=True) + np.float32(1e-9)
        a = s @ v
        y = xq + by(a, p["O"])
        h = by(y, p["A"]) + p["a"]
        np.maximum(h, 0, out=h)
        z = y + by(h, p["B"])
        logits = z.reshape(-1, DEPTH) @ p["C"] + p["c"]
        return e, xq, k, v, q, s, a, y, h, z, logits

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of all queries; as :meth:`forward` does, in fewer passes over the attention weights."""
        p = self.p
        e = p["E"][x] + p["P"]
        xq, flat = np.ascontiguousarray(e[:, PAST:]).reshape(-1, DEPTH), e.reshape(-1, DEPTH)
        s = (xq @ (p["Q"] * _SCALE)).reshape(-1, QUERIES, DEPTH) @ (flat @ p["K"]).reshape(e.shape).transpose(0, 2, 1)
        if s.max(initial=0) > 30:
            np.minimum(s, 30, out=s)
        np.exp(s, out=s)
        s *= _MASK
        first = np.flatnonzero(x[:, PAST - 1] == len(self.home) + 1)  # nothing before the first query
        s[first, :, :PAST] = 0
        a = s @ (flat @ p["V"]).reshape(e.shape)
        a /= s.sum(-1, keepdims=True)
        y = xq + a.reshape(-1, DEPTH) @ p["O"]
        h = y @ p["A"] + p["a"]
        np.maximum(h, 0, out=h)
        return (y + h @ p["B"]) @ p["C"] + p["c"]

    def log_p(self, offsets: np.ndarray, ids: np.ndarray, chunk: int = 24) -> np.ndarray:
        """Natural logarithm of the probability of each id's class; ``chunk`` windows at a time stay in the cache."""
        x, y = self.windows(offsets, ids)
        home, value = self.home[y], np.empty(y.shape, np.float32)
        base, ones = np.arange(chunk * QUERIES) * CLASSES, np.ones(CLASSES, np.float32)
        for i in range(0, len(x), chunk):
            logits = self.logits(x[i : i + chunk])
            if logits.max() > 60:
                np.minimum(logits, 60, out=logits)
            own = logits.ravel().take(base[: len(logits)] + home[i : i + chunk].ravel())
            np.exp(logits, out=logits)
            value[i : i + chunk] = (own - np.log(logits @ ones)).reshape(-1, QUERIES)
        return value[y >= 0].astype(float)

    def fit(self, offsets: np.ndarray, ids: np.ndarray, epochs: int = 3, batch: int = 64, rate: float = 5e-3, seed: int = 2) -> Attention:
        """Adam on the cross-entropy of classes; more ``epochs``, up to 30, where they make fewer than LEAST_STEPS steps."""
        rng = np.random.default_rng(seed)
        x, y = self.windows(offsets, ids)
        if epochs > 1:
            epochs = max(epochs, min(30, LEAST_STEPS // max(1, len(x) // batch)))
        m, v, t, p = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0, self.p
        steps = max(1, len(x) // batch) * epochs
        for _ in range(epochs):
            for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                g, seen, of_seen = self.backward(x[i], y[i])
                t += 1
                now = rate * min(1.0, t / 50) * (1 - 0.9 * t / steps)
                for k in p:
                    at, d = (seen, of_seen) if k == "E" else (slice(None), g[k])  # other rows of E keep their moments
                    m[k][at] += 0.1 * (d - m[k][at])
                    v[k][at] += 0.01 * (d**2 - v[k][at])
                    p[k][at] -= (now * (m[k][at] / (1 - 0.9**t)) / (np.sqrt(v[k][at] / (1 - 0.99**t)) + 1e-8)).astype(p[k].dtype)
        return self

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        g, seen, of_seen = self.backward(x, y)
        g["E"] = np.zeros_like(self.p["E"])
        g["E"][seen] = of_seen
        return g

    def backward(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """The gradients of all weights but E, the rows of E in ``x``, and their gradients."""
        p, flat = self.p, lambda w: w.reshape(-1, w.shape[-1])
        by = lambda a, w: (flat(a) @ w).reshape(*a.shape[:-1], -1)  # noqa: E731  one product
        e, xq, k, v, q, s, a, yy, h, z, logits = self.forward(x)
        target, real = y.ravel(), y.ravel() >= 0
        d = np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
        d /= (d @ np.ones(CLASSES, d.dtype))[:, None]
        d[np.arange(len(d)), self.home[target]] -= 1
        d *= real[:, None] / np.float32(max(real.sum(), 1))
        g = {"C": flat(z).T @ d, "c": d.sum(0)}
        dz = (d @ p["C"].T).reshape(z.shape)
        dh = by(dz, p["B"].T)
        dh *= h > 0
        g |= {"B": flat(h).T @ flat(dz), "A": flat(yy).T @ flat(dh), "a": flat(dh).sum(0)}
        dy = dz + by(dh, p["A"].T)
        g["O"] = flat(a).T @ flat(dy)
        da = by(dy, p["O"].T)
        dv, ds = s.transpose(0, 2, 1) @ da, da @ v.transpose(0, 2, 1)
        ds -= np.einsum("nqd,nqd->nq", da, a)[..., None]  # the sum of ds * s over keys
        ds *= s
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        g |= {"K": flat(e).T @ flat(dk), "V": flat(e).T @ flat(dv), "Q": flat(xq).T @ flat(dq) * _SCALE}
        de = by(dk, p["K"].T) + by(dv, p["V"].T)
        de[:, PAST:] += dy + by(dq, p["Q"].T * _SCALE)
        g["P"] = de.sum(0)
        order = np.argsort(x.ravel(), kind="stable")
        xs = x.ravel()[order]
        starts = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]]))
        return g, xs[starts], np.add.reduceat(flat(de)[order], starts)


#: Of the products of queries and keys; in 32 bits, or all that follows would be in 64.
_SCALE = np.float32(1 / np.sqrt(DEPTH))
#: A query sees keys up to its own place.
_MASK = (np.arange(WINDOW)[None] <= np.arange(QUERIES)[:, None] + PAST).astype(np.float32)


def cluster(near: pd.DataFrame, counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """The class of each id: frequent ids alone, the rest by k-means over their neighbours among frequent ids.

    ``near`` has ``id, side, code, n``: how often an id has the frequent id ``code`` (SINGLE: another one) on a side.
    """
    rng, n = np.random.default_rng(seed), len(counts)
    top = frequent(counts)
    table = np.zeros((n, 2 * SINGLE + 2))
    table[near["id"], near["side"] * (SINGLE + 1) + near["code"]] = near["n"]
    total = table.sum(1, keepdims=True)
    base = table.sum(0, keepdims=True) / max(table.sum(), 1)
    vector = np.log1p((table + 8 * base) / ((total + 8) * np.maximum(base, 1e-9))).astype(np.float32)
    k, mass = CLASSES - SINGLE, counts + 1.0
    rest = np.setdiff1d(np.arange(n), top)
    centre = vector[rng.choice(rest, k, replace=len(rest) < k, p=mass[rest] / mass[rest].sum())]
    for _ in range(12):
        best = ((centre**2).sum(1)[None] - 2 * vector[rest] @ centre.T).argmin(1)
        weight = np.bincount(best, mass[rest], k)
        for j in np.flatnonzero(weight):
            mine = rest[best == j]
            centre[j] = (vector[mine] * mass[mine, None]).sum(0) / weight[j]
    home = np.empty(n, np.int64)
    home[top], home[rest] = np.arange(len(top)), SINGLE + best
    return home


def frequent(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts, kind="stable")[:SINGLE]


def lowered(text) -> pa.Array:
    """A-Z to lower case; null is empty."""
    return pc.ascii_lower(pc.fill_null(text, ""))


def _ids(batch, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, ids)`` of the texts of a batch, each with its end."""
    enc = encoder(tokenizer)
    offsets, ids = enc.encode(lowered(batch.column("text")))
    return with_end(offsets, ids.astype(np.int64), enc.size)


def corpus_counts(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """``block, key, n, total, once`` of each word and pair of ids that a training text has.

    n counts it in the training texts of the block, total in all of them; ``once`` is true in one row of each key.
    Blocks in which no training text has the key have a row too.
    """

    def count(table: pa.Table) -> pa.Table:
        size, end, held = encoder(tokenizer).size + 1, end_word(), []
        for batch in slices(table.to_batches(), PART_BYTES):
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            offsets, h = word_hashes(lowered(batch.column("text")))
            at, ids = _ids(batch, tokenizer)
            for key, of in ((_word_keys(h), offsets), (_pair_keys(at, ids, size)[1], at)):
                codes, kinds = pd.factorize(key)
                held.append((kinds, np.bincount(codes, np.repeat(learn, np.diff(of)), len(kinds))))
            held.append((np.array([end]), np.array([float(learn.sum())])))
            if len(held) > 12:
                held = [_added(held)]
        key, n = _added(held)
        return pa.table({"block": pa.array(np.full(len(key), table.column("block")[0].as_py(), np.int32)), "key": key, "n": n.astype(np.int64)})

    found = blocks.groupBy("block").applyInArrow(count, "block int, key long, n long")
    every = Window.partitionBy("key")
    return found.select("block", "key", "n", F.sum("n").over(every).alias("total"), (F.min("block").over(every) == F.col("block")).alias("once")).filter("total > 0")


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, key = pd.factorize(np.concatenate([k for k, _ in held]))
    return key, np.bincount(codes, np.concatenate([n for _, n in held]))


@dataclass
class Model:
    """The attention model; how often, and before how many kinds of ids, an id before meets a class (by sorted ``pair``)."""

    attention: Attention
    pair: np.ndarray
    total: np.ndarray
    kinds: np.ndarray

    def log10_p(self, offsets: np.ndarray, ids: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each id, which came ``n`` times after the id ``before`` in training."""
        a = self.attention
        total, kinds = np.zeros(len(ids)), np.zeros(len(ids))
        codes, each = pd.factorize(before * CLASSES + a.home[ids])
        if len(self.pair) and len(ids):
            at = np.minimum(np.searchsorted(self.pair, each), len(self.pair) - 1)
            there = self.pair[at] == each
            total, kinds = np.where(there, self.total[at], 0)[codes], np.where(there, self.kinds[at], 0)[codes]
        alone = np.exp(a.inner[ids])
        p = np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * alone) / np.maximum(total, 1), alone)
        return (a.log_p(offsets, ids) + np.log(p)) / np.log(10)


def learn(docs: DataFrame, counts: DataFrame, tokenizer: str) -> Model:
    """The model of training ``docs`` (``doc_id, text``) and their stored ``counts``.

    What reaches the driver has a row for each id of the vocabulary and class, or for 2 x SINGLE neighbours of it, at most.
    """
    size = encoder(tokenizer).size + 1
    index = F.shiftright("key", 1)
    pairs = counts.filter(F.col("key") % 2 != 0).select(F.expr(f"shiftright(key, 1) div {size + 1}").cast("int").alias("before"), (index % (size + 1)).cast("int").alias("id"), "n", "once")
    n = np.zeros(size)
    got = on_driver(pairs.groupBy("id").agg(F.sum("n").alias("n")))
    n[got["id"]] = got["n"]
    codes = {int(x): i for i, x in enumerate(frequent(n))}
    code = lambda c: F.coalesce(F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])[F.col(c)], F.lit(SINGLE)).alias("code")
    after = pairs.filter(F.col("before") < size).select(F.col("before").alias("id"), F.lit(0).alias("side"), code("id"), "n")
    near = after.union(pairs.filter(F.col("before") < size).select("id", F.lit(1).alias("side"), code("before"), "n"))
    home = cluster(on_driver(near.groupBy("id", "side", "code").agg(F.sum("n").alias("n")).filter("n > 0")), n)
    mass = np.bincount(home, n + 0.5, CLASSES)
    fresh = Attention.fresh(home, np.log((n + 0.5) / mass[home]).astype(np.float32))
    homes = docs.sparkSession.createDataFrame(pd.DataFrame({"id": np.arange(size, dtype=np.int32), "class": home.astype(np.int32)}))
    met = pairs.join(F.broadcast(homes), "id").groupBy((F.col("before").cast("long") * CLASSES + F.col("class")).alias("pair"))
    met = on_driver(met.agg(F.sum("n").alias("n"), F.sum(F.col("once").cast("int")).alias("kinds"))).sort_values("pair")
    return Model(descend(docs, fresh, tokenizer), met["pair"].to_numpy(np.int64), met["n"].to_numpy(np.float32), met["kinds"].to_numpy(np.float32))


def _rows(p: dict[str, np.ndarray]) -> np.ndarray:
    """All weights in rows of _ROW values, those of ids first."""
    flat = np.concatenate([w.ravel() for w in p.values()])
    return np.pad(flat, (0, -len(flat) % _ROW)).reshape(-1, _ROW)


def _back(rows: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = rows.ravel(), {}, 0
    for k, w in like.items():
        out[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
        at += w.size
    return out


def descend(docs: DataFrame, model: Attention, tokenizer: str, first_docs: int = FIRST_DOCS, first_bytes: int = FIRST_BYTES, task_bytes: int = TASK_BYTES) -> Attention:
    """Gradient steps on the whole texts of all ``docs``, in the order of a hash.

    One task takes the first ones, some ``first_docs`` or ``first_bytes``; all others start from its weights, in tasks of
    about ``task_bytes``, and the mean of what they change is added, where each row of ids weighs as often as a task has
    met it.
    """
    spark = docs.sparkSession
    of = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    if not of.n:
        return model
    first = min(1.0, first_bytes / max(of.b or 0, 1), first_docs / of.n)
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("attention")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    n_tasks = max(1, round((1 - first) * (of.b or 0) / task_bytes))

    def steps(start: dict[str, np.ndarray], home: np.ndarray, inner: np.ndarray, rate: float, epochs: int):
        held = spark.sparkContext.broadcast((start, home, inner))  # the vocabulary x DEPTH weights, a fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, home, inner = held.value
            lengths, ids = [], []
            for batch in slices(batches):
                offsets, own = _ids(batch, tokenizer)
                lengths.append(np.diff(offsets))
                ids.append(own)
            if not ids:
                return
            offsets, ids = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.concatenate(ids)
            own = Attention({k: w.copy() for k, w in start.items()}, home, inner).fit(offsets, ids, epochs, rate=rate)
            change = _rows(own.p) - _rows(start)
            weight = np.full(len(change), float(len(ids)))
            weight[: len(start["E"])] = np.bincount(ids, minlength=len(start["E"]))
            at = np.flatnonzero((change != 0).any(1))
            weight = np.maximum(weight[at], 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight), *[pa.array((change[at, j] * weight).astype(np.float32)) for j in range(_ROW)]], names)

        names = ["at", "weight", *[f"v{j}" for j in range(_ROW)]]
        return run, "at long, weight double, " + ", ".join(f"v{j} float" for j in range(_ROW))

    def mean(rows: DataFrame, model: Attention, rate: float, epochs: int) -> Attention:
        run, schema = steps(model.p, model.home, model.inner, rate, epochs)
        got = rows.select("text").mapInArrow(run, schema).groupBy("at").agg(F.sum("weight").alias("weight"), *[F.sum(f"v{j}").alias(f"v{j}") for j in range(_ROW)])
        got = on_driver(got)
        now = _rows(model.p).astype(float)
        now[got["at"]] += got[[f"v{j}" for j in range(_ROW)]].to_numpy() / got[["weight"]].to_numpy()
        return replace(model, p=_back(now, model.p))

    rows = docs.select("text", u.alias("u"))
    model = mean(rows.filter(F.col("u") < first).repartition(1).sortWithinPartitions("u", "text"), model, 5e-3, 3)
    if first < 1:
        rest = rows.filter(F.col("u") >= first)
        model = mean(rest.repartition(n_tasks, "u").sortWithinPartitions("u", "text"), model, 2e-3, 1)
    return model


def score_documents(docs: DataFrame, is_training, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of all ``docs``, learnt where ``is_training``.

    A null text is empty and is scored by its end alone. Repeated rows are scored alike. Where no document is for
    training, the counts are zero and the model keeps its first weights.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(is_training, F.lit(False)).alias("learn"))
    n_blocks = block_count(rows, block_bytes)
    blocks = in_blocks(rows, n_blocks).repartition(n_blocks, "block")
    counts = keep(corpus_counts(blocks, tokenizer), "counts")
    of_words = counts.filter(F.col("key") % 2 == 0)
    size = of_words.agg(F.sum("n").alias("n"), F.sum(F.col("once").cast("int")).alias("v")).first()
    n_train, kinds, end = size.n or 0, size.v or 0, end_word()
    model = spark.sparkContext.broadcast(learn(rows.filter("learn").select("doc_id", "text"), counts, tokenizer))  # a fixed size

    def counted(want: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(key) or not len(want):
            return np.zeros(len(want), np.int64)
        codes, each = pd.factorize(want)
        at = np.minimum(np.searchsorted(key, each), len(key) - 1)
        return np.where(key[at] == each, n[at], 0)[codes]

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        m, vocabulary = model.value, encoder(tokenizer).size + 1
        key, n = known.column("key").to_numpy(), known.column("total").to_numpy()
        order = np.argsort(key)
        key, n, out = key[order], n[order], []
        ends = counted(np.array([end]), key, n)[0]
        for batch in slices(table.to_batches(), PART_BYTES):
            offsets, h = word_hashes(lowered(batch.column("text")))
            ends_at, c = with_end(offsets, counted(_word_keys(h), key, n), ends)
            log = np.log10((c + 0.5) / (n_train + 0.5 * (kinds + 1)))
            at, ids = _ids(batch, tokenizer)
            before, pairs = _pair_keys(at, ids, vocabulary)
            value = m.log10_p(at, ids, before, counted(pairs, key, n))
            out.append(pa.table({
                "doc_id": batch.column("doc_id"), "n_tokens": np.diff(ends_at), "n_known": np.add.reduceat((c > 0).astype(np.int64), ends_at[:-1]),
                "train_tokens": np.full(batch.num_rows, n_train), "base_score": np.add.reduceat(log, ends_at[:-1]), "score": np.add.reduceat(value, at[:-1]),
            }))
        return pa.concat_tables(out)

    known = counts.select("block", "key", "total")
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)
