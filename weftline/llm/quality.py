"""Quality rules: word and line counts, and perplexity bands of an n-gram model with modified Kneser-Ney smoothing.

The model is over characters (as written, white space as one space), four at a time: four of 16 bits pack into 64, the
distinct ones stay few at any corpus size, and whole-corpus counts need one small shuffle. A word model's distinct n-grams
are more than half of all words and would move more bytes than the corpus has. Case is kept, because what comes after a
full stop and what doesn't is most of what four characters see of the order of words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._store import filesystem, fresh_path, keep
from weftline.llm._words import MULT, hash_words, inside, mix, owner, slices, split_words, window_hashes

ORDER = 4
#: Model entries are told apart by so many bits of their hashes; all of them are kept, in 12 bytes each.
KEY_BITS = 62
#: The model is kept in this many files, as a power of two.
RANGE_BITS = 5
_RANGE_SHIFT = KEY_BITS - RANGE_BITS
PAD, END = "\x02", "\x03"
UNKNOWN_LANG = "und"
#: Languages up to which their bands are sent to all tasks.
MOST_LANGS = 10_000
#: A document is rejected if its log perplexity is this many quartile ranges outside of its language's quartiles.
BAND_WIDTH = 2.0
#: Least quartile range taken (in log10), for languages in which most documents are alike.
LEAST_RANGE = 0.02
BASE_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def base_counts(text) -> pd.DataFrame:
    """The base figures of each text of an Arrow array; null has no words."""
    offsets, codes, words = split_words(text)
    n = np.diff(offsets)
    each = lambda per_word: np.add.reduceat(np.append(per_word[codes], 0), offsets[:-1]) * (n > 0) if len(codes) else np.zeros(len(n), np.int64)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(words, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    lines = np.array([_repeated_lines(t) if t else 0 for t in text.to_pylist()], np.int64)
    covered = np.zeros(len(codes), bool)
    if len(codes) >= 3:
        with np.errstate(over="ignore"):
            key = window_hashes(hash_words(words)[codes], 3) + owner(offsets)[: len(codes) - 2].astype(np.uint64) * MULT
        twice = np.zeros(len(key), bool)
        within = inside(offsets, 3)
        twice[within] = pd.Series(key[within]).duplicated(keep=False).to_numpy()
        for k in range(3):
            covered[k : k + len(key)] |= twice
    repeats = np.add.reduceat(np.append(covered, False).astype(np.int64), offsets[:-1]) * (n > 0) if len(codes) else np.zeros(len(n), np.int64)
    return pd.DataFrame({"n_words": n, "word_chars": each(chars), "n_symbols": each(symbols), "n_dup_lines": lines, "n_repeat_words": repeats, "base_failed": (n < 50) | (100 * repeats > 50 * n)})


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def char_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, n)``: the packed grams of all texts in turn and how many each has (its characters and the end)."""
    clean = [" ".join((t or "").replace(PAD, " ").replace(END, " ").split()) for t in texts]
    points = np.frombuffer("".join(PAD * (ORDER - 1) + t + END for t in clean).encode("utf-32-le"), "<u4")
    points = np.where(points > 0xFFFF, 0xE000 + points % 0x1900, points)  # rarer planes share the private characters
    grams = np.zeros(max(len(points) - ORDER + 1, 0), np.uint64)
    for k in range(ORDER):
        grams |= points[k : k + len(grams)].astype(np.uint64) << np.uint64(16 * (ORDER - 1 - k))
    return grams[points[ORDER - 1 :] != ord(PAD)], np.array([len(t) + 1 for t in clean], np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over the distinct texts of each language; each task adds up what it has read before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, grams = pd.factorize(np.concatenate([g for g, _ in parts]))
            return grams, np.bincount(codes, np.concatenate([c for _, c in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = merged(parts)
                for a in range(0, len(grams), 200_000):
                    g = grams[a : a + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n[a : a + 200_000])], ["lang", "gram", "n"])
            held.clear()

        for batch in slices(batches):
            langs = pc.fill_null(batch.column("lang"), UNKNOWN_LANG)
            for lang in langs.unique().to_pylist():
                grams, _ = char_grams(batch.column("text").filter(pc.equal(langs, lang)).to_pylist())
                codes, found = pd.factorize(grams)
                parts = held.setdefault(lang, [])
                parts.append((found, np.bincount(codes, minlength=len(found))))
                if len(parts) >= 8:
                    held[lang] = [merged(parts)]
            size = sum(len(g) for parts in held.values() for g, _ in parts)
            if size > 4_000_000:
                yield from out()
        yield from out()

    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), "text").distinct()
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _slots(lang: pd.Series, kind: pd.Series, gram: pd.Series) -> np.ndarray:
    """The key of a model entry, by which it is found; kind is the order of a probability, or 16 plus that of a context."""
    at, names = pd.factorize(lang)
    with np.errstate(over="ignore"):
        seed = hash_words(list(names))[at] + kind.to_numpy(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (mix(mix(gram.to_numpy(np.int64).view(np.uint64) * MULT + seed)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _lower(grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, n)``: the last k characters of distinct grams, and how many different characters come before them."""
    return np.unique(grams & np.uint64((1 << 16 * k) - 1), return_counts=True)


def _before_last(grams: DataFrame) -> DataFrame:
    """The group of each gram: the character before its last one, to which all contexts of all orders belong."""
    return grams.withColumn("pivot", F.shiftright("gram", 16).bitwiseAND(F.lit(0xFFFF)))


def gram_statistics(grams: DataFrame) -> DataFrame:
    """``lang, kind, key, n``: of each order (kind 2 to 4) how many grams have the count key (1 to 4), and for kind 1
    before how many different characters each character's code (key) comes."""

    def collect(rows: pd.DataFrame) -> pd.DataFrame:
        out, kinds, n = [], rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy()
        for k in range(ORDER, 1, -1):
            if k < ORDER:
                kinds, n = _lower(kinds, k)
            out += [(k, i, int((n == i).sum())) for i in (1, 2, 3, 4)]
        out += [(1, int(c), int(m)) for c, m in zip(*_lower(kinds, 1), strict=True)]
        return pd.DataFrame(out, columns=["kind", "key", "n"]).assign(lang=rows["lang"].iloc[0])

    found = _before_last(grams).groupBy("lang", "pivot").applyInPandas(collect, "kind int, key int, n long, lang string")
    return found.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def _discounts(n: dict[int, int]) -> np.ndarray:
    """By count 0 to 3 (and more), from how many grams have the counts 1 to 4; a half where those are missing."""
    y = n[1] / (n[1] + 2 * n[2]) if n.get(1) and n.get(2) else 0.5
    raw = [i - (i + 1) * y * n[i + 1] / n[i] if n.get(i) and n.get(i + 1) else 0.5 for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))])


def _spread(context: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(contexts, total, weight, place)``: what discounting leaves over in each context, and the context of each gram."""
    kinds, place = np.unique(context, return_inverse=True)
    total = np.bincount(place, n)
    return kinds, total, np.bincount(place, d[np.minimum(n, 3)]) / total, place


def kneser_ney(grams: DataFrame) -> Model:
    """The interpolated model of ``lang, gram, n``: log10 probabilities of all orders and log10 weights of contexts.

    The highest order takes counts, each lower one the number of different characters before the gram. The model has an
    entry for each gram and each context of every order.
    """
    stats: dict[str, dict[int, dict[int, int]]] = {}
    for r in gram_statistics(grams).collect():  # for each language a row for each character of 16 bits at most
        stats.setdefault(r.lang, {}).setdefault(r.kind, {})[r.key] = r.n
    discounts, single, entries = {}, {}, []
    for lang, found in stats.items():
        discounts[lang] = {k: _discounts(found[k]) for k in range(2, ORDER + 1)}
        chars, n = np.array(list(found[1]), np.uint64), np.array(list(found[1].values()))
        d = _discounts({i: int((n == i).sum()) for i in (1, 2, 3, 4)})
        left = d[np.minimum(n, 3)].sum() / n.sum() / (len(n) + 1)
        p = (n - d[np.minimum(n, 3)]) / n.sum() + left
        single[lang] = dict(zip(chars.tolist(), p.tolist(), strict=True))
        unseen = np.append(chars, np.uint64(0xFFFFFFFFFFFFFFFF))
        entries.append((_slots(pd.Series([lang] * len(unseen)), pd.Series(np.ones(len(unseen), np.int64)), pd.Series(unseen.view(np.int64))), np.log10(np.append(p, left))))
    held = grams.sparkSession.sparkContext.broadcast((discounts, single))

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        lang, (discount, alone) = rows["lang"].iloc[0], held.value
        levels = {ORDER: (rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))}
        for k in range(ORDER - 1, 1, -1):
            levels[k] = _lower(levels[k + 1][0], k)
        out, tails = [], np.array(sorted(alone[lang]), np.uint64)
        below = np.array([alone[lang][int(c)] for c in tails])
        for k in range(2, ORDER + 1):
            kinds, n = levels[k]
            d = discount[lang][k]
            contexts, total, weight, place = _spread(kinds >> np.uint64(16), n, d)
            q = below[np.searchsorted(tails, kinds & np.uint64((1 << 16 * (k - 1)) - 1))]
            p = (n - d[np.minimum(n, 3)]) / total[place] + weight[place] * q
            for kind, key, v in ((k, kinds, p), (16 + k, contexts, weight)):
                at = _slots(pd.Series([lang] * len(key)), pd.Series(np.full(len(key), kind)), pd.Series(key.view(np.int64)))
                out.append(pd.DataFrame({"slot": at, "value": np.log10(v).astype(np.float32)}))
            order = np.argsort(kinds)
            tails, below = kinds[order], p[order]
        return pd.concat(out)

    slots = _before_last(grams).groupBy("lang", "pivot").applyInPandas(smooth, "slot long, value float")
    low = pd.DataFrame({"slot": np.concatenate([s for s, _ in entries] or [[]]), "value": np.concatenate([v for _, v in entries] or [[]])}).astype({"slot": "int64", "value": "float32"})
    first = grams.sparkSession.createDataFrame(low, "slot long, value float")
    return stored(slots.unionByName(first))


def stored(entries: DataFrame) -> Model:
    """Entries sorted and written to the shared folder, a file for each range of slots; the driver gets their lengths."""
    folder = fresh_path(entries.sparkSession, "model")

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        number, (fs, at) = table.column("range")[0].as_py(), filesystem(folder)
        fs.create_dir(at, recursive=True)
        unfinished = f"{at}/{uuid.uuid4().hex}"
        with fs.open_output_stream(unfinished) as f:
            f.write(table.column("slot").to_numpy().astype("<i8").tobytes())
            f.write(table.column("value").to_numpy().astype("<f4").tobytes())
        fs.move(unfinished, f"{at}/{number}")  # a task that runs again writes the same
        return pa.table({"range": pa.array([number], pa.int32()), "n": pa.array([table.num_rows], pa.int64())})

    ranged = entries.withColumn("range", F.shiftright("slot", _RANGE_SHIFT).cast("int"))
    found = ranged.groupBy("range").applyInArrow(write, "range int, n long").collect()  # 2 ** RANGE_BITS rows at most
    return Model(folder, {r.range: r.n for r in found})


@lru_cache(maxsize=1)
def _arrays(folder: str, sizes: tuple) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``range, slots, values`` of a stored model: mapped where the folder is mounted, so that workers share the pages."""
    fs, at = filesystem(folder)
    out = []
    for number, n in sizes:
        raw = np.memmap(f"{at}/{number}", np.uint8, "r") if isinstance(fs, pa.fs.LocalFileSystem) else np.frombuffer(fs.open_input_stream(f"{at}/{number}").readall(), np.uint8)
        out.append((number, raw[: 8 * n].view("<i8"), raw[8 * n :].view("<f4")))
    return out


class Model:
    """A folder of sorted slots with their values, looked up by binary search."""

    def __init__(self, folder: str, sizes: dict[int, int]):
        self.folder, self.sizes = folder, tuple(sorted(sizes.items()))

    def find(self, lang: str, kind: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = _slots(pd.Series([lang]).repeat(len(grams)), pd.Series(np.full(len(grams), kind)), pd.Series(grams.view(np.int64)))
        order = np.argsort(want)
        want, found, value = want[order], np.zeros(len(want), bool), np.zeros(len(want))
        for number, slots, values in _arrays(self.folder, self.sizes):
            a, b = np.searchsorted(want, [number << _RANGE_SHIFT, (number + 1) << _RANGE_SHIFT])
            at = np.minimum(np.searchsorted(slots, want[a:b]), len(slots) - 1)
            found[order[a:b]], value[order[a:b]] = slots[at] == want[a:b], values[at]
        return found, value

    def logs(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """log10 of each packed gram's last character after those before it."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            g = grams[todo] & np.uint64((1 << 16 * k) - 1)
            found, value = self.find(lang, k, g)
            out[todo[found]] += value[found]
            todo, g = todo[~found], g[~found]
            if not len(todo):
                return out
            if k > 1:
                known, weight = self.find(lang, 16 + k, g >> np.uint64(16))
                out[todo] += np.where(known, weight, 0.0)
        found, value = self.find(lang, 1, np.full(len(todo), np.uint64(0xFFFFFFFFFFFFFFFF)))
        out[todo] += np.where(found, value, -6.0)
        return out

    def log_perplexity(self, texts: list[str | None], lang: str) -> np.ndarray:
        """log10 perplexity of a character of each text."""
        grams, n = char_grams(texts)
        codes, found = pd.factorize(grams)
        value = self.logs(lang, np.asarray(found, np.uint64))[codes]
        return -np.add.reduceat(value, np.cumsum(n) - n) / n


def train(docs: DataFrame) -> Model:
    """The model of the distinct texts of ``docs`` by language, in the shared folder; none of it passes the driver."""
    return kneser_ney(keep(count_grams(docs), "grams"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns, the base figures and ``log_ppl``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in (*[x.split()[0] for x in BASE_FIELDS.split(", ")], "log_ppl")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            figures, text = base_counts(batch.column("text")), batch.column("text")
            langs = pc.fill_null(batch.column("lang"), UNKNOWN_LANG)
            log_ppl = np.zeros(batch.num_rows)
            for lang in langs.unique().to_pylist():
                mask = pc.equal(langs, lang)
                log_ppl[mask.to_numpy(zero_copy_only=False)] = held.value.log_perplexity(text.filter(mask).to_pylist(), lang)
            for name in figures.columns:
                batch = batch.append_column(name, pa.array(figures[name].to_numpy()))
            yield batch.append_column("log_ppl", pa.array(log_ppl))

    return docs.select(*columns).mapInArrow(run, f"{fields}, {BASE_FIELDS}, log_ppl double")


def _text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.hash("text", F.lit(1)).alias("h2")]


def bands(scored: DataFrame, width: float = BAND_WIDTH) -> DataFrame:
    """``band, low, high`` by language of the log perplexity of texts that pass the base rules.

    Copies, told by ``h1, h2`` (see :func:`_text_hashes`), count once.
    """
    sound = scored.filter(~F.col("base_failed"))
    texts = sound.groupBy(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("band"), "h1", "h2").agg(F.round(F.min("log_ppl"), 3).alias("log_ppl"))
    steps = texts.groupBy("band", "log_ppl").agg(F.count(F.lit(1)).alias("n"))  # few values, so that quartiles are exact
    found = steps.groupBy("band").agg(F.percentile("log_ppl", [0.25, 0.75], F.col("n")).alias("q"))
    reach = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_RANGE)) * width
    return found.select("band", (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high"))


def judge(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``low``, ``high`` and ``kept``; a language without a band (no sound document) keeps nothing."""
    limits = F.broadcast(limits) if limits.count() <= MOST_LANGS else limits
    at = scored.withColumn("band", F.coalesce("lang", F.lit(UNKNOWN_LANG))).join(limits, "band", "left").drop("band")
    return at.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False)))


def quality_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base figures, ``log_ppl``, its language's band and ``kept`` of every document.

    Null and empty texts have no words and fail; a null language is ``und``; repeated rows are judged alike.
    """
    thin = docs.select("doc_id", "text", "lang", *_text_hashes())
    scored = keep(score(thin, train(thin)).drop("text"), "scored")
    return judge(scored.drop("h1", "h2"), keep(bands(scored), "bands"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, in all their columns, that the rules keep."""
    thin = docs.select("text", "lang", *_text_hashes())
    model = train(thin)
    limits = keep(bands(score(thin, model)), "bands")
    packed = docs.select("text", "lang", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return judge(score(packed, model), limits).filter("kept").select("row.*")
