"""Whole-text encoding with the tokenizers library, one distinct run of letters or signs at a time."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from weftline.llm._words import first_places, gather, span_hashes, text_bytes, word_spans


def default_tokenizer() -> str:
    """Path of the public 49k word BPE; every operator takes a path instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LETTER, _SIGN, _DIGIT = 1, 2, 3
#: The kind of each byte: 0 white space; all bytes of other than ASCII characters pass for letters until looked at.
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TextEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    For tokenizers that lower-case, drop white space and part letters from other signs and digits from each other: no
    id then spans two such runs. Each distinct run goes through the library once and stays in a cache of at most
    ``cache_runs`` runs, by a 64-bit hash (some 40 bytes each); words with elisions, special tokens or odd characters
    go through it whole.
    """

    def __init__(self, path: str, cache_runs: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])  # for runs in lower case already
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.tokenizer.get_vocab_size()
        self.cache_runs = cache_runs
        self.ending = np.zeros(self.size, bool)
        self.ending[[k for x, k in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat = np.empty(1 << 16, np.uint32)
        self.begin, self.count, self.odd = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.used = 0

    def _encode(self, tokenizer, runs: list[str], chunk: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, count)`` of runs that are one pre-token each, so that one ending id closes each; others go singly."""
        parts = [runs[at : at + chunk] for at in range(0, len(runs), chunk)]
        ids, counts = [], []
        for part, got in zip(parts, tokenizer.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            own = np.array(got.ids, np.uint32)
            count = np.diff(np.flatnonzero(self.ending[own]) + 1, prepend=0)
            if len(count) != len(part) or count.sum() != len(own):
                each = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in part]
                own, count = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
            ids.append(own)
            counts.append(count)
        return np.concatenate(ids or [np.empty(0, np.uint32)]), np.concatenate(counts or [np.empty(0, np.int64)])

    def _learn(self, hashes: np.ndarray, runs: list[bytes], whole: np.ndarray) -> None:
        """Add runs; ``whole`` ones are words that go through the library as they are."""
        text = [r.decode() for r in runs]
        low = [t.lower() for t in text]
        alone = [not w and (t.isascii() or t.isalpha() and "Σ" not in t and "İ" not in t) for t, w in zip(text, whole, strict=True)]
        latin = np.array([x and max(t) < "ɐ" for t, x in zip(text, alone, strict=True)], bool)  # lower case as Python has it
        fine = np.array(alone, bool) & ~latin
        odd = ~(latin | fine | whole)
        groups = [np.flatnonzero(x) for x in (latin, fine, whole, odd)]
        ids, counts = zip(self._encode(self.plain, [low[i] for i in groups[0]]), self._encode(self.tokenizer, [text[i] for i in groups[1]]), self._encode(self.tokenizer, [text[i] for i in groups[2]], 1), strict=True)
        ids, count = np.concatenate(ids), np.concatenate([*counts, np.zeros(len(groups[3]), np.int64)])
        order, n, m = np.concatenate(groups), len(self.known), len(runs)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + m > len(self.begin):
            self.begin, self.count, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.odd))
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[n : n + m] = count
        self.begin[n : n + m] = self.used + np.cumsum(count) - count
        self.odd[n : n + m] = odd[order]
        self.used += len(ids)
        new = hashes[order]
        by = np.argsort(new)
        at = np.searchsorted(self.known, new[by])
        self.known, self.number = np.insert(self.known, at, new[by]), np.insert(self.number, at, n + by)

    def _numbers(self, flat: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The number of each run in the cache, learning new ones."""
        h = span_hashes(low, start, end)
        h ^= whole.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        codes, kinds = pd.factorize(h)
        at = np.minimum(np.searchsorted(self.known, kinds), max(len(self.known) - 1, 0))
        new = self.known[at] != kinds if len(self.known) else np.ones(len(kinds), bool)
        if new.any():
            if len(self.known) and len(self.known) + int(new.sum()) > self.cache_runs:
                self._forget()
                new[:] = True
            place = first_places(codes, len(kinds))[new]
            self._learn(kinds[new], [flat[a:z].tobytes() for a, z in zip(start[place].tolist(), end[place].tolist(), strict=True)], whole[place])
            at = np.searchsorted(self.known, kinds)
        return self.number[at][codes] if len(kinds) else np.empty(0, np.int64)

    def encode(self, text) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of an Arrow array of texts; null has no ids."""
        flat, bounds = text_bytes(text)
        if not len(flat):
            return np.zeros(len(bounds), np.int64), np.empty(0, np.uint32)
        _, word, word_end = word_spans(flat, bounds)
        kind, low = _KIND[flat], _LOWER[flat]
        cut = kind == _DIGIT
        cut[1:] |= kind[1:] != kind[:-1]
        cut &= kind > 0
        cut[word] = True
        start = np.flatnonzero(cut)
        of = np.searchsorted(word, start, "right") - 1
        # an apostrophe before a letter may be an elision, and special tokens begin with <|
        mark = np.flatnonzero(((flat[:-1] == 39) & (kind[1:] == _LETTER)) | ((flat[:-1] == 60) & (flat[1:] == 124)))
        merged = np.zeros(len(word), bool)
        merged[np.searchsorted(word, mark, "right") - 1] = True

        def runs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = ~merged[of] | (start == word[of])
            a, w = start[own], of[own]
            z = word_end[w]
            same = w[1:] == w[:-1]
            z[:-1][same] = a[1:][same]
            return a, z, w

        a, z, w = runs()
        number = self._numbers(flat, low, a, z, merged[w])
        if self.odd[number].any():
            merged[w[self.odd[number]]] = True
            a, z, w = runs()
            number = self._numbers(flat, low, a, z, merged[w])
        ends, ids = gather(self.flat, self.begin[number], self.count[number])
        return ends[np.searchsorted(a, bounds)], ids


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process, kept between tasks."""
    return TextEncoder(path)


def with_end(offsets: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    return offsets + np.arange(len(offsets)), np.insert(ids, offsets[1:], end_id)


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
