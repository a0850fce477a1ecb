"""Words ``[^\\x20\\x09-\\x0D]+`` of whole texts as spans of their bytes, as hashes and as integer codes."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial hash over word hashes.
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are looked at together: the arrays over a slice take up to a hundred times its size.
SLICE_BYTES = 2 << 20
#: Words from this length on are hashed one by one.
LONG_WORD = 1 << 9
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: By number of bytes 0 to 8: which bits of eight bytes count.
_BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def slices(batches, most_bytes: int = SLICE_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each have about ``most_bytes``; a longer text stands alone.

    What is free at the end goes back to the system, as idle workers stay beside the executor's heap.
    """
    try:
        yield from _cut(batches, most_bytes, text)
    finally:
        pa.default_memory_pool().release_unused()
        give_back()


@lru_cache(maxsize=1)
def _libc():
    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def give_back() -> None:
    """Return the allocator's free pages to the system, where the C library can."""
    if _libc():
        _libc().malloc_trim(0)


def _cut(batches, most_bytes: int, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def text_bytes(text) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, bounds)``: text i of an Arrow array is ``bytes[bounds[i]:bounds[i + 1]]``; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks() if text.num_chunks else pa.array([], pa.string())
    if text.null_count:
        text = pc.fill_null(text, "")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    if not len(text):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return flat, bounds - bounds[0]


def word_spans(flat: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(offsets, start, end)``: text i has the words offsets[i] to offsets[i + 1], each from start to end; ``space`` says
    which of the 256 bytes part them."""
    solid = ~space[flat]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(flat))]  # words end where texts meet
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(first)
    return np.searchsorted(start, bounds), start, np.flatnonzero(last) + 1


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A stable 64-bit hash of the bytes of each span, eight at a time."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(flat) + 1, "<u8", padded, strides=(1,))
    n = end - start
    with np.errstate(over="ignore"):
        h = mix((n.astype(np.uint64) * MULT ^ (eight[start] & _BITS[np.minimum(n, 8)])) * MULT)
        todo, done = np.flatnonzero((n > 8) & (n < LONG_WORD)), 8
        while len(todo):
            part = eight[start[todo] + done] & _BITS[np.minimum(n[todo] - done, 8)]
            h[todo] = mix((h[todo] ^ part) * MULT)
            done += 8
            todo = todo[n[todo] > done]
    for i in np.flatnonzero(n >= LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(flat[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(text) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, hashes)`` of the words of each text."""
    flat, bounds = text_bytes(text)
    offsets, start, end = word_spans(flat, bounds)
    return offsets, span_hashes(flat, start, end)


def take_spans(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings."""
    ends, values = gather(flat, start, end - start)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)).cast(pa.string())


def gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ends, values)`` of the runs ``flat[begin : begin + count]`` one after another."""
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(begin - ends[:-1], count)
    at += np.arange(ends[-1])
    return ends, flat[at]


def first_places(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the codes 0 to n - 1 occurs first."""
    out = np.empty(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out


def split_words(text) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(offsets, codes, words)``: text i has the words ``words[codes[offsets[i]:offsets[i + 1]]]``; null has none."""
    flat, bounds = text_bytes(text)
    offsets, start, end = word_spans(flat, bounds)
    codes, kinds = pd.factorize(span_hashes(flat, start, end))
    at = first_places(codes, len(kinds))
    return offsets, codes, take_spans(flat, start[at], end[at])


def hash_words(words: pa.Array | list[str]) -> np.ndarray:
    """The hash of each word, as :func:`word_hashes` has it."""
    flat, bounds = text_bytes(words if isinstance(words, pa.Array | pa.ChunkedArray) else pa.array(words, pa.string()))
    return span_hashes(flat, bounds[:-1], bounds[1:])


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (multiply and shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all ``width`` consecutive values; windows may cross texts, see :func:`inside`."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        # hashes of doubling widths, joined by the bits of width
        have, cur, cur_width, out, out_width = values, values, 1, None, 0
        power = MULT
        while True:
            if width & cur_width:
                if out is None:
                    out, out_width = cur, cur_width
                else:
                    shift = np.uint64(pow(int(MULT), cur_width, 1 << 64))
                    m = len(have) - out_width - cur_width + 1
                    out, out_width = out[:m] * shift + cur[out_width : out_width + m], out_width + cur_width
            if cur_width * 2 > width:
                break
            m = len(cur) - cur_width
            cur = cur[:m] * power + cur[cur_width : cur_width + m]
            cur_width, power = cur_width * 2, power * power
        return mix(out[:n])


def inside(offsets: np.ndarray, width: int) -> np.ndarray:
    """Which windows of ``width`` words lie within one text, by start."""
    n = int(offsets[-1]) - width + 1
    ok = np.ones(max(n, 0), bool)
    for back in range(1, width):
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
