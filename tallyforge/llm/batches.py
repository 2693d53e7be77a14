"""Whole-batch text work in numpy: words, k-grams and 64-bit hashes without a Python loop over characters."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text worked on at a time: small enough to stay in cache, the last document of a slice is never cut.
SLICE_BYTES = 1 << 18

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(of: str, n: int) -> np.ndarray:
    have = _powers.get(of)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        steps = np.full(size, _BASE if of == "base" else _INVERSE, U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if n <= 2 * SLICE_BYTES:
            _powers[of] = have
    return have[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one entry more than texts); a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return body, at - at[0]


@functools.cache
def _libc() -> ctypes.CDLL | None:
    lib = ctypes.CDLL(None)
    return lib if hasattr(lib, "malloc_trim") else None


def give_back() -> None:
    """What the allocators keep of freed memory goes back to the system: workers live from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last
    give_back()


class Words:
    """Words (runs of letters, digits and non-ASCII bytes) of a batch of texts, with prefix hashes of the bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = True):
        n = len(data)
        inside = WORD_BYTE[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = at[(at > 0) & (at < n)]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        self.data, self.at = data, at
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        #: the first word of each text, and the number of words as last entry
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        terms = (LOWER[data] if lower else data).astype(U64)
        terms += U64(1)
        terms *= _power("base", n)
        self._sum = np.zeros(n + 1, U64)
        np.cumsum(terms, out=self._sum[1:])

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes from start to end, the same wherever those bytes stand."""
        return mix((self._sum[end] - self._sum[start]) * _power("inverse", len(self.data) + 1)[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of k words; a text with fewer words gives one run of all it has."""
    h, n = words.hashes(), np.diff(words.first)
    total = np.zeros(len(h), U64)
    for j in range(k):
        step = mix(np.array([j + 1], U64))[0] | U64(1)
        total[: len(h) - j] += h[j:] * step
    place = np.arange(len(h)) - np.repeat(words.first[:-1], n)
    room = np.repeat(n, n) - place
    keep = room >= k
    doc, out = words.doc[keep], total[keep]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        whole = np.array([np.bitwise_xor.reduce(h[a : a + m] * mix(np.arange(1, m + 1, dtype=U64))) for a, m in zip(words.first[few], n[few])], U64)
        doc, out = np.concatenate([doc, few]), np.concatenate([out, whole])
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, mix(out)


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes."""
    return (h >> U64(11)).astype(np.float64) * 2.0**-53
