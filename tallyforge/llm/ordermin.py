"""Order MinHash fingerprints, sensitive to edit distance.

The k-mers of a text (k bytes of its UTF-8 form, ASCII letters in lower case) are
numbered by occurrence.  For each of M hash functions the L pairs (k-mer,
occurrence) with the smallest hashes are selected and put back in text order; the
hash of that tuple of k-mers is one entry of the fingerprint.  Entries of two
texts agree when they share k-mers in the same order, which moved blocks break and
plain MinHash would not see.

Defined results
* null text: null fingerprint; empty text: an empty fingerprint
* a text shorter than k bytes: one k-mer, the whole text; fewer than L k-mers: all of them, in order
* equal hashes: the earlier place in the text; occurrences are counted by all 64 bits of a k-mer's hash, in texts of any length
* repeated rows get equal fingerprints; an empty table gives an empty result
* very long texts are fingerprinted whole; columns that clash with ``fingerprint`` push it to ``fingerprint_``
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import LOWER, U64, _power, mix, slices, utf8
from .shared import arrow_map, free_name

K, L, M = 8, 3, 32
SEED = 48_611


def kmer_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k bytes; of the whole text if it is shorter."""
    n = len(text)
    terms = LOWER[text].astype(U64)
    terms += U64(1)
    terms *= _power("base", n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(terms, out=sums[1:])
    if n <= k:
        return mix(sums[n:])
    return mix((sums[k:] - sums[:-k]) * _power("inverse", n + 1)[: n - k + 1])


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each k-mer stood before in the text."""
    n = len(h)
    bits = U64(max(1, n.bit_length()))
    low = (U64(1) << bits) - U64(1)
    # The upper bits of the hash and, below them, the position: one sort of plain numbers.
    at = (np.sort((h & ~low) | np.arange(n, dtype=U64)) & low).astype(np.int64)
    name = h[at]
    new = np.ones(n, bool)
    new[1:] = name[1:] != name[:-1]
    # k-mers that differ in the lower bits alone may lie mixed; whole hashes are sorted then.
    if (new[1:] & (name[1:] >> bits == name[:-1] >> bits)).any():
        at = np.argsort(h, kind="stable")
        name = h[at]
        new[1:] = name[1:] != name[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    out = np.empty(n, np.int64)
    out[at] = np.arange(n) - begin
    return out


def fingerprint(text: np.ndarray, k: int = K, l: int = L, m: int = M, seed: int = SEED) -> np.ndarray:  # noqa: E741
    """m 64-bit entries for the bytes of a text that isn't empty."""
    h = kmer_hashes(text, k)
    n = len(h)
    pairs = mix(h + occurrences(h).astype(U64) * U64(0x9FB21C651E98DF25))
    keys = mix(np.arange(2 * m, dtype=U64) + U64(seed))
    least = np.empty((m, min(l, n)), np.int64)
    v = np.empty(n, U64)
    for j in range(m):
        np.bitwise_xor(pairs, keys[2 * j], out=v)
        np.multiply(v, keys[2 * j + 1] | U64(1), out=v)
        for i in range(least.shape[1]):
            at = int(v.argmin())
            least[j, i] = at
            v[at] = U64(0xFFFFFFFFFFFFFFFF)
    least.sort(axis=1)
    out = mix(np.arange(m, dtype=U64))
    for i in range(least.shape[1]):
        out = mix(out + h[least[:, i]])
    return out.view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, k: int = K, l: int = L, m: int = M, seed: int = SEED) -> DataFrame:  # noqa: E741
    """``columns`` of ``df`` (the id by default) with ``fingerprint``, an array of m 64-bit numbers."""
    kept = [id_col] if columns is None else columns
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(free_name(kept, "fingerprint"), T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_"):
                texts = part.column(len(kept))
                data, at = utf8(texts)
                some = np.diff(at) > 0
                rows = [fingerprint(data[at[i] : at[i + 1]], k, l, m, seed) for i in np.flatnonzero(some)]
                ends = np.concatenate([[0], np.cumsum(np.where(some, m, 0))]).astype(np.int32)
                values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=texts.is_null())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), lists], names=schema.names)

    source = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{text_col}`").alias("text_"))
    return arrow_map(source, run, schema)


def similarity(a: Column, b: Column) -> Column:
    """Share of entries on which two fingerprints agree; null if either is null or empty."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, agree / F.size(a))
