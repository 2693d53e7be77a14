"""Sum-of-squares online packing of documents into training windows.

Each document goes, as it arrives, into the fill level that minimises the sum over
levels h of N(h) squared, where N(h) is the number of partly filled windows at
level h; N is the level array.  Opening a window is one of the choices, filling
one to the brim takes it out of the array.

A document longer than a window is cut: whole windows of its own, and the rest is
placed.  Sizes are computed once and written as a narrow table; from there on only
ids and sizes move.  Each shard of documents packs by itself, in the order of ids and sizes; the
number of shards follows the total size alone, so a result does not depend on how
the input happens to be split.

Defined results
* null or empty text (no units): placed nowhere, no row
* ties between choices: a fuller window first, the one that reached its level first; a new window last
* repeated rows are placed as often as they occur; a null id is placed like any other, before the rest
* ids are whole numbers and come back unchanged, beside null ones too; others raise ValueError
* extra columns are ignored; an empty table gives an empty result
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import integer_id, written

WINDOW = 2048
SHARD_UNITS = 1 << 27


def pretokens(text: Column) -> Column:
    """Number of words and of runs of other visible characters: the pieces that subword tokenisers start from."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"))


class SumOfSquares:
    """The online packer: windows of one size and the level array."""

    def __init__(self, window: int):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[deque[int]] = [deque() for _ in range(window + 1)]
        self.windows = 0

    def _new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for an item of 1 to ``window`` units."""
        b, n = self.window, self.levels
        if size == b:
            return self._new(), 0
        best, gain = 0, 2 * int(n[size]) + 1
        here = n[1 : b - size + 1]
        # Taking one window from level h and putting it at h + size; a full window leaves the array.
        change = 2 * n[size + 1 : b + 1] + 2 - 2 * here
        change[-1] = 1 - 2 * here[-1]
        change = np.where(here > 0, change, np.iinfo(np.int64).max)
        last = len(change) - 1 - int(change[::-1].argmin())
        if change[last] <= gain and here[last] > 0:
            best = last + 1
        if best:
            window = self.open[best].popleft()
            n[best] -= 1
        else:
            window = self._new()
        level = best + size
        if level < b:
            n[level] += 1
            self.open[level].append(window)
        return window, best


SCHEMA = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("window", pa.int64()), ("window_offset", pa.int32()), ("doc_offset", pa.int64()), ("units", pa.int32())])
#: Pieces that are held before they are handed on.
PIECES = 10_000


def _packed(window: int):
    """Rows come sorted by shard, id and size; a task holds the level array and the open windows of one shard, never its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now, out = None, None, []
        for batch in batches:
            for shard, doc, units in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if packer is None or shard != now:
                    packer, now = SumOfSquares(window), shard
                for piece, start in enumerate(range(0, units, window)):
                    size = min(window, units - start)
                    at, offset = packer.place(size)
                    out.append((shard, doc, piece, at, offset, start, size))
                    if len(out) == PIECES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: Column | None = None, window: int = WINDOW, shard_units: int = SHARD_UNITS) -> DataFrame:
    """One row for each piece of a document: its window (shard, window), its place in the window and in the document."""
    size = pretokens(F.col(f"`{text_col}`")) if units is None else units
    sizes = written(df.select(integer_id(df, id_col).alias("id"), F.coalesce(size.cast("long"), F.lit(0)).alias("units")).where("units > 0"), "packing-sizes")
    total = sizes.agg(F.sum("units")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_units))
    # Also by size, so that rows that share an id, or have none, are no shard of their own.
    shard = F.pmod(F.xxhash64("id", "units"), F.lit(shards)).cast("int").alias("shard")
    moved = sizes.select(shard, "id", "units").repartition("shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "units")
    return moved.mapInArrow(_packed(window), "shard int, doc_id long, piece int, window long, window_offset int, doc_offset long, units int")
