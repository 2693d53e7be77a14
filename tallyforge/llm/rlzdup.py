"""Duplicate passages by relative Lempel-Ziv factors.

The references of a document are all documents with smaller ids.  They are indexed
by seeds, runs of MIN_WORDS words: a seed is listed under its first occurrence, the
document with the smallest id that has it, so what a later document repeats is
listed once.  The index is kept in blocks.  Of the RUN_WORDS-word runs in a seed the
one with the smallest hash is the seed's anchor, and a block (all rows of one anchor
in a shuffle partition) holds every stretch of text whose seeds have that anchor.
Equal seeds have equal anchors at equal places, so a document meets each reference
block that can hold a factor of it, and no other.

In a block each document's stretch is factored from left to right: a seed that is
listed begins a factor, which goes on as long as the following seeds are listed at
the following places of the same reference.  Seeds are told apart by the 64-bit hash
of the anchor's bytes, its place in the seed and a 32-bit hash of the seed's bytes.
The factors of one document are then checked at their boundaries: two on one
diagonal (same reference, same distance of the places) that touch or overlap are
one, and the parse goes from left to right once more, takes at each place the factor
that reaches furthest, and lets a factor that began before the boundary go on behind
it.  No text is shuffled.

An anchor with more than HOT_ROWS stretches has no block: its seeds are aggregated
one by one, with partial aggregation, and joined with their first occurrences in
SALTS parts.  The factors are the same.

Defined results
* null text, and texts of fewer than MIN_WORDS words: no factor
* places are offsets in the bytes of the UTF-8 text; a factor starts at a word, or where the one before it ends, and ends at a word's end
* the n-th occurrence of a seed in a document meets the reference's n-th one, or its last
* a document is never its own reference; equal rows count once; texts that share an id are factored apart, against other ids only
* equal reach: the reference with the smallest id
* a null id takes no part; an id that isn't a whole number raises ValueError
* an empty table gives an empty result; extra columns are ignored
* very long texts are parsed whole
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import U64, Words, slices, utf8
from .dartminhash import _edges_of, _runs
from .shared import arrow_map, integer_id, join_small, written

RUN_WORDS = 16
MIN_WORDS = 50
#: Stretches of one anchor that a task may hold at once.
HOT_ROWS = 1 << 16
SALTS = 32
_FACTOR = "id long, row long, ref long, ref_row long, diagonal long, start long, end long"


class Anchors:
    """Anchors of a batch of texts.  Seeds of one anchor follow one another, so each anchor stands for a stretch of seeds."""

    def __init__(self, data: np.ndarray, at: np.ndarray, k: int = RUN_WORDS, least: int = MIN_WORDS):
        words = Words(data, at, lower=False)
        w = least - k + 1
        n = np.maximum(np.diff(words.first) - k + 1, 0)
        n[n < w] = 0
        total = int(n.sum())
        self.doc = self.hash = self.place = self.back = self.reach = self.shift = self.size = np.zeros(0, np.int64)
        self.seeds = np.zeros(0, np.uint32)
        self.starts = self.ends = np.zeros(0, np.int64)
        if not total:
            return
        doc = np.repeat(np.arange(len(n)), n)
        ends = np.cumsum(n)
        word = words.first[doc] + np.arange(total) - np.repeat(ends - n, n)
        h = words.span_hash(words.start[word], words.end[word + k - 1])
        low, size = (h & U64(0xFFFFFFFF00000000)) | np.arange(total, dtype=U64), 1
        while size * 2 <= w:
            low[: total - size] = np.minimum(low[: total - size], low[size:])
            size *= 2
        if size < w:
            step = w - size
            low[: total - step] = np.minimum(low[: total - step], low[step:])
        seed = np.flatnonzero(np.repeat(ends, n) - np.arange(total) >= w)
        anchor = (low[seed] & U64(0xFFFFFFFF)).astype(np.int64)
        begin, end = words.start[word[seed]], words.end[word[seed] + least - 1]
        self.seeds = (words.span_hash(begin, end) >> U64(32)).astype(np.uint32)
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        run = anchor[first]
        self.doc, self.hash = doc[run], h[run].view(np.int64)
        start = words.start[word[run]]
        #: of the run, in bytes of its text; bytes from the first seed's start to it and from it to that seed's end; words from the first seed to it; number of seeds
        self.place = start - at[self.doc]
        self.back = start - begin[first]
        self.reach = end[first] - start
        self.shift = run - seed[first]
        self.size = np.diff(np.append(first, len(anchor)))
        #: how far each seed starts and ends behind the one before it in its stretch
        self.starts, self.ends = np.diff(begin, prepend=0), np.diff(end, prepend=0)
        self.starts[first] = self.ends[first] = 0


def _binary(values: np.ndarray, size: np.ndarray) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum(size)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


_STRETCH = "h long, id long, row long, place long, back int, reach int, shift int, seeds binary, starts binary, ends binary, wide boolean"
_NAMES = [c.split()[0] for c in _STRETCH.split(", ")]


def _stretches(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                a = Anchors(*utf8(part.column(2)), k, least)
                of = np.repeat(np.arange(len(a.size)), a.size)
                # Steps of a byte each, but for stretches with a very long word or gap.
                far = np.zeros(len(a.size), bool)
                far[of[(a.starts > 255) | (a.ends > 255)]] = True
                for wide, kind in ((False, np.uint8), (True, np.uint32)):
                    rows = np.flatnonzero(far == wide)
                    if not len(rows):
                        continue
                    mine = far[of] == wide
                    columns = [pa.array(c[rows]) for c in (a.hash, part.column(0).to_numpy()[a.doc], part.column(1).to_numpy()[a.doc], a.place)]
                    columns += [pa.array(c[rows].astype(np.int32)) for c in (a.back, a.reach, a.shift)]
                    columns += [_binary(c[mine], a.size[rows]) for c in (a.seeds, a.starts.astype(kind), a.ends.astype(kind))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), wide))], names=_NAMES)

    return run


def _counted(k: int, least: int):
    """(anchor, stretches) of a batch's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, n = np.unique(Anchors(*utf8(part.column(0)), k, least).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return run


def _bytes(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values, how many each row has) of a binary column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, body = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(body, np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind), np.diff(at) // np.dtype(kind).itemsize


class Opened:
    """The seeds of stretches (rows of _STRETCH), one after another."""

    def __init__(self, table: pa.Table):
        self.seed, self.size = _bytes(table.column(7), np.uint32)
        self.row = np.repeat(np.arange(table.num_rows), self.size)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        place, back, reach, shift = (table.column(i).to_numpy().astype(np.int64) for i in range(3, 7))
        #: words from a seed to its anchor
        self.step = np.repeat(shift, self.size) - (np.arange(len(self.row)) - self.begin[:-1][self.row])
        wide = table.column(10).to_numpy(zero_copy_only=False).astype(bool)
        self.start, self.end = (base[self.row] + self._summed(table.column(i), wide) for base, i in ((place - back, 8), (place + reach, 9)))

    def _summed(self, column: pa.ChunkedArray, wide: np.ndarray) -> np.ndarray:
        steps = np.zeros(len(self.row), np.int64)
        for far, kind in ((False, np.uint8), (True, np.uint32)):
            rows = np.flatnonzero(wide == far)
            if len(rows):
                steps[wide[self.row] == far] = _bytes(column.take(pa.array(rows)), kind)[0]
        sums = np.cumsum(steps)
        return sums - sums[self.begin[:-1]][self.row]


def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a block: the factors of each document's stretches against the seeds that the block lists."""
    for table in _runs(batches):
        h, doc, version, place = (table.column(i).to_numpy() for i in range(4))
        # Equal rows count once; only anchors that two documents have can have seeds in common (ids are sorted within an anchor).
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (place[1:] != place[:-1])
        edges = _edges_of(h)
        rows = np.flatnonzero(fresh & np.repeat(doc[edges[:-1]] != doc[edges[1:] - 1], np.diff(edges)))
        if not len(rows):
            continue
        few = table.take(pa.array(rows)).combine_chunks()
        h, doc, version = h[rows], doc[rows], version[rows]
        o = Opened(few)
        block = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) * (int(o.step.max()) + 1)
        kind = block[o.row] + o.step
        order = np.argsort(kind.view(U64) << U64(32) | o.seed, kind="stable") if int(kind.max()) < 1 << 32 else np.lexsort((o.seed, kind))
        new = np.ones(len(order), bool)
        new[1:] = (kind[order[1:]] != kind[order[:-1]]) | (o.seed[order[1:]] != o.seed[order[:-1]])
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        # The n-th occurrence in one document meets the n-th in the other, so copies of repetitive texts stay on one diagonal.
        owner, text = doc[o.row[order]], version[o.row[order]]
        change = new.copy()
        change[1:] |= (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(change)
        run = np.cumsum(change) - 1
        times = np.diff(np.append(begin, len(order)))
        nth = np.arange(len(order)) - begin[run]
        first = order[heads[group] + np.minimum(nth, times[run[heads]][group] - 1)]
        listed = np.full(len(order), -1)
        listed[order] = first
        mine = np.flatnonzero(doc[o.row] != doc[o.row[listed]])
        if not len(mine):
            continue
        other = listed[mine]
        diagonal = o.start[mine] - o.start[other]
        cut = np.ones(len(mine), bool)
        same = lambda x: x[1:] == x[:-1]
        cut[1:] = ~((np.diff(mine) == 1) & same(o.row[mine]) & same(doc[o.row[other]]) & same(version[o.row[other]]) & same(diagonal))
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(mine)) - 1
        r, q = o.row[mine[a]], o.row[other[a]]
        columns = (doc[r], version[r], doc[q], version[q], diagonal[a], o.start[mine[a]], o.end[mine[b]])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "row", "ref", "ref_row", "diagonal", "start", "end"])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            o = Opened(table)
            h, doc, version = (table.column(i).to_numpy()[o.row] for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, o.step, o.seed.astype(np.int64), doc, version, o.start, o.end)], names=["h", "step", "seed", "id", "row", "start", "end"])


def _hot_factors(stretches: DataFrame) -> DataFrame:
    """What _factored gives, seed by seed, for anchors that no task could hold."""
    key = ["h", "step", "seed"]
    each = stretches.mapInArrow(_seeds, "h long, step long, seed long, id long, row long, start long, end long").groupBy(*key, "id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("at"))
    first = each.groupBy(*key).agg(F.min(F.struct("id", "row", "at")).alias("f")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = each.withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(SALTS)).cast("int")).join(first, [*key, "salt"]).where(F.col("f.id") < F.col("id"))
    theirs = lambda i: F.get(F.col("f.at"), F.least(i, F.size("f.at") - 1))["start"]
    places = F.transform("at", lambda x, i: F.struct((x["start"] - theirs(i)).alias("diagonal"), x["start"].alias("start"), x["end"].alias("end")))
    return met.select("id", "row", F.col("f.id").alias("ref"), F.col("f.row").alias("ref_row"), F.explode(places).alias("p")).select("id", "row", "ref", "ref_row", "p.*")


def joined(factors: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, reference, start there) from sorted (reference, its text, diagonal, start, end): factors of one diagonal that touch or overlap are one."""
    out: list[tuple[int, int, int, int]] = []
    kind = None
    for ref, version, diagonal, start, end in factors:
        if kind == (ref, version, diagonal) and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), ref, out[-1][3])
        else:
            kind = (ref, version, diagonal)
            out.append((start, end, ref, start - diagonal))
    return out


def parse(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy parse of (start, end, reference, start there): no two of the result overlap, all that was covered stays covered."""
    spans = sorted(spans)
    out: list[tuple[int, int, int, int]] = []
    at = i = 0
    best = None
    while True:
        # Of all factors that begin here or before the boundary, the one that reaches furthest.
        while i < len(spans) and spans[i][0] <= at:
            if best is None or (-spans[i][1], spans[i][2]) < (-best[1], best[2]):
                best = spans[i]
            i += 1
        if best is not None and best[1] > at:
            start, end, ref, ref_start = best
            out.append((at, end, ref, ref_start + at - start))
            at = end
        elif i < len(spans):
            at = spans[i][0]
        else:
            return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches):
        columns = [table.column(i).to_numpy() for i in range(7)]
        new = np.ones(len(columns[0]), bool)
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        edges = np.append(np.flatnonzero(new), len(new))
        out: list[tuple[int, ...]] = []
        for first, last in zip(edges[:-1], edges[1:]):
            spans = joined(list(zip(*(c[first:last].tolist() for c in columns[2:]))))
            out += [(int(columns[0][first]), *s) for s in (parse(spans) if len(spans) > 1 else spans)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "start", "end", "ref", "ref_start"])


def duplicate_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, start, end, ref_id, ref_start): passages of min_words words or more copied from a document with a smaller id."""
    if not 0 < run_words < min_words:
        raise ValueError("min_words must exceed run_words")
    docs = df.select(integer_id(df, id_col).alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    counts = arrow_map(docs.select("text"), _counted(run_words, min_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    hot = written(counts.where(F.col("n") > hot_rows).select("h"), "hot-anchors")
    some = hot.count()
    stretches = arrow_map(docs, _stretches(run_words, min_words), _STRETCH)
    in_blocks = join_small(stretches, hot, ["h"], "left_anti", some) if some else stretches
    factors = in_blocks.repartition("h").sortWithinPartitions("h", "id", "row", "place").mapInArrow(_factored, _FACTOR)
    if some:
        factors = factors.unionByName(_hot_factors(join_small(stretches, hot, ["h"], "left_semi", some)))
    out = factors.repartition("id", "row").sortWithinPartitions("id", "row", "ref", "ref_row", "diagonal", "start").mapInArrow(_parsed, "id long, start long, end long, ref long, ref_start long")
    return out.select(F.col("id").alias(id_col), "start", "end", F.col("ref").alias("ref_id"), "ref_start")
