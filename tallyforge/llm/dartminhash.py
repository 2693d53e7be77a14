"""Near-duplicate groups by DartMinHash over weighted word shingles.

A document is a weighted set: its word k-shingles, each with weight 1 + ln(count).
The plane (weight x rank) of a shingle is cut into cells, one weight unit high and
of doubling width in rank.  The hash of shingle and cell says how many darts fall
into the cell (Poisson, by its area) and where; every dart also has one of T
coordinates.  A dart counts if it lies under the shingle's weight.  Cells are
visited by growing rank until each coordinate has a dart, and each keeps its
earliest.  Two documents agree on a coordinate with a probability equal to their
weighted Jaccard similarity, and a sketch costs about T ln T darts however long
the text is.

Bands of a sketch are joined by their hashes.  Of equal sketches that a task meets
only the first is banded, the others are linked to it, so a group of copies brings
each bucket one row a task.  Within a bucket equal sketches are one, and the parts
that hang together are found exactly: each new finding is compared with all that are
left, but for those that the triangle inequality rules out (the number of coordinates
on which two sketches differ is a distance).  The groups are the connected parts
over all buckets.

Defined results
* null text and text without words: no sketch, never in a group
* a text of fewer than k words: one shingle of all its words
* repeated rows: one document; several texts under one id count as that document's, each of them is compared
* null id: not grouped (and kept by ``one_of_each``); an id that isn't a whole number raises ValueError
* an empty table gives an empty result; extra columns of any type and name are passed through by ``one_of_each``
* very long texts are sketched whole
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import U64, Words, mix, shingles, slices, unit, utf8
from .shared import arrow_map, free_name, integer_id, written

COORDINATES = 128
SHINGLE = 3
BANDS, ROWS = 32, 4
SIMILARITY = 0.5
SEED = 1_299_709
#: Sketches that a task remembers.
MET = 1 << 20
_LEVEL_0 = -8


@functools.cache
def _poisson_cdf(width: float) -> np.ndarray:
    top = int(width + 12 * math.sqrt(width) + 20)
    k = np.arange(top)
    logs = -width + k * math.log(width) - np.array([math.lgamma(i + 1) for i in k])
    return np.cumsum(np.exp(logs))


def weighted_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of each distinct shingle of each text."""
    doc, h = shingles(words, k)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], 1 + np.log(np.diff(np.append(at, len(h))))


def sketches(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, t: int = COORDINATES, seed: int = SEED) -> np.ndarray:
    """docs x t ranks of the earliest darts; infinite for a document without elements."""
    best = np.full(docs * t, np.inf)
    if not len(doc):
        return best.reshape(docs, t)
    bits = t.bit_length() - 1
    if 1 << bits != t:
        raise ValueError("the number of coordinates must be a power of two")
    units = np.ceil(weight).astype(np.int64)
    owner = np.repeat(np.arange(len(doc)), units)
    unit_no = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    cell_doc = doc[owner]
    room = weight[owner] - unit_no
    start = mix(element + U64(seed))[owner]
    again = unit_no > 0
    start[again] = mix(start[again] + unit_no[again].astype(U64))
    level = _LEVEL_0
    while len(cell_doc):
        low, width = (0.0, 2.0**level) if level == _LEVEL_0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        here = mix(start ^ mix(np.array([level + 1000], U64))[0])
        u = unit(here)
        cdf = _poisson_cdf(width)
        hit = np.flatnonzero(u > cdf[0])
        darts = np.searchsorted(cdf, u[hit])
        cell = np.repeat(hit, darts)
        number = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        place = mix(here[cell] + (number + 1).astype(U64) * U64(0xD6E8FEB86659FD93))
        coordinate = (place >> U64(64 - bits)).astype(np.int64)
        under = unit(place << U64(bits)) < room[cell]
        rank = low + width * unit(mix(place ^ U64(0xA5A5A5A5A5A5A5A5)))
        np.minimum.at(best, cell_doc[cell[under]] * t + coordinate[under], rank[under])
        left = ~np.isfinite(best.reshape(docs, t)).all(axis=1)
        go = left[cell_doc]
        if not go.all():
            cell_doc, room, start = cell_doc[go], room[go], start[go]
        level += 1
    return best.reshape(docs, t)


def _sketch_batches(k: int, t: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*utf8(part.column(1)))
                n = part.num_rows
                ranks = sketches(*weighted_sets(words, k), n, t, seed)
                some = np.isfinite(ranks[:, 0])
                if not some.any():
                    continue
                prints = (mix(ranks[some].view(U64)) >> U64(32)).astype(np.uint32)
                keys = np.zeros((len(prints), bands), U64)
                for r in range(rows):
                    keys = mix(keys + prints[:, r : r + bands * rows : rows].astype(U64) + U64(1))
                keys = mix(keys + np.arange(bands, dtype=U64)).view(np.int64)
                ids = part.column(0).filter(pa.array(some))
                # A fuller table of what was met would only save some more: sketches that it forgot meet in their buckets.
                if len(met) > MET:
                    met.clear()
                same: list[int | None] = []
                for digest, key in zip(map(xxhash.xxh3_128_digest, np.ascontiguousarray(prints)), ids.to_pylist()):
                    same.append(met.get(digest))
                    met.setdefault(digest, key)
                first = np.array([s is None for s in same], bool)
                # Two bytes a coordinate are enough to compare: others agree by chance on one of 65,536.
                held = pa.array([p.tobytes() if s is None else None for p, s in zip(prints.astype(np.uint16), same)], pa.binary())
                ends = np.concatenate([[0], np.cumsum(np.where(first, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[first].ravel()))
                yield pa.RecordBatch.from_arrays([ids, held, lists, pa.array(same, pa.int64())], names=["id", "sketch", "bands", "same"])

    return run


def sketch_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, t: int = COORDINATES, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(id, sketch, bands, same) of every document that has words; for a document whose sketch its task has met, only ``same``, the id it met it with."""
    given = df.select(integer_id(df, id_col).alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    return arrow_map(given, _sketch_batches(k, t, bands, rows, seed), "id long, sketch binary, bands array<long>, same long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut so that no value of it is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cut = int(np.searchsorted(key != key[-1], False)) if (key[0] == key[-1]) else int(np.flatnonzero(key != key[-1])[-1]) + 1
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges_of(key: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), len(key))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each band hash that at least two documents share; equal lists of members only once in a task."""
    given: set[int] = set()
    for table in _runs(batches):
        key, doc = table.column(0).to_numpy(), table.column(1).to_numpy()
        # An id that repeats under one hash is one document.
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[keep], doc[keep]
        at = _edges_of(key)
        several = np.flatnonzero(np.diff(at) > 1)
        if not len(several):
            continue
        terms = mix(doc.view(U64))
        sums = np.add.reduceat(terms, at[:-1])
        buckets, docs = [], []
        for i in several:
            name = int(sums[i])
            if name not in given:
                given.add(name)
                docs.append(doc[at[i] : at[i + 1]])
                buckets.append(np.full(at[i + 1] - at[i], sums[i], U64))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets).view(np.int64)), pa.array(np.concatenate(docs))], names=["bucket", "id"])


def connected(sketch: np.ndarray, least: float) -> np.ndarray:
    """For each sketch the number of the first one in its part; two hang together if they agree on ``least`` of the coordinates."""
    t = sketch.shape[1]
    most = t - math.ceil(least * t - 1e-9)
    rows = np.ascontiguousarray(sketch).view(np.dtype((np.void, sketch.itemsize * t))).ravel()
    _, place, of = np.unique(rows, return_index=True, return_inverse=True)
    # Distinct sketches in the order of their first rows.
    order = np.argsort(place)
    place, back = place[order], np.argsort(order)
    kind = sketch[place]
    out, left = np.full(len(kind), -1), np.arange(len(kind))
    while len(left):
        seed, left = left[0], left[1:]
        out[seed] = seed
        # Sketches differ from one another at least by the difference of their distances from the seed.
        apart = (kind[left] != kind[seed]).sum(axis=1)
        near = apart <= most
        out[left[near]] = seed
        front = list(zip(apart[near].tolist(), left[near].tolist()))
        by = np.argsort(apart[~near], kind="stable")
        left, apart = left[~near][by], apart[~near][by]
        while front and len(left):
            far, one = front.pop()
            reach = int(np.searchsorted(apart, far + most, "right"))
            hit = np.flatnonzero((kind[left[:reach]] != kind[one]).sum(axis=1) <= most)
            if len(hit):
                out[left[hit]] = seed
                front += zip(apart[hit].tolist(), left[hit].tolist())
                left, apart = np.delete(left, hit), np.delete(apart, hit)
        left.sort()
    return place[out[back[of]]]


def _compared(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            at = _edges_of(table.column(0).to_numpy())
            doc = table.column(1).to_numpy()
            sketch = table.column(2)
            a, b = [], []
            for first, last in zip(at[:-1], at[1:]):
                part = np.frombuffer(b"".join(sketch.slice(first, last - first).to_pylist()), np.uint16).reshape(last - first, -1)
                ids = doc[first:last]
                head = ids[connected(part, least)]
                far = head != ids
                a.append(ids[far])
                b.append(head[far])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the undirected edges (a, b): root is the smallest id of the connected part.

    Alternating large-star and small-star rounds, each written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = written(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def _grouped(sketched: DataFrame, least: float) -> DataFrame:
    bands = sketched.select(F.explode("bands").alias("key"), "id").repartition("key").sortWithinPartitions("key", "id")
    # Buckets with the same members, found in several tasks, are one.
    members = written(bands.mapInArrow(_buckets, "bucket long, id long").distinct(), "buckets")
    # An id with several texts has a row for each of its sketches.
    held = sketched.where("sketch is not null").select("id", "sketch")
    # Shuffled at every size: neither side is bounded.
    filled = members.hint("merge").join(held, "id").select("bucket", "id", "sketch").repartition("bucket").sortWithinPartitions("bucket", "id")
    found = filled.mapInArrow(_compared(least), "a long, b long")
    return components(found.unionByName(sketched.where("same is not null and same <> id").select(F.col("id").alias("a"), F.col("same").alias("b"))))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, **how: int) -> DataFrame:
    """(id, group_id) of every document that has a near duplicate; group_id is the smallest id of its group."""
    sketched = written(sketch_table(df, id_col, text_col, **how), "sketches")
    return _grouped(sketched, least).select(F.col("id").alias(id_col), F.col("root").alias("group_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, **how: int) -> DataFrame:
    """The rows of ``df`` with one document of each group: the one with the smallest id.  All columns stay."""
    sketched = written(sketch_table(df, id_col, text_col, **how), "sketches")
    key = free_name(df.columns, "near_id")
    gone = written(_grouped(sketched, least).where("id <> root").select(F.col("id").alias(key)), "near-copies")
    kept = df.join(gone, F.col(f"`{id_col}`") == F.col(key), "left_anti")
    repeated = written(sketched.groupBy("id").count().where("count > 1").select(F.col("id").alias(key)), "repeated-ids")
    if repeated.limit(1).count() == 0:
        return kept
    # Rows that repeat an id with the same text are one document too.
    same = F.col(f"`{id_col}`") == F.col(key)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    again = kept.join(repeated, same, "left_semi").groupBy(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).agg(F.min_by(row, row.cast("string")).alias("row")).select("row.*")
    return kept.join(repeated, same, "left_anti").unionByName(again)
