"""Exact deduplication: Patricia tries over (length, content hash) partitions.

Rows are shuffled by length and content hash and sorted by them, then by id.  A
task inserts the full byte string of each row, led by its hash, into the compressed
radix trie of its length; the terminal node stores the smallest id, which is that of
the first row to reach it, as rows come in id order.  They also come in the trie's
own order of hashes: once a trie holds SUBTREE_BYTES, the subtrees of all smaller
hashes are complete and given up, and what is still to come waits, grouped by
subtree, in the spill files of Spark's sort.  Before the shuffle each Arrow batch
folds its own copies, whose text then does not travel.

A text with more than HOT_ROWS copies is settled before the shuffle.  Copies are
counted by length and hash, the hot texts are aggregated with their smallest ids (by
whole texts, with partial aggregation), and up to HOT_BYTES of them travel to the
tasks as one trie; rows that find their owner there are spread over all tasks.

Defined results
* null text: never a copy of anything; the row owns itself
* empty texts are copies of one another
* ties and repeated rows (equal id and text): exactly one row is kept
* null id: ordered after every id; a group without ids has owner null; an id that isn't a whole number raises ValueError
* extra columns are passed through whatever their names; an empty table gives an empty result
* very long texts are compared whole
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from .batches import give_back
from .shared import arrow_map, integer_id

#: Bytes of text that a trie holds before it gives up its completed subtrees.
SUBTREE_BYTES = 16 << 20
#: Copies of one text that may go to one task, and bytes of texts with more copies that every task may hold.
HOT_ROWS, HOT_BYTES = 1 << 16, 32 << 20


class Trie:
    """Compressed radix trie of byte strings; a node is [label, children by first byte, owner or None]."""

    __slots__ = ("root", "size")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.size = 0

    def insert(self, key: bytes, owner: object) -> object:
        """The owner of the terminal that ``key`` reaches: ``owner`` itself if the string is new."""
        node, at, n = self.root, 0, len(key)
        while True:
            if at == n:
                if node[2] is None:
                    node[2] = owner
                    self.size += 1
                return node[2]
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, owner]
                self.size += 1
                return owner
            label = child[0]
            m = len(label)
            if m <= n - at and key.startswith(label, at):
                node, at = child, at + m
                continue
            same = _common(label, key, at)
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = middle
            node, at = middle, at + same

    def find(self, key: bytes) -> object:
        """The owner of ``key``, or None."""
        node, at = self.root, 0
        while at < len(key):
            node = node[1].get(key[at])
            if node is None or not key.startswith(node[0], at):
                return None
            at += len(node[0])
        return node[2]


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _digest(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _keyed(text: bytes, digest: int) -> bytes:
    """A text as the trie has it, led by its hash."""
    return (digest + (1 << 63)).to_bytes(8, "big") + text


def _folded(names: list[str], keep_copies: bool, hot):
    """Before the shuffle: copies within a batch lose their text (or, without ``keep_copies``, their row), and copies of hot texts are settled.

    Length -1 marks a null text, -2 a settled copy; both are spread over all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Trie()
        for text, owner in hot.value if hot else []:
            known.insert(_keyed(text, _digest(text)), (owner,))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).to_pylist()
            texts = pc.cast(batch.column(1), pa.large_binary()).to_pylist()
            trie = Trie()
            length, digest = np.full(n, -1, np.int64), np.zeros(n, np.int64)
            owner, first, settled = [None] * n, np.ones(n, bool), np.zeros(n, bool)
            spread = lambda i: _digest(f"{ids[i]} {i}".encode())
            for i in sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0)):
                if texts[i] is None:
                    digest[i] = spread(i)
                    continue
                length[i], digest[i] = len(texts[i]), _digest(texts[i])
                key = _keyed(texts[i], int(digest[i]))
                found = trie.insert(key, i)
                first[i] = found == i
                owner[i] = ids[found]
                of = known.find(key)
                # The rows that have the owner's id themselves go on: one of them is the row to keep.
                if of is not None and (of[0] != ids[i] or not first[i]):
                    owner[i], first[i], settled[i] = of[0], False, True
                    length[i], digest[i] = -2, spread(i)
            moved = pc.if_else(pa.array(first), batch.column(1), pa.nulls(n, batch.column(1).type))
            out = pa.RecordBatch.from_arrays([batch.column(0), moved, *batch.columns[2:], pa.array(length), pa.array(digest), pa.array(owner, pa.int64()), pa.array(first)], names=names)
            yield out if keep_copies else out.filter(pa.array(first & ~settled))
            del texts, trie, out, moved
            give_back()

    return run


def _owned(names: list[str], keep_copies: bool, given: int, subtree_bytes: int):
    """After the shuffle: rows sorted by length, digest and id, one subtree after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        now, held, trie, by_id = (None, None), 0, Trie(), {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = given
            length, digest, local, first = (batch.column(at + j).to_pylist() for j in range(4))
            ids = batch.column(0).to_pylist()
            texts = pc.cast(batch.column(1), pa.large_binary())
            owner, is_owner = [None] * n, np.zeros(n, bool)
            for i in range(n):
                if length[i] < 0:
                    owner[i], is_owner[i] = (ids[i], True) if length[i] == -1 else (local[i], False)
                    continue
                if now != (length[i], digest[i]):
                    if now[0] != length[i] or held > subtree_bytes:
                        trie, held = Trie(), 0
                    now, by_id = (length[i], digest[i]), {}
                if first[i]:
                    row += 1
                    found = trie.insert(_keyed(texts[i].as_py(), digest[i]), (ids[i], row))
                    owner[i], is_owner[i] = found[0], found[1] == row
                    held += length[i] if is_owner[i] else 0
                    by_id.setdefault(ids[i], []).append(found[0])
                else:
                    # A copy without text follows the row of its batch that kept the text; two strings of one
                    # digest never share an id's entry unless the id itself is repeated with both.
                    owner[i] = by_id[local[i]][0]
            kept = [batch.column(j) for j in range(given) if keep_copies is False] if not keep_copies else [batch.column(0)]
            if keep_copies:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(owner, pa.int64()), pa.array(is_owner)], names=names)
            else:
                yield pa.RecordBatch.from_arrays(kept, names=names).filter(pa.array(is_owner))

    return run


def hot_texts(df: DataFrame, hot_rows: int, hot_bytes: int) -> list[tuple[bytes, int | None]]:
    """(text, smallest id) of texts with more than ``hot_rows`` copies, those with most copies first, of ``hot_bytes`` together at most.

    ``df`` has i and t.  The others go the ordinary way.
    """
    size, digest = F.octet_length("t").alias("n"), F.xxhash64("t").alias("h")
    counts = df.where("t is not null").groupBy(size, digest).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_rows)
    # At most one key for every hot_rows rows, and none is longer than what the tasks may hold.
    keys = counts.where(F.col("n") <= hot_bytes).orderBy(F.desc("c"), "n", "h").limit(10_000).collect()
    room, chosen = hot_bytes, []
    for k in keys:
        if k["n"] <= room:
            room -= k["n"]
            chosen.append((k["n"], k["h"]))
    if not chosen:
        return []
    few = F.broadcast(df.sparkSession.createDataFrame(chosen, "n int, h long"))
    found = df.select("i", "t", size, digest).join(few, ["n", "h"], "left_semi").groupBy("t").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("c"))
    return [(r["t"].encode(), r["i"]) for r in found.where(F.col("c") > hot_rows).collect()]


def _shuffled(df: DataFrame, id_col: str, text_col: str, rest: list[str], keep_copies: bool, hot_rows: int) -> tuple[DataFrame, T.StructType]:
    fields = [T.StructField("i", T.LongType()), T.StructField("t", T.StringType()), *(T.StructField(f"c{j}", df.schema[c].dataType) for j, c in enumerate(rest))]
    more = [T.StructField("n", T.LongType()), T.StructField("h", T.LongType()), T.StructField("o", T.LongType()), T.StructField("f", T.BooleanType())]
    given = df.select(integer_id(df, id_col).alias("i"), F.col(f"`{text_col}`").alias("t"), *(F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(rest)))
    hot = hot_texts(given.select("i", "t"), hot_rows, HOT_BYTES)
    shared = df.sparkSession.sparkContext.broadcast(hot) if hot else None
    folded = arrow_map(given, _folded([x.name for x in [*fields, *more]], keep_copies, shared), T.StructType([*fields, *more]))
    # A row that kept its text precedes the copies that lost theirs, also among equal ids.
    return folded.repartition("n", "h").sortWithinPartitions("n", "h", F.col("i").asc_nulls_last(), F.col("f").desc()), T.StructType(fields)


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS, subtree_bytes: int = SUBTREE_BYTES) -> DataFrame:
    """(id, owner_id, is_owner) for every row: the smallest id with the same text, and whether this row is the one to keep."""
    moved, _ = _shuffled(df, id_col, text_col, [], True, hot_rows)
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("owner_id", T.LongType()), T.StructField("is_owner", T.BooleanType())])
    return arrow_map(moved, _owned(schema.names, True, 2, subtree_bytes), schema)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS, subtree_bytes: int = SUBTREE_BYTES) -> DataFrame:
    """The rows of ``df`` without exact copies: of each group the row with the smallest id, all columns as they were."""
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    moved, fields = _shuffled(df, id_col, text_col, rest, False, hot_rows)
    order = [id_col, text_col, *rest]
    names = [f"x{j}" for j in range(len(order))]
    schema = T.StructType([T.StructField(x, f.dataType) for x, f in zip(names, fields)])
    out = arrow_map(moved, _owned(names, False, len(fields), subtree_bytes), schema)
    return out.select(*(F.col(names[order.index(c)]).cast(df.schema[c].dataType).alias(c) for c in df.columns))
