"""The cluster's shared folder: where intermediate tables are written to cut lineage.

``spark.checkpoint.dir`` names it.  Only where that setting is absent (tests, a
laptop) a folder of our own is made, once for each SparkContext.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's own bound of an Arrow batch, which counts as no wish of the user, and ours.
DEFAULT_BATCH_BYTES, BATCH_BYTES = 64 << 20, 8 << 20

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that every executor can read and write."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        sc.setCheckpointDir(_OWN[sc.applicationId])
    return _OWN[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside, but for those to keep, are deleted at the end."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        delete(spark, _SCRATCH.pop())


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders from whatever file system they are on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, readable after executors are lost.

    A table with a path of its own is kept; others belong to the scratch that is open, if one is.
    """
    if path is None:
        path = fresh_path(df.sparkSession, name)
        if _SCRATCH:
            _SCRATCH[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` for rows that hold texts: batches of at most BATCH_BYTES, unless the session asks for still smaller ones.

    A worker holds a batch several times over, on both sides of the pipe.  Spark reads the
    setting when a query runs, so it stays for the session; only Spark's own default is replaced.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == f"{DEFAULT_BATCH_BYTES}b":
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, small_rows: int, broadcast_rows: int = 200_000) -> DataFrame:
    """Join with a side whose row count is known: broadcast up to ``broadcast_rows`` rows, else shuffled."""
    return big.join(F.broadcast(small) if small_rows <= broadcast_rows else small, on, how)


def integer_id(df: DataFrame, name: str) -> Column:
    """The id column as a 64-bit number; ids of other kinds (texts, fractions) are refused before anything runs, not cast."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"ids must be whole numbers of at most 64 bits, and {name} is {kind.simpleString()}: number the documents first")
    return F.col(f"`{name}`").cast("long")


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or with underscores added until no column in ``taken`` has that name (case ignored)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted
