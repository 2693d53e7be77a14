"""Where intermediate tables go: the cluster's shared folder, so that lost executors cost no recomputation of a whole plan.

The folder is the one that ``spark.checkpoint.dir`` names; only where that is unset (tests, a laptop) one is made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _MADE:
        _MADE[key] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return _MADE[key]


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside are deleted at the end, from whatever file system the folder is on.

    Only for results that are rows by then: a DataFrame that still reads the tables would fail.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCRATCH.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: later passes read a narrow table instead of the input."""
    path = f"{shared_folder(df.sparkSession)}/tallyforge/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Parts:
    """Named tables, each made when it is first asked for, so that a part costs nothing to those who want another; its repr shows no value."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self.__dict__["_makers"] = makers

    def __getattr__(self, name: str) -> DataFrame:
        makers = self.__dict__.get("_makers", {})
        if name not in makers:
            raise AttributeError(name)
        self.__dict__[name] = made = makers[name]()
        return made

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(self._makers)})"


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int, most: int = 200_000) -> DataFrame:
    """A join with a side of ``rows`` rows: broadcast up to ``most``, shuffled beyond."""
    return big.join(F.broadcast(small) if rows <= most else small, on, how)


class TooManyRows(ValueError):
    """A bounded result would have been larger than its bound; nothing was truncated."""


def bounded(df: DataFrame, most: int, what: str = "the result") -> list:
    """At most ``most`` rows on the driver; raises instead of truncating."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooManyRows(f"{what} has more than {most} rows")
    return rows
