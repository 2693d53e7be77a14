"""Ordered periods as one table, and the entities' membership that longitudinal operators share."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import is_missing, quoted
from ..spec import SpecError, storage_family


def valid_entity(df: DataFrame, column: str) -> tuple[Column, Column, Column]:
    """(null, blank, valid) of an entity id; blank means spaces only, and only text can be blank."""
    x, dtype = quoted(column), df.schema[column].dataType
    null = is_missing(x, dtype)
    blank = ~null & (F.trim(x) == "") if storage_family(dtype) == "text" else F.lit(False)
    return null, blank, ~null & ~blank


@dataclass(frozen=True)
class Periods:
    """At least two named tables in time order."""

    tables: dict[str, DataFrame]
    #: (table, number of the period) where all are cut from one table: it is read once, not once for each of them
    whole: tuple[DataFrame, Column] | None = None

    def __post_init__(self) -> None:
        if len(self.tables) < 2:
            raise SpecError("at least two periods are needed")

    @property
    def labels(self) -> list[str]:
        return list(self.tables)

    @property
    def first(self) -> DataFrame:
        return next(iter(self.tables.values()))

    def stacked(self, columns) -> DataFrame:
        """Union of ``columns(df)`` (a list of Columns) over the periods, with the period's number p, from 1."""
        if self.whole:
            df, number = self.whole
            return df.select(number.alias("p"), *columns(df)).where("p > 0")
        parts = [df.select(F.lit(i).alias("p"), *columns(df)) for i, df in enumerate(self.tables.values(), 1)]
        return reduce(DataFrame.unionByName, parts)

    def grid(self) -> DataFrame:
        """(p, label), one row for each period."""
        spark = self.first.sparkSession
        return F.broadcast(spark.createDataFrame(list(enumerate(self.labels, 1)), "p int, label string"))

    def label(self, p: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.labels)), p.cast("int"))


def periods_by(df: DataFrame, column: Column, labels: dict[str, object]) -> Periods:
    """Periods cut from one table: label -> value of ``column``."""
    number = F.coalesce(F.array_position(F.array(*map(F.lit, labels.values())), column).cast("int"), F.lit(0))
    return Periods({k: df.where(column == F.lit(v)) for k, v in labels.items()}, (df, number))
