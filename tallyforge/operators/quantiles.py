"""Exact type-7 quantiles without a large task and without moving values.

The interval of each wanted rank is cut into cells that are counted, with partial
aggregation, so that only counts are shuffled; the cell that holds the rank, narrowed
to the values that are there, is the next interval.  An interval of few values is
counted value by value.  Two or three passes do for any number of rows that are spread
evenly; where a pass hardly narrows an interval (values of very different magnitude)
the next one cuts it by magnitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import bounded, materialised

CELLS = 2048
#: Rows of an interval that are counted value by value.
FEW = 4096
#: Intervals that the driver keeps: a few for each combination of the keys.
MOST = 2_000_000


def _magnitude(v: Column) -> Column:
    """Grows with v, evenly in the digits of large and small numbers."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    # Halves, since the difference of two doubles may be none.
    even = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    low, high = _magnitude(lo), _magnitude(hi)
    by_size = F.when(high > low, (_magnitude(v) - low) / (high - low)).otherwise(even)
    share = F.when(F.col("sizes"), by_size).otherwise(even)
    return F.when(F.col("held") <= FEW, v).otherwise(F.least(F.lit(float(CELLS - 1)), F.floor(share * CELLS).cast("double")))


def quantiles(values: DataFrame, keys: list[str], probs: tuple[float, ...] = (0.25, 0.5, 0.75), base: DataFrame | None = None) -> DataFrame:
    """(keys, q): ``values`` has the keys (never null), ``v`` (finite double) and ``c`` (how often); q is an array in the order of ``probs``.

    ``base`` is (keys, n, lo, hi) where that is known already.  The keys' combinations are few.
    """
    if base is None:
        base = materialised(values.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-bounds")
    spark, k = values.sparkSession, len(keys)
    place = lambda n, p: (n - 1) * p
    kinds = T.StructType([*(base.schema[c] for c in keys), *(T.StructField(c, t) for c, t in (("before", T.LongType()), ("lo", T.DoubleType()), ("hi", T.DoubleType()), ("held", T.LongType()), ("sizes", T.BooleanType()), ("ranks", T.ArrayType(T.LongType()))))])
    bases = bounded(base.select(*keys, "n", "lo", "hi").where("n > 0"), MOST, "the table of quantiles")
    totals = {tuple(r[:k]): r["n"] for r in bases}
    at: dict[tuple, dict[int, float]] = {x: {} for x in totals}
    # Intervals: how many smaller values there are, their ends, the values in them, how to cut them and the ranks that are looked for.
    going = [(*r[:k], 0, r["lo"], r["hi"], r["n"], False, sorted({f(place(r["n"], p)) for p in probs for f in (math.floor, math.ceil)})) for r in bases]
    while going:
        for x in going:
            if x[k + 1] == x[k + 2]:
                at[x[:k]] |= dict.fromkeys(x[k + 5], x[k + 1])
        going = [x for x in going if x[k + 1] < x[k + 2]]
        if not going:
            break
        intervals = spark.createDataFrame(going, kinds)
        inside = values.join(F.broadcast(intervals.drop("ranks")), keys).where("v >= lo and v <= hi").withColumn("cell", _cell(F.col("v"), F.col("lo"), F.col("hi")))
        cells = inside.groupBy(*keys, "before", "cell").agg(F.sum("c").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        cells = cells.withColumn("upto", F.col("before") + F.sum("m").over(Window.partitionBy(*keys, "before").orderBy("cell")))
        mine = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("m")))
        met = cells.join(F.broadcast(intervals), [*keys, "before"]).select(*keys, (F.col("upto") - F.col("m")).alias("before"), "least", "most", F.col("m").cast("long"), (F.col("m") * 16 > F.col("held")).alias("sizes"), mine.alias("ranks")).where("size(ranks) > 0")
        going = [tuple(r) for r in bounded(met, MOST, "the table of quantiles")]
    out = []
    for x, n in totals.items():
        q = []
        for p in probs:
            h = place(n, p)
            low, high = at[x][math.floor(h)], at[x][math.ceil(h)]
            q.append(low + (high - low) * (h - math.floor(h)))
        out.append((*x, q))
    return spark.createDataFrame(out, T.StructType([*(base.schema[c] for c in keys), T.StructField("q", T.ArrayType(T.DoubleType()))]))
