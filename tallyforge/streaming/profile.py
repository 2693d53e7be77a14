"""Counts of a stream by event-time window: rows, missing values and sums of chosen columns, late rows left out by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import is_missing, quoted
from ..spec import storage_family


def windowed_counts(stream: DataFrame, time_col: str, columns: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, n, and for each column n_missing and, of numbers, the finite sum); works on streams and tables alike."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        x, dtype = quoted(c), stream.schema[c].dataType
        gone = is_missing(x, dtype)
        aggs.append(F.sum(gone.cast("long")).alias(f"{c}_n_missing"))
        if storage_family(dtype) in ("numeric", "integer"):
            d = x.cast("double")
            aggs.append(F.sum(F.when(~gone & (F.abs(d) < float("inf")), d)).alias(f"{c}_sum"))
    marked = stream.withWatermark(time_col, late) if stream.isStreaming else stream
    return marked.groupBy(F.window(quoted(time_col), window).alias("w")).agg(*aggs).select(F.col("w.start").alias("window_start"), "n", *[f"{c}_n_missing" for c in columns], *[f"{c}_sum" for c in columns if storage_family(stream.schema[c].dataType) in ("numeric", "integer")])
