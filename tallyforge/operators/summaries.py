"""Typed summaries of a whole table: schema check, missingness, and the six components of a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import is_missing, quoted, readings, safe_div
from ..spec import Spec, storage_family
from ..storage import Parts, bounded
from .clean import distinct_up_to
from .profile import ALL, Profile

NUMERIC_COLUMNS = ["name", "n_finite", "sum", "min", "q1", "mean", "median", "q3", "max", "iqr", "sd", "variance", "sem", "cv", "skewness", "kurtosis", "shapiro_p", "lower_fence", "upper_fence", "n_below_lower", "n_above_upper", "outlier_count", "outlier_percentage"]
CATEGORICAL_COLUMNS = ["name", "level", "n", "p_total", "p_observed", "is_declared", "is_unexpected"]
TEXT_COLUMNS = ["name", "n", "n_missing", "n_observed", "n_unique", "n_empty", "n_whitespace", "min_length", "max_length"]
TEMPORAL_COLUMNS = ["name", "source_class", "timezone", "n", "n_missing", "n_observed", "n_unique", "min", "q1", "median", "q3", "max", "range_value", "range_unit"]
VARIABLES_SCHEMA = "name string, label string, type string, role string, required boolean, n long, n_missing long, n_observed long, n_unique long, n_infinite long, status string, reason string"
SKIPPED_SCHEMA = "name string, type string, observed_class string, reason string"


class Summaries(Parts):
    """The components of a profile: variables, numeric, categorical, text, temporal, skipped."""


def profile_summaries(df: DataFrame, spec: Spec, assume_timezone: bool = False, max_levels: int | None = None) -> Summaries:
    """All six components, each computed when it is asked for."""
    p = Profile(df, spec, None, assume_timezone)
    if max_levels is not None:
        p.levels(max_levels)
    return Summaries(
        variables=lambda: variables_component(p),
        numeric=lambda: p.numeric().select(*NUMERIC_COLUMNS),
        categorical=lambda: p.categorical(max_levels=max_levels).select(*CATEGORICAL_COLUMNS),
        text=lambda: p.text().select(*TEXT_COLUMNS),
        temporal=lambda: p.temporal().select(*TEMPORAL_COLUMNS),
        skipped=lambda: p.spark.createDataFrame([(r.name, r.variable.analysis_type, r.observed_type, r.reason) for r in p.readings if not r.usable], SKIPPED_SCHEMA),
    )


def variables_component(p: Profile) -> DataFrame:
    """One row for each variable of the specification, in its order."""
    basic = {r["name"]: r for r in p.basic.where(F.col("g") == ALL).collect()}
    total, rows = p.totals.get(ALL, 0), []
    for r in p.readings:
        v, b = r.variable, basic.get(r.name)
        head = (v.name, v.label or v.name, v.analysis_type, v.role, v.required)
        if not r.usable:
            rows.append((*head, total, None, None, None, None, "skipped", r.reason))
        elif b is not None and b["n_inexact"]:
            rows.append((*head, total, None, None, None, None, "skipped", "whole numbers exceed what a double holds exactly"))
        else:
            rows.append((*head, b["n"], b["n_missing"], b["n_observed"], b["n_unique"], b["n_infinite"], "summarised", None) if b is not None else (*head, 0, 0, 0, 0, 0, "summarised", None))
    return p.spark.createDataFrame(rows, VARIABLES_SCHEMA)


def schema_check(df: DataFrame, spec: Spec, assume_timezone: bool = False) -> DataFrame:
    """Declared against observed columns; columns that nobody declared come last.

    Checks that depend on values (levels of a coercible variable) are one aggregate over all of them.
    """
    bound = readings(df, spec, assume_timezone)
    checks = []
    for i, r in enumerate(bound):
        family = None if r.dtype is None else storage_family(r.dtype)
        if r.status == "coercible" and r.variable.levels and family in ("numeric", "integer", "text"):
            from ..contract import text_form

            checks.append(F.coalesce(F.bool_and(r.missing | text_form(r.column, r.dtype).isin(list(r.variable.levels))), F.lit(True)).alias(f"c{i}"))
        elif r.status == "incompatible" and r.variable.analysis_type == "integer" and family == "numeric":
            x = r.column.cast("double")
            checks.append(F.coalesce(F.bool_and(is_missing(r.column, r.dtype) | (F.abs(x) == float("inf")) | (x == F.floor(x))), F.lit(True)).alias(f"c{i}"))
    found = df.agg(*checks).first().asDict() if checks else {}
    rows = []
    for i, r in enumerate(bound):
        status, reason = r.status, r.reason
        if f"c{i}" in found:
            ok = found[f"c{i}"]
            status = "coercible" if ok else "incompatible"
            reason = r.reason if ok and r.status == "coercible" else "all values are whole" if ok else "some values don't fit the declaration"
        rows.append((r.name, r.variable.analysis_type, r.observed_type, True, r.dtype is not None, "missing" if r.dtype is None else "present", "not_applicable" if r.dtype is None else status, None if r.dtype is None else reason))
    declared = set(spec.names)
    rows += [(f.name, None, f.dataType.simpleString(), False, True, "unexpected", "not_applicable", None) for f in df.schema.fields if f.name not in declared]
    return df.sparkSession.createDataFrame(rows, "name string, expected_type string, observed_type string, expected_present boolean, observed_present boolean, status string, type_status string, type_reason string")


def profile_missing(df: DataFrame, spec: Spec) -> DataFrame:
    """(name, n, n_missing, p_missing) of every declared variable from one aggregate; nulls for absent columns."""
    bound = [r for r in readings(df, spec, True) if r.dtype is not None]

    def mask(r):
        try:
            return r.missing
        except ValueError:
            return is_missing(r.column, r.dtype)

    sums = [F.coalesce(F.sum(mask(r).cast("long")), F.lit(0)).alias(f"m{i}") for i, r in enumerate(bound)]
    pieces = [F.struct(F.lit(r.name).alias("name"), F.col("n"), F.col(f"m{i}").alias("n_missing"), safe_div(F.col(f"m{i}"), F.col("n")).alias("p_missing")) for i, r in enumerate(bound)]
    there = {r.name for r in bound}
    pieces += [F.struct(F.lit(v.name).alias("name"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("n_missing"), F.lit(None).cast("double").alias("p_missing")) for v in spec if v.name not in there]
    if not pieces:
        return df.sparkSession.createDataFrame([], "name string, n long, n_missing long, p_missing double")
    return df.agg(F.count(F.lit(1)).alias("n"), *sums).select(F.explode(F.array(*pieces)).alias("x")).select("x.*")


def identifier_profile(df: DataFrame, spec: Spec) -> DataFrame:
    """Distinct and repeated values of the identifier variables."""
    parts, rows = None, []
    for r in readings(df, spec, True):
        if not r.variable.is_identifier:
            continue
        if r.dtype is None or storage_family(r.dtype) == "other":
            rows.append((r.name, r.observed_type, None, None, None, None, None, None, None, "skipped", r.reason))
            continue
        key = df.select(F.when(~r.missing, r.column.cast("string")).alias("k"))
        by = key.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
        some = F.col("k").isNotNull()
        zero = lambda x: F.coalesce(x, F.lit(0))
        one = by.agg(
            zero(F.sum("c")).alias("n"), zero(F.sum(F.when(~some, F.col("c")))).alias("n_missing"), zero(F.sum(F.when(some, F.col("c")))).alias("n_observed"), F.count(F.when(some, 1)).alias("n_distinct"),
            F.count(F.when(some & (F.col("c") > 1), 1)).alias("n_repeated_values"), zero(F.sum(F.when(some, F.col("c") - 1))).alias("duplicate_excess"), zero(F.max(F.when(some, F.col("c")))).alias("max_frequency"),
        ).select(F.lit(r.name).alias("name"), F.lit(r.observed_type).alias("observed_type"), "*", F.lit("profiled").alias("status"), F.lit(None).cast("string").alias("reason"))
        parts = one if parts is None else parts.unionByName(one)
    schema = "name string, observed_type string, n long, n_missing long, n_observed long, n_distinct long, n_repeated_values long, duplicate_excess long, max_frequency long, status string, reason string"
    skipped = df.sparkSession.createDataFrame(rows, schema)
    return skipped if parts is None else parts.unionByName(skipped) if rows else parts


def frequencies(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """(rank, level, n): the ``top`` commonest levels, ties bytewise, and one row for what is left."""
    counted = df.where(quoted(column).isNotNull()).groupBy(quoted(column).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    # The commonest are found without sorting the others; only they are numbered.
    first = counted.orderBy(F.col("n").desc(), "level").limit(top)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "level")))
    rest = counted.join(F.broadcast(first.select("level")), "level", "left_anti").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where("k > 0")
    return ranked.select("rank", "level", "n").unionByName(rest.select(F.lit(top + 1).alias("rank"), F.concat(F.lit("Other ("), F.col("k").cast("string"), F.lit(" levels)")).alias("level"), "n"))


def plot_data(df: DataFrame, spec: Spec, assume_timezone: bool = False, top: int = 20) -> dict[str, DataFrame]:
    """Data for plots: histogram bins, box summaries and the commonest levels."""
    p = Profile(df, spec, None, assume_timezone)
    out = {"histogram": p.histogram(), "box": p.numeric().select("name", "min", "q1", "median", "q3", "max", "lower_fence", "upper_fence")}
    parts = [frequencies(df, r.name, top).select(F.lit(r.name).alias("name"), "*") for r in p.usable if r.variable.analysis_type in ("categorical", "binary")]
    for part in parts:
        out["frequency"] = part if "frequency" not in out else out["frequency"].unionByName(part)
    return out


def catalogue_profile(df: DataFrame, columns: list[str], max_levels: int = 50) -> DataFrame:
    """(column, value, n, n_missing) of columns with at most ``max_levels`` distinct values; refuses larger ones before any is listed."""
    counts = df.agg(*[F.coalesce(F.sum(quoted(c).isNull().cast("long")), F.lit(0)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    held = distinct_up_to(df, columns, max_levels + 2)
    if any(held[c] - (counts[f"m{i}"] > 0) > max_levels for i, c in enumerate(columns)):
        raise ValueError(f"a column has more than {max_levels} distinct values")
    rows = []
    for i, c in enumerate(columns):
        got = bounded(df.where(quoted(c).isNotNull()).groupBy(quoted(c).cast("string").alias("value")).count().orderBy("value"), max_levels)
        rows += [(c, r["value"], r["count"], counts[f"m{i}"]) for r in got]
    return df.sparkSession.createDataFrame(rows, "column string, value string, n long, n_missing long")
