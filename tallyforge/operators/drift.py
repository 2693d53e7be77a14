"""Drift over ordered periods: schemas, missingness, distributions, and their changes between neighbours."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import readings, safe_div
from ..spec import Spec, SpecError
from ..storage import Parts
from .periods import Periods
from .profile import LEVELS, NUMERIC, TEMPORAL, Profile

MEASURES = ("min", "q1", "mean", "median", "q3", "max", "iqr", "sd")
MAX_LEVELS = 50


class Drift(Parts):
    """The tables of a drift: schema, missingness, numeric, categorical and temporal by period, each also as _adjacent, and skipped."""


def longitudinal_drift(periods: Periods, spec: Spec, variables: list[str] | None = None, max_levels: int = MAX_LEVELS, assume_timezone: bool = False) -> Drift:
    """Variables that can be read alike in all periods are profiled in one scan of their union; the others are named in ``skipped``."""
    spec = spec.only(variables) if variables else spec
    spark, grid = periods.first.sparkSession, periods.grid()
    bound = {p: readings(df, spec, assume_timezone) for p, df in enumerate(periods.tables.values(), 1)}
    order = {v.name: i for i, v in enumerate(spec, 1)}
    schema_rows, skipped_rows = [], []
    for p, rs in bound.items():
        for r in rs:
            v = r.variable
            schema_rows.append((p, periods.labels[p - 1], order[v.name], v.name, v.analysis_type, v.database_type, r.observed_type, r.dtype is not None, "not_applicable" if r.dtype is None else r.status, r.reason))
            if not r.usable:
                skipped_rows.append((p, periods.labels[p - 1], order[v.name], v.name, "distribution", "absent" if r.dtype is None else "incompatible", r.reason))
            elif v.analysis_type == "text":
                skipped_rows.append((p, periods.labels[p - 1], order[v.name], v.name, "distribution", "unsupported_type", "texts have no distribution to compare"))
    good = [v for v in spec if any(next(r for r in rs if r.name == v.name).usable for rs in bound.values())]
    usable = {(p, r.name) for p, rs in bound.items() for r in rs if r.usable}

    # A column that a period lacks, or can't be read there, is null in the union and dropped again by (period, variable).
    types = {v.name: next(r.dtype for rs in bound.values() for r in rs if r.name == v.name and r.usable) for v in good}
    if periods.whole:
        rows = periods.stacked(lambda df: [F.col(f"`{v.name}`") for v in good]).select(F.col("p").cast("string").alias("\0p"), *[F.col(f"`{v.name}`") for v in good])
    else:
        parts = [df.select(F.lit(str(p)).alias("\0p"), *[(F.col(f"`{v.name}`") if (p, v.name) in usable else F.lit(None)).cast(types[v.name]).alias(v.name) for v in good]) for p, df in enumerate(periods.tables.values(), 1)]
        rows = reduce(DataFrame.unionByName, parts)
    # Written once: the periods are read again by each pass of the profile.
    profile = Profile(rows, Spec(tuple(good)), F.col("`\0p`"), assume_timezone, overall=False, kept=True)
    groups = [str(p) for p in bound]
    # Too many levels are refused here, not when the categorical part is read.
    profile.levels(max_levels)
    cells = [(p, periods.labels[p - 1], order[v.name], v.name, v.analysis_type, (p, v.name) in usable) for p in bound for v in spec]
    cell = F.broadcast(spark.createDataFrame(cells, "period_index int, period string, variable_index int, variable string, kind string, usable boolean"))
    state = [F.when(F.col("usable"), "available").otherwise("unavailable").alias("status"), F.when(~F.col("usable"), "the variable can't be read in this period").alias("reason")]
    own = lambda part: part.withColumn("period_index", F.col("g").try_cast("int")).withColumnRenamed("name", "variable")
    sizes = profile.cells.where("i = -1").select(F.col("g").try_cast("int").alias("period_index"), F.col("n").alias("rows"))

    basic = own(profile.cells.where("i >= 0").select("g", profile._name(F.col("i")).alias("name"), F.col("n_missing").alias("m")))
    held = cell.join(sizes, "period_index", "left").join(basic.select("period_index", "variable", "m"), ["period_index", "variable"], "left")
    n, m = F.coalesce("rows", F.lit(0)), F.when(F.col("usable"), F.coalesce("m", F.lit(0)))
    missingness = held.select("period_index", "period", "variable_index", "variable", n.alias("n"), m.alias("n_missing"), (n - m).alias("n_observed"), safe_div(m, n).alias("p_missing"), *state)
    absolute = F.col("p_missing_right") - F.col("p_missing_left")
    missing_adjacent = _adjacent(missingness, ["n", "n_missing", "n_observed", "p_missing"], suffix=True)
    missing_adjacent = missing_adjacent.select(*missing_adjacent.columns[:14], absolute.alias("absolute_change"), F.when(F.col("p_missing_left") > 0, absolute / F.col("p_missing_left")).alias("relative_change"), F.when(F.col("p_missing_left") > 0, F.col("p_missing_left")).alias("relative_denominator"), "status", "reason")

    gone = lambda c: F.when(F.col("usable"), F.col(c)).alias(c)

    @cache
    def numeric() -> DataFrame:
        stats = own(profile.numeric(groups)).select("period_index", "variable", "n", "n_missing", "n_observed", "n_infinite", "n_finite", *MEASURES)
        out = cell.where(F.col("kind").isin(*NUMERIC)).join(stats, ["period_index", "variable"], "left")
        return out.select("period_index", "period", "variable_index", "variable", *[gone(c) for c in ("n", "n_missing", "n_observed", "n_infinite", "n_finite", *MEASURES)], *state)

    def numeric_adjacent() -> DataFrame:
        na = _adjacent(numeric(), ["n_finite", *MEASURES])
        changes = [x for c in MEASURES for x in (F.col(f"left_{c}"), F.col(f"right_{c}"), (F.col(f"right_{c}") - F.col(f"left_{c}")).alias(f"{c}_change"))]
        return na.select(*na.columns[:6], "left_n_finite", "right_n_finite", *changes, "status", "reason")

    declared = F.coalesce(F.col("is_declared"), F.lit(False))

    @cache
    def by_level() -> DataFrame:
        levels = own(profile.categorical(groups, max_levels)).select("period_index", "variable", "level_order", "level", "n", "n_total", "n_observed", "p_total", "p_observed", "is_declared", "is_unexpected")
        return cell.where(F.col("kind").isin(*LEVELS) & F.col("usable")).join(levels, ["period_index", "variable"])

    # A period's domain is what is declared and what it holds; a pair's is the union of both.
    def categorical() -> DataFrame:
        return by_level().where(declared | (F.col("n") > 0)).select("period_index", "period", "variable_index", "variable", "level", "n", "p_total", "p_observed", "is_declared", "is_unexpected", *state)

    def categorical_adjacent() -> DataFrame:
        left, right = (by_level().select("variable_index", "variable", "level", "is_declared", "is_unexpected", F.col("period_index").alias(f"{s}_period_index"), F.col("period").alias(f"{s}_period"), *[F.col(a).alias(f"{s}_{b}") for a, b in (("n", "n"), ("n_total", "total_denominator"), ("p_total", "p_total"), ("n_observed", "observed_denominator"), ("p_observed", "p_observed"))]) for s in ("left", "right"))
        both = left.join(right.drop("variable", "is_declared", "is_unexpected"), ["variable_index", "level"]).where("right_period_index = left_period_index + 1")
        l, r = F.col("left_n") > 0, F.col("right_n") > 0
        status = F.when(l & r, "present_both").when(l, "removed").when(r, "introduced").otherwise("absent_both")
        return both.where(declared | l | r).select(
            "left_period_index", "left_period", "right_period_index", "right_period", "variable_index", "variable", "level", "left_n", "right_n", "left_total_denominator", "right_total_denominator", "left_p_total", "right_p_total", (F.col("right_p_total") - F.col("left_p_total")).alias("p_total_difference"),
            "left_observed_denominator", "right_observed_denominator", "left_p_observed", "right_p_observed", (F.col("right_p_observed") - F.col("left_p_observed")).alias("p_observed_difference"), "is_declared", "is_unexpected", status.alias("level_status"), F.lit("available").alias("status"), F.lit(None).cast("string").alias("reason"),
        )

    @cache
    def temporal_all() -> DataFrame:
        t = own(profile.temporal(groups)).select("period_index", "variable", "n", "n_missing", "n_observed", "min", "max", "min_number", "max_number", "range_value", F.col("range_unit").alias("unit"))
        return cell.where(F.col("kind").isin(*TEMPORAL)).join(t, ["period_index", "variable"], "left").select("period_index", "period", "variable_index", "variable", *[gone(c) for c in ("n", "n_missing", "n_observed", "min", "max", "min_number", "max_number", "range_value", "unit")], *state)

    def temporal_adjacent() -> DataFrame:
        ta = _adjacent(temporal_all(), ["min", "max", "min_number", "max_number", "range_value", "unit"])
        shifts = [x for c in ("min", "max") for x in (F.col(f"left_{c}"), F.col(f"right_{c}"), (F.col(f"right_{c}_number") - F.col(f"left_{c}_number")).alias(f"{c}_shift"))]
        return ta.select(*ta.columns[:6], *shifts, "left_range_value", "right_range_value", (F.col("right_range_value") - F.col("left_range_value")).alias("range_change"), F.coalesce("left_unit", "right_unit").alias("unit"), "status", "reason")

    schema = spark.createDataFrame(schema_rows, "period_index int, period string, variable_index int, variable string, analysis_type string, expected_database_type string, observed_type string, observed_present boolean, type_status string, type_reason string")
    skipped = spark.createDataFrame(skipped_rows, "period_index int, period string, variable_index int, variable string, component string, code string, message string")
    return Drift(
        schema=lambda: schema,
        missingness=lambda: missingness,
        missingness_adjacent=lambda: missing_adjacent,
        numeric=numeric,
        numeric_adjacent=numeric_adjacent,
        categorical=categorical,
        categorical_adjacent=categorical_adjacent,
        temporal=lambda: temporal_all().drop("min_number", "max_number"),
        temporal_adjacent=temporal_adjacent,
        skipped=lambda: skipped,
    )


def _adjacent(part: DataFrame, columns: list[str], suffix: bool = False) -> DataFrame:
    """Neighbouring periods side by side; the tables are one row for each period and variable."""

    def side(s: str) -> DataFrame:
        name = lambda c: f"{c}_{s}" if suffix else f"{s}_{c}"
        keep: list[Column] = [F.col(c).alias(name(c)) for c in columns]
        return part.select("variable_index", "variable", F.col("period_index").alias(f"{s}_period_index"), F.col("period").alias(f"{s}_period"), *keep, F.col("status").alias(f"{s}_status"))

    both = side("left").join(side("right").drop("variable"), "variable_index").where("right_period_index = left_period_index + 1")
    ok = (F.col("left_status") == "available") & (F.col("right_status") == "available")
    names = [f"{c}_{s}" for s in ("left", "right") for c in columns] if suffix else [f"{s}_{c}" for c in columns for s in ("left", "right")]
    return both.select("left_period_index", "left_period", "right_period_index", "right_period", "variable_index", "variable", *names, F.when(ok, "available").otherwise("unavailable").alias("status"), F.when(~ok, "the variable can't be read in both periods").alias("reason"))


def need_levels(spec: Spec, names: list[str]) -> None:
    for n in names:
        if spec[n].analysis_type not in LEVELS:
            raise SpecError("state variables must be categorical or binary")
