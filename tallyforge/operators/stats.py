"""Descriptive statistics of columns by kind, contingency tables and correlations."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import BLANKS, number_form, quoted, safe_div, text_form
from ..functions.pvalues import chi_square, correlation_p, fisher_2x2
from ..storage import bounded, materialised, small_join
from .clean import distinct_up_to, is_date, is_numeric, is_text
from .profile import numeric_statistics
from .quantiles import quantiles


def stats_numeric(df: DataFrame, columns: list[str] | None = None, coef: float = 1.5, na_rm: bool = True) -> DataFrame:
    """The numeric core of each numeric column.  With ``na_rm`` false a column with missing values keeps its counts only."""
    columns = columns or [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    number = lambda c: quoted(c).cast("double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), number(c).alias("v")) for c in columns])).alias("e")).select("e.*")
    counted = long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("c"))
    gone = F.col("v").isNull() | F.isnan("v")
    infinite = ~gone & (F.abs("v") == float("inf"))
    held = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    sizes = counted.groupBy("name").agg(F.sum("c").alias("n"), held(gone).alias("n_missing"), held(~gone).alias("n_observed"), held(infinite).alias("n_infinite"))
    core = numeric_statistics(counted.where(~gone & ~infinite), ["name"], coef)
    out = sizes.join(core, "name", "left").withColumn("n_finite", F.coalesce("n_finite", F.lit(0)))
    if not na_rm:
        keep = ("name", "n", "n_missing", "n_observed", "n_infinite", "n_finite")
        out = out.select(*[c if c in keep else F.when(F.col("n_missing") == 0, F.col(c)).alias(c) for c in out.columns])
    return out


def count_outliers(df: DataFrame, column: str, coef: float = 1.5) -> DataFrame:
    """(column, n_outliers): finite values beyond Tukey's fences; 0 for an empty column or coef 0."""
    one = stats_numeric(df, [column], coef).select(F.lit(column).alias("column"), F.coalesce("outlier_count", F.lit(0)).cast("long").alias("n_outliers"))
    return one.unionByName(df.sparkSession.createDataFrame([(column, 0)], "column string, n_outliers long")).groupBy("column").agg(F.max("n_outliers").alias("n_outliers"))


def stats_text(df: DataFrame) -> DataFrame:
    """For each text column: missing, completeness, lengths, empty, distinct and blank values."""
    columns = [f.name for f in df.schema.fields if is_text(f.dataType)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.sha2(quoted(c), 256).alias("h"), F.char_length(quoted(c)).alias("len"), F.when(quoted(c) == "", 1).when(F.btrim(quoted(c), F.lit(BLANKS)) == "", 2).otherwise(0).alias("kind")) for c in columns])).alias("e")).select("e.*")
    # One row for each distinct value of a column; bodies stay where they are.
    by = long.groupBy("variable", "h", "len", "kind").agg(F.count(F.lit(1)).alias("c"))
    some = F.col("h").isNotNull()
    held = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    return by.groupBy("variable").agg(
        held(~some).alias("n_missing"), safe_div(held(some), F.sum("c")).alias("complete_rate"), F.min("len").cast("long").alias("min_length"), F.max("len").cast("long").alias("max_length"), held(some & (F.col("kind") == 1)).alias("empty"), F.count(F.when(some, 1)).alias("n_unique"), held(some & (F.col("kind") == 2)).alias("whitespace")
    )


def _level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), text_form(quoted(c), df.schema[c].dataType).alias("level")) for c in columns])).alias("e")).select("e.*")
    return long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))


def stats_categories(df: DataFrame, columns: list[str], ordered: dict[str, list[str]] | None = None) -> DataFrame:
    """For each categorical column: missing, completeness, whether its levels are ordered, distinct levels and the three commonest."""
    ordered = ordered or {}
    counts = _level_counts(df, columns)
    place = F.lit(0)
    for c, levels in ordered.items():
        place = F.when(F.col("variable") == c, F.array_position(F.array(*map(F.lit, levels)), F.col("level"))).otherwise(place)
    rank = F.row_number().over(Window.partitionBy("variable").orderBy(F.col("level").isNull(), F.col("n").desc(), place, "level"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("r") <= 3) & F.col("level").isNotNull(), F.struct("r", F.concat("level", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))))), lambda x: x["t"]), ", ")
    gone = F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))), F.lit(0))
    return counts.withColumn("r", rank).groupBy("variable").agg(gone.alias("n_missing"), safe_div(F.sum("n") - gone, F.sum("n")).alias("complete_rate"), F.count("level").alias("n_unique"), top.alias("top_counts")).select("variable", "n_missing", "complete_rate", F.col("variable").isin(list(ordered) or [""]).alias("ordered"), "n_unique", "top_counts")


def category_table(df: DataFrame, columns: list[str], levels: dict[str, list[str]] | None = None) -> DataFrame:
    """(variable, level, n) with a row for missing values where there are any; declared levels stay at 0."""
    counts = _level_counts(df, columns)
    if not levels:
        return counts
    grid = df.sparkSession.createDataFrame([(v, x) for v, ls in levels.items() for x in ls], "variable string, level string")
    return counts.unionByName(grid.withColumn("n", F.lit(0).cast("long"))).groupBy("variable", "level").agg(F.sum("n").alias("n"))


def stats_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Eleven statistics of each date or timestamp column in long form (column, statistic, value)."""
    columns = columns or [f.name for f in df.schema.fields if is_date(f.dataType)]
    kinds = {c: isinstance(df.schema[c].dataType, T.DateType) for c in columns}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("day"), number_form(quoted(c), df.schema[c].dataType).alias("v")) for c in columns])).alias("e")).select("e.*")
    counts = long.groupBy("column", "day", "v").agg(F.count(F.lit(1)).alias("c"))
    some = F.col("v").isNotNull()
    base = counts.groupBy("column", "day").agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(~some, F.col("c"))), F.lit(0)).alias("n_missing"), F.count("v").alias("n_unique"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.when(some, F.struct("c", (-F.col("v")).alias("m")))).alias("top"),
    )
    got = base.join(quantiles(counts.where(some), ["column"]), "column", "left")

    def shown(x):
        return F.when(F.col("day"), F.date_format(F.date_from_unix_date(F.floor(x).cast("int")), "yyyy-MM-dd")).otherwise(F.date_format(F.timestamp_seconds(F.floor(x)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))

    days = lambda x: F.when(F.col("day"), x).otherwise(x / 86400)
    q = F.col("q")
    items = [("N", F.col("n").cast("string")), ("N Missing", F.col("n_missing").cast("string")), ("N Unique", F.col("n_unique").cast("string")), ("Min", shown(F.col("lo"))), ("25%", shown(q[0])), ("Median", shown(q[1])), ("75%", shown(q[2])), ("Max", shown(F.col("hi"))), ("IQR", F.format_string("%.6f", days(q[2] - q[0]))), ("Most Common", shown(-F.col("top")["m"])), ("Range (Days)", F.format_string("%.6f", days(F.col("hi") - F.col("lo"))))]
    return got.select("column", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(n).alias("statistic"), F.when(F.lit(n).isin("IQR", "Range (Days)") & F.col("lo").isNull(), None).otherwise(v).alias("value")) for i, (n, v) in enumerate(items)])).alias("e")).select("column", "e.statistic", "e.value")


def stats_dates_wide(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each date column, a column for each statistic."""
    names = ["N", "N Missing", "N Unique", "Min", "25%", "Median", "75%", "Max", "IQR", "Most Common", "Range (Days)"]
    return stats_dates(df, columns).groupBy("column").pivot("statistic", names).agg(F.first("value"))


def date_gaps(df: DataFrame, column: str) -> DataFrame:
    """(gap_days, n): differences of consecutive sorted dates.

    Equal days give gaps of 0 without being sorted; only the distinct days, few however
    many rows there are, meet in one task.
    """
    days = df.where(quoted(column).isNotNull()).groupBy(quoted(column).cast("date").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    steps = days.select("c", F.datediff("d", F.lag("d").over(Window.orderBy("d"))).alias("gap_days"))
    both = steps.where("gap_days is not null").select("gap_days", F.lit(1).cast("long").alias("n")).unionByName(steps.where("c > 1").select(F.lit(0).alias("gap_days"), (F.col("c") - 1).alias("n")))
    return both.groupBy("gap_days").agg(F.sum("n").alias("n"))


def date_months(df: DataFrame, column: str) -> DataFrame:
    """(month, n) of a date column."""
    x = quoted(column)
    return df.where(x.isNotNull()).groupBy(F.date_format(x, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def summary_by_class(df: DataFrame, codes: list[str], class_type: str = "text", action: str = "exclude") -> DataFrame:
    """Level counts (text) or numeric statistics of a class of columns, without the codes or for the codes only."""
    wanted = is_text if class_type == "text" else is_numeric if class_type == "numeric" else is_date
    columns = [f.name for f in df.schema.fields if wanted(f.dataType)]
    hit = lambda c: F.coalesce(quoted(c).cast("string").isin(codes), F.lit(False)) if codes else F.lit(False)
    kept = df.select(*[F.when(hit(c) if action == "codes_only" else ~hit(c), quoted(c)).alias(c) for c in columns])
    if class_type == "numeric":
        return stats_numeric(kept, columns)
    return _level_counts(kept, columns).where("level is not null").select(F.col("variable").alias("id"), F.col("level").alias("x"), "n")


def tidy_counts(counts: DataFrame, n_rows: int, levels: list[str] | None = None, most: int = 500) -> DataFrame:
    """(id, x, n) rows spread wide, with row sums and their percentage of ``n_rows``."""
    levels = levels or sorted(r[0] for r in bounded(counts.select("x").distinct().where("x is not null"), most, "the spread"))
    wide = counts.groupBy("id").pivot("x", levels).agg(F.sum("n"))
    total = sum((F.coalesce(quoted(x), F.lit(0)) for x in levels), F.lit(0))
    return wide.withColumn("row_sums", total.cast("long")).withColumn("percent", F.col("row_sums") / F.lit(float(n_rows)) * 100)


def outcome_proportion(df: DataFrame, outcome: str, window_col: str, window: object, digits: int = 4) -> DataFrame:
    """Share of outcome 1 among the rows of one window; missing or other outcomes are an error."""
    rows = df.where(quoted(window_col) == F.lit(window))
    x = quoted(outcome).cast("double")
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((x.isNull() | ~x.isin(0.0, 1.0)).cast("int")), F.lit(0)).alias("bad"), F.sum(x).cast("long").alias("k"))
    if got.first()["bad"]:
        raise ValueError("outcomes must be 0 or 1 and not missing")
    return got.select(F.col("n").alias("n_at_risk"), F.coalesce("k", F.lit(0)).alias("n_outcome"), F.round(safe_div(F.col("k"), F.col("n")), digits).alias("proportion"))


def contingency(df: DataFrame, x: str, y: str, most: int = 1000) -> DataFrame:
    """(x, y, n) of all pairs of levels, also those that nobody has; missing values take no part."""
    counts = df.where(quoted(x).isNotNull() & quoted(y).isNotNull()).groupBy(quoted(x).cast("string").alias("x"), quoted(y).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    # The levels are read off the counts, a table of at most ``most`` levels a side.
    left, right = counts.select("x").distinct(), counts.select("y").distinct()
    bounded(left, most, "the rows of a contingency table")
    bounded(right, most, "the columns of a contingency table")
    return F.broadcast(left).crossJoin(F.broadcast(right)).join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"))


def contingency_tables(df: DataFrame, x: str, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """A table against each other column, its second column named after that."""
    return {c: contingency(df, x, c).withColumnsRenamed({"x": x, "y": c}) for c in columns or [c for c in df.columns if c != x]}


def testable_columns(df: DataFrame, least: int = 2) -> list[str]:
    """Columns with at least ``least`` distinct values; null counts as one."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    held = distinct_up_to(df, plain, least)
    return [c for c in plain if held[c] >= least]


def contingency_test(df: DataFrame, x: str, y: str, test: str = "fisher") -> DataFrame:
    """p-value of independence: Fisher's exact test of a 2 x 2 table, whatever its counts; chi-square if asked for, and for tables of more rows or columns."""
    rows = contingency(df, x, y).collect()
    xs, ys = sorted({r["x"] for r in rows}), sorted({r["y"] for r in rows})
    t = np.zeros((len(xs), len(ys)))
    for r in rows:
        t[xs.index(r["x"]), ys.index(r["y"])] = r["n"]
    if test not in ("fisher", "chisq"):
        raise ValueError("the test is fisher or chisq")
    if test == "fisher" and t.shape == (2, 2):
        out = (y, "fisher", None, None, fisher_2x2(t))
    else:
        stat, dof, p = chi_square(t)
        out = (y, "chisq", stat, dof, p)
    return df.sparkSession.createDataFrame([out], "variable string, method string, statistic double, parameter int, p_value double")


def contingency_tests(df: DataFrame, x: str, columns: list[str] | None = None, test: str = "fisher") -> DataFrame:
    out = None
    for c in columns or [c for c in testable_columns(df) if c != x]:
        one = contingency_test(df, x, c, test)
        out = one if out is None else out.unionByName(one)
    return out


def contingency_nxn(df: DataFrame, dependent: str, independent: list[str], always: tuple[str, ...] = ("Yes", "No"), most: int = 1000) -> DataFrame:
    """Counts of the dependent variable's levels for all combinations of the others' levels, with totals and percentages."""
    names = [*independent, dependent]
    counts = df.where(" and ".join(f"`{c}` is not null" for c in names)).groupBy(*[quoted(c).cast("string").alias(c) for c in names]).agg(F.count(F.lit(1)).alias("_n"))
    sides = [counts.select(quoted(c)).distinct() for c in independent]
    for s in sides:
        bounded(s, most, "the levels of a variable")
    grid = sides[0]
    for s in sides[1:]:
        grid = grid.crossJoin(F.broadcast(s))
    found = sorted(r[0] for r in bounded(counts.select(quoted(dependent)).distinct(), most, "the dependent variable"))
    levels = [*found, *[a for a in always if a not in found]]
    wide = grid.join(counts.groupBy(*map(quoted, independent)).pivot(dependent, levels).agg(F.sum("_n")), independent, "left").fillna(0, subset=levels)
    total = sum((quoted(x) for x in levels), F.lit(0))
    wide = wide.withColumn("total", total.cast("long"))
    return wide.withColumns({f"perc_{x}": F.round(safe_div(quoted(x) * 100, F.col("total")), 2) for x in levels})


def correlations(df: DataFrame, columns: list[str], method: str = "spearman") -> DataFrame:
    """(var1, var2, r, n, p) of all pairs, the diagonal included, over the rows in which both are observed.

    Spearman's needs ranks among the rows of each pair.  They come from the pair's value
    counts: a value's mean rank is the number of smaller ones plus half its own and a half.
    A column with itself is counted only; of two columns the one with fewer values comes
    second, so that its ranks are mostly few enough to be broadcast.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError("the method is spearman or pearson")
    pairs = list(combinations_with_replacement(columns, 2))
    good = lambda c: quoted(c).cast("double")
    ok = lambda c: quoted(c).isNotNull() & ~F.isnan(good(c))
    if method == "pearson":
        both = lambda a, b: ok(a) & ok(b)
        got = df.agg(*[F.corr(F.when(both(a, b), good(a)), F.when(both(a, b), good(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(both(a, b).cast("long")).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]).first()
        rows = [(a, b, got[f"r{i}"], got[f"n{i}"]) for i, (a, b) in enumerate(pairs)]
    else:
        known = df.agg(*[F.sum(ok(c).cast("long")).alias(f"n{j}") for j, c in enumerate(columns)], *[F.approx_count_distinct(F.when(ok(c), good(c))).alias(f"d{j}") for j, c in enumerate(columns)]).first()
        rows_of, values_of = ({c: known[f"{p}{j}"] or 0 for j, c in enumerate(columns)} for p in "nd")
        crossed = [(i, *sorted((a, b), key=lambda c: -values_of[c])) for i, (a, b) in enumerate(pairs) if a != b]
        items = [F.when(ok(a) & ok(b), F.struct(F.lit(i).alias("k"), good(a).alias("a"), good(b).alias("b"))) for i, a, b in crossed] or [F.lit(None).cast("struct<k:int,a:double,b:double>")]
        wide = df.select(F.explode(F.array(*items)).alias("e")).where("e is not null").select("e.*")
        joint = materialised(wide.groupBy("k", "a", "b").agg(F.count(F.lit(1)).alias("c")), "rank-pairs")

        def ranks(side: str) -> tuple[DataFrame, int]:
            # Ranges of values, their sizes, and a running sum within each: no task has all values of a pair.
            by = joint.groupBy("k", side).agg(F.sum("c").alias("m"))
            ranged = materialised(by.repartitionByRange("k", side).withColumn("_p", F.spark_partition_id()), "rank-ranges")
            before = ranged.groupBy("k", "_p").agg(F.sum("m").alias("t")).withColumn("before", F.sum("t").over(Window.partitionBy("k").orderBy("_p")) - F.col("t"))
            upto = F.sum("m").over(Window.partitionBy("k", "_p").orderBy(side))
            return ranged.join(F.broadcast(before.drop("t")), ["k", "_p"]).select("k", side, (F.col("before") + upto - (F.col("m") - 1) / 2).alias(f"r_{side}")), ranged.count()

        (left, n_left), (right, n_right) = ranks("a"), ranks("b")
        ranked = small_join(small_join(joint, right, ["k", "b"], "inner", n_right), left, ["k", "a"], "inner", n_left)
        x, y, c = F.col("r_a"), F.col("r_b"), F.col("c")
        sums = ranked.groupBy("k").agg(F.sum("c").alias("n"), *[F.sum(e * c).alias(s) for e, s in ((x, "x"), (y, "y"), (x * x, "xx"), (y * y, "yy"), (x * y, "xy"))])
        r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt((F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n")))
        by_k = {z["k"]: (z["r"], z["n"]) for z in sums.select("k", "n", F.when((F.col("xx") > F.col("x") * F.col("x") / F.col("n")) & (F.col("yy") > F.col("y") * F.col("y") / F.col("n")), r).alias("r")).collect()}
        rows = [(a, b, *(by_k.get(i, (None, 0)) if a != b else (None, rows_of[a]))) for i, (a, b) in enumerate(pairs)]
    full = [(a, b, 1.0 if a == b and n else r, n, None if a == b else correlation_p(r, n)) for a, b, r, n in rows]
    full += [(b, a, r, n, p) for a, b, r, n, p in full if a != b]
    return df.sparkSession.createDataFrame(full, "var1 string, var2 string, r double, n long, p double")


def lower_triangle(melted: DataFrame, order: list[str]) -> DataFrame:
    """Pairs with the second variable not after the first, nulls dropped."""
    at = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    return melted.where((at("var1") >= at("var2")) & F.col("r").isNotNull())


def relabelled(melted: DataFrame, labels: dict[str, str], digits: int = 2) -> DataFrame:
    """Labels for variable names, and rounded numbers."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    named = lambda c: F.coalesce(m[F.col(c)], F.col(c)).alias(c)
    return melted.select(named("var1"), named("var2"), F.round("r", digits).alias("r"), "n", F.round("p", digits).alias("p"))


def kaplan_meier(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    """(group, time, n_risk, n_event, n_censor, surv): the product-limit estimate at each time."""
    key = F.lit("") if group is None else quoted(group).cast("string")
    at = df.where(quoted(time).isNotNull() & quoted(event).isNotNull()).groupBy(key.alias("group"), quoted(time).cast("double").alias("time")).agg(F.sum((quoted(event).cast("int") == 1).cast("long")).alias("n_event"), F.count(F.lit(1)).alias("k"))
    later = Window.partitionBy("group").orderBy(F.col("time").desc())
    so_far = Window.partitionBy("group").orderBy("time")
    risk = at.withColumn("n_risk", F.sum("k").over(later))
    step = F.when(F.col("n_event") < F.col("n_risk"), F.log(1 - F.col("n_event") / F.col("n_risk"))).otherwise(F.lit(-1e300))
    return risk.select("group", "time", "n_risk", "n_event", (F.col("k") - F.col("n_event")).alias("n_censor"), F.exp(F.greatest(F.sum(step).over(so_far), F.lit(-1e300))).alias("surv"))
