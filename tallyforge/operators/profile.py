"""Typed summaries of a table, whole or by group.

One aggregate, with a row for each group and no shuffle of values, gives counts, sums
and extremes of all variables; it is unpivoted into a small table of cells (group,
variable).  Everything else is done only if it is asked for: quantiles by counted cells,
central moments and fences by one more pass, numbers of distinct values and levels variable
by variable, each reading its own column.  Texts are told apart by SHA-256 and length,
so their bodies never travel.  Overall is merged from the groups' cells.
"""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import BLANKS, EXACT, Reading, is_infinite, number_form, readings, safe_div, text_form
from ..functions.pvalues import shapiro_wilk
from ..spec import Spec
from ..storage import bounded, materialised
from .quantiles import quantiles

ALL = "\0all"
ROWS = "\0rows"
NUMERIC, LEVELS, TEMPORAL = ("numeric", "integer"), ("categorical", "binary"), ("date", "datetime")
#: Variables of one aggregate: generated code has a size that the JVM still compiles.
TOGETHER = 16
#: Levels of all categorical variables together; a profile with more fails, nothing is cut.
MAX_LEVELS = 100_000
_CELL = ["n_missing", "n_infinite", "n_inexact", "n_finite", "sum", "lo", "hi", "n_empty", "n_blank", "min_length", "max_length"]


def _columns(i: int, r: Reading) -> list[Column]:
    """What the passes read of variable i: m (missing), v (number), k (state), h (hash), l (level)."""
    kind, x, name = r.variable.analysis_type, r.column, lambda c: f"{c}{i}"
    out = [r.missing.alias(name("m"))]
    if kind == "text":
        blank = F.btrim(x, F.lit(BLANKS)) == ""
        out += [F.when(~r.missing, F.when(x == "", 1).when(blank, 2).otherwise(0)).alias(name("k")), F.when(~r.missing, F.char_length(x)).alias(name("v")), F.when(~r.missing, F.sha2(x, 256)).alias(name("h"))]
    elif kind in LEVELS:
        out += [F.when(~r.missing, text_form(x, r.dtype)).alias(name("l"))]
    else:
        num = number_form(x, r.dtype)
        # Whole numbers that a double does not hold are counted apart and make the variable unusable.
        lossy = F.abs(x.cast("decimal(20,0)")) > EXACT if kind == "integer" else F.lit(False)
        infinite = is_infinite(num) if kind in NUMERIC else F.lit(False)
        out += [F.when(r.missing, 0).when(lossy, 1).when(infinite, 2).otherwise(3).alias(name("k"))]
        out += [F.when(~r.missing & ~lossy & ~infinite, num).alias(name("v")), F.when(~r.missing, x if kind == "integer" else num).alias(name("h"))]
    return out


def _aggregates(i: int, r: Reading) -> list[Column]:
    kind, col = r.variable.analysis_type, lambda c: F.col(f"{c}{i}")
    out: dict[str, Column] = {"n_missing": F.count_if(col("m"))}
    if kind == "text":
        out |= {"n_empty": F.count_if(col("k") == 1), "n_blank": F.count_if(col("k") == 2), "min_length": F.min(col("v")).cast("long"), "max_length": F.max(col("v")).cast("long")}
    elif kind not in LEVELS:
        v = col("v")
        out |= {"n_finite": F.count(v), "lo": F.min(v), "hi": F.max(v)}
        if kind in NUMERIC:
            out |= {"n_infinite": F.count_if(col("k") == 2), "n_inexact": F.count_if(col("k") == 1), "sum": F.sum(v)}
    return [x.alias(f"{c}_{i}") for c, x in out.items()]


class Profile:
    """Summaries of a table, whole or by group.  ``group`` is a string column; its nulls are left out.

    With ``kept`` the columns that the passes read are written first, for tables that are costly to read again.
    """

    def __init__(self, df: DataFrame, spec: Spec, group: Column | None = None, assume_timezone: bool = False, overall: bool = True, kept: bool = False):
        self.spark, self.spec, self.grouped = df.sparkSession, spec, group is not None
        self.overall = self.grouped and overall
        self._numeric: dict[tuple[str, ...], DataFrame] = {}
        self._quartiles: dict[tuple[str, ...], DataFrame] = {}
        self.readings = readings(df, spec, assume_timezone)
        self.usable = [r for r in self.readings if r.usable]
        #: of values: without groups no text is part of a key
        self.keys = ["g", "i"] if self.grouped else ["i"]
        key = F.lit(ALL) if group is None else group
        self.rows = df.select(key.alias("g"), *(c for i, r in enumerate(self.usable) for c in _columns(i, r))).where("g is not null")
        if kept:
            self.rows = materialised(self.rows, "profile-rows")

    def _numbers(self, kinds: tuple[str, ...]) -> list[int]:
        return [i for i, r in enumerate(self.usable) if r.variable.analysis_type in kinds]

    def _name(self, i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(r.name) for r in self.usable] or [F.lit("")]), i + 1)

    @cached_property
    def cells(self) -> DataFrame:
        """(g, i, n and _CELL) of each group and usable variable, and the group's size under i = -1; written once."""
        types = {c: "double" if c in ("sum", "lo", "hi") else "long" for c in _CELL}
        parts = []
        for first in range(0, max(1, len(self.usable)), TOGETHER):
            chunk = list(enumerate(self.usable))[first : first + TOGETHER]
            wide = self.rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(a for i, r in chunk for a in _aggregates(i, r)))
            have = set(wide.columns)
            items = [F.struct(F.lit(i).alias("i"), *((F.col(f"{c}_{i}") if f"{c}_{i}" in have else F.lit(None)).cast(t).alias(c) for c, t in types.items())) for i, _ in chunk]
            if not first:
                items.append(F.struct(F.lit(-1).alias("i"), *(F.lit(None).cast(t).alias(c) for c, t in types.items())))
            parts.append(wide.select("g", "n", F.explode(F.array(*items)).alias("x")).select("g", "n", "x.*"))
        cells = materialised(reduce(DataFrame.unionByName, parts), "profile-cells")
        return materialised(cells.unionByName(_merged(cells)), "profile-cells") if self.overall else cells

    @cached_property
    def totals(self) -> dict[str, int]:
        """Rows of each group; one number for each group, groups are bounded by the caller."""
        return {r["g"]: r["n"] for r in self.cells.where("i = -1").select("g", "n").collect()} or {ALL: 0}

    def _distinct(self, i: int) -> DataFrame:
        """(g, n_unique) of variable i, from its own column."""
        kind = self.usable[i].variable.analysis_type
        columns = [F.col(f"h{i}"), F.col(f"v{i}")] if kind == "text" else [F.col(f"l{i}" if kind in LEVELS else f"h{i}")]
        group = ["g"] if self.grouped else []
        each = self.rows.where(~F.col(f"m{i}")).select(*group, *(c.alias(f"x{j}") for j, c in enumerate(columns))).distinct()
        by = self._with_g(each.groupBy(*group).agg(F.count(F.lit(1)).alias("n_unique")))
        if self.overall:
            by = by.unionByName(each.drop("g").distinct().agg(F.count(F.lit(1)).alias("n_unique")).select(F.lit(ALL).alias("g"), "n_unique"))
        return by.select("g", F.lit(i).alias("i"), "n_unique")

    def _with_g(self, part: DataFrame) -> DataFrame:
        return part if self.grouped else part.withColumn("g", F.lit(ALL))

    def _basic(self, numbers: list[int]) -> DataFrame:
        if "basic" in self.__dict__ and len(numbers) < len(self.usable):
            return self.basic.where(F.col("name").isin([self.usable[i].name for i in numbers]))
        counted = self.cells.where(F.col("i").isin(numbers or [-2]))
        if numbers:
            counted = counted.join(materialised(reduce(DataFrame.unionByName, map(self._distinct, numbers)), "distinct-counts"), ["g", "i"], "left")
        else:
            counted = counted.withColumn("n_unique", F.lit(0).cast("long"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return counted.select("g", self._name(F.col("i")).alias("name"), "n", "n_missing", (F.col("n") - F.col("n_missing")).alias("n_observed"), zero("n_unique"), zero("n_infinite"), zero("n_inexact"))

    @cached_property
    def basic(self) -> DataFrame:
        """(g, name, n, n_missing, n_observed, n_unique, n_infinite, n_inexact) of the usable variables."""
        return self._basic(list(range(len(self.usable))))

    def _cells_of(self, kinds: tuple[str, ...]) -> DataFrame:
        """Cells of the variables of these kinds with their names."""
        return self.cells.where(F.col("i").isin(self._numbers(kinds) or [-2])).withColumn("name", self._name(F.col("i"))).withColumn("n_observed", F.col("n") - F.col("n_missing"))

    def _values(self, kinds: tuple[str, ...]) -> DataFrame:
        """(keys, v, c) of the finite values of these kinds, also for Overall."""
        numbers = self._numbers(kinds)
        if not numbers:
            return self.spark.createDataFrame([], "g string, i int, v double, c int").select(*self.keys, "v", "c")
        group = [F.explode(F.array("g", F.lit(ALL))).alias("g") if self.overall else F.col("g")] if self.grouped else []
        pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in numbers))
        return self.rows.select(*group, pairs.alias("pairs")).select(*(["g"] if group else []), F.explode("pairs").alias("x")).select(*(["g"] if group else []), "x.*").where("v is not null").withColumn("c", F.lit(1))

    def quartiles(self, kinds: tuple[str, ...]) -> DataFrame:
        """(g, i, q) of the variables of these kinds; what was computed together with others is not computed again."""
        for have, table in self._quartiles.items():
            if set(kinds) <= set(have):
                return table.where(F.col("i").isin(self._numbers(kinds) or [-2]))
        base = self.cells.where(F.col("i").isin(self._numbers(kinds) or [-2])).select(*self.keys, F.col("n_finite").alias("n"), "lo", "hi")
        self._quartiles[kinds] = self._with_g(quantiles(self._values(kinds), self.keys, base=base))
        return self._quartiles[kinds]

    def grid(self, groups: list[str], kinds: tuple[str, ...] = ()) -> DataFrame:
        """(g, group_order, name, variable_order, type) for every group and usable variable of these kinds."""
        rows = [(g, i, r.name, j, r.variable.analysis_type) for i, g in enumerate(groups) for j, r in enumerate(self.usable) if not kinds or r.variable.analysis_type in kinds]
        return self.spark.createDataFrame(rows, "g string, group_order int, name string, variable_order int, type string")

    def _full(self, groups: list[str] | None, kinds: tuple[str, ...], *parts: DataFrame) -> DataFrame:
        out = self.grid(groups or [ALL], kinds)
        for p in parts:
            # A row for each group and variable, like the grid.
            out = out.join(F.broadcast(p), ["g", "name"], "left")
        return out

    def numeric(self, groups: list[str] | None = None) -> DataFrame:
        """The 23 numeric statistics of every group and numeric variable (g and orders beside them); a second call reads the first one's table."""
        key = tuple(groups or [ALL])
        if key in self._numeric:
            return self._numeric[key]
        own = with_fences(self._cells_of(NUMERIC).join(F.broadcast(self.quartiles(NUMERIC)), ["g", "i"], "left"))
        own = materialised(own, "numeric-first-pass")
        about = F.broadcast(own.select(*self.keys, "mean", "lower_fence", "upper_fence"))
        second = self._with_g(self._values(NUMERIC).join(about, self.keys).groupBy(*self.keys).agg(*_about_mean(F.lit(1), True)))
        tested = shapiro_table(self._values(NUMERIC), own, self.keys)
        second = second.join(F.broadcast(self._with_g(tested)), ["g", "i"], "left")
        stats = numeric_columns(own.withColumnsRenamed({"lo": "min", "hi": "max"}).join(F.broadcast(second), ["g", "i"], "left"), ["g", "name", "n", "n_missing", "n_observed", "n_infinite", "n_inexact"])
        out = self._full(groups, NUMERIC, stats)
        for c in ("n", "n_missing", "n_observed", "n_infinite", "n_finite", "n_below_lower", "n_above_upper", "outlier_count"):
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
        self._numeric[key] = materialised(out, "numeric")
        return self._numeric[key]

    def temporal(self, groups: list[str] | None = None) -> DataFrame:
        kinds = {r.name: r for r in self.usable if r.variable.analysis_type in TEMPORAL}
        base = self._cells_of(TEMPORAL).join(F.broadcast(self.quartiles(TEMPORAL)), ["g", "i"], "left").select("g", "name", "lo", "hi", "q")
        out = self._full(groups, TEMPORAL, self._basic(self._numbers(TEMPORAL)).select("g", "name", "n", "n_missing", "n_observed", "n_unique"), base)
        is_date = F.col("type") == "date"

        def shown(x: Column) -> Column:
            # Quantiles between two values are cut to the whole day or second.
            day = F.date_format(F.date_from_unix_date(F.floor(x).cast("int")), "yyyy-MM-dd")
            instant = F.date_format(F.timestamp_seconds(F.floor(x)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
            return F.when(is_date, day).otherwise(instant)

        source = F.create_map(*[F.lit(x) for n, r in kinds.items() for x in (n, r.observed_type)]) if kinds else F.create_map(F.lit(""), F.lit(""))
        cols = [F.col("lo"), F.col("q")[0], F.col("q")[1], F.col("q")[2], F.col("hi")]
        for c in ("n", "n_missing", "n_observed", "n_unique"):
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
        return out.select(
            "g", "group_order", "variable_order", "name", "type", source[F.col("name")].alias("source_class"), F.when(~is_date, "UTC").alias("timezone"), "n", "n_missing", "n_observed", "n_unique",
            *(shown(x).alias(a) for x, a in zip(cols, ("min", "q1", "median", "q3", "max"))),
            *(x.alias(f"{a}_number") for x, a in zip(cols, ("min", "q1", "median", "q3", "max"))),
            (F.col("hi") - F.col("lo")).alias("range_value"), F.when(is_date, "days").otherwise("seconds").alias("range_unit"),
        )

    def text(self, groups: list[str] | None = None) -> DataFrame:
        s = self._cells_of(("text",)).select("g", "name", "n_empty", F.col("n_blank").alias("n_whitespace"), "min_length", "max_length")
        out = self._full(groups, ("text",), self._basic(self._numbers(("text",))).select("g", "name", "n", "n_missing", "n_observed", "n_unique"), s)
        for c in ("n", "n_missing", "n_observed", "n_unique", "n_empty", "n_whitespace"):
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
        return out

    @cached_property
    def level_counts(self) -> DataFrame:
        """(g, name, level, k) of the observed levels of all categorical variables, each from its own column."""
        numbers = self._numbers(LEVELS)
        if not numbers:
            return self.spark.createDataFrame([], "g string, name string, level string, k long")
        parts = [self.rows.where(~F.col(f"m{i}")).groupBy("g", F.lit(self.usable[i].name).alias("name"), F.col(f"l{i}").alias("level")).agg(F.count(F.lit(1)).alias("k")) for i in numbers]
        counts = materialised(reduce(DataFrame.unionByName, parts), "level-counts")
        return counts.unionByName(counts.groupBy("name", "level").agg(F.sum("k").alias("k")).select(F.lit(ALL).alias("g"), "name", "level", "k")) if self.overall else counts

    def levels(self, max_levels: int | None = None) -> dict[str, list[tuple[str, bool]]]:
        """For each categorical variable its levels over all groups: declared ones in their order, then others bytewise.

        More than ``max_levels`` of a variable, or MAX_LEVELS of all together, are an error.
        """
        out = {}
        observed: dict[str, list[str]] = {}
        names = [self.usable[i].name for i in self._numbers(LEVELS)]
        for r in bounded(self.level_counts.select("name", "level").distinct(), MAX_LEVELS if max_levels is None else max_levels * max(1, len(names)), "the levels of the categorical variables"):
            observed.setdefault(r["name"], []).append(r["level"])
        for r in self.usable:
            if r.variable.analysis_type in LEVELS:
                declared = list(r.variable.levels) or (["FALSE", "TRUE"] if r.variable.analysis_type == "binary" else [])
                more = sorted((w for w in observed.get(r.name, []) if w not in declared), key=lambda w: w.encode())
                if max_levels is not None and len(declared) + len(more) > max_levels:
                    raise ValueError(f"a categorical variable has more than {max_levels} levels")
                out[r.name] = [(w, True) for w in declared] + [(w, False) for w in more]
        return out

    def categorical(self, groups: list[str] | None = None, max_levels: int | None = None) -> DataFrame:
        """Every level of every categorical variable in every group, also where nobody has it."""
        levels = self.levels(max_levels)
        has_declared = {r.name: bool(r.variable.levels) or r.variable.analysis_type == "binary" for r in self.usable}
        rows = [(n, k, w, d if has_declared[n] else None, (not d) if has_declared[n] else False) for n, ls in levels.items() for k, (w, d) in enumerate(ls)]
        known = self.spark.createDataFrame(rows, "name string, level_order int, level string, is_declared boolean, is_unexpected boolean")
        grid = self._full(groups, LEVELS, self._cells_of(LEVELS).select("g", "name", F.col("n").alias("n_total"), "n_missing", "n_observed")).join(F.broadcast(known), "name")
        out = grid.join(self.level_counts, ["g", "name", "level"], "left")
        for c in ("n_total", "n_missing", "n_observed"):
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
        n = F.coalesce("k", F.lit(0))
        return out.select("g", "group_order", "variable_order", "name", "type", "level_order", "level", n.alias("n"), "n_total", "n_missing", "n_observed", safe_div(n, F.col("n_total")).alias("p_total"), safe_div(n, F.col("n_observed")).alias("p_observed"), "is_declared", "is_unexpected")

    def histogram(self, bins: int = 30) -> DataFrame:
        """(name, bin, lower, upper, midpoint, count): equal bins of each numeric variable; a constant falls into the middle one."""
        own = self._with_g(self._values(NUMERIC)).where(F.col("g") == ALL).drop("g")
        ends = self._cells_of(NUMERIC).where((F.col("g") == ALL) & (F.col("n_finite") > 0)).select("i", "name", "lo", "hi")
        flat = F.col("lo") == F.col("hi")
        pad = F.greatest(F.lit(0.5), F.abs("lo") * 0.01)
        ends = ends.select("i", "name", flat.alias("flat"), F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + pad).otherwise(F.col("hi")).alias("hi"))
        place = F.when(F.col("flat"), (bins + 1) // 2).otherwise(F.least(F.lit(bins), F.greatest(F.lit(1), 1 + F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))))
        counted = own.join(F.broadcast(ends), "i").groupBy("name", place.cast("int").alias("bin")).agg(F.sum("c").alias("k"))
        grid = F.broadcast(self.spark.createDataFrame([(n, b) for n in [self.usable[i].name for i in self._numbers(NUMERIC)] for b in range(1, bins + 1)], "name string, bin int"))
        full = grid.join(F.broadcast(ends.drop("i")), "name", "left").join(counted, ["name", "bin"], "left")
        lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1.0))
        width = (hi - lo) / bins
        return full.select("name", "bin", (lo + width * (F.col("bin") - 1)).alias("lower"), (lo + width * F.col("bin")).alias("upper"), (lo + width * (F.col("bin") - 0.5)).alias("midpoint"), F.coalesce("k", F.lit(0)).alias("count"))


def _merged(cells: DataFrame) -> DataFrame:
    """Cells of all groups together."""
    how = {"lo": F.min, "hi": F.max, "min_length": F.min, "max_length": F.max}
    return cells.groupBy("i").agg(F.sum("n").alias("n"), *(how.get(c, F.sum)(c).alias(c) for c in _CELL)).select(F.lit(ALL).alias("g"), "n", "i", *_CELL)


def _about_mean(c: Column, fences: bool) -> list[Column]:
    """Central moments and, if wanted, counts beyond the fences, of values v that occur c times."""
    d = F.col("v") - F.col("mean")
    outside = lambda cond: F.sum(F.when(cond, c).otherwise(0)) if fences else F.lit(0)
    return [F.sum(d * d * c).alias("m2"), F.sum(d * d * d * c).alias("m3"), F.sum(d * d * d * d * c).alias("m4"), outside(F.col("v") < F.col("lower_fence")).alias("n_below_lower"), outside(F.col("v") > F.col("upper_fence")).alias("n_above_upper")]


def shapiro_table(values: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shapiro_p) for keys with more than 3 and fewer than 5000 finite values (n_finite in ``sizes``): only those values are gathered, each key's in a task."""
    few = sizes.where("n_finite > 3 and n_finite < 5000").select(*keys)
    schema = T.StructType([*(sizes.schema[c] for c in keys), T.StructField("shapiro_p", T.DoubleType())])
    if not few.limit(1).count():
        return sizes.sparkSession.createDataFrame([], schema)

    def test(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.repeat(part["v"].to_numpy(), part["c"].to_numpy())
        return pd.DataFrame([(*key, shapiro_wilk(x))], columns=schema.names)

    return values.join(F.broadcast(few), keys).select(*keys, "v", "c").groupBy(*keys).applyInPandas(test, schema)


def with_fences(part: DataFrame, coef: float = 1.5) -> DataFrame:
    """``part`` (n_finite, sum, q) with mean, iqr and Tukey's fences."""
    q = F.col("q")
    out = part.withColumns({"mean": safe_div(F.col("sum"), F.col("n_finite")), "iqr": q[2] - q[0]})
    return out.withColumns({"lower_fence": q[0] - coef * F.col("iqr"), "upper_fence": q[2] + coef * F.col("iqr")})


def numeric_columns(part: DataFrame, keys: list[str]) -> DataFrame:
    """The numeric core (type-3 shape) from n_finite, sum, min, max, q, mean, fences, central moments m2, m3, m4 and the counts beyond the fences."""
    n = F.col("n_finite").cast("double")
    variance = F.when(n >= 2, F.col("m2") / (n - 1))
    sd = F.sqrt(variance)
    shaped = (n >= 3) & (F.col("m2") > 0)
    skew = F.when(shaped, (F.col("m3") / n) / F.pow(F.col("m2") / n, F.lit(1.5)) * F.pow(1 - 1 / n, F.lit(1.5)))
    kurt = F.when(shaped, (F.col("m4") / n) / F.pow(F.col("m2") / n, F.lit(2.0)) * F.pow(1 - 1 / n, F.lit(2.0)) - 3)
    out = F.col("n_below_lower") + F.col("n_above_upper")
    return part.select(
        *keys, "n_finite", "sum", "min", F.col("q")[0].alias("q1"), "mean", F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "iqr", sd.alias("sd"), variance.alias("variance"), F.when(n > 0, sd / F.sqrt(n)).alias("sem"),
        F.when(F.col("mean") != 0, sd / F.col("mean")).alias("cv"), skew.alias("skewness"), kurt.alias("kurtosis"), "shapiro_p", "lower_fence", "upper_fence", "n_below_lower", "n_above_upper", out.alias("outlier_count"), F.when(n > 0, out * 100.0 / n).alias("outlier_percentage"),
    )


def numeric_statistics(values: DataFrame, keys: list[str], coef: float = 1.5) -> DataFrame:
    """The numeric core of weighted finite values (keys, v, c)."""
    base = materialised(values.groupBy(*keys).agg(F.sum("c").alias("n_finite"), F.sum(F.col("v") * F.col("c")).alias("sum"), F.min("v").alias("min"), F.max("v").alias("max")), "numeric-sums")
    q = quantiles(values, keys, base=base.select(*keys, F.col("n_finite").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi")))
    # One row for each group and variable: kept, so that the second pass does not repeat the first.
    first = materialised(with_fences(base.join(q, keys), coef), "numeric-first-pass")
    second = values.join(F.broadcast(first.select(*keys, "mean", "lower_fence", "upper_fence")), keys).groupBy(*keys).agg(*_about_mean(F.col("c"), bool(coef)))
    tested = shapiro_table(values, first, keys)
    return numeric_columns(first.join(second, keys).join(F.broadcast(tested), keys, "left"), keys)
