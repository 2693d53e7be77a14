"""Summaries by stratum, the percentages of categorical cells and Table 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import readings, safe_div, text_form
from ..spec import Spec, SpecError, strict_levels
from ..storage import Parts, bounded
from .profile import ALL, LEVELS, NUMERIC, TEMPORAL, Profile
from .summaries import NUMERIC_COLUMNS, TEMPORAL_COLUMNS, TEXT_COLUMNS

BASES = ("compatibility", "column", "row", "overall")
MISSING = "\0missing"
PREFIX = ["group_id", "group_order", "group_value", "group_label", "is_overall", "is_missing_stratum", "is_unexpected_stratum"]
GROUPS_SCHEMA = "group_id string, group_order int, group_value string, group_label string, is_overall boolean, is_missing_stratum boolean, is_unexpected_stratum boolean, is_declared_stratum boolean, n long"
MAX_STRATA = 200
_DASH = "—"


class Stratified(Parts):
    """groups, variables, numeric, categorical, text, temporal and skipped, each computed when it is asked for.

    ``strata`` is the stratifier, ``labels`` and ``orders`` hold title and place of each
    summarised variable, ``declared`` the declared levels.
    """

    strata: str
    labels: dict[str, str]
    orders: dict[str, int]
    types: dict[str, str]


def profile_stratified(df: DataFrame, spec: Spec, strata: str, include_overall: bool = True, include_missing_stratum: bool = True, assume_timezone: bool = False, max_strata: int = MAX_STRATA) -> Stratified:
    """All components for Overall, every declared stratum (also empty ones), unexpected strata and Missing.

    Rows whose stratum is missing count towards Overall only if the missing stratum
    is included.  Every group shows every level that any included row has.
    """
    own = readings(df, spec.only([strata]), assume_timezone)[0]
    if own.variable.analysis_type not in ("categorical", "binary") or not own.usable:
        raise SpecError("the stratifier must be a usable categorical or binary variable")
    declared = list(strict_levels(own.variable.levels)) or (["FALSE", "TRUE"] if own.variable.analysis_type == "binary" else [])
    key = F.when(own.missing, F.lit(MISSING) if include_missing_stratum else F.lit(None)).otherwise(text_form(own.column, own.dtype))
    p = Profile(df, spec, key, assume_timezone)
    sizes = {r["g"]: r["n"] for r in bounded(p.cells.where("i = -1").select("g", "n"), max_strata + 2, "the stratifier")}
    unexpected = sorted((g for g in sizes if g not in (ALL, MISSING) and g not in declared), key=lambda g: g.encode())
    rows, keys = [], []
    if include_overall:
        rows.append((".overall", None, "Overall", True, False, False, False, sizes.get(ALL, 0)))
        keys.append(ALL)
    for i, g in enumerate([*declared, *unexpected], 1):
        rows.append((f".stratum.{i:03d}", g, g, False, False, g in unexpected, g in declared, sizes.get(g, 0)))
        keys.append(g)
    if include_missing_stratum and sizes.get(MISSING):
        rows.append((".missing", None, "Missing", False, True, False, False, sizes[MISSING]))
        keys.append(MISSING)
    ordered = [(r[0], i, *r[1:]) for i, r in enumerate(rows, 1)]
    groups = p.spark.createDataFrame(ordered, GROUPS_SCHEMA)
    named = F.broadcast(p.spark.createDataFrame([(k, *r) for k, r in zip(keys, ordered)], "g string, " + GROUPS_SCHEMA).drop("n", "is_declared_stratum"))
    prefixed = lambda part, columns: part.drop("group_order").join(named, "g").select(*PREFIX, *columns)

    labels = {v.name: v.label or v.name for v in spec}
    of = lambda field: F.create_map(*[F.lit(x) for v in spec for x in (v.name, field(v))])[F.col("name")]

    def full(counts: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
        out = p._full(keys, kinds, counts)
        return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "n_missing", "n_observed", "n_unique", "n_infinite") if c in out.columns})

    def variables() -> DataFrame:
        names = ["name", "label", "type", "role", "required", "n", "n_missing", "n_observed", "n_unique", "n_infinite", "status", "reason"]
        rows = full(p.basic).withColumns({"label": of(lambda v: v.label or v.name), "role": of(lambda v: v.role), "required": of(lambda v: v.required), "status": F.lit("summarised"), "reason": F.lit(None).cast("string")})
        return prefixed(rows, names)

    def categorical() -> DataFrame:
        columns = ["name", "type", "level", "n", "n_total", "n_observed", "p_total", "p_observed", "is_declared", "is_unexpected"]
        level_rows = prefixed(p.categorical(keys), columns).withColumn("is_missing_level", F.lit(False))
        gone = full(p._cells_of(LEVELS).select("g", "name", "n", "n_missing", "n_observed"), LEVELS)
        gone = gone.select("g", "group_order", "name", "type", F.lit(None).cast("string").alias("level"), F.col("n_missing").alias("n"), F.col("n").alias("n_total"), "n_observed", safe_div(F.col("n_missing"), F.col("n")).alias("p_total"), F.lit(None).cast("double").alias("p_observed"), F.lit(False).alias("is_declared"), F.lit(False).alias("is_unexpected"))
        return level_rows.unionByName(prefixed(gone, columns).withColumn("is_missing_level", F.lit(True)))

    def skipped() -> DataFrame:
        found = [(*r[:8], x.name, x.variable.analysis_type, x.observed_type, x.reason) for r in ordered for x in p.readings if not x.usable]
        return p.spark.createDataFrame(found, "group_id string, group_order int, group_value string, group_label string, is_overall boolean, is_missing_stratum boolean, is_unexpected_stratum boolean, is_declared boolean, name string, type string, observed_class string, reason string").drop("is_declared")

    out = Stratified(
        groups=lambda: groups,
        variables=variables,
        numeric=lambda: prefixed(p.numeric(keys), ["name", "type", "n", "n_missing", "n_observed", "n_infinite", *NUMERIC_COLUMNS[1:]]),
        categorical=categorical,
        text=lambda: prefixed(p.text(keys), TEXT_COLUMNS),
        temporal=lambda: prefixed(p.temporal(keys), TEMPORAL_COLUMNS),
        skipped=skipped,
        declared=lambda: {n: [w for w, d in ls if d] for n, ls in p.levels().items() if any(d for _, d in ls)},
    )
    out.strata, out.labels = strata, labels
    out.quartiles = lambda: p.quartiles((*NUMERIC, *TEMPORAL))
    out.orders = {r.name: j for j, r in enumerate(p.usable, 1)}
    out.types = {r.name: r.variable.analysis_type for r in p.usable}
    return out


def reconcile(result: Stratified) -> None:
    """Raises if group sizes don't add up to Overall, or observed and missing don't add up to a group."""
    rows = result.groups.collect()
    overall = [r["n"] for r in rows if r["is_overall"]]
    if overall and overall[0] != sum(r["n"] for r in rows if not r["is_overall"]):
        raise AssertionError("group sizes do not add up to the overall size")
    if result.variables.where("n <> n_missing + n_observed").limit(1).count():
        raise AssertionError("observed and missing values do not add up to the group size")


def categorical_display(result: Stratified, basis: str = "compatibility") -> DataFrame:
    """Numerator and denominator of every categorical cell under one of the four bases."""
    if basis not in BASES:
        raise SpecError("unknown percentage basis")
    spark = result.groups.sparkSession
    order = F.broadcast(spark.createDataFrame(list(result.orders.items()), "name string, variable_order int"))
    sizes = F.broadcast(result.groups.select("group_id", F.col("n").alias("group_n")))
    population = result.groups.where("is_overall").select(F.col("n").alias("p"))
    if not population.count():
        population = result.groups.agg(F.sum("n").alias("p"))
    titles = F.create_map(*[F.lit(x) for kv in result.labels.items() for x in kv])
    cells = result.categorical.join(order, "name").join(sizes, "group_id").crossJoin(F.broadcast(population))
    level_order = F.row_number().over(Window.partitionBy("name", "group_id").orderBy("is_missing_level", F.col("is_declared").desc_nulls_last(), F.coalesce(F.array_position(_levels_of(result), F.col("level")), F.lit(0)), "level"))
    missing = F.col("is_missing_level")
    across = F.sum(F.when(~F.col("is_overall"), F.col("n"))).over(Window.partitionBy("name", "level", "is_missing_level"))
    denominator: Column = {
        "compatibility": F.when(missing, F.col("group_n")).otherwise(F.col("n_observed")),
        "column": F.col("group_n"),
        "overall": F.col("p"),
        "row": F.coalesce(across, F.lit(0)),
    }[basis]
    scope = {"compatibility": F.when(missing, "all_within_group").otherwise("observed_within_group"), "column": F.lit("all_within_group"), "row": F.lit("level_across_groups"), "overall": F.lit("analysis_population")}[basis]
    treatment = {"compatibility": F.when(missing, "separate_level").otherwise("excluded"), "column": F.lit("included"), "row": F.lit("separate_level"), "overall": F.lit("included")}[basis]
    return cells.select(
        "variable_order", level_order.cast("int").alias("level_order"), "name", titles[F.col("name")].alias("label"), "type", "level", "group_id", "group_order", "group_label", "is_overall", "group_n", F.col("p").alias("population_n"), F.col("n").alias("numerator"),
        denominator.cast("long").alias("denominator"), safe_div(F.col("n"), denominator).alias("proportion"), F.lit(basis).alias("percentage_basis"), scope.alias("denominator_scope"), treatment.alias("missing_treatment"), "is_missing_level",
    )


def _levels_of(result: Stratified) -> Column:
    declared = result.declared
    if not declared:
        return F.array().cast("array<string>")
    return F.coalesce(F.create_map(*[x for n, ls in declared.items() for x in (F.lit(n), F.array(*map(F.lit, ls)))])[F.col("name")], F.array().cast("array<string>"))


def _one(x: Column) -> Column:
    return F.when(x.isNull(), F.lit(_DASH)).otherwise(F.format_string("%.1f", x.cast("double")))


def _share(n: Column, p: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" ("), F.when(p.isNull(), F.lit(_DASH)).otherwise(F.format_string("%.1f%%", 100 * p)), F.lit(")"))


def _or_dash(x: Column) -> Column:
    return F.when(x.isNull() | (x.cast("string") == ""), F.lit(_DASH)).otherwise(x.cast("string"))


def table1(result: Stratified, basis: str = "compatibility") -> DataFrame:
    """Display rows of all variables but the stratifier, ordered by variable, row and group."""
    spark = result.groups.sparkSession
    # Of numbers and times together, since both are shown.
    result.quartiles()
    order = F.broadcast(spark.createDataFrame([(n, i, result.labels[n]) for i, n in enumerate((n for n in result.orders if n != result.strata), 1)], "name string, variable_order int, label string"))
    stratum_note = F.concat_ws(" ", F.when(F.col("is_missing_stratum"), "Missing stratum."), F.when(F.col("is_unexpected_stratum"), "Unexpected stratum."))
    missing_note = F.lit("Percentage of all rows of the group.")
    denominators = {"compatibility": F.when(F.col("is_missing_level"), missing_note).otherwise("Percentage of observed values."), "column": F.lit("Percentage of all rows of the group, missing ones included."), "row": F.lit("Percentage of this level's rows in all groups but Overall."), "overall": F.lit("Percentage of the whole included population.")}

    def rows(part: DataFrame, *lines: tuple[int, str, str, Column, Column, Column]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(k).alias("row_order"), F.lit(stat).alias("statistic"), F.lit(label).alias("level_label"), den.cast("long").alias("denominator"), shown.alias("display"), F.trim(F.concat_ws(" ", stratum_note, note)).alias("note")) for k, stat, label, den, shown, note in lines])
        return part.join(order, "name").withColumn("r", F.explode(items)).select("variable_order", "r.row_order", "name", "label", "type", F.lit(None).cast("string").alias("level"), "r.level_label", "r.statistic", "group_id", "group_order", "group_label", F.col("n").cast("long").alias("group_n"), "r.denominator", "r.display", "r.note")

    none = F.lit("")
    gap = _share(F.col("n_missing"), safe_div(F.col("n_missing"), F.col("n")))
    infinite = F.when(F.col("n_infinite") > 0, "Infinite values take no part in the statistics.")
    numeric = rows(
        result.numeric,
        (1, "mean_sd", "", F.col("n_finite"), F.concat(_one(F.col("mean")), F.lit(" ("), _one(F.col("sd")), F.lit(")")), infinite),
        (2, "median_iqr", "", F.col("n_finite"), F.concat(_one(F.col("median")), F.lit(" ["), _one(F.col("q1")), F.lit(", "), _one(F.col("q3")), F.lit("]")), infinite),
        (3, "missing", "Missing", F.col("n"), gap, F.concat_ws(" ", infinite, missing_note)),
    )
    types = F.create_map(*[F.lit(x) for kv in result.types.items() for x in kv] or [F.lit(""), F.lit("")])
    unit = F.concat(F.when(F.col("timezone").isNotNull(), F.concat(F.lit("Timezone: "), F.col("timezone"), F.lit(". "))).otherwise(none), F.lit("Range unit: "), F.col("range_unit"), F.lit("."))
    temporal = rows(
        result.temporal.withColumn("type", types[F.col("name")]),
        (1, "median_iqr", "", F.col("n_observed"), F.concat(_or_dash(F.col("median")), F.lit(" ["), _or_dash(F.col("q1")), F.lit(", "), _or_dash(F.col("q3")), F.lit("]")), unit),
        (2, "range", "", F.col("n_observed"), F.concat(_or_dash(F.col("min")), F.lit(" to "), _or_dash(F.col("max"))), unit),
        (3, "missing", "Missing", F.col("n"), gap, F.concat_ws(" ", unit, missing_note)),
    )
    text = rows(
        result.text.withColumn("type", F.lit("text")),
        (1, "observed_unique", "", F.col("n_observed"), F.concat(F.col("n_observed").cast("string"), F.lit(" observed; "), F.col("n_unique").cast("string"), F.lit(" unique")), none),
        (2, "length_range", "", F.col("n_observed"), F.when(F.col("min_length").isNull(), _DASH).otherwise(F.concat(F.col("min_length").cast("string"), F.lit(" to "), F.col("max_length").cast("string"))), none),
        (3, "blank_whitespace", "", F.col("n_observed"), F.concat(F.col("n_empty").cast("string"), F.lit(" empty; "), F.col("n_whitespace").cast("string"), F.lit(" whitespace-only")), none),
        (4, "missing", "Missing", F.col("n"), gap, missing_note),
    )
    flags = result.categorical.select("name", "group_id", F.col("level").alias("l"), F.col("is_missing_level").alias("m"), "is_missing_stratum", "is_unexpected_stratum", "is_unexpected")
    cells = categorical_display(result, basis).drop("variable_order", "label").join(order, "name")
    cells = cells.join(flags, (cells["name"] == flags["name"]) & (cells["group_id"] == flags["group_id"]) & cells["level"].eqNullSafe(flags["l"]) & (cells["is_missing_level"] == flags["m"])).drop(flags["name"], flags["group_id"])
    note = F.trim(F.concat_ws(" ", stratum_note, F.when(F.col("is_unexpected"), "Unexpected level."), denominators[basis]))
    categorical = cells.select(
        "variable_order", F.col("level_order").alias("row_order"), "name", "label", "type", "level", F.when(F.col("is_missing_level"), "Missing").otherwise(F.col("level")).alias("level_label"), F.when(F.col("is_missing_level"), "missing").otherwise("level").alias("statistic"),
        "group_id", "group_order", "group_label", F.col("group_n").cast("long"), "denominator", _share(F.col("numerator"), F.col("proportion")).alias("display"), note.alias("note"),
    )
    out = numeric.unionByName(temporal).unionByName(text).unionByName(categorical)
    return out.orderBy("variable_order", "row_order", "group_order").drop("group_order")
