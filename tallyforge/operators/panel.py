"""Long panels: one table with an entity and a discrete time of declared order."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import number_form, readings, safe_div, text_form
from ..spec import Spec, SpecError, strict_levels
from ..storage import Parts, materialised
from .periods import valid_entity
from .profile import LEVELS, NUMERIC, numeric_statistics
from .stratified import Stratified, profile_stratified


class Panel(Parts):
    """The tables of a panel: structure, observation_count, first_observation, last_observation, gap_status, timepoints,
    missing_by_time, entity_summary, measurement_distribution, interior_missing, change_adjacent, change_first_to_last, issues and,
    if they were asked for, summaries by time."""


def longitudinal_panel(df: DataFrame, spec: Spec, entity: str, time: str, time_order: list[str] | None = None, variables: list[str] | None = None, summaries: bool = False) -> Panel:
    """Structure, follow-up, missingness and changes of a panel.

    Rows are reduced once to (entity, time) cells with the least and greatest value of
    each variable: equal ones are a usable value, different ones a conflict.
    """
    spark = df.sparkSession
    levels = list(time_order or strict_levels(spec[time].levels))
    if not levels:
        raise SpecError("the time variable needs declared levels or an order")
    t = readings(df, spec.only([time]))[0]
    names = variables or [v.name for v in spec if v.name not in (entity, time) and not v.is_identifier and v.analysis_type in (*NUMERIC, *LEVELS)]
    bound = [r for r in readings(df, spec.only(names)) if r.usable]
    order = {n: i for i, n in enumerate(names, 1)}
    null, blank, valid = valid_entity(df, entity)
    word = text_form(t.column, t.dtype)
    index = F.when(~t.missing, F.when(word.isin(levels), F.array_position(F.array(*map(F.lit, levels)), word).cast("int")))
    gone = t.missing | index.isNull()
    ok = valid & ~gone
    n_times = len(levels)
    times = F.broadcast(spark.createDataFrame(list(enumerate(levels, 1)), "t int, timepoint string"))

    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(a) for c, a in ((null, "n_missing_id"), (blank, "n_blank_id"), (gone, "n_missing_time"), ((null | blank) & gone, "n_invalid_id_and_missing_time"), (ok, "n_valid_panel_rows"))])
    sides = []
    for r in bound:
        if r.variable.analysis_type in NUMERIC:
            x = F.when(~r.missing, number_form(r.column, r.dtype))
            sides.append((r.name, x, F.lit(None).cast("string")))
        else:
            sides.append((r.name, F.lit(None).cast("double"), F.when(~r.missing, text_form(r.column, r.dtype))))
    rows = df.where(ok).select(F.col(f"`{entity}`").cast("string").alias("id"), index.alias("t"), *[c.alias(f"{k}{i}") for i, (_, x, s) in enumerate(sides) for k, c in (("x", x), ("s", s))])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(sides)):
        aggs += [F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}"), F.min(f"s{i}").alias(f"slo{i}"), F.max(f"s{i}").alias(f"shi{i}")]
    # What several tables need is computed when the first of them is asked for.
    cells = materialised(rows.groupBy("id", "t").agg(*aggs), "panel-cells")

    per = cells.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("t").alias("first"), F.max("t").alias("last"), F.max((F.col("rows") > 1).cast("int")).alias("dup"))
    ent = per.agg(F.count(F.lit(1)).alias("n_valid_entities"), F.coalesce(F.sum("dup"), F.lit(0)).cast("long").alias("n_entities_with_duplicate_cell"), F.coalesce(F.sum((F.col("k") == n_times).cast("long")), F.lit(0)).alias("n_complete_entities"))
    cel = cells.agg(F.count_distinct("t").alias("n_observed_timepoints"), F.count(F.lit(1)).alias("n_observed_id_time_cells"), F.coalesce(F.sum((F.col("rows") > 1).cast("long")), F.lit(0)).alias("n_duplicate_cells"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("n_duplicate_excess"), F.coalesce(F.max("rows"), F.lit(0)).alias("max_rows_per_cell"))
    one = counts.crossJoin(ent).crossJoin(cel)
    structure = one.select(
        "n_rows", "n_missing_id", "n_blank_id", "n_missing_time", "n_invalid_id_and_missing_time", "n_valid_panel_rows", "n_valid_entities", F.lit(n_times).cast("long").alias("n_declared_timepoints"), "n_observed_timepoints", "n_observed_id_time_cells", "n_duplicate_cells", "n_duplicate_excess", "max_rows_per_cell",
        "n_entities_with_duplicate_cell", (F.col("n_valid_entities") * n_times).alias("n_expected_cells"), "n_complete_entities", (F.col("n_valid_entities") - F.col("n_complete_entities")).alias("n_incomplete_entities"),
    )
    spread = cache(lambda: materialised(per.groupBy("k", "first", "last").agg(F.count(F.lit(1)).alias("n")), "panel-spread"))
    total = lambda on, name: times.join(spread().groupBy(F.col(on).alias("t")).agg(F.sum("n").alias("n")), "t", "left").select(F.col("t").alias(name), "timepoint", F.coalesce("n", F.lit(0)).alias("n_entities"))
    has_gap = (F.col("last") - F.col("first") + 1 > F.col("k")) & (F.col("k") >= 2)
    gaps = lambda: F.broadcast(spark.createDataFrame([(False,), (True,)], "has_gap boolean")).join(spread().groupBy(has_gap.alias("has_gap")).agg(F.sum("n").alias("n")), "has_gap", "left").select("has_gap", F.coalesce("n", F.lit(0)).alias("n_entities"))

    w = Window.partitionBy("id").orderBy("t")
    flagged = cells.select("id", "t", "rows", F.lag("t").over(w).alias("before"), F.lead("t").over(w).alias("after"))
    kept = F.coalesce(F.col("before") == F.col("t") - 1, F.lit(False))
    at = flagged.groupBy("t").agg(F.sum("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_entities"), F.sum(F.col("before").isNull().cast("long")).alias("n_first_observed"), F.sum(F.col("after").isNull().cast("long")).alias("n_last_observed"), F.sum(kept.cast("long")).alias("kept"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    filled = times.join(at, "t", "left").select("t", "timepoint", *[z(c).alias(c) for c in ("n_rows", "n_entities", "n_first_observed", "n_last_observed", "kept")])
    prior = filled.select((F.col("t") + 1).alias("t"), F.col("n_entities").alias("prior"))
    later = F.col("t") > 1
    new = F.when(later, F.col("n_entities") - F.col("kept"))
    timepoints = filled.join(prior, "t", "left").select(
        F.col("t").alias("time_index"), "timepoint", "n_rows", "n_entities", "n_first_observed", "n_last_observed", F.when(later, F.col("kept")).alias("n_retained"), new.alias("n_not_present_previous"), F.when(later, F.col("kept")).alias("retention_numerator"), F.col("prior").alias("retention_denominator"),
        F.when(later, safe_div(F.col("kept"), F.col("prior"))).alias("p_retained"), new.alias("presence_numerator"), F.when(later, F.col("n_entities")).alias("presence_denominator"), safe_div(new, F.col("n_entities")).alias("p_not_present_previous"),
    )

    def state(i: int) -> Column:
        lo, hi, slo, shi = (F.col(f"{c}{i}") for c in ("lo", "hi", "slo", "shi"))
        return F.when(lo.isNull() & slo.isNull(), 0).when((lo == hi) | (slo == shi), 1).otherwise(2)

    long = cells.select("id", "t", F.explode(F.array(*[F.struct(F.lit(order[n]).alias("vx"), F.lit(n).alias("variable"), state(i).alias("k"), F.col(f"lo{i}").alias("x")) for i, (n, _, _) in enumerate(sides)])).alias("e")).select("id", "t", "e.*") if sides else spark.createDataFrame([], "id string, t int, vx int, variable string, k int, x double")
    used = F.broadcast(spark.createDataFrame([(order[n], n) for n, _, _ in sides], "vx int, variable string"))
    grid = used.crossJoin(times)
    by = long.groupBy("vx", "t").agg(*[F.sum((F.col("k") == i).cast("long")).alias(c) for i, c in ((1, "u"), (0, "m"), (2, "x"))])
    u, m, x = z("u"), z("m"), z("x")
    present = u + m + x
    by_time = grid.join(by, ["vx", "t"], "left").select(F.col("vx").alias("variable_index"), "variable", F.col("t").alias("time_index"), "timepoint", present.alias("n_present_entities"), u.alias("n_usable"), m.alias("n_missing"), x.alias("n_conflicting"), *[c for a, k in (("usable", u), ("missing", m), ("conflicting", x)) for c in (k.alias(f"{a}_numerator"), present.alias(f"{a}_denominator"), safe_div(k, present).alias(f"p_{a}"))])
    usable_t = F.when(F.col("k") == 1, F.col("t"))
    wv = Window.partitionBy("vx", "id")
    inside = long.select("*", F.min(usable_t).over(wv).alias("a"), F.max(usable_t).over(wv).alias("b"))
    by_entity = inside.groupBy("vx", "id").agg(F.sum((F.col("k") == 1).cast("int")).alias("usable"), F.count(F.lit(1)).alias("present"), F.max(((F.col("k") == 0) & (F.col("t") > F.col("a")) & (F.col("t") < F.col("b"))).cast("int")).alias("interior"))
    own = cache(lambda: materialised(by_entity.groupBy("vx", "usable", "present", F.coalesce("interior", F.lit(0)).alias("interior")).agg(F.count(F.lit(1)).alias("n")), "panel-entities"))
    su = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    entity_summary = lambda: used.join(own(), "vx", "left").groupBy(F.col("vx").alias("variable_index"), "variable").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_valid_entities"), su(F.col("usable") == 0).alias("n_never_observed"), su(F.col("usable") > 0).alias("n_observed_at_least_once"), su(F.col("usable") == F.col("present")).alias("n_complete_among_present"), su(F.col("usable") != F.col("present")).alias("n_incomplete_among_present"))
    steps = F.broadcast(spark.createDataFrame([(i,) for i in range(n_times + 1)], "usable int"))
    distribution = lambda: used.crossJoin(steps).join(own().groupBy("vx", "usable").agg(F.sum("n").alias("n")), ["vx", "usable"], "left").select(F.col("vx").alias("variable_index"), "variable", F.col("usable").alias("n_usable_measurements"), z("n").alias("n_entities"))
    interior = lambda: used.join(own(), "vx", "left").groupBy(F.col("vx").alias("variable_index"), "variable").agg(su(F.col("interior") == 1).alias("n_entities_interior_missing"))

    numeric_names = [n for n, _, _ in sides if spec[n].analysis_type in NUMERIC]
    nums = long.where(F.col("variable").isin(numeric_names or [""]))
    wn = Window.partitionBy("vx", "id").orderBy("t")
    lagged = nums.select("vx", "variable", "id", "t", "k", "x", F.lag("t").over(wn).alias("t0"), F.lag("k").over(wn).alias("k0"), F.lag("x").over(wn).alias("x0"))

    def change_adjacent() -> DataFrame:
        adjacent = _changes(lagged.where("t0 = t - 1").select("vx", "variable", F.col("t0").alias("from"), "k0", "x0", "k", "x"), ["vx", "variable", "from"])
        pairs = F.broadcast(spark.createDataFrame([(order[n], n, i) for n in numeric_names for i in range(1, n_times)], "vx int, variable string, `from` int"))
        out = pairs.join(adjacent.drop("variable"), ["vx", "from"], "left").join(times.select(F.col("t").alias("from"), F.col("timepoint").alias("from_timepoint")), "from").join(times.select((F.col("t") - 1).alias("from"), F.col("timepoint").alias("to_timepoint")), "from")
        return out.select(F.col("from").alias("from_time_index"), "from_timepoint", (F.col("from") + 1).alias("to_time_index"), "to_timepoint", F.col("vx").alias("variable_index"), "variable", *_change_columns())

    def first_last() -> DataFrame:
        ends = nums.groupBy("vx", "variable", "id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("k", "x"), "t").alias("a"), F.max_by(F.struct("k", "x"), "t").alias("b"))
        lasting = _changes(ends.where("n > 1").select("vx", "variable", F.col("a.k").alias("k0"), F.col("a.x").alias("x0"), F.col("b.k").alias("k"), F.col("b.x").alias("x")), ["vx", "variable"])
        single = ends.groupBy("vx").agg(F.count(F.lit(1)).alias("present"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
        return used.where(F.col("variable").isin(numeric_names or [""])).join(single, "vx", "left").join(lasting.drop("variable"), "vx", "left").select(F.col("vx").alias("variable_index"), "variable", z("present").alias("n_entities_with_presence"), z("single").alias("n_excluded_single_timepoint"), *_change_columns())

    plain = counts.crossJoin(cel).select(F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(code).alias("issue_code"), F.col(c).alias("n_affected"), F.lit(text).alias("message")) for i, (code, c, text) in enumerate((("missing_entity_id", "n_missing_id", "rows without an entity id take no part"), ("blank_entity_id", "n_blank_id", "rows with a blank entity id take no part"), ("missing_time", "n_missing_time", "rows without a known time take no part"), ("duplicate_id_time", "n_duplicate_cells", "cells hold several rows")))])).alias("i")).select("i.*").where("n_affected > 0")
    none = lambda k, a: F.lit(None).cast(k).alias(a)
    plain = plain.select("issue_code", F.lit("warning").alias("severity"), none("int", "time_index"), none("string", "timepoint"), none("int", "variable_index"), none("string", "variable"), "n_affected", "message", "rank")
    conflict = by_time.where("n_conflicting > 0").select(F.lit("conflicting_variable_cell").alias("issue_code"), F.lit("warning").alias("severity"), "time_index", "timepoint", "variable_index", "variable", F.col("n_conflicting").alias("n_affected"), F.lit("cells hold different values").alias("message"), F.lit(4).alias("rank"))
    empty = filled.where("n_entities = 0").select(F.lit("zero_observation_timepoint").alias("issue_code"), F.lit("warning").alias("severity"), F.col("t").alias("time_index"), "timepoint", none("int", "variable_index"), none("string", "variable"), F.lit(0).cast("long").alias("n_affected"), F.lit("nobody was observed at this time").alias("message"), F.lit(5).alias("rank"))
    issues = plain.unionByName(conflict).unionByName(empty).orderBy("rank", "time_index", "variable_index").drop("rank")
    return Panel(
        structure=lambda: structure,
        observation_count=lambda: total("k", "n_timepoints_observed").drop("timepoint"),
        first_observation=lambda: total("first", "time_index"),
        last_observation=lambda: total("last", "time_index"),
        gap_status=gaps,
        timepoints=lambda: timepoints,
        missing_by_time=lambda: by_time,
        entity_summary=entity_summary,
        measurement_distribution=distribution,
        interior_missing=interior,
        change_adjacent=change_adjacent,
        change_first_to_last=first_last,
        issues=lambda: issues,
        summaries=lambda: profile_stratified(df, spec, time, include_missing_stratum=False) if summaries else None,
    )


def _changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Classes of pairs (conflict before missing before not finite) and statistics of the eligible differences."""
    d = F.col("x") - F.col("x0")
    finite = lambda c: F.abs(c) < float("inf")
    kind = F.when((F.col("k0") == 2) | (F.col("k") == 2), "conflict").when((F.col("k0") == 0) | (F.col("k") == 0), "missing").when(finite(F.col("x")) & finite(F.col("x0")) & finite(d), "eligible").otherwise("nonfinite")
    counted = materialised(pairs.select(*keys, kind.alias("kind"), F.when(kind == "eligible", d).alias("d")).groupBy(*keys, "kind", "d").agg(F.count(F.lit(1)).alias("c")), "changes")
    held = lambda s: F.coalesce(F.sum(F.when(F.col("kind") == s, F.col("c"))), F.lit(0))
    sizes = counted.groupBy(*keys).agg(F.sum("c").alias("n_present_both"), held("eligible").alias("n_eligible"), held("missing").alias("n_excluded_missing"), held("conflict").alias("n_excluded_conflict"), held("nonfinite").alias("n_excluded_nonfinite"))
    stats = numeric_statistics(counted.where("kind = 'eligible'").select(*keys, F.col("d").alias("v"), "c"), keys).select(*keys, "mean", "sd", "min", "q1", "median", "q3", "max", "iqr")
    return sizes.join(stats, keys, "left")


def _change_columns() -> list[Column]:
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_present_both", "n_eligible", "n_excluded_missing", "n_excluded_conflict", "n_excluded_nonfinite")]
    n = F.coalesce(F.col("n_eligible"), F.lit(0))
    return [*counts, n.alias("delta_n"), *[F.col(c) for c in ("mean", "sd", "min", "q1", "median", "q3", "max", "iqr")], F.lit("available").alias("status"), F.when(n == 0, "zero_eligible").alias("reason")]
