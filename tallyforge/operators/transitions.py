"""State transitions of entities between neighbouring periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import readings, safe_div, text_form
from ..spec import Spec
from ..storage import bounded, materialised
from .drift import MAX_LEVELS, need_levels
from .periods import Periods, valid_entity


@dataclass
class Transitions:
    state_audit: DataFrame
    transition_summary: DataFrame
    transition_counts: DataFrame
    issues: DataFrame


def longitudinal_transitions(periods: Periods, entity_id: str, spec: Spec, variables: list[str], max_levels: int = MAX_LEVELS) -> Transitions:
    """An entity's state in a period is missing (no value), usable (one) or conflicting (several).

    min and max of the values tell these apart, so a period's states need one aggregate
    with partial sums and no distinct counting.  Pairs are made by a window over the
    entity's own few rows.
    """
    need_levels(spec, variables)
    spec = spec.only(variables)
    spark, grid = periods.first.sparkSession, periods.grid()
    bound = {p: readings(df, spec) for p, df in enumerate(periods.tables.values(), 1)}
    order = {v: i for i, v in enumerate(variables, 1)}
    usable = [(p, r.name) for p, rs in bound.items() for r in rs if r.usable]

    parts = None
    for p, df in enumerate(periods.tables.values(), 1):
        _, _, valid = valid_entity(df, entity_id)
        # The member itself is a row too: an entity belongs to a period whatever its variables hold.
        cells = [F.struct(F.lit("").alias("variable"), F.lit(None).cast("string").alias("state"))]
        cells += [F.struct(F.lit(r.name).alias("variable"), F.when(~r.missing, text_form(r.column, r.dtype)).alias("state")) for r in bound[p] if r.usable]
        part = df.where(valid).select(F.lit(p).alias("p"), F.col(f"`{entity_id}`").cast("string").alias("entity"), F.explode(F.array(*cells)).alias("e")).select("p", "entity", "e.*")
        parts = part if parts is None else parts.unionByName(part)
    states = materialised(parts.groupBy("variable", "entity", "p").agg(F.min("state").alias("lo"), F.max("state").alias("hi")), "states")
    kind = F.when(F.col("lo").isNull(), 0).when(F.col("lo") == F.col("hi"), 1).otherwise(2)
    own = states.where("variable <> ''").withColumn("k", kind)

    cells = F.broadcast(spark.createDataFrame([(p, order[v], v, (p, v) in usable) for p in bound for v in variables], "p int, variable_index int, variable string, usable boolean"))
    counts = own.groupBy("p", "variable").agg(*[F.sum((F.col("k") == i).cast("long")).alias(n) for i, n in ((1, "u"), (0, "m"), (2, "x"))])
    members = states.where("variable = ''").groupBy("p").agg(F.count(F.lit(1)).alias("members"))
    zero = lambda c: F.when(F.col("usable"), F.coalesce(F.col(c), F.lit(0)))
    audit = cells.join(members, "p", "left").join(counts, ["p", "variable"], "left").join(grid, "p").select(
        F.col("p").alias("period_index"), F.col("label").alias("period"), "variable_index", "variable", F.coalesce("members", F.lit(0)).alias("n_valid_entities"), zero("u").alias("n_usable_state"), zero("m").alias("n_missing_state"), zero("x").alias("n_conflicting_state"),
        F.when(F.col("usable"), "available").otherwise("unavailable").alias("status"), F.when(~F.col("usable"), "the variable can't be read in this period").alias("reason"),
    )

    # Domains: declared levels, then what occurs, bytewise; bounded before any pair is counted.
    seen = own.where("lo is not null").select("variable", "p", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("state")).distinct()
    found: dict[tuple[str, int], set[str]] = {}
    for r in bounded(seen, max_levels * len(usable) if usable else 1, "the states"):
        found.setdefault((r["variable"], r["p"]), set()).add(r["state"])
    rows = []
    for v in variables:
        declared = list(spec[v].levels) or (["FALSE", "TRUE"] if spec[v].analysis_type == "binary" else [])
        for p in range(1, len(bound)):
            if (p, v) in usable and (p + 1, v) in usable:
                more = sorted((found.get((v, p), set()) | found.get((v, p + 1), set())) - set(declared), key=lambda s: s.encode())
                domain = declared + more
                if len(domain) > max_levels:
                    raise ValueError(f"the states of two neighbouring periods exceed {max_levels}")
                rows += [(v, p, i, s, s in declared if declared else None, s not in declared if declared else False) for i, s in enumerate(domain)]
    domain = F.broadcast(spark.createDataFrame(rows, "variable string, p int, place int, state string, declared boolean, unexpected boolean"))

    w = Window.partitionBy("variable", "entity").orderBy("p")
    members_and_states = states.withColumn("k", kind)
    pairs = members_and_states.select("variable", "entity", F.lag("p").over(w).alias("p0"), F.lag("k").over(w).alias("k0"), F.lag("lo").over(w).alias("from_state"), "p", "k", F.col("lo").alias("to_state")).where("p0 = p - 1")
    flow = materialised(pairs.groupBy("variable", F.col("p0").alias("p"), F.when(F.col("variable") == "", 9).when((F.col("k0") == 2) | (F.col("k") == 2), 2).when((F.col("k0") == 0) | (F.col("k") == 0), 0).otherwise(1).alias("k"), F.when((F.col("k0") == 1) & (F.col("k") == 1), F.col("from_state")).alias("from_state"), F.when((F.col("k0") == 1) & (F.col("k") == 1), F.col("to_state")).alias("to_state")).agg(F.count(F.lit(1)).alias("n")), "flows")
    retained = flow.where("k = 9").groupBy("p").agg(F.sum("n").alias("n_retained"))
    by = flow.where("variable <> ''").groupBy("variable", "p").agg(*[F.coalesce(F.sum(F.when(F.col("k") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in ((1, "e"), (0, "mi"), (2, "co"))])
    pair_rows = [(p, order[v], v, (p, v) in usable and (p + 1, v) in usable) for p in range(1, len(bound)) for v in variables]
    pair = F.broadcast(spark.createDataFrame(pair_rows, "p int, variable_index int, variable string, both boolean"))
    sizes = domain.groupBy("variable", "p").agg(F.count(F.lit(1)).alias("d"))
    e = F.when(F.col("both"), F.coalesce(F.col("e"), F.lit(0)))
    status = F.when(~F.col("both") | (e == 0), "unavailable").otherwise("available")
    reason = F.when(~F.col("both"), "the variable can't be read in both periods").when(e == 0, "zero_eligible")
    left = [F.col("p").alias("left_period_index"), periods.label(F.col("p")).alias("left_period"), (F.col("p") + 1).alias("right_period_index"), periods.label(F.col("p") + 1).alias("right_period")]
    joined = pair.join(retained, "p", "left").join(by, ["variable", "p"], "left").join(sizes, ["variable", "p"], "left")
    summary = joined.select(
        *left, "variable_index", "variable", F.coalesce("n_retained", F.lit(0)).alias("n_retained"), e.alias("n_eligible"), F.when(F.col("both"), F.coalesce("mi", F.lit(0))).alias("n_excluded_missing"), F.when(F.col("both"), F.coalesce("co", F.lit(0))).alias("n_excluded_conflict"),
        F.coalesce(F.col("d") * F.col("d"), F.lit(0)).cast("int").alias("n_transition_cells"), e.alias("eligible_denominator"), status.alias("status"), reason.alias("reason"),
    )
    a, b = (domain.select("variable", "p", *[F.col(c).alias(f"{s}_{c}") for c in ("place", "state", "declared", "unexpected")]) for s in ("from", "to"))
    moves = flow.where("k = 1").select("variable", "p", "from_state", "to_state", F.col("n").alias("moved"))
    full = a.join(b, ["variable", "p"]).join(moves, ["variable", "p", "from_state", "to_state"], "left").join(joined.where("both").select("variable", "p", "variable_index", "both", "e"), ["variable", "p"])
    n = F.coalesce("moved", F.lit(0))
    matrix = full.select(
        *left, "variable_index", "variable", "from_state", "to_state", n.alias("n"), e.alias("eligible_denominator"), safe_div(n, e).alias("proportion"), F.col("from_declared").alias("from_is_declared"), F.col("from_unexpected").alias("from_is_unexpected"), F.col("to_declared").alias("to_is_declared"), F.col("to_unexpected").alias("to_is_unexpected"),
        F.when(e == 0, "unavailable").otherwise("available").alias("status"), F.when(e == 0, "zero_eligible").alias("reason"),
    )
    none = lambda t: F.lit(None).cast(t)
    shape = lambda d, code, lp, n, text, pair=False: d.select(
        F.lit(code).alias("issue_code"), F.lit("warning").alias("severity"), *((none("int").alias("period_index"), none("string").alias("period"), "left_period_index", "left_period", "right_period_index", "right_period") if pair else ("period_index", "period", none("int").alias("left_period_index"), none("string").alias("left_period"), none("int").alias("right_period_index"), none("string").alias("right_period"))),
        "variable_index", "variable", n.cast("long").alias("n_affected"), F.lit(text).alias("message"),
    )
    issues = shape(audit.where("status = 'unavailable'"), "unavailable_variable", None, none("long"), "the variable can't be read in this period").unionByName(
        shape(audit.where("n_conflicting_state > 0"), "conflicting_state", None, F.col("n_conflicting_state"), "entities have several states in one period")
    ).unionByName(shape(summary.where("reason = 'zero_eligible'"), "zero_eligible", None, F.lit(0), "no entity has a usable state in both periods", True))
    return Transitions(audit, summary, matrix, issues)
