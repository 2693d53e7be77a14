"""Population quality over ordered periods: ids, record keys, overlap, retention, history and issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import is_missing, quoted, safe_div
from ..spec import storage_family
from ..storage import materialised
from .periods import Periods, valid_entity


@dataclass
class PopulationQC:
    period_summary: DataFrame
    pairwise_overlap: DataFrame
    adjacent: DataFrame
    entity_history: DataFrame
    issues: DataFrame


def population_qc(periods: Periods, entity_id: str, record_key: list[str] | None = None) -> PopulationQC:
    """One scan makes a table of (period, entity, rows); all counts of populations come from that."""

    def columns(df: DataFrame) -> list:
        null, blank, valid = valid_entity(df, entity_id)
        state = F.when(null, "null").when(blank, "blank").otherwise("valid")
        return [state.alias("state"), F.when(valid, quoted(entity_id).cast("string")).alias("entity")]

    members = materialised(periods.stacked(columns).groupBy("p", "state", "entity").agg(F.count(F.lit(1)).alias("c")), "members")
    grid = periods.grid()
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    held = lambda s: zero(F.sum(F.when(F.col("state") == s, F.col("c"))))
    valid = F.col("state") == "valid"
    by = members.groupBy("p").agg(
        F.sum("c").alias("n_rows"), held("null").alias("n_entity_null"), held("blank").alias("n_entity_blank"), held("valid").alias("n_entity_nonblank"), held("valid").alias("n_valid_entity_rows"), F.count(F.when(valid, 1)).alias("n_distinct_entities"),
        zero(F.sum(F.when(valid & (F.col("c") > 1), F.col("c")))).alias("n_repeated_entity_rows"), zero(F.sum(F.when(valid, F.col("c") - 1))).alias("n_repeated_entity_excess"), zero(F.max(F.when(valid, F.col("c")))).alias("max_entity_frequency"),
    )
    names = [c for c in by.columns if c != "p"]
    summary = grid.join(by, "p", "left").select("p", "label", *[zero(F.col(c)).alias(c) for c in names])
    key_names = ["n_missing_record_key", "n_complete_record_key_rows", "n_distinct_record_keys", "n_duplicate_record_key_groups", "n_duplicate_record_key_rows", "n_duplicate_record_key_excess", "max_record_key_frequency"]
    if record_key:

        def key_columns(df: DataFrame) -> list:
            gone = F.lit(False)
            for c in record_key:
                x, dtype = quoted(c), df.schema[c].dataType
                gone = gone | is_missing(x, dtype) | (F.trim(x) == "" if storage_family(dtype) == "text" else F.lit(False))
            return [F.when(~gone, F.struct(*[quoted(c).cast("string").alias(f"k{i}") for i, c in enumerate(record_key)])).alias("key")]

        counted = periods.stacked(key_columns).groupBy("p", "key").agg(F.count(F.lit(1)).alias("c"))
        some, many = F.col("key").isNotNull(), F.col("key").isNotNull() & (F.col("c") > 1)
        keys = counted.groupBy("p").agg(*[
            zero(e).alias(n) for n, e in zip(key_names, (
                F.sum(F.when(~some, F.col("c"))), F.sum(F.when(some, F.col("c"))), F.count(F.when(some, 1)), F.count(F.when(many, 1)), F.sum(F.when(many, F.col("c"))), F.sum(F.when(many, F.col("c") - 1)), F.max(F.when(some, F.col("c"))),
            ))
        ])
        summary = summary.join(keys, "p", "left").select(*summary.columns, *[zero(F.col(c)).alias(c) for c in key_names])
    else:
        summary = summary.select("*", *[F.lit(None).cast("long").alias(c) for c in key_names])
    period_summary = summary.withColumnsRenamed({"p": "period_index", "label": "period_label"})

    # The periods of an entity are as few as there are periods, so pairs need no join of the entities with themselves.
    seen = materialised(members.where(valid).groupBy("entity").agg(F.array_sort(F.collect_set("p")).alias("ps")), "entity-periods")
    pairs = seen.select(F.explode("ps").alias("l"), "ps").select("l", F.explode("ps").alias("r")).where("l < r").groupBy("l", "r").agg(F.count(F.lit(1)).alias("n_overlap"))
    size = summary.select("p", "n_distinct_entities")
    every = grid.select(F.col("p").alias("l"), F.col("label").alias("left_label")).crossJoin(grid.select(F.col("p").alias("r"), F.col("label").alias("right_label"))).where("l < r")
    over = every.join(pairs, ["l", "r"], "left").join(size.select(F.col("p").alias("l"), F.col("n_distinct_entities").alias("nl")), "l").join(size.select(F.col("p").alias("r"), F.col("n_distinct_entities").alias("nr")), "r").withColumn("n", zero(F.col("n_overlap")))
    overlap = over.select(
        F.col("l").alias("left_period_index"), F.col("left_label").alias("left_period_label"), F.col("r").alias("right_period_index"), F.col("right_label").alias("right_period_label"), F.col("nl").alias("n_left_entities"), F.col("nr").alias("n_right_entities"), F.col("n").alias("n_overlap"),
        (F.col("nl") + F.col("nr") - F.col("n")).alias("n_union"), (F.col("nl") - F.col("n")).alias("n_left_only"), (F.col("nr") - F.col("n")).alias("n_right_only"), F.col("nl").alias("left_overlap_denominator"), safe_div(F.col("n"), F.col("nl")).alias("left_overlap_proportion"), F.col("nr").alias("right_overlap_denominator"), safe_div(F.col("n"), F.col("nr")).alias("right_overlap_proportion"),
    )
    near = overlap.where("right_period_index = left_period_index + 1")
    nf, nt, kept = F.col("n_left_entities"), F.col("n_right_entities"), F.col("n_overlap")
    adjacent = near.select(
        F.col("left_period_index").alias("from_period_index"), F.col("left_period_label").alias("from_period_label"), F.col("right_period_index").alias("to_period_index"), F.col("right_period_label").alias("to_period_label"), nf.alias("n_from_entities"), nt.alias("n_to_entities"), "n_union",
        kept.alias("n_retained"), (nf - kept).alias("n_exited"), (nt - kept).alias("n_entered"), kept.alias("retention_numerator"), nf.alias("retention_denominator"), safe_div(kept, nf).alias("retention_proportion"), nf.alias("exit_denominator"), safe_div(nf - kept, nf).alias("exit_proportion"),
        (nt - kept).alias("entry_numerator"), nt.alias("entry_denominator"), safe_div(nt - kept, nt).alias("entry_proportion"),
    )
    first, last, k = F.col("ps")[0], F.element_at("ps", -1), F.size("ps")
    kinds = seen.groupBy(first.alias("first_period_index"), last.alias("last_period_index"), k.alias("periods_observed")).agg(F.count(F.lit(1)).alias("n_entities"))
    gaps = F.col("last_period_index") - F.col("first_period_index") + 1 - F.col("periods_observed")
    total = F.sum("n_entities").over(Window.partitionBy())
    history = kinds.select(
        "first_period_index", periods.label(F.col("first_period_index")).alias("first_period_label"), "last_period_index", periods.label(F.col("last_period_index")).alias("last_period_label"), "periods_observed", gaps.alias("gap_periods"), (gaps > 0).alias("has_gap"), "n_entities", total.alias("proportion_denominator"), safe_div(F.col("n_entities"), total).alias("proportion")
    )
    bad_ids = F.col("n_entity_null") + F.col("n_entity_blank")
    rules = [
        (F.col("n_rows") == 0, "empty_period", F.lit(None), F.lit(0), "the period has no rows"),
        (bad_ids > 0, "invalid_entity_id", F.lit(entity_id), bad_ids, "entity ids are null or blank"),
        (F.coalesce(F.col("n_missing_record_key"), F.lit(0)) > 0, "missing_record_key", F.lit(",".join(record_key or [])), F.col("n_missing_record_key"), "record keys are incomplete"),
        (F.coalesce(F.col("n_duplicate_record_key_excess"), F.lit(0)) > 0, "duplicate_record_key", F.lit(",".join(record_key or [])), F.col("n_duplicate_record_key_excess"), "complete record keys repeat within the period"),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(code).alias("issue_code"), F.lit("warning").alias("severity"), f.cast("string").alias("field"), n.cast("long").alias("n_affected"), F.lit(m).alias("message"))) for c, code, f, n, m in rules]), lambda x: x.isNotNull())
    issues = period_summary.select("period_index", "period_label", F.explode(found).alias("i")).select("period_index", "period_label", "i.*")
    return PopulationQC(period_summary, overlap, adjacent, history, issues)
