"""Quality evidence with pending proposals, reviewed cleaning rules, relationships of columns, identifiers and coordinates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import Reading, is_infinite, is_missing, quoted, readings, text_form, typed_codes
from ..spec import Spec, SpecError, storage_family
from ..storage import TooManyRows, bounded, materialised
from .profile import ALL, NUMERIC, Profile

_KEY = re.compile(r"var_[a-z0-9]{16,64}")


def check_keys(keys: Mapping[str, str], names: Iterable[str]) -> dict[str, str]:
    """name -> opaque key, unique and well formed, for each of the names."""
    out = {n: keys.get(n, "") for n in names}
    if any(not _KEY.fullmatch(k) for k in out.values()) or len(set(out.values())) != len(out):
        raise SpecError("variable keys must be unique and look like var_ and 16 to 64 small letters or digits")
    return out


EVIDENCE = "variable_key string, evidence_state string, declared_type string, profile_status string, evidence_code string, n long, n_missing long, n_observed long, n_unique long, n_infinite long, n_finite long, observed_min double, observed_max double, tukey_lower_fence double, tukey_upper_fence double, n_below_tukey long, n_above_tukey long"
PROPOSALS = "variable_key string, proposal_state string, candidate_type string, units_review_required boolean, candidate_units string, candidate_screening_min double, candidate_screening_max double, screening_basis string, candidate_allowed_levels string, candidate_missing_codes string, rationale_codes string"


def quality_proposals(df: DataFrame, spec: Spec, keys: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(evidence, proposals): counts and fences of each variable under its opaque key, and what a reviewer might decide.

    Identifiers are not profiled.  Nothing is changed; every proposal is pending.
    """
    key, spark = check_keys(keys, spec.names), df.sparkSession
    p = Profile(df, Spec(tuple(v for v in spec if not v.is_identifier)), None, True)
    basic = {r["name"]: r for r in p.basic.where(F.col("g") == ALL).collect()}
    stats = {r["name"]: r for r in p.numeric().collect()}
    bound = {r.name: r for r in p.readings}
    total, evidence, proposals = p.totals.get(ALL, 0), [], []
    for v in spec:
        head = (key[v.name], "observed", v.analysis_type)
        if v.is_identifier or not bound[v.name].usable:
            code = "identifier_not_profiled" if v.is_identifier else "absent" if bound[v.name].dtype is None else "incompatible_storage"
            evidence.append((*head, "not_profiled", code, total, *[None] * 11))
            continue
        b, s = basic.get(v.name), stats.get(v.name)
        n = (b["n"], b["n_missing"], b["n_observed"], b["n_unique"], b["n_infinite"]) if b else (0, 0, 0, 0, 0)
        if s is not None:
            own = (s["n_finite"], s["min"], s["max"], s["lower_fence"], s["upper_fence"], s["n_below_lower"], s["n_above_upper"])
        else:
            own = (None,) * 7
        evidence.append((*head, "profiled", "profiled", *n, *own))
        why, number = [], v.analysis_type in NUMERIC
        units = v.analysis_type in (*NUMERIC, "date", "datetime") and not v.units.strip()
        binary = number and n[2] > 0 and n[3] == 2 and n[4] == 0 and own[1] == 0 and own[2] == 1
        fenced = number and not binary and own[3] is not None and (own[5] or 0) + (own[6] or 0) > 0
        for hit, code in ((units, "units_not_declared"), (binary, "observed_integral_zero_one"), (fenced, "finite_values_beyond_tukey"), (number and n[4] > 0, "non_finite_values_present")):
            if hit:
                why.append(code)
        if why:
            proposals.append((key[v.name], "pending", "binary" if binary else "", units, "", own[3] if fenced else None, own[4] if fenced else None, "tukey_1_5_iqr" if fenced else "", "0;1" if binary else "", "", ";".join(why)))
    return spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(proposals, PROPOSALS)


@dataclass(frozen=True)
class Rule:
    """A reviewed rule: what makes a value of one variable missing."""

    variable_key: str
    declared_type: str
    valid_min: float | None = None
    valid_max: float | None = None
    allowed_values: tuple[str, ...] = ()
    missing_codes: tuple[str, ...] = ()


def cleaning_rules(rows: Iterable[Mapping[str, object]]) -> tuple[Rule, ...]:
    """Rules of exactly the six fields, checked and in the order of their keys."""
    names = {"variable_key", "declared_type", "valid_min", "valid_max", "allowed_values", "missing_codes"}
    out = []
    for row in rows:
        if set(row) != names:
            raise SpecError("a cleaning rule has exactly six fields")
        kind = str(row["declared_type"])
        if not _KEY.fullmatch(str(row["variable_key"])):
            raise SpecError("a cleaning rule needs an opaque variable key")
        if kind not in ("numeric", "integer", "categorical", "binary"):
            raise SpecError("cleaning rules are for numbers and categories")
        tokens = lambda x: tuple(t for t in str(x or "").split(";") if t)
        bounds = [None if b in (None, "") else float(b) for b in (row["valid_min"], row["valid_max"])]
        rule = Rule(str(row["variable_key"]), kind, bounds[0], bounds[1], tokens(row["allowed_values"]), tokens(row["missing_codes"]))
        if kind not in NUMERIC and (rule.valid_min is not None or rule.valid_max is not None):
            raise SpecError("only numbers have bounds")
        if any(b is not None and not math.isfinite(b) for b in bounds) or (None not in bounds and bounds[0] > bounds[1]):
            raise SpecError("bounds must be finite and ordered")
        if not (rule.allowed_values or rule.missing_codes or rule.valid_min is not None or rule.valid_max is not None):
            raise SpecError("a cleaning rule must do something")
        if len(set(rule.allowed_values)) != len(rule.allowed_values) or len(set(rule.missing_codes)) != len(rule.missing_codes):
            raise SpecError("values of a rule must be unique")
        out.append(rule)
    if not out or len({r.variable_key for r in out}) != len(out):
        raise SpecError("rules must be there, one for each variable")
    return tuple(sorted(out, key=lambda r: r.variable_key.encode()))


def _transition(rule: Rule, x: Column, dtype) -> Column:
    """Whether the rule makes an observed value missing; false for what is missing already."""
    family = storage_family(dtype)
    if (rule.declared_type in NUMERIC) != (family in ("numeric", "integer")):
        raise SpecError("a rule's type does not fit its column")
    hit = F.lit(False)
    if rule.missing_codes:
        hit = hit | (x.isin(typed_codes(dtype, rule.missing_codes)) if rule.declared_type in NUMERIC else text_form(x, dtype).isin(list(rule.missing_codes)))
    if rule.valid_min is not None:
        hit = hit | (x < F.lit(rule.valid_min))
    if rule.valid_max is not None:
        hit = hit | (x > F.lit(rule.valid_max))
    if rule.allowed_values:
        hit = hit | ~(x.isin(typed_codes(dtype, rule.allowed_values)) if rule.declared_type in NUMERIC else text_form(x, dtype).isin(list(rule.allowed_values)))
    return ~is_missing(x, dtype) & F.coalesce(hit, F.lit(False))


def apply_rules(df: DataFrame, rules: tuple[Rule, ...], keys: Mapping[str, str], output_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned table, audit): one projection, one aggregate; with a path the table is written, never over another, and read again."""
    by_key = {k: n for n, k in check_keys(keys, keys).items()}
    plan = []
    for r in rules:
        if r.variable_key not in by_key or by_key[r.variable_key] not in df.columns:
            raise SpecError("a rule's key names no column")
        name = by_key[r.variable_key]
        plan.append((r, name, _transition(r, quoted(name), df.schema[name].dataType)))
    cleaned = df.withColumns({name: F.when(~hit, quoted(name)) for _, name, hit in plan})
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"{a}{i}") for i, (_, name, hit) in enumerate(plan) for a, c in (("m", is_missing(quoted(name), df.schema[name].dataType)), ("t", hit))]).first()
    if output_path:
        cleaned.write.mode("errorifexists").parquet(output_path)
        cleaned = df.sparkSession.read.parquet(output_path)
    after = cleaned.agg(*[F.coalesce(F.sum(is_missing(quoted(name), df.schema[name].dataType).cast("long")), F.lit(0)).alias(f"a{i}") for i, (_, name, _) in enumerate(plan)]).first()
    rows = [(r.variable_key, sums["n"], sums[f"m{i}"], after[f"a{i}"], sums[f"t{i}"], sums[f"m{i}"] + sums[f"t{i}"] == after[f"a{i}"]) for i, (r, _, _) in enumerate(plan)]
    if not all(r[-1] for r in rows):
        raise AssertionError("missing values after cleaning do not reconcile with those before")
    return cleaned, df.sparkSession.createDataFrame(rows, "variable_key string, n long, n_missing_before long, n_missing_after long, n_transitioned_to_missing long, reconciled boolean")


def relationship_profile(df: DataFrame, pairs: list[tuple[str, str]], max_levels: int = 500, names: tuple[str, str] = ("", "")) -> dict[str, DataFrame]:
    """summary, mappings and conflicts of directed column pairs; all pairs are bounded before any value is shown."""
    spark = df.sparkSession
    for a, b in pairs:
        if a == b or not {a, b} <= set(df.columns):
            raise SpecError("a pair names two different columns")
    form = lambda c: text_form(quoted(c), df.schema[c].dataType)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), form(a).alias("left_value"), form(b).alias("right_value")) for i, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")
    joint = materialised(long.groupBy("pair", "left_value", "right_value").agg(F.count(F.lit(1)).alias("n")), "relationships")
    l, r = F.col("left_value").isNotNull(), F.col("right_value").isNotNull()
    held = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sizes = joint.groupBy("pair").agg(F.sum("n").alias("total_rows"), held(l & r).alias("both_present"), held(~l & r).alias("left_missing"), held(l & ~r).alias("right_missing"), held(~l & ~r).alias("both_missing"), F.count(F.when(l & r, 1)).alias("distinct_combinations"))
    both = joint.where(l & r)

    def side(own: str, fan: str, many: str, count: str) -> DataFrame:
        per = both.groupBy("pair", own).agg(F.count(F.lit(1)).alias("k"))
        return per.groupBy("pair").agg(F.count(F.lit(1)).alias(count), F.max("k").alias(fan), F.sum((F.col("k") > 1).cast("long")).alias(many))

    full = sizes.join(side("left_value", "max_right_per_left", "left_values_with_multiple_right", "distinct_left"), "pair", "left").join(side("right_value", "max_left_per_right", "right_values_with_multiple_left", "distinct_right"), "pair", "left")
    full = full.fillna(0)
    rl, lr = F.col("max_right_per_left"), F.col("max_left_per_right")
    kind = F.when(F.col("both_present") == 0, "insufficient_data").when((F.col("distinct_left") == 1) & (F.col("distinct_right") == 1), "one_to_one").when(F.col("distinct_left") == 1, "constant_left").when(F.col("distinct_right") == 1, "constant_right").when((rl == 1) & (lr == 1), "one_to_one").when((rl > 1) & (lr == 1), "one_to_many").when((rl == 1) & (lr > 1), "many_to_one").otherwise("many_to_many")
    if sizes.where(F.col("distinct_combinations") > max_levels).limit(1).count():
        raise TooManyRows(f"a pair has more than {max_levels} combinations")
    schema, table = names
    ends = F.broadcast(spark.createDataFrame([(i, schema, table, a, schema, table, b) for i, (a, b) in enumerate(pairs)], "pair int, left_schema string, left_table string, left_column string, right_schema string, right_table string, right_column string"))
    keys = ["left_schema", "left_table", "left_column", "right_schema", "right_table", "right_column"]
    counts = ["total_rows", "both_present", "left_missing", "right_missing", "both_missing", "distinct_left", "distinct_right", "distinct_combinations", "max_right_per_left", "max_left_per_right", "left_values_with_multiple_right", "right_values_with_multiple_left"]
    summary = ends.join(full, "pair").select(*keys, *counts, kind.alias("relationship_class"))
    mappings = ends.join(both, "pair").select(*keys, "left_value", "right_value", "n")
    many_r = F.count(F.lit(1)).over(Window.partitionBy("pair", "left_value")) > 1
    many_l = F.count(F.lit(1)).over(Window.partitionBy("pair", "right_value")) > 1
    flagged = both.withColumn("x", F.filter(F.array(F.when(many_r, "left_maps_multiple_right"), F.when(many_l, "right_maps_multiple_left")), lambda x: x.isNotNull())).select("pair", F.explode("x").alias("exception_type"), "left_value", "right_value", "n")
    gone = full.select("pair", F.explode(F.array(*[F.struct(F.lit(c).alias("exception_type"), F.col(c).alias("n")) for c in ("left_missing", "right_missing", "both_missing")])).alias("e")).where("e.n > 0").select("pair", "e.exception_type", F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"), "e.n")
    conflicts = ends.join(flagged.unionByName(gone), "pair").select(*keys, "exception_type", "left_value", "right_value", "n")
    return {"summary": summary, "mappings": mappings, "conflicts": conflicts}


@dataclass(frozen=True)
class Identifier:
    name: str
    expected_length: int | None = None
    pattern: str | None = None
    case_sensitive: bool = True
    provenance: str = ""


def identifier_qc(df: DataFrame, identifiers: list[Identifier]) -> tuple[DataFrame, DataFrame]:
    """(form and repetition of each identifier, rows by which identifiers are there).

    ``case_sensitive`` is stated in the result only; patterns are always matched as written.
    """
    out = None
    for i in identifiers:
        value = quoted(i.name).cast("string")
        by = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
        v, c = F.col("v"), F.col("c")
        full = v.isNotNull() & (F.trim(v) != "")
        pattern = None if i.pattern is None else i.pattern.replace("[[:space:]]", r"\s").replace("[:space:]", r"\s")
        held = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
        main = by.agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("n_input"), held(v.isNull()).alias("n_null"), held(F.trim(v) == "").alias("n_blank"), held(full).alias("n_nonblank"), F.count(F.when(full, 1)).alias("n_distinct"), F.coalesce(F.sum(F.when(full, c - 1)), F.lit(0)).alias("duplicate_excess"), F.coalesce(F.max(F.when(full, c)), F.lit(0)).alias("max_frequency"),
            held(v.rlike(r"^\s")).alias("n_leading_whitespace"), held(v.rlike(r"\s$")).alias("n_trailing_whitespace"), held(F.trim(v).rlike(r"\s")).alias("n_internal_whitespace"), F.coalesce(F.min(F.when(full, F.char_length(v))), F.lit(0)).cast("long").alias("min_length"), F.coalesce(F.max(F.when(full, F.char_length(v))), F.lit(0)).cast("long").alias("max_length"),
            held(full & (F.char_length(v) != i.expected_length) if i.expected_length is not None else F.lit(False)).alias("n_expected_length_violations"), held(full & ~v.rlike(pattern) if pattern is not None else F.lit(False)).alias("n_pattern_violations"),
        )
        cases = by.where(full).groupBy(F.lower("v").alias("f")).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias("n_case_variations"))
        one = main.crossJoin(F.broadcast(cases)).select(F.lit(i.name).alias("name"), F.lit(i.expected_length).cast("int").alias("expected_length"), F.lit(i.pattern is not None).alias("pattern_declared"), F.lit(i.case_sensitive).alias("case_sensitive"), F.lit(i.provenance).alias("provenance"), "*")
        out = one if out is None else out.unionByName(one)
    if len(identifiers) == 1:
        patterns = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("only_identifier").alias("pattern"), "n_rows")
    else:
        flag = lambda n: F.when(quoted(n).isNotNull() & (F.trim(quoted(n).cast("string")) != ""), "1").otherwise("0")
        patterns = df.groupBy(F.concat_ws("_", *[flag(i.name) for i in identifiers]).alias("pattern")).agg(F.count(F.lit(1)).alias("n_rows"))
    return out, patterns


def coordinate_profile(df: DataFrame, spec: Spec) -> DataFrame:
    """Readiness of each coordinate pair.  NaN counts as not finite here, not as missing; EPSG:4326 has ranges."""
    pairs: dict[str, dict[str, Reading]] = {}
    for r in readings(df, spec):
        if r.variable.geo_role:
            pairs.setdefault(r.variable.geo_pair, {})[r.variable.geo_role] = r
    out = None
    for name, ends in pairs.items():
        x, y = ends["x"], ends["y"]
        if x.dtype is None or y.dtype is None:
            raise SpecError("a coordinate column is not in the data")
        num = lambda r: r.column.cast("double")
        gone = lambda r: F.coalesce(r.column.isNull() | (r.column.isin(typed_codes(r.dtype, r.variable.missing_codes)) if r.variable.missing_codes else F.lit(False)), F.lit(True))
        mx, my = gone(x), gone(y)
        odd = lambda r: F.isnan(num(r)) | is_infinite(num(r))
        strange = ~mx & ~my & (odd(x) | odd(y))
        plain = ~mx & ~my & ~strange
        epsg = int(x.variable.geo_crs.split(":")[1])
        outside = plain & ((F.abs(num(x)) > 180) | (F.abs(num(y)) > 90)) if epsg == 4326 else F.lit(False)
        s = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        one = df.agg(F.count(F.lit(1)).alias("n"), s(~mx & ~my).alias("complete_pairs"), s(mx & ~my).alias("missing_x"), s(~mx & my).alias("missing_y"), s(mx & my).alias("both_missing"), s(strange).alias("non_finite"), s(outside).alias("range_failures"))
        why = F.concat_ws(";", F.when(F.col("missing_x") + F.col("missing_y") + F.col("both_missing") > 0, "incomplete_pairs"), F.when(F.col("non_finite") > 0, "non_finite_coordinates"), F.when(F.col("range_failures") > 0, "declared_crs_range_failure"))
        ready = (F.col("n") > 0) & (why == "")
        one = one.select(F.lit(name).alias("geo_pair"), F.lit(x.name).alias("x_name"), F.lit(y.name).alias("y_name"), F.lit(x.variable.geo_crs).alias("geo_crs"), F.lit(epsg).alias("crs_epsg"), "n", "complete_pairs", "missing_x", "missing_y", "both_missing", "non_finite", "range_failures", ready.alias("map_ready"), F.when(ready, "ready").otherwise("not_ready").alias("status"), F.when(F.col("n") == 0, "no_rows").when(ready, "all_rows_map_ready").otherwise(why).alias("reason"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return df.sparkSession.createDataFrame([], "geo_pair string, x_name string, y_name string, geo_crs string, crs_epsg int, n long, complete_pairs long, missing_x long, missing_y long, both_missing long, non_finite long, range_failures long, map_ready boolean, status string, reason string")
    return out


def points_in_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, max_features: int = 10_000) -> list:
    """At most ``max_features`` points of a bounding box (x and y least, then greatest) on the driver; raises beyond that."""
    rows = df.where(quoted(x).isNotNull() & quoted(y).isNotNull())
    if box:
        rows = rows.where(quoted(x).between(box[0], box[2]) & quoted(y).between(box[1], box[3]))
    return bounded(rows.select(quoted(x), quoted(y), *[quoted(c) for c in columns or []]), max_features, "the points of the map")


def describe_points(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Count, missing and invalid points and the bounding box, in all or by group."""
    a, b = quoted(x).cast("double"), quoted(y).cast("double")
    gone = a.isNull() | b.isNull()
    bad = ~gone & (F.isnan(a) | F.isnan(b) | is_infinite(a) | is_infinite(b))
    good = lambda c: F.when(~gone & ~bad, c)
    aggs = [F.count(F.lit(1)).alias("n_features"), F.sum(gone.cast("long")).alias("n_null"), F.sum(bad.cast("long")).alias("n_invalid"), F.min(good(a)).alias("xmin"), F.min(good(b)).alias("ymin"), F.max(good(a)).alias("xmax"), F.max(good(b)).alias("ymax")]
    return df.groupBy(quoted(group)).agg(*aggs) if group else df.agg(*aggs)


