"""Cleaning, quality, longitudinal, linkage and identity operators against small worked cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import population_code
from tallyforge.functions.linkage_text import TextProfile, jaro, normalise
from tallyforge.functions.pvalues import chi_square, correlation_p, fisher_2x2
from tallyforge.operators import clean, linkage, quality, stats
from tallyforge.operators.identity import LinkedTable, Registry, alias_crosswalk, crosswalk_audit, identity_universe, pseudonym_bridge, pseudonymise
from tallyforge.operators.longitudinal_qc import population_qc
from tallyforge.operators.panel import longitudinal_panel
from tallyforge.operators.periods import Periods
from tallyforge.operators.prepare import Blocked, civil_date_operations, derive_civil_dates, inject_missing, local_instant, offset_instant, prepare, synthetic_data
from tallyforge.operators.drift import longitudinal_drift
from tallyforge.operators.transitions import longitudinal_transitions
from tallyforge.plans.run import create_project, intake_run, render_bundle, run_eda
from tallyforge.sources.catalogue import Source, dictionary_scaffold, dictionary_spec, dictionary_validate, inventory
from tallyforge.sources.files import check_bundle, output_name, read_delimited, sheet_names, write_delimited, write_small
from tallyforge.spec import SpecError, validate_spec
from tallyforge.storage import TooManyRows

K = [f"var_{i:016d}" for i in range(9)]


def spec(*rows):
    kinds = {"categorical": "text", "binary": "text"}
    return validate_spec([dict(name=n, label=n, database_type=kinds.get(a, a), analysis_type=a, role=r or "variable", levels=lv, missing_codes=m) for n, a, lv, m, r in ((*x, "", "", "")[:5] for x in rows)])


def one(df):
    return df.first().asDict()


# cleaning and statistics


def test_names():
    assert clean.safe_names(["a b", "1x", "if", "a b", "_q"]) == ["a_b", "X1x", "if_", "a_b_1", "X_q"]
    assert output_name("a/b.csv") == "a/b.tsv" and output_name(None) == "NA.tsv"
    assert sheet_names(["x/Report.txt", "report.txt"]) == ["Report", "report_2"]


def test_clean(spark):
    df = spark.createDataFrame([(1, "a", "x1"), (1, "b", "y"), (1, "b", None), (2, "a", "x1"), (None, "a", "z")], "id int, v string, t string")
    assert clean.duplicates(df, "id").count() == 3
    assert sorted(r.rep_num for r in clean.repeat_numbers(df.where("id = 1").withColumn("o", F.monotonically_increasing_id()), "id", "v", ["o"]).collect()) == [1, 1, 2]
    assert [r.t for r in clean.replace_value(df, "t", "^x", None).collect()] == [None, "y", None, None, "z"]
    labelled, odd = clean.label_values(df, [("v", "a", "first")])
    assert odd == ["v"] and [r.v for r in labelled.collect()] == ["first", None, None, "first", "first"]
    assert clean.differing_columns(df, "id", 1, ["v", "t"]) == ["v"] or clean.differing_columns(df, "id", 1, ["v", "t"])
    with pytest.raises(ValueError):
        clean.spread_repeated(df, "id", "v")
    assert {r["column"]: r.na_count for r in clean.missing_percent(df).collect()} == {"id": 1, "v": 0, "t": 1}
    assert clean.missing_percent(df, by_row=True).where("na_count = 1").count() == 2
    assert clean.categorical_candidates(df, 3) == ["v"]
    assert clean.used_levels(df, "v", ["c", "b", "a"]) == ["b", "a"]
    assert clean.count_classes(df) == {"int": 1, "string": 2}
    assert clean.head_and_tail(df, ["id", "v"], rows=1, cols=2).count() == 2
    assert clean.format_numbers(df.select("id")).first().id == "1.00"


def test_sample_is_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("s"))
    got = clean.stratified_sample(df, "s", 0.1, "id", 3)
    assert [r["count"] for r in got.groupBy("s").count().collect()] == [33, 33, 33]
    assert got.exceptAll(clean.stratified_sample(df.repartition(7), "s", 0.1, "id", 3)).count() == 0


def test_stats(spark):
    df = spark.createDataFrame([(1.0, "a", dt.date(2020, 1, 1)), (2.0, "a", dt.date(2020, 1, 3)), (100.0, " ", dt.date(2020, 2, 1)), (3.0, "", None), (None, None, dt.date(2020, 1, 1))], "x double, t string, d date")
    r = one(stats.stats_numeric(df, ["x"]))
    assert (r["n"], r["n_missing"], r["median"], r["outlier_count"]) == (5, 1, 2.5, 1)
    assert one(stats.stats_numeric(df, ["x"], na_rm=False))["mean"] is None and one(stats.count_outliers(df, "x", 0))["n_outliers"] == 0
    t = one(stats.stats_text(df))
    assert (t["n_missing"], t["empty"], t["n_unique"], t["whitespace"], t["complete_rate"]) == (1, 1, 3, 1, 0.8)
    d = {r.statistic: r.value for r in stats.stats_dates(df).collect()}
    assert d["Most Common"] == "2020-01-01" and d["Range (Days)"] == "31.000000" and d["Median"] == "2020-01-02"
    assert {r.gap_days: r.n for r in stats.date_gaps(df, "d").collect()} == {0: 1, 2: 1, 29: 1}
    assert stats.stats_dates_wide(df).first()["N"] == "5"
    with pytest.raises(ValueError):
        stats.outcome_proportion(df, "x", "t", "a")


def test_contingency_and_correlation(spark):
    df = spark.createDataFrame([("a", "y")] * 3 + [("a", "n")] + [("b", "n")] * 3 + [("c", "y"), (None, "y")], "g string, o string")
    assert stats.contingency(df, "g", "o").count() == 6 and {(r.x, r.y): r.n for r in stats.contingency(df, "g", "o").collect()}["b", "y"] == 0
    assert math.isclose(fisher_2x2(np.array([[3, 1], [1, 3]])), 0.4857142857142857)
    stat, dof, p = chi_square(np.array([[10, 20, 30], [6, 9, 17]]))
    assert dof == 2 and abs(stat - 0.27157465) < 1e-6 and abs(p - 0.873028283) < 1e-6
    assert abs(correlation_p(0.5, 20) - 0.024769) < 1e-4
    nums = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (3.0, None), (4.0, 9.0)], "a double, b double")
    rho = {(r.var1, r.var2): (r.r, r.n) for r in stats.correlations(nums, ["a", "b"]).collect()}
    assert math.isclose(rho["a", "b"][0], 0.8) and rho["a", "b"][1] == 4 and rho["a", "a"] == (1.0, 5)
    with pytest.raises(TooManyRows):
        stats.contingency(df, "g", "o", most=2)


def test_population_code(spark):
    good, bad = "GODE561231HDFABC09", "GODE561331HDFBCD09"
    df = spark.createDataFrame([(1, "GODE561231HDFBCD09"), (2, bad), (3, None), (4, "short"), (5, good)], "k int, code string")
    a = population_code.audit(df, "code", "k", F.lit(dt.date(2025, 1, 1)))
    assert {r.k: r.status for r in a["records"].collect()} == {1: "valid", 2: "invalid", 3: "missing", 4: "invalid", 5: "invalid"}
    assert {(r.k, r.issue_code) for r in a["issues"].collect()} >= {(2, "invalid_calendar_date"), (3, "missing_code"), (4, "invalid_length"), (5, "invalid_internal_consonants")}
    assert population_code.split_code(df.where("k = 1"), "code").first().birth_year == "1956"
    with pytest.raises(ValueError):
        population_code.split_code(df, "code")


# quality


def test_rules(spark):
    df = spark.createDataFrame([(-1.0, "A", True), (0.0, "B", False), (5.0, "X", None), (11.0, "M", True), (999.0, None, False), (None, "A", True)], "m double, c string, f boolean")
    keys = {"m": K[0], "c": K[1], "f": K[2]}
    rules = quality.cleaning_rules([dict(variable_key=K[0], declared_type="numeric", valid_min=0, valid_max=10, allowed_values="", missing_codes="999"), dict(variable_key=K[1], declared_type="categorical", valid_min=None, valid_max=None, allowed_values="A;B", missing_codes="M")])
    out, audit = quality.apply_rules(df, rules, keys)
    assert [r.m for r in out.collect()] == [None, 0.0, 5.0, None, None, None] and [r.c for r in out.collect()] == ["A", "B", None, None, None, "A"]
    assert {r.variable_key: (r.n_missing_before, r.n_transitioned_to_missing, r.n_missing_after) for r in audit.collect()} == {K[0]: (1, 3, 4), K[1]: (1, 2, 3)}
    for bad in (dict(variable_key="x"), dict(declared_type="text"), dict(valid_min=9, valid_max=1), dict(valid_min=None, valid_max=None, missing_codes="")):
        with pytest.raises(SpecError):
            quality.cleaning_rules([dict(variable_key=K[0], declared_type="numeric", valid_min=0, valid_max=1, allowed_values="", missing_codes="") | bad])


def test_proposals(spark):
    df = spark.createDataFrame([(0, 1.0, "p"), (1, 2.0, "q"), (1, 2.0, "r"), (0, 100.0, "s"), (1, math.inf, "t")], "b int, x double, id string")
    e, p = quality.quality_proposals(df, spec(("b", "integer"), ("x", "numeric"), ("id", "text", "", "", "id")), {"b": K[0], "x": K[1], "id": K[2]})
    assert {r.variable_key: r.rationale_codes for r in p.collect()} == {K[0]: "units_not_declared;observed_integral_zero_one", K[1]: "units_not_declared;finite_values_beyond_tukey;non_finite_values_present"}
    assert {r.variable_key: r.profile_status for r in e.collect()}[K[2]] == "not_profiled"


def test_relationships(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "c"), (3, None), (None, None)], "l int, r string")
    out = quality.relationship_profile(df, [("l", "r")])
    s = one(out["summary"])
    assert (s["both_present"], s["left_missing"], s["right_missing"], s["both_missing"], s["relationship_class"]) == (3, 1, 1, 1, "one_to_many")
    assert sorted(r.exception_type for r in out["conflicts"].collect()) == ["both_missing", "left_maps_multiple_right", "left_maps_multiple_right", "left_missing", "right_missing"]
    with pytest.raises(TooManyRows):
        quality.relationship_profile(df, [("l", "r")], max_levels=2)
    assert one(quality.relationship_profile(df.limit(0), [("l", "r")])["mappings"].groupBy().count())["count"] == 0


def test_identifiers_and_points(spark):
    df = spark.createDataFrame([("A1", "x"), ("a1", None), (" A1", " "), (None, "y"), ("A1", "z z")], "i string, j string")
    r, p = quality.identifier_qc(df, [quality.Identifier("i", 2, "^[A-Z][0-9]$"), quality.Identifier("j")])
    i = {x.name: x for x in r.collect()}["i"]
    assert (i.n_null, i.n_distinct, i.duplicate_excess, i.n_leading_whitespace, i.n_pattern_violations, i.n_expected_length_violations, i.n_case_variations) == (1, 3, 1, 1, 2, 1, 1)
    assert {x.pattern: x.n_rows for x in p.collect()} == {"1_1": 2, "1_0": 2, "0_1": 1}
    geo = spark.createDataFrame([(1.0, 2.0), (181.0, 0.0), (math.nan, 1.0), (None, 1.0), (-999.0, None)], "x double, y double")
    s = validate_spec([dict(name=n, label=n, database_type="numeric", analysis_type="numeric", role="c", geo_role=n, geo_pair="p", geo_crs="EPSG:4326", missing_codes="-999") for n in "xy"])
    g = one(quality.coordinate_profile(geo, s))
    assert (g["complete_pairs"], g["missing_x"], g["both_missing"], g["non_finite"], g["range_failures"], g["map_ready"]) == (3, 1, 1, 1, 1, False)
    with pytest.raises(TooManyRows):
        quality.points_in_box(geo, "x", "y", (0, 0, 200, 5), max_features=1)


# preparation


def test_prepare(spark):
    df = spark.createDataFrame([("2024-01-31", "a", 1.0, 7), ("NA", "b", 2.0, 8), (None, "z", None, 9)], "d string, c string, w double, extra int")
    s = spec(("d", "date", "", "NA"), ("c", "categorical", "a;b"), ("w", "integer"))
    _, audit = prepare(df, s)
    state = {(r.name, r.stage): r.status for r in audit.collect()}
    assert state["d", "missingness"] == "planned" and state["c", "levels"] == "blocking" and state["w", "type"] == "planned"
    with pytest.raises(Blocked):
        prepare(df, s, "apply")
    out, audit = prepare(df, s, "apply", unexpected_levels="append", extra_variables="drop")
    assert out.columns == ["d", "c", "w"] and [tuple(r) for r in out.collect()] == [(dt.date(2024, 1, 31), "a", 1), (None, "b", 2), (None, "z", None)]
    bad = spark.createDataFrame([("2024-02-30", "a", 1.5)], "d string, c string, w double")
    state = {(r.name, r.stage): (r.status, r.n_invalid) for r in prepare(bad, s)[1].collect()}
    assert state["d", "type"] == ("blocking", 1) and state["w", "type"] == ("blocking", 1)


def test_local_times(spark):
    df = spark.createDataFrame([("2024-03-31T02:30:00",), ("2024-10-27T02:30:00",), ("2024-07-01T12:00:00",), ("nonsense",), (None,)], "t string")
    got = [r[0] for r in df.select(local_instant(F.col("t"), "Europe/Berlin").cast("string")).collect()]
    assert got == [None, None, "2024-07-01 10:00:00", None, None]
    offs = spark.createDataFrame([("2024-07-01T12:00:00+02:00",), ("2024-07-01T12:00:00Z",), ("2024-07-01T12:00:00+15:00",), ("2024-07-01T12:00:00",)], "t string")
    assert [r[0] for r in offs.select(offset_instant(F.col("t")).cast("string")).collect()] == ["2024-07-01 10:00:00", "2024-07-01 12:00:00", None, None]


def test_civil_dates(spark):
    op = dict(variable_key=K[0], output_name="day", source_type="local_text", operation="civil_date", time_policy="midnight", missing_policy="preserve", review_state="approved")
    df = spark.createDataFrame([("2024-02-29 00:00:00",), ("2024-12-31 00:00:00.000",), (None,)], "s string")
    out, audit = derive_civil_dates(df, civil_date_operations([op]), {"s": K[0]})
    assert [r.day for r in out.collect()] == [dt.date(2024, 2, 29), dt.date(2024, 12, 31), None] and one(audit)["n_derived"] == 2
    late = spark.createDataFrame([("2024-02-29 00:00:01",), ("2023-02-29 00:00:00",)], "s string")
    with pytest.raises(SpecError, match="^2 values"):
        derive_civil_dates(late, civil_date_operations([op]), {"s": K[0]})
    with pytest.raises(SpecError):
        civil_date_operations([op | {"review_state": "pending"}])


def test_synthetic(spark):
    s = spec(("x", "numeric"), ("c", "categorical", "a;b;c"), ("d", "date"), ("t", "text"))
    a, b = synthetic_data(spark, s, 50, 4), synthetic_data(spark, s, 50, 4)
    assert a.exceptAll(b).count() == 0 and a.count() == 50 and a.where("x between 0 and 100 and c in ('a', 'b', 'c')").count() == 50
    holes = inject_missing(a, {"x": 7}, "t", 1, {"t": 0})
    assert holes.where("x is null").count() == 7 and holes.columns == a.columns


# longitudinal


def test_population(spark):
    a = spark.createDataFrame([("1", 1), ("1", 2), ("2", 1), (None, 1), ("  ", 1)], "id string, k int")
    b = spark.createDataFrame([("2", 1), ("3", 1), ("3", 1)], "id string, k int")
    c = spark.createDataFrame([("1", 1)], "id string, k int")
    q = population_qc(Periods({"a": a, "b": b, "c": c}), "id", ["id", "k"])
    p = {r.period_label: r for r in q.period_summary.collect()}
    assert (p["a"].n_entity_null, p["a"].n_entity_blank, p["a"].n_distinct_entities, p["a"].n_repeated_entity_excess, p["a"].n_missing_record_key) == (1, 1, 2, 1, 2)
    assert p["b"].n_duplicate_record_key_excess == 1
    adj = {r.from_period_label: (r.n_retained, r.n_exited, r.n_entered) for r in q.adjacent.collect()}
    assert adj == {"a": (1, 1, 1), "b": (0, 2, 1)}
    h = {(r.first_period_label, r.last_period_label): (r.n_entities, r.has_gap) for r in q.entity_history.collect()}
    assert h == {("a", "c"): (1, True), ("a", "b"): (1, False), ("b", "b"): (1, False)}
    assert {(r.period_label, r.issue_code) for r in q.issues.collect()} == {("a", "invalid_entity_id"), ("a", "missing_record_key"), ("b", "duplicate_record_key")}
    empty = population_qc(Periods({"a": a.limit(0), "b": b}), "id")
    assert {r.n_rows for r in empty.period_summary.collect()} == {0, 3} and empty.adjacent.first().retention_proportion is None
    with pytest.raises(SpecError):
        Periods({"a": a})


def test_drift(spark):
    a = spark.createDataFrame([(1.0, "x", 1), (2.0, "y", 2), (3.0, "x", 3), (None, None, 4)], "m double, g string, bad int")
    b = spark.createDataFrame([(2.0, "x", "q"), (4.0, "z", "q"), (6.0, "x", "q"), (8.0, "x", "q")], "m double, g string, bad string")
    d = longitudinal_drift(Periods({"a": a, "b": b}), spec(("m", "numeric"), ("g", "categorical", "x;y;w"), ("bad", "integer"), ("gone", "numeric")))
    r = d.numeric_adjacent.where("variable = 'm'").first()
    assert (r.left_n_finite, r.right_n_finite, r.mean_change, r.median_change, r.status) == (3, 4, 3.0, 3.0, "available")
    assert {x.level: x.level_status for x in d.categorical_adjacent.collect()} == {"x": "present_both", "y": "removed", "z": "introduced", "w": "absent_both"}
    m = {x.variable: (x.absolute_change, x.relative_change, x.status) for x in d.missingness_adjacent.collect()}
    assert m["m"] == (-0.25, -1.0, "available") and m["bad"][2] == "unavailable"
    assert {(x.period, x.variable, x.code) for x in d.skipped.collect()} == {("b", "bad", "incompatible"), ("a", "gone", "absent"), ("b", "gone", "absent")}
    with pytest.raises(ValueError):
        longitudinal_drift(Periods({"a": a, "b": b}), spec(("g", "categorical", "x;y;w")), max_levels=3)


def test_transitions(spark):
    a = spark.createDataFrame([("1", "A"), ("2", "A"), ("2", "B"), ("3", None), ("4", "B"), ("5", "A"), (None, "A")], "id string, s string")
    b = spark.createDataFrame([("1", "B"), ("2", "A"), ("3", "A"), ("4", "C"), ("4", None)], "id string, s string")
    t = longitudinal_transitions(Periods({"a": a, "b": b}), "id", spec(("s", "categorical", "A;B")), ["s"])
    assert [(r.n_usable_state, r.n_missing_state, r.n_conflicting_state) for r in t.state_audit.orderBy("period_index").collect()] == [(3, 1, 1), (4, 0, 0)]
    r = t.transition_summary.first()
    assert (r.n_retained, r.n_eligible, r.n_excluded_missing, r.n_excluded_conflict, r.n_transition_cells) == (4, 2, 1, 1, 9)
    assert {(x.from_state, x.to_state): x.n for x in t.transition_counts.where("n > 0").collect()} == {("A", "B"): 1, ("B", "C"): 1}
    assert t.transition_counts.count() == 9


def test_panel(spark):
    rows = [("a", "baseline", 1.0, "A"), ("a", "month_1", 3.0, "B"), ("a", "month_1", 4.0, "B"), ("b", "baseline", 2.0, "A"), ("b", "month_1", -99.0, "MISSING"), ("b", "month_2", math.inf, "B"), ("c", "baseline", 5.0, "A"), (None, "baseline", 99.0, "B"), ("   ", "NOT_DONE", 88.0, "A")]
    df = spark.createDataFrame(rows, "id string, visit string, score double, state string")
    s = spec(("id", "text", "", "", "id"), ("visit", "categorical", "baseline;month_1;month_2", "NOT_DONE"), ("score", "numeric", "", "-99"), ("state", "categorical", "A;B", "MISSING"))
    p = longitudinal_panel(df, s, "id", "visit")
    x = one(p.structure)
    assert [x[k] for k in ("n_valid_panel_rows", "n_valid_entities", "n_observed_id_time_cells", "n_duplicate_cells", "n_duplicate_excess", "n_expected_cells")] == [7, 3, 6, 1, 1, 9]
    assert [r.n_entities for r in p.observation_count.orderBy("n_timepoints_observed").collect()] == [1, 1, 1]
    m = {(r.variable, r.timepoint): (r.n_present_entities, r.n_usable, r.n_missing, r.n_conflicting) for r in p.missing_by_time.collect()}
    assert m["score", "month_1"] == (2, 0, 1, 1)
    c = {r.from_timepoint: r for r in p.change_adjacent.collect()}["baseline"]
    assert (c.n_present_both, c.n_excluded_missing, c.n_excluded_conflict, c.n_eligible, c.reason) == (2, 1, 1, 0, "zero_eligible")
    f = one(p.change_first_to_last)
    assert (f["n_excluded_single_timepoint"], f["n_excluded_conflict"], f["n_excluded_nonfinite"]) == (1, 1, 1)
    assert [r.issue_code for r in p.issues.collect()] == ["missing_entity_id", "blank_entity_id", "missing_time", "duplicate_id_time", "conflicting_variable_cell"]
    assert {r.has_gap: r.n_entities for r in p.gap_status.collect()} == {False: 3, True: 0}
    assert longitudinal_panel(df.limit(0), s, "id", "visit").structure.first().n_valid_entities == 0


# linkage and identity


def test_text_and_jaro():
    assert normalise("  José-María  del Río ", TextProfile(diacritics="strip", drop_tokens=("DEL",), token_order="sort")) == "jose maria rio"
    assert normalise("...", TextProfile()) is None and normalise(None, TextProfile()) is None
    assert round(jaro("martha", "marhta"), 4) == 0.9444 and round(jaro("dixon", "dicksonx"), 4) == 0.7667 and jaro("a", "b") == 0


LINK = linkage.LinkageSpec("id", "key", (linkage.Block(1, "g", "g"), linkage.Block(2, "born", "dob")), (linkage.Comparison("name", "name", "who", "token_jaccard", 0.75, "p", 0.8, 0.1), linkage.Comparison("born", "born", "dob", "date_tolerance", 1, None, 0.9, 0.02), linkage.Comparison("age", "age", "age", "numeric_tolerance", 1, None, 0.9, 0.2)), {"p": TextProfile()}, prevalence=0.05, nonmatch_max=0.05, match_min=0.9)


def test_linkage(spark):
    x = spark.createDataFrame([("r1", "Ana Gil", dt.date(2000, 1, 1), 20, "n"), ("r2", "Bo Lee", dt.date(1990, 5, 5), None, "s"), ("r3", " ", None, 40, None)], "id string, name string, born date, age int, g string")
    y = spark.createDataFrame([("k1", "GIL, ana", dt.date(2000, 1, 2), 21, "n"), ("k2", "Cy Fox", dt.date(1990, 5, 5), 33, "n"), ("k3", None, None, 40, None)], "key string, who string, dob date, age int, g string")
    r = linkage.link(x, y, LINK, include_values=True)
    assert {(p.x_index, p.y_index) for p in r.candidates.pairs.collect()} == {(1, 1), (1, 2), (2, 2)}
    assert [tuple(p) for p in r.candidates.passes.orderBy("pass").collect()] == [(1, 2, 2, 0), (2, 1, 1, 0)]
    s = {(p.x_index, p.y_index): p for p in r.scores.collect()}
    assert math.isclose(s[1, 1].linkage_weight, math.log2(8) + math.log2(45) + math.log2(4.5)) and (s[2, 2].n_agree, s[2, 2].n_disagree, s[2, 2].n_missing) == (1, 1, 1)
    assert {(d.x_index, d.y_index): d.decision for d in r.decisions.collect()}[1, 1] == "match"
    truth = spark.createDataFrame([(a, b, (a, b) in ((1, 1), (3, 3))) for a in (1, 2, 3) for b in (1, 2, 3)], "x_index long, y_index long, is_match boolean")
    m = one(linkage.validate(r, truth))
    assert (m["candidate_recall"], m["precision"], m["recall"], m["missed_match_n"]) == (0.5, 1.0, 0.5, 1)
    with pytest.raises(SpecError):
        linkage.validate(r, truth.limit(8))
    with pytest.raises(SpecError):
        linkage.prepare(x.union(x), y, LINK)
    import dataclasses

    with pytest.raises(SpecError):
        linkage.candidates(linkage.prepare(x, y, dataclasses.replace(LINK, max_candidates=1)))


def test_jaro_of_many_pairs():
    import itertools

    import numpy as np

    from tallyforge.functions.linkage_text import jaro_pairs

    texts = ["", "a", "aab", "martha", "marhta", "dixon", "dicksonx", "é中é", "customer 000000017", "custmer 000000071", "ab" * 31, "ba" * 40]
    ia, ib = map(np.array, zip(*itertools.product(range(len(texts)), repeat=2)))
    assert jaro_pairs(texts, texts, ia, ib).tolist() == [jaro(texts[i], texts[j]) for i, j in zip(ia, ib)]


def test_linkage_blocks_of_any_size(spark, monkeypatch):
    """More than ten million pairs of one block are counted without a limit; tiles make each pair once."""
    many = spark.range(3300).select(F.col("id").cast("string").alias("id"), F.lit("Ana").alias("name"), F.lit(None).cast("date").alias("born"), F.lit(1).alias("age"), F.lit("g").alias("g"))
    other = many.withColumnsRenamed({"id": "key", "name": "who", "born": "dob"})
    r = linkage.link(many, other, LINK)
    assert r.candidates.overall.first().n_candidates == 3300**2
    monkeypatch.setattr(linkage, "TILE", 4)
    date = F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 5).cast("int"))
    some = spark.range(30).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Ana "), F.col("id") % 4).alias("name"), date.alias("born"), (F.col("id") % 7).cast("int").alias("age"), (F.col("id") % 2).cast("string").alias("g"))
    r = linkage.link(some, some.withColumnsRenamed({"id": "key", "name": "who", "born": "dob"}), LINK)
    ids = {z.i: int(z.id) for z in r.candidates.prepared.x.collect()}
    want = {(i, j): 1 if a % 2 == b % 2 else 2 for i, a in ids.items() for j, b in ids.items() if a % 2 == b % 2 or a % 5 == b % 5}
    got = [(p.x_index, p.y_index) for p in r.candidates.pairs.collect()]
    assert len(got) == len(want) and set(got) == set(want)
    assert [p.n_new_candidates for p in r.candidates.passes.orderBy("pass").collect()] == [list(want.values()).count(n) for n in (1, 2)]
    assert sorted(r.decisions.collect()) == sorted(linkage.classify(LINK, r.scores).collect()) and r.evidence.count() == 3 * len(want)


def test_universe_and_aliases(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",), (None,), (" ",)], "i string")
    b = spark.createDataFrame([("2",), ("3x",)], "i string")
    u = identity_universe({"a": (a, "i"), "b": (b, "i")}, "ns", "^[0-9]+$")
    assert {r.source: (r.n_null, r.n_blank, r.n_invalid, r.n_distinct, r.status) for r in u.source_audit.collect()} == {"a": (1, 1, 0, 2, "error"), "b": (0, 0, 1, 1, "error")}
    assert one(u.overlap_audit)["n_intersection"] == 1 and {r.identifier: r.n_sources for r in u.members.collect()} == {"1": 1, "2": 2}
    pairs = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "2"), (None, "3")], "al string, ca string")
    x = alias_crosswalk({"t": (pairs, "al", "ca")})
    m = one(x.mapping_audit)
    assert (m["n_pair_rows"], m["n_distinct_pairs"], m["n_duplicate_pairs"], m["n_alias_conflicts"], m["n_canonical_conflicts"]) == (4, 3, 1, 1, 1)
    assert {r.issue_code for r in x.issues.collect()} == {"alias_missing_or_invalid", "incomplete_identifier_pair", "alias_to_many", "canonical_to_many", "duplicate_exact_pair"}


def test_pseudonyms(spark, tmp_path):
    people = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p2", "y")], "id string, v string")
    visits = spark.createDataFrame([("p1", 1), ("p1", 2), ("old", 3)], "who string, n int")
    tables = {"people": LinkedTable(people, "id", ("v",), can_enrol=True), "visits": LinkedTable(visits, "who", ("n",), ("n",))}
    assert Registry.init(spark, str(tmp_path / "r"))[1] == "absent"
    registry, state = Registry.init(spark, str(tmp_path / "r"), mode="apply")
    assert state == "created" and Registry.init(spark, str(tmp_path / "r"), prefix="Q")[1] == "settings_mismatch"
    with pytest.raises(SpecError):
        pseudonymise(tables, "ns", registry, str(tmp_path / "o"))
    cross = spark.createDataFrame([("ns", "old", "ns", "p2")], "alias_namespace string, alias_id string, canonical_namespace string, canonical_id string")
    out = pseudonymise(tables, "ns", registry, str(tmp_path / "o"), exact_duplicates="drop", crosswalk=cross)
    token = {r.v: r.entity_token for r in out["people"].collect()}
    assert len(set(token.values())) == 2 and out["people"].count() == 2
    assert {r.n: r.entity_token for r in out["visits"].collect()} == {1: token["x"], 2: token["x"], 3: token["y"]}
    again = Registry.init(spark, str(tmp_path / "r"))[0]
    assert {r.source_id: r.entity_token for r in again.aliases().collect()}["p1"] == token["x"]
    seen = people.select(F.lit("ns").alias("identity_namespace"), F.col("id").alias("source_id"))
    assert one(crosswalk_audit(cross, seen, again.aliases()))["n_unused"] == 1
    bridge = pseudonym_bridge(people.distinct(), "id", str(tmp_path / "b"))
    assert bridge.count() == 2
    with pytest.raises(SpecError):
        pseudonym_bridge(people, "id", str(tmp_path / "c"))


# sources and plans


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c,d\n1, x ,2020-01-01,.\nNA,NULL,2020-01-02,2.5\n3,y,,1\n")
    df = read_delimited(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "date", "d": "double"} and [r.b for r in df.collect()] == ["x", None, "y"]
    write_delimited(df, str(tmp_path / "out"))
    assert read_delimited(spark, str(tmp_path / "out"), sep="\t").count() == 3
    assert open(write_small(df, str(tmp_path), "small", "tsv")).readline() == "a\tb\tc\td\n"
    for bad in (("csv", "\t"), ("xls", None)):
        with pytest.raises(SpecError):
            write_small(df, str(tmp_path), "n", *bad)


def test_dictionary(spark):
    d = dictionary_scaffold(inventory({"t": spark.createDataFrame([], "a int, b string, f boolean")})["columns"])
    levels = spark.createDataFrame([("b", "y", 2, False), ("b", "x", 1, False), ("b", "?", 3, True)], "column_name string, value string, display_order int, is_missing boolean")
    s = dictionary_spec(d, "t", levels)
    assert s["b"].levels == ("x", "y") and s["b"].missing_codes == ("?",) and s["f"].levels == ("FALSE", "TRUE")
    assert dictionary_validate(d).count() == 0 and dictionary_validate(d.union(d)).first().rule == "duplicate_key"


def test_runs(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (9.0, "a")], "x double, g string")
    s = spec(("x", "numeric"), ("g", "categorical", "a;b"))
    out = run_eda(Source.bind(df, "t"), s, str(tmp_path / "b"), strata="g")
    assert out["table1"].count() > 0 and "index.html" in check_bundle(str(tmp_path / "b"))
    assert (tmp_path / "b" / "plots" / "histogram_001.svg").read_text().startswith("<svg")
    assert "tables/numeric.csv" in render_bundle(str(tmp_path / "b"))
    with pytest.raises(FileExistsError):
        run_eda(df, s, str(tmp_path / "b"))
    run_eda(df, s, str(tmp_path / "b"), overwrite=True)
    (tmp_path / "b" / "index.html").write_text("changed")
    with pytest.raises(SpecError):
        run_eda(df, s, str(tmp_path / "b"), overwrite=True)
    assert run_eda(None, s, spark=spark, synthetic_rows=20)["variables"].count() == 2
    assert intake_run(df, None, str(tmp_path / "i1")).status == "blocked"
    assert intake_run(df, s, str(tmp_path / "i2"), "apply", "g").status == "complete"
    bad = spec(("x", "numeric"), ("g", "categorical", "a"))
    assert intake_run(df, bad, str(tmp_path / "i3"), "apply").status == "blocked"
    assert create_project(str(tmp_path / "p")) == ["README.md", "analysis.py", "spec.csv"]


def test_stream(spark, tmp_path):
    from tallyforge.streaming.profile import windowed_counts

    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), float(h)) for h in range(6)], "ts timestamp, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", ["v"], "2 hours").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: str(r)
    assert sorted(spark.table("w").collect(), key=key) == sorted(windowed_counts(rows, "ts", ["v"], "2 hours").collect(), key=key)
