"""Typed summaries, strata and displays against figures worked out by hand."""

import datetime as dt
import math

import pytest

from tallyforge.operators.profile import Profile
from tallyforge.operators.stratified import categorical_display, profile_stratified, reconcile, table1
from tallyforge.operators.summaries import catalogue_profile, identifier_profile, profile_missing, profile_summaries, schema_check
from tallyforge.spec import SpecError, scaffold_spec, split_list, strict_levels, validate_spec

UTC = dt.UTC


def spec(*rows):
    return validate_spec([dict(name=n, label=n, database_type=d, analysis_type=a, role=r, levels=lv, missing_codes=m) for n, d, a, r, lv, m in rows])


@pytest.fixture(scope="module")
def mixed(spark):
    day, at = dt.date, lambda d, h=0: dt.datetime(2024, 1, d, h, tzinfo=UTC)
    rows = [
        ("x", 1.0, 1, "A", True, "alpha", day(2024, 1, 1), at(1), at(1).replace(tzinfo=None)),
        ("x", 2.0, 2, "B", False, "", day(2024, 1, 3), at(2), at(2).replace(tzinfo=None)),
        ("y", 999.0, 2, "A", True, "  ", None, None, None),
        (None, math.nan, 3, "Z", False, "é", day(2024, 1, 5), at(2, 22), at(3).replace(tzinfo=None)),
        ("z", math.inf, 9, "MISSING", True, "SECRET", day(2024, 1, 7), at(4), at(4).replace(tzinfo=None)),
        ("z", None, 11, None, None, None, day(2024, 1, 9), at(5), at(5).replace(tzinfo=None)),
    ]
    return spark.createDataFrame(rows, "participant string, measure double, whole long, arm string, flag boolean, note string, day date, instant timestamp, wall timestamp_ntz")


MIXED = spec(
    ("participant", "text", "text", "identifier", "", ""), ("measure", "numeric", "numeric", "variable", "", "999"), ("whole", "integer", "integer", "variable", "", ""), ("arm", "text", "categorical", "variable", "A;B;C", "MISSING"), ("flag", "boolean", "binary", "variable", "FALSE;TRUE", ""),
    ("note", "text", "text", "variable", "", "SECRET"), ("day", "date", "date", "variable", "", "2024-01-03"), ("instant", "datetime", "datetime", "variable", "", ""), ("wall", "datetime", "datetime", "variable", "", ""),
)


def test_summaries_by_hand(mixed):
    s = profile_summaries(mixed, MIXED)
    v = {r.name: r for r in s.variables.collect()}
    assert [v[n].n_missing for n in ("participant", "measure", "whole", "arm", "flag", "note", "day", "instant")] == [1, 3, 0, 2, 1, 2, 2, 1]
    assert v["wall"].status == "skipped" and [r.name for r in s.skipped.collect()] == ["wall"]
    n = {r.name: r for r in s.numeric.collect()}
    m = n["measure"]
    assert (m.n_finite, m.sum, m.q1, m["mean"], m.q3, m.lower_fence, m.upper_fence, m.skewness, m.kurtosis) == (2, 3, 1.25, 1.5, 1.75, 0.5, 2.5, None, None)
    assert v["measure"].n_infinite == 1 and math.isclose(m.sd, 0.7071067811865476)
    w = n["whole"]
    assert (w.sum, w.q1, w.median, w.q3, w.lower_fence, w.upper_fence) == (28, 2, 2.5, 7.5, -6.25, 15.75)
    for got, want in ((w.sd, 4.22689799577263), (w.skewness, 0.537503736374889), (w.kurtosis, -1.82467327541398)):
        assert math.isclose(got, want, rel_tol=1e-10)
    c = [(r.level, r.n, r.is_declared, r.is_unexpected) for r in s.categorical.where("name = 'arm'").collect()]
    assert sorted(c) == [("A", 2, True, False), ("B", 1, True, False), ("C", 0, True, False), ("Z", 1, False, True)]
    t = {r.name: r for r in s.text.collect()}["note"]
    assert (t.n_observed, t.n_unique, t.n_empty, t.n_whitespace, t.min_length, t.max_length) == (4, 4, 1, 1, 0, 5)
    d = {r.name: r for r in s.temporal.collect()}
    assert (d["day"]["min"], d["day"].median, d["day"]["max"], d["day"].range_value, d["day"].range_unit) == ("2024-01-01", "2024-01-06", "2024-01-09", 8, "days")
    assert d["instant"]["min"] == "2024-01-01T00:00:00Z" and d["instant"].range_unit == "seconds"
    i = identifier_profile(mixed, MIXED).first()
    assert (i.n_observed, i.n_distinct, i.n_repeated_values, i.duplicate_excess, i.max_frequency) == (5, 3, 2, 2, 2)
    assert "SECRET" not in repr(s)


@pytest.mark.parametrize("values,finite,sd", [([], 0, None), ([None, None], 0, None), ([math.nan], 0, None), ([math.inf, -math.inf], 0, None), ([5.0], 1, None), ([5.0, 5.0, 5.0], 3, 0.0)])
def test_numeric_edges(spark, values, finite, sd):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = profile_summaries(df, spec(("x", "numeric", "numeric", "v", "", ""))).numeric.first()
    assert (r.n_finite, r.sd, r.skewness, r.n_below_lower, r.n_above_upper) == (finite, sd, None, 0, 0)
    assert r.outlier_percentage == (0.0 if finite else None)


def test_empty_table(spark, mixed):
    s = profile_summaries(mixed.limit(0), MIXED)
    assert {r.n for r in s.variables.where("status = 'summarised'").collect()} == {0}
    assert all(r.p_total is None and r.n == 0 for r in s.categorical.collect())
    assert s.temporal.where("n_observed > 0").count() == 0


def test_exactness_guard(spark):
    df = spark.createDataFrame([(2**53 + 1,), (1,)], "x long")
    assert profile_summaries(df, spec(("x", "integer", "integer", "v", "", ""))).variables.first().status == "skipped"


def test_odd_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "`Body Mass (g)` double, `a.b+c` string")
    s = profile_summaries(df, spec(("Body Mass (g)", "numeric", "numeric", "v", "", ""), ("a.b+c", "text", "categorical", "v", "a;b", "")))
    assert s.numeric.first()["mean"] == 2 and s.categorical.count() == 2


def test_schema_and_missing(mixed):
    got = {r.name: (r.status, r.type_status) for r in schema_check(mixed.drop("flag"), MIXED.only(["measure", "flag", "wall"])).collect()}
    assert got["flag"] == ("missing", "not_applicable") and got["wall"] == ("present", "incompatible") and got["note"][0] == "unexpected"
    miss = {r.name: (r.n, r.n_missing, r.p_missing) for r in profile_missing(mixed.drop("flag"), MIXED.only(["measure", "flag"])).collect()}
    assert miss == {"measure": (6, 3, 0.5), "flag": (None, None, None)}


def test_spec_rules():
    base = dict(name="x", label="x", database_type="numeric", analysis_type="numeric", role="v")
    for bad in (dict(type="numeric"), dict(name=""), dict(database_type="blob"), dict(min="5", max="1"), dict(min="word"), dict(required="maybe"), dict(geo_role="x"), dict(geo_role="x", geo_pair="p", geo_crs="EPSG:4326")):
        with pytest.raises(SpecError):
            validate_spec([base | bad])
    with pytest.raises(SpecError):
        validate_spec([base, base])
    assert split_list(" a; ;b ") == ("a", "b") and strict_levels("a;b") == ("a", "b")
    for bad in ("a; b", "a;;b", "a;a"):
        with pytest.raises(SpecError):
            strict_levels(bad)


def test_scaffold(spark, mixed):
    kinds = {v.name: v.analysis_type for v in scaffold_spec(mixed.schema)}
    assert kinds["flag"] == "binary" and kinds["day"] == "date" and kinds["participant"] == "text"
    with pytest.raises(SpecError):
        scaffold_spec(spark.createDataFrame([], "a array<int>").schema)


def test_catalogue_bound(spark):
    df = spark.createDataFrame([(str(i),) for i in range(5)], "x string")
    assert catalogue_profile(df, ["x"], 5).count() == 5
    with pytest.raises(ValueError):
        catalogue_profile(df, ["x"], 4)


STRATA = spec(("arm", "text", "categorical", "v", "B;A;D", "MISS"), ("value", "numeric", "numeric", "v", "", "999"), ("status", "text", "categorical", "v", "no;yes;unused", ""), ("absent", "text", "text", "v", "", ""))


@pytest.fixture(scope="module")
def trial(spark):
    return spark.createDataFrame([("A", 1.0, "yes"), ("A", 3.0, "no"), ("B", 2.0, "yes"), ("C", math.inf, "other"), ("MISS", 999.0, "NA"), (None, None, None)], "arm string, value double, status string")


def test_strata(trial):
    s = profile_stratified(trial, STRATA, "arm")
    g = [(r.group_label, r.n, r.is_unexpected_stratum) for r in s.groups.orderBy("group_order").collect()]
    assert g == [("Overall", 6, False), ("B", 1, False), ("A", 2, False), ("D", 0, False), ("C", 1, True), ("Missing", 2, False)]
    reconcile(s)
    n = {r.group_label: (r.n_finite, r["mean"]) for r in s.numeric.collect()}
    assert n == {"Overall": (3, 2.0), "B": (1, 2.0), "A": (2, 2.0), "D": (0, None), "C": (0, None), "Missing": (0, None)}
    cells = s.categorical.where("name = 'status'").collect()
    assert len(cells) == 6 * 6  # no, yes, unused, NA, other and the missing row
    assert sum(r.n for r in cells if r.group_label == "Overall") == 6
    left_out = profile_stratified(trial, STRATA, "arm", include_missing_stratum=False)
    assert [r.n for r in left_out.groups.orderBy("group_order").collect()] == [4, 1, 2, 0, 1]
    with pytest.raises(SpecError):
        profile_stratified(trial, STRATA, "value")


def test_bases_and_table1(trial):
    s = profile_stratified(trial, STRATA, "arm")
    d = {b: {(r.level, r.group_label): r for r in categorical_display(s, b).where("name = 'status'").collect()} for b in ("compatibility", "column", "row", "overall")}
    key = ("yes", "A")
    assert [(d[b][key].denominator, d[b][key].proportion) for b in d] == [(2, 0.5), (2, 0.5), (2, 0.5), (6, 1 / 6)]
    assert d["row"]["unused", "A"].proportion is None and d["compatibility"][None, "Missing"].denominator == 2
    t = {(r.name, r.statistic, r.group_label): r.display for r in table1(s).collect() if r.statistic != "level"}
    assert t["value", "mean_sd", "A"] == "2.0 (1.4)" and t["value", "median_iqr", "D"] == "— [—, —]" and t["value", "missing", "Missing"] == "2 (100.0%)"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(5.0, 0.0, None), (5.0, 30.0, None), (5.0, 15.0, None)], "c double, r double, e double")
    s = spec(("c", "numeric", "numeric", "v", "", ""), ("r", "numeric", "numeric", "v", "", ""), ("e", "numeric", "numeric", "v", "", ""))
    rows = Profile(df, s).histogram().collect()
    by = {(r.name, r.bin): r for r in rows}
    assert len(rows) == 90 and by["c", 15]["count"] == 3 and (by["c", 1].lower, by["c", 30].upper) == (4.5, 5.5)
    assert by["r", 1]["count"] == 1 and by["r", 30]["count"] == 1 and by["r", 16]["count"] == 1
    assert (by["e", 1].lower, by["e", 30].upper, by["e", 7]["count"]) == (0, 1, 0)


def test_histogram_edges_are_those_shown(spark):
    """0.3 is below 3 * 0.1, where the fourth of 30 bins from 0 to 3 begins."""
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 1.4, 3.0)], "x double")
    bins = {r.bin: r for r in Profile(df, spec(("x", "numeric", "numeric", "v", "", ""))).histogram().collect()}
    assert [b for b, r in sorted(bins.items()) if r["count"]] == [1, 3, 14, 30] and bins[3].lower <= 0.3 < bins[4].lower
