"""Quantiles, exact tests, samples and ranks against slow versions."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import storage
from tallyforge.functions.pvalues import fisher_2x2, shapiro_wilk
from tallyforge.operators import clean, stats
from tallyforge.operators.profile import Profile, numeric_statistics
from tallyforge.operators.quantiles import quantiles
from tallyforge.operators.summaries import catalogue_profile, frequencies
from tallyforge.spec import validate_spec


def type_7(x, p):
    x = sorted(x)
    h = (len(x) - 1) * p
    low, high = x[math.floor(h)], x[math.ceil(h)]
    return low + (high - low) * (h - math.floor(h))


def test_quantiles_of_awkward_values(spark, monkeypatch):
    """Few cells and no counting value by value until the end: many passes, magnitudes from 1e-300 to 1e300, ties, one value."""
    from tallyforge.operators import quantiles as q

    monkeypatch.setattr(q, "CELLS", 8)
    monkeypatch.setattr(q, "FEW", 3)
    rng = np.random.default_rng(1)
    groups = {"even": rng.random(400), "wide": 10.0 ** rng.uniform(-300, 300, 200) * rng.choice([-1, 1], 200), "tied": np.repeat([1.0, 2.0, 2.0000000001], [50, 300, 1]), "one": np.array([7.0]), "same": np.full(90, -3.5), "ends": np.array([-1.7e308, 0.0, 1.7e308, 1.6e308])}
    df = spark.createDataFrame([(g, float(v), 1) for g, x in groups.items() for v in x] + [("heavy", 1.0, 999), ("heavy", 2.0, 1)], "g string, v double, c int").repartition(5)
    got = {r.g: r.q for r in quantiles(df, ["g"], (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    groups["heavy"] = np.repeat([1.0, 2.0], [999, 1])
    for g, x in groups.items():
        assert got[g] == [type_7(x.tolist(), p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)], g


def test_numeric_core_by_group(spark):
    rng = np.random.default_rng(2)
    rows = [("abc"[i % 3], float(v)) for i, v in enumerate(rng.normal(5, 2, 300))]
    spec = validate_spec([dict(name="x", label="x", database_type="numeric", analysis_type="numeric", role="v")])
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.g: r for r in Profile(df, spec, F.col("k")).numeric(["a", "b", "c", "\0all"]).collect()}
    for g, x in [*((k, [v for j, v in rows if j == k]) for k in "abc"), ("\0all", [v for _, v in rows])]:
        a, r = np.array(x), got[g]
        d = a - a.mean()
        n = len(a)
        assert math.isclose(r["mean"], a.mean()) and math.isclose(r.sd, a.std(ddof=1)) and math.isclose(r.median, type_7(x, 0.5))
        assert math.isclose(r.skewness, (d**3).mean() / (d**2).mean() ** 1.5 * (1 - 1 / n) ** 1.5, rel_tol=1e-9)
        assert math.isclose(r.shapiro_p, shapiro_wilk(a), rel_tol=1e-9)
        assert r.n_below_lower == sum(a < r.lower_fence) and r.n_above_upper == sum(a > r.upper_fence)
    weighted = spark.createDataFrame([("w", 1.0, 3), ("w", 4.0, 2)], "k string, v double, c int")
    assert math.isclose(numeric_statistics(weighted, ["k"]).first()["mean"], 2.2)


@pytest.mark.parametrize("table", [[[3, 1], [1, 3]], [[120, 300], [80, 410]], [[0, 5], [3, 2]], [[1500, 2500], [1400, 2700]], [[0, 0], [3, 4]], [[1000, 1], [2, 900]]])
def test_fisher_is_exact(table):
    (a, b), (c, d) = table
    weights = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + c, a + b) + 1)}
    want = sum(w for w in weights.values() if w * 10**7 <= weights[a] * (10**7 + 1)) / math.comb(a + b + c + d, a + c)
    assert math.isclose(fisher_2x2(np.array(table)), want, rel_tol=1e-9)


def test_fisher_of_a_large_table(spark):
    """Counts above 100 don't change the test."""
    df = spark.range(4000).select((F.col("id") % 2).alias("x"), (F.col("id") % 5 < 2 + F.col("id") % 2).cast("int").alias("y"))
    r = stats.contingency_test(df, "x", "y").first()
    assert r.method == "fisher" and 0 < r.p_value < 1e-5
    assert stats.contingency_test(df.withColumn("y", F.col("y") + F.col("x")), "x", "y").first().method == "chisq"


def test_shapiro_by_published_values():
    assert math.isclose(shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])), 0.006704, abs_tol=5e-6)
    assert shapiro_wilk(np.ones(10)) is None and shapiro_wilk(np.array([1.0, 2.0])) is None
    x = np.random.default_rng(3).normal(size=2000)
    assert shapiro_wilk(x) > 0.01 and shapiro_wilk(np.exp(x)) < 1e-10
    assert math.isclose(shapiro_wilk(x), shapiro_wilk(x * 1e300), rel_tol=1e-6)


def test_sample_of_null_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a" if i % 3 == 1 else "") for i in range(300)], "id long, s string")
    got = [(r.id, r.s) for r in clean.stratified_sample(df, "s", 0.25, "id", 1).collect()]
    assert sorted(str(s) for _, s in got) == sorted(["None"] * 25 + ["a"] * 25 + [""] * 25) and len({i for i, _ in got}) == 75
    assert clean.stratified_sample(df.limit(0), "s", 0.5, "id").count() == 0 and clean.stratified_sample(df, "s", 1.0, "id").count() == 300


def test_spearman_against_ranks(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 20, 500).astype(float), rng.normal(size=500)
    b[::7] = np.nan
    got = {(r.var1, r.var2): (r.r, r.n) for r in stats.correlations(spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double"), ["a", "b"]).collect()}
    ok = ~np.isnan(b)
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert got["a", "b"][1] == ok.sum() and math.isclose(got["a", "b"][0], np.corrcoef(rank(a[ok]), rank(b[ok]))[0, 1], rel_tol=1e-9)


def test_spearman_ranks_no_column_with_itself(spark, monkeypatch):
    tables = {}

    def kept(df, name):
        tables[name] = storage.materialised(df, name)
        return tables[name]

    monkeypatch.setattr(stats, "materialised", kept, raising=False)
    df = spark.createDataFrame([(float(i % 2), float(i), 1.0) for i in range(8)], "a double, b double, c double")
    got = {(r.var1, r.var2): (r.r, r.n) for r in stats.correlations(df, ["a", "b", "c"]).collect()}
    assert {(r.k, r.n) for r in tables["rank-pairs"].groupBy("k").agg(F.count("a").alias("n")).collect()} == {(1, 8), (2, 2), (4, 8)}
    assert got["a", "a"] == got["c", "c"] == (1.0, 8) and got["a", "c"] == (None, 8) and len(got) == 9


def test_distinct_and_frequencies(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), (None, 1), ("c", 1)], "x string, y int")
    assert clean.distinct_up_to(df, ["x", "y"], 3) == {"x": 3, "y": 1}
    assert [(r.level, r.n) for r in frequencies(df, "x", 1).orderBy("rank").collect()] == [("a", 2), ("Other (2 levels)", 2)]
    assert catalogue_profile(df, ["x"], 3).count() == 3
    with pytest.raises(ValueError):
        catalogue_profile(df, ["x"], 2)


def test_scratch_tables_are_deleted(spark):
    with storage.scratch(spark):
        kept = storage.materialised(spark.range(3), "passing")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_no_window_over_everything(spark, sf_dir):
    """The plans of samples, ranks and frequencies bring no whole table to one task."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = clean.stratified_sample(orders, "o_orderstatus", 0.1, "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
