"""The registered queries of the descriptive operators and the SQL that says the same.

Doubles of both sides keep nine significant digits: sums depend on the order of addition.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linkage_text import TextProfile
from ..operators import clean, linkage, quality, stats
from ..operators.drift import longitudinal_drift
from ..operators.identity import LinkedTable, alias_crosswalk, identity_universe, pseudonym_audit
from ..operators.longitudinal_qc import population_qc
from ..operators.panel import longitudinal_panel
from ..operators.periods import Periods, periods_by
from ..operators.prepare import civil_date_operations, derive_civil_dates, inject_missing, offset_instant, prepare, synthetic_data
from ..operators.profile import Profile
from ..operators.stratified import categorical_display, profile_stratified, table1
from ..operators.summaries import catalogue_profile, frequencies, identifier_profile, profile_missing, profile_summaries, schema_check
from ..operators.transitions import longitudinal_transitions
from ..sources.catalogue import dictionary_refresh, dictionary_scaffold, inventory
from ..spec import Spec, validate_spec
from ..streaming.profile import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Larger than what another order of addition changes, smaller than the ninth digit.
_NUDGE = 1 + 3e-12


def tidy(df: DataFrame) -> DataFrame:
    """Doubles with nine significant digits, ties up in either engine; what is nearly nothing is 0."""

    def short(c: str):
        x = F.col(f"`{c}`")
        return F.when(F.abs(x) < 1e-9, 0.0).when(x.isNotNull(), F.format_string("%.8e", x * F.lit(_NUDGE)).cast("double")).alias(c)

    return df.select(*[short(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def short(x: str) -> str:
    """The same in SQL."""
    return f"CASE WHEN abs({x}) < 1e-9 THEN 0.0::DOUBLE ELSE CAST(printf('%.8e', ({x})::DOUBLE * {_NUDGE!r}::DOUBLE) AS DOUBLE) END"


def register(name: str, sql: str | None = None, doubles: str = ""):
    """Adds a query; ``doubles`` names the SQL's columns that are shortened."""

    def add(query: Callable[[Callable[[str], DataFrame], SparkSession], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(query(lambda t: table(spark, sf_dir, t), spark))
        if sql is not None:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'{short(c)} AS {c}' for c in doubles.split())}) FROM ({sql})" if doubles else sql
        return query

    return add


def spec_of(*rows: tuple) -> Spec:
    """(name, analysis_type, levels, missing_codes, role, ...) rows as a specification."""
    kinds = {"categorical": "text", "binary": "text", "numeric": "numeric", "integer": "integer", "date": "date", "datetime": "datetime", "text": "text"}
    return validate_spec([dict(name=n, label=n.replace("_", " "), database_type=kinds[k], analysis_type=k, role=r or "variable", levels=lv, missing_codes=m) for n, k, lv, m, r in ((*x, "", "", "")[:5] for x in rows)])


LINES = spec_of(("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_linenumber", "integer", "", "7"), ("l_returnflag", "categorical", "A;N;X"), ("l_linestatus", "categorical", "F;O"), ("l_shipdate", "datetime"))
LINE_NUMBERS = [("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("l_linenumber", "CASE WHEN l_linenumber <> 7 THEN l_linenumber END")]


def long_sql(pairs: list[tuple[str, str]], source: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {extra}'{n}' AS name, ({x})::DOUBLE AS x FROM {source}" for n, x in pairs)


def numeric_sql(values: str, keys: str = "name") -> str:
    """The numeric core over a relation with keys and x (null is missing)."""
    on = " AND ".join(f"v.{k} = b.{k}" for k in keys.split(", "))
    ks = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""
WITH v AS ({values}),
b AS (SELECT {keys}, count(x) AS n_finite, sum(x) AS sum, min(x) AS min, quantile_cont(x, 0.25) AS q1, avg(x) AS mean, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max, stddev_samp(x) AS sd FROM v GROUP BY {keys}),
m AS (SELECT {ks}, sum(pow(x - mean, 2)) AS m2, sum(pow(x - mean, 3)) AS m3, sum(pow(x - mean, 4)) AS m4, count(*) FILTER (x < q1 - 1.5 * (q3 - q1)) AS lo, count(*) FILTER (x > q3 + 1.5 * (q3 - q1)) AS hi FROM v JOIN b ON {on} GROUP BY {ks})
SELECT {ks}, n_finite, sum, min, q1, mean, median, q3, max, q3 - q1 AS iqr, sd, sd * sd AS variance, sd / sqrt(n_finite) AS sem, CASE WHEN mean <> 0 THEN sd / mean END AS cv,
  (m3 / n_finite) / pow(m2 / n_finite, 1.5) * pow(1 - 1.0::DOUBLE / n_finite, 1.5) AS skewness, (m4 / n_finite) / pow(m2 / n_finite, 2) * pow(1 - 1.0::DOUBLE / n_finite, 2) - 3 AS kurtosis, NULL::DOUBLE AS shapiro_p,
  q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence, lo AS n_below_lower, hi AS n_above_upper, lo + hi AS outlier_count, (lo + hi) * 100.0::DOUBLE / n_finite AS outlier_percentage
FROM b JOIN m ON {" AND ".join(f"m.{k} = b.{k}" for k in keys.split(", "))}"""


NUMERIC_DOUBLES = "sum min q1 mean median q3 max iqr sd variance sem cv skewness kurtosis lower_fence upper_fence outlier_percentage"


@register("summary_numeric", numeric_sql(long_sql(LINE_NUMBERS, "lineitem")), NUMERIC_DOUBLES)
def _(t, spark):
    return profile_summaries(t("lineitem"), LINES, assume_timezone=True).numeric


_LEVELS_SQL = """
WITH g AS (SELECT * FROM (VALUES ('l_returnflag', 'A', true), ('l_returnflag', 'N', true), ('l_returnflag', 'X', true), ('l_returnflag', 'R', false), ('l_linestatus', 'F', true), ('l_linestatus', 'O', true)) x(name, level, is_declared)),
c AS (SELECT 'l_returnflag' AS name, l_returnflag AS level FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem),
k AS (SELECT name, level, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT name, count(*) AS n_total, count(level) AS n_observed FROM c GROUP BY ALL)
"""


@register("summary_categorical", _LEVELS_SQL + "SELECT g.name, g.level, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE / n_total AS p_total, coalesce(n, 0)::DOUBLE / n_observed AS p_observed, is_declared, NOT is_declared AS is_unexpected FROM g LEFT JOIN k USING (name, level) JOIN t USING (name)", "p_total p_observed")
def _(t, spark):
    return profile_summaries(t("lineitem"), LINES, assume_timezone=True).categorical


@register("summary_variables", """
WITH c AS (SELECT unnest([
  {'name': 'l_quantity', 'type': 'numeric', 'x': l_quantity::VARCHAR}, {'name': 'l_extendedprice', 'type': 'numeric', 'x': l_extendedprice::VARCHAR}, {'name': 'l_discount', 'type': 'numeric', 'x': l_discount::VARCHAR}, {'name': 'l_tax', 'type': 'numeric', 'x': l_tax::VARCHAR},
  {'name': 'l_linenumber', 'type': 'integer', 'x': CASE WHEN l_linenumber <> 7 THEN l_linenumber::VARCHAR END}, {'name': 'l_returnflag', 'type': 'categorical', 'x': l_returnflag}, {'name': 'l_linestatus', 'type': 'categorical', 'x': l_linestatus}, {'name': 'l_shipdate', 'type': 'datetime', 'x': l_shipdate::VARCHAR}]) AS r FROM lineitem)
SELECT r.name AS name, replace(r.name, '_', ' ') AS label, r.type AS type, 'variable' AS role, false AS required, count(*) AS n, count(*) - count(r.x) AS n_missing, count(r.x) AS n_observed, count(DISTINCT r.x) AS n_unique, 0::BIGINT AS n_infinite, 'summarised' AS status, NULL::VARCHAR AS reason
FROM c GROUP BY r.name, r.type""")
def _(t, spark):
    return profile_summaries(t("lineitem"), LINES, assume_timezone=True).variables


def _text_sql(pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS n_missing, count({c}) AS n_observed, count(DISTINCT {c}) AS n_unique, count(*) FILTER ({c} = '') AS n_empty,
  count(*) FILTER ({c} <> '' AND trim({c}, ' \t\r\n') = '') AS n_whitespace, min(length({c})) AS min_length, max(length({c})) AS max_length FROM {t}""" for t, c in pairs)


@register("summary_text", _text_sql([("documents", "text"), ("documents", "source"), ("documents", "lang")]))
def _(t, spark):
    return profile_summaries(t("documents"), spec_of(("text", "text"), ("source", "text"), ("lang", "text"))).text


@register("summary_temporal", """
SELECT 'o_orderdate' AS name, 'timestamp_ntz' AS source_class, 'UTC' AS timezone, count(*) AS n, 0::BIGINT AS n_missing, count(*) AS n_observed, count(DISTINCT o_orderdate) AS n_unique,
  strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS min, strftime(make_timestamp((floor(quantile_cont(epoch(o_orderdate)::DOUBLE, 0.25)) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS q1, strftime(make_timestamp((floor(quantile_cont(epoch(o_orderdate)::DOUBLE, 0.5)) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS median,
  strftime(make_timestamp((floor(quantile_cont(epoch(o_orderdate)::DOUBLE, 0.75)) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS q3, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS max, epoch(max(o_orderdate))::DOUBLE - epoch(min(o_orderdate))::DOUBLE AS range_value, 'seconds' AS range_unit
FROM orders""", "range_value")
def _(t, spark):
    return profile_summaries(t("orders"), spec_of(("o_orderdate", "datetime")), assume_timezone=True).temporal


@register("schema_check", """
SELECT * FROM (VALUES ('o_orderkey', 'integer', 'bigint', true, true, 'present', 'compatible', NULL), ('o_totalprice', 'numeric', 'double', true, true, 'present', 'compatible', NULL), ('o_orderstatus', 'categorical', 'string', true, true, 'present', 'compatible', NULL), ('o_orderdate', 'datetime', 'timestamp_ntz', true, true, 'present', 'incompatible', 'a timestamp without time zone is no instant'),
  ('absent', 'text', NULL, true, false, 'missing', 'not_applicable', NULL), ('o_custkey', NULL, 'bigint', false, true, 'unexpected', 'not_applicable', NULL), ('o_orderpriority', NULL, 'string', false, true, 'unexpected', 'not_applicable', NULL))
  x(name, expected_type, observed_type, expected_present, observed_present, status, type_status, type_reason)""")
def _(t, spark):
    return schema_check(t("orders"), spec_of(("o_orderkey", "integer"), ("o_totalprice", "numeric"), ("o_orderstatus", "categorical", "F;O;P"), ("o_orderdate", "datetime"), ("absent", "text")))


@register("missing_profile", """
SELECT 'o_orderstatus' AS name, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS n_missing, count(*) FILTER (o_orderstatus = 'P')::DOUBLE / count(*) AS p_missing FROM orders
UNION ALL SELECT 'o_totalprice', count(*), 0, 0.0 FROM orders UNION ALL SELECT 'absent', NULL, NULL, NULL""", "p_missing")
def _(t, spark):
    return profile_missing(t("orders"), spec_of(("o_orderstatus", "categorical", "F;O", "P"), ("o_totalprice", "numeric"), ("absent", "text")))


@register("identifier_profile", """
WITH k AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1)
SELECT 'o_custkey' AS name, 'bigint' AS observed_type, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (o_custkey IS NULL), 0)::BIGINT AS n_missing, sum(c) FILTER (o_custkey IS NOT NULL)::BIGINT AS n_observed, count(o_custkey) AS n_distinct, count(*) FILTER (c > 1) AS n_repeated_values, sum(c - 1)::BIGINT AS duplicate_excess, max(c) AS max_frequency, 'profiled' AS status, NULL::VARCHAR AS reason FROM k""")
def _(t, spark):
    return identifier_profile(t("orders"), spec_of(("o_custkey", "integer", "", "", "identifier"), ("o_totalprice", "numeric")))


@register("histogram", """
WITH v AS (SELECT 'l_quantity' AS name, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem), e AS (SELECT name, min(x) AS lo, max(x) AS hi FROM v GROUP BY name),
k AS (SELECT name, least(30, greatest(1, 1 + floor((x - lo) / ((hi - lo) / 30))))::INT AS bin, count(*) AS c FROM v JOIN e USING (name) GROUP BY ALL)
SELECT name, b::INT AS bin, lo + (hi - lo) / 30 * (b - 1) AS lower, lo + (hi - lo) / 30 * b AS upper, lo + (hi - lo) / 30 * (b - 0.5::DOUBLE) AS midpoint, coalesce(c, 0) AS count FROM e CROSS JOIN range(1, 31) r(b) LEFT JOIN k ON k.name = e.name AND k.bin = b""".replace("SELECT name, b::INT", "SELECT e.name, b::INT"), "lower upper midpoint")
def _(t, spark):
    return Profile(t("lineitem"), spec_of(("l_quantity", "numeric"), ("l_extendedprice", "numeric"))).histogram()


@register("top_levels", """
WITH k AS (SELECT p_brand AS level, count(*) AS n FROM part GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY n DESC, level) AS rank, * FROM k)
SELECT rank::INT AS rank, level, n FROM r WHERE rank <= 20 UNION ALL SELECT 21, 'Other (' || count(*) || ' levels)', sum(n)::BIGINT FROM r WHERE rank > 20""")
def _(t, spark):
    return frequencies(t("part"), "p_brand", 20)


@register("catalogue_profile", "SELECT 'o_orderstatus' AS column, o_orderstatus AS value, count(*) AS n, 0::BIGINT AS n_missing FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), 0 FROM orders GROUP BY 2")
def _(t, spark):
    return catalogue_profile(t("orders"), ["o_orderstatus", "o_orderpriority"])


ORDERS = spec_of(("o_orderpriority", "categorical", "1-URGENT;2-HIGH;6-NEVER", "5-LOW"), ("o_totalprice", "numeric"), ("o_orderstatus", "categorical", "F;O"), ("o_custkey", "integer"), ("o_orderdate", "datetime"))
_STRATA = """
WITH o AS (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS s FROM orders),
g AS (SELECT * FROM (VALUES ('.overall', 1, NULL, 'Overall', true, false, false, false), ('.stratum.001', 2, '1-URGENT', '1-URGENT', false, false, false, true), ('.stratum.002', 3, '2-HIGH', '2-HIGH', false, false, false, true), ('.stratum.003', 4, '6-NEVER', '6-NEVER', false, false, false, true),
  ('.stratum.004', 5, '3-MEDIUM', '3-MEDIUM', false, false, true, false), ('.stratum.005', 6, '4-NOT SPECIFIED', '4-NOT SPECIFIED', false, false, true, false), ('.missing', 7, NULL, 'Missing', false, true, false, false)) x(group_id, group_order, group_value, group_label, is_overall, is_missing_stratum, is_unexpected_stratum, is_declared_stratum)),
r AS (SELECT g.*, o.* FROM g LEFT JOIN o ON g.is_overall OR (g.is_missing_stratum AND o.s IS NULL) OR g.group_value = o.s)"""
_PREFIX = "group_id, group_order, group_value, group_label, is_overall, is_missing_stratum, is_unexpected_stratum"


def _stratified(t):
    return profile_stratified(t("orders"), ORDERS, "o_orderpriority", assume_timezone=True)


@register("stratified_groups", _STRATA + f" SELECT {_PREFIX}, is_declared_stratum, count(o_orderkey) AS n FROM r GROUP BY ALL")
def _(t, spark):
    return _stratified(t).groups


@register("stratified_numeric", _STRATA + f""",
b AS (SELECT {_PREFIX}, count(o_totalprice) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS q3, min(o_totalprice) AS min, max(o_totalprice) AS max FROM r GROUP BY ALL)
SELECT * FROM b""", "mean sd q1 median q3 min max")
def _(t, spark):
    return _stratified(t).numeric.where("name = 'o_totalprice'").select(*_PREFIX.split(", "), "n", "mean", "sd", "q1", "median", "q3", "min", "max")


_CELLS = _STRATA + f""",
lv AS (SELECT unnest(['F', 'O', 'P']) AS level), t AS (SELECT group_id, count(o_orderkey) AS n_total FROM r GROUP BY 1),
c AS (SELECT g.*, level, (SELECT count(*) FROM r WHERE r.group_id = g.group_id AND r.o_orderstatus = level) AS n FROM g CROSS JOIN lv)
"""


@register("stratified_categorical", _CELLS + f"""
SELECT {_PREFIX.replace('group_id', 'c.group_id')}, 'o_orderstatus' AS name, 'categorical' AS type, level, n, n_total, n_total AS n_observed, CASE WHEN n_total > 0 THEN n::DOUBLE / n_total END AS p_total, CASE WHEN n_total > 0 THEN n::DOUBLE / n_total END AS p_observed, level <> 'P' AS is_declared, level = 'P' AS is_unexpected, false AS is_missing_level FROM c JOIN t ON t.group_id = c.group_id
UNION ALL SELECT {_PREFIX.replace('group_id', 'g.group_id')}, 'o_orderstatus', 'categorical', NULL, 0, n_total, n_total, CASE WHEN n_total > 0 THEN 0.0 END, NULL, false, false, true FROM g JOIN t ON t.group_id = g.group_id""", "p_total p_observed")
def _(t, spark):
    return _stratified(t).categorical.where("name = 'o_orderstatus'")


for _basis, _den in (("compatibility", "n_total"), ("column", "n_total"), ("overall", "pop"), ("row", "across")):

    @register(f"categorical_display_{_basis}", _CELLS + f""",
    cells AS (SELECT c.group_id, is_overall, level, n, n_total, false AS is_missing_level FROM c JOIN t ON t.group_id = c.group_id UNION ALL SELECT g.group_id, is_overall, NULL, 0, n_total, true FROM g JOIN t ON t.group_id = g.group_id),
    w AS (SELECT *, (SELECT n_total FROM t WHERE group_id = '.overall') AS pop, coalesce(sum(n) FILTER (NOT is_overall) OVER (PARTITION BY level, is_missing_level), 0)::BIGINT AS across FROM cells)
    SELECT group_id, level, is_missing_level, n_total AS group_n, pop AS population_n, n AS numerator, {_den} AS denominator, CASE WHEN {_den} > 0 THEN n::DOUBLE / {_den} END AS proportion, '{_basis}' AS percentage_basis FROM w""", "proportion")
    def _(t, spark, basis=_basis):
        return categorical_display(_stratified(t), basis).where("name = 'o_orderstatus'").select("group_id", "level", "is_missing_level", "group_n", "population_n", "numerator", "denominator", "proportion", "percentage_basis")


@register("table1", _STRATA + """
SELECT 1 AS row_order, 'mean_sd' AS statistic, group_id, group_label, count(o_orderkey) AS group_n, count(o_totalprice) AS denominator, coalesce(printf('%.1f', avg(o_totalprice)), '—') || ' (' || coalesce(printf('%.1f', stddev_samp(o_totalprice)), '—') || ')' AS display FROM r GROUP BY ALL
UNION ALL SELECT 3, 'missing', group_id, group_label, count(o_orderkey), count(o_orderkey), '0 (' || CASE WHEN count(o_orderkey) > 0 THEN '0.0%' ELSE '—' END || ')' FROM r GROUP BY ALL""")
def _(t, spark):
    return table1(_stratified(t)).where("name = 'o_totalprice' and row_order in (1, 3)").select("row_order", "statistic", "group_id", "group_label", "group_n", "denominator", "display")


@register("stats_numeric", "SELECT n.*, s.* EXCLUDE (name, n_finite, shapiro_p), s.n_finite FROM (SELECT name, count(*) AS n, 0::BIGINT AS n_missing, count(*) AS n_observed, 0::BIGINT AS n_infinite FROM (" + long_sql([("p_size", "p_size"), ("p_retailprice", "p_retailprice")], "part") + ") GROUP BY name) n JOIN (" + numeric_sql(long_sql([("p_size", "p_size"), ("p_retailprice", "p_retailprice")], "part")) + ") s ON s.name = n.name", NUMERIC_DOUBLES)
def _(t, spark):
    # SQL can't say Shapiro-Wilk; tests hold it against published values.
    return stats.stats_numeric(t("part"), ["p_size", "p_retailprice"]).drop("shapiro_p")


@register("count_outliers", "SELECT 'value' AS column, count(*) AS n_outliers FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def _(t, spark):
    return stats.count_outliers(t("events"), "value")


@register("stats_text", " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, count({c})::DOUBLE / count(*) AS complete_rate, min(length({c})) AS min_length, max(length({c})) AS max_length, count(*) FILTER ({c} = '') AS empty, count(DISTINCT {c}) AS n_unique, count(*) FILTER ({c} <> '' AND trim({c}, ' \t\r\n') = '') AS whitespace FROM customer" for c in ("c_name", "c_mktsegment")), "complete_rate")
def _(t, spark):
    return stats.stats_text(t("customer"))


@register("stats_categories", """
WITH k AS (SELECT p_type AS level, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, level) AS r FROM k)
SELECT 'p_type' AS variable, 0::BIGINT AS n_missing, 1.0::DOUBLE AS complete_rate, false AS ordered, count(*) AS n_unique, string_agg(level || ' (' || n || ')', ', ' ORDER BY r) FILTER (r <= 3) AS top_counts FROM r""", "complete_rate")
def _(t, spark):
    return stats.stats_categories(t("part"), ["p_type"])


@register("category_table", "SELECT 'p_type' AS variable, p_type AS level, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2")
def _(t, spark):
    return stats.category_table(t("part"), ["p_type", "p_brand"])


@register("stats_dates", """
WITH d AS (SELECT o_orderdate::DATE AS d, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS x FROM orders), b AS (SELECT count(*) AS n, count(DISTINCT d) AS u, min(x) AS lo, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, max(x) AS hi FROM d),
m AS (SELECT d FROM d GROUP BY d ORDER BY count(*) DESC, d LIMIT 1), f AS (SELECT *, (SELECT d FROM m) AS mode FROM b)
SELECT 'day' AS column, unnest(['N', 'N Missing', 'N Unique', 'Min', '25%', 'Median', '75%', 'Max', 'IQR', 'Most Common', 'Range (Days)']) AS statistic, unnest([n::VARCHAR, '0', u::VARCHAR, (DATE '1970-01-01' + lo::INT)::VARCHAR, (DATE '1970-01-01' + floor(q1)::INT)::VARCHAR, (DATE '1970-01-01' + floor(q2)::INT)::VARCHAR, (DATE '1970-01-01' + floor(q3)::INT)::VARCHAR, (DATE '1970-01-01' + hi::INT)::VARCHAR, printf('%.6f', q3 - q1), mode::VARCHAR, printf('%.6f', hi - lo)]) AS value FROM f""")
def _(t, spark):
    return stats.stats_dates(t("orders").select(F.col("o_orderdate").cast("date").alias("day")))


_STATISTICS = ["N", "N Missing", "N Unique", "Min", "25%", "Median", "75%", "Max", "IQR", "Most Common", "Range (Days)"]


@register("stats_dates_wide", "SELECT \"column\", " + ", ".join(f"max(value) FILTER (statistic = '{x}') AS \"{x}\"" for x in _STATISTICS) + f" FROM ({SQL['stats_dates']}) GROUP BY \"column\"")
def _(t, spark):
    return stats.stats_dates_wide(t("orders").select(F.col("o_orderdate").cast("date").alias("day")))


@register("date_gaps", "WITH d AS (SELECT o_orderdate::DATE AS d, lag(o_orderdate::DATE) OVER (ORDER BY o_orderdate) AS p FROM orders) SELECT datediff('day', p, d)::INT AS gap_days, count(*) AS n FROM d WHERE p IS NOT NULL GROUP BY 1")
def _(t, spark):
    return stats.date_gaps(t("orders"), "o_orderdate")


@register("date_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def _(t, spark):
    return stats.date_months(t("orders"), "o_orderdate")


@register("summary_by_class", "SELECT 'o_orderstatus' AS id, o_orderstatus AS x, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', '5-LOW') GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority NOT IN ('F', '5-LOW') GROUP BY 2")
def _(t, spark):
    return stats.summary_by_class(t("orders"), ["F", "5-LOW"], "text", "exclude")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("tidy_counts", "WITH k AS (SELECT p_brand AS id, " + ", ".join(f"count(*) FILTER (p_type = '{x}') AS {x}" for x in _TYPES) + ", count(*) AS n FROM part GROUP BY 1) SELECT id, " + ", ".join(f"nullif({x}, 0) AS {x}" for x in _TYPES) + ", n AS row_sums, n::DOUBLE / 1000 * 100 AS percent FROM k", "percent")
def _(t, spark):
    counts = t("part").groupBy(F.col("p_brand").alias("id"), F.col("p_type").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return stats.tidy_counts(counts, 1000, _TYPES)


@register("outcome_proportion", "SELECT count(*) AS n_at_risk, sum(toxic)::BIGINT AS n_outcome, round(avg(toxic), 4) AS proportion FROM labels WHERE quality = 1", "proportion")
def _(t, spark):
    return stats.outcome_proportion(t("labels"), "toxic", "quality", 1)


@register("contingency_table", "WITH a AS (SELECT DISTINCT o_orderstatus AS x FROM orders), b AS (SELECT DISTINCT o_orderpriority AS y FROM orders) SELECT x, y, (SELECT count(*) FROM orders WHERE o_orderstatus = x AND o_orderpriority = y) AS n FROM a CROSS JOIN b")
def _(t, spark):
    return stats.contingency(t("orders"), "o_orderstatus", "o_orderpriority")


#: Twice the normal density between 0 and z, by Simpson's rule.
_NORMAL = "(SELECT 2 / sqrt(2 * pi()) * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(i * z / 4000, 2) / 2)) * z / 4000 / 3 FROM range(0, 4001) q(i))"


@register("contingency_test", f"""
WITH t AS (SELECT quality AS x, toxic AS y, count(*)::DOUBLE AS o FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e FROM t),
c AS (SELECT sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e) AS statistic FROM e), z AS (SELECT statistic, sqrt(statistic) AS z FROM c)
SELECT 'toxic' AS variable, 'chisq' AS method, statistic, 1 AS parameter, round(1 - {_NORMAL}, 8) AS p_value FROM z""", "statistic p_value")
def _(t, spark):
    return stats.contingency_test(t("labels"), "quality", "toxic", "chisq").withColumn("p_value", F.round("p_value", 8))


_FISHER = """
{0}_t AS (SELECT count(*) FILTER ({1} AND {2}) AS a, count(*) FILTER ({1}) AS n1, count(*) FILTER (NOT {1}) AS n2, count(*) FILTER ({2}) AS k FROM {3} WHERE {1} IS NOT NULL AND {2} IS NOT NULL),
{0}_p AS (SELECT a, x, lgamma(n1 + 1) - lgamma(x + 1) - lgamma(n1 - x + 1) + lgamma(n2 + 1) - lgamma(k - x + 1) - lgamma(n2 - k + x + 1) - lgamma(n1 + n2 + 1) + lgamma(k + 1) + lgamma(n1 + n2 - k + 1) AS lp FROM {0}_t, unnest(range(greatest(0, k - n2), least(k, n1) + 1)) r(x)),
{0} AS (SELECT round(sum(exp(lp)) FILTER (lp <= (SELECT lp FROM {0}_p WHERE x = a) + 1e-7), 7) AS p FROM {0}_p)"""


@register("contingency_fisher", "WITH " + _FISHER.format("f", "(quality = 1)", "(toxic = 1)", "labels") + ", " + _FISHER.format("g", "(quality = 1)", "(doc_id % 2 = 1)", "labels") + " SELECT 'toxic' AS variable, 'fisher' AS method, NULL::DOUBLE AS statistic, NULL::INT AS parameter, p AS p_value FROM f UNION ALL SELECT 'odd', 'fisher', NULL, NULL, p FROM g", "p_value")
def _(t, spark):
    rows = t("labels").select("quality", "toxic", (F.col("doc_id") % 2).alias("odd"))
    return stats.contingency_tests(rows, "quality").withColumn("p_value", F.round("p_value", 7))


@register("contingency_nxn", """
WITH g AS (SELECT DISTINCT o_orderpriority FROM orders), k AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1)
SELECT o_orderpriority, F, O, P, 0::BIGINT AS Yes, 0::BIGINT AS No, F + O + P AS total, round(F * 100.0::DOUBLE / (F + O + P), 2) AS perc_F, round(O * 100.0::DOUBLE / (F + O + P), 2) AS perc_O, round(P * 100.0::DOUBLE / (F + O + P), 2) AS perc_P, 0.0::DOUBLE AS perc_Yes, 0.0::DOUBLE AS perc_No FROM k""", "perc_F perc_O perc_P perc_Yes perc_No")
def _(t, spark):
    return stats.contingency_nxn(t("orders"), "o_orderstatus", ["o_orderpriority"])


_PAIRS = [(a, b) for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")]


def _with_p(pairs: str) -> str:
    """(var1, var2, r, n) rows with the two-sided p of Student's t, integrated by Simpson's rule; beyond 40 it is nothing."""
    return f"""WITH pairs AS ({pairs}), t AS (SELECT *, (n - 2)::DOUBLE AS v, CASE WHEN var1 <> var2 THEN least(40, abs(r) * sqrt((n - 2) / nullif(1 - r * r, 0))) END AS z FROM pairs)
SELECT var1, var2, r, n, CASE WHEN var1 <> var2 THEN round(1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * (SELECT sum(CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(i * z / 8000, 2) / v, -(v + 1) / 2)) * z / 8000 / 3 FROM range(0, 8001) q(i)), 7) END AS p FROM t"""


@register("correlation_pearson", _with_p(" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, {'1.0::DOUBLE' if a == b else f'corr({a}, {b})'} AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS)), "r p")
def _(t, spark):
    return stats.correlations(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "pearson").withColumn("p", F.round("p", 7))


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))
_RANKED = " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, {'1.0::DOUBLE' if a == b else f'corr({a}, {b})'} AS r, count(*) AS n FROM (SELECT {_RANKS} FROM lineitem)" for a, b in _PAIRS if a >= b)


@register("correlation_spearman", _with_p(_RANKED), "r p")
def _(t, spark):
    names = ["l_discount", "l_extendedprice", "l_quantity"]
    return stats.lower_triangle(stats.correlations(t("lineitem"), names), names).withColumn("p", F.round("p", 7))


@register("kaplan_meier", """
WITH a AS (SELECT o_orderpriority AS g, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS t, (o_orderstatus = 'F')::INT AS e FROM orders), k AS (SELECT g, t, sum(e) AS d, count(*) AS c FROM a GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY g ORDER BY t DESC) AS n FROM k)
SELECT g AS "group", t AS time, n::BIGINT AS n_risk, d::BIGINT AS n_event, (c - d)::BIGINT AS n_censor, coalesce(exp(sum(ln(CASE WHEN d < n THEN 1 - d::DOUBLE / n END)) OVER (PARTITION BY g ORDER BY t)), 0) * CASE WHEN max((d = n)::INT) OVER (PARTITION BY g ORDER BY t) = 1 THEN 0 ELSE 1 END AS surv FROM r""", "surv")
def _(t, spark):
    rows = t("orders").select("o_orderpriority", F.datediff("o_orderdate", F.lit(dt.date(1995, 1, 1))).alias("days"), (F.col("o_orderstatus") == "F").cast("int").alias("event"))
    return stats.kaplan_meier(rows, "days", "event", "o_orderpriority")


@register("duplicate_rows", "SELECT * FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 60)", "c_acctbal")
def _(t, spark):
    return clean.duplicates(t("customer"), "c_nationkey", 60)


@register("repeat_numbers", """
WITH w AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER u IS DISTINCT FROM event_type AND lag(event_id) OVER u IS NOT NULL THEN 0 ELSE 1 END AS s FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM w)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id)::INT AS rep_num FROM r""")
def _(t, spark):
    return clean.repeat_numbers(t("events").select("user_id", "event_id", "ts", "event_type"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "rep_num")


@register("spread_repeated", """SELECT n_nationkey, n_name AS "n_name.2" FROM nation WHERE n_regionkey = 2""")
def _(t, spark):
    return clean.spread_repeated(t("nation"), "n_regionkey", "n_nationkey")["2"].drop("n_regionkey.2")


@register("merge_tables", 'SELECT n_nationkey AS k, n_name AS label, s.label AS label_suppliers, s.n FROM nation FULL JOIN (SELECT s_nationkey AS k, min(s_name) AS label, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey')
def _(t, spark):
    return clean.merge_all({"nations": t("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("label")), "suppliers": t("supplier").groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.min("s_name").alias("label"), F.count(F.lit(1)).alias("n"))}, "k")


@register("stratified_sample", """
WITH d AS (SELECT *, ('0x' || substr(md5('7:' || o_orderkey::VARCHAR), 1, 13))::BIGINT AS u FROM orders)
SELECT * EXCLUDE (u) FROM d QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY u, o_orderkey) <= round_even(count(*) OVER (PARTITION BY o_orderstatus) * 0.1::DOUBLE, 0)""", "o_totalprice")
def _(t, spark):
    return clean.stratified_sample(t("orders"), "o_orderstatus", 0.1, "o_orderkey", 7)


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("missing_percent", " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) - count({c}) AS na_count, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS na_perc FROM lineitem" for c in _LINE_COLUMNS), "na_perc")
def _(t, spark):
    return clean.missing_percent(t("lineitem").select(*_LINE_COLUMNS))


@register("inject_missing", """
WITH d AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer) SELECT (SELECT count(*) FROM d) AS n, 120::BIGINT AS n_balance, 75::BIGINT AS n_segment, 30::BIGINT AS n_blank, 0::BIGINT AS n_other""")
def _(t, spark):
    was = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    now = inject_missing(was, {"c_acctbal": 120, "c_mktsegment": 75}, "c_custkey", 3, {"c_mktsegment": 30})
    both = now.join(was.withColumnsRenamed({"c_mktsegment": "s", "c_acctbal": "b"}), "c_custkey")
    changed = F.coalesce((F.col("c_mktsegment") != F.col("s")) & (F.col("c_mktsegment") != ""), F.lit(False)) | F.coalesce(F.col("c_acctbal") != F.col("b"), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal").isNull()).alias("n_balance"), F.count_if(F.col("c_mktsegment").isNull()).alias("n_segment"), F.count_if(F.col("c_mktsegment") == "").alias("n_blank"), F.count_if(changed).alias("n_other"))


@register("head_and_tail", "(SELECT 'head' AS part, o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL (SELECT 'tail', o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def _(t, spark):
    return clean.head_and_tail(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])


@register("values_to_null", "SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('P', 'F') THEN o_orderstatus END AS o_orderstatus FROM orders")
def _(t, spark):
    return clean.values_to_null(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["P", "F"])


@register("integers_to_text", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _(t, spark):
    return clean.integers_to_text(t("nation").select("n_nationkey", "n_name", "n_regionkey"))


@register("categorical_candidates", "SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS name")
def _(t, spark):
    found = clean.categorical_candidates(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), 10)
    return spark.createDataFrame([(x,) for x in found], "name string")


@register("offset_instants", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + INTERVAL 10 HOUR WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE + INTERVAL 12 HOUR END AS at FROM orders")
def _(t, spark):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T12:00:00+02:00"))).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T12:00:00Z"))).otherwise(F.concat(day, F.lit("T12:00:00+15:00")))
    return t("orders").select("o_orderkey", offset_instant(text).cast("timestamp_ntz").alias("at"))


@register("replace_value", "SELECT p_partkey, CASE WHEN p_type LIKE '%SMALL%' THEN 'tiny' ELSE p_type END AS p_type FROM part")
def _(t, spark):
    return clean.replace_value(t("part").select("p_partkey", "p_type"), "p_type", "SMALL", "tiny")


@register("label_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS o_orderstatus FROM orders")
def _(t, spark):
    return clean.label_values(t("orders").select("o_orderkey", "o_orderstatus"), [("o_orderstatus", "F", "finished"), ("o_orderstatus", "O", "open")])[0]


@register("transpose", """SELECT 'r_name' AS V1, max(r_name) FILTER (r_regionkey = 0) AS "0", max(r_name) FILTER (r_regionkey = 1) AS "1", max(r_name) FILTER (r_regionkey = 2) AS "2", max(r_name) FILTER (r_regionkey = 3) AS "3", max(r_name) FILTER (r_regionkey = 4) AS "4" FROM region""")
def _(t, spark):
    return clean.transpose(t("region"), "r_regionkey")


@register("contains_text", "SELECT c_custkey, contains(c_name, c_nationkey::VARCHAR) AS found FROM customer")
def _(t, spark):
    return clean.contains_text(t("customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("k")), "c_name", "k").select("c_custkey", "found")


@register("format_numbers", "SELECT s_suppkey, s_name, printf('%.2f', s_acctbal) AS s_acctbal FROM supplier")
def _(t, spark):
    return clean.format_numbers(t("supplier").select("s_suppkey", "s_name", "s_acctbal"), ["s_suppkey"])


KEYS = {n: f"var_{i:016d}" for i, n in enumerate(LINES.names)}


@register("quality_evidence", "SELECT 'var_' || lpad((k.i)::VARCHAR, 16, '0') AS variable_key, count(*) AS n, count(*) - count(x) AS n_missing, count(x) AS n_observed, count(DISTINCT x) AS n_unique, min(x) AS observed_min, max(x) AS observed_max, any_value(a - 1.5 * (b - a)) AS tukey_lower_fence, any_value(b + 1.5 * (b - a)) AS tukey_upper_fence, count(*) FILTER (x < a - 1.5 * (b - a)) AS n_below_tukey, count(*) FILTER (x > b + 1.5 * (b - a)) AS n_above_tukey FROM (" + long_sql(LINE_NUMBERS, "lineitem") + ") v JOIN (SELECT name, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM (" + long_sql(LINE_NUMBERS, "lineitem") + ") GROUP BY name) q USING (name) JOIN (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber']) AS name, unnest(range(5)) AS i) k USING (name) GROUP BY k.i", "observed_min observed_max tukey_lower_fence tukey_upper_fence")
def _(t, spark):
    return quality.quality_proposals(t("lineitem"), LINES, KEYS)[0].where("declared_type in ('numeric', 'integer')").select("variable_key", "n", "n_missing", "n_observed", "n_unique", "observed_min", "observed_max", "tukey_lower_fence", "tukey_upper_fence", "n_below_tukey", "n_above_tukey")


@register("quality_proposals", """
SELECT 'var_0000000000000000' AS variable_key, 'pending' AS proposal_state, 'binary' AS candidate_type, true AS units_review_required, '' AS candidate_units, NULL::DOUBLE AS candidate_screening_min, NULL::DOUBLE AS candidate_screening_max, '' AS screening_basis, '0;1' AS candidate_allowed_levels, '' AS candidate_missing_codes, 'units_not_declared;observed_integral_zero_one' AS rationale_codes
UNION ALL SELECT 'var_0000000000000001', 'pending', 'binary', true, '', NULL, NULL, '', '0;1', '', 'units_not_declared;observed_integral_zero_one'""")
def _(t, spark):
    return quality.quality_proposals(t("labels"), spec_of(("quality", "integer"), ("toxic", "integer"), ("doc_id", "integer", "", "", "id")), {"quality": "var_0000000000000000", "toxic": "var_0000000000000001", "doc_id": "var_0000000000000002"})[1]


_RULES = [dict(variable_key=KEYS["l_quantity"], declared_type="numeric", valid_min=5, valid_max=45, allowed_values="", missing_codes="10"), dict(variable_key=KEYS["l_returnflag"], declared_type="categorical", valid_min=None, valid_max=None, allowed_values="A;N", missing_codes="")]


@register("cleaning_audit", f"""
SELECT '{KEYS["l_quantity"]}' AS variable_key, count(*) AS n, 0::BIGINT AS n_missing_before, count(*) FILTER (l_quantity = 10 OR l_quantity < 5 OR l_quantity > 45) AS n_missing_after, count(*) FILTER (l_quantity = 10 OR l_quantity < 5 OR l_quantity > 45) AS n_transitioned_to_missing, true AS reconciled FROM lineitem
UNION ALL SELECT '{KEYS["l_returnflag"]}', count(*), 0, count(*) FILTER (l_returnflag NOT IN ('A', 'N')), count(*) FILTER (l_returnflag NOT IN ('A', 'N')), true FROM lineitem""")
def _(t, spark):
    return quality.apply_rules(t("lineitem"), quality.cleaning_rules(_RULES), KEYS)[1]


@register("cleaned_table", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 10 AND l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS l_quantity, CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag END AS l_returnflag FROM lineitem", "l_quantity")
def _(t, spark):
    return quality.apply_rules(t("lineitem"), quality.cleaning_rules(_RULES), KEYS)[0].select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@register("preparation_audit", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS c FROM orders)
SELECT x.name, x.stage, x.action, x.status, n AS n_total, CASE WHEN x.s THEN c ELSE 0 END AS n_sentinel_missing FROM n, (VALUES ('o_orderstatus', 'presence', 'assess_presence', 'unchanged', false), ('o_orderstatus', 'missingness', 'replace_sentinel_missing', 'planned', true), ('o_orderstatus', 'type', 'match_levels', 'unchanged', true), ('o_orderstatus', 'levels', 'assess_levels', 'unchanged', true),
  ('o_totalprice', 'presence', 'assess_presence', 'unchanged', false), ('o_totalprice', 'missingness', 'retain_missingness', 'unchanged', false), ('o_totalprice', 'type', 'retain_numeric', 'unchanged', false)) x(name, stage, action, status, s)""")
def _(t, spark):
    return prepare(t("orders"), spec_of(("o_orderstatus", "categorical", "F;O", "P"), ("o_totalprice", "numeric")))[1].where("stage not in ('extra', 'dataset')").select("name", "stage", "action", "status", "n_total", "n_sentinel_missing")


@register("prepared_table", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, o_custkey::DOUBLE AS o_custkey FROM orders", "o_custkey")
def _(t, spark):
    return prepare(t("orders"), spec_of(("o_orderkey", "integer"), ("o_orderstatus", "categorical", "F;O", "P"), ("o_custkey", "numeric")), "apply", extra_variables="drop")[0].select("o_orderkey", "o_orderstatus", "o_custkey")


@register("civil_dates", "SELECT o_orderkey, o_orderdate::DATE AS order_day FROM orders")
def _(t, spark):
    operation = civil_date_operations([dict(variable_key="var_00000000000000aa", output_name="order_day", source_type="local_timestamp", operation="civil_date", time_policy="midnight", missing_policy="preserve", review_state="approved")])
    return derive_civil_dates(t("orders"), operation, {"o_orderdate": "var_00000000000000aa"})[0].select("o_orderkey", "order_day")


def _relations(t):
    return quality.relationship_profile(t("nation"), [("n_nationkey", "n_name"), ("n_regionkey", "n_name"), ("n_name", "n_regionkey")], names=("main", "nation"))


_REL_KEYS = "left_schema, left_table, left_column, right_schema, right_table, right_column"


@register("relationship_summary", " UNION ALL ".join(f"""SELECT 'main' AS left_schema, 'nation' AS left_table, '{a}' AS left_column, 'main' AS right_schema, 'nation' AS right_table, '{b}' AS right_column, count(*) AS total_rows, count(*) AS both_present, count(DISTINCT {a}) AS distinct_left, count(DISTINCT {b}) AS distinct_right, (SELECT max(c) FROM (SELECT count(DISTINCT {b}) AS c FROM nation GROUP BY {a})) AS max_right_per_left, (SELECT max(c) FROM (SELECT count(DISTINCT {a}) AS c FROM nation GROUP BY {b})) AS max_left_per_right, '{k}' AS relationship_class FROM nation""" for a, b, k in (("n_nationkey", "n_name", "one_to_one"), ("n_regionkey", "n_name", "one_to_many"), ("n_name", "n_regionkey", "many_to_one"))))
def _(t, spark):
    return _relations(t)["summary"].select(*_REL_KEYS.split(", "), "total_rows", "both_present", "distinct_left", "distinct_right", "max_right_per_left", "max_left_per_right", "relationship_class")


@register("relationship_mappings", " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, {a}::VARCHAR AS left_value, {b}::VARCHAR AS right_value, count(*) AS n FROM nation GROUP BY 3, 4" for a, b in (("n_nationkey", "n_name"), ("n_regionkey", "n_name"), ("n_name", "n_regionkey"))))
def _(t, spark):
    return _relations(t)["mappings"].select("left_column", "right_column", "left_value", "right_value", "n")


@register("relationship_conflicts", "SELECT 'n_regionkey' AS left_column, 'left_maps_multiple_right' AS exception_type, n_regionkey::VARCHAR AS left_value, n_name AS right_value, count(*) AS n FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(DISTINCT n_name) > 1) GROUP BY ALL UNION ALL SELECT 'n_name', 'right_maps_multiple_left', n_name, n_regionkey::VARCHAR, count(*) FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(DISTINCT n_name) > 1) GROUP BY ALL")
def _(t, spark):
    return _relations(t)["conflicts"].select("left_column", "exception_type", "left_value", "right_value", "n")


@register("identifier_qc", """
WITH k AS (SELECT c_name AS v, count(*) AS c FROM customer GROUP BY 1)
SELECT 'c_name' AS name, 18 AS expected_length, true AS pattern_declared, true AS case_sensitive, 'crm' AS provenance, sum(c)::BIGINT AS n_input, 0::BIGINT AS n_null, 0::BIGINT AS n_blank, sum(c)::BIGINT AS n_nonblank, count(*) AS n_distinct, sum(c - 1)::BIGINT AS duplicate_excess, max(c) AS max_frequency, 0::BIGINT AS n_leading_whitespace, 0::BIGINT AS n_trailing_whitespace, coalesce(sum(c) FILTER (regexp_matches(v, '\\s')), 0)::BIGINT AS n_internal_whitespace,
  min(length(v)) AS min_length, max(length(v)) AS max_length, coalesce(sum(c) FILTER (length(v) <> 18), 0)::BIGINT AS n_expected_length_violations, coalesce(sum(c) FILTER (NOT regexp_matches(v, '^Customer#0+[1-4]')), 0)::BIGINT AS n_pattern_violations, 0::BIGINT AS n_case_variations FROM k""")
def _(t, spark):
    return quality.identifier_qc(t("customer"), [quality.Identifier("c_name", 18, "^Customer#0+[1-4]", True, "crm")])[0]


@register("identifier_availability", "SELECT CASE WHEN trim(lang) <> '' THEN '1' ELSE '0' END || '_' || CASE WHEN trim(source) <> '' THEN '1' ELSE '0' END AS pattern, count(*) AS n_rows FROM documents GROUP BY 1")
def _(t, spark):
    return quality.identifier_qc(t("documents"), [quality.Identifier("lang"), quality.Identifier("source")])[1]


@register("coordinate_profile", """
WITH p AS (SELECT l_quantity * 8 - 200 AS x, l_extendedprice / 1000 - 50 AS y FROM lineitem)
SELECT 'site' AS geo_pair, 'x' AS x_name, 'y' AS y_name, 'EPSG:4326' AS geo_crs, 4326 AS crs_epsg, count(*) AS n, count(*) AS complete_pairs, 0::BIGINT AS missing_x, 0::BIGINT AS missing_y, 0::BIGINT AS both_missing, 0::BIGINT AS non_finite, count(*) FILTER (abs(x) > 180 OR abs(y) > 90) AS range_failures, count(*) FILTER (abs(x) > 180 OR abs(y) > 90) = 0 AS map_ready,
  CASE WHEN count(*) FILTER (abs(x) > 180 OR abs(y) > 90) = 0 THEN 'ready' ELSE 'not_ready' END AS status, CASE WHEN count(*) FILTER (abs(x) > 180 OR abs(y) > 90) = 0 THEN 'all_rows_map_ready' ELSE 'declared_crs_range_failure' END AS reason FROM p""")
def _(t, spark):
    points = t("lineitem").select((F.col("l_quantity") * 8 - 200).alias("x"), (F.col("l_extendedprice") / 1000 - 50).alias("y"))
    spec = validate_spec([dict(name=n, label=n, database_type="numeric", analysis_type="numeric", role="coordinate", geo_role=n, geo_pair="site", geo_crs="EPSG:4326") for n in ("x", "y")])
    return quality.coordinate_profile(points, spec)


@register("describe_points", "SELECT l_returnflag, count(*) AS n_features, 0::BIGINT AS n_null, 0::BIGINT AS n_invalid, min(l_quantity) AS xmin, min(l_extendedprice) AS ymin, max(l_quantity) AS xmax, max(l_extendedprice) AS ymax FROM lineitem GROUP BY 1", "xmin ymin xmax ymax")
def _(t, spark):
    return quality.describe_points(t("lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


# Periods: orders by year, customers as entities.
YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)
_YEARS_SQL = f"WITH y AS (SELECT *, year(o_orderdate) - {YEARS[0] - 1} AS p FROM orders WHERE year(o_orderdate) IN {YEARS}), e AS (SELECT DISTINCT p, o_custkey AS id FROM y)"


def _years(t) -> Periods:
    return periods_by(t("orders"), F.year("o_orderdate"), {str(y): y for y in YEARS})


@register("population_periods", _YEARS_SQL + f", k AS (SELECT p, o_custkey, count(*) AS c FROM y GROUP BY ALL), r AS (SELECT p, o_custkey, o_orderstatus, count(*) AS c FROM y GROUP BY ALL) SELECT p::INT AS period_index, (p + {YEARS[0] - 1})::VARCHAR AS period_label, sum(c)::BIGINT AS n_rows, count(*) AS n_distinct_entities, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS n_repeated_entity_rows, sum(c - 1)::BIGINT AS n_repeated_entity_excess, max(c) AS max_entity_frequency, (SELECT count(*) FROM r WHERE r.p = k.p) AS n_distinct_record_keys, (SELECT sum(r.c - 1)::BIGINT FROM r WHERE r.p = k.p) AS n_duplicate_record_key_excess FROM k GROUP BY p")
def _(t, spark):
    return population_qc(_years(t), "o_custkey", ["o_custkey", "o_orderstatus"]).period_summary.select("period_index", "period_label", "n_rows", "n_distinct_entities", "n_repeated_entity_rows", "n_repeated_entity_excess", "max_entity_frequency", "n_distinct_record_keys", "n_duplicate_record_key_excess")


_OVERLAP = _YEARS_SQL + ", s AS (SELECT p, count(*) AS n FROM e GROUP BY 1), o AS (SELECT a.p AS l, b.p AS r, count(*) AS k FROM e a JOIN e b ON a.id = b.id AND a.p < b.p GROUP BY ALL), f AS (SELECT a.p AS l, b.p AS r, a.n AS nl, b.n AS nr, coalesce(k, 0) AS k FROM s a JOIN s b ON a.p < b.p LEFT JOIN o ON o.l = a.p AND o.r = b.p) "


@register("population_overlap", _OVERLAP + "SELECT l::INT AS left_period_index, r::INT AS right_period_index, nl AS n_left_entities, nr AS n_right_entities, k AS n_overlap, nl + nr - k AS n_union, nl - k AS n_left_only, nr - k AS n_right_only, k::DOUBLE / nl AS left_overlap_proportion, k::DOUBLE / nr AS right_overlap_proportion FROM f", "left_overlap_proportion right_overlap_proportion")
def _(t, spark):
    return population_qc(_years(t), "o_custkey").pairwise_overlap.select("left_period_index", "right_period_index", "n_left_entities", "n_right_entities", "n_overlap", "n_union", "n_left_only", "n_right_only", "left_overlap_proportion", "right_overlap_proportion")


@register("population_adjacent", _OVERLAP + "SELECT l::INT AS from_period_index, r::INT AS to_period_index, k AS n_retained, nl - k AS n_exited, nr - k AS n_entered, k::DOUBLE / nl AS retention_proportion, (nl - k)::DOUBLE / nl AS exit_proportion, (nr - k)::DOUBLE / nr AS entry_proportion FROM f WHERE r = l + 1", "retention_proportion exit_proportion entry_proportion")
def _(t, spark):
    return population_qc(_years(t), "o_custkey").adjacent.select("from_period_index", "to_period_index", "n_retained", "n_exited", "n_entered", "retention_proportion", "exit_proportion", "entry_proportion")


@register("population_history", _YEARS_SQL + ", h AS (SELECT id, min(p) AS a, max(p) AS b, count(*) AS k FROM e GROUP BY 1) SELECT a::INT AS first_period_index, b::INT AS last_period_index, k::INT AS periods_observed, (b - a + 1 - k)::INT AS gap_periods, b - a + 1 > k AS has_gap, count(*) AS n_entities, (sum(count(*)) OVER ())::BIGINT AS proportion_denominator, count(*)::DOUBLE / sum(count(*)) OVER () AS proportion FROM h GROUP BY a, b, k", "proportion")
def _(t, spark):
    return population_qc(_years(t), "o_custkey").entity_history.drop("first_period_label", "last_period_label")


DRIFT = spec_of(("o_totalprice", "numeric"), ("o_orderpriority", "categorical", "1-URGENT;2-HIGH", "5-LOW"), ("o_orderdate", "datetime"))


def _drift(t):
    return longitudinal_drift(_years(t), DRIFT, assume_timezone=True)


@register("drift_missingness", _YEARS_SQL + ", m AS (SELECT p, count(*) AS n, count(*) FILTER (o_orderpriority = '5-LOW') AS k FROM y GROUP BY 1) SELECT a.p::INT AS left_period_index, 'o_orderpriority' AS variable, a.k AS n_missing_left, b.k AS n_missing_right, b.k::DOUBLE / b.n - a.k::DOUBLE / a.n AS absolute_change, (b.k::DOUBLE / b.n - a.k::DOUBLE / a.n) / (a.k::DOUBLE / a.n) AS relative_change FROM m a JOIN m b ON b.p = a.p + 1", "absolute_change relative_change")
def _(t, spark):
    return _drift(t).missingness_adjacent.where("variable = 'o_orderpriority'").select("left_period_index", "variable", "n_missing_left", "n_missing_right", "absolute_change", "relative_change")


@register("drift_numeric", _YEARS_SQL + ", m AS (SELECT p, count(*) AS n, min(o_totalprice) AS lo, avg(o_totalprice) AS mean, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr, stddev_samp(o_totalprice) AS sd FROM y GROUP BY 1) SELECT a.p::INT AS left_period_index, a.n AS left_n_finite, b.n AS right_n_finite, b.lo - a.lo AS min_change, b.mean - a.mean AS mean_change, b.med - a.med AS median_change, b.iqr - a.iqr AS iqr_change, b.sd - a.sd AS sd_change FROM m a JOIN m b ON b.p = a.p + 1", "min_change mean_change median_change iqr_change sd_change")
def _(t, spark):
    return _drift(t).numeric_adjacent.select("left_period_index", "left_n_finite", "right_n_finite", *[F.round(f"{c}_change", 4).alias(f"{c}_change") for c in ("min", "mean", "median", "iqr", "sd")])


SQL["drift_numeric"] = SQL["drift_numeric"].replace("b.lo - a.lo", "round(b.lo - a.lo, 4)").replace("b.mean - a.mean", "round(b.mean - a.mean, 4)").replace("b.med - a.med", "round(b.med - a.med, 4)").replace("b.iqr - a.iqr", "round(b.iqr - a.iqr, 4)").replace("b.sd - a.sd", "round(b.sd - a.sd, 4)")


@register("drift_categorical", _YEARS_SQL + ", t AS (SELECT p, count(*) AS n, count(*) FILTER (o_orderpriority <> '5-LOW') AS o FROM y GROUP BY 1), c AS (SELECT p, o_orderpriority AS level, count(*) AS k FROM y WHERE o_orderpriority <> '5-LOW' GROUP BY ALL) SELECT a.p::INT AS left_period_index, l.level, a.k AS left_n, b.k AS right_n, b.k::DOUBLE / tb.n - a.k::DOUBLE / ta.n AS p_total_difference, b.k::DOUBLE / tb.o - a.k::DOUBLE / ta.o AS p_observed_difference, 'present_both' AS level_status FROM (SELECT DISTINCT level FROM c) l JOIN c a ON a.level = l.level JOIN c b ON b.level = l.level AND b.p = a.p + 1 JOIN t ta ON ta.p = a.p JOIN t tb ON tb.p = b.p", "p_total_difference p_observed_difference")
def _(t, spark):
    return _drift(t).categorical_adjacent.select("left_period_index", "level", "left_n", "right_n", "p_total_difference", "p_observed_difference", "level_status")


@register("drift_temporal", _YEARS_SQL + ", m AS (SELECT p, epoch(min(o_orderdate))::DOUBLE AS lo, epoch(max(o_orderdate))::DOUBLE AS hi FROM y GROUP BY 1) SELECT a.p::INT AS left_period_index, b.lo - a.lo AS min_shift, b.hi - a.hi AS max_shift, (b.hi - b.lo) - (a.hi - a.lo) AS range_change, 'seconds' AS unit FROM m a JOIN m b ON b.p = a.p + 1", "min_shift max_shift range_change")
def _(t, spark):
    return _drift(t).temporal_adjacent.select("left_period_index", "min_shift", "max_shift", "range_change", "unit")


STATES = spec_of(("o_orderpriority", "categorical", "1-URGENT;2-HIGH;3-MEDIUM", "5-LOW"), ("o_orderstatus", "categorical", "F;O;P"))
_STATES_SQL = _YEARS_SQL + ", s AS (SELECT p, o_custkey AS id, count(DISTINCT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END) AS k, min(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END) AS v FROM y GROUP BY ALL), j AS (SELECT a.p, a.k AS k0, b.k AS k1, a.v AS v0, b.v AS v1 FROM s a JOIN s b ON b.id = a.id AND b.p = a.p + 1) "


def _transitions(t):
    return longitudinal_transitions(_years(t), "o_custkey", STATES, ["o_orderpriority", "o_orderstatus"])


@register("transition_states", _STATES_SQL + "SELECT p::INT AS period_index, count(*) AS n_valid_entities, count(*) FILTER (k = 1) AS n_usable_state, count(*) FILTER (k = 0) AS n_missing_state, count(*) FILTER (k > 1) AS n_conflicting_state FROM s GROUP BY p")
def _(t, spark):
    return _transitions(t).state_audit.where("variable = 'o_orderpriority'").select("period_index", "n_valid_entities", "n_usable_state", "n_missing_state", "n_conflicting_state")


@register("transition_summary", _STATES_SQL + "SELECT p::INT AS left_period_index, count(*) AS n_retained, count(*) FILTER (k0 = 1 AND k1 = 1) AS n_eligible, count(*) FILTER (k0 < 2 AND k1 < 2 AND (k0 = 0 OR k1 = 0)) AS n_excluded_missing, count(*) FILTER (k0 > 1 OR k1 > 1) AS n_excluded_conflict, 16 AS n_transition_cells FROM j GROUP BY p")
def _(t, spark):
    return _transitions(t).transition_summary.where("variable = 'o_orderpriority'").select("left_period_index", "n_retained", "n_eligible", "n_excluded_missing", "n_excluded_conflict", "n_transition_cells")


@register("transition_counts", _STATES_SQL + ", l AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED']) AS v), ok AS (SELECT * FROM j WHERE k0 = 1 AND k1 = 1) SELECT q.p::INT AS left_period_index, a.v AS from_state, b.v AS to_state, (SELECT count(*) FROM ok WHERE ok.p = q.p AND v0 = a.v AND v1 = b.v) AS n, q.n AS eligible_denominator, (SELECT count(*) FROM ok WHERE ok.p = q.p AND v0 = a.v AND v1 = b.v)::DOUBLE / q.n AS proportion, a.v = '4-NOT SPECIFIED' AS from_is_unexpected FROM (SELECT p, count(*) AS n FROM ok GROUP BY 1) q CROSS JOIN l a CROSS JOIN l b", "proportion")
def _(t, spark):
    return _transitions(t).transition_counts.where("variable = 'o_orderpriority'").select("left_period_index", "from_state", "to_state", "n", "eligible_denominator", "proportion", "from_is_unexpected")


# A panel: users by week, the value of one kind of event.
_WEEKS = ["w1", "w2", "w3", "w4", "w5"]
_PANEL_SQL = "WITH r AS (SELECT user_id AS id, 1 + (datediff('day', DATE '2024-01-01', ts::DATE) // 7) AS t, CASE WHEN value < 150 THEN value END AS v FROM events), c AS (SELECT id, t, count(*) AS rows, count(DISTINCT v) AS k, min(v) AS x FROM r GROUP BY ALL), p AS (SELECT id, count(*) AS k, min(t) AS a, max(t) AS b, max(rows) AS m FROM c GROUP BY 1) "


def _panel(t):
    rows = t("events").select("user_id", F.concat(F.lit("w"), (1 + F.floor(F.datediff("ts", F.lit(dt.date(2024, 1, 1))) / 7)).cast("string")).alias("week"), F.when(F.col("value") < 150, F.col("value")).alias("value"))
    return longitudinal_panel(rows, spec_of(("user_id", "integer", "", "", "id"), ("week", "categorical", ";".join(_WEEKS)), ("value", "numeric")), "user_id", "week")


@register("panel_structure", _PANEL_SQL + "SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FROM p) AS n_valid_entities, (SELECT count(*) FROM c) AS n_observed_id_time_cells, (SELECT count(*) FROM c WHERE rows > 1) AS n_duplicate_cells, (SELECT sum(rows - 1) FROM c)::BIGINT AS n_duplicate_excess, (SELECT max(rows) FROM c) AS max_rows_per_cell, (SELECT count(*) FROM p WHERE m > 1) AS n_entities_with_duplicate_cell, (SELECT count(*) * 5 FROM p) AS n_expected_cells, (SELECT count(*) FROM p WHERE k = 5) AS n_complete_entities")
def _(t, spark):
    return _panel(t).structure.select("n_rows", "n_valid_entities", "n_observed_id_time_cells", "n_duplicate_cells", "n_duplicate_excess", "max_rows_per_cell", "n_entities_with_duplicate_cell", "n_expected_cells", "n_complete_entities")


@register("panel_timepoints", _PANEL_SQL + "SELECT t::INT AS time_index, sum(rows)::BIGINT AS n_rows, count(*) AS n_entities, count(*) FILTER (t = a) AS n_first_observed, count(*) FILTER (t = b) AS n_last_observed, CASE WHEN t > 1 THEN count(*) FILTER (EXISTS (SELECT 1 FROM c q WHERE q.id = c.id AND q.t = c.t - 1)) END AS n_retained, CASE WHEN t > 1 THEN count(*) FILTER (EXISTS (SELECT 1 FROM c q WHERE q.id = c.id AND q.t = c.t - 1))::DOUBLE / (SELECT count(*) FROM c z WHERE z.t = c.t - 1) END AS p_retained FROM c JOIN p USING (id) GROUP BY t".replace("count(*) FILTER (EXISTS (SELECT 1 FROM c q WHERE q.id = c.id AND q.t = c.t - 1))", "sum(f)").replace("FROM c JOIN p USING (id) GROUP BY t", "FROM (SELECT c.*, p.a, p.b, (EXISTS (SELECT 1 FROM c q WHERE q.id = c.id AND q.t = c.t - 1))::BIGINT AS f FROM c JOIN p USING (id)) c GROUP BY t").replace("CASE WHEN t > 1 THEN sum(f) END", "CASE WHEN t > 1 THEN sum(f)::BIGINT END"), "p_retained")
def _(t, spark):
    return _panel(t).timepoints.select("time_index", "n_rows", "n_entities", "n_first_observed", "n_last_observed", "n_retained", "p_retained")


@register("panel_gaps", _PANEL_SQL + "SELECT f AS has_gap, (SELECT count(*) FROM p WHERE (b - a + 1 > k AND k >= 2) = f) AS n_entities FROM (SELECT unnest([false, true]) AS f)")
def _(t, spark):
    return _panel(t).gap_status


@register("panel_missingness", _PANEL_SQL + "SELECT t::INT AS time_index, count(*) AS n_present_entities, count(*) FILTER (k = 1) AS n_usable, count(*) FILTER (k = 0) AS n_missing, count(*) FILTER (k > 1) AS n_conflicting, count(*) FILTER (k = 1)::DOUBLE / count(*) AS p_usable FROM c GROUP BY t", "p_usable")
def _(t, spark):
    return _panel(t).missing_by_time.select("time_index", "n_present_entities", "n_usable", "n_missing", "n_conflicting", "p_usable")


@register("panel_observation_count", _PANEL_SQL + "SELECT g.t::INT AS n_timepoints_observed, count(p.id) AS n_entities FROM range(1, 6) g(t) LEFT JOIN p ON p.k = g.t GROUP BY 1")
def _(t, spark):
    return _panel(t).observation_count


@register("panel_entity_summary", _PANEL_SQL + ", e AS (SELECT id, count(*) FILTER (k = 1) AS u, count(*) AS n FROM c GROUP BY id) SELECT 1 AS variable_index, 'value' AS variable, count(*) AS n_valid_entities, count(*) FILTER (u = 0) AS n_never_observed, count(*) FILTER (u > 0) AS n_observed_at_least_once, count(*) FILTER (u = n) AS n_complete_among_present, count(*) FILTER (u <> n) AS n_incomplete_among_present FROM e")
def _(t, spark):
    return _panel(t).entity_summary


@register("panel_distribution", _PANEL_SQL + ", e AS (SELECT id, count(*) FILTER (k = 1) AS u FROM c GROUP BY id) SELECT 1 AS variable_index, 'value' AS variable, g.t::INT AS n_usable_measurements, count(e.id) AS n_entities FROM range(0, 6) g(t) LEFT JOIN e ON e.u = g.t GROUP BY ALL")
def _(t, spark):
    return _panel(t).measurement_distribution


@register("panel_change_first_last", _PANEL_SQL + """, f AS (SELECT p.id, p.k AS n, a.k AS k0, a.x AS x0, b.k AS k1, b.x AS x1 FROM p JOIN c a ON a.id = p.id AND a.t = p.a JOIN c b ON b.id = p.id AND b.t = p.b)
SELECT 'value' AS variable, count(*) AS n_entities_with_presence, count(*) FILTER (n = 1) AS n_excluded_single_timepoint, count(*) FILTER (n > 1) AS n_present_both, count(*) FILTER (n > 1 AND k0 = 1 AND k1 = 1) AS n_eligible, count(*) FILTER (n > 1 AND (k0 > 1 OR k1 > 1)) AS n_excluded_conflict,
  count(*) FILTER (n > 1 AND k0 < 2 AND k1 < 2 AND (k0 = 0 OR k1 = 0)) AS n_excluded_missing, round(avg(x1 - x0) FILTER (n > 1 AND k0 = 1 AND k1 = 1), 6) AS mean, round(median(x1 - x0) FILTER (n > 1 AND k0 = 1 AND k1 = 1), 6) AS median FROM f""", "mean median")
def _(t, spark):
    one = _panel(t).change_first_to_last
    return one.select("variable", "n_entities_with_presence", "n_excluded_single_timepoint", "n_present_both", "n_eligible", "n_excluded_conflict", "n_excluded_missing", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@register("panel_issues", _PANEL_SQL + "SELECT 'duplicate_id_time' AS issue_code, NULL::INT AS time_index, count(*) AS n_affected FROM c WHERE rows > 1 HAVING count(*) > 0 UNION ALL SELECT 'conflicting_variable_cell', t::INT, count(*) FROM c WHERE k > 1 GROUP BY t UNION ALL SELECT 'missing_time', NULL, count(*) FROM r WHERE t NOT BETWEEN 1 AND 5 HAVING count(*) > 0")
def _(t, spark):
    return _panel(t).issues.select("issue_code", "time_index", "n_affected")


@register("panel_change", _PANEL_SQL + ", j AS (SELECT a.t, a.k AS k0, b.k AS k1, b.x - a.x AS d FROM c a JOIN c b ON b.id = a.id AND b.t = a.t + 1), e AS (SELECT t, count(*) AS n, avg(d) AS mean, median(d) AS med, stddev_samp(d) AS sd FROM j WHERE k0 = 1 AND k1 = 1 GROUP BY t) SELECT g.t::INT AS from_time_index, coalesce(z.n, 0) AS n_present_both, coalesce(e.n, 0) AS n_eligible, coalesce(z.co, 0) AS n_excluded_conflict, coalesce(z.mi, 0) AS n_excluded_missing, round(mean, 6) AS mean, round(med, 6) AS median, round(sd, 6) AS sd FROM range(1, 5) g(t) LEFT JOIN (SELECT t, count(*) AS n, count(*) FILTER (k0 > 1 OR k1 > 1) AS co, count(*) FILTER (k0 < 2 AND k1 < 2 AND (k0 = 0 OR k1 = 0)) AS mi FROM j GROUP BY t) z ON z.t = g.t LEFT JOIN e ON e.t = g.t", "mean median sd")
def _(t, spark):
    return _panel(t).change_adjacent.select("from_time_index", "n_present_both", "n_eligible", "n_excluded_conflict", "n_excluded_missing", *[F.round(c, 6).alias(c) for c in ("mean", "median", "sd")])


# Linkage: customers against a copy with other spellings.
LINKAGE = linkage.LinkageSpec(
    "id", "key", (linkage.Block(1, "nation", "nation"), linkage.Block(1, "segment", "segment"), linkage.Block(2, "name", "label", "fold")),
    (linkage.Comparison("name", "name", "label", "jaro", 0.9, "fold", 0.9, 0.1), linkage.Comparison("balance", "balance", "money", "numeric_tolerance", 1.0, None, 0.95, 0.01), linkage.Comparison("segment", "segment", "segment", "exact", None, None, 0.98, 0.2), linkage.Comparison("words", "name", "label", "token_jaccard", 0.5, "fold", 0.9, 0.3)),
    {"fold": TextProfile()}, prevalence=0.01, nonmatch_max=0.2, match_min=0.9,
)
_LINK_SQL = """
WITH x AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance, trim(regexp_replace(lower(c_name), '#', ' ', 'g')) AS name FROM customer),
y AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0.5 END AS money, trim(regexp_replace(lower(CASE WHEN c_custkey % 4 = 0 THEN replace(c_name, 'Customer', 'Custmer') ELSE upper(c_name) END), '#', ' ', 'g')) AS label FROM customer),
c AS (SELECT xi, yi, min(pass) AS pass FROM (SELECT x.i AS xi, y.i AS yi, 1 AS pass FROM x JOIN y USING (nation, segment) UNION ALL SELECT x.i, y.i, 2 FROM x JOIN y ON x.name = y.label) GROUP BY ALL),
e AS (SELECT xi, yi, jaro_similarity(name, label) AS s1, (abs(balance - money) <= 1)::INT::DOUBLE AS s2, (x.segment = y.segment)::INT::DOUBLE AS s3, len(list_intersect(string_split(name, ' '), string_split(label, ' ')))::DOUBLE / len(list_distinct(string_split(name, ' ') || string_split(label, ' '))) AS s4 FROM c JOIN x ON x.i = xi JOIN y ON y.i = yi),
w AS (SELECT *, CASE WHEN s1 >= 0.9 THEN log2(0.9 / 0.1) ELSE log2(0.1 / 0.9) END + CASE WHEN s2 >= 1 THEN log2(0.95 / 0.01) ELSE log2(0.05 / 0.99) END + CASE WHEN s3 >= 1 THEN log2(0.98 / 0.2) ELSE log2(0.02 / 0.8) END + CASE WHEN s4 >= 0.5 THEN log2(0.9 / 0.3) ELSE log2(0.1 / 0.7) END AS weight FROM e),
p AS (SELECT *, 1 / (1 + exp(-(ln(0.01 / 0.99) + weight * ln(2)))) AS posterior FROM w)
"""


def _link(t):
    c = t("customer")
    x = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    label = F.when(F.col("c_custkey") % 4 == 0, F.replace("c_name", F.lit("Customer"), F.lit("Custmer"))).otherwise(F.upper("c_name"))
    y = c.select(F.col("c_custkey").alias("key"), label.alias("label"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") + F.when(F.col("c_custkey") % 3 == 0, 2.0).otherwise(0.5)).alias("money"))
    return linkage.link(x, y, LINKAGE)


@register("linkage_candidates", _LINK_SQL + "SELECT (SELECT count(*) FROM x) AS n_x, (SELECT count(*) FROM y) AS n_y, (SELECT count(*) FROM x) * (SELECT count(*) FROM y) AS n_possible, (SELECT count(*) FROM c) AS n_candidates, (SELECT count(*) FROM x) * (SELECT count(*) FROM y) - (SELECT count(*) FROM c) AS reduction_n, 1 - (SELECT count(*) FROM c)::DOUBLE / ((SELECT count(*) FROM x) * (SELECT count(*) FROM y)) AS reduction_ratio", "reduction_ratio")
def _(t, spark):
    return _link(t).candidates.overall


@register("linkage_evidence", _LINK_SQL + "SELECT xi AS x_index, yi AS y_index, unnest(['name', 'balance', 'segment', 'words']) AS comparison, unnest([s1, s2, s3, s4]) AS similarity, CASE WHEN unnest([s1 >= 0.9, s2 >= 1, s3 >= 1, s4 >= 0.5]) THEN 'agree' ELSE 'disagree' END AS comparison_state FROM e", "similarity")
def _(t, spark):
    return _link(t).evidence.select("x_index", "y_index", "comparison", "similarity", "comparison_state")


@register("linkage_scores", _LINK_SQL + "SELECT xi AS x_index, yi AS y_index, (s1 >= 0.9)::BIGINT + (s2 >= 1)::BIGINT + (s3 >= 1)::BIGINT + (s4 >= 0.5)::BIGINT AS n_agree, 4 - ((s1 >= 0.9)::BIGINT + (s2 >= 1)::BIGINT + (s3 >= 1)::BIGINT + (s4 >= 0.5)::BIGINT) AS n_disagree, 0::BIGINT AS n_missing, weight AS linkage_weight, posterior AS model_posterior FROM p", "linkage_weight model_posterior")
def _(t, spark):
    return _link(t).scores


@register("linkage_decisions", _LINK_SQL + "SELECT xi AS x_index, yi AS y_index, CASE WHEN posterior >= 0.9 THEN 'match' WHEN posterior <= 0.2 THEN 'non_match' ELSE 'review' END AS decision FROM p")
def _(t, spark):
    return _link(t).decisions


@register("linkage_validation", _LINK_SQL + ", t AS (SELECT x.i AS xi, y.i AS yi, x.c_custkey = y.c_custkey AS m FROM x CROSS JOIN y), d AS (SELECT t.*, p.xi IS NOT NULL AS c, CASE WHEN posterior >= 0.9 THEN 'match' WHEN posterior > 0.2 THEN 'review' ELSE 'non_match' END AS k FROM t LEFT JOIN p USING (xi, yi)) SELECT count(*) FILTER (m AND c) AS candidate_recall_numerator, count(*) FILTER (m) AS candidate_recall_denominator, count(*) FILTER (m AND k = 'match') AS precision_numerator, count(*) FILTER (k = 'match') AS precision_denominator, count(*) FILTER (m AND k = 'non_match') AS missed_match_n, count(*) FILTER (k = 'review') AS review_n FROM d")
def _(t, spark):
    r = _link(t)
    p = r.candidates.prepared
    matches = p.x.select(F.col("i").alias("x_index"), "id").join(p.y.select(F.col("i").alias("y_index"), "id"), "id")
    return linkage.validate_matches(r, matches).select("candidate_recall_numerator", "candidate_recall_denominator", "precision_numerator", "precision_denominator", "missed_match_n", "review_n")


# Identity: nation keys in three tables, supplier names as aliases.
def _universe(t):
    return identity_universe({"customer": (t("customer"), "c_nationkey"), "supplier": (t("supplier"), "s_nationkey"), "nation": (t("nation"), "n_nationkey")}, "nation")


_UNI = "WITH u AS (SELECT 'customer' AS source, c_nationkey AS id FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier UNION ALL SELECT 'nation', n_nationkey FROM nation), k AS (SELECT source, id, count(*) AS c FROM u GROUP BY ALL) "


@register("universe_sources", _UNI + "SELECT source, 'nation' AS identity_namespace, sum(c)::BIGINT AS n_input, 0::BIGINT AS n_null, 0::BIGINT AS n_blank, 0::BIGINT AS n_invalid, sum(c)::BIGINT AS n_observed, count(*) AS n_distinct, sum(c - 1)::BIGINT AS n_duplicate_excess, max(c) AS max_frequency, CASE WHEN sum(c - 1) > 0 THEN 'warning' ELSE 'ready' END AS status FROM k GROUP BY source")
def _(t, spark):
    return _universe(t).source_audit


@register("universe_overlap", _UNI + ", s AS (SELECT source, count(*) AS n FROM k GROUP BY 1), q AS (SELECT * FROM (VALUES ('customer', 'supplier'), ('customer', 'nation'), ('supplier', 'nation')) v(l, r)) SELECT l AS left_source, r AS right_source, a.n AS n_left_distinct, b.n AS n_right_distinct, (SELECT count(*) FROM k x JOIN k y ON x.id = y.id WHERE x.source = l AND y.source = r) AS n_intersection FROM q JOIN s a ON a.source = l JOIN s b ON b.source = r")
def _(t, spark):
    return _universe(t).overlap_audit.select("left_source", "right_source", "n_left_distinct", "n_right_distinct", "n_intersection")


@register("universe_namespace", _UNI + ", m AS (SELECT id, count(*) AS s FROM k GROUP BY 1) SELECT 'nation' AS identity_namespace, 3 AS n_sources, (SELECT count(*) FROM u) AS n_input, count(*) AS n_distinct, count(*) FILTER (s = 1) AS n_single_source, count(*) FILTER (s > 1) AS n_multi_source FROM m")
def _(t, spark):
    return _universe(t).namespace_audit.select("identity_namespace", "n_sources", "n_input", "n_distinct", "n_single_source", "n_multi_source")


@register("alias_mapping", "WITH p AS (SELECT s_name AS a, s_nationkey AS c, count(*) AS k FROM supplier GROUP BY ALL) SELECT sum(k)::BIGINT AS n_pair_rows, count(DISTINCT a) AS n_distinct_alias, count(DISTINCT c) AS n_distinct_canonical, count(*) AS n_distinct_pairs, sum(k - 1)::BIGINT AS n_duplicate_pairs, (SELECT count(*) FROM (SELECT a FROM p GROUP BY a HAVING count(*) > 1)) AS n_alias_conflicts, (SELECT count(*) FROM (SELECT c FROM p GROUP BY c HAVING count(*) > 1)) AS n_canonical_conflicts FROM p")
def _(t, spark):
    return alias_crosswalk({"supplier": (t("supplier"), "s_name", "s_nationkey")}).mapping_audit


@register("pseudonym_audit", "SELECT 'customer' AS source, (SELECT count(*) FROM customer) AS n_rows, 0::BIGINT AS n_invalid_ids, 0::BIGINT AS n_unmatched, 0::BIGINT AS n_exact_duplicates, NULL::BIGINT AS n_conflicting_keys UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 0, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), (SELECT sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey, o_orderstatus)), (SELECT count(*) FROM (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT (o_custkey, o_orderstatus)) > 1))")
def _(t, spark):
    known = spark.createDataFrame([], "identity_namespace string, source_id string, entity_token string")
    return pseudonym_audit({"customer": LinkedTable(t("customer"), "c_custkey", ("c_name",), can_enrol=True), "orders": LinkedTable(t("orders"), "o_custkey", ("o_orderstatus",), ("o_orderpriority",))}, "customer", known)[0]


@register("inventory_columns", "SELECT 'main' AS schema_name, * FROM (VALUES ('nation', 'n_nationkey', 1, 'int', true), ('nation', 'n_name', 2, 'string', true), ('nation', 'n_regionkey', 3, 'int', true), ('region', 'r_regionkey', 1, 'int', true), ('region', 'r_name', 2, 'string', true)) x(table_name, column_name, ordinal, data_type, is_nullable)")
def _(t, spark):
    return inventory({"nation": t("nation"), "region": t("region")})["columns"]


@register("dictionary_refresh", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 'current'), ('nation', 'n_name', 'current'), ('nation', 'n_regionkey', 'modified'), ('nation', 'n_comment', 'added'), ('region', 'r_regionkey', 'removed'), ('region', 'r_name', 'removed')) x(table_name, column_name, drift_status)")
def _(t, spark):
    old = dictionary_scaffold(inventory({"nation": t("nation"), "region": t("region")})["columns"])
    new = inventory({"nation": t("nation").withColumn("n_regionkey", F.col("n_regionkey").cast("long")).withColumn("n_comment", F.lit(""))})["columns"]
    return dictionary_refresh(old, new).select("table_name", "column_name", "drift_status")


@register("windowed_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n, 0::BIGINT AS value_n_missing, round(sum(value), 4) AS value_sum FROM events GROUP BY 1", "value_sum")
def _(t, spark):
    return windowed_counts(t("events"), "ts", ["value"], "1 day").withColumn("value_sum", F.round("value_sum", 4))


def _unit(i: int) -> str:
    return f"(('0x' || substr(md5('1:{i}:' || id::VARCHAR), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r}::DOUBLE)"


@register("synthetic_data", "SELECT " + ", ".join([
    *(f"{_unit(i)} * 100 AS {c}" for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])), f"floor({_unit(4)} * 101)::BIGINT AS l_linenumber", f"['A', 'N', 'X'][floor({_unit(5)} * 3)::INT + 1] AS l_returnflag", f"['F', 'O'][floor({_unit(6)} * 2)::INT + 1] AS l_linestatus",
    f"TIMESTAMP '2000-01-01' + INTERVAL 1 SECOND * floor({_unit(7)} * {366 * 86_400})::BIGINT AS l_shipdate",
]) + " FROM range(0, 1000) x(id)", "l_quantity l_extendedprice l_discount l_tax")
def _(t, spark):
    made = synthetic_data(spark, LINES, 1000, 1)
    return made.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))


@register("population_issues", "WITH k AS (SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS c FROM orders GROUP BY ALL) SELECT (y - " + str(YEARS[0]) + " + 1)::INT AS period_index, y::VARCHAR AS period_label, 'duplicate_record_key' AS issue_code, 'warning' AS severity, 'o_orderpriority' AS field, sum(c - 1)::BIGINT AS n_affected FROM k GROUP BY y HAVING sum(c - 1) > 0")
def _(t, spark):
    found = population_qc(_years(t), "o_custkey", ["o_orderpriority"]).issues
    return found.select("period_index", "period_label", "issue_code", "severity", "field", "n_affected")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric summaries of line items by return flag, for every group and all together."""
    spec = spec_of(("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_returnflag", "categorical", "A;N;R"))
    out = profile_stratified(table(spark, sf_dir, "lineitem"), spec, "l_returnflag").numeric
    return tidy(out.select("group_id", "name", "n", "n_missing", "n_finite", "mean", "sd", "q1", "median", "q3", "lower_fence", "upper_fence", "n_below_lower", "n_above_upper"))
