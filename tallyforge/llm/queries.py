"""One query for each operator, over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dartminhash, exactdup, langid, licenses, mixing, ordermin, packing, rlzdup, urlfilter, warc
from .shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def document_path() -> F.Column:
    """Documents have no file names: their place is source, language and id."""
    return F.concat_ws("/", "source", "lang", "doc_id")


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), path=document_path())


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn(table(spark, sf_dir, "documents"), columns=["doc_id", "source"])


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.owners(table(spark, sf_dir, "documents"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.scored(table(spark, sf_dir, "pages"), columns=["page_id", "url"])


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(table(spark, sf_dir, "documents"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlzdup.duplicate_spans(table(spark, sf_dir, "documents"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train_profiles(docs), columns=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_dictionary_writer": _warc,
    "op2_sum_of_squares_packing": _packing,
    "op3_license_scan": _licenses,
    "op4_pareto_mixing": _mixing,
    "op5_exact_dedup_trie": _exact,
    "op6_url_filter": _urls,
    "op7_order_minhash": _fingerprints,
    "op8_relative_lz_dedup": _spans,
    "op9_dart_minhash": _near,
    "op10_language_id": _languages,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{wording.replace(chr(39), chr(39) * 2)}')" for i, (name, wording) in enumerate(licenses.TEMPLATES))

_LICENSES = rf"""
WITH templates(t, license, wording) AS (VALUES {_TEMPLATE_ROWS}),
template_words AS (
  SELECT t, license, w, count(*) AS tf FROM (
    SELECT t, license, unnest(regexp_extract_all(translate(wording, '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS w FROM templates) GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, translate(text, '{_UPPER}', '{_LOWER}') AS body,
  regexp_replace(nullif(regexp_extract(text, '{licenses.SPDX}', 1), ''), '-(only|or-later)$', '') AS tag FROM documents),
size AS (SELECT count(body) AS n FROM docs),
segments AS (
  SELECT r, 'line' AS kind, i AS part, regexp_extract_all(line, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws
  FROM (SELECT r, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS i FROM docs)
  UNION ALL SELECT r, 'whole', 0, regexp_extract_all(body, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') FROM docs WHERE body IS NOT NULL),
counts AS (SELECT r, kind, part, w, count(*) AS tf FROM (SELECT r, kind, part, unnest(ws) AS w FROM segments) GROUP BY ALL),
df AS (SELECT w, count(DISTINCT r) AS df FROM counts WHERE kind = 'whole' AND w IN (SELECT w FROM template_words) GROUP BY w),
idf AS (
  SELECT v.w, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT w FROM template_words) v CROSS JOIN size LEFT JOIN df ON df.w = v.w),
norms AS (
  SELECT r, kind, part, sqrt(sum(pow(tf * coalesce(idf, ln((1 + n)::DOUBLE) + 1), 2))) AS norm
  FROM counts CROSS JOIN size LEFT JOIN idf USING (w) GROUP BY r, kind, part),
template_norms AS (SELECT t, sqrt(sum(pow(tf * idf, 2))) AS norm FROM template_words JOIN idf USING (w) GROUP BY t),
scores AS (
  SELECT c.r, c.kind, c.part, tw.license, round(sum(c.tf * idf * tw.tf * idf) / any_value(s.norm) / any_value(tn.norm), 9) AS score
  FROM (SELECT * FROM counts WHERE kind = 'line') c JOIN idf USING (w) JOIN template_words tw ON tw.w = c.w JOIN norms s ON (s.r, s.kind, s.part) = (c.r, c.kind, c.part) JOIN template_norms tn ON tn.t = tw.t
  GROUP BY c.r, c.kind, c.part, tw.t, tw.license),
best AS (SELECT r, license, score FROM scores WHERE score >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license) = 1),
own AS (
  SELECT d.r, d.doc_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS dir,
    coalesce(tag, l.license) AS license, CASE WHEN tag IS NOT NULL THEN 1 ELSE l.score END AS score,
    CASE WHEN coalesce(tag, l.license) IS NOT NULL THEN CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$') THEN 'file' ELSE 'header' END END AS how
  FROM docs d LEFT JOIN best l ON l.r = d.r),
licensed AS (SELECT dir AS up, license, score FROM own WHERE how = 'file' AND dir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
above AS (
  SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS up
  FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM own WHERE dir IS NOT NULL))),
nearest AS (SELECT dir, above.up, license, score FROM above JOIN licensed ON licensed.up = above.up QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT doc_id, coalesce(own.license, nearest.license) AS license, coalesce(how, CASE WHEN nearest.license IS NOT NULL THEN 'inherited' END, 'none') AS how,
  round(CASE WHEN own.license IS NOT NULL THEN own.score ELSE nearest.score END, 4) AS score, CASE WHEN own.license IS NULL THEN nearest.up END AS license_dir
FROM own LEFT JOIN nearest ON nearest.dir = own.dir"""

_MIXING = f"""
WITH base AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 WHEN length(text) = 0 THEN 1 ELSE length(bin(length(text))) END AS a FROM documents),
sums AS (SELECT source, sum(a)::BIGINT AS measure, CASE WHEN sum(a) > 0 THEN sqrt(sum(a)::DOUBLE) ELSE 0 END AS weight FROM base GROUP BY source),
total AS (SELECT count(*) AS n, (SELECT sum(weight) FROM sums) AS w FROM base),
shares AS (SELECT source, measure, weight > 0 AS has, floor(weight * n / w)::BIGINT AS low, weight * n / w - floor(weight * n / w) AS part FROM sums, total),
targets AS (
  SELECT source, measure, low + CASE WHEN has AND row_number() OVER (ORDER BY has DESC, part DESC, source NULLS FIRST) <= (SELECT n FROM total) - (SELECT sum(low) FROM shares) THEN 1 ELSE 0 END AS target FROM shares),
expected AS (
  SELECT b.doc_id, b.source, a, target, CASE WHEN measure > 0 THEN target::DOUBLE * a::DOUBLE / measure::DOUBLE ELSE 0 END AS e,
    (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE AS u
  FROM base b JOIN targets t ON t.source IS NOT DISTINCT FROM b.source),
ranked AS (
  SELECT *, floor(e)::BIGINT AS whole, CASE WHEN e > floor(e) THEN u / (1 - u) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM expected),
counted AS (
  SELECT *, target - sum(whole) OVER (PARTITION BY source) AS size, CASE WHEN q IS NOT NULL THEN row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, a) END AS k FROM ranked)
SELECT doc_id, source, whole, coalesce(k <= size, false)::BIGINT AS sampled, whole + coalesce(k <= size, false)::BIGINT AS copies
FROM counted WHERE whole + coalesce(k <= size, false)::BIGINT > 0"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": _LICENSES,
    "op4_pareto_mixing": _MIXING,
    "op5_exact_dedup_trie": """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS owner_id,
  text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS is_owner
FROM documents""",
}
