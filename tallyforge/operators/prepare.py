"""Preparation of a table under its specification, civil dates, and synthetic data."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import is_missing, quoted, text_form
from ..spec import Spec, SpecError, Variable, storage_family
from .quality import check_keys

AUDIT = "name string, stage string, declared_type string, observed_class_before string, observed_class_after string, action string, status string, n_total long, n_standard_missing long, n_sentinel_missing long, n_invalid long, n_unexpected long, n_affected long, n_changed long, reason string"
INT32 = 2_147_483_647
_LOCAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


class Blocked(SpecError):
    """Preparation was refused: the audit has blocking rows, and nothing was changed."""


def local_instant(column: Column, zone: str) -> Column:
    """Wall times of a zone as UTC instants; null for times that the zone skips or has twice."""

    @F.pandas_udf(T.TimestampType())
    def run(s: pd.Series) -> pd.Series:
        tz, out = ZoneInfo(zone), []
        for x in s:
            t = None
            if x is not None and x == x and re.match(_LOCAL, x):
                try:
                    wall = dt.datetime.fromisoformat(x)
                    a, b = wall.replace(tzinfo=tz), wall.replace(tzinfo=tz, fold=1)
                    # A skipped time does not survive the way to UTC and back; a doubled one has two offsets.
                    if a.utcoffset() == b.utcoffset() and a.astimezone(dt.UTC).astimezone(tz).replace(tzinfo=None) == wall:
                        t = a.astimezone(dt.UTC)
                except ValueError:
                    t = None
            out.append(t)
        return pd.Series(pd.to_datetime(out, utc=True))

    return run(column)


def offset_instant(x: Column) -> Column:
    """Text with Z or an offset of at most 14 hours as an instant; null for anything else."""
    hours = F.regexp_extract(x, r"[+-](\d{2}):(\d{2})$", 1)
    minutes = F.regexp_extract(x, r"[+-](\d{2}):(\d{2})$", 2)
    fits = (hours == "") | ((hours < "14") & (minutes < "60")) | ((hours == "14") & (minutes == "00"))
    return F.when(x.rlike(_OFFSET) & fits, F.try_to_timestamp(x))


def iso_date(x: Column) -> Column:
    """Strict YYYY-MM-DD; null for anything else."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


class _Plan:
    """What is to be done with one column: expressions for the audit and for the result."""

    def __init__(self, v: Variable, dtype: T.DataType | None, unexpected: str):
        self.v, self.dtype, self.family = v, dtype, None if dtype is None else storage_family(dtype)
        self.x = None if dtype is None else quoted(v.name)
        self.action, self.after, self.storage_ok, self.changes = "convert_declared_type", None, False, False
        self.bad: Column = F.lit(False)
        self.unexpected: Column = F.lit(False)
        self.result: Column | None = self.x
        self.levels = list(v.levels)
        if dtype is None or self.family == "other":
            return
        standard = is_missing(self.x, dtype)
        self.standard = standard
        self.sentinel = is_missing(self.x, dtype, v.missing_codes) & ~standard
        self.rest = ~standard & ~self.sentinel
        kept = F.when(self.rest, self.x)
        kind = v.analysis_type
        before = dtype.simpleString()

        def plan(action: str, after: str, value: Column, bad: Column | None = None, changes: bool = True) -> None:
            self.action, self.after, self.result, self.storage_ok, self.changes = action, after, value, True, changes
            if bad is not None:
                self.bad = self.rest & F.coalesce(bad, F.lit(True))

        if kind == "numeric" and self.family in ("numeric", "integer"):
            plan("convert_integer_to_numeric" if self.family == "integer" else "retain_numeric", "double", kept.cast("double"), changes=self.family == "integer")
        elif kind == "integer" and self.family == "integer":
            plan("retain_integer", before, kept, changes=False)
        elif kind == "integer" and self.family == "numeric":
            d = self.x.cast("double")
            whole = (F.abs(d) <= INT32) & (d == F.floor(d))
            plan("convert_numeric_to_integer", "int", F.when(whole & self.rest, d).cast("int"), ~whole)
        elif kind in ("categorical", "binary") and self.family in ("text", "boolean", "integer", "numeric"):
            if kind == "binary" and self.family == "boolean" and not v.levels:
                plan("retain_logical_binary", before, kept, changes=False)
            else:
                word = text_form(self.x, dtype)
                plan("match_levels", "string", F.when(self.rest, word), changes=self.family != "text")
                if self.levels:
                    self.unexpected = self.rest & ~word.isin(self.levels)
        elif kind == "text" and self.family == "text":
            plan("retain_text", before, kept, changes=False)
        elif kind == "date" and self.family == "date":
            plan("retain_date", before, kept, changes=False)
        elif kind == "date" and self.family == "text":
            plan("parse_iso_date", "date", F.when(self.rest, iso_date(self.x)), iso_date(self.x).isNull())
        elif kind == "datetime" and self.family == "datetime":
            plan("retain_datetime", before, kept, changes=False)
        elif kind == "datetime" and self.family == "text":
            if v.timezone and v.timezone in available_timezones():
                value = F.coalesce(offset_instant(self.x), local_instant(F.when(self.rest, self.x), v.timezone))
            else:
                value = offset_instant(self.x)
            plan("parse_iso_datetime", "timestamp", F.when(self.rest, value), value.isNull())


def prepare(df: DataFrame, spec: Spec, mode: str = "audit", unexpected_levels: str = "error", extra_variables: str = "keep") -> tuple[DataFrame | None, DataFrame]:
    """(prepared table or None, audit).  ``apply`` changes all or nothing: any blocking row raises before a column is touched.

    The audit is one aggregate over all columns.  Duplicate rows are counted with the dataset row.
    """
    if mode not in ("audit", "apply") or unexpected_levels not in ("error", "append") or extra_variables not in ("keep", "error", "drop"):
        raise SpecError("unknown preparation option")
    types = {f.name: f.dataType for f in df.schema.fields}
    plans = [_Plan(v, types.get(v.name), unexpected_levels) for v in spec]
    s = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    live = [p for p in plans if p.dtype is not None and p.family != "other"]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[c for i, p in enumerate(live) for c in (s(p.standard).alias(f"m{i}"), s(p.sentinel).alias(f"c{i}"), s(p.rest).alias(f"r{i}"), s(p.bad).alias(f"b{i}"), s(p.unexpected).alias(f"u{i}"))]).first()
    n, rows = sums["n"], []
    plain = [c for c in df.columns if storage_family(types[c]) != "other"]
    distinct = df.select(*map(quoted, plain)).distinct().count() if plain else min(n, 1)
    rows.append(("", "dataset", "", None, None, "count_duplicates", "warning" if n > distinct else "unchanged", n, None, None, None, None, n - distinct, 0, "rows that repeat an earlier row"))
    for p in plans:
        v = p.v
        if p.dtype is None:
            rows.append((v.name, "presence", v.analysis_type, None, None, "assess_presence", "blocking" if v.required else "skipped", n, None, None, None, None, None, None, "the column is absent and required" if v.required else "the column is absent and is not made"))
            continue
        before = p.dtype.simpleString()
        rows.append((v.name, "presence", v.analysis_type, before, before, "assess_presence", "unchanged", n, 0, 0, 0, 0, 0, 0, "the column is there"))
        if p.family == "other":
            rows.append((v.name, "type", v.analysis_type, before, None, "convert_declared_type", "blocking", n, None, None, n, 0, n, 0, "nested storage can't be converted"))
            continue
        i = live.index(p)
        m, c, r, b, u = (sums[f"{k}{i}"] for k in "mcrbu")
        rows.append((v.name, "missingness", v.analysis_type, before, before, "replace_sentinel_missing" if c else "retain_missingness", "planned" if c else "unchanged", n, m, c, 0, 0, c, c, "declared codes become missing" if c else "no declared code occurs"))
        if not p.storage_ok:
            rows.append((v.name, "type", v.analysis_type, before, None, p.action, "blocking", n, m, c, r, 0, r, 0, "no approved conversion leads from this storage to the declared type"))
        else:
            changed = n if p.changes and not b else 0
            rows.append((v.name, "type", v.analysis_type, before, None if b else p.after, p.action, "blocking" if b else "planned" if p.changes else "unchanged", n, m, c, b, 0, b or changed, changed, "some values can't be converted" if b else "values fit the declared type"))
        if v.timezone and v.analysis_type != "datetime":
            rows.append((v.name, "type", v.analysis_type, before, p.after, "ignore_timezone", "warning", n, m, c, 0, 0, 0, 0, "a time zone means nothing for this type"))
        if v.analysis_type in ("categorical", "binary"):
            grows = unexpected_levels == "append" and v.analysis_type == "categorical"
            status = "unchanged" if not u else "planned" if grows else "blocking"
            rows.append((v.name, "levels", v.analysis_type, before, p.after, "append_unexpected_levels" if u and grows else "assess_levels", status, n, m, c, 0, u, u, 0, "values outside the declared levels" if u else "all values are declared levels"))
    declared = set(spec.names)
    for c in df.columns:
        if c not in declared:
            rows.append((c, "extra", None, types[c].simpleString(), types[c].simpleString() if extra_variables == "keep" else None, f"{extra_variables}_extra_variable", {"keep": "unchanged", "drop": "planned", "error": "blocking"}[extra_variables], n, None, None, None, None, 0, 0, "the column is not in the specification"))
    if mode == "apply":
        rows = [(*r[:6], "applied" if r[6] == "planned" else r[6], *r[7:]) for r in rows]
    audit = df.sparkSession.createDataFrame(rows, AUDIT)
    if mode == "audit":
        return None, audit
    if any(r[6] == "blocking" for r in rows):
        raise Blocked("preparation has blocking findings")
    made = {p.v.name: p.result for p in live}
    columns = [made[c].alias(c) if c in made else quoted(c) for c in df.columns if c in declared or extra_variables == "keep"]
    return df.select(*columns), audit


DATE_FIELDS = {"variable_key", "output_name", "source_type", "operation", "time_policy", "missing_policy", "review_state"}


def civil_date_operations(rows: Iterable[Mapping[str, str]]) -> list[dict[str, str]]:
    """Reviewed operations of exactly seven fields: midnight times become dates, missing stays missing."""
    out = [dict(r) for r in rows]
    for r in out:
        if set(r) != DATE_FIELDS:
            raise SpecError("a civil-date operation has exactly seven fields")
        if (r["operation"], r["missing_policy"], r["time_policy"], r["review_state"]) != ("civil_date", "preserve", "midnight", "approved"):
            raise SpecError("only approved operations on midnight times are carried out")
        if r["source_type"] not in ("local_text", "local_timestamp"):
            raise SpecError("the source of a civil date is local text or a local timestamp")
    names = [r["output_name"] for r in out]
    if not out or len(set(names)) != len(names) or len({r["variable_key"] for r in out}) != len(out):
        raise SpecError("operations must be there, with unique keys and output names")
    return out


def derive_civil_dates(df: DataFrame, operations: list[dict[str, str]], keys: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(table with the dates appended, audit).  One value that is not midnight stops everything; the error tells only how many."""
    by_key = {k: n for n, k in check_keys(keys, keys).items()}
    plans = []
    for o in operations:
        name = by_key.get(o["variable_key"])
        if name not in df.columns or o["output_name"] in df.columns:
            raise SpecError("an operation's source is absent or its output exists")
        x, family = quoted(name), storage_family(df.schema[name].dataType)
        if o["source_type"] == "local_text" and family == "text":
            shaped = x.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$")
            date = F.when(shaped, F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"))
            midnight = date.isNotNull() & F.substring(x, 11, 100).rlike(r"^ 00:00:00(\.0+)?$")
        elif o["source_type"] == "local_timestamp" and family == "local":
            date, midnight = x.cast("date"), F.date_trunc("day", x) == x
        else:
            raise SpecError("the column's storage is not the operation's source type")
        plans.append((o, x, date, x.isNotNull() & ~F.coalesce(midnight, F.lit(False))))
    s = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    got = df.agg(F.count(F.lit(1)).alias("n"), *[e for i, (_, x, _, bad) in enumerate(plans) for e in (s(x.isNull()).alias(f"m{i}"), s(bad).alias(f"b{i}"))]).first()
    off = sum(got[f"b{i}"] for i in range(len(plans)))
    if off:
        raise SpecError(f"{off} values are not midnight times")
    out = df.withColumns({o["output_name"]: date for o, _, date, _ in plans})
    rows = [(o["variable_key"], o["output_name"], got["n"], got[f"m{i}"], got["n"] - got[f"m{i}"], True) for i, (o, *_) in enumerate(plans)]
    return out, df.sparkSession.createDataFrame(rows, "variable_key string, output_name string, n long, n_missing long, n_derived long, reconciled boolean")


def synthetic_data(spark: SparkSession, spec: Spec, n: int = 100, seed: int = 0) -> DataFrame:
    """Rows after the specification: the same ones for the same seed, made in parallel."""
    base = spark.range(n)
    digits = lambda i: F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(i)), F.col("id").cast("string"))), 1, 13)
    unit = lambda i: F.conv(digits(i), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
    out = []
    for i, v in enumerate(spec):
        u = unit(i)
        low, high = (0.0 if v.min is None else v.min), (100.0 if v.max is None else v.max)
        if v.analysis_type == "numeric":
            c = F.lit(low) + u * F.lit(high - low)
        elif v.analysis_type == "integer":
            c = (F.lit(int(low)) + F.floor(u * F.lit(float(int(high) - int(low) + 1)))).cast("long")
        elif v.analysis_type in ("categorical", "binary"):
            levels = v.levels or (("FALSE", "TRUE") if v.analysis_type == "binary" else ("A", "B"))
            c = F.element_at(F.array(*map(F.lit, levels)), (F.floor(u * len(levels)) + 1).cast("int"))
            c = c == "TRUE" if v.database_type == "boolean" else c
        elif v.analysis_type == "date":
            c = F.date_add(F.lit(dt.date(2000, 1, 1)), F.floor(u * 366).cast("int"))
        elif v.analysis_type == "datetime":
            c = F.timestamp_seconds(F.lit(946_684_800) + F.floor(u * (366 * 86_400)))
        else:
            c = F.concat(F.lit(f"{v.name}_synthetic_"), (F.col("id") + 1).cast("string"))
        out.append(c.alias(v.name))
    return base.select(*out)


def inject_missing(df: DataFrame, counts: Mapping[str, int], key: str, seed: int = 0, blanks: Mapping[str, int] | None = None) -> DataFrame:
    """Exactly so many values of each column made null (or, of text, blank), chosen by a hash of key and seed among those that are there."""
    blanks = blanks or {}
    out = df
    for c in dict.fromkeys([*counts, *blanks]):
        x = quoted(c)
        order = [F.when(x.isNull() | (x.cast("string") == ""), 1).otherwise(0), F.xxhash64(quoted(key), F.lit(seed), F.lit(c)), quoted(key)]
        small = out.select(quoted(key).alias("\1k"), *[e.alias(f"\1o{j}") for j, e in enumerate(order)]).where("`\1o0` = 0").orderBy("`\1o1`", "`\1o2`").limit(counts.get(c, 0) + blanks.get(c, 0))
        chosen = small.withColumn("\1r", F.row_number().over(Window.orderBy("`\1o1`", "`\1o2`"))).select("`\1k`", "`\1r`")
        if chosen.count() < counts.get(c, 0) + blanks.get(c, 0):
            raise SpecError("a column has fewer values than are to be made missing")
        hit = F.col("`\1r`")
        out = out.join(chosen, quoted(key) == F.col("`\1k`"), "left").withColumn(c, F.when(hit <= counts.get(c, 0), None).when(hit.isNotNull(), F.lit("") if c in blanks else None).otherwise(x)).drop("\1k", "\1r")
    return out
