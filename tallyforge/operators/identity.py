"""Deterministic identity: universes of identifiers, alias crosswalks, a token registry and pseudonymised tables."""

from __future__ import annotations

import json
import os
import secrets
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import quoted, safe_div
from ..spec import SpecError
from ..storage import materialised

ISSUES = "issue_code string, severity string, source string, n_affected long, message string"


def _classes(x: Column, regex: str | None) -> tuple[Column, Column, Column, Column]:
    """(null, blank, invalid, valid) of an identifier."""
    text = x.cast("string")
    null = x.isNull()
    blank = ~null & (F.trim(text) == "")
    invalid = ~null & ~blank & ~text.rlike(regex) if regex else F.lit(False)
    return null, blank, invalid, ~null & ~blank & ~invalid


@dataclass
class Universe:
    source_audit: DataFrame
    namespace_audit: DataFrame
    overlap_audit: DataFrame
    issues: DataFrame
    members: DataFrame


def identity_universe(sources: dict[str, tuple[DataFrame, str]], namespace: str, validity_regex: str | None = None) -> Universe:
    """Audit of identifiers that several sources share; ``members`` is (identifier, n_sources)."""
    if len(sources) < 2:
        raise SpecError("a universe has at least two sources")
    spark = next(iter(sources.values()))[0].sparkSession
    rows = None
    for i, (df, column) in enumerate(sources.values()):
        null, blank, invalid, valid = _classes(quoted(column), validity_regex)
        state = F.when(null, "null").when(blank, "blank").when(invalid, "invalid").otherwise("valid")
        part = df.select(F.lit(i).alias("s"), state.alias("state"), F.when(valid, quoted(column).cast("string")).alias("id"))
        rows = part if rows is None else rows.unionByName(part)
    counts = materialised(rows.groupBy("s", "state", "id").agg(F.count(F.lit(1)).alias("c")), "universe")
    names = F.broadcast(spark.createDataFrame(list(enumerate(sources)), "s int, source string"))
    held = lambda k: F.coalesce(F.sum(F.when(F.col("state") == k, F.col("c"))), F.lit(0))
    valid = F.col("state") == "valid"
    by = names.join(counts.groupBy("s").agg(F.sum("c").alias("n_input"), held("null").alias("n_null"), held("blank").alias("n_blank"), held("invalid").alias("n_invalid"), held("valid").alias("n_observed"), F.count(F.when(valid, 1)).alias("n_distinct"), F.coalesce(F.max(F.when(valid, F.col("c"))), F.lit(0)).alias("max_frequency")), "s", "left").fillna(0)
    excess = F.col("n_observed") - F.col("n_distinct")
    status = F.when(F.col("n_null") + F.col("n_blank") + F.col("n_invalid") > 0, "error").when((excess > 0) | (F.col("n_input") == 0), "warning").otherwise("ready")
    audit = by.select("s", "source", F.lit(namespace).alias("identity_namespace"), "n_input", "n_null", "n_blank", "n_invalid", "n_observed", "n_distinct", excess.alias("n_duplicate_excess"), "max_frequency", status.alias("status"))
    member = materialised(counts.where(valid).groupBy("id").agg(F.array_sort(F.collect_set("s")).alias("ss")), "universe-members")
    worst = audit.agg(F.sum("n_input").alias("n_input"), F.sum("n_observed").alias("n_observed"), F.max((F.col("status") == "error").cast("int")).alias("e"), F.max((F.col("status") == "warning").cast("int")).alias("w"))
    alone = F.size("ss") == 1
    sizes = member.agg(F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(alone.cast("long")), F.lit(0)).alias("n_single_source"), F.coalesce(F.sum((~alone).cast("long")), F.lit(0)).alias("n_multi_source"))
    # Identifiers are compared as they are, so two can't collide after normalisation.
    space = worst.crossJoin(sizes).select(F.lit(namespace).alias("identity_namespace"), F.lit(len(sources)).alias("n_sources"), "n_input", "n_observed", "n_distinct", "n_single_source", "n_multi_source", F.lit(0).cast("long").alias("n_collisions"), F.when(F.col("e") == 1, "error").when(F.col("w") == 1, "warning").otherwise("ready").alias("status"))
    pairs = member.select(F.explode("ss").alias("l"), "ss").select("l", F.explode("ss").alias("r")).where("l < r").groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: audit.select(F.col("s").alias(s), F.col("source").alias(f"{s}_source"), F.col("n_distinct").alias(f"{s}_n"))
    n, nl, nr = F.coalesce("n", F.lit(0)), F.col("l_n"), F.col("r_n")
    overlap = side("l").crossJoin(side("r")).where("l < r").join(pairs, ["l", "r"], "left").select(F.col("l_source").alias("left_source"), F.col("r_source").alias("right_source"), nl.alias("n_left_distinct"), nr.alias("n_right_distinct"), n.alias("n_intersection"), (nl - n).alias("n_left_exclusive"), (nr - n).alias("n_right_exclusive"), safe_div(n, nl).alias("left_coverage"), safe_div(n, nr).alias("right_coverage"))
    rules = [("null_identifier", "error", "n_null", "identifiers are null"), ("blank_identifier", "error", "n_blank", "identifiers are blank"), ("invalid_identifier", "error", "n_invalid", "identifiers do not match the declared form"), ("duplicate_identifier", "warning", "n_duplicate_excess", "identifiers repeat within a source")]
    issues = audit.select("source", F.explode(F.array(*[F.struct(F.lit(c).alias("issue_code"), F.lit(s).alias("severity"), F.col(k).alias("n_affected"), F.lit(m).alias("message")) for c, s, k, m in rules])).alias("i")).where("i.n_affected > 0").select("i.issue_code", "i.severity", "source", "i.n_affected", "i.message")
    empty = audit.where("n_input = 0").select(F.lit("empty_source").alias("issue_code"), F.lit("warning").alias("severity"), "source", F.lit(0).cast("long").alias("n_affected"), F.lit("the source has no rows").alias("message"))
    return Universe(audit.drop("s"), space, overlap, issues.unionByName(empty), member.select(F.col("id").alias("identifier"), F.size("ss").alias("n_sources")))


@dataclass
class Aliases:
    source_audit: DataFrame
    mapping_audit: DataFrame
    issues: DataFrame
    crosswalk: DataFrame


def alias_crosswalk(pairs: dict[str, tuple[DataFrame, str, str]], validity_regex: str | None = None) -> Aliases:
    """Audit of (alias, canonical) columns; ``crosswalk`` has each exact pair once."""
    audits, valid_pairs = [], []
    for name, (df, a, c) in pairs.items():
        an, ab, ai, av = _classes(quoted(a), validity_regex)
        cn, cb, ci, cv = _classes(quoted(c), validity_regex)
        s = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
        audits.append(df.agg(
            F.count(F.lit(1)).alias("n_input"), s(av & cv).alias("n_both_valid"), s(av & ~cv).alias("n_alias_only"), s(~av & cv).alias("n_canonical_only"), s(~av & ~cv).alias("n_neither_valid"), s(an).alias("n_alias_null"), s(cn).alias("n_canonical_null"), s(ab).alias("n_alias_blank"), s(cb).alias("n_canonical_blank"), s(ai).alias("n_alias_invalid"), s(ci).alias("n_canonical_invalid"),
        ).select(F.lit(name).alias("source"), "*"))
        valid_pairs.append(df.where(av & cv).select(quoted(a).cast("string").alias("alias"), quoted(c).cast("string").alias("canonical")))
    source_audit = reduce(DataFrame.unionByName, audits)
    distinct = materialised(reduce(DataFrame.unionByName, valid_pairs).groupBy("alias", "canonical").agg(F.count(F.lit(1)).alias("c")), "alias-pairs")
    side = lambda k, a, b: distinct.groupBy(k).agg(F.count(F.lit(1)).alias("t")).agg(F.count(F.lit(1)).alias(a), F.coalesce(F.sum((F.col("t") > 1).cast("long")), F.lit(0)).alias(b))
    total = distinct.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_pair_rows"), F.count(F.lit(1)).alias("n_distinct_pairs"))
    mapping = total.crossJoin(side("alias", "n_distinct_alias", "n_alias_conflicts")).crossJoin(side("canonical", "n_distinct_canonical", "n_canonical_conflicts")).select("n_pair_rows", "n_distinct_alias", "n_distinct_canonical", "n_distinct_pairs", (F.col("n_pair_rows") - F.col("n_distinct_pairs")).alias("n_duplicate_pairs"), "n_alias_conflicts", "n_canonical_conflicts")
    rules = [("alias_missing_or_invalid", F.col("n_alias_null") + F.col("n_alias_blank") + F.col("n_alias_invalid"), "alias ids are null, blank or not valid"), ("canonical_missing_or_invalid", F.col("n_canonical_null") + F.col("n_canonical_blank") + F.col("n_canonical_invalid"), "canonical ids are null, blank or not valid"), ("incomplete_identifier_pair", F.col("n_alias_only") + F.col("n_canonical_only"), "only one id of a pair is valid")]
    per_source = source_audit.select("source", F.explode(F.array(*[F.struct(F.lit(c).alias("issue_code"), n.alias("n_affected"), F.lit(m).alias("message")) for c, n, m in rules])).alias("i")).select("i.issue_code", F.lit("error").alias("severity"), "source", "i.n_affected", "i.message")
    whole = mapping.select(F.explode(F.array(*[F.struct(F.lit(c).alias("issue_code"), F.lit(s).alias("severity"), F.lit("").alias("source"), F.col(n).alias("n_affected"), F.lit(m).alias("message")) for c, s, n, m in (("alias_to_many", "error", "n_alias_conflicts", "an alias has several canonical ids"), ("canonical_to_many", "error", "n_canonical_conflicts", "a canonical id has several aliases"), ("duplicate_exact_pair", "warning", "n_duplicate_pairs", "a pair is repeated; it is kept once"))])).alias("i")).select("i.*")
    return Aliases(source_audit, mapping, per_source.unionByName(whole).where("n_affected > 0"), distinct.select("alias", "canonical"))


def new_tokens(n: int, n_bytes: int = 24, prefix: str = "P") -> list[str]:
    """``n`` different random tokens from the system's cryptographic source."""
    if n_bytes < 16:
        raise SpecError("tokens need at least 16 random bytes")
    for _ in range(5):
        out = [f"{prefix}_{secrets.token_hex(n_bytes)}" for _ in range(n)]
        if len(set(out)) == n:
            return out
    raise RuntimeError("tokens collided again and again")


def pseudonym_bridge(ids: DataFrame, column: str, path: str, n_bytes: int = 24, prefix: str = "P") -> DataFrame:
    """(id, token) of unique ids, written once; a path that exists is an error."""
    bad = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(quoted(column)).alias("d")).first()
    if bad["n"] != bad["d"]:
        raise SpecError("ids must be unique and not missing")
    return _tokens(ids.select(quoted(column).cast("string").alias("source_id")), path, n_bytes, prefix)


def _tokens(ids: DataFrame, path: str, n_bytes: int, prefix: str) -> DataFrame:
    """Random tokens made on the executors and fixed by being written: nothing reads them before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(entity_token=new_tokens(len(batch), n_bytes, prefix))

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ids.schema.fields), "entity_token string"])
    ids.mapInPandas(run, schema).write.mode("errorifexists").parquet(path)
    return ids.sparkSession.read.parquet(path)


@dataclass
class Registry:
    """Aliases and their tokens, an append-only folder of Parquet with its settings beside it; one writer at a time."""

    spark: SparkSession
    path: str
    prefix: str = "E"
    n_bytes: int = 24
    batches: list[str] = field(default_factory=list)

    @classmethod
    def init(cls, spark: SparkSession, path: str, prefix: str = "E", n_bytes: int = 24, mode: str = "audit") -> tuple[Registry | None, str]:
        """(registry, state): absent, ready, created or mismatched settings; ``audit`` writes nothing."""
        if n_bytes < 16:
            raise SpecError("tokens need at least 16 random bytes")
        settings = f"{path}/settings.json"
        if os.path.exists(settings):
            with open(settings, encoding="utf-8") as f:
                have = json.load(f)
            if (have["prefix"], have["n_bytes"]) != (prefix, n_bytes):
                return None, "settings_mismatch"
            return cls(spark, path, prefix, n_bytes, have["batches"]), "ready"
        if mode == "audit":
            return None, "absent"
        os.makedirs(path, exist_ok=True)
        out = cls(spark, path, prefix, n_bytes)
        out._save()
        return out, "created"

    def _save(self) -> None:
        partial = f"{self.path}/.settings-{uuid.uuid4().hex}"
        with open(partial, "w", encoding="utf-8") as f:
            json.dump({"version": 1, "prefix": self.prefix, "n_bytes": self.n_bytes, "batches": self.batches}, f)
        os.replace(partial, f"{self.path}/settings.json")

    def aliases(self) -> DataFrame:
        schema = "identity_namespace string, source_id string, entity_token string"
        if not self.batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{b}" for b in self.batches])

    def enrol(self, ids: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
        """All aliases after tokens for ids (identity_namespace, source_id) that have none; a crosswalk's alias shares its canonical token."""
        known = self.aliases()
        keys = ["identity_namespace", "source_id"]
        if crosswalk is not None:
            alias = crosswalk.select(F.col("alias_namespace").alias("identity_namespace"), F.col("alias_id").alias("source_id"))
            targets = crosswalk.select(F.col("canonical_namespace").alias("identity_namespace"), F.col("canonical_id").alias("source_id"))
            ids = ids.select(*keys).join(alias, keys, "left_anti").unionByName(targets)
        new = ids.select(*keys).distinct().join(known, keys, "left_anti")
        name = f"aliases-{len(self.batches):05d}-{uuid.uuid4().hex[:8]}"
        _tokens(new, f"{self.path}/{name}", self.n_bytes, self.prefix)
        added = [name]
        if crosswalk is not None:
            now = self.spark.read.parquet(f"{self.path}/{name}").unionByName(known)
            linked = crosswalk.join(now.select(F.col("identity_namespace").alias("canonical_namespace"), F.col("source_id").alias("canonical_id"), "entity_token"), ["canonical_namespace", "canonical_id"]).select(F.col("alias_namespace").alias("identity_namespace"), F.col("alias_id").alias("source_id"), "entity_token").distinct().join(now, keys, "left_anti")
            linked.write.mode("errorifexists").parquet(f"{self.path}/{name}-linked")
            added.append(f"{name}-linked")
        self.batches += added
        self._save()
        return self.aliases()


@dataclass(frozen=True)
class LinkedTable:
    """A table to pseudonymise: its id column, what is kept beside the token, and its record key."""

    df: DataFrame
    id_column: str
    keep: tuple[str, ...]
    record_key: tuple[str, ...] = ()
    can_enrol: bool = False


def pseudonym_audit(tables: dict[str, LinkedTable], namespace: str, known: DataFrame, crosswalk: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row for each table, issues): invalid and unmatched ids, exact duplicates and conflicting record keys; nothing is written."""
    if sum(t.can_enrol for t in tables.values()) != 1:
        raise SpecError("exactly one table enrols entities")
    spark = known.sparkSession
    enrolling = next(t for t in tables.values() if t.can_enrol)
    base = [enrolling.df.select(quoted(enrolling.id_column).cast("string").alias("id")), known.where(F.col("identity_namespace") == namespace).select(F.col("source_id").alias("id"))]
    if crosswalk is not None:
        base.append(crosswalk.where(F.col("alias_namespace") == namespace).select(F.col("alias_id").alias("id")))
    mapped = materialised(reduce(DataFrame.unionByName, base).where("id is not null").distinct(), "known-ids")
    rows, issues = None, []
    for name, t in tables.items():
        null, blank, _, valid = _classes(quoted(t.id_column), None)
        s = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        size = t.df.agg(F.count(F.lit(1)).alias("n_rows"), s(null | blank).alias("n_invalid_ids"))
        unmatched = t.df.where(valid).select(quoted(t.id_column).cast("string").alias("id")).join(mapped, "id", "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))
        payload = [t.id_column, *t.keep]
        exact = t.df.groupBy(*map(quoted, payload)).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_exact_duplicates"))
        if t.record_key:
            # A struct, so that payloads with nulls are counted too.
            clash = t.df.groupBy(*map(quoted, t.record_key)).agg(F.count_distinct(F.struct(*map(quoted, payload))).alias("c")).agg(s(F.col("c") > 1).alias("n_conflicting_keys"))
        else:
            clash = spark.range(1).select(F.lit(None).cast("long").alias("n_conflicting_keys"))
        one = size.crossJoin(unmatched).crossJoin(exact).crossJoin(clash).select(F.lit(name).alias("source"), "*")
        rows = one if rows is None else rows.unionByName(one)
    rules = [("invalid_identifier", "error", "n_invalid_ids", "ids are null or blank"), ("unmatched_identifier", "error", "n_unmatched", "ids are neither enrolled nor known"), ("exact_duplicate", "warning", "n_exact_duplicates", "rows repeat exactly"), ("conflicting_record_key", "error", "n_conflicting_keys", "a record key has different rows")]
    issues = rows.select("source", F.explode(F.array(*[F.struct(F.lit(c).alias("issue_code"), F.lit(v).alias("severity"), F.col(k).alias("n_affected"), F.lit(m).alias("message")) for c, v, k, m in rules])).alias("i")).where("i.n_affected > 0").select("i.issue_code", "i.severity", "source", "i.n_affected", "i.message")
    return rows, issues


def crosswalk_audit(crosswalk: DataFrame, observed: DataFrame, known: DataFrame) -> DataFrame:
    """Counts over a crosswalk: rows, unused aliases, conflicts, missing targets, chains, invalid ids and clashes with the registry."""
    c = crosswalk
    bad = lambda k: F.col(k).isNull() | (F.trim(k) == "")
    observed = observed.select("identity_namespace", "source_id").distinct()
    unused = c.join(observed, (F.col("alias_namespace") == observed["identity_namespace"]) & (F.col("alias_id") == observed["source_id"]), "left_anti").count()
    conflicts = c.groupBy("alias_namespace", "alias_id").agg(F.count_distinct(F.struct("canonical_namespace", "canonical_id")).alias("t")).where("t > 1").count()
    targets = observed.unionByName(known.select("identity_namespace", "source_id")).distinct()
    missing = c.join(targets, (F.col("canonical_namespace") == targets["identity_namespace"]) & (F.col("canonical_id") == targets["source_id"]), "left_anti").count()
    second = c.select(F.col("alias_namespace").alias("n2"), F.col("alias_id").alias("i2")).distinct()
    chains = c.join(second, (F.col("canonical_namespace") == F.col("n2")) & (F.col("canonical_id") == F.col("i2")), "left_semi").count()
    invalid = c.where(bad("alias_id") | bad("canonical_id")).count()
    a, b = known.select(F.col("identity_namespace").alias("alias_namespace"), F.col("source_id").alias("alias_id"), F.col("entity_token").alias("ta")), known.select(F.col("identity_namespace").alias("canonical_namespace"), F.col("source_id").alias("canonical_id"), F.col("entity_token").alias("tb"))
    clashes = c.join(a, ["alias_namespace", "alias_id"]).join(b, ["canonical_namespace", "canonical_id"]).where("ta <> tb").count()
    return c.sparkSession.createDataFrame([(c.count(), unused, conflicts, missing, chains, invalid, clashes)], "n_rows long, n_unused long, n_conflicts long, n_missing_targets long, n_chains long, n_invalid long, n_registry_conflicts long")


def pseudonymise(tables: dict[str, LinkedTable], namespace: str, registry: Registry, output: str, token_column: str = "entity_token", exact_duplicates: str = "report", crosswalk: DataFrame | None = None) -> dict[str, DataFrame]:
    """Audit, enrol, and write each table with tokens for its ids; nothing is written if the audit has errors."""
    if exact_duplicates not in ("report", "drop"):
        raise SpecError("exact duplicates are reported or dropped")
    _, issues = pseudonym_audit(tables, namespace, registry.aliases(), crosswalk)
    if issues.where("severity = 'error'").limit(1).count():
        raise SpecError("the audit found errors; nothing was written")
    enrolling = next(t for t in tables.values() if t.can_enrol)
    ids = enrolling.df.select(F.lit(namespace).alias("identity_namespace"), quoted(enrolling.id_column).cast("string").alias("source_id"))
    tokens = registry.enrol(ids, crosswalk).where(F.col("identity_namespace") == namespace).select("source_id", "entity_token")
    out = {}
    for name, t in tables.items():
        if token_column in t.keep:
            raise SpecError("a kept column has the token's name")
        source = t.df.select(quoted(t.id_column).cast("string").alias("\1id"), *map(quoted, t.keep))
        made = source.join(tokens, source["\1id"] == tokens["source_id"]).select(F.col("entity_token").alias(token_column), *map(quoted, t.keep))
        made = made.distinct() if exact_duplicates == "drop" else made
        made.write.mode("errorifexists").parquet(f"{output}/{name}")
        out[name] = t.df.sparkSession.read.parquet(f"{output}/{name}")
        expected = source.distinct().count() if exact_duplicates == "drop" else source.count()
        if out[name].count() != expected:
            raise AssertionError("a pseudonymised table does not have the rows of its source")
    return out
