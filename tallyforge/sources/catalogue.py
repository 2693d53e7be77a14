"""Sources with a fingerprint, inventories of tables, and the semantic dictionary that is drawn from them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import Spec, SpecError, storage_family, validate_spec

INVENTORY_COLUMNS = "schema_name string, table_name string, column_name string, ordinal int, data_type string, is_nullable boolean"
KEYS = ["schema_name", "table_name", "column_name"]
CURATED = ["label", "analysis_type", "role", "units", "levels", "missing_codes", "description"]
DICTIONARY = f"{INVENTORY_COLUMNS}, database_type string, label string, analysis_type string, role string, units string, levels string, missing_codes string, description string, drift_status string"


def fingerprint(df: DataFrame) -> str:
    """SHA-256 of the schema."""
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


@dataclass(frozen=True)
class Source:
    """A table bound with the schema it had; local timestamps may be declared to be UTC."""

    df: DataFrame
    name: str
    schema_sha256: str
    assume_timezone: str | None = None

    @classmethod
    def bind(cls, df: DataFrame, name: str, assume_timezone: str | None = None) -> Source:
        if assume_timezone not in (None, "UTC"):
            raise SpecError("local times can only be declared to be UTC")
        if not df.columns or len(set(df.columns)) != len(df.columns):
            raise SpecError("a source needs columns with unique names")
        return cls(df, name, fingerprint(df), assume_timezone)

    def checked(self) -> DataFrame:
        if fingerprint(self.df) != self.schema_sha256:
            raise SpecError("the source's schema has changed")
        return self.df

    def __repr__(self) -> str:
        return f"Source({self.name!r}, {len(self.df.columns)} columns)"


def read_source(spark: SparkSession, path_or_table: str, name: str | None = None, assume_timezone: str | None = None) -> Source:
    """A Parquet path, or a table or view of the session's catalogue."""
    df = spark.read.parquet(path_or_table) if "/" in path_or_table else spark.table(path_or_table)
    return Source.bind(df, name or path_or_table.rsplit("/", 1)[-1], assume_timezone)


def read_relation(spark: SparkSession, url: str, relation: str, properties: dict[str, str] | None = None, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> Source:
    """A database relation over JDBC, read in parallel ranges of a numeric column if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", relation).options(**(properties or {}))
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return Source.bind(reader.load(), relation)


def inventory(tables: dict[str, DataFrame], schema_name: str = "main", row_counts: str = "none") -> dict[str, DataFrame]:
    """tables, columns and constraints, in order; constraints are empty because Parquet has none."""
    if row_counts not in ("none", "exact"):
        raise SpecError("row counts are none or exact")
    spark = next(iter(tables.values())).sparkSession
    columns = [(schema_name, t, f.name, i, f.dataType.simpleString(), f.nullable) for t in sorted(tables) for i, f in enumerate(tables[t].schema.fields, 1)]
    sized = spark.createDataFrame([(schema_name, t, len(tables[t].columns)) for t in sorted(tables)], "schema_name string, table_name string, n_columns int")
    if row_counts == "exact":
        counts = None
        for t in sorted(tables):
            one = tables[t].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
            counts = one if counts is None else counts.unionByName(one)
        sized = sized.join(counts, "table_name").select("schema_name", "table_name", "n_columns", "n_rows")
    else:
        sized = sized.withColumn("n_rows", F.lit(None).cast("long"))
    return {"tables": sized, "columns": spark.createDataFrame(columns, INVENTORY_COLUMNS), "constraints": spark.createDataFrame([], "schema_name string, table_name string, constraint_name string, constraint_type string, columns string")}


def catalogue_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """All tables of a database of the session's catalogue."""
    return {t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database)}


def dictionary_scaffold(columns: DataFrame) -> DataFrame:
    """A dictionary row for each inventoried column, types inferred from storage, nothing else claimed."""
    kind = F.when(F.col("data_type").isin("tinyint", "smallint", "int", "bigint"), "integer").when(F.col("data_type").rlike("^(decimal|float|double)"), "numeric").when(F.col("data_type") == "boolean", "boolean").when(F.col("data_type") == "date", "date").when(F.col("data_type").isin("timestamp", "timestamp_ntz"), "datetime").otherwise("text")
    blank = F.lit("")
    return columns.select("*", kind.alias("database_type"), F.col("column_name").alias("label"), F.when(kind == "boolean", "binary").otherwise(kind).alias("analysis_type"), F.lit("variable").alias("role"), blank.alias("units"), F.when(kind == "boolean", "FALSE;TRUE").otherwise("").alias("levels"), blank.alias("missing_codes"), blank.alias("description"), F.lit("current").alias("drift_status"))


def dictionary_refresh(dictionary: DataFrame, columns: DataFrame) -> DataFrame:
    """The dictionary against a new inventory: curated fields stay, and each row is added, modified, current or removed."""
    fresh = dictionary_scaffold(columns)
    source = ["ordinal", "data_type", "is_nullable", "database_type"]
    old = dictionary.select(*KEYS, *[F.col(c).alias(f"o_{c}") for c in [*source, *CURATED]], F.lit(True).alias("had"))
    new = fresh.select(*KEYS, *source, *[F.col(c).alias(f"n_{c}") for c in CURATED], F.lit(True).alias("has"))
    both = new.join(old, KEYS, "full_outer")
    same = F.lit(True)
    for c in source:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    status = F.when(F.col("has").isNull(), "removed").when(F.col("had").isNull(), "added").when(same, "current").otherwise("modified")
    keep = lambda c: F.when(F.col("has").isNull(), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
    curated = lambda c: F.when(F.col("had"), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c)
    return both.select(*KEYS, *map(keep, source), *map(curated, CURATED), status.alias("drift_status")).select(*[c.split()[0] for c in DICTIONARY.split(", ")])


def dictionary_validate(dictionary: DataFrame) -> DataFrame:
    """(rule, n) of the rules that rows break; empty if the dictionary is sound."""
    bad_keys = dictionary.groupBy(*KEYS).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_key").alias("rule"), "n")
    rules = [("empty_key", F.lit(False) | F.col("column_name").isNull() | (F.col("column_name") == "")), ("unknown_analysis_type", ~F.col("analysis_type").isin("numeric", "integer", "categorical", "binary", "date", "datetime", "text")), ("unknown_drift_status", ~F.col("drift_status").isin("added", "modified", "current", "removed"))]
    sums = dictionary.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("long")), F.lit(0)).alias(n) for n, c in rules])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n, _ in rules])).alias("e")).select("e.*").unionByName(bad_keys).where("n > 0")


def dictionary_spec(dictionary: DataFrame, table: str, levels: DataFrame | None = None) -> Spec:
    """The specification of one table; ``levels`` (column_name, value, display_order, is_missing) adds levels and missing codes."""
    rows = dictionary.where((F.col("table_name") == table) & (F.col("drift_status") != "removed")).orderBy("ordinal").collect()
    if not rows:
        raise SpecError("the dictionary has no such table")
    by: dict[str, tuple[list[str], list[str]]] = {}
    if levels is not None:
        for r in levels.orderBy("column_name", "display_order").collect():
            by.setdefault(r["column_name"], ([], []))[1 if r["is_missing"] else 0].append(r["value"])
    out = []
    for r in rows:
        known, gone = by.get(r["column_name"], ([], []))
        codes = [c for c in (r["missing_codes"] or "").split(";") if c]
        out.append({"name": r["column_name"], "label": r["label"], "database_type": r["database_type"], "analysis_type": r["analysis_type"], "role": r["role"], "units": r["units"], "levels": ";".join(known) if known else r["levels"], "missing_codes": ";".join(dict.fromkeys(codes + gone)), "description": r["description"]})
    return validate_spec(out)


def reviewed_types(df: DataFrame) -> dict[str, str]:
    """The storage family of every column."""
    return {f.name: storage_family(f.dataType) for f in df.schema.fields}
