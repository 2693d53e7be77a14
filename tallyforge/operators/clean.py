"""Small cleaning operators: names, values, labels, repeats, duplicates, shape."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import quoted
from ..storage import bounded, materialised, small_join

_RESERVED = set("if else repeat while function for next break TRUE FALSE NULL Inf NaN NA NA_integer_ NA_real_ NA_character_ in".split())


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def count_classes(df: DataFrame) -> dict[str, int]:
    """How many columns there are of each type."""
    return dict(Counter(f.dataType.simpleString() for f in df.schema.fields))


def suffix_names(df: DataFrame, suffix: str, id_col: str | None = None) -> DataFrame:
    """All columns but the id with ``suffix`` after their names."""
    id_col = df.columns[0] if id_col is None else id_col
    return df.toDF(*[c if c == id_col else c + suffix for c in df.columns])


def safe_names(names: list[str], replacement: str = "_", unique: bool = True) -> list[str]:
    """Syntactic names: letters, digits, dots and underscores, no reserved word, numbered when they repeat."""
    out = []
    for n in names:
        s = re.sub(r"[^0-9A-Za-z._]", ".", n)
        if not re.match(r"^([A-Za-z]|\.(?![0-9]))", s):
            s = "X" + s
        out.append(s + "." if s in _RESERVED else s)
    if unique:
        taken, seen = set(out), Counter()
        for i, s in enumerate(out):
            if seen[s]:
                k = seen[s]
                while f"{s}.{k}" in taken:
                    k += 1
                out[i] = f"{s}.{k}"
                taken.add(out[i])
                seen[s] = k + 1
            else:
                seen[s] = 1
    made = [s.replace(".", replacement) for s in out]
    if unique and len(set(made)) != len(made):
        raise ValueError("names can't be made unique with this replacement")
    return made


def replace_value(df: DataFrame, column: str, pattern: str, replacement: str | None = None) -> DataFrame:
    """Values that match the pattern anywhere are replaced as a whole; nulls stay."""
    x = quoted(column)
    return df.withColumn(column, F.when(x.rlike(pattern), F.lit(replacement)).otherwise(x))


def label_values(df: DataFrame, lookup: list[tuple[str, str, str]]) -> tuple[DataFrame, list[str]]:
    """Codes replaced by labels from (variable, level, label) rows; other codes become null.  Also the variables with codes that no label names."""
    by: dict[str, dict[str, str]] = {}
    for variable, level, label in lookup:
        by.setdefault(variable, {})[str(level)] = label
    here = {v: m for v, m in by.items() if v in df.columns}
    if not here:
        return df, []
    flags = df.agg(*[F.bool_or(quoted(v).isNotNull() & ~quoted(v).cast("string").isin(list(m))).alias(f"f{i}") for i, (v, m) in enumerate(here.items())]).first()
    mapped = {v: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[quoted(v).cast("string")] for v, m in here.items()}
    return df.withColumns(mapped), [v for i, v in enumerate(here) if flags[f"f{i}"]]


def distinct_up_to(df: DataFrame, columns: list[str], most: int) -> dict[str, int]:
    """Distinct values of each column, null counted as one, but no more than ``most``: each column is read by itself and no more values are gathered."""
    parts = [df.select(quoted(c).alias("x")).distinct().limit(most).agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n")) for i, c in enumerate(columns)]
    return {columns[r["i"]]: r["n"] for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}


def categorical_candidates(df: DataFrame, cutoff: int = 10) -> list[str]:
    """Columns, dates apart, with fewer than ``cutoff`` distinct values; null counts as one."""
    fields = [f for f in df.schema.fields if not is_date(f.dataType) and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    held = distinct_up_to(df, [f.name for f in fields], cutoff)
    return [f.name for f in fields if held[f.name] < cutoff]


def integers_to_text(df: DataFrame) -> DataFrame:
    """Whole-number columns as text, so that they are taken as categories."""
    return df.withColumns({f.name: quoted(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))})


def used_levels(df: DataFrame, column: str, levels: list[str], most: int = 10_000) -> list[str]:
    """The declared levels that occur."""
    found = {r[0] for r in bounded(df.where(quoted(column).isin(levels)).select(quoted(column).cast("string")).distinct(), most)}
    return [x for x in levels if x in found]


def values_to_null(df: DataFrame, column: str, values: list) -> DataFrame:
    x = quoted(column)
    return df.withColumn(column, F.when(~x.isin(values), x))


def contains_text(df: DataFrame, text_col: str, part_col: str, name: str = "found") -> DataFrame:
    """Whether one column's text contains the other's, literally, row by row."""
    return df.withColumn(name, F.contains(quoted(text_col), quoted(part_col)))


def transpose(df: DataFrame, id_col: str, most: int = 1000) -> DataFrame:
    """One row for each other column, one column for each id."""
    others = [c for c in df.columns if c != id_col]
    ids = [r[0] for r in bounded(df.select(quoted(id_col).cast("string")).distinct().orderBy(id_col), most, "the table to transpose")]
    kind = "double" if all(is_numeric(df.schema[c].dataType) for c in others) else "string"
    long = df.select(quoted(id_col).cast("string").alias("id"), F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("V1"), quoted(c).cast(kind).alias("v")) for i, c in enumerate(others)])).alias("e")).select("id", "e.*")
    return long.groupBy("k", "V1").pivot("id", ids).agg(F.first("v")).orderBy("k").drop("k")


def duplicates(df: DataFrame, column: str, frequency: int = 1) -> DataFrame:
    """Rows whose value occurs more than ``frequency`` times; null is no value.

    The frequent values are counted first, so that only a narrow table is shuffled.
    """
    x = quoted(column)
    many = df.where(x.isNotNull()).groupBy(x.alias("_k")).count().where(F.col("count") > frequency).select("_k")
    return df.join(many, x == F.col("_k"), "left_semi")


def differing_columns(df: DataFrame, id_col: str, value: object, order: list[str], first: int = 1, second: int = 2) -> list[str]:
    """Names of the columns in which two rows of one id differ."""
    rows = df.where(quoted(id_col) == F.lit(value)).orderBy(*map(quoted, order)).limit(max(first, second)).collect()
    a, b = rows[first - 1], rows[second - 1]
    return [c for c in df.columns if a[c] != b[c]]


def repeat_numbers(df: DataFrame, id_col: str, repeat_col: str, order: list[str]) -> DataFrame:
    """``rep_num``: one more than the row before if the id is the same and ``repeat_col`` differs, else 1; order is explicit.

    Within an id a row whose value equals its predecessor's starts again at 1; the number is its place since then.
    """
    w = Window.partitionBy(id_col).orderBy(*map(quoted, order))
    same = F.lag(quoted(repeat_col)).over(w).eqNullSafe(quoted(repeat_col)) | (F.row_number().over(w) == 1)
    run = df.withColumn("_run", F.sum(same.cast("int")).over(w))
    return run.withColumn("rep_num", F.row_number().over(Window.partitionBy(id_col, "_run").orderBy(*map(quoted, order)))).drop("_run")


def spread_repeated(df: DataFrame, repeat_col: str, id_col: str, most: int = 200) -> dict[str, DataFrame]:
    """One table for each visit code, its columns suffixed with it; (id, visit) must be unique and visits not null."""
    bad = df.agg(F.max(quoted(repeat_col).isNull().cast("int")).alias("n")).first()["n"]
    if bad:
        raise ValueError("visit codes must not be missing")
    if df.groupBy(id_col, repeat_col).count().where("count > 1").limit(1).count():
        raise ValueError("each pair of id and visit code must be unique")
    codes = sorted(r[0] for r in bounded(df.select(quoted(repeat_col)).distinct(), most, "the visit codes"))
    return {str(c): suffix_names(df.where(quoted(repeat_col) == F.lit(c)), f".{c}", id_col) for c in codes}


def merge_all(tables: dict[str, DataFrame], id_col: str, how: str = "full_outer") -> DataFrame:
    """Tables joined on one id; columns that clash get the table's name after them."""
    if len(tables) < 2:
        raise ValueError("at least two tables are needed")

    def step(left: tuple[DataFrame, set[str]], right: tuple[str, DataFrame]) -> tuple[DataFrame, set[str]]:
        name, df = right
        out = df.toDF(*[c if c == id_col or c not in left[1] else f"{c}_{name}" for c in df.columns])
        return left[0].join(out, id_col, how), left[1] | set(out.columns)

    (first, df), *rest = tables.items()
    return reduce(step, rest, (df, set(df.columns)))[0]


def stratified_sample(df: DataFrame, outcome: str, proportion: float, key: str, seed: int = 0) -> DataFrame:
    """round(n p) rows of each stratum without replacement, those with the smallest hashes of seed and key, so the same rows each time.

    ``key`` identifies a row.  The hash at which a stratum's sample ends is found by counting
    hashes in ranges; only the range that holds it is sorted, never a stratum.
    """
    if not 0 < proportion <= 1:
        raise ValueError("the proportion must be in (0, 1]")
    stratum = F.coalesce(F.concat(F.lit("="), quoted(outcome).cast("string")), F.lit("")).alias("\1s")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), quoted(key).cast("string"))), 1, 13), 16, 10).cast("long")
    rows = df.select(stratum, draw.alias("\1u"), quoted(key).alias("\1k"))
    s, u, cell = F.col("`\1s`"), F.col("`\1u`"), F.shiftright("`\1u`", 36)
    counts = rows.groupBy(s, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(s)
    ends = counts.withColumn("upto", F.sum("n").over(whole.orderBy("cell"))).withColumn("take", F.bround(F.sum("n").over(whole) * F.lit(float(proportion))).cast("long"))
    ends = materialised(ends.where("upto >= take and upto - n < take").select(s, "cell", (F.col("take") - F.col("upto") + F.col("n")).alias("more")), "sample-ends")
    strata = ends.count()
    last = small_join(rows.withColumn("cell", cell), ends, ["\1s", "cell"], "inner", strata)
    edge = last.withColumn("r", F.row_number().over(whole.orderBy(u, F.col("`\1k`")))).where("r = more").select(s, u.alias("\1u_end"), F.col("`\1k`").alias("\1k_end"))
    out = small_join(df.withColumns({"\1s": stratum, "\1u": draw}), materialised(edge, "sample-edges"), ["\1s"], "inner", strata)
    return out.where(F.struct(u, quoted(key)) <= F.struct(F.col("`\1u_end`"), F.col("`\1k_end`"))).select(*map(quoted, df.columns))


def head_and_tail(df: DataFrame, order: list[str], rows: int = 5, cols: int = 5, last_cols: bool = False) -> DataFrame:
    """The first and the last rows by an explicit order, of the first or last columns."""
    chosen = df.columns[-cols:] if last_cols else df.columns[:cols]
    first = df.orderBy(*[quoted(c).asc_nulls_last() for c in order]).limit(rows).withColumn("_part", F.lit("head"))
    last = df.orderBy(*[quoted(c).desc_nulls_first() for c in order]).limit(rows).withColumn("_part", F.lit("tail"))
    return first.unionByName(last).select(F.col("_part").alias("part"), *map(quoted, chosen))


def list_head(items: dict[str, DataFrame], rows: int = 3, most: int | None = None) -> dict[str, list]:
    return {k: d.limit(rows).collect() for k, d in list(items.items())[:most]}


def list_tail(items: dict[str, DataFrame], order: list[str], rows: int = 3, most: int | None = None) -> dict[str, list]:
    return {k: d.orderBy(*[quoted(c).desc() for c in order]).limit(rows).collect()[::-1] for k, d in list(items.items())[:most]}


def format_numbers(df: DataFrame, skip: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Numeric columns as text with a fixed number of digits."""
    made: dict[str, Column] = {}
    for f in df.schema.fields:
        if is_numeric(f.dataType) and f.name not in (skip or []):
            x = quoted(f.name).cast("double")
            made[f.name] = F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.round(x, digits)))
    return df.withColumns(made)


def missing_percent(df: DataFrame, by_row: bool = False, key: str | None = None) -> DataFrame:
    """Nulls and NaNs as count and percentage, for each column, or for each row beside its key."""
    flag = lambda f: (quoted(f.name).isNull() | F.isnan(quoted(f.name)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name).isNull()).cast("int")
    if by_row:
        n = reduce(lambda a, b: a + b, [F.coalesce(flag(f), F.lit(1)) for f in df.schema.fields])
        return df.select(quoted(key or df.columns[0]), n.cast("long").alias("na_count"), (n * 100.0 / len(df.columns)).alias("na_perc"))
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(flag(f)).alias(f"m{i}") for i, f in enumerate(df.schema.fields)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("na_count"), F.when(F.col("n") > 0, F.col(f"m{i}") * 100.0 / F.col("n")).alias("na_perc")) for i, f in enumerate(df.schema.fields)])).alias("e")).select("e.*")
