"""Mexico's 18-character population register code: fields by position, and an audit of form, catalogue and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import quoted

STATES = "AS BC BS CC CL CM CS CH DF DG GT GR HG JC MC MN MS NT NL OC PL QT QR SP SL SR TC TS TL VZ YN ZS NE".split()
#: field: (first character, length)
FIELDS = {"surname_initial": (1, 1), "surname_vowel": (2, 1), "second_surname_initial": (3, 1), "name_initial": (4, 1), "birth_month": (7, 2), "birth_day": (9, 2), "sex": (11, 1), "state": (12, 2), "consonants": (14, 3), "homonym": (17, 1), "check_digit": (18, 1)}


def split_code(df: DataFrame, column: str) -> DataFrame:
    """The thirteen fields of every code; years up to 22 are of this century.  A code that isn't 18 long is an error."""
    x = quoted(column)
    bad = df.where(x.isNotNull() & (F.char_length(x) != 18)).limit(1).count()
    if bad:
        raise ValueError("every code must have 18 characters")
    yy = F.substring(x, 5, 2)
    year = F.when(yy.rlike("^[0-9]{2}$"), F.concat(F.when(F.expr(f"try_cast(substring(`{column}`, 5, 2) as int)") <= 22, "20").otherwise("19"), yy))
    first = [F.substring(x, *FIELDS[f]).alias(f) for f in list(FIELDS)[:4]]
    rest = [F.substring(x, *FIELDS[f]).alias(f) for f in list(FIELDS)[4:]]
    return df.select(x.alias("code"), *first, year.alias("birth_year"), *rest)


def audit(df: DataFrame, column: str, key: str, today: Column | None = None, references: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """records, issues, comparison and summary; ``references`` maps birth_date, sex_code, birthplace_code or initials to columns to compare with."""
    x, today = quoted(column), F.current_date() if today is None else today
    part = lambda a, n=1: F.substring(x, a, n)
    missing, size_ok = x.isNull(), F.coalesce(F.char_length(x) == 18, F.lit(False))
    flag = lambda cond: size_ok & F.coalesce(cond, F.lit(False))
    ok = {
        "invalid_initials": flag(part(1, 4).rlike("^[A-Z][AEIOUX][A-Z]{2}$")),
        "invalid_birth_date_format": flag(part(5, 6).rlike("^[0-9]{6}$")),
        "invalid_sex_code": flag(part(11).isin("H", "M")),
        "invalid_birthplace_code": flag(part(12, 2).isin(STATES)),
        "invalid_internal_consonants": flag(part(14, 3).rlike("^[BCDFGHJKLMNPQRSTVWXYZ]{3}$")),
        "invalid_century_marker": flag(part(17).rlike("^[0-9A-J]$")),
        "invalid_check_digit_format": flag(part(18).rlike("^[0-9]$")),
    }
    dated = ok["invalid_birth_date_format"] & ok["invalid_century_marker"]
    century = F.when(part(17).rlike("^[0-9]$"), "19").otherwise("20")
    date = F.when(dated, F.try_to_date(F.concat(century, part(5, 2), F.lit("-"), part(7, 2), F.lit("-"), part(9, 2)), "yyyy-MM-dd"))
    base = df.withColumn("_date", date)
    calendar = dated & F.col("_date").isNotNull()
    future = calendar & (F.col("_date") > today)
    stages = {"invalid_birthplace_code": "catalogue", "invalid_century_marker": "date"}
    checks = [(missing, "missing_code", "input"), (~missing & ~size_ok, "invalid_length", "input"), *[(size_ok & ~good, code, stages.get(code, "lexical")) for code, good in ok.items()], (dated & ~calendar, "invalid_calendar_date", "date"), (future, "future_birth_date", "date")]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(code).alias("issue_code"), F.lit(stage).alias("stage"))) for c, code, stage in checks]), lambda i: i.isNotNull())
    base = base.withColumn("_issues", found)
    valid = F.size("_issues") == 0
    status = F.when(missing, "missing").when(valid, "valid").otherwise("invalid")
    derived = {"birth_date": F.col("_date"), "sex_code": part(11), "birthplace_code": part(12, 2), "initials": part(1, 4)}
    records = base.select(key, status.alias("status"), *[F.when(valid, c).alias(n) for n, c in derived.items()], F.when(valid, F.when(part(17).rlike("^[0-9]$"), "1900-1999").otherwise("2000-2099")).alias("century_marker_class"), F.when(valid, F.lit("not_verified")).alias("checksum_status"))
    issues = base.select(key, F.explode("_issues").alias("i")).select(key, "i.issue_code", "i.stage")
    references = references or {}

    def state(name: str) -> Column:
        if name not in references:
            return F.lit("not_requested")
        ref = quoted(references[name])
        return F.when(~valid, "code_unavailable").when(ref.isNull(), "reference_missing").when(ref == derived[name], "match").otherwise("mismatch")

    comparison = base.select(key, *[state(n).alias(n) for n in derived])
    summary = records.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("measure"), F.col("status").alias("value"), "n").unionByName(issues.groupBy("issue_code").agg(F.count(F.lit(1)).alias("n")).select(F.lit("issue").alias("measure"), F.col("issue_code").alias("value"), "n"))
    return {"records": records, "issues": issues, "comparison": comparison, "summary": summary}
