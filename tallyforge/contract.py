"""How a variable is read: missingness, typed codes, numeric and text forms, and whether its storage allows the analysis."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import Spec, Variable, storage_family

#: Largest whole number that a double holds exactly.
EXACT = 9_007_199_254_740_991
BLANKS = " \t\r\n"


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_div(num: Column, den: Column) -> Column:
    """num / den as double; null where the denominator is 0 or null."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def storage_status(dtype: T.DataType, v: Variable, assume_timezone: bool = False) -> tuple[str, str | None]:
    """(compatible, coercible or incompatible; reason) from storage alone."""
    family, kind = storage_family(dtype), v.analysis_type
    if family == "other":
        return "incompatible", "unsupported storage"
    if kind == "numeric":
        return ("compatible", None) if family in ("numeric", "integer") else ("incompatible", "numeric storage is needed")
    if kind == "integer":
        if family == "integer":
            return "compatible", None
        return ("incompatible", "whole-number storage is needed")
    if kind == "categorical":
        if family in ("text", "boolean"):
            return "compatible", None
        if family in ("integer", "numeric") and v.levels:
            return "coercible", "stored values are compared with the declared levels"
        return "incompatible", "categorical storage or declared levels are needed"
    if kind == "binary":
        if family == "boolean":
            return "compatible", None
        if family in ("text", "integer", "numeric") and len(v.levels) == 2:
            return "coercible" if family != "text" else "compatible", "exactly two levels are declared" if family != "text" else None
        return "incompatible", "boolean storage or exactly two declared levels are needed"
    if kind == "date":
        return ("compatible", None) if family == "date" else ("incompatible", "date storage is needed")
    if kind == "datetime":
        if family == "datetime":
            return "compatible", None
        if family == "local" and assume_timezone:
            return "coercible", "local times are taken as UTC by request"
        return "incompatible", "a timestamp without time zone is no instant" if family == "local" else "timestamp storage is needed"
    return ("compatible", None) if family == "text" else ("incompatible", "text storage is needed")


class CodeError(ValueError):
    """A missing code can't be a value of the variable's storage."""


def typed_codes(dtype: T.DataType, codes: tuple[str, ...]) -> list[object]:
    """The codes as values of the storage type."""
    family = storage_family(dtype)
    out: list[object] = []
    for code in codes:
        try:
            if family == "integer":
                number = float(code)
                if number != math.floor(number):
                    raise ValueError
                out.append(int(number))
            elif family == "numeric":
                out.append(float(code))
            elif family == "boolean":
                out.append({"true": True, "false": False}[code.lower()])
            elif family == "date":
                out.append(dt.date.fromisoformat(code))
            elif family in ("datetime", "local"):
                out.append(dt.datetime.fromisoformat(code))
            else:
                out.append(code)
        except (ValueError, KeyError):
            raise CodeError("a missing code does not fit the storage type") from None
    return out


def is_missing(x: Column, dtype: T.DataType, codes: tuple[str, ...] = ()) -> Column:
    """Null, NaN or one of the codes; never null itself."""
    out = x.isNull()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        out = out | F.isnan(x)
    values = typed_codes(dtype, codes)
    if values:
        out = out | F.coalesce(x.isin(values), F.lit(False))
    return F.coalesce(out, F.lit(False))


def text_form(x: Column, dtype: T.DataType) -> Column:
    """Values as levels: booleans in capitals, whole numbers without a fraction."""
    family = storage_family(dtype)
    if family == "boolean":
        return F.when(x, "TRUE").when(~x, "FALSE")
    if family == "numeric":
        d = x.cast("double")
        return F.when((d == F.floor(d)) & (F.abs(d) < EXACT), F.floor(d).cast("string")).otherwise(d.cast("string"))
    return x.cast("string")


def number_form(x: Column, dtype: T.DataType) -> Column:
    """Numbers as double, dates as days and instants as seconds since 1970."""
    family = storage_family(dtype)
    if family == "date":
        return F.datediff(x, F.lit(dt.date(1970, 1, 1))).cast("double")
    if family in ("datetime", "local"):
        return F.unix_micros(x.cast("timestamp")).cast("double") / F.lit(1e6)
    return x.cast("double")


def is_infinite(x: Column) -> Column:
    return F.coalesce(F.abs(x) == F.lit(float("inf")), F.lit(False))


@dataclass(frozen=True)
class Reading:
    """A variable bound to a table: its storage, and the reason if it can't be read."""

    variable: Variable
    dtype: T.DataType | None
    status: str
    reason: str | None

    @property
    def usable(self) -> bool:
        return self.status in ("compatible", "coercible")

    @property
    def name(self) -> str:
        return self.variable.name

    @property
    def column(self) -> Column:
        return quoted(self.name)

    @property
    def missing(self) -> Column:
        return is_missing(self.column, self.dtype, self.variable.missing_codes)

    @property
    def observed_type(self) -> str | None:
        return None if self.dtype is None else self.dtype.simpleString()


def readings(df: DataFrame, spec: Spec, assume_timezone: bool = False) -> list[Reading]:
    """Each variable of the specification as it can be read from ``df``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for v in spec:
        if v.name not in types:
            out.append(Reading(v, None, "absent", "the column is not in the data"))
            continue
        status, reason = storage_status(types[v.name], v, assume_timezone)
        if status != "incompatible":
            try:
                typed_codes(types[v.name], v.missing_codes)
            except CodeError as e:
                status, reason = "incompatible", str(e)
        out.append(Reading(v, types[v.name], status, reason))
    return out
