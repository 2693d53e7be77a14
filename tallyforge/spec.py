"""Variable specifications: the declared, validated data dictionary that every profile works from."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import types as T

DATABASE_TYPES = ("numeric", "integer", "boolean", "date", "datetime", "text")
ANALYSIS_TYPES = ("numeric", "integer", "categorical", "binary", "date", "datetime", "text")
REQUIRED_FIELDS = ("name", "label", "database_type", "analysis_type", "role")
#: Words for true and false in the ``required`` field.
TRUE_WORDS, FALSE_WORDS = {"true", "t", "1", "yes", "y"}, {"false", "f", "0", "no", "n", ""}


@dataclass(frozen=True)
class Variable:
    """One row of a specification."""

    name: str
    label: str = ""
    database_type: str = "text"
    analysis_type: str = "text"
    role: str = "variable"
    units: str = ""
    levels: tuple[str, ...] = ()
    min: float | None = None
    max: float | None = None
    missing_codes: tuple[str, ...] = ()
    required: bool = False
    group: str = ""
    description: str = ""
    timezone: str = ""
    geo_role: str = ""
    geo_pair: str = ""
    geo_crs: str = ""

    @property
    def is_identifier(self) -> bool:
        return self.role.lower() in ("id", "identifier")


@dataclass(frozen=True)
class Spec:
    variables: tuple[Variable, ...] = field(default_factory=tuple)

    def __iter__(self):
        return iter(self.variables)

    def __len__(self) -> int:
        return len(self.variables)

    def __getitem__(self, name: str) -> Variable:
        for v in self.variables:
            if v.name == name:
                return v
        raise KeyError("the specification has no such variable")

    @property
    def names(self) -> list[str]:
        return [v.name for v in self.variables]

    def only(self, names: Iterable[str]) -> Spec:
        return Spec(tuple(self[n] for n in names))

    def of_type(self, *types: str) -> list[Variable]:
        return [v for v in self.variables if v.analysis_type in types]


class SpecError(ValueError):
    """A specification, or an option beside it, breaks a rule.  Messages never hold data values."""


def split_list(text: object) -> tuple[str, ...]:
    """Pieces of a semicolon-separated field, trimmed, empty ones dropped."""
    if text is None:
        return ()
    if isinstance(text, (list, tuple)):
        return tuple(str(x).strip() for x in text if str(x).strip())
    return tuple(p.strip() for p in str(text).split(";") if p.strip())


def strict_levels(text: object) -> tuple[str, ...]:
    """Levels of a stratifier: no empty, padded or repeated piece."""
    pieces = tuple(text) if isinstance(text, (list, tuple)) else tuple(str(text or "").split(";")) if text else ()
    if any(p != p.strip() or not p for p in pieces):
        raise SpecError("declared levels must not be empty or padded with spaces")
    if len(set(pieces)) != len(pieces):
        raise SpecError("declared levels must be unique")
    return pieces


def _number(x: object, what: str) -> float | None:
    if x is None or (isinstance(x, str) and not x.strip()):
        return None
    try:
        return float(x)
    except (TypeError, ValueError):
        raise SpecError(f"{what} must be a number") from None


def _flag(x: object) -> bool:
    if isinstance(x, bool):
        return x
    word = str("" if x is None else x).strip().lower()
    if word in TRUE_WORDS:
        return True
    if word in FALSE_WORDS:
        return False
    raise SpecError("required must be true or false")


def validate_spec(rows: Iterable[Mapping[str, object] | Variable]) -> Spec:
    """The rows as a Spec; raises SpecError at the first rule that is broken."""
    out: list[Variable] = []
    known = {f.name for f in fields(Variable)}
    for row in rows:
        if isinstance(row, Variable):
            row = {f.name: getattr(row, f.name) for f in fields(Variable)}
        if "type" in row:
            raise SpecError("the field type has been replaced by database_type and analysis_type")
        lacking = [f for f in REQUIRED_FIELDS if f not in row]
        if lacking:
            raise SpecError("the specification lacks: " + ", ".join(lacking))
        name = str(row["name"] or "").strip()
        if not name:
            raise SpecError("variable names must not be empty")
        database, analysis = str(row["database_type"]), str(row["analysis_type"])
        if database not in DATABASE_TYPES:
            raise SpecError("unknown database_type")
        if analysis not in ANALYSIS_TYPES:
            raise SpecError("unknown analysis_type")
        low, high = _number(row.get("min"), "min") if analysis in ("numeric", "integer") else None, _number(row.get("max"), "max") if analysis in ("numeric", "integer") else None
        if low is not None and high is not None and low > high:
            raise SpecError("min must not exceed max")
        text = {k: str(row.get(k) or "") for k in ("label", "role", "units", "group", "description", "timezone", "geo_role", "geo_pair", "geo_crs") if k in known}
        out.append(Variable(name=name, database_type=database, analysis_type=analysis, levels=split_list(row.get("levels")), min=low, max=high, missing_codes=split_list(row.get("missing_codes")), required=_flag(row.get("required")), **text))
    if len({v.name for v in out}) != len(out):
        raise SpecError("variable names must be unique")
    _validate_geo(out)
    return Spec(tuple(out))


def _validate_geo(variables: list[Variable]) -> None:
    pairs: dict[str, list[Variable]] = {}
    for v in variables:
        some = [bool(v.geo_role), bool(v.geo_pair), bool(v.geo_crs)]
        if any(some) and not all(some):
            raise SpecError("geo_role, geo_pair and geo_crs are declared together or not at all")
        if all(some):
            if v.geo_role not in ("x", "y"):
                raise SpecError("geo_role must be x or y")
            if v.analysis_type not in ("numeric", "integer"):
                raise SpecError("coordinates must be numeric")
            if not re.fullmatch(r"(?i)epsg:\d+", v.geo_crs):
                raise SpecError("geo_crs must be an EPSG code")
            pairs.setdefault(v.geo_pair, []).append(v)
    for pair in pairs.values():
        if sorted(v.geo_role for v in pair) != ["x", "y"] or len({v.geo_crs.lower() for v in pair}) != 1:
            raise SpecError("a coordinate pair needs one x and one y of the same CRS")


def load_spec(source: str | Path | Iterable[Mapping[str, object]]) -> Spec:
    """A Spec from a CSV file or from rows."""
    if isinstance(source, (str, Path)):
        with open(source, newline="", encoding="utf-8") as f:
            return validate_spec(list(csv.DictReader(f)))
    return validate_spec(source)


def storage_family(dtype: T.DataType) -> str:
    """numeric, integer, boolean, text, date, datetime, local (a timestamp without zone) or other."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, T.TimestampNTZType):
        return "local"
    if isinstance(dtype, T.TimestampType):
        return "datetime"
    return "other"


def scaffold_spec(schema: T.StructType) -> Spec:
    """A draft from storage types alone; no value is looked at.  Nested columns are refused."""
    out = []
    for f in schema.fields:
        family = storage_family(f.dataType)
        if family == "other":
            raise SpecError("nested and binary columns can't be specified")
        database = {"local": "datetime"}.get(family, family)
        analysis = {"boolean": "binary", "local": "datetime"}.get(family, family)
        out.append(Variable(name=f.name, label=f.name, database_type=database, analysis_type=analysis, levels=("FALSE", "TRUE") if family == "boolean" else ()))
    return Spec(tuple(out))


def with_levels(v: Variable, levels: Iterable[str]) -> Variable:
    return replace(v, levels=tuple(levels))
