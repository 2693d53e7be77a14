"""Delimited and Parquet files, names of outputs, and staged publication on the driver."""

from __future__ import annotations

import csv
import datetime as dt
import hashlib
import json
import os
import platform
import shutil
import uuid
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import quoted
from ..spec import SpecError
from ..storage import bounded

NA_TOKENS = ("-Inf", "NULL", ".", "", "NA", "NaN", "<NA>")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, na: tuple[str, ...] = NA_TOKENS, infer: bool = True) -> DataFrame:
    """A delimited file, values trimmed and ``na`` tokens null.

    Types are found by one aggregate over the text columns (whole, decimal, date, else
    text), so that a missing-value word does not turn a number column into text.
    """
    raw = spark.read.option("header", header).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("inferSchema", False).option("multiLine", False).csv(path)
    clean = raw.select(*[F.when(~quoted(c).isin(list(na)), quoted(c)).alias(c) for c in raw.columns])
    if not infer or not raw.columns:
        return clean
    tests = (("bigint", lambda x: x.rlike(r"^[+-]?\d{1,18}$")), ("double", lambda x: x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), ("date", lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull()), ("boolean", lambda x: F.lower(x).isin("true", "false")))
    got = clean.agg(*[F.bool_and(quoted(c).isNull() | t(quoted(c))).alias(f"{k}{i}") for i, c in enumerate(clean.columns) for k, t in tests], *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(clean.columns)]).first()
    kind = lambda i: next((k for k, _ in tests if got[f"{k}{i}"]), "string") if got[f"n{i}"] else "string"
    return clean.select(*[quoted(c).cast(kind(i)).alias(c) for i, c in enumerate(clean.columns)])


def write_delimited(df: DataFrame, path: str, sep: str = "\t", na: str = "NA", header: bool = True, mode: str = "errorifexists") -> None:
    """A folder of delimited files, one for each partition: nothing is gathered."""
    df.write.mode(mode).option("sep", sep).option("nullValue", na).option("emptyValue", "").option("header", header).csv(path)


def write_small(df: DataFrame, folder: str, name: str, suffix: str = "csv", sep: str | None = None, most: int = 1_000_000) -> str:
    """One file of a bounded result; the separator must agree with the suffix and the folder must exist."""
    implied = {"csv": ",", "tsv": "\t"}.get(suffix.lstrip("."))
    if sep is not None and implied is not None and sep != implied:
        raise SpecError("the separator contradicts the suffix")
    if implied is None and sep is None:
        raise SpecError("this suffix needs a separator")
    if os.sep in name or not os.path.isdir(folder):
        raise SpecError("the name must be plain and the folder must exist")
    path = os.path.join(folder, f"{name}.{suffix.lstrip('.')}")
    rows = bounded(df, most)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=sep or implied, lineterminator="\n")
        w.writerow(df.columns)
        w.writerows([["NA" if v is None else v for v in r] for r in rows])
    return path


def output_name(name: str | None, suffix: str = ".tsv") -> str:
    """The name with its extension replaced; NA for none."""
    return (os.path.splitext(name)[0] if name else "NA") + suffix


def make_folder(base: str, sub: str | None = None) -> str:
    """``base/sub``, today's date if no name is given."""
    path = os.path.join(base, sub or dt.date.today().strftime("%d_%m_%Y"))
    os.makedirs(path, exist_ok=True)
    return path


def session_log(spark: SparkSession, prefix: str | None = None) -> str:
    """Versions and settings of the session in a text file."""
    path = f"{prefix}_log.txt" if prefix else f"session_{dt.date.today():%Y%m%d}_log.txt"
    Path(path).write_text("\n".join([f"python {platform.python_version()}", f"pyspark {pyspark.__version__}", f"spark {spark.version}", *(f"{k}={v}" for k, v in sorted(spark.sparkContext.getConf().getAll()))]) + "\n")
    return path


def save_tables(tables: dict[str, DataFrame], prefix: str) -> dict[str, str]:
    """Named tables as Parquet folders; none may exist."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{prefix}_{name}.parquet"
        df.write.mode("errorifexists").parquet(out[name])
    return out


def sheet_names(files: list[str], most: int = 29) -> list[str]:
    """Names of at most ``most`` characters, unique without regard to case, with _2, _3 … where they repeat."""
    out: list[str] = []
    taken: set[str] = set()
    for f in files:
        stem = Path(f).stem[:most]
        name, k = stem, 1
        while name.lower() in taken:
            k += 1
            name = f"{stem[: most - len(str(k)) - 1]}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


class Bundle:
    """A folder of results with a manifest of checksums: filled in a staging folder, then renamed into place."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        if os.path.exists(self.path):
            if not overwrite:
                raise FileExistsError("the bundle's folder exists")
            check_bundle(self.path)
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def __enter__(self) -> Bundle:
        os.makedirs(self.staging)
        return self

    def file(self, name: str) -> str:
        full = os.path.join(self.staging, name)
        if not os.path.abspath(full).startswith(os.path.abspath(self.staging) + os.sep):
            raise SpecError("files of a bundle stay inside it")
        os.makedirs(os.path.dirname(full), exist_ok=True)
        return full

    def table(self, name: str, df: DataFrame, most: int = 1_000_000) -> None:
        self.file(f"tables/{name}.csv")
        write_small(df, os.path.join(self.staging, "tables"), name, "csv", most=most)

    def text(self, name: str, content: str) -> None:
        Path(self.file(name)).write_text(content, encoding="utf-8")

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is not None:
            shutil.rmtree(self.staging, ignore_errors=True)
            return
        files = {str(p.relative_to(self.staging)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(self.staging).rglob("*")) if p.is_file()}
        Path(self.staging, "manifest.json").write_text(json.dumps({"version": 1, "files": files}, indent=1, sort_keys=True))
        old = f"{self.path}.old-{uuid.uuid4().hex}"
        if os.path.exists(self.path):
            os.rename(self.path, old)
        try:
            os.rename(self.staging, self.path)
        except OSError:
            if os.path.exists(old):
                os.rename(old, self.path)
            raise
        shutil.rmtree(old, ignore_errors=True)


def check_bundle(path: str) -> dict[str, str]:
    """The manifest's files, after comparing every checksum."""
    try:
        files = json.loads(Path(path, "manifest.json").read_text())["files"]
    except (OSError, KeyError, ValueError):
        raise SpecError("the folder is no bundle") from None
    for name, digest in files.items():
        full = Path(path, name)
        if Path(name).is_absolute() or ".." in Path(name).parts or not full.is_file() or hashlib.sha256(full.read_bytes()).hexdigest() != digest:
            raise SpecError("a file of the bundle is absent or was changed")
    return files
