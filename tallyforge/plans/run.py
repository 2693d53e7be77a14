"""Runs: a whole exploratory profile, and a guided intake with review gates."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import prepare, synthetic_data
from ..operators.profile import NUMERIC, TEMPORAL, Profile
from ..operators.quality import coordinate_profile, points_in_box
from ..operators.stratified import categorical_display, profile_stratified, reconcile, table1
from ..operators.summaries import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS, TEMPORAL_COLUMNS, TEXT_COLUMNS, identifier_profile, profile_missing, schema_check, variables_component
from ..sources.catalogue import Source
from ..sources.files import Bundle, check_bundle
from ..spec import Spec, SpecError, load_spec, scaffold_spec
from ..storage import bounded, scratch
from .report import bars_svg, box_svg, histogram_svg, page, scatter_svg, table_html

MAX_PLOT_LEVELS = 20
MAX_PUBLISHED = 1_000_000


def run_eda(data: DataFrame | Source | None, spec: Spec, output_dir: str | None = None, *, spark: SparkSession | None = None, synthetic_rows: int | None = None, seed: int = 0, strata: str | None = None, plots: bool = True, basis: str = "compatibility", overwrite: bool = False, maps: bool = False, max_map_points: int = 10_000) -> dict[str, DataFrame]:
    """All components of a profile; with a folder they are published there as a bundle with plots and a manifest.

    Either data or a number of synthetic rows is given, never both.
    """
    if (data is None) == (synthetic_rows is None):
        raise SpecError("give data or ask for synthetic rows")
    zone = isinstance(data, Source) and data.assume_timezone == "UTC"
    df = synthetic_data(spark, spec, synthetic_rows, seed) if data is None else data.checked() if isinstance(data, Source) else data
    if output_dir:
        # What is published is rows by then.
        with scratch(df.sparkSession):
            return _run_eda(df, spec, output_dir, strata, plots, basis, overwrite, maps, max_map_points, zone)
    return _run_eda(df, spec, None, strata, plots, basis, overwrite, maps, max_map_points, zone)


def _run_eda(df: DataFrame, spec: Spec, output_dir: str | None, strata: str | None, plots: bool, basis: str, overwrite: bool, maps: bool, max_map_points: int, zone: bool) -> dict[str, DataFrame]:
    p = Profile(df, spec, None, zone)
    # Independent passes run beside one another; what several components need is there before them.
    p.cells  # noqa: B018
    at_once([lambda: p.quartiles((*NUMERIC, *TEMPORAL)), lambda: p.basic, lambda: p.level_counts])
    makers = {
        "schema": lambda: schema_check(df, spec, zone),
        "missing": lambda: profile_missing(df, spec),
        "geo": lambda: coordinate_profile(df, spec),
        "identifiers": lambda: identifier_profile(df, spec),
        "variables": lambda: variables_component(p),
        "numeric": lambda: p.numeric().select(*NUMERIC_COLUMNS),
        "categorical": lambda: p.categorical().select(*CATEGORICAL_COLUMNS),
        "text": lambda: p.text().select(*TEXT_COLUMNS),
        "temporal": lambda: p.temporal().select(*TEMPORAL_COLUMNS),
    }
    bins: list = []

    def rows_of(name: str) -> DataFrame:
        part = makers[name]()
        # Computed once: tables of the report and what is returned are these rows.
        return df.sparkSession.createDataFrame(bounded(part, MAX_PUBLISHED, f"the table {name}"), part.schema) if output_dir else part

    tasks = [lambda n=n: (n, rows_of(n)) for n in makers]
    if output_dir and plots:
        tasks.append(lambda: bins.extend(p.histogram().collect()))
    done = dict(x for x in at_once(tasks) if x)
    out = {n: done[n] for n in makers}
    if strata:
        s = profile_stratified(df, spec, strata, assume_timezone=zone)
        reconcile(s)
        out |= {f"stratified_{c}": getattr(s, c) for c in ("groups", "variables", "numeric", "categorical", "text", "temporal")}
        out |= {"categorical_display": categorical_display(s, basis), "table1": table1(s, basis)}
    if output_dir:
        with Bundle(output_dir, overwrite) as b:
            for name, part in out.items():
                if name not in makers:
                    out[name] = part = df.sparkSession.createDataFrame(bounded(part, MAX_PUBLISHED, f"the table {name}"), part.schema)
                b.table(name, part)
            if plots:
                for name, svg in profile_plots(bins, out["numeric"], out["categorical"]).items():
                    b.text(f"plots/{name}.svg", svg)
            if maps:
                for name, svg in point_maps(df, spec, out["geo"], max_map_points).items():
                    b.text(f"maps/{name}.svg", svg)
            b.text("index.html", page("Exploratory profile", [(k, table_html(v)) for k, v in out.items() if k in ("variables", "missing", "numeric", "categorical", "table1")]))
    return out


def at_once(tasks: list[Callable[[], object]], most: int = 4) -> list:
    """The results of independent jobs that the driver starts beside one another: small ones leave executors idle."""
    with ThreadPoolExecutor(most) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def profile_plots(histogram: list, numeric: DataFrame, categorical: DataFrame, top: int = MAX_PLOT_LEVELS) -> dict[str, str]:
    """SVG by file name: histograms, boxes and bars, from bins, quantiles and counts only."""
    out, bins = {}, {}
    for r in histogram:
        bins.setdefault(r["name"], []).append(r)
    for i, (name, rows) in enumerate(bins.items(), 1):
        out[f"histogram_{i:03d}"] = histogram_svg(name, rows)
    boxes = numeric.select("name", "min", "q1", "median", "q3", "max").collect()
    if boxes:
        out["boxes"] = box_svg("Quartiles", boxes)
    levels: dict[str, list] = {}
    for r in categorical.select("name", "level", "n").collect():
        levels.setdefault(r["name"], []).append((r["level"], r["n"]))
    for i, (name, pairs) in enumerate(levels.items(), 1):
        pairs.sort(key=lambda x: (-x[1], x[0].encode()))
        head, rest = pairs[:top], pairs[top:]
        if rest:
            head = [*head, (f"Other ({len(rest)} levels)", sum(n for _, n in rest))]
        out[f"levels_{i:03d}"] = bars_svg(name, [w for w, _ in head], [n for _, n in head])
    return out


def point_maps(df: DataFrame, spec: Spec, geo: DataFrame, most: int) -> dict[str, str]:
    """A map of points for each ready pair; a pair with more points than ``most`` is refused as a whole."""
    out = {}
    for i, r in enumerate(geo.where("map_ready").collect(), 1):
        points = points_in_box(df, r["x_name"], r["y_name"], max_features=most)
        out[f"map_{i:03d}"] = scatter_svg(r["geo_pair"], [(float(x), float(y)) for x, y in points])
    return out


@dataclass
class Intake:
    """State of a guided intake: its status, messages for the reviewer, and what was made so far."""

    status: str = "running"
    stages: list[tuple[str, str]] = field(default_factory=list)
    messages: list[tuple[str, str, str]] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    prepared: DataFrame | None = None

    def blocked(self, stage: str, text: str) -> None:
        self.status = "blocked"
        self.stages.append((stage, "blocked"))
        self.messages.append((stage, "blocker", text))


def intake_run(data: DataFrame, spec: Spec | str | None, output_dir: str, prepare_mode: str = "none", strata: str | None = None, overwrite: bool = False, source_id: str | None = None) -> Intake:
    """Specification, audit, preparation, summaries, strata, Table 1 and report, each only if those before hold.

    Without a specification a draft is published for review and the run stops there.
    Whatever was made until a stage blocks is published with the reason.
    """
    s = Intake()
    sections: list[tuple[str, str]] = []
    draft = None
    try:
        if spec is None:
            draft = scaffold_spec(data.schema)
            s.blocked("spec", "a draft was made from storage types; review it and run again with it")
        else:
            spec = load_spec(spec) if isinstance(spec, str) else spec
            s.stages.append(("spec", "done"))
    except SpecError as e:
        s.blocked("spec", str(e))
    current = data
    if s.status == "running":
        s.tables["schema"] = schema_check(data, spec)
        _, s.tables["audit"] = prepare(data, spec, "audit")
        blocking = s.tables["audit"].where("status = 'blocking'").count()
        s.stages.append(("audit", "done"))
        if prepare_mode == "apply":
            if blocking:
                s.blocked("prepare", f"{blocking} audit rows are blocking")
            else:
                current, s.tables["prepared_audit"] = prepare(data, spec, "apply")
                s.prepared = current
                s.stages.append(("prepare", "done"))
        elif blocking:
            s.messages.append(("audit", "warning", f"{blocking} audit rows would block preparation"))
    if s.status == "running":
        s.tables |= run_eda(current, spec)
        wrong = s.tables["variables"].where("status = 'summarised' and n <> n_missing + n_observed").count()
        if wrong:
            s.blocked("summaries", "observed and missing values do not add up")
        else:
            s.stages.append(("summaries", "done"))
    if s.status == "running" and strata:
        try:
            strat = profile_stratified(current, spec, strata)
            reconcile(strat)
            s.tables |= {"stratified_groups": strat.groups, "stratified_numeric": strat.numeric, "stratified_categorical": strat.categorical, "table1": table1(strat)}
            s.stages += [("stratified", "done"), ("table1", "done")]
        except (SpecError, AssertionError, KeyError) as e:
            s.blocked("stratified", str(e))
    if s.status == "running":
        s.status = "complete"
    with Bundle(output_dir, overwrite) as b:
        for name, part in s.tables.items():
            b.table(name, part)
        if draft is not None:
            lines = ["name,label,database_type,analysis_type,role,levels"] + [",".join((v.name, v.label, v.database_type, v.analysis_type, v.role, ";".join(v.levels))) for v in draft]
            b.text("draft_spec.csv", "\n".join(lines) + "\n")
        stamp = datetime.now(UTC).isoformat(timespec="seconds")
        notes = "".join(f"<li>{a}: {k}: {t}</li>" for a, k, t in s.messages)
        sections.append(("Stages", "<ul>" + "".join(f"<li>{a}: {k}</li>" for a, k in s.stages) + f"</ul><ul>{notes}</ul><p>{source_id or ''} {stamp}</p>"))
        sections += [(k, table_html(v)) for k, v in s.tables.items() if k in ("variables", "numeric", "categorical", "table1")]
        b.text("index.html", page(f"Intake: {s.status}", sections))
    return s


def render_bundle(path: str) -> str:
    """A README of a bundle after checking every file against the manifest."""
    files = check_bundle(path)
    text = "# Contents\n\n" + "\n".join(f"* {f}" for f in sorted(files)) + "\n"
    Path(path, "README.md").write_text(text)
    return text


PROJECT = {
    "README.md": "# Analysis\n\nPut the specification into spec.csv, then run `python analysis.py DATA OUTPUT`.\n",
    "spec.csv": "name,label,database_type,analysis_type,role,units,levels,min,max,missing_codes,required,group,description\n",
    "analysis.py": 'import sys\n\nfrom pyspark.sql import SparkSession\n\nfrom tallyforge.plans.run import run_eda\nfrom tallyforge.spec import load_spec\n\nspark = SparkSession.builder.getOrCreate()\nrun_eda(spark.read.parquet(sys.argv[1]), load_spec("spec.csv"), sys.argv[2])\n',
}


def create_project(path: str, overwrite: bool = False) -> list[str]:
    """A folder with a specification to fill in and a script that profiles a table under it."""
    if os.path.exists(path) and os.listdir(path) and not overwrite:
        raise FileExistsError("the project's folder is not empty")
    os.makedirs(path, exist_ok=True)
    for name, content in PROJECT.items():
        Path(path, name).write_text(content)
    return sorted(PROJECT)
