"""Sinks: canonical JSON without timings, case and summary CSV, Markdown reports, experiment folders."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE_VERSION = "1.0"
#: Columns of the per-case CSV, in order. Fixed values.
CASE_COLUMNS = ("run_id", "scenario_name", "subject_name", "name", "execution_success", "structural_validity", "semantic_validity", "ratio", "required_ratio")
#: Columns of the summary and of the long-form CSV, in order. Fixed values.
SUMMARY_COLUMNS = (
    "group_type", "group_label", "scenario_name", "subject_name", "subject_kind", "metric_group", "metric_name", "run_count", "bundle_kind", "dataset_id", "template_id", "drift_id",
    "drift_type", "severity", "compatibility_class", "tags", "mean", "median", "stdev", "min", "max", "q1", "q3", "iqr",
)
BOXPLOT_COLUMNS = (
    "run_id", "experiment_name", "scenario_name", "subject_name", "subject_kind", "metric_group", "metric_name", "value", "bundle_kind", "dataset_id", "template_id", "drift_id",
    "drift_type", "severity", "compatibility_class", "tags",
)
_STATS = ("run_count", "mean", "median", "stdev", "min", "max", "q1", "q3", "iqr")


def without_timings(data: Any) -> Any:
    """data without fields that hold seconds, at any depth."""
    if isinstance(data, dict):
        return {k: without_timings(v) for k, v in data.items() if not k.endswith("_seconds")}
    return [without_timings(v) for v in data] if isinstance(data, list) else data


def put_text(text: str, path: str) -> None:
    """One small file, in whatever file system the path is of: Spark's where a session is active, else the driver's disk."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def write_json(data: Any, path: str) -> None:
    """Canonical JSON: sorted keys, timings left out; the same results give the same bytes."""
    put_text(json.dumps(without_timings(data), sort_keys=True, indent=2, default=str) + "\n", path)


def nested_telemetry(rows: list[dict]) -> dict:
    """Timings by scenario, subject and case; rows with a case_name are of cases."""
    out: dict[str, dict] = {}
    for r in rows:
        subject = out.setdefault(r["scenario_name"], {}).setdefault(r["subject_name"], {"name": r["subject_name"], "preparation_seconds": None, "runtime_seconds": None, "cases": {}})
        if r.get("case_name") is not None:
            subject["cases"].setdefault(r["case_name"], {"name": r["case_name"], "runtime_seconds": None})["runtime_seconds"] = r["value"]
        else:
            subject[r["metric_name"]] = r["value"]
    return {"scenarios": [{"name": n, "subjects": [{**s, "cases": list(s["cases"].values())} for s in subjects.values()]} for n, subjects in out.items()]}


def write_telemetry(rows: list[dict], path: str) -> None:
    """The timings of one run alone, beside the canonical results, in the layout that readers.telemetry_rows() reads."""
    put_text(json.dumps(nested_telemetry(rows), sort_keys=True, indent=2) + "\n", path)


def trace_artifact(kind: str, payload: Any) -> dict:
    """A versioned record of a report, a repair, a failure or a reply for the caller to keep: plain data, timings left out."""
    if is_dataclass(payload):
        payload = {f.name: getattr(payload, f.name) for f in fields(payload)}
    plain = json.loads(json.dumps(payload, sort_keys=True, default=lambda x: x.as_dict() if hasattr(x, "as_dict") else x.asDict(True) if hasattr(x, "asDict") else trace_artifact("part", x)["payload"] if is_dataclass(x) else str(x)))
    return {"artifact": kind, "version": TRACE_VERSION, "payload": without_timings(plain)}


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.concat_ws(";", f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """CSV with a header; lists are joined by `;`. An order sorts the whole table over the cluster, so that parts follow each other."""
    out = _texts(df.select(*columns) if columns else df)
    (out.orderBy(*order) if order else out).write.mode("overwrite").option("header", True).csv(path)


def in_columns(df: DataFrame, columns: tuple[str, ...], **more: str) -> DataFrame:
    """df in a fixed order of columns; those that it hasn't are null, or the text given."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(more.get(c)).cast("string").alias(c) for c in columns])


def write_boxplot_csv(rows: DataFrame, path: str, experiment: str) -> None:
    """Metric rows in long form, one value a line, for box plots."""
    write_csv(in_columns(rows, BOXPLOT_COLUMNS, experiment_name=experiment), path, order=["run_id", "scenario_name", "subject_name", "metric_group", "metric_name"])


def write_summary_csv(summary: DataFrame, path: str) -> None:
    write_csv(in_columns(summary, SUMMARY_COLUMNS), path, order=["group_type", "group_label", "subject_name", "metric_group", "metric_name"])


def write_cases_csv(cases: DataFrame, path: str) -> None:
    flat = cases.withColumns({"ratio": F.col("accuracy.ratio"), "required_ratio": F.col("accuracy.required_ratio")})
    write_csv(flat, path, list(CASE_COLUMNS), ["scenario_name", "subject_name", "name"])


def write_records(df: DataFrame, path: str, format: str = "json", drop_nulls: bool = True) -> None:
    """Mapped records as JSON lines, Parquet or ORC; JSON leaves out nulls as an absent key unless told otherwise."""
    w = df.write.mode("overwrite")
    (w.option("ignoreNullFields", drop_nulls).json(path) if format == "json" else w.format(format).save(path))


def _table(rows: list, columns: list[str]) -> list[str]:
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows]]


def experiment_markdown(summary: DataFrame, title: str) -> str:
    """A report of summary rows, which are few: a section for each grouping."""
    rows = sorted(summary.collect(), key=lambda r: (r.group_type, r.group_label, r.metric_group, r.metric_name))
    lines = [f"# {title}", ""]
    for kind in dict.fromkeys(r.group_type for r in rows):
        lines += [f"## By {kind.replace('_', ' ')}", "", *_table([r for r in rows if r.group_type == kind], ["group_label", "metric_group", "metric_name", *_STATS]), ""]
    return "\n".join(lines)


def run_markdown(metrics: DataFrame, title: str) -> str:
    rows = metrics.collect()
    return "\n".join([f"# {title}", "", *_table(rows, metrics.columns), ""])


def export_experiment(cases: DataFrame, summary: DataFrame, telemetry: list[dict], folder: str, name: str, rows: DataFrame | None = None) -> dict:
    """summary/, report.md, boxplot/ where metric rows are given, runs/<run_id>/cases with each run's telemetry.json, and a manifest of them.

    The runs, of which there are few, are written one after the other; folder may be of any file system."""
    runs = sorted(r.run_id for r in cases.select("run_id").distinct().collect())
    write_summary_csv(summary, f"{folder}/summary")
    put_text(experiment_markdown(summary.orderBy("group_type", "group_label", "subject_name", "metric_group", "metric_name"), name), f"{folder}/report.md")
    artifacts = ["summary", "report.md"]
    if rows is not None:
        write_boxplot_csv(rows, f"{folder}/boxplot", name)
        artifacts.append("boxplot")
    made = []
    for run in runs:
        cases.where(F.col("run_id") == run).write.mode("overwrite").parquet(f"{folder}/runs/{run}/cases")
        write_telemetry([t for t in telemetry if t["run_id"] == run], f"{folder}/runs/{run}/telemetry.json")
        made.append({"run_id": run, "artifacts": [f"runs/{run}/cases", f"runs/{run}/telemetry.json"]})
    manifest = {"experiment_name": name, "runs": made, "artifacts": artifacts}
    write_json(manifest, f"{folder}/manifest.json")
    return manifest
