"""Sources: CSV, JSON, JSON lines, Parquet and in-memory records as DataFrames with normalised column names."""

from __future__ import annotations

import csv
import io
import re
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.operators.contract import issues_column


@dataclass(frozen=True)
class Dataset:
    """A read dataset: its records and what the reader learnt about them. root: rows, object or list."""

    records: DataFrame
    format: str
    root: str = "rows"
    path: str | None = None
    original_names: dict[str, str] = field(default_factory=dict)


def normalise_name(name: str) -> str:
    """Trimmed, white space as one underscore, lower case."""
    return re.sub(r"\s+", "_", name.strip()).lower()


def normalised(column: Column) -> Column:
    """normalise_name() of a column's values."""
    return F.lower(F.regexp_replace(F.trim(column), r"\s+", "_"))


def normalised_headers(names: list[str]) -> dict[str, str]:
    """Normalised name to original; two originals with one normalised name are an error."""
    found = defaultdict(list)
    for n in names:
        found[normalise_name(n)].append(n)
    if clash := {k: v for k, v in found.items() if len(v) > 1}:
        raise ValueError("headers clash after normalisation: " + "; ".join(f"{k} from {', '.join(map(repr, v))}" for k, v in sorted(clash.items())))
    return {k: v[0] for k, v in found.items()}


def _first_bytes(spark: SparkSession, path: str, n: int = 2048) -> str:
    """The beginning of a file, or of a folder's first file, through Spark's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.getFileStatus(at).isDirectory():
        names = sorted(str(s.getPath()) for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", ".")))
        at = jvm.org.apache.hadoop.fs.Path(names[0])
    stream = fs.open(at)
    try:
        return bytes(b & 255 for b in stream.readNBytes(n)).decode("utf-8", "replace")
    finally:
        stream.close()


def _first_record(spark: SparkSession, path: str) -> tuple[str, str]:
    """(first 2 KiB, whole first record) of a CSV file, whatever the record's length and the line ends in its quotes."""
    n = 2048
    head = whole = _first_bytes(spark, path, n)
    while True:
        quotes = accumulate(whole, lambda inside, c: inside ^ (c == '"'), initial=False)
        end = next((i for i, (c, inside) in enumerate(zip(whole, quotes)) if c in "\r\n" and not inside and whole[:i].strip("\ufeff\r\n")), None)
        if end is not None:
            return head, whole[:end]
        if len(whole.encode("utf-8", "replace")) < n:
            return head, whole
        n *= 8
        whole = _first_bytes(spark, path, n)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def read_csv(spark: SparkSession, path: str) -> Dataset:
    """CSV with a header of any length; the delimiter is sniffed from the first 2 KiB, comma in doubt. All values are texts,
    empty ones null; short rows are filled with nulls, surplus cells ignored."""
    head, record = _first_record(spark, path)
    if not head.strip():
        raise ValueError(f"{path}: a CSV file needs a header")
    try:
        dialect = csv.Sniffer().sniff(head)
        delimiter = dialect.delimiter if dialect.delimiter in ",;\t|" else ","
    except csv.Error:
        delimiter = ","
    names = next(csv.reader(io.StringIO(record.lstrip("\ufeff\r\n"), newline=""), delimiter=delimiter))
    originals = normalised_headers(names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in originals])
    df = spark.read.schema(schema).options(header=True, sep=delimiter, escape='"', multiLine=True, enforceSchema=True, nullValue="").csv(path)
    return Dataset(df, "csv", "rows", path, originals)


def read_json(spark: SparkSession, path: str) -> Dataset:
    """One JSON document: an object is one record, a list of objects is many, anything else one record with `value`."""
    first = _first_bytes(spark, path, 256).lstrip("﻿ \t\r\n")[:1]
    if first in ("{", "["):
        whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
        objects = first == "{" or whole.selectExpr("forall(cast(v as array<variant>), x -> schema_of_variant(x) like 'OBJECT%') as o").first().o
        if objects:
            df = spark.read.options(multiLine=True, mode="FAILFAST").json(path)
            return Dataset(df, "json", "object" if first == "{" else "list", path, {n: n for n in df.columns})
    df = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("value"))
    return Dataset(df, "json", "list" if first == "[" else "object", path, {"value": "value"})


def read_jsonl(spark: SparkSession, path: str) -> Dataset:
    """One object a line; blank lines are skipped, other lines fail the read."""
    df = spark.read.option("mode", "FAILFAST").json(path)
    return Dataset(df, "jsonl", "rows", path, {n: n for n in df.columns})


def read_variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines whose records differ in shape: column `record` as VARIANT, in which missing keys and nulls differ."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("record"))


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    """Dispatch on the file's ending."""
    readers = {".csv": read_csv, ".json": read_json, ".jsonl": read_jsonl}
    for ending, reader in readers.items():
        if path.lower().endswith(ending):
            return reader(spark, path)
    if path.lower().rstrip("/").endswith(".parquet"):
        return from_frame(spark.read.parquet(path), "parquet", path)
    raise ValueError(f"unsupported file type: {path}")


def from_frame(df: DataFrame, kind: str = "rows", path: str | None = None) -> Dataset:
    return Dataset(df, kind, "rows", path, {n: n for n in df.columns})


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of several bundles, columns by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_contract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents of a fixed schema, with the contract's issues of each in `issues`."""
    df = spark.read.schema(schema).options(multiLine=True).json(path)
    return df.withColumn("issues", issues_column(F.struct(*df.columns), schema, schema))


def telemetry_rows(spark: SparkSession, path: str) -> DataFrame:
    """Timing sidecars, runs/<run>/*.json, as (run_id, scenario_name, subject_name, case_name, metric_name, value)."""
    case = "struct<name string, runtime_seconds double>"
    subject = f"struct<name string, preparation_seconds double, runtime_seconds double, cases array<{case}>>"
    schema = f"scenarios array<struct<name string, subjects array<{subject}>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    flat = raw.select(run.alias("run_id"), F.inline("scenarios")).select("run_id", F.col("name").alias("scenario_name"), F.inline("subjects"))
    flat = flat.select("run_id", "scenario_name", F.col("name").alias("subject_name"), "preparation_seconds", "runtime_seconds", "cases")
    whole = flat.select("run_id", "scenario_name", "subject_name", F.lit(None).cast("string").alias("case_name"), F.expr("stack(2, 'preparation_seconds', preparation_seconds, 'runtime_seconds', runtime_seconds) as (metric_name, value)"))
    cases = flat.select("run_id", "scenario_name", "subject_name", F.inline("cases")).select("run_id", "scenario_name", "subject_name", F.col("name").alias("case_name"), F.lit("case_runtime_seconds").alias("metric_name"), F.col("runtime_seconds").alias("value"))
    return whole.unionByName(cases).where("value IS NOT NULL")
