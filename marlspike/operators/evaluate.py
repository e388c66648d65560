"""Evaluation: case accuracy, run metrics, experiment roll-ups, telemetry and candidate ranking, as DataFrame aggregates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions.values import py_str
from marlspike.plans.analyze import analyze
from marlspike.plans.ir import Program

#: Tags that become dimensions. Fixed values.
DIMENSIONS = ("bundle_kind", "dataset_id", "template_id", "drift_id", "drift_type", "severity", "compatibility_class")


def leaf_columns(kind: T.DataType, at: Column, prefix: str = "") -> list[tuple[str, Column]]:
    """(path, text) of an object's leaves; lists are leaves."""
    if not isinstance(kind, T.StructType):
        return [(prefix, py_str(at, kind))]
    return [x for f in kind.fields for x in leaf_columns(f.dataType, at.getField(f.name), f"{prefix}.{f.name}" if prefix else f.name)]


def case_accuracy(df: DataFrame, expected: str, actual: str, required: list[str] | None = None) -> DataFrame:
    """df with `accuracy`: matched and total leaves of expected, all and required, and their ratios (0 without leaves).

    Leaves that expected hasn't don't count; a null in it is a leaf. Without `required` all leaves are."""
    want = leaf_columns(df.schema[expected].dataType, F.col(expected))
    have = dict(leaf_columns(df.schema[actual].dataType, F.col(actual)))
    match = {p: c.eqNullSafe(have[p]).cast("long") if p in have else F.lit(0).cast("long") for p, c in want}
    need = [p for p in match if required is None or p in required]
    total = lambda names: sum((match[p] for p in names), F.lit(0).cast("long"))
    ratio = lambda names: (total(names) / len(names)).cast("double") if names else F.lit(0.0)
    parts = {"matched": total(match), "total": F.lit(len(match)).cast("long"), "matched_required": total(need), "total_required": F.lit(len(need)).cast("long"), "ratio": ratio(list(match)), "required_ratio": ratio(need)}
    return df.withColumn("accuracy", F.struct(*[c.alias(n) for n, c in parts.items()]))


def run_metrics(cases: DataFrame, by: list[str] = ()) -> DataFrame:
    """Metrics of cases (execution_success, structural_validity, semantic_validity, accuracy), for each group of `by`."""
    a = lambda n: F.col("accuracy")[n]
    share = lambda x, y: F.coalesce(F.try_divide(F.sum(x).cast("double"), F.sum(y).cast("double")), F.lit(0.0))
    exact = (a("matched") == a("total")) & (a("total") > 0) & F.col("execution_success")
    valid = exact & F.coalesce(F.col("structural_validity"), F.lit(True)) & F.coalesce(F.col("semantic_validity"), F.lit(True))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return cases.groupBy(*by).agg(
        F.count("*").alias("case_count"),
        share(a("matched_required"), a("total_required")).alias("required_accuracy"),
        F.avg(a("ratio")).alias("macro_accuracy"),
        share(a("matched"), a("total")).alias("micro_accuracy"),
        F.bool_and(valid).cast("double").alias("pass_at_1"),
        F.avg(valid.cast("double")).alias("coverage"),
        rate("execution_success").alias("execution_success_rate"),
        rate("structural_validity").alias("structural_validity_rate"),
        rate("semantic_validity").alias("semantic_validity_rate"),
    )


def tag_dimensions(df: DataFrame, tags: str = "tags") -> DataFrame:
    """df with a column for each dimension, from tags like `severity:high`; the first counts, a missing one is null."""
    value = lambda d: F.regexp_extract(F.get(F.filter(tags, lambda t: t.startswith(f"{d}:")), F.lit(0)), r"^[^:]*:(.*)$", 1)
    return df.withColumn(tags, F.array_distinct(tags)).withColumns({d: value(d) for d in DIMENSIONS})


def metric_rows(df: DataFrame, metrics: list[str], group: str = "benchmark") -> DataFrame:
    """Unpivot metric columns to (metric_group, metric_name, value); null metrics have no row."""
    rest = [c for c in df.columns if c not in metrics]
    return df.unpivot(rest, metrics, "metric_name", "value").where("value IS NOT NULL").withColumn("metric_group", F.lit(group))


def _statistics(v: Column, run: str) -> list[Column]:
    """run_count and statistics of a value, the quartiles in one array; they interpolate between ranks. Runs are few: a group holds each id once."""
    return [F.size(F.collect_set(run)).cast("long").alias("run_count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")]


def summary_stats(df: DataFrame, keys: list[str], value: str = "value", run: str = "run_id") -> DataFrame:
    """run_count and eight statistics of a value by keys."""
    out = df.groupBy(*keys).agg(*_statistics(F.col(value), run))
    q1, median, q3 = (F.col("q")[i] for i in range(3))
    return out.select(*keys, "run_count", "mean", median.alias("median"), "stdev", "min", "max", q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"))


#: Roll-ups, and the columns that they group by; the last three are of drift bundles alone. Fixed values.
ROLL_UPS = (("scenario", "scenario_name"), ("bundle_kind", "bundle_kind"), ("drift_type", "drift_type"), ("severity", "severity"), ("compatibility", "compatibility_class"))


def summarise(rows: DataFrame) -> DataFrame:
    """The five roll-ups of metric rows in one aggregate: by scenario, bundle kind, drift type, severity and compatibility class."""
    groups = []
    for kind, column in ROLL_UPS:
        there = F.col(column).isNotNull() & (F.col(column) != "")
        if kind in ("drift_type", "severity", "compatibility"):
            there = there & (F.col("bundle_kind") == "drift")
        groups.append(F.when(there, F.struct(F.lit(kind).alias("group_type"), F.concat_ws(" / ", F.col(column), F.col("subject_name")).alias("group_label"))))
    each = rows.withColumn("g", F.explode(F.filter(F.array(*groups), lambda g: g.isNotNull()))).select("*", "g.*")
    return summary_stats(each, ["group_type", "group_label", "subject_name", "metric_group", "metric_name"])


def runtime_valid() -> Column:
    """Whether a case ran, and was valid in both ways where both were asked."""
    both = F.col("structural_validity") & F.col("semantic_validity")
    return F.col("execution_success") & F.coalesce(both, F.col("structural_validity").isNull() | F.col("semantic_validity").isNull())


def stage_metrics(cases: DataFrame, by: list[str] = (), prepared: bool = True, coverage: float | None = None, overrides: dict[str, float | bool] | None = None) -> DataFrame:
    """Rates of each stage over the cases of each group of `by`: flags that are null don't count, and a rate without flags is null.

    coverage, of an acceptance report, is the runtime rate where it is given; overrides are what the caller measured, and come first."""
    rate = lambda c: F.avg(c.cast("double"))
    found = {
        "build_success": F.lit(float(prepared)),
        "execution_success_rate": F.coalesce(rate(F.col("execution_success")), F.lit(0.0)),
        "runtime_validity_rate": F.coalesce(rate(runtime_valid()), F.lit(0.0)) if coverage is None else F.lit(float(coverage)),
        "structural_validity_rate": rate(F.col("structural_validity")),
        "semantic_validity_rate": rate(F.col("semantic_validity")),
        "source_structure_recovery": F.lit(None).cast("double"),
        "mapping_quality": F.lit(None).cast("double"),
    }
    found |= {k: F.lit(float(v)) for k, v in (overrides or {}).items() if v is not None}
    return cases.groupBy(*by).agg(*[c.alias(k) for k, c in found.items()])


def observation_metrics(cases: DataFrame, by: list[str]) -> DataFrame:
    """Long rows (by, metric_group, metric_name, value) of the run's metrics and its stages, those without a value left out."""
    names = ["required_accuracy", "macro_accuracy", "micro_accuracy", "pass_at_1", "coverage"]
    runs = metric_rows(run_metrics(cases, by).select(*by, *names), names)
    stages = stage_metrics(cases, by)
    named = metric_rows(stages, [c for c in stages.columns if c not in by], "stage").withColumn("metric_name", F.concat(F.lit("stage."), "metric_name"))
    return runs.unionByName(named)


def zip_with_gold(df: DataFrame, raw: str, gold: str, keep: list[str] = ()) -> DataFrame:
    """keep, position, raw and gold: the items of two lists of a row, matched by position; lists of unequal length are an error."""
    same = F.coalesce(F.size(raw), F.lit(0)) == F.coalesce(F.size(gold), F.lit(0))
    checked = F.when(same, F.arrays_zip(F.col(raw).alias("raw"), F.col(gold).alias("gold"))).otherwise(F.raise_error(F.lit(f"{raw} and {gold} have not the same length")))
    return df.select(*keep, F.posexplode(checked).alias("position", "pair")).select(*keep, "position", F.col("pair.raw").alias("raw"), F.col("pair.gold").alias("gold"))


@dataclass(frozen=True)
class Scenario:
    """A named input with what is expected of it: columns of df and an `expected` struct, one row for each case `name`."""

    name: str
    df: DataFrame
    tags: tuple[str, ...] = ()


def bundle_tags(bundle: dict) -> tuple[str, ...]:
    """What a bundle's scenario is tagged with: its kind and origin, and its drift."""
    tags = ["synthetic", bundle["bundle_kind"], f"bundle_kind:{bundle['bundle_kind']}", f"dataset:{bundle['bundle_id']}", f"template:{bundle['template'].get('template_id', 'base')}"]
    if drift := bundle.get("drift_manifest"):
        tags += ["drift", *(f"{k}:{drift[k]}" for k in ("drift_id", "drift_type", "severity")), f"compatibility:{drift['compatibility_class']}"]
    return tuple(dict.fromkeys(tags))


def scenario_of_bundles(spark: SparkSession, name: str, bundles: list[dict], record: str, expected: T.StructType, tags: tuple[str, ...] = ()) -> Scenario:
    """One case for each bundle: its raw rendering as the columns of schema `record`, its gold one as `expected`; the case's name is the bundle's id.

    Raw renderings must be objects."""
    if wrong := [b["bundle_id"] for b in bundles if not isinstance(b["l0"], dict)]:
        raise TypeError(f"raw renderings must be objects, those of {', '.join(wrong)} are lists")
    rows = [(b["bundle_id"], json.dumps(b["l0"]), json.dumps(b["l1"])) for b in bundles]
    texts = spark.createDataFrame(rows, "name string, raw string, gold string")
    df = texts.select("name", F.from_json("raw", record).alias("r"), F.from_json("gold", expected).alias("expected")).select("name", "r.*", "expected")
    return Scenario(name, df, tuple(dict.fromkeys([*(t for b in bundles for t in bundle_tags(b)), *tags])))


@dataclass(frozen=True)
class Subject:
    """Something that converts: DataFrame with name and expected in, the same with `actual` and _error out."""

    name: str
    prepare: Callable[[], Callable[[DataFrame], DataFrame]]
    kind: str = "callable"

    @classmethod
    def from_program(cls, name: str, compile_: Callable) -> Subject:
        return cls(name, lambda: lambda df: compile_(df.schema).transform(df, keep=["name", "expected"], name="actual"), "program")


def run_benchmark(subjects: list[Subject], scenarios: list[Scenario], run_id: str = "run-001") -> tuple[DataFrame, list[dict]]:
    """(case results of every subject on every scenario, telemetry). A subject that can't be prepared fails all cases.

    Subjects times scenarios is a driver loop over plans; the cases of each are one projection."""
    out, telemetry = None, []
    for scenario in scenarios:
        for subject in subjects:
            began = perf_counter()
            try:
                convert = subject.prepare()
                cases = convert(scenario.df)
                failed = None
            except Exception as err:  # the subject's own failure is a result
                cases = scenario.df.select("name", "expected", F.lit(None).cast(scenario.df.schema["expected"].dataType).alias("actual"), F.lit(f"{type(err).__name__}: {err}").alias("_error"))
                failed = str(err)
            telemetry.append({"run_id": run_id, "scenario_name": scenario.name, "subject_name": subject.name, "metric_name": "preparation_seconds", "value": perf_counter() - began, "error": failed})
            done = F.col("_error").isNull()
            scored = case_accuracy(cases, "expected", "actual")
            zero = F.struct(*[(F.lit(0).cast(f.dataType) if f.name.startswith("matched") or f.name.endswith("ratio") else F.col("accuracy")[f.name]).alias(f.name) for f in scored.schema["accuracy"].dataType.fields])
            rows = scored.select(
                F.lit(run_id).alias("run_id"),
                F.lit(scenario.name).alias("scenario_name"),
                F.lit(subject.name).alias("subject_name"),
                F.lit(subject.kind).alias("subject_kind"),
                F.array(*[F.lit(t) for t in dict.fromkeys(scenario.tags)]).cast("array<string>").alias("tags"),
                "name",
                done.alias("execution_success"),
                F.col("_error").alias("error"),
                F.when(done, F.col("accuracy")).otherwise(zero).alias("accuracy"),
                F.lit(None).cast("boolean").alias("structural_validity"),
                F.lit(None).cast("boolean").alias("semantic_validity"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out, telemetry


def run_repeated(subjects: list[Subject], scenarios: list[Scenario], runs: int = 3) -> tuple[DataFrame, list[dict]]:
    """run_benchmark() as run-001, run-002 ..."""
    out, telemetry = None, []
    for i in range(1, runs + 1):
        rows, times = run_benchmark(subjects, scenarios, f"run-{i:03d}")
        out = rows if out is None else out.unionByName(rows)
        telemetry += times
    return out, telemetry


def attach_acceptance(cases: DataFrame, accepted: DataFrame) -> DataFrame:
    """Case results with the acceptance flags of the same name; of repeated names one report counts."""
    flags = ["execution_success", "structural_validity", "semantic_validity"]
    one = accepted.groupBy("name").agg(F.max_by(F.struct(*flags), F.struct(*flags)).alias("f")).select("name", *[F.col(f"f.{c}").alias(f"a_{c}") for c in flags])
    out = cases.join(one, "name", "left")
    return out.withColumns({c: F.coalesce(f"a_{c}", c) for c in flags[1:]}).drop(*[f"a_{c}" for c in flags])


@dataclass(frozen=True)
class Ranked:
    program: Program
    valid: bool
    coverage: float
    score: float
    issues: tuple = field(default=())


def rank_candidates(programs: list[Program], source_paths: list[str] | None, wanted: list[str]) -> list[Ranked]:
    """Candidates by 1000 for validity, 100 for the share of wanted target paths, 1 for each path, less 25 for each issue;
    ties by digest. The best comes first."""
    out = []
    for p in programs:
        issues = analyze(p, source_paths)
        paths = {a.target_path for a in p.assignments}
        coverage = len(paths & set(wanted)) / len(wanted) if wanted else 0.0
        out.append(Ranked(p, not issues, coverage, 1000.0 * (not issues) + 100.0 * coverage + len(paths) - 25.0 * len(issues), tuple(issues)))
    return sorted(out, key=lambda r: (-r.score, hashlib.sha256(json.dumps(r.program.as_dict(), sort_keys=True, default=list).encode()).hexdigest()))


def smoke_score(executed: float, structural: float, required: float, errors: int) -> float:
    """A candidate's score on sampled cases."""
    return max(0.0, round(4 * executed + 2 * structural + 4 * required - 0.01 * min(errors, 100), 6))


def telemetry_frame(spark: SparkSession, telemetry: list[dict]) -> DataFrame:
    return spark.createDataFrame([{k: v for k, v in t.items() if k != "error"} for t in telemetry], "run_id string, scenario_name string, subject_name string, metric_name string, value double")
