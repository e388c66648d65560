"""Semantic assertions, acceptance and the bounded repair loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions.expressions import compile_expression
from marlspike.functions.paths import read_path
from marlspike.functions.values import Value, as_type, cast_value, common_type, literal, map_enum, py_str, truthy
from marlspike.operators.contract import issues_column
from marlspike.plans.compile import ERROR, CompilationError, CompiledProgram, compile_program
from marlspike.plans.ir import Program

SEMANTIC = "struct<name:string,code:string,target_path:string,message:string,expected:string,actual:string>"


@dataclass(frozen=True)
class Assertion:
    """kind: equals, enum_mapping, unit_conversion or predicate."""

    name: str
    kind: str
    target_path: str
    source_path: str | None = None
    expected: Any = None
    mapping: dict[str, str] = field(default_factory=dict)
    factor: float | None = None
    expression: str | None = None


def _same(a: Value, b: Value) -> Column:
    kind = common_type([a.type, b.type])
    return as_type(a, kind).col.eqNullSafe(as_type(b, kind).col)


def semantic_issues(assertions: list[Assertion], source: Value, target: Value) -> Column:
    """Issues of the assertions that a record's source and target don't meet, as one array column."""
    found = []
    for a in assertions:
        actual = read_path(target.col, target.type, a.target_path)
        if a.kind == "predicate":
            if a.expression is None:
                continue
            v = compile_expression(a.expression, {"actual": actual, "source": source, "target": target})
            met = truthy(v.col, v.type) & (v.error.isNull() if v.error is not None else F.lit(True))
            code, expected = "semantic_predicate_failed", Value(F.lit("True"), T.StringType())
        else:
            origin = read_path(source.col, source.type, a.source_path or a.target_path)
            if a.kind == "equals":
                expected = literal(a.expected) if a.expected is not None else origin
            elif a.kind == "enum_mapping":
                expected = map_enum(origin, a.mapping)
            elif a.kind == "unit_conversion":
                number = cast_value(origin, "float")
                expected = Value(number.col * F.lit(float(a.factor)), T.DoubleType()) if a.factor is not None else origin
            else:
                raise ValueError(f"unsupported semantic assertion kind {a.kind!r}")
            met, code = _same(actual, expected), f"semantic_{a.kind}_mismatch"
        parts = [F.lit(a.name), F.lit(code), F.lit(a.target_path), F.lit(f"assertion '{a.name}' isn't met"), py_str(expected.col, expected.type), py_str(actual.col, actual.type)]
        found.append(F.when(~met, F.struct(*parts)).cast(SEMANTIC))
    array = F.array(*found) if found else F.array().cast(f"array<{SEMANTIC}>")
    return F.filter(array, lambda i: i.isNotNull())


def acceptance_cases(df: DataFrame, program: CompiledProgram, contract: T.StructType, assertions: list[Assertion] = (), keep: list[str] = ()) -> DataFrame:
    """keep, target, _error, structural_issues, semantic_issues and the flags execution_success, structural_validity,
    semantic_validity of every record. A record that fails to map is neither structurally nor semantically valid."""
    source = Value(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)
    error = program.error if program.error is not None else F.lit(None).cast("string")
    out = df.select(
        *[F.col(c) for c in keep],
        program.target.col.alias("target"),
        error.alias(ERROR),
        issues_column(program.target.col, program.target_type, contract).alias("structural_issues"),
        semantic_issues(list(assertions), source, program.target).alias("semantic_issues"),
    )
    done = F.col(ERROR).isNull()
    return out.withColumns({"execution_success": done, "structural_validity": done & (F.size("structural_issues") == 0), "semantic_validity": done & (F.size("semantic_issues") == 0)})


def acceptance_report(cases: DataFrame) -> DataFrame:
    """One row: the flags over all cases, case_count and coverage, the share of cases that pass (0 without cases)."""
    passed = F.col("execution_success") & F.col("structural_validity") & F.col("semantic_validity")
    return cases.agg(
        F.count("*").alias("case_count"),
        *[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in ("execution_success", "structural_validity", "semantic_validity")],
        F.coalesce(F.avg(passed.cast("double")), F.lit(0.0)).alias("coverage"),
    )


@dataclass
class Attempt:
    attempt: int
    program: Program
    report: dict | None
    compile_error: str | None
    decision: str


def repair_loop(program: Program, df: DataFrame, contract: T.StructType, assertions: list[Assertion], strategy: Callable[[Program, dict | None, str | None], Program | None], max_iterations: int = 2) -> list[Attempt]:
    """Compile and accept; while that fails, let the strategy patch the program, max_iterations times at most.

    Decisions: accepted, patched, strategy_declined, max_iterations_reached. One Spark action for each attempt."""
    history: list[Attempt] = []
    for attempt in range(max_iterations + 1):
        report = error = None
        try:
            report = acceptance_report(acceptance_cases(df, compile_program(program, df.schema), contract, assertions)).first().asDict()
        except CompilationError as err:
            error = str(err)
        if report and report["execution_success"] and report["structural_validity"] and report["semantic_validity"]:
            history.append(Attempt(attempt, program, report, error, "accepted"))
            break
        if attempt == max_iterations:
            history.append(Attempt(attempt, program, report, error, "max_iterations_reached"))
            break
        patched = strategy(program, report, error)
        history.append(Attempt(attempt, program, report, error, "patched" if patched is not None else "strategy_declined"))
        if patched is None:
            break
        program = patched
    return history


def preflight(program: Program, contract: T.StructType) -> dict:
    """Required targets that nothing writes, and those whose step has a default."""
    written = {a.target_path: a.step_id for a in program.assignments}
    kinds = {s.id: s.operation.kind for s in program.steps}
    required = [f.name for f in contract.fields if f.metadata.get("required", not f.nullable)]
    covered = lambda n: any(p == n or p.startswith(f"{n}.") for p in written)
    return {
        "missing_required": sorted(n for n in required if not covered(n)),
        "defaulted_required": sorted(n for n in required if kinds.get(written.get(n, "")) == "default"),
        "unassigned_steps": sorted(set(kinds) - set(written.values())),
    }
