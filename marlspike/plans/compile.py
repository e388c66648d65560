"""Mapping programs compiled to one projection of Catalyst expressions.

A step is a column; the target is one nested struct, so that reading a part of it prunes the rest down to the scan. A
record's first error, in the order preconditions, steps, postconditions, assignments, stands beside it: the record is
quarantined, nulled or fails the job, as the caller says. Steps that nothing is assigned from still count with their
errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions.expressions import ExpressionError, compile_expression
from marlspike.functions.paths import build_struct, read_path
from marlspike.functions.values import NULL, Value, as_type, cast_value, common_type, default_value, first_error, literal, map_enum, merge_texts, split_text, truthy, unit_convert
from marlspike.plans.analyze import Issue, analyze, ordered_steps
from marlspike.plans.ir import Condition, Operation, Program, ProgramError

ERROR = "_error"


class CompilationError(ProgramError):
    """A program that the analyzer rejects, with its issues."""

    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(f"{i.code} at {i.location}: {i.message}" for i in issues))
        self.issues = issues


@dataclass(frozen=True)
class CompiledProgram:
    """A program compiled for records of one schema."""

    program: Program
    schema: T.StructType
    target: Value
    error: Column | None

    @property
    def target_type(self) -> T.StructType:
        return self.target.type

    def manifest(self) -> dict:
        return {"version": self.program.version, "digest": self.program.digest(), "source_schema": self.schema.jsonValue(), "target_schema": self.target_type.jsonValue(), "steps": [s.id for s in self.program.steps]}

    def transform(self, df: DataFrame, mode: str = "quarantine", keep: list[str] = (), name: str = "target") -> DataFrame:
        """df's `keep` columns and the target struct. mode: quarantine adds _error, null nulls failed records, fail raises."""
        error = self.error if self.error is not None else F.lit(None).cast("string")
        kept = [F.col(c) for c in keep]
        if mode == "quarantine":
            return df.select(*kept, self.target.col.alias(name), error.alias(ERROR))
        if mode == "null":
            return df.select(*kept, F.when(error.isNull(), self.target.col).alias(name))
        if mode == "fail":
            raised = F.when(error.isNotNull(), F.raise_error(error).cast(self.target_type)).otherwise(self.target.col)
            return df.select(*kept, raised.alias(name))
        raise ValueError(f"unknown mode {mode!r}")

    def split(self, df: DataFrame, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
        """(records that map, records that don't with their _error)."""
        out = self.transform(df, keep=keep)
        return out.where(F.col(ERROR).isNull()).drop(ERROR), out.where(F.col(ERROR).isNotNull())

    def export(self, folder: str) -> list[str]:
        """Write manifest.json and mapping_ir.json; the same program gives the same bytes."""
        out = Path(folder)
        out.mkdir(parents=True, exist_ok=True)
        for name, data in (("manifest.json", self.manifest()), ("mapping_ir.json", self.program.as_dict())):
            (out / name).write_text(json.dumps(data, sort_keys=True, indent=2, default=list) + "\n")
        return ["manifest.json", "mapping_ir.json"]


def _condition(c: Condition, v: Value) -> Column:
    """The error of an unmet condition."""
    if c.kind == "equals":
        want = literal(c.value)
        kind = common_type([v.type, want.type])
        met = as_type(v, kind).col.eqNullSafe(as_type(want, kind).col)
    else:
        met = v.col.isNotNull()
    return F.when(~met, F.lit(f"condition {c.kind} on '{c.ref}' isn't met"))


def _step(op: Operation, sources: dict[str, Value], steps: dict[str, Value]) -> Value:
    one = sources[op.source_ref] if op.source_ref else None
    match op.kind:
        case "copy" | "rename":
            return one
        case "cast":
            return cast_value(one, op.to_type)
        case "map_enum":
            return map_enum(one, op.mapping)
        case "unit_convert":
            return unit_convert(one, op.factor)
        case "split":
            return split_text(one, op.delimiter)
        case "merge":
            return merge_texts([*[sources[r] for r in op.source_refs], *[steps[r] for r in op.step_refs]], op.delimiter)
        case "nest":
            kept = {op.child_keys[r]: steps[r] for r in op.step_refs if not steps[r].dropped}
            out = build_struct(kept) if kept else literal({})
            return out.failing(*[v.error for v in kept.values()])
        case "unnest":
            inner = read_path(one.col, one.type, op.child_path)
            return inner.failing(one.error)
        case "default":
            return default_value(one, op.value)
        case "drop":
            return Value(F.lit(None), NULL, dropped=True)
    names = {**{r: sources[r] for r in op.sources()}, **{r: steps[r] for r in op.step_refs}}
    if op.kind == "derive":
        return compile_expression(op.expression, names)
    good = compile_expression(op.predicate, {"value": one, **names})
    failed = F.when(~truthy(good.col, good.type), F.lit(op.message or f"validation failed: {op.predicate}"))
    return replace(one, error=first_error(one.error, good.error, failed))


def compile_program(program: Program | dict | str, schema: T.StructType) -> CompiledProgram:
    """A program compiled for DataFrames with this schema; rejected programs raise CompilationError with all issues."""
    program = program if isinstance(program, Program) else Program.read(program)
    if issues := analyze(program):
        raise CompilationError(issues)
    sources = {r.id: _root(schema, r.path) for r in program.source_refs}
    # a source reads null for a step's name, as conditions before the steps do
    errors = [_condition(c, sources.get(c.ref, Value(F.lit(None), NULL))) for c in program.preconditions]
    steps: dict[str, Value] = {}
    for s in ordered_steps(program):
        try:
            v = _step(s.operation, sources, {k: replace(v, error=None) for k, v in steps.items()})
        except ExpressionError as err:
            raise CompilationError([Issue("invalid_expression", str(err), f"steps.{s.id}")]) from None
        if v.error is not None:
            errors.append(F.when(v.error.isNotNull(), F.concat(F.lit(f"{s.id}: "), v.error)))
        steps[s.id] = v
    errors += [_condition(c, steps.get(c.ref) or sources[c.ref]) for c in program.postconditions]
    writes: dict[str, Value] = {}
    for a in program.assignments:
        if not steps[a.step_id].dropped:
            writes[a.target_path] = steps[a.step_id]  # of overwriting assignments the last one counts
    target = build_struct(writes) if writes else literal({})
    return CompiledProgram(program, schema, target, first_error(*errors))


def _root(schema: T.StructType, path: str) -> Value:
    head, _, rest = path.partition(".")
    name = head.removesuffix("[]")
    if name not in schema.names:
        return Value(F.lit(None), NULL) if "[]" not in path else read_path(F.lit(None), NULL, path)
    tail = ("[]" if head.endswith("[]") else "") + (f".{rest}" if rest else "")
    column, kind = F.col(f"`{name}`"), schema[name].dataType
    return read_path(column, kind, tail.lstrip(".")) if tail and not tail.startswith("[]") else read_path(F.struct(column.alias(name)), T.StructType([schema[name]]), path) if tail else Value(column, kind)
