"""Patches: compatible changes proposed from a drift report, and their application to schemas and programs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from marlspike.operators.drift import DriftReport
from marlspike.operators.schema import SourceField, SourceSchema, identifier
from marlspike.plans.ir import Operation, Program, SourceReference

#: Type changes that a cast makes safe. Fixed values.
SAFE_CASTS = {("int", "float"), ("float", "int"), ("int", "str"), ("str", "int"), ("float", "str"), ("str", "float")}


class PatchError(ValueError):
    pass


@dataclass(frozen=True)
class Patch:
    """schema: ("add_field", SourceField) | ("add_alias", path, alias) | ("update_field", path, changes);
    program: ("retarget", ref id, path) | ("add_ref", SourceReference) | ("promote_cast", step id, type) | ("extend_enum", step id, mapping)."""

    schema: tuple[tuple, ...] = ()
    program: tuple[tuple, ...] = ()


@dataclass
class Resolution:
    patch: Patch
    decisions: list[dict] = field(default_factory=list)
    unresolved: list[dict] = field(default_factory=list)


def propose_patch(report: DriftReport, schema: SourceSchema, program: Program) -> Resolution:
    """What can be patched safely: renames, additions, safe casts, and enums that only grew. The rest is unresolved."""
    on_schema: list[tuple] = []
    on_program: list[tuple] = []
    out = Resolution(Patch())
    known, refs = schema.by_path(), {r.path: r for r in program.source_refs}
    decide = lambda d, what: out.decisions.append({"kind": d.kind, "target": d.baseline_path or d.candidate_path, "status": "patched", "reason": what})
    for d in report.drifts:
        if d.kind == "renamed":
            if d.baseline_path in known:
                on_schema += [("add_alias", d.baseline_path, d.candidate_path), ("update_field", d.baseline_path, {"path": d.candidate_path})]
            if ref := refs.get(d.baseline_path):
                on_program.append(("retarget", ref.id, d.candidate_path))
            else:
                on_program.append(("add_ref", SourceReference(f"src_{identifier(d.candidate_path)}", d.candidate_path, d.signature.get("dominant_type") or "str", d.signature.get("cardinality") or "one")))
            decide(d, "renamed field keeps its references")
        elif d.kind == "added":
            s = d.signature
            on_schema.append(("add_field", SourceField(d.candidate_path, "", None, s.get("dominant_type") or "str", s.get("cardinality") or "one", True, examples=tuple((s.get("enum_values") or [])[:3]), confidence=0.8).normalised()))
            decide(d, "optional field added")
        elif d.kind == "changed" and set(d.reasons) <= {"type", "numeric_type"} and (ref := refs.get(d.baseline_path)) and (ref.dtype, d.signature.get("dominant_type")) in SAFE_CASTS:
            on_schema.append(("update_field", d.baseline_path, {"dtype": d.signature["dominant_type"]}))
            for s in program.steps:
                if s.operation.kind in ("copy", "rename") and s.operation.source_ref == ref.id:
                    on_program.append(("promote_cast", s.id, ref.dtype))
            decide(d, f"cast back to {ref.dtype}")
        elif d.kind == "changed" and d.reasons == ("enum_values",) and (found := _grown(d, program, refs)):
            on_program += found
            decide(d, "enum mapping extended")
        else:
            out.unresolved.append({"kind": d.kind, "target": d.baseline_path or d.candidate_path, "reason": ", ".join(d.reasons)})
    out.patch = Patch(tuple(on_schema), tuple(on_program))
    return out


def _grown(d, program: Program, refs: dict) -> list[tuple]:
    ref = refs.get(d.baseline_path)
    new = set(d.signature.get("enum_values") or [])
    out = []
    for s in program.steps:
        if ref and s.operation.kind == "map_enum" and s.operation.source_ref == ref.id and new > set(s.operation.mapping):
            out.append(("extend_enum", s.id, {v: v.lower() for v in sorted(new - set(s.operation.mapping))}))
    return out


def apply_to_schema(schema: SourceSchema, patch: Patch) -> SourceSchema:
    fields = {f.path: f for f in schema.fields}
    for op in patch.schema:
        if op[0] == "add_field":
            if op[1].path in fields:
                raise PatchError(f"field '{op[1].path}' is there already")
            fields[op[1].path] = op[1]
            continue
        if op[1] not in fields:
            raise PatchError(f"unknown field '{op[1]}'")
        f = fields[op[1]]
        if op[0] == "add_alias":
            fields[op[1]] = replace(f, aliases=tuple(sorted({*f.aliases, identifier(op[2])})))
        elif op[0] == "update_field":
            fields = {op[2].get("path", k) if k == op[1] else k: replace(v, **op[2]) if k == op[1] else v for k, v in fields.items()}
        else:
            raise PatchError(f"unknown schema operation '{op[0]}'")
    return replace(schema, fields=tuple(fields.values()))


def apply_to_program(program: Program, patch: Patch) -> Program:
    refs = {r.id: r for r in program.source_refs}
    steps = {s.id: s for s in program.steps}

    def step(name: str, wanted: tuple[str, ...], **changes: object) -> None:
        if name not in steps:
            raise PatchError(f"unknown step '{name}'")
        op: Operation = steps[name].operation
        if op.kind not in wanted:
            raise PatchError(f"step '{name}' is {op.kind}, not {' or '.join(wanted)}")
        steps[name] = replace(steps[name], operation=replace(op, **changes))

    for op in patch.program:
        if op[0] == "retarget":
            if op[1] not in refs:
                raise PatchError(f"unknown source ref '{op[1]}'")
            refs[op[1]] = replace(refs[op[1]], path=op[2])
        elif op[0] == "add_ref":
            if op[1].id in refs:
                raise PatchError(f"source ref '{op[1].id}' is there already")
            refs[op[1].id] = op[1]
        elif op[0] == "promote_cast":
            step(op[1], ("copy", "rename", "cast"), kind="cast", to_type=op[2])
        elif op[0] == "extend_enum":
            if op[1] not in steps:
                raise PatchError(f"unknown step '{op[1]}'")
            step(op[1], ("map_enum",), mapping={**steps[op[1]].operation.mapping, **op[2]})
        else:
            raise PatchError(f"unknown program operation '{op[0]}'")
    return replace(program, source_refs=tuple(refs.values()), steps=tuple(steps.values()))
