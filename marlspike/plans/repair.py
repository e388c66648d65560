"""Deterministic repairs of proposed mapping programs: what can be mended without asking for another proposal.

Rules work on a program's JSON form, in a fixed order, and each says what it changed. A rule that finds nothing to mend leaves
the program alone, so that a repaired program is a fixed point."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterable

from pyspark.sql import types as T

from marlspike.plans.ir import Program

#: Helpers that proposals write, and the names that the expression language has for them. Fixed values.
HELPERS = {"coalesce": "first_non_null"}


def _leaf(path: str) -> str:
    return path.replace("[]", "").rpartition(".")[2].lower()


def _fresh(wanted: str, taken: Iterable[str]) -> str:
    taken, name, n = set(taken), wanted, 2
    while name in taken:
        name, n = f"{wanted}_{n}", n + 1
    return name


def _canonical_refs(program: dict, sources: list[str], target: T.StructType | None) -> list[str]:
    """A reference by a source's path, or by another spelling of its id, becomes one by its id; a source path that nothing declares is declared."""
    notes = []
    refs = program.setdefault("source_refs", [])
    by_name: dict[str, str] = {}
    for r in refs:
        for name in (r["id"], r["path"], _leaf(r["path"])):
            by_name.setdefault(name.strip().lower(), r["id"])
    steps = {s["id"] for s in program.get("steps", [])}
    known = {r["id"] for r in refs}

    def resolved(name: str) -> str:
        if name in known or name in steps:
            return name
        if found := by_name.get(name.strip().lower()):
            notes.append(f"reference {name} is {found}")
            return found
        path = next((p for p in sources if name in (p, _leaf(p))), None)
        if path is None:
            return name
        new = _fresh(re.sub(r"\W+", "_", _leaf(path)), known | steps)
        refs.append({"id": new, "path": path, "dtype": "str"})
        known.add(new)
        by_name[name.strip().lower()] = new
        notes.append(f"source {path} declared as {new}")
        return new

    for s in program.get("steps", []):
        op = s["operation"]
        if op.get("source_ref"):
            op["source_ref"] = resolved(op["source_ref"])
        if op.get("source_refs"):
            op["source_refs"] = [resolved(n) for n in op["source_refs"]]
    for group in ("preconditions", "postconditions"):
        for c in program.get(group) or []:
            c["ref"] = resolved(c["ref"])
    return notes


def _copied_sources(program: dict, sources: list[str], target: T.StructType | None) -> list[str]:
    """An assignment of a source, or of a source path, gets a step that copies it."""
    notes = []
    refs, steps = program.setdefault("source_refs", []), program.setdefault("steps", [])
    for a in program.get("assignments", []):
        name = a["step_id"]
        if name in {s["id"] for s in steps}:
            continue
        ref = next((r["id"] for r in refs if name in (r["id"], r["path"])), None)
        if ref is None and name in sources:
            ref = _fresh(re.sub(r"\W+", "_", _leaf(name)), {r["id"] for r in refs} | {s["id"] for s in steps})
            refs.append({"id": ref, "path": name, "dtype": "str"})
        if ref is None:
            continue
        step = next((s["id"] for s in steps if s["operation"] == {"kind": "copy", "source_ref": ref}), None)
        if step is None:
            step = _fresh(f"copy_{ref}", {s["id"] for s in steps} | {r["id"] for r in refs})
            steps.append({"id": step, "operation": {"kind": "copy", "source_ref": ref}})
        a["step_id"] = step
        notes.append(f"{a['target_path']} takes a copy of {ref}")
    return notes


def _known_helpers(program: dict, sources: list[str], target: T.StructType | None) -> list[str]:
    """Calls of helpers under other names; texts in quotes stay."""
    notes = []
    call = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|\b(" + "|".join(HELPERS) + r")(?=\s*\()")
    for s in program.get("steps", []):
        for field in ("expression", "predicate"):
            text = s["operation"].get(field)
            new = call.sub(lambda m: m[1] or HELPERS[m[2]], text) if text else text
            if new != text:
                s["operation"][field] = new
                notes.append(f"{s['id']}: {field} calls {', '.join(sorted(set(HELPERS.values())))}")
    return notes


def _one_surface(program: dict, sources: list[str], target: T.StructType | None) -> list[str]:
    """Preconditions on sources of a step that reads several, of which a record need only have one, go."""
    several = {r for s in program.get("steps", []) if len(refs := s["operation"].get("source_refs") or []) > 1 and "first_non_null(" in (s["operation"].get("expression") or "") for r in refs}
    gone = [c["ref"] for c in program.get("preconditions") or [] if c["ref"] in several]
    if gone:
        program["preconditions"] = [c for c in program["preconditions"] if c["ref"] not in several]
    return [f"precondition on {r} dropped: other sources can take its place" for r in gone]


def _empty_lists(program: dict, sources: list[str], target: T.StructType | None) -> list[str]:
    """Lists of the target that may be absent and that nothing writes are empty."""
    if target is None:
        return []
    notes = []
    steps, assignments = program.setdefault("steps", []), program.setdefault("assignments", [])
    written = {a["target_path"] for a in assignments}

    def visit(kind: T.StructType, prefix: str) -> None:
        for f in kind.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            if path in written:
                continue
            if isinstance(f.dataType, T.StructType) and any(w.startswith(f"{path}.") for w in written):
                visit(f.dataType, path)
            elif isinstance(f.dataType, T.ArrayType) and not f.metadata.get("required", not f.nullable):
                step = _fresh(f"empty_{re.sub(r'\W+', '_', path)}", {s["id"] for s in steps} | {r["id"] for r in program.get("source_refs", [])})
                steps.append({"id": step, "operation": {"kind": "default", "value": []}})
                assignments.append({"step_id": step, "target_path": path})
                notes.append(f"{path} is empty by default")

    visit(target, "")
    return notes


#: In this order: references first, as the others look for ids.
RULES: tuple[Callable[[dict, list[str], T.StructType | None], list[str]], ...] = (_canonical_refs, _copied_sources, _known_helpers, _one_surface, _empty_lists)


def repair(proposal: dict, source_paths: Iterable[str] = (), target: T.StructType | None = None) -> tuple[Program, list[str]]:
    """(program, what was changed) of a proposal in JSON form. What no rule mends is left for the analyzer to report."""
    program, sources = copy.deepcopy(proposal), list(source_paths)
    notes = [n for rule in RULES for n in rule(program, sources, target)]
    return Program.read(program), notes
