"""Mapping programs: source references, steps, target assignments and conditions, in the JSON form that users write."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any

#: The operations of a step. Fixed values.
KINDS = ("copy", "rename", "cast", "map_enum", "unit_convert", "split", "merge", "nest", "unnest", "derive", "default", "drop", "validate")
CONDITION_KINDS = ("exists", "non_null", "equals")


class ProgramError(ValueError):
    """A program that can't be read or compiled."""


def _text(value: Any, what: str) -> str:
    text = str(value or "").strip()
    if not text:
        raise ProgramError(f"{what} must not be blank")
    return text


def _optional(value: Any) -> str | None:
    return (str(value).strip() or None) if value is not None else None


def _only(data: dict, cls: type) -> None:
    extra = set(data) - set(cls.__dataclass_fields__)
    if extra:
        raise ProgramError(f"{cls.__name__}: unknown fields {sorted(extra)}")


@dataclass(frozen=True)
class SourceReference:
    id: str
    path: str
    dtype: str = "str"
    cardinality: str = "one"
    description: str | None = None

    @classmethod
    def read(cls, data: dict) -> SourceReference:
        _only(data, cls)
        return cls(_text(data.get("id"), "source ref id"), _text(data.get("path"), "source ref path"), _text(data.get("dtype", "str"), "dtype"), data.get("cardinality", "one"), data.get("description"))


@dataclass(frozen=True)
class Operation:
    kind: str
    source_ref: str | None = None
    source_refs: tuple[str, ...] = ()
    step_refs: tuple[str, ...] = ()
    child_keys: dict[str, str] = field(default_factory=dict)
    to_type: str | None = None
    mapping: dict[str, str] = field(default_factory=dict)
    from_unit: str | None = None
    to_unit: str | None = None
    factor: float | None = None
    delimiter: str | None = None
    child_path: str | None = None
    expression: str | None = None
    value: Any = None
    predicate: str | None = None
    message: str | None = None

    @classmethod
    def read(cls, data: dict) -> Operation:
        _only(data, cls)
        if data.get("kind") not in KINDS:
            raise ProgramError(f"unknown operation {data.get('kind')!r}")
        texts = {k: _optional(data.get(k)) for k in ("source_ref", "to_type", "from_unit", "to_unit", "child_path", "expression", "predicate", "message")}
        lists = {k: tuple(t for v in data.get(k) or () if (t := str(v).strip())) for k in ("source_refs", "step_refs")}
        keys = {_text(k, "child key ref"): _text(v, "child key") for k, v in (data.get("child_keys") or {}).items()}
        delimiter = data.get("delimiter")
        if delimiter is not None:
            delimiter = delimiter.strip() or None
        return cls(data["kind"], **texts, **lists, child_keys=keys, mapping=dict(data.get("mapping") or {}), factor=data.get("factor"), delimiter=delimiter, value=data.get("value"))

    def sources(self) -> list[str]:
        return [*([self.source_ref] if self.source_ref else []), *self.source_refs]


@dataclass(frozen=True)
class Step:
    id: str
    operation: Operation
    depends_on: tuple[str, ...] = ()
    description: str | None = None

    @classmethod
    def read(cls, data: dict) -> Step:
        _only(data, cls)
        return cls(_text(data.get("id"), "step id"), Operation.read(data["operation"]), tuple(t for v in data.get("depends_on") or () if (t := v.strip())), data.get("description"))

    def upstream(self) -> set[str]:
        return {*self.depends_on, *self.operation.step_refs}


@dataclass(frozen=True)
class Assignment:
    step_id: str
    target_path: str
    allow_overwrite: bool = False
    required: bool = True

    @classmethod
    def read(cls, data: dict) -> Assignment:
        _only(data, cls)
        return cls(_text(data.get("step_id"), "step_id"), _text(data.get("target_path"), "target_path"), bool(data.get("allow_overwrite", False)), bool(data.get("required", True)))


@dataclass(frozen=True)
class Condition:
    ref: str
    kind: str = "exists"
    value: Any = None
    description: str | None = None

    @classmethod
    def read(cls, data: dict) -> Condition:
        _only(data, cls)
        if data.get("kind", "exists") not in CONDITION_KINDS:
            raise ProgramError(f"unknown condition {data.get('kind')!r}")
        return cls(_text(data.get("ref"), "condition ref"), data.get("kind", "exists"), data.get("value"), data.get("description"))


@dataclass(frozen=True)
class Program:
    version: str = "1.0"
    source_refs: tuple[SourceReference, ...] = ()
    steps: tuple[Step, ...] = ()
    assignments: tuple[Assignment, ...] = ()
    preconditions: tuple[Condition, ...] = ()
    postconditions: tuple[Condition, ...] = ()

    @classmethod
    def read(cls, data: dict | str) -> Program:
        data = json.loads(data) if isinstance(data, str) else data
        _only(data, cls)
        parts = {"source_refs": SourceReference, "steps": Step, "assignments": Assignment, "preconditions": Condition, "postconditions": Condition}
        return cls(data.get("version", "1.0"), **{k: tuple(kind.read(x) for x in data.get(k) or ()) for k, kind in parts.items()})

    def as_dict(self) -> dict:
        return asdict(self)

    def digest(self) -> str:
        """SHA-256 of the canonical JSON; names a compiled plan."""
        return hashlib.sha256(json.dumps(self.as_dict(), sort_keys=True, separators=(",", ":"), default=list).encode()).hexdigest()
