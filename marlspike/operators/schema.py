"""Source schema contracts: fields with names, aliases and confidence; their normal form and the merge of candidates."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


def identifier(text: str) -> str:
    """Lower case, everything else than letters and digits as one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", text.strip().lower()).strip("_")


@dataclass(frozen=True)
class SourceField:
    path: str
    semantic_name: str = ""
    description: str | None = None
    dtype: str = "str"
    cardinality: str = "one"
    nullable: bool = False
    aliases: tuple[str, ...] = ()
    unit: str | None = None
    examples: tuple[str, ...] = ()
    confidence: float = 1.0

    def normalised(self) -> SourceField:
        path = self.path.strip()
        leaf = path.replace("[]", "").split(".")[-1]
        name = identifier(self.semantic_name or leaf)
        aliases = {identifier(a) for a in (*self.aliases, leaf, name)} - {""}
        return replace(self, path=path, semantic_name=name, dtype=self.dtype.strip().lower(), cardinality="many" if path.endswith("[]") else self.cardinality, aliases=tuple(sorted(aliases)), unit=(self.unit or "").strip() or None)


@dataclass(frozen=True)
class SourceSchema:
    source_name: str
    fields: tuple[SourceField, ...] = field(default_factory=tuple)
    source_format: str = "rows"
    root_type: str = "rows"
    schema_fingerprint: str = ""

    def normalised(self) -> SourceSchema:
        return replace(self, fields=tuple(sorted((f.normalised() for f in self.fields), key=lambda f: (f.semantic_name, f.path))))

    def by_path(self) -> dict[str, SourceField]:
        return {f.path: f for f in self.fields}


def _vote(values: list) -> object:
    counts = Counter(v for v in values if v is not None)
    return min(counts, key=lambda v: (-counts[v], str(v))) if counts else None


def merge_candidates(candidates: list[SourceSchema]) -> SourceSchema:
    """One schema from several: fields with one path, or that share a name that isn't a part of either's path alone, are
    one; text by vote (most, then first in order), the longest description, mean confidence."""
    if not candidates:
        raise ValueError("no candidates")
    clusters: list[list[SourceField]] = []
    fields = sorted((f.normalised() for c in candidates for f in c.fields), key=lambda f: (f.path, f.semantic_name, f.dtype))
    for f in fields:
        for cluster in clusters:
            if any(f.path == g.path or (f.cardinality == g.cardinality and f.semantic_name == g.semantic_name and set(f.aliases) & set(g.aliases)) for g in cluster):
                cluster.append(f)
                break
        else:
            clusters.append([f])
    merged = []
    for c in clusters:
        texts = sorted({f.description for f in c if f.description}, key=lambda d: (-len(d), d))
        merged.append(
            SourceField(
                _vote([f.path for f in c]),
                _vote([f.semantic_name for f in c]),
                texts[0] if texts else None,
                _vote([f.dtype for f in c]),
                _vote([f.cardinality for f in c]),
                any(f.nullable for f in c),
                tuple(sorted({a for f in c for a in (*f.aliases, identifier(f.path))})),
                _vote([f.unit for f in c]),
                tuple(list(dict.fromkeys(e for f in c for e in f.examples))[:5]),
                round(sum(f.confidence for f in c) / len(c), 4),
            )
        )
    first = candidates[0]
    return SourceSchema(_vote([c.source_name for c in candidates]), tuple(merged), first.source_format, first.root_type, _vote([c.schema_fingerprint for c in candidates]) or "").normalised()


def complete_schema(schema: SourceSchema, profile_rows: list[dict]) -> SourceSchema:
    """schema with a field for every profiled path that it lacks."""
    known = schema.by_path()
    more = [SourceField(r["path"], "", None, r["dominant_type"], r["cardinality"], r["present_ratio"] < 1 or r["null_ratio"] > 0, examples=tuple((r.get("sample_values") or [])[:3]), confidence=0.5).normalised() for r in profile_rows if r["path"] not in known]
    return replace(schema, fields=tuple(sorted((*schema.fields, *more), key=lambda f: (f.semantic_name, f.path))))


def semantic_coverage(schema: SourceSchema, required: list[str]) -> dict[str, list[str]]:
    """For each required semantic name the paths of the fields whose names hold all its words."""
    words = lambda t: set(identifier(t).split("_"))
    return {r: sorted(f.path for f in schema.fields if any(words(r) <= words(a) for a in (f.semantic_name, *f.aliases))) for r in required}


def target_card(schema: T.StructType, prefix: str = "") -> list[dict]:
    """A target type as nested cards: path, type, required, default, enum, description, children."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        kind = f.dataType
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        card = {"path": path, "type": f"list[{inner.simpleString() if not isinstance(inner, T.StructType) else 'object'}]" if isinstance(kind, T.ArrayType) else "object" if isinstance(kind, T.StructType) else kind.simpleString(), "required": bool(f.metadata.get("required", not f.nullable)), "default": f.metadata.get("default"), "enum": list(f.metadata.get("enum", [])), "description": f.metadata.get("comment")}
        card["children"] = target_card(inner, path) if isinstance(inner, T.StructType) else []
        out.append(card)
    return out


def schema_of_card(cards: list[dict]) -> T.StructType:
    """The target type of target_card()'s cards."""
    fields = []
    for c in cards:
        many = c["type"].startswith("list[")
        inner = schema_of_card(c["children"]) if c["children"] else T._parse_datatype_string(c["type"][5:-1] if many else c["type"])
        meta = {k: v for k, v in (("required", c["required"]), ("default", c["default"]), ("enum", c["enum"] or None), ("comment", c["description"])) if v is not None}
        fields.append(T.StructField(c["path"].split(".")[-1], T.ArrayType(inner) if many else inner, True, meta))
    return T.StructType(fields)
