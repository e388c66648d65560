"""Synthetic drift: ten schema-changing operators on nested records, as struct rewrites.

An operator works on all rows or on those whose index is named. A column has one type for all rows, so a field that an
operator moves in some rows is null, not absent, in the others; to_json() leaves such fields out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions.values import Value, is_number, literal, py_str


def _get(tree: dict, path: str) -> Value | None:
    node = tree
    for p in path.split("."):
        if not isinstance(node, dict) or p not in node:
            return None
        node = node[p]
    return _packed(node) if isinstance(node, dict) else node


def _set(tree: dict, path: str, v: Value) -> None:
    *parents, leaf = path.split(".")
    node = tree
    for p in parents:
        node = node.setdefault(p, {})
        if not isinstance(node, dict):
            raise ValueError(f"'{path}' goes through a value that isn't an object")
    node[leaf] = v


def _drop(tree: dict, path: str) -> None:
    *parents, leaf = path.split(".")
    node = tree
    for p in parents:
        node = node.get(p, {})
    node.pop(leaf, None)
    if parents and not node:
        _drop(tree, ".".join(parents))


def _tree(kind: T.StructType, at: Column | None = None) -> dict:
    out: dict = {}
    for f in kind.fields:
        c = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
        out[f.name] = _tree(f.dataType, c) if isinstance(f.dataType, T.StructType) and f.dataType.fields else Value(c, f.dataType)
    return out


def _packed(node: dict) -> Value:
    """An object; null where all its fields are, as an absent one is."""
    fields = {k: _packed(v) if isinstance(v, dict) else v for k, v in node.items()}
    some = F.lit(False)
    for v in fields.values():
        some = some | v.col.isNotNull()
    return Value(F.when(some, F.struct(*[v.col.alias(k) for k, v in fields.items()])), T.StructType([T.StructField(k, v.type) for k, v in fields.items()]))


def changed_paths(op: dict) -> list[str]:
    match op["kind"]:
        case "rename_field" | "nest_field" | "flatten_field":
            return [op["path"], op["new_path"]]
        case "split_field":
            return [op["path"], *op["new_paths"]]
        case "merge_fields":
            return [*op["paths"], op["new_path"]]
        case "inject_sparse_objects":
            return list(op["keep_paths"])
        case _:
            return [op["path"]]


def apply_operator(df: DataFrame, op: dict, index: str | None = None) -> DataFrame:
    """One operator on the records of df; `index` names the column with a record's number, which stays as it is."""
    chosen = op.get("record_indexes") or []
    if chosen and index is None:
        raise ValueError("record_indexes need an index column")
    here = F.col(index).isin(chosen) if chosen else F.lit(True)
    body = T.StructType([f for f in df.schema.fields if f.name != index])
    tree = _tree(body)
    everywhere = not chosen

    def put(path: str, v: Value) -> None:
        old = _get(tree, path)
        if old is not None and not everywhere and old.type != v.type:  # one column, one type: texts
            old, v = Value(py_str(old.col, old.type), T.StringType()), Value(py_str(v.col, v.type), T.StringType())
        before = old.col if old is not None else F.lit(None).cast(v.type)
        _set(tree, path, v if everywhere else Value(F.when(here, v.col).otherwise(before), v.type))

    def pop(path: str) -> Value | None:
        v = _get(tree, path)
        if v is None:
            return None
        if everywhere:
            _drop(tree, path)
        else:
            _set(tree, path, Value(F.when(~here, v.col), v.type))
        return v

    kind = op["kind"]
    if kind == "add_field":
        put(op["path"], literal(op["value"]))
    elif kind == "drop_optional_field":
        pop(op["path"])
    elif kind in ("rename_field", "nest_field", "flatten_field"):
        if (v := pop(op["path"])) is not None:
            put(op["new_path"], v)
    elif kind == "split_field":
        if (v := pop(op["path"])) is not None:
            parts = F.split(py_str(v.col, v.type), "\\Q" + op.get("separator", " ") + "\\E", 2)
            for i, path in enumerate(op["new_paths"]):
                put(path, Value(F.when(v.col.isNotNull(), F.coalesce(F.get(parts, F.lit(i)), F.lit(""))), T.StringType()))
    elif kind == "merge_fields":
        found = [v for p in op["paths"] if (v := pop(p)) is not None]
        if found:
            put(op["new_path"], Value(F.concat_ws(op.get("separator", " "), *[py_str(v.col, v.type) for v in found]), T.StringType()))
    elif kind == "change_value_format":
        if (v := _get(tree, op["path"])) is not None:
            style, text = op.get("format_style", "stringify"), py_str(v.col, v.type)
            if style != "stringify" and is_number(v.type):
                whole = v.col.cast("long").cast("string")
                text = F.concat(F.lit("P"), whole, F.lit("D")) if style == "duration_iso" else F.concat(whole, F.when(v.col.cast("long") == 1, " day").otherwise(" days"))
            put(op["path"], Value(text, T.StringType()))
    elif kind == "change_enum_surface":
        if (v := _get(tree, op["path"])) is not None:
            text = py_str(v.col, v.type)
            new = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in op["mapping"].items() for x in kv]), text), text) if op.get("mapping") else text
            put(op["path"], Value(F.when(text.isNotNull(), new), T.StringType()))
    elif kind == "inject_sparse_objects":
        kept: dict = {}
        for p in op["keep_paths"]:
            if (v := _get(tree, p)) is not None:
                _set(kept, p, v)
        if everywhere:
            tree = kept
        else:
            keep = set(op["keep_paths"])

            def sparse(node: dict, prefix: str = "") -> None:
                for k, v in list(node.items()):
                    path = prefix + k
                    if path in keep:
                        continue
                    if isinstance(v, dict):
                        sparse(v, f"{path}.")
                    else:
                        node[k] = Value(F.when(~here, v.col), v.type)

            sparse(tree)
    else:
        raise ValueError(f"unsupported operator kind {kind!r}")
    columns = {k: _packed(v) if isinstance(v, dict) else v for k, v in tree.items()}
    return df.select(*([F.col(index)] if index else []), *[v.col.alias(k) for k, v in columns.items()])


def apply_drift(df: DataFrame, spec: dict, index: str | None = None) -> tuple[DataFrame, dict]:
    """(records after all operators of a spec, manifest)."""
    for op in spec["operators"]:
        df = apply_operator(df, op, index)
    paths: Iterable[str] = (p for op in spec["operators"] for p in changed_paths(op))
    indexes = sorted({i for op in spec["operators"] for i in op.get("record_indexes") or []})
    return df, {"drift_id": spec["drift_id"], "drift_type": spec["drift_type"], "severity": spec["severity"], "compatibility_class": spec["compatibility_class"], "operator_sequence": [op["kind"] for op in spec["operators"]], "changed_paths": list(dict.fromkeys(paths)), "changed_record_indexes": indexes, "notes": list(spec.get("notes", []))}
