"""Dotted paths into records whose type is known, compiled to accessors; and nested writes that build one struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions.values import NULL, STR, Value


def read_path(column: Column, kind: T.DataType, path: str) -> Value:
    """The value at a path: keys, `items[]` for each item of a list, digits for one item.

    A key applied to a list goes to its items. What isn't there is null, or after `[]` the empty list."""
    return _read(column, kind, [p for p in path.split(".") if p])


def _read(column: Column, kind: T.DataType, parts: list[str]) -> Value:
    if not parts:
        return Value(column, kind)
    head, rest = parts[0], parts[1:]
    wild = head.endswith("[]")
    name = head[:-2] if wild else head
    if isinstance(kind, T.ArrayType):
        if name.isdigit() and not wild:
            return _read(F.get(column, F.lit(int(name))), kind.elementType, rest)
        return _items(column, kind, parts)
    if name:
        column, kind = _field(column, kind, name)
    if wild:
        if not isinstance(kind, T.ArrayType):
            return Value(F.array().cast(T.ArrayType(STR)), T.ArrayType(STR))
        return _items(column, kind, rest)
    return _read(column, kind, rest)


def _field(column: Column, kind: T.DataType, name: str) -> tuple[Column, T.DataType]:
    if isinstance(kind, T.StructType) and name in kind.names:
        return column.getField(name), kind[name].dataType
    if isinstance(kind, T.MapType):
        return F.try_element_at(column, F.lit(name)), kind.valueType
    return F.lit(None), NULL


def _items(column: Column, kind: T.ArrayType, rest: list[str]) -> Value:
    inner: list[Value] = []

    def one(x: Column) -> Column:
        inner[:] = [_read(x, kind.elementType, rest)]
        return inner[0].col

    mapped = F.transform(column, one)
    out = T.ArrayType(STR if isinstance(inner[0].type, T.NullType) else inner[0].type)
    return Value(F.coalesce(mapped.cast(out), F.array().cast(out)), out)


def build_struct(writes: dict[str, Value]) -> Value:
    """One nested struct from values at dotted paths, none of which is another's beginning."""
    tree: dict = {}
    for path, v in writes.items():
        node = tree
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = v

    def made(node: dict) -> Value:
        fields = {k: made(v) if isinstance(v, dict) else v for k, v in node.items()}
        return Value(F.struct(*[v.col.alias(k) for k, v in fields.items()]), T.StructType([T.StructField(k, v.type) for k, v in fields.items()]))

    return made(tree)


def remove_path(column: Column, kind: T.DataType, path: str) -> Value:
    """A record without the field at a path. `[]` in it doesn't count; a path that isn't there, or that leads through a list, removes nothing."""
    parts = [p.replace("[]", "") for p in path.split(".") if p]
    return Value(*_without(column, kind, parts)) if parts else Value(column, kind)


def _without(column: Column, kind: T.DataType, parts: list[str]) -> tuple[Column, T.DataType]:
    if not isinstance(kind, T.StructType) or parts[0] not in kind.names:
        return column, kind
    if len(parts) == 1:
        fields = {f.name: (column.getField(f.name), f.dataType) for f in kind.fields if f.name != parts[0]}
    else:
        fields = {f.name: _without(column.getField(f.name), f.dataType, parts[1:]) if f.name == parts[0] else (column.getField(f.name), f.dataType) for f in kind.fields}
    out = T.StructType([T.StructField(n, t) for n, (_, t) in fields.items()])
    return F.when(column.isNotNull(), F.struct(*[c.alias(n) for n, (c, _) in fields.items()]).cast(out)), out
