"""Structural contracts: what of a record doesn't fit a target type, as an array of issues in one column expression.

Types are checked as a lenient model check does: a number's text is a number, a whole float is a whole number, a number is
no text. A field's metadata may say required, default, enum, ge, gt, le."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions.values import FALSE_TEXTS, TRUE_TEXTS, is_float, is_int, is_number, py_str

ISSUE = "struct<code:string,path:string,message:string,input:string>"


def _issue(when: Column, code: str, path: str, message: str, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"), F.lit(message).alias("message"), value.alias("input")))


def _checks(c: Column, have: T.DataType, want: T.StructField, path: str, there: Column) -> list[Column]:
    """Issues of one field, null where there is none; `there` says whether the parent is."""
    meta, kind = want.metadata, want.dataType
    out = []
    if isinstance(have, T.NullType):
        return [_issue(there, "missing", path, "field required", F.lit(None).cast("string"))] if meta.get("required", not want.nullable) else []
    text = py_str(c, have)
    if meta.get("required", not want.nullable):
        out.append(_issue(there & c.isNull(), "missing", path, "field required", text))
    if isinstance(kind, T.StructType):
        if not isinstance(have, T.StructType):
            return [*out, _issue(c.isNotNull(), "object_type", path, "not an object", text)]
        for f in kind.fields:
            inner = have[f.name].dataType if f.name in have.names else T.NullType()
            out += _checks(c.getField(f.name) if f.name in have.names else F.lit(None), inner, f, f"{path}.{f.name}" if path != "$" else f.name, there & c.isNotNull())
        return out
    if isinstance(kind, T.ArrayType):
        if not isinstance(have, T.ArrayType):
            return [*out, _issue(c.isNotNull(), "list_type", path, "not a list", text)]
        item = T.StructField("item", kind.elementType, kind.containsNull, {k: v for k, v in meta.items() if k in ("enum", "ge", "gt", "le")})
        found = F.transform(c, lambda x: F.filter(F.array(*(_checks(x, have.elementType, item, f"{path}[]", F.lit(True)) or [F.lit(None).cast(ISSUE)])).cast(f"array<{ISSUE}>"), lambda i: i.isNotNull()))
        out.append(F.get(F.flatten(found), F.lit(0)))
        return out
    ok, number = F.lit(True), None
    if isinstance(kind, T.StringType):
        ok = F.lit(isinstance(have, T.StringType))
    elif isinstance(kind, T.BooleanType):
        ok = F.lit(True) if isinstance(have, T.BooleanType) else F.lower(c).isin(*TRUE_TEXTS, *FALSE_TEXTS, "on", "off", "t", "f", "n", "y") if isinstance(have, T.StringType) else c.isin(0, 1) if is_number(have) else F.lit(False)
    elif is_int(kind) or is_float(kind):
        if isinstance(have, T.StringType | T.BooleanType) or is_number(have):
            number = (c.cast("int") if isinstance(have, T.BooleanType) else F.trim(c) if isinstance(have, T.StringType) else c).try_cast("double")
            ok = number.isNotNull() if is_float(kind) else number.isNotNull() & (number == F.floor(number))
        else:
            ok = F.lit(False)
    names = {"string": "string_type", "boolean": "bool_parsing", "double": "float_parsing", "float": "float_parsing"}
    out.append(_issue(c.isNotNull() & ~F.coalesce(ok, F.lit(False)), names.get(kind.simpleString(), "int_parsing"), path, f"not a valid {kind.simpleString()}", text))
    if allowed := meta.get("enum"):
        out.append(_issue(c.isNotNull() & ~text.isin(*[str(a) for a in allowed]), "literal_error", path, f"not one of {', '.join(map(str, allowed))}", text))
    if number is not None:
        for name, bad in (("ge", lambda n, b: n < b), ("gt", lambda n, b: n <= b), ("le", lambda n, b: n > b)):
            if name in meta:
                out.append(_issue(F.coalesce(bad(number, meta[name]), F.lit(False)), {"ge": "greater_than_equal", "gt": "greater_than", "le": "less_than_equal"}[name], path, f"must be {name} {meta[name]}", text))
    return out


def issues_column(record: Column, have: T.StructType, want: T.StructType) -> Column:
    """All issues of a record, in the order of the contract's fields; the first issue of each list."""
    checks = _checks(record, have, T.StructField("$", want, False), "$", F.lit(True))
    array = F.array(*[c.cast(ISSUE) for c in checks]) if checks else F.array().cast(f"array<{ISSUE}>")
    return F.filter(array, lambda i: i.isNotNull())


def normalised_output(record: Column, have: T.StructType, want: T.StructType) -> Column:
    """The record in the contract's types: defaults filled in, fields that it doesn't name left out."""
    fields = []
    for f in want.fields:
        if f.name in have.names:
            inner = have[f.name].dataType
            c = record.getField(f.name)
            if isinstance(f.dataType, T.StructType) and isinstance(inner, T.StructType):
                c = F.when(c.isNotNull(), normalised_output(c, inner, f.dataType))
            elif isinstance(f.dataType, T.StringType):
                c = c if isinstance(inner, T.StringType) else F.lit(None).cast("string")
            else:
                c = c.try_cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        if "default" in f.metadata:
            c = F.coalesce(c, F.lit(f.metadata["default"]).cast(f.dataType))
        fields.append(c.alias(f.name))
    return F.struct(*fields)
