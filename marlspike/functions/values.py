"""Typed values: a column, its type and its error, and Python's value semantics on them in Catalyst expressions.

No value here runs Python for a row. What would raise in Python sets the value's error text, and the value is null."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, STR, INT, FLOAT, BOOL = T.NullType(), T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    error: Column | None = None
    dropped: bool = False

    def failing(self, *errors: Column | None) -> Value:
        """The value with more errors; the first one counts."""
        return replace(self, error=first_error(self.error, *errors))


def first_error(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def is_int(t: T.DataType) -> bool:
    return isinstance(t, _INTEGRAL)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, _FRACTIONAL)


def is_number(t: T.DataType) -> bool:
    return is_int(t) or is_float(t)


def literal(value: Any) -> Value:
    """A JSON value as a constant."""
    if value is None:
        return Value(F.lit(None), NULL)
    if isinstance(value, bool):
        return Value(F.lit(value), BOOL)
    if isinstance(value, int):
        return Value(F.lit(value).cast("long"), INT)
    if isinstance(value, float):
        return Value(F.lit(value), FLOAT)
    if isinstance(value, str):
        return Value(F.lit(value), STR)
    if isinstance(value, list | tuple):
        items = [literal(v) for v in value]
        kind = common_type([i.type for i in items])
        return Value(F.array(*[as_type(i, kind).col for i in items]) if items else F.array().cast(T.ArrayType(STR)), T.ArrayType(kind if not isinstance(kind, T.NullType) else STR))
    if isinstance(value, dict):
        items = {str(k): literal(v) for k, v in value.items()}
        if not items:
            return Value(F.create_map().cast(T.MapType(STR, STR)), T.MapType(STR, STR))
        return Value(F.struct(*[v.col.alias(k) for k, v in items.items()]), T.StructType([T.StructField(k, v.type) for k, v in items.items()]))
    raise TypeError(f"not a JSON value: {value!r}")


def common_type(types: list[T.DataType]) -> T.DataType:
    """The type that holds all of them without a change of text: one type, numbers as double, else string."""
    kinds = [t for t in types if not isinstance(t, T.NullType)]
    if not kinds:
        return NULL
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(is_int(k) for k in kinds):
        return INT
    if all(is_number(k) for k in kinds):
        return FLOAT
    return STR


def as_type(v: Value, t: T.DataType) -> Value:
    if v.type == t or isinstance(t, T.NullType):
        return v
    if isinstance(t, T.StringType) and not isinstance(v.type, T.NullType):
        return replace(v, col=py_str(v.col, v.type), type=STR)
    return replace(v, col=v.col.cast(t), type=t)


def _float_text(c: Column) -> Column:
    """Python's repr of a double: shortest digits, plain from 1e-4 up to 1e16."""
    c = c.cast("double")
    s, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    power = F.substring_index(s, "E", -1).try_cast("int")
    exponent = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) > 9, F.abs(power).cast("string")).otherwise(F.concat(F.lit("0"), F.abs(power).cast("string"))))
    return (
        F.when(F.isnan(c), "nan")
        .when(c == float("inf"), "inf")
        .when(c == float("-inf"), "-inf")
        .when(~s.contains("E"), s)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def py_str(c: Column, t: T.DataType) -> Column:
    """Python's str() of a value; null stays null, containers are compact JSON, dates and times ISO text."""
    if isinstance(t, T.StringType):
        return c
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(t, T.FloatType | T.DoubleType):
        return F.when(c.isNotNull(), _float_text(c))
    if isinstance(t, T.ArrayType | T.StructType | T.MapType):
        return F.when(c.isNotNull(), F.to_json(c))
    return c.cast("string")


def truthy(c: Column, t: T.DataType) -> Column:
    """Python's truth of a value; never null."""
    if isinstance(t, T.NullType):
        return F.lit(False)
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if is_number(t):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(t, T.ArrayType | T.MapType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def is_missing(c: Column, t: T.DataType) -> Column:
    """Null, the empty text or the empty list."""
    if isinstance(t, T.NullType):
        return F.lit(True)
    if isinstance(t, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(t, T.ArrayType):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


#: Texts that are boolean, in lower case. Fixed values.
TRUE_TEXTS = ("true", "1", "yes", "y")
FALSE_TEXTS = ("false", "0", "no", "n")


def _each(v: Value, change, what: str) -> Value:
    """change() for each item of a list."""
    inner: list[Value] = []

    def one(x: Column) -> Column:
        inner[:] = [change(Value(x, v.type.elementType))]
        return inner[0].col

    col = F.transform(v.col, one)
    kind = T.ArrayType(inner[0].type)
    out = replace(v, col=col, type=kind)
    if inner[0].error is not None:
        failed = F.exists(v.col, lambda x: F.coalesce(change(Value(x, v.type.elementType)).error.isNotNull(), F.lit(False)))
        out = out.failing(F.when(failed, F.lit(what)))
    return out


def cast_value(v: Value, to: str) -> Value:
    """Cast as in Python: int() of a float's text truncates, booleans read words, lists item by item."""
    kind, what = v.type, f"cannot cast to {to}"
    if to not in ("str", "int", "float", "bool", "list", "dict"):
        return replace(v, col=F.lit(None).cast("string"), type=STR).failing(F.lit(f"unsupported cast type '{to}'"))
    if isinstance(kind, T.ArrayType):
        return _each(v, lambda x: cast_value(x, to), what)
    if isinstance(kind, T.NullType):
        return replace(v, type={"str": STR, "int": INT, "float": FLOAT, "bool": BOOL}.get(to, STR), col=v.col.cast({"int": "long", "float": "double", "bool": "boolean"}.get(to, "string")))
    if to == "str":
        return replace(v, col=py_str(v.col, kind), type=STR)
    if to == "list":
        return replace(v, col=F.when(v.col.isNotNull(), F.array(v.col)), type=T.ArrayType(kind))
    if to == "dict":
        ok = isinstance(kind, T.StructType | T.MapType)
        return v if ok else v.failing(F.when(v.col.isNotNull(), F.lit(what)))
    if to == "bool":
        if isinstance(kind, T.StringType):
            word = F.lower(F.trim(v.col))
            col = F.when(word.isin(*TRUE_TEXTS), True).when(word.isin(*FALSE_TEXTS), False)
        else:
            col = F.when(v.col.isNotNull(), truthy(v.col, kind))
        return replace(v, col=col, type=BOOL).failing(F.when(v.col.isNotNull() & col.isNull(), F.lit(what)))
    if isinstance(kind, T.BooleanType):
        number = v.col.cast("int").cast("double")
    elif is_number(kind) or isinstance(kind, T.StringType):
        number = (F.trim(v.col) if isinstance(kind, T.StringType) else v.col).try_cast("double")
    else:
        number = F.lit(None).cast("double")
    if to == "int":
        # whole numbers keep all their digits
        col = v.col.cast("long") if is_int(kind) else F.when(~F.isnan(number), number.try_cast("long"))
        return replace(v, col=col, type=INT).failing(F.when(v.col.isNotNull() & col.isNull(), F.lit(what)))
    return replace(v, col=number, type=FLOAT).failing(F.when(v.col.isNotNull() & number.isNull(), F.lit(what)))


def map_enum(v: Value, mapping: dict[str, str]) -> Value:
    """The mapping's value for the text of v, else v itself."""
    if isinstance(v.type, T.ArrayType):
        return _each(v, lambda x: map_enum(x, mapping), "")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    text = py_str(v.col, v.type)
    found = F.when(text.isNotNull(), F.try_element_at(table, text))
    return replace(v, col=F.coalesce(found, text), type=STR)


def unit_convert(v: Value, factor: float) -> Value:
    """v times factor; whole numbers by a whole factor stay whole."""
    if isinstance(v.type, T.ArrayType):
        return _each(v, lambda x: unit_convert(x, factor), "cannot convert units")
    if is_int(v.type) and float(factor).is_integer():
        return replace(v, col=v.col.cast("long") * F.lit(int(factor)).cast("long"), type=INT)
    number = cast_value(v, "float")
    return replace(number, col=number.col * F.lit(float(factor)))


def split_text(v: Value, delimiter: str) -> Value:
    """The trimmed pieces that aren't empty; a list's items as texts; null as the empty list."""
    empty = F.array().cast(T.ArrayType(STR))
    if isinstance(v.type, T.ArrayType):
        return replace(v, col=F.coalesce(F.transform(v.col, lambda x: F.coalesce(py_str(x, v.type.elementType), F.lit("None"))), empty), type=T.ArrayType(STR))
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pieces = F.transform(F.split(py_str(v.col, v.type), quoted), F.trim)
    return replace(v, col=F.coalesce(F.filter(pieces, lambda x: x != ""), empty), type=T.ArrayType(STR))


def merge_texts(values: list[Value], delimiter: str | None) -> Value:
    """Texts joined; nulls, dropped values and null items are left out."""
    kept = [v for v in values if not v.dropped and not isinstance(v.type, T.NullType)]
    errors = [v.error for v in values]
    if delimiter is None:
        return Value(F.lit(None).cast("string"), STR, first_error(*errors, F.lit("merge needs a delimiter")))
    parts = [F.transform(v.col, lambda x, t=v.type: py_str(x, t.elementType)) if isinstance(v.type, T.ArrayType) else py_str(v.col, v.type) for v in kept]
    return Value(F.concat_ws(delimiter, *parts) if parts else F.lit(""), STR, first_error(*errors))


def default_value(v: Value | None, value: Any) -> Value:
    """The constant where v is missing; alone without v."""
    constant = literal(value)
    if v is None:
        return constant
    if isinstance(v.type, T.ArrayType) and isinstance(constant.type, T.ArrayType):
        constant = replace(constant, col=constant.col.cast(v.type), type=v.type)
    kind = common_type([v.type, constant.type])
    a, b = as_type(v, kind), as_type(constant, kind)
    return replace(a, col=F.when(is_missing(v.col, v.type), b.col).otherwise(a.col), type=kind)
