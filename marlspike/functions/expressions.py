"""The expression language of derive and validate steps: a subset of Python, parsed to an AST and compiled to columns.

Nothing is evaluated in Python. An expression's errors (division by zero, an order on null, an index out of range) are
collected as error texts under the conditions in which Python would raise them."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions.values import BOOL, FLOAT, INT, NULL, STR, Value, as_type, cast_value, common_type, first_error, is_float, is_int, is_missing, is_number, literal, py_str, truthy

#: The functions an expression may call. Fixed values.
FUNCTIONS = ("bool", "first_non_null", "float", "int", "len", "max", "min", "round", "sorted", "str", "sum")
_BINARY = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod)
_UNARY = (ast.Not, ast.UAdd, ast.USub)
_COMPARE = (ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn)
_PLAIN = (ast.Expression, ast.BoolOp, ast.IfExp, ast.List, ast.Tuple, ast.Subscript, ast.Slice, ast.Load, ast.And, ast.Or, ast.BinOp, ast.UnaryOp, ast.Compare, *_BINARY, *_UNARY, *_COMPARE)


class ExpressionError(ValueError):
    """An expression outside the language."""


def parse(text: str) -> ast.Expression:
    try:
        return ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError) as err:
        raise ExpressionError(f"cannot parse expression: {err}") from None


def check_expression(text: str, names: set[str]) -> str | None:
    """What is wrong with an expression over these names, if anything."""
    try:
        tree = parse(text)
    except ExpressionError as err:
        return str(err)
    called = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            if not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS or node.func.id in names:
                return f"call of {ast.unparse(node.func)} isn't allowed"
            if any(isinstance(a, ast.Starred) for a in node.args) or any(k.arg is None for k in node.keywords):
                return "starred arguments aren't allowed"
            called.add(id(node.func))
        elif isinstance(node, ast.Name):
            if node.id not in names and node.id not in FUNCTIONS:
                return f"unknown name '{node.id}'"
        elif isinstance(node, ast.Constant):
            if not isinstance(node.value, str | int | float | bool | None):
                return f"constant {node.value!r} isn't allowed"
        elif isinstance(node, ast.Dict):
            if any(k is None for k in node.keys):
                return "starred items aren't allowed"
        elif not isinstance(node, (*_PLAIN, ast.keyword)):
            return f"{type(node).__name__} isn't allowed"
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and node.id in FUNCTIONS and node.id not in names and id(node) not in called:
            return f"function '{node.id}' can only be called"
    return None


def compile_expression(text: str, names: dict[str, Value]) -> Value:
    """The value of an expression over named values."""
    if wrong := check_expression(text, set(names)):
        raise ExpressionError(wrong)
    return _Compiler(names).visit(parse(text).body)


def _any_null(*values: Value) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | v.col.isNull()
    return out


def _fails(when: Column, message: str) -> Column:
    return F.when(when, F.lit(message))


class _Compiler(ast.NodeVisitor):
    def __init__(self, names: dict[str, Value]):
        self.names = names

    def visit_Constant(self, node: ast.Constant) -> Value:
        return literal(node.value)

    def visit_Name(self, node: ast.Name) -> Value:
        return self.names[node.id]

    def visit_BoolOp(self, node: ast.BoolOp) -> Value:
        values = [self.visit(v) for v in node.values]  # all are evaluated
        out = truthy(values[0].col, values[0].type)
        for v in values[1:]:
            out = out & truthy(v.col, v.type) if isinstance(node.op, ast.And) else out | truthy(v.col, v.type)
        return Value(out, BOOL, first_error(*[v.error for v in values]))

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Value:
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return replace(v, col=~truthy(v.col, v.type), type=BOOL)
        v = self._number(v)
        v = v.failing(_fails(v.col.isNull(), "bad operand for a sign: null"))
        return v if isinstance(node.op, ast.UAdd) else replace(v, col=-v.col)

    @staticmethod
    def _number(v: Value) -> Value:
        if isinstance(v.type, T.BooleanType):
            return replace(v, col=v.col.cast("int").cast("long"), type=INT)
        if is_int(v.type):
            return replace(v, col=v.col.cast("long"), type=INT)
        if is_float(v.type):
            return replace(v, col=v.col.cast("double"), type=FLOAT)
        if isinstance(v.type, T.NullType):
            return replace(v, col=F.lit(None).cast("double"), type=FLOAT)
        raise ExpressionError(f"arithmetic on {v.type.simpleString()}")

    def visit_BinOp(self, node: ast.BinOp) -> Value:
        a, b, op = self.visit(node.left), self.visit(node.right), node.op
        errors = [a.error, b.error]
        if isinstance(op, ast.Add) and isinstance(a.type, T.StringType | T.ArrayType) and type(a.type) is type(b.type):
            b = as_type(b, a.type)
            return Value(F.concat(a.col, b.col), a.type, first_error(*errors, _fails(_any_null(a, b), "bad operand for +: null")))
        if isinstance(op, ast.Mult) and (isinstance(a.type, T.StringType) and is_int(b.type) or is_int(a.type) and isinstance(b.type, T.StringType)):
            text, n = (a, b) if isinstance(a.type, T.StringType) else (b, a)
            return Value(F.repeat(text.col, n.col.cast("int")), STR, first_error(*errors, _fails(_any_null(a, b), "bad operand for *: null")))
        a, b = self._number(a), self._number(b)
        errors.append(_fails(_any_null(a, b), "bad operand for arithmetic: null"))
        whole = is_int(a.type) and is_int(b.type)
        x, y = (a.col, b.col) if whole else (a.col.cast("double"), b.col.cast("double"))
        kind = INT if whole else FLOAT
        if isinstance(op, ast.Add | ast.Sub | ast.Mult):
            f = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[type(op)]
            out = f(x, y)
            if whole:
                errors.append(_fails(~_any_null(a, b) & out.isNull(), "integer too large"))
            return Value(out, kind, first_error(*errors))
        errors.append(_fails(y == 0, "division by zero"))
        z = F.when(y != 0, y)
        if isinstance(op, ast.Div):
            return Value(F.try_divide(x.cast("double"), z.cast("double")), FLOAT, first_error(*errors))
        rest = F.when(z > 0, F.pmod(x, z)).otherwise(-F.pmod(-x, -z))
        if isinstance(op, ast.Mod):
            return Value(rest, kind, first_error(*errors))
        out = F.call_function("div", x - rest, z) if whole else F.floor(F.try_divide(x, z)).cast("double")
        return Value(out, kind, first_error(*errors))

    def visit_Compare(self, node: ast.Compare) -> Value:
        values = [self.visit(v) for v in (node.left, *node.comparators)]
        out, errors = None, [v.error for v in values]
        for op, a, b in zip(node.ops, values, values[1:], strict=False):
            c, error = self._compare(op, a, b)
            if error is not None:
                errors.append(error if out is None else F.when(out, error))  # a chain stops at the first false
            out = c if out is None else out & c
        return Value(out, BOOL, first_error(*errors))

    def _compare(self, op: ast.cmpop, a: Value, b: Value) -> tuple[Column, Column | None]:
        if isinstance(op, ast.In | ast.NotIn):
            c, error = self._contains(a, b)
            return (~c if isinstance(op, ast.NotIn) else c), error
        comparable = a.type == b.type or {True} == {is_number(t) or isinstance(t, T.BooleanType) for t in (a.type, b.type)} or isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType)
        if isinstance(op, ast.Eq | ast.NotEq):
            if not comparable and not (isinstance(a.type, T.ArrayType | T.StructType) and type(a.type) is type(b.type)):
                same = a.col.isNull() & b.col.isNull()
            else:
                a2, b2 = (self._number(a), self._number(b)) if a.type != b.type and not isinstance(a.type, T.NullType) and not isinstance(b.type, T.NullType) and is_number(a.type) | isinstance(a.type, T.BooleanType) else (a, b)
                same = a2.col.eqNullSafe(b2.col)
            return (~same if isinstance(op, ast.NotEq) else same), None
        if not comparable:
            return F.lit(False), F.lit(f"no order between {a.type.simpleString()} and {b.type.simpleString()}")
        c = {ast.Lt: a.col < b.col, ast.LtE: a.col <= b.col, ast.Gt: a.col > b.col, ast.GtE: a.col >= b.col}[type(op)]
        return F.coalesce(c, F.lit(False)), _fails(_any_null(a, b), "no order on null")

    @staticmethod
    def _contains(a: Value, b: Value) -> tuple[Column, Column | None]:
        if isinstance(b.type, T.ArrayType):
            kind = common_type([a.type, b.type.elementType])
            if kind == STR and not (isinstance(a.type, T.StringType | T.NullType) and isinstance(b.type.elementType, T.StringType)):
                return F.lit(False), _fails(b.col.isNull(), "null isn't a container")
            x = as_type(a, kind).col
            return F.coalesce(F.exists(b.col.cast(T.ArrayType(kind)), lambda e: e.eqNullSafe(x)), F.lit(False)), _fails(b.col.isNull(), "null isn't a container")
        if isinstance(b.type, T.StringType) and isinstance(a.type, T.StringType):
            return F.coalesce(b.col.contains(a.col), F.lit(False)), _fails(_any_null(a, b), "bad operand for in: null")
        if isinstance(b.type, T.MapType):
            return F.coalesce(F.map_contains_key(b.col, py_str(a.col, a.type)), F.lit(False)), _fails(b.col.isNull(), "null isn't a container")
        if isinstance(b.type, T.StructType):
            return F.coalesce(a.col.isin(*b.type.names), F.lit(False)), None
        return F.lit(False), F.lit(f"{b.type.simpleString()} isn't a container")

    def visit_IfExp(self, node: ast.IfExp) -> Value:
        c, a, b = self.visit(node.test), self.visit(node.body), self.visit(node.orelse)
        kind = common_type([a.type, b.type])
        x, y = as_type(a, kind), as_type(b, kind)
        yes = truthy(c.col, c.type)
        lazy = None
        if a.error is not None or b.error is not None:
            none = F.lit(None).cast("string")
            lazy = F.when(yes, a.error if a.error is not None else none).otherwise(b.error if b.error is not None else none)
        return Value(F.when(yes, x.col).otherwise(y.col), kind, first_error(c.error, lazy))

    def _list(self, nodes: list[ast.expr]) -> Value:
        items = [self.visit(n) for n in nodes]
        if not items:
            return literal([])
        kind = common_type([i.type for i in items])
        kind = STR if isinstance(kind, T.NullType) else kind
        return Value(F.array(*[as_type(i, kind).col.cast(kind) for i in items]), T.ArrayType(kind), first_error(*[i.error for i in items]))

    def visit_List(self, node: ast.List) -> Value:
        return self._list(node.elts)

    def visit_Tuple(self, node: ast.Tuple) -> Value:
        return self._list(node.elts)

    def visit_Dict(self, node: ast.Dict) -> Value:
        if not node.keys:
            return literal({})
        if not all(isinstance(k, ast.Constant) and isinstance(k.value, str) for k in node.keys):
            raise ExpressionError("keys of an object must be texts")
        items = {k.value: self.visit(v) for k, v in zip(node.keys, node.values, strict=True)}
        return Value(F.struct(*[v.col.alias(k) for k, v in items.items()]), T.StructType([T.StructField(k, v.type) for k, v in items.items()]), first_error(*[v.error for v in items.values()]))

    def visit_Subscript(self, node: ast.Subscript) -> Value:
        v = self.visit(node.value)
        if isinstance(node.slice, ast.Slice):
            return self._slice(v, node.slice)
        k = self.visit(node.slice)
        errors = [v.error, k.error]
        if isinstance(v.type, T.StructType):
            name = node.slice.value if isinstance(node.slice, ast.Constant) else None
            if name not in v.type.names:
                return Value(F.lit(None), NULL, first_error(*errors, F.lit(f"no key {name!r}")))
            return Value(v.col.getField(name), v.type[name].dataType, first_error(*errors, _fails(v.col.isNull(), "null has no keys")))
        if isinstance(v.type, T.MapType):
            key = py_str(k.col, k.type)
            return Value(F.try_element_at(v.col, key), v.type.valueType, first_error(*errors, _fails(~F.coalesce(F.map_contains_key(v.col, key), F.lit(False)), "no such key")))
        if isinstance(v.type, T.ArrayType) or isinstance(v.type, T.StringType):
            n = F.size(v.col) if isinstance(v.type, T.ArrayType) else F.length(v.col)
            i = k.col.cast("int")
            at = F.when(i < 0, i + n).otherwise(i)
            bad = _fails(_any_null(v, k) | (at < 0) | (at >= n), "index out of range")
            out, kind = (F.get(v.col, at), v.type.elementType) if isinstance(v.type, T.ArrayType) else (F.substring(v.col, at + 1, F.lit(1)), STR)
            return Value(out, kind, first_error(*errors, bad))
        raise ExpressionError(f"{v.type.simpleString()} has no items")

    def _slice(self, v: Value, s: ast.Slice) -> Value:
        bound = lambda n: None if n is None else self.visit(n)
        lower, upper, step = bound(s.lower), bound(s.upper), s.step
        stride = ast.literal_eval(step) if step is not None else 1
        if not isinstance(stride, int) or stride == 0:
            raise ExpressionError("a slice's step must be a whole number other than 0")
        text = isinstance(v.type, T.StringType)
        if not text and not isinstance(v.type, T.ArrayType):
            raise ExpressionError(f"{v.type.simpleString()} has no slices")
        n = F.length(v.col) if text else F.size(v.col)
        low, high = (F.lit(0), n) if stride > 0 else (F.lit(-1), n - 1)
        clip = lambda b: F.least(F.greatest(F.when(b.col < 0, b.col.cast("int") + n).otherwise(b.col.cast("int")), low), high)
        begin = clip(lower) if lower is not None else (low if stride > 0 else high)
        end = clip(upper) if upper is not None else (high if stride > 0 else low)
        errors = first_error(v.error, *[b.error for b in (lower, upper) if b is not None], _fails(v.col.isNull(), "null has no slices"))
        if stride == 1:
            size = F.greatest(end - begin, F.lit(0))
            return Value(F.substring(v.col, begin + 1, size) if text else F.slice(v.col, begin + 1, size), v.type, errors)
        last = end - 1 if stride > 0 else end + 1
        some = (last >= begin) if stride > 0 else (last <= begin)
        places = F.when(some, F.sequence(begin, F.when(some, last).otherwise(begin), F.lit(stride))).otherwise(F.array().cast("array<int>"))
        if text:
            return Value(F.array_join(F.transform(places, lambda i: F.substring(v.col, i + 1, F.lit(1))), ""), STR, errors)
        return Value(F.transform(places, lambda i: F.get(v.col, i)), v.type, errors)

    def visit_Call(self, node: ast.Call) -> Value:
        args = [self.visit(a) for a in node.args]
        named = {k.arg: k.value for k in node.keywords}
        f: Callable[..., Value] = getattr(self, f"call_{node.func.id}")
        try:
            out = f(*args, **named)
        except TypeError as err:
            raise ExpressionError(f"{node.func.id}(): {err}") from None
        return replace(out, error=first_error(*[a.error for a in args], out.error))

    def call_bool(self, v: Value) -> Value:
        return Value(truthy(v.col, v.type), BOOL)

    def call_first_non_null(self, *values: Value) -> Value:
        kind = common_type([v.type for v in values])
        out = [F.when(~is_missing(v.col, v.type), as_type(v, kind).col) for v in values]
        return Value(F.coalesce(*out) if out else F.lit(None), kind)

    def call_float(self, v: Value) -> Value:
        out = cast_value(replace(v, error=None), "float")
        return out.failing(_fails(v.col.isNull(), "float() of null"))

    def call_int(self, v: Value) -> Value:
        if isinstance(v.type, T.StringType):
            col = F.when(v.col.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v.col).try_cast("long"))
            return Value(col, INT, _fails(col.isNull(), "invalid text for int()"))
        out = cast_value(replace(v, error=None), "int")
        return out.failing(_fails(v.col.isNull(), "int() of null"))

    def call_str(self, v: Value) -> Value:
        return Value(F.coalesce(py_str(v.col, v.type), F.lit("None")), STR)

    def call_len(self, v: Value) -> Value:
        if isinstance(v.type, T.StringType):
            n = F.length(v.col)
        elif isinstance(v.type, T.ArrayType | T.MapType):
            n = F.size(v.col)
        elif isinstance(v.type, T.StructType):
            n = F.lit(len(v.type))
        else:
            raise TypeError(f"{v.type.simpleString()} has no length")
        return Value(F.when(v.col.isNotNull(), n).cast("long"), INT, _fails(v.col.isNull(), "len() of null"))

    def _extreme(self, values: tuple[Value, ...], many: Callable, one: Callable, name: str, default: ast.expr | None) -> Value:
        if len(values) == 1:
            (v,) = values
            if not isinstance(v.type, T.ArrayType):
                raise TypeError("needs a list or several values")
            out = Value(one(v.col), v.type.elementType)
            if default is not None:
                d = self.visit(default)
                return replace(out, col=F.coalesce(out.col, d.col.cast(out.type)), error=d.error)
            return out.failing(_fails(v.col.isNull() | (F.size(v.col) == 0), f"{name}() of nothing"))
        kind = common_type([v.type for v in values])
        return Value(many(*[as_type(v, kind).col for v in values]), kind, _fails(_any_null(*values), f"{name}() with null"))

    def call_max(self, *values: Value, default: ast.expr | None = None) -> Value:
        return self._extreme(values, F.greatest, F.array_max, "max", default)

    def call_min(self, *values: Value, default: ast.expr | None = None) -> Value:
        return self._extreme(values, F.least, F.array_min, "min", default)

    def call_round(self, v: Value, n: Value | None = None, *, ndigits: ast.expr | None = None) -> Value:
        n = self.visit(ndigits) if ndigits is not None else n
        v = self._number(replace(v, error=None))
        bad = _fails(v.col.isNull(), "round() of null")
        if n is None:
            return Value(F.bround(v.col.cast("double"), 0).try_cast("long"), INT, bad)
        places = n.col
        return Value(F.call_function("bround", v.col, places.cast("int")) if is_float(v.type) else v.col, v.type, bad)

    def call_sorted(self, v: Value, *, reverse: ast.expr | None = None) -> Value:
        down = bool(ast.literal_eval(reverse)) if reverse is not None else False
        return Value(F.sort_array(v.col, asc=not down), v.type, _fails(v.col.isNull(), "sorted() of null"))

    def call_sum(self, v: Value, start: Value | None = None) -> Value:
        if not isinstance(v.type, T.ArrayType):
            raise TypeError("needs a list")
        kind = INT if is_int(v.type.elementType) or isinstance(v.type.elementType, T.BooleanType) else FLOAT
        zero = start.col.cast(kind) if start is not None else F.lit(0).cast(kind)
        return Value(F.aggregate(v.col, zero, lambda a, x: a + x.cast(kind)), kind, _fails(v.col.isNull(), "sum() of null"))
