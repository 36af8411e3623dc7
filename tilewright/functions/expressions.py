"""A JSON expression language over features, lowered to columns.

An expression becomes a Value: a column of a kind known before the query runs, whether it is undefined, and whether
its evaluation fails. Nothing it lowers to raises: failure is a column beside the value, left out altogether where
none is possible, so that plain predicates stay plain and reach the scan.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import colors

NOTHING = object()


class ExpressionError(ValueError):
    """An expression that can't be lowered."""


@dataclass(frozen=True)
class Value:
    """kind: number, string, boolean, array, object, null, or mixed (a struct of kind, number, string and boolean)."""

    kind: str
    column: Column
    failed: Column | None = None
    absent: Column | None = None
    literal: object = NOTHING


@dataclass(frozen=True)
class Scope:
    """What expressions read: property columns by name (null: the feature lacks it), geometry type, id and so on."""

    properties: dict[str, tuple[str, Column]] = field(default_factory=dict)
    geometry_type: Column | None = None
    id: tuple[str, Column] | None = None
    zoom: Column | float = 0.0
    line_progress: Column | float = 0.0
    state: dict[str, tuple[str, Column]] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, properties: list[str], state: list[str] = (), **others: object) -> Scope:
        typed = lambda name: (kind_of(df.schema[name].dataType), F.col(name))
        if isinstance(others.get("id"), str):
            others["id"] = typed(others["id"])
        return Scope({x: typed(x) for x in properties}, state={x: typed(x) for x in state}, **others)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    return {T.StringType: "string", T.BooleanType: "boolean", T.ArrayType: "array", T.NullType: "null"}.get(type(dtype), "object")


OPERATORS: dict[str, Callable[[list, Scope], Value]] = {}


def operator(*names: str) -> Callable:
    def put(f: Callable[[list, Scope], Value]) -> Callable:
        OPERATORS.update({x: (lambda args, scope, f=f, x=x: f(x, args, scope)) if len(names) > 1 else f for x in names})
        return f

    return put


def register_operator(name: str, lower: Callable[[list, Scope], Value]) -> None:
    """Adds an operator: lower(arguments, scope) gives its Value."""
    OPERATORS[name] = lower


def either(*flags: Column | None) -> Column | None:
    return reduce(lambda a, b: a | b, [x for x in flags if x is not None]) if any(x is not None for x in flags) else None


def literal(x: object) -> Value:
    if x is None:
        return Value("null", F.lit(None).cast("string"), literal=None)
    if isinstance(x, bool):
        return Value("boolean", F.lit(x), literal=x)
    if isinstance(x, int | float):
        return Value("number", F.lit(float(x)), literal=float(x))
    if isinstance(x, str):
        return Value("string", F.lit(x), literal=x)
    if isinstance(x, list) and x and all(isinstance(y, int | float) and not isinstance(y, bool) for y in x):
        return Value("array", F.array(*[F.lit(float(y)) for y in x]), literal=x)
    if isinstance(x, list) and all(isinstance(y, str) for y in x):
        return Value("array", F.array(*[F.lit(y) for y in x]).cast("array<string>"), literal=x)
    return Value("array" if isinstance(x, list) else "object", F.lit(json.dumps(x, separators=(",", ":"), ensure_ascii=False)), literal=x)


def lower(expression: object, scope: Scope) -> Value:
    """The Value of an expression; an array whose head is no operator is data."""
    if isinstance(expression, list) and expression and isinstance(expression[0], str) and expression[0] in OPERATORS:
        return OPERATORS[expression[0]](expression[1:], scope)
    return literal(expression)


def arguments(name: str, args: list, scope: Scope, least: int, most: int | None = None) -> list[Value]:
    if len(args) < least or (most is not None and len(args) > most):
        raise ExpressionError(f"{name} takes {least} to {most or 'any number of'} arguments")
    return [lower(x, scope) for x in args]


# kinds


def present(v: Value) -> Column | None:
    return None if v.absent is None else ~v.absent


def truthy(v: Value) -> Column:
    if v.kind == "mixed":
        c = v.column
        known = F.when(c.kind == "number", truthy(Value("number", c.number))).when(c.kind == "string", truthy(Value("string", c.string)))
        return F.coalesce(known.when(c.kind == "boolean", c.boolean), F.lit(False))
    if v.kind == "number":
        return F.coalesce((v.column != 0) & ~F.isnan(v.column), F.lit(False))
    if v.kind == "string":
        return F.coalesce(v.column != "", F.lit(False))
    return {"boolean": F.coalesce(v.column, F.lit(False)), "null": F.lit(False)}.get(v.kind, v.column.isNotNull())


def mixed(v: Value) -> Value:
    """Any scalar as a struct that says what it is."""
    if v.kind == "mixed":
        return v
    slot = lambda kind, dtype: (v.column if v.kind == kind else F.lit(None)).cast(dtype)
    kind = F.when(v.column.isNull(), F.lit("null")).otherwise(F.lit(v.kind if v.kind in ("number", "string", "boolean", "null") else "string"))
    text = v.column.cast("string") if v.kind in ("array", "object") else slot("string", "string")
    return replace(v, kind="mixed", column=F.struct(kind.alias("kind"), slot("number", "double").alias("number"), text.alias("string"), slot("boolean", "boolean").alias("boolean")))


def unified(values: list[Value]) -> list[Value]:
    """The same kind for all branches: theirs if they agree, else mixed; null goes with any."""
    kinds = {v.kind for v in values} - {"null"}
    if len(kinds) > 1:
        return [mixed(v) for v in values]
    kind = next(iter(kinds), "null")
    return [v if v.kind == kind else replace(v, kind=kind, column=F.lit(None)) for v in values]


def number_text(x: Column) -> Column:
    """A number as ECMAScript writes it: no point in whole numbers, exponents below 1e-6 and from 1e21."""
    shortest, size = x.cast("string"), F.abs(x)
    trimmed = lambda places: F.regexp_replace(shortest.try_cast(T.DecimalType(38, places)).cast("string"), r"\.?0+$", "")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(shortest, r"\.0E", "E"), "E-", "e-"), "E", "e+")
    special = F.when(F.isnan(x), F.lit("NaN")).when(x == math.inf, F.lit("Infinity")).when(x == -math.inf, F.lit("-Infinity"))
    whole = special.when((size < 1e21) & (F.floor(x).cast("double") == x) & (size < 9e15), F.floor(x).cast("string"))
    whole = whole.when((size < 1e21) & (size >= 9e15), x.try_cast(T.DecimalType(38, 0)).cast("string"))
    return whole.when(size >= 1e21, exponent).when(size >= 1, trimmed(20)).when(size >= 1e-6, trimmed(30)).otherwise(exponent)


def text_of(v: Value) -> Column:
    if v.kind == "mixed":
        c = v.column
        chosen = F.when(c.kind == "number", number_text(c.number)).when(c.kind == "boolean", c.boolean.cast("string")).otherwise(c.string)
        return F.coalesce(chosen, F.lit(""))
    if v.literal is not NOTHING and v.kind in ("array", "object"):
        return F.lit(json.dumps(v.literal, separators=(",", ":"), ensure_ascii=False))
    text = {"number": lambda: number_text(v.column), "boolean": lambda: v.column.cast("string"), "array": lambda: F.to_json(v.column), "null": lambda: F.lit("")}
    return F.coalesce(text.get(v.kind, lambda: v.column)(), F.lit(""))


def same(a: Value, b: Value) -> Column:
    """Strict equality, never null: of one kind and equal; undefined equals undefined, null equals null; arrays and
    NaN equal nothing."""
    both_absent = a.absent & b.absent if a.absent is not None and b.absent is not None else None
    if "mixed" in (a.kind, b.kind):
        x, y = mixed(a).column, mixed(b).column
        equal = (x.kind == y.kind) & (x.number.eqNullSafe(y.number)) & x.string.eqNullSafe(y.string) & x.boolean.eqNullSafe(y.boolean)
    elif a.kind == b.kind == "null":
        equal = F.lit(True)
    elif a.kind != b.kind or a.kind in ("array", "object"):
        equal = F.lit(False)
    else:
        equal = F.coalesce(a.column == b.column, F.lit(False))
        if a.kind == "number" and not (isinstance(a.literal, float) or isinstance(b.literal, float)):
            equal = equal & ~F.isnan(a.column)
    if a.kind == b.kind == "null" and (a.absent is None) != (b.absent is None):
        equal = ~next(x.absent for x in (a, b) if x.absent is not None)
    return equal if both_absent is None else equal | F.coalesce(both_absent, F.lit(False))


def numbers(values: list[Value]) -> tuple[list[Column], Column | None]:
    """Operands of arithmetic, and whether one is no number."""
    columns, bad = [], []
    for v in values:
        bad.append(v.failed)
        if v.kind == "mixed":
            columns.append(v.column.number)
            bad.append(v.column.number.isNull() | F.isnan(v.column.number))
        elif v.kind == "number":
            columns.append(v.column.cast("double"))
            if v.literal is NOTHING:
                bad.append(v.column.isNull() | F.isnan(v.column.cast("double")))
        else:
            if v.literal is not NOTHING:
                raise ExpressionError(f"{v.literal!r} is no number")
            columns.append(F.lit(None).cast("double"))
            bad.append(F.lit(True))
    return columns, either(*[None if x is None else F.coalesce(x, F.lit(True)) for x in bad])


def take(choices: list[tuple[Column, Value]], otherwise: Value, before: Column | None = None) -> Value:
    """The value of the first choice whose condition holds; its failure and absence too."""
    values = unified([v for _, v in choices] + [otherwise])

    def chosen(get: Callable[[Value], Column | None], default: Column | None) -> Column | None:
        if default is None and all(get(v) is None for v in values):
            return None
        of = lambda v: get(v) if get(v) is not None else F.lit(False)
        out = None
        for (condition, _), v in zip(choices, values[:-1], strict=True):
            out = F.when(condition, of(v)) if out is None else out.when(condition, of(v))
        return out.otherwise(of(values[-1])) if out is not None else of(values[-1])

    column = chosen(lambda v: v.column, None)
    return Value(values[0].kind, column, either(before, chosen(lambda v: v.failed, None)), chosen(lambda v: v.absent, None))


# lookup


def key_of(name: str, args: list) -> str:
    if not 1 <= len(args) <= 2 or not isinstance(args[0], str):
        raise ExpressionError(f"{name} takes a key and, at most, an object")
    return args[0]


def of_object(args: list, scope: Scope) -> dict:
    v = lower(args[1], scope)
    if not isinstance(v.literal, dict):
        raise ExpressionError("an object argument must be a literal")
    return v.literal


@operator("literal")
def _literal(args: list, scope: Scope) -> Value:
    if len(args) != 1:
        raise ExpressionError("literal takes one argument")
    return literal(args[0])


UNDEFINED = lambda: Value("null", F.lit(None).cast("string"), absent=F.lit(True))


def read(typed: tuple[str, Column] | None) -> Value:
    return UNDEFINED() if typed is None else Value(typed[0], typed[1].cast("double") if typed[0] == "number" else typed[1], absent=typed[1].isNull())


@operator("get")
def _get(args: list, scope: Scope) -> Value:
    key = key_of("get", args)
    if len(args) == 2:
        found = of_object(args, scope)
        return literal(found[key]) if key in found else UNDEFINED()
    return read(scope.properties.get(key))


@operator("has")
def _has(args: list, scope: Scope) -> Value:
    key = key_of("has", args)
    if len(args) == 2:
        return literal(key in of_object(args, scope))
    return Value("boolean", scope.properties[key][1].isNotNull() if key in scope.properties else F.lit(False))


@operator("!has")
def _lacks(args: list, scope: Scope) -> Value:
    return Value("boolean", ~_has([key_of("!has", args)], scope).column)


@operator("at")
def _at(args: list, scope: Scope) -> Value:
    index, array = arguments("at", args, scope, 2, 2)
    if array.kind != "array":
        return replace(UNDEFINED(), failed=either(index.failed, array.failed))
    (k,), bad = numbers([index])
    found = F.when(k >= 0, F.get(array.column, F.floor(k).cast("int")))
    kind = "string" if isinstance(array.literal, list) and array.literal and isinstance(array.literal[0], str) else "number"
    return Value(kind, found, either(bad, array.failed), found.isNull())


@operator("length")
def _length(args: list, scope: Scope) -> Value:
    (v,) = arguments("length", args, scope, 1, 1)
    if v.kind == "string":  # in UTF-16 units: characters beyond the first plane count twice
        size = F.length(v.column) + F.length(F.regexp_replace(v.column, r"[^\x{10000}-\x{10FFFF}]", ""))
    else:
        size = F.size(v.column) if v.kind == "array" else F.lit(0)
    return Value("number", F.coalesce(size, F.lit(0)).cast("double"), v.failed)


@operator("properties")
def _properties(args: list, scope: Scope) -> Value:
    return Value("object", F.to_json(F.struct(*[c.alias(k) for k, (_, c) in scope.properties.items()])) if scope.properties else F.lit("{}"))


@operator("geometry-type")
def _geometry_type(args: list, scope: Scope) -> Value:
    kind = scope.geometry_type
    if kind is None:
        return literal("Unknown")
    return Value("string", F.when(kind == 1, "Point").when(kind == 2, "LineString").when(kind == 3, "Polygon").otherwise("Unknown"))


@operator("id")
def _id(args: list, scope: Scope) -> Value:
    return read(scope.id)


@operator("zoom")
def _zoom(args: list, scope: Scope) -> Value:
    return literal(scope.zoom) if not isinstance(scope.zoom, Column) else Value("number", scope.zoom.cast("double"))


@operator("line-progress")
def _line_progress(args: list, scope: Scope) -> Value:
    p = scope.line_progress
    return literal(p) if not isinstance(p, Column) else Value("number", F.coalesce(p.cast("double"), F.lit(0.0)))


@operator("feature-state")
def _feature_state(args: list, scope: Scope) -> Value:
    return read(scope.state.get(key_of("feature-state", args)))


# logic


@operator("!")
def _not(args: list, scope: Scope) -> Value:
    (v,) = arguments("!", args, scope, 1, 1)
    return Value("boolean", ~truthy(v), v.failed)


@operator("==", "!=")
def _equal(name: str, args: list, scope: Scope) -> Value:
    a, b = arguments(name, args, scope, 2, 2)
    return Value("boolean", same(a, b) if name == "==" else ~same(a, b), either(a.failed, b.failed))


COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def ordered(name: str, a: Value, b: Value, kinds: tuple[str, ...] = ("number", "string")) -> Column:
    """Of two numbers or two strings; false for all else, and with NaN."""
    if "mixed" in (a.kind, b.kind):
        x, y = mixed(a).column, mixed(b).column
        slots = [ordered(name, Value(k, x[k]), Value(k, y[k])) for k in kinds]
        return reduce(lambda p, q: p | q, slots)
    if a.kind != b.kind or a.kind not in kinds:
        return F.lit(False)
    sides = [v.column for v in (a, b) if a.kind == "number" and v.literal is NOTHING]
    holds = reduce(lambda x, y: x & ~F.isnan(y), sides, COMPARE[name](a.column, b.column))
    return F.coalesce(holds, F.lit(False))


@operator("<", "<=", ">", ">=")
def _compare(name: str, args: list, scope: Scope) -> Value:
    a, b = arguments(name, args, scope, 2, 2)
    return Value("boolean", ordered(name, a, b), either(a.failed, b.failed))


@operator("all", "any", "none")
def _junction(name: str, args: list, scope: Scope) -> Value:
    """Reads arguments in turn until one decides; a failure counts only where it is reached."""
    values = [lower(x, scope) for x in args]
    stops = (lambda v: ~truthy(v)) if name == "all" else truthy
    failed, open_ = None, F.lit(True)
    for v in values:
        if v.failed is not None:
            failed = either(failed, open_ & v.failed)
            open_ = open_ & ~v.failed
        open_ = open_ & ~stops(v)
    flags = [truthy(v) for v in values]
    if name == "all":
        column = reduce(lambda a, b: a & b, flags) if flags else F.lit(True)
    else:
        column = reduce(lambda a, b: a | b, flags) if flags else F.lit(False)
    return Value("boolean", ~column if name == "none" else column, failed)


@operator("case")
def _case(args: list, scope: Scope) -> Value:
    if len(args) < 3 or len(args) % 2 == 0:
        raise ExpressionError("case takes pairs and a fallback")
    choices, failing = [], []
    for condition, value in zip(args[:-1:2], args[1::2], strict=True):
        c, v = lower(condition, scope), lower(value, scope)
        if c.failed is not None:
            choices.append((c.failed, replace(UNDEFINED(), failed=F.lit(True))))
        choices.append((truthy(c), v))
        failing.append(c)
    return take(choices, lower(args[-1], scope))


@operator("match")
def _match(args: list, scope: Scope) -> Value:
    if len(args) < 4 or len(args) % 2:
        raise ExpressionError("match takes an input, pairs and a fallback")
    given = lower(args[0], scope)
    choices = []
    for labels, value in zip(args[1:-1:2], args[2:-1:2], strict=True):
        labels = labels if isinstance(labels, list) else [labels]
        if any(isinstance(x, list | dict) for x in labels):
            raise ExpressionError("labels of match are scalar literals")
        hit = reduce(lambda a, b: a | b, [same(given, literal(x)) for x in labels]) if labels else F.lit(False)
        choices.append((hit, lower(value, scope)))
    return take(choices, lower(args[-1], scope), given.failed)


@operator("coalesce")
def _coalesce(args: list, scope: Scope) -> Value:
    values = arguments("coalesce", args, scope, 1)
    choices = []
    for v in values:
        if v.failed is not None:
            choices.append((v.failed, replace(UNDEFINED(), failed=F.lit(True))))
        choices.append((v.column.kind != "null" if v.kind == "mixed" else v.column.isNotNull(), v))
    return take(choices, literal(None))


@operator("in", "!in")
def _in(name: str, args: list, scope: Scope) -> Value:
    (given,) = arguments(name, args[:1], scope, 1)
    hits = [same(given, literal(x)) for x in args[1:] if not isinstance(x, list | dict)]
    found = reduce(lambda a, b: a | b, hits) if hits else F.lit(False)
    return Value("boolean", found if name == "in" else ~found, given.failed)


# arithmetic


@operator("+", "*")
def _fold(name: str, args: list, scope: Scope) -> Value:
    columns, bad = numbers([lower(x, scope) for x in args])
    start = F.lit(0.0 if name == "+" else 1.0)
    return Value("number", reduce((lambda a, b: a + b) if name == "+" else (lambda a, b: a * b), columns, start), bad)


@operator("-")
def _minus(args: list, scope: Scope) -> Value:
    columns, bad = numbers(arguments("-", args, scope, 1, 2))
    return Value("number", -columns[0] if len(columns) == 1 else columns[0] - columns[1], bad)


@operator("/", "%", "^")
def _binary(name: str, args: list, scope: Scope) -> Value:
    (a, b), bad = numbers(arguments(name, args, scope, 2, 2))
    if name == "^":
        return Value("number", F.pow(a, b), bad)
    return Value("number", F.try_divide(a, b) if name == "/" else F.try_mod(a, b), either(bad, F.coalesce(b == 0, F.lit(True))))


@operator("min", "max")
def _extreme(name: str, args: list, scope: Scope) -> Value:
    columns, bad = numbers(arguments(name, args, scope, 1))
    return Value("number", columns[0] if len(columns) == 1 else (F.least if name == "min" else F.greatest)(*columns), bad)


UNARY = {
    "abs": (F.abs, None),
    "floor": (lambda x: F.floor(x).cast("double"), None),
    "ceil": (lambda x: F.ceil(x).cast("double"), None),
    "round": (lambda x: F.floor(x + 0.5).cast("double"), None),
    "sqrt": (F.sqrt, lambda x: x < 0),
    "ln": (F.ln, lambda x: x <= 0),
    "log10": (F.log10, lambda x: x <= 0),
    "log2": (F.log2, lambda x: x <= 0),
}


@operator(*UNARY)
def _unary(name: str, args: list, scope: Scope) -> Value:
    (x,), bad = numbers(arguments(name, args, scope, 1, 1))
    of, outside = UNARY[name]
    return Value("number", of(x), either(bad, outside and F.coalesce(outside(x), F.lit(True))))


@operator("e", "pi")
def _constant(name: str, args: list, scope: Scope) -> Value:
    return literal(math.e if name == "e" else math.pi)


@operator("rand")
def _rand(args: list, scope: Scope) -> Value:
    """Between two numbers; with a seed, by two steps of a linear congruence from its floor modulo 2**32."""
    columns, bad = numbers(arguments("rand", args, scope, 2, 3))
    if len(columns) == 2:
        share = F.rand()
    else:
        seed = F.pmod(F.floor(columns[2]).cast("long"), F.lit(1 << 32))
        state = F.when(seed == 0, F.lit(1).cast("long")).otherwise(seed)
        for _ in range(2):
            state = F.pmod(state * 1664525 + 1013904223, F.lit(1 << 32))
        share = state.cast("double") / float(1 << 32)
    return Value("number", columns[0] + (columns[1] - columns[0]) * share, bad)


# conversion and strings


@operator("to-string")
def _to_string(args: list, scope: Scope) -> Value:
    (v,) = arguments("to-string", args, scope, 1, 1)
    return Value("string", text_of(v), v.failed)


def parsed_number(text: Column) -> Column:
    """ECMAScript's reading of a trimmed string as a number; null where it is none or empty."""
    s = F.trim(text)
    decimal = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    for letter, base, digits in (("x", 16, "0-9a-fA-F"), ("o", 8, "0-7"), ("b", 2, "01")):
        decimal = decimal.when(s.rlike(f"^0[{letter}{letter.upper()}][{digits}]+$"), F.conv(F.substring(s, 3, 64), base, 10).try_cast("double"))
    return decimal.when(s.rlike(r"^\+?Infinity$"), F.lit(math.inf)).when(s == "-Infinity", F.lit(-math.inf))


@operator("to-number")
def _to_number(args: list, scope: Scope) -> Value:
    def number(v: Value) -> Column:
        if v.kind == "mixed":
            c = v.column
            return F.coalesce(c.number, parsed_number(c.string), c.boolean.cast("double"))
        kinds = {"number": lambda: F.when(~F.isnan(v.column), v.column), "boolean": lambda: v.column.cast("double"), "string": lambda: parsed_number(v.column)}
        return kinds.get(v.kind, lambda: F.lit(None))().cast("double")

    values = arguments("to-number", args, scope, 1)
    found = F.coalesce(*[number(v) for v in values])
    return Value("number", found, either(*[v.failed for v in values], found.isNull()))


@operator("to-boolean")
def _to_boolean(args: list, scope: Scope) -> Value:
    (v,) = arguments("to-boolean", args, scope, 1, 1)
    return Value("boolean", F.coalesce(F.size(v.column) > 0, F.lit(False)) if v.kind == "array" else truthy(v), v.failed)


def channels_of(v: Value) -> Column:
    """array(r, g, b, a) of a colour: a CSS string, or three or four numbers; null where it is none."""
    if isinstance(v.literal, str):
        found = colors.parse_color(v.literal)
        return F.lit(None).cast("array<double>") if found is None else F.array(*[F.lit(float(x)) for x in found])
    if v.kind in ("string", "mixed"):
        return colors.color_channels(v.column if v.kind == "string" else v.column.string)
    if v.kind == "array" and not (isinstance(v.literal, list) and any(isinstance(x, str) for x in v.literal)):
        share = lambda k, whole: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(v.column, F.lit(k)) / whole))
        alpha = F.when(F.size(v.column) == 4, share(3, 1.0)).otherwise(1.0)
        return F.when(F.size(v.column).isin(3, 4), F.array(share(0, 255.0), share(1, 255.0), share(2, 255.0), alpha))
    return F.lit(None).cast("array<double>")


@operator("to-rgba")
def _to_rgba(args: list, scope: Scope) -> Value:
    (v,) = arguments("to-rgba", args, scope, 1, 1)
    found = channels_of(v)
    byte = lambda k: F.floor(F.get(found, F.lit(k)) * 255 + 0.5).cast("double")
    return Value("array", F.array(byte(0), byte(1), byte(2), F.get(found, F.lit(3))), either(v.failed, found.isNull()))


@operator("to-color")
def _to_color(args: list, scope: Scope) -> Value:
    values = arguments("to-color", args, scope, 1)
    found = F.coalesce(*[channels_of(v) for v in values])
    return Value("string", colors.format_color(found, number_text), either(*[v.failed for v in values], found.isNull()))


@operator("concat")
def _concat(args: list, scope: Scope) -> Value:
    values = [lower(x, scope) for x in args]
    return Value("string", F.concat(*[text_of(v) for v in values]) if values else F.lit(""), either(*[v.failed for v in values]))


@operator("downcase", "upcase")
def _letters(name: str, args: list, scope: Scope) -> Value:
    (v,) = arguments(name, args, scope, 1, 1)
    return Value("string", (F.lower if name == "downcase" else F.upper)(text_of(v)), v.failed)


@operator("resolved-locale")
def _locale(args: list, scope: Scope) -> Value:
    return literal("en")


# curves


def curve_input(v: Value) -> Column:
    """The input of a curve as a number, null where it isn't a finite one."""
    if v.kind == "string":
        x = parsed_number(v.column)
    else:
        x = v.column.number if v.kind == "mixed" else F.lit(None) if v.kind in ("array", "object", "null") else v.column
        x = F.lit(0.0) if v.kind == "null" and v.absent is None else x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)


def stops_of(name: str, pairs: list, scope: Scope) -> tuple[list[float], list[Value]]:
    at, values = pairs[::2], pairs[1::2]
    if any(isinstance(x, bool) or not isinstance(x, int | float) for x in at) or any(b <= a for a, b in zip(at, at[1:], strict=False)):
        raise ExpressionError(f"stops of {name} are growing numbers")
    return [float(x) for x in at], unified([lower(x, scope) for x in values])


def bezier(x1: float, y1: float, x2: float, y2: float, u: Column) -> Column:
    """y of the cubic curve where x is u: by bisection on x, which grows with the parameter, then one secant step."""

    def cubic(t: Column, a: float, b: float) -> Column:
        return ((F.lit(1 - 3 * b + 3 * a) * t + F.lit(3 * b - 6 * a)) * t + F.lit(3 * a)) * t

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halved(s: Column, _: Column) -> Column:
        middle = (s.low + s.high) / 2
        right = cubic(middle, x1, x2) < u
        return F.struct(F.when(right, middle).otherwise(s.low).alias("low"), F.when(right, s.high).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(44)), start, halved, lambda s: (s.low + s.high) / 2)
    return F.when(u <= 0, 0.0).when(u >= 1, 1.0).otherwise(cubic(found, y1, y2))


def curve_share(spec: object, low: float, high: float, x: Column) -> Column:
    head = spec[0] if isinstance(spec, list) and spec else None
    linear = (x - low) / (high - low)
    if head == "linear":
        return linear
    if head == "exponential":
        base = float(spec[1])
        if not (math.isfinite(base) and base > 0):
            raise ExpressionError("the base of an exponential curve is positive")
        return linear if base == 1 else (F.pow(F.lit(base), x - low) - 1) / (base ** (high - low) - 1)
    if head == "cubic-bezier" and len(spec) == 5:
        return bezier(*map(float, spec[1:]), linear)
    raise ExpressionError(f"no curve {spec!r}")


def blended(a: Value, b: Value, t: Column) -> Value:
    failed = either(a.failed, b.failed)
    if a.kind == "number":
        return Value("number", a.column + (b.column - a.column) * t, failed)
    if a.kind == "array":
        return Value("array", F.when(F.size(a.column) == F.size(b.column), F.zip_with(a.column, b.column, lambda x, y: x + (y - x) * t)).otherwise(a.column), failed)
    if a.kind == "string":
        ca, cb = channels_of(a), channels_of(b)
        color = colors.format_color(colors.lerp_channels(ca, cb, t), number_text)
        return Value("string", F.when(ca.isNotNull() & cb.isNotNull(), color).otherwise(F.when(t < 1, a.column).otherwise(b.column)), failed)
    return Value(a.kind, F.when(t < 1, a.column).otherwise(b.column), failed)


@operator("interpolate")
def _interpolate(args: list, scope: Scope) -> Value:
    if len(args) < 4 or len(args) % 2:
        raise ExpressionError("interpolate takes a curve, an input and stops")
    given = lower(args[1], scope)
    x = curve_input(given)
    at, values = stops_of("interpolate", args[2:], scope)
    choices = [(x.isNull() | (x <= at[0]), values[0])]
    for k in range(len(at) - 1):
        choices.append((x < at[k + 1], blended(values[k], values[k + 1], curve_share(args[0], at[k], at[k + 1], x))))
    return take(choices, values[-1], given.failed)


@operator("step")
def _step(args: list, scope: Scope) -> Value:
    if len(args) < 4 or len(args) % 2:
        raise ExpressionError("step takes an input, a fallback and stops")
    given = lower(args[0], scope)
    x = curve_input(given)
    at, values = stops_of("step", args[2:], scope)
    first = lower(args[1], scope)
    choices = [(x.isNull() | (x < at[0]), first)] + [(x < high, v) for high, v in zip(at[1:], values, strict=False)]
    return take(choices, values[-1], given.failed)


# what queries use


def evaluate(expression: object, scope: Scope, default: Column | None = None) -> Column:
    """The expression's value; the default (null) where it fails or is undefined or null."""
    try:
        v = lower(expression, scope)
    except ExpressionError:
        return F.lit(None) if default is None else default
    column = v.column if v.failed is None else F.when(~v.failed, v.column)
    if v.kind == "mixed":
        column = F.when(column.kind != "null", text_of(replace(v, column=column)))
    return column if default is None else F.coalesce(column, default)


def validate(expression: object, scope: Scope) -> str | None:
    """What is wrong with an expression, if anything."""
    try:
        lower(expression, scope)
    except ExpressionError as e:
        return str(e)
    return None


def is_expression(x: object) -> bool:
    return isinstance(x, list) and bool(x) and isinstance(x[0], str) and x[0] in OPERATORS


JUNCTIONS = {"all", "any", "none"}
LEGACY = {*JUNCTIONS, "has", "!has", "==", "!=", "in", "!in", *COMPARE}


def is_legacy(node: list) -> bool:
    if not node or not isinstance(node[0], str) or node[0] not in LEGACY:
        return False
    if node[0] in JUNCTIONS:
        return all(isinstance(x, list) and is_legacy(x) for x in node[1:])
    return all(x and x[0] in ("get", "geometry-type", "$type") for x in node[1:] if isinstance(x, list))


def legacy_filter(node: list, scope: Scope) -> Column:
    """The plain form of filters: operands are literals, properties (null where missing) or the geometry type."""
    name, *rest = node
    if name in JUNCTIONS:
        parts = [legacy_filter(x, scope) if name != "none" else ~legacy_filter(x, scope) for x in rest]
        return reduce((lambda a, b: a | b) if name == "any" else (lambda a, b: a & b), parts, F.lit(name != "any")) if not parts else reduce((lambda a, b: a | b) if name == "any" else (lambda a, b: a & b), parts)
    if name in ("has", "!has"):
        known = isinstance(rest[0], str)
        there = scope.properties[rest[0]][1].isNotNull() if known and rest[0] in scope.properties else F.lit(False)
        return there if name == "has" else ~there & F.lit(known)

    def operand(x: object) -> Value:
        if isinstance(x, list) and x[0] == "get" and len(x) > 1 and isinstance(x[1], str):
            return replace(read(scope.properties.get(x[1])), absent=None)
        return _geometry_type([], scope) if isinstance(x, list) and x[0] == "geometry-type" else literal(x)

    def equal(a: Value, b: Value) -> Column:
        if b.kind == "null" or a.kind == "null":
            return (a if b.kind == "null" else b).column.isNull()
        return same(a, b)

    left, others = operand(rest[0]), [operand(x) for x in rest[1:]]
    if name in COMPARE:
        return ordered(name, left, others[0], ("number",))
    found = reduce(lambda a, b: a | b, [equal(left, x) for x in others]) if others else F.lit(False)
    return found if name in ("==", "in") else ~found


def upgraded(node: object) -> object:
    """A filter with bare property names as an expression."""
    if not isinstance(node, list) or not node or node[0] not in LEGACY:
        return node
    if node[0] in JUNCTIONS:
        return [node[0], *map(upgraded, node[1:])]
    if node[0] in ("has", "!has") or len(node) < 2 or not isinstance(node[1], str):
        return node
    head = {"$type": ["geometry-type"], "$id": ["id"]}.get(node[1], ["get", node[1]])
    return [node[0], head, *node[2:]]


def where(expression: object, scope: Scope) -> Column:
    """A filter's predicate. Rows for which it fails stay, and all rows where it can't be lowered."""
    if not isinstance(expression, list) or not expression:
        return F.lit(True)
    if is_legacy(expression):
        return legacy_filter(expression, scope)
    try:
        v = lower(expression, scope)
    except ExpressionError:
        return F.lit(True)
    return truthy(v) if v.failed is None else F.coalesce(v.failed, F.lit(False)) | truthy(v)
