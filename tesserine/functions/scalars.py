"""Scalar functions of the query language as columns, and a registry to extend.

A function gets Values (a column with its Spark type) and returns a Value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, T.IntegralType):
            return "int"
        if isinstance(t, (T.FractionalType,)):
            return "float"
        if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
            return "string"
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, T.ArrayType):
            return "list"
        if isinstance(t, (T.MapType, T.StructType)):
            return "map"
        if isinstance(t, T.BinaryType):
            return "bytes"
        return "other"

    @property
    def number(self) -> bool:
        return self.kind in ("int", "float")


class FunctionError(Exception):
    """A call with arguments that the function can't take."""


def null(t: T.DataType = NULL) -> Value:
    return Value(F.lit(None).cast(t), t)


def truthy(v: Value) -> Column:
    """Null, zero and empty are false."""
    c = {
        "bool": v.col, "int": v.col != 0, "float": v.col != 0, "string": F.length(v.col) > 0, "bytes": F.length(v.col) > 0, "list": F.size(v.col) > 0,
        "map": F.size(v.col) > 0 if isinstance(v.type, T.MapType) else v.col.isNotNull(), "null": F.lit(False),
    }.get(v.kind, v.col.isNotNull())
    return F.coalesce(c, F.lit(False))


def comparable(a: Value, b: Value) -> bool:
    return a.kind == b.kind or (a.number and b.number) or "null" in (a.kind, b.kind) or {a.kind, b.kind} == {"other", "string"}


def equal(a: Value, b: Value) -> Column:
    """Null equals null alone; values of different kinds are not equal."""
    if not comparable(a, b):
        return a.col.isNull() & b.col.isNull()
    if "null" in (a.kind, b.kind):
        return (b if a.kind == "null" else a).col.isNull()
    return a.col.eqNullSafe(b.col)


def common_type(values: list[Value]) -> T.DataType:
    types = [v.type for v in values if v.kind != "null"]
    if not types:
        return NULL
    kinds = {v.kind for v in values if v.kind != "null"}
    if kinds == {"int"}:
        return LONG
    if kinds <= {"int", "float"}:
        return DOUBLE
    return types[0] if all(t == types[0] for t in types) else STRING


def _need(name: str, v: Value, *kinds: str) -> None:
    if v.kind not in kinds and v.kind != "null":
        raise FunctionError(f"{name}() can't take a {v.kind}")


def _abs(x: Value) -> Value:
    _need("abs", x, "int", "float")
    return Value(F.abs(x.col), x.type)


def _size(x: Value) -> Value:
    _need("size", x, "string", "bytes", "list")
    return null(LONG) if x.kind == "null" else Value((F.size(x.col) if x.kind == "list" else F.octet_length(x.col)).cast("long"), LONG)


def _to_integer(x: Value) -> Value:
    if x.kind == "int":
        return Value(x.col.cast("long"), LONG)
    if x.kind == "float":
        return Value(x.col.try_cast("long"), LONG)
    if x.kind == "string":
        return Value(F.when(x.col.rlike("^[+-]?[0-9]+$"), x.col.try_cast("long")), LONG)
    return null(LONG)


def _to_float(x: Value) -> Value:
    if x.number:
        return Value(x.col.cast("double"), DOUBLE)
    if x.kind == "string":
        return Value(F.when(x.col.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.col.try_cast("double")), DOUBLE)
    return null(DOUBLE)


def _to_string(x: Value) -> Value:
    if x.kind in ("list", "map"):
        return Value(F.coalesce(F.to_json(x.col), F.lit("null")), STRING)
    return Value(F.coalesce(x.col.cast("string"), F.lit("null")), STRING)


def _lower(x: Value) -> Value:
    _need("toLower", x, "string")
    return Value(tx.ascii_lower(x.col.cast("string")), STRING)


def _upper(x: Value) -> Value:
    _need("toUpper", x, "string")
    return Value(tx.ascii_upper(x.col.cast("string")), STRING)


def _trim(x: Value) -> Value:
    _need("trim", x, "string")
    return Value(F.btrim(x.col.cast("string"), F.lit(" \t\r\n")), STRING)


def _substring(s: Value, start: Value, length: Value | None = None) -> Value:
    """0-based and clamped at both ends."""
    _need("substring", s, "string")
    _need("substring", start, "int")
    begin = F.greatest(F.lit(0), start.col.cast("int"))
    n = F.length(s.col) if length is None else F.greatest(F.lit(0), length.col.cast("int"))
    return Value(F.substring(s.col, begin + 1, n), STRING)


def _replace(s: Value, a: Value, b: Value) -> Value:
    for v in (s, a, b):
        _need("replace", v, "string")
    return Value(F.when(F.length(a.col) == 0, s.col).otherwise(F.replace(s.col, a.col, b.col)), STRING)


def _split(s: Value, d: Value) -> Value:
    _need("split", s, "string")
    _need("split", d, "string")
    quoted = F.concat(F.lit("\\Q"), d.col, F.lit("\\E"))
    return Value(F.when(F.length(d.col) == 0, F.array(s.col)).otherwise(F.split(s.col, quoted, -1)), T.ArrayType(STRING))


def _element(name: str, at: int) -> Callable[[Value], Value]:
    def run(x: Value) -> Value:
        _need(name, x, "list")
        return null() if x.kind == "null" else Value(F.try_element_at(x.col, F.lit(at)), x.type.elementType)

    return run


def _tail(x: Value) -> Value:
    _need("tail", x, "list")
    return null() if x.kind == "null" else Value(F.slice(x.col, F.lit(2), F.greatest(F.size(x.col), F.lit(0))), x.type)


def _range(a: Value, b: Value, step: Value | None = None) -> Value:
    """Inclusive at both ends; empty if the step leads away."""
    for v in (a, b) + ((step,) if step else ()):
        _need("range", v, "int")
    lo, hi = a.col.cast("long"), b.col.cast("long")
    s = step.col.cast("long") if step else F.lit(1).cast("long")
    safe = F.when(s == 0, F.raise_error(F.lit("range() with a step of 0")).cast("long")).otherwise(s)
    right = ((safe > 0) & (lo <= hi)) | ((safe < 0) & (lo >= hi))
    return Value(F.when(right, F.sequence(lo, F.when(right, hi).otherwise(lo), F.when(right, safe).otherwise(F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))


def _coalesce(*xs: Value) -> Value:
    t = common_type(list(xs))
    return Value(F.coalesce(*[x.col.cast(t) for x in xs]) if xs else F.lit(None), t)


FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Value]]] = {
    "coalesce": (1, None, _coalesce), "abs": (1, 1, _abs), "size": (1, 1, _size), "toInteger": (1, 1, _to_integer), "toFloat": (1, 1, _to_float), "toString": (1, 1, _to_string),
    "toLower": (1, 1, _lower), "toUpper": (1, 1, _upper), "trim": (1, 1, _trim), "substring": (2, 3, _substring), "replace": (3, 3, _replace), "split": (2, 2, _split),
    "head": (1, 1, _element("head", 1)), "last": (1, 1, _element("last", -1)), "tail": (1, 1, _tail), "range": (2, 3, _range),
}


def register(name: str, fn: Callable[..., Value], least: int, most: int | None = None) -> None:
    """Adds a function that queries can call."""
    FUNCTIONS[name] = (least, most if most is not None else least, fn)
