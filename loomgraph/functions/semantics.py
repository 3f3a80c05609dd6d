"""Value semantics of the query language, as columns.

Nulls are two-valued: ``null = null`` is true, null sorts and compares below
everything, and every predicate is true or false.  Numbers compare as numbers,
strings as strings; values of other or mixed types are equal if their
renderings are, and otherwise neither above nor below each other.

A value is a column with its type: num, str, bool, list, null or other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Value(NamedTuple):
    """const: a literal's value, in a tuple; dtype: the column's Spark type."""

    col: Column
    kind: str
    dtype: T.DataType
    const: tuple | None = None


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "num"
    for cls, kind in ((T.StringType, "str"), (T.BooleanType, "bool"), (T.ArrayType, "list"), (T.NullType, "null")):
        if isinstance(dtype, cls):
            return kind
    return "other"


def value(col: Column, dtype: T.DataType) -> Value:
    return Value(col, kind_of(dtype), dtype)


def literal(x) -> Value:
    dtype = T.NullType() if x is None else T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) else T.DoubleType() if isinstance(x, float) else T.StringType()
    return Value(F.lit(x).cast(dtype) if x is not None else F.lit(None), kind_of(dtype), dtype, (x,))


def boolean(col: Column) -> Value:
    return Value(col, "bool", T.BooleanType())


def null() -> Value:
    return literal(None)


def truthy(v: Value) -> Column:
    """null and false are false, everything else is true."""
    return F.lit(False) if v.kind == "null" else F.coalesce(v.col, F.lit(False)) if v.kind == "bool" else v.col.isNotNull()


def render(v: Value) -> Column:
    """The text of a value; whole numbers without a fraction."""
    if isinstance(v.dtype, (T.DoubleType, T.FloatType)):
        return F.when((v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15), v.col.cast("long").cast("string")).otherwise(v.col.cast("string"))
    if v.kind in ("list", "other") and not isinstance(v.dtype, (T.DateType, T.TimestampType, T.BinaryType)):
        return F.to_json(v.col) if v.kind == "other" else F.concat(F.lit("["), F.array_join(v.col.cast("array<string>"), " "), F.lit("]"))
    return v.col.cast("string")


def comparable(a: Value, b: Value) -> bool:
    return a.kind == b.kind and (a.kind in ("num", "str") or (a.kind == "other" and a.dtype == b.dtype))


def equal(a: Value, b: Value) -> Column:
    if "null" in (a.kind, b.kind):
        return F.lit(True) if a.kind == b.kind else (b if a.kind == "null" else a).col.isNull()
    if a.kind == b.kind and (a.kind != "list" or a.dtype == b.dtype):
        return a.col.eqNullSafe(b.col)
    return render(a).eqNullSafe(render(b))


def less(a: Value, b: Value) -> Column:
    """a < b, with null below all values."""
    if b.kind == "null":
        return F.lit(False)
    if a.kind == "null":
        return b.col.isNotNull()
    below = F.coalesce(a.col < b.col, F.lit(False)) if comparable(a, b) else F.lit(False)
    if b.const is not None:
        return a.col.isNull() | (a.col < b.col) if comparable(a, b) else a.col.isNull()
    return (a.col.isNull() & b.col.isNotNull()) | below


def compare(op: str, a: Value, b: Value) -> Value:
    out = {"=": lambda: equal(a, b), "<>": lambda: ~equal(a, b), "<": lambda: less(a, b), ">": lambda: less(b, a), "<=": lambda: ~less(b, a), ">=": lambda: ~less(a, b)}[op]()
    if op in (">", ">=") and a.kind == b.kind and comparable(a, b) and b.const is not None:
        # The same, in a form that scans can use.
        out = F.coalesce(a.col > b.col if op == ">" else a.col >= b.col, F.lit(False))
    return boolean(out)


def contains(op: str, a: Value, b: Value) -> Value:
    if a.kind != "str" or b.kind != "str":
        return boolean(F.lit(False))
    test = {"CONTAINS": F.contains, "STARTS": F.startswith, "ENDS": F.endswith}[op]
    return boolean(F.coalesce(test(a.col, b.col), F.lit(False)))


def member(a: Value, items: list[Value] | None, array: Value) -> Value:
    """a IN array; items: the parts of a written list."""
    if items is not None:
        out = F.lit(False)
        for x in items:
            out = out | equal(a, x)
        return boolean(out)
    if array.kind != "list":
        return boolean(F.lit(False))
    of = array.dtype.elementType
    return boolean(F.coalesce(F.exists(array.col, lambda x: equal(value(x, of), a)), F.lit(False)))


def _texts(v: Value) -> Column:
    """A list's values as texts."""
    of = v.dtype.elementType
    return F.transform(v.col, lambda x: render(value(x, of)))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+" and a.kind == b.kind == "str":
        return Value(F.concat(a.col, b.col), "str", T.StringType())
    if op == "+" and a.kind == b.kind == "list":
        one, other = a.dtype.elementType, b.dtype.elementType
        if one == other or isinstance(one, T.NullType) or isinstance(other, T.NullType):
            return Value(F.concat(a.col, b.col), "list", b.dtype if isinstance(one, T.NullType) else a.dtype)
        if isinstance(one, T.NumericType) and isinstance(other, T.NumericType):
            both = T.ArrayType(T.DoubleType())
            return Value(F.concat(a.col.cast(both), b.col.cast(both)), "list", both)
        # As in a written list, values of several types are texts.
        return Value(F.concat(_texts(a), _texts(b)), "list", T.ArrayType(T.StringType()))
    if a.kind != "num" or b.kind != "num":
        return null()
    if op == "/":
        return value(F.try_divide(a.col.cast("double"), b.col.cast("double")), T.DoubleType())
    if op == "%":
        return value(F.try_mod(a.col.cast("long"), b.col.cast("long")), T.LongType())
    whole = all(isinstance(x.dtype, T.IntegralType) for x in (a, b))
    dtype = T.LongType() if whole else T.DoubleType()
    x, y = a.col.cast(dtype), b.col.cast(dtype)
    return value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), dtype)


def size(v: Value) -> Value:
    """Entries of a list, bytes of a string, else 0."""
    out = F.size(v.col) if v.kind == "list" else F.octet_length(v.col) if v.kind == "str" else F.lit(0)
    return value(F.greatest(F.coalesce(out, F.lit(0)), F.lit(0)).cast("long"), T.LongType())


def _same(f):
    return lambda v: value(f(v.col), v.dtype)


def _to(dtype: T.DataType):
    return lambda v: value(v.col.try_cast(dtype), dtype)


def _text(f):
    return lambda v: value(f(v.col.cast("string")), T.StringType())


def _end(place: int):
    """The first or last of a list; null for what is no list."""
    return lambda v: value(F.try_element_at(v.col, F.lit(place)), v.dtype.elementType) if v.kind == "list" else null()


#: Scalar functions of one argument besides size, type and those on nodes.
FUNCTIONS = {
    "toupper": _text(F.upper),
    "tolower": _text(F.lower),
    "trim": _text(F.trim),
    "abs": _same(F.abs),
    "round": lambda v: value(F.round(v.col.cast("double")), T.DoubleType()),
    "tointeger": _to(T.LongType()),
    "tofloat": _to(T.DoubleType()),
    "tostring": lambda v: Value(render(v), "str", T.StringType()),
    "head": _end(1),
    "last": _end(-1),
}
