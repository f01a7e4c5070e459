"""Operators on typed values: arithmetic, comparison, boolean logic, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.errors import SemanticError
from graphloom.functions import temporal as t
from graphloom.functions.types import (
    ANY, BOOL, DATE, DATE_TIME, DURATION, FLOAT, INT, LOCAL_DATE_TIME, LOCAL_TIME, NODE, NULL, NUMBERS, PATH, REL, STRING, TEMPORAL, Type, Value,
    common, list_of, spark_type,
)

_NAMES = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide", "%": "modulo", "^": "pow"}
_PLUS = {DATE: t.date_plus, LOCAL_TIME: t.local_time_plus, LOCAL_DATE_TIME: t.local_date_time_plus, DATE_TIME: t.date_time_plus}


def null(kind: Type = NULL) -> Value:
    """A null; one of no known type is a text column, as files can't hold columns of no type."""
    return Value(F.lit(None).cast("string" if kind == NULL else spark_type(kind)), kind)


def printed(value: Value) -> Column:
    """A value as text: what concatenation with a string gives (floats without a trailing .0)."""
    kind, c = value.type, value.column
    if kind == FLOAT:
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    if kind == ANY:
        return c["v"]
    makers = {LOCAL_TIME: t.print_local_time, LOCAL_DATE_TIME: t.print_local_date_time, DATE_TIME: t.print_date_time, DURATION: t.print_duration}
    return makers[kind](c) if kind in makers else c.cast("string")


def cast(value: Value, kind: Type) -> Column:
    """A value's column as one of another type that holds it."""
    if value.type == kind:
        return value.column
    if kind == ANY:
        if value.type == NULL:
            return F.lit(None).cast(spark_type(ANY))
        text = printed(value) if value.type.name not in ("List", "Map", "Node", "Rel", "Path") else F.to_json(value.column)
        return F.when(value.column.isNotNull(), F.struct(F.lit(str(value.type)).alias("t"), text.alias("v")))
    if value.type == NULL or kind == FLOAT or kind.name == "List":
        return value.column.cast(spark_type(kind))
    return value.column


def _wrong(op: str, a: Value, b: Value, context: str) -> SemanticError:
    return SemanticError(f"Invalid argument types {a.type}, {b.type} for function {_NAMES.get(op, op)} in {context}")


def _overflow(op: str, a: Value, b: Value) -> Column:
    text = F.format_string(f'Eval error: arithmetic overflow, op: {_NAMES[op]}, args: ["%s", "%s"]', printed(a), printed(b))
    return F.raise_error(text)


def arithmetic(op: str, a: Value, b: Value, context: str) -> Value:
    """a op b for + - * / % ^ and ||; null if either is null."""
    if op == "||":
        op = "+"
    if a.type.name == "List" or b.type.name == "List":
        return _lists(op, a, b, context)
    if NULL in (a.type, b.type):
        other = b.type if a.type == NULL else a.type
        return null(other if other in NUMBERS or other == STRING else NULL)
    x, y = a.column, b.column
    if a.type in NUMBERS and b.type in NUMBERS:
        return _numeric(op, a, b)
    if op == "+":
        if STRING in (a.type, b.type) and not {a.type, b.type} & {NODE, REL, PATH}:
            return Value(F.concat(printed(a), printed(b)), STRING)
        if a.type in TEMPORAL and b.type == DURATION:
            return Value(F.when(y.isNotNull(), _PLUS[a.type](x, y, 1)), a.type)
        if b.type in TEMPORAL and a.type == DURATION:
            return arithmetic(op, b, a, context)
        if a.type == b.type == DURATION:
            return _durations(a, b, t.combined(x, y, 1))
    elif op == "-":
        if a.type == b.type == DATE:
            return _durations(a, b, t.days_between(x, y))
        if a.type in TEMPORAL and b.type == DURATION:
            return Value(F.when(y.isNotNull(), _PLUS[a.type](x, y, -1)), a.type)
        if a.type == b.type == DURATION:
            return _durations(a, b, t.combined(x, y, -1))
        if a.type == b.type and a.type in TEMPORAL:
            message = F.concat(F.lit(f"Eval error: type error Cannot subtract {b.type}("), printed(b), F.lit(f") from {a.type}("), printed(a), F.lit(")"))
            return Value(F.when(x.isNotNull() & y.isNotNull(), F.raise_error(message).cast(t_spark(DURATION))), DURATION)
    elif op == "*":
        if a.type in NUMBERS and b.type == DURATION:
            return arithmetic(op, b, a, context)
        if a.type == DURATION and b.type in NUMBERS:
            return _durations(a, b, t.scaled(x, y, b.type == INT))
    elif op == "/" and a.type == DURATION and b.type in NUMBERS:
        wrong = _overflow(op, a, b).cast(t_spark(DURATION))
        return _durations(a, b, F.when(y == 0, wrong).otherwise(t.scaled(x, 1 / F.nullif(y.cast("double"), F.lit(0.0)), False)))
    raise _wrong(op, a, b, context)


def t_spark(kind: Type) -> str:
    return spark_type(kind)


def _durations(a: Value, b: Value, column: Column) -> Value:
    return Value(F.when(a.column.isNotNull() & b.column.isNotNull(), column), DURATION)


def _numeric(op: str, a: Value, b: Value) -> Value:
    x, y = a.column, b.column
    if op == "^":
        return Value(F.pow(x.cast("double"), y.cast("double")), FLOAT)
    if a.type == b.type == INT:
        if op in ("/", "%"):
            inside = F.call_function("mod", x, F.nullif(y, F.lit(0).cast("bigint"))) if op == "%" else _int_div(x, y)
            return Value(F.when(y == 0, _overflow(op, a, b).cast("bigint")).otherwise(inside), INT)
        return Value({"+": x + y, "-": x - y, "*": x * y}[op], INT)
    x, y = x.cast("double"), y.cast("double")
    if op == "/":
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        by_zero = F.when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)
        return Value(F.when(y == 0, by_zero).otherwise(x / F.nullif(y, F.lit(0.0))), FLOAT)
    if op == "%":
        return Value(F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.nullif(y, F.lit(0.0))), FLOAT)
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], FLOAT)


def _int_div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint")))


def _lists(op: str, a: Value, b: Value, context: str) -> Value:
    if op != "+":
        raise _wrong(op, a, b, context)
    if NULL in (a.type, b.type):
        return null(b.type if a.type == NULL else a.type)
    parts = [v if v.type.name == "List" else Value(F.when(v.column.isNotNull(), F.array(v.column)), list_of(v.type)) for v in (a, b)]
    kind = list_of(common([p.type.item for p in parts]))
    return Value(F.concat(*[cast(p, kind) for p in parts]), kind)


def negative(op: str, a: Value, context: str) -> Value:
    if a.type == NULL:
        return a
    if a.type not in NUMBERS:
        raise SemanticError(f"Invalid argument types {a.type} for function unary_{'add' if op == '+' else 'substract'} in {context}")
    return Value(a.column if op == "+" else -a.column, a.type)


# Comparison


def _comparable(a: Type, b: Type) -> bool:
    if a.name == b.name == "List":
        return NULL in (a.item, b.item) or _comparable(a.item, b.item)
    return (a in NUMBERS and b in NUMBERS) or a == b or ANY in (a, b)


def comparison(op: str, a: Value, b: Value) -> Value:
    """= <> < <= > >=: null if either is null; values of different kinds are unequal, unordered."""
    if NULL in (a.type, b.type):
        return null(BOOL)
    x, y = a.column, b.column
    if not _comparable(a.type, b.type):
        if op not in ("=", "<>"):
            return null(BOOL)
        return Value(F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "<>")), BOOL)
    if ANY in (a.type, b.type):
        return _tagged(op, *[Value(cast(v, ANY), ANY) for v in (a, b)])
    if a.type in (NODE, REL):
        x, y = x["id"], y["id"]
    elif a.type == DATE_TIME:
        x, y = x["utc"], y["utc"]
    elif a.type != b.type and a.type.name == "List":
        kind = list_of(common([a.type.item, b.type.item]))
        x, y = cast(a, kind), cast(b, kind)
    return Value({"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], BOOL)


def _tagged(op: str, a: Value, b: Value) -> Value:
    """Comparison of values whose types are known row by row only: numbers by size, others as text."""
    x, y = a.column, b.column
    numbers = x["t"].isin("Integer", "Float") & y["t"].isin("Integer", "Float")
    test = {"=": lambda p, q: p == q, "<>": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
    apart = F.lit(op == "<>") if op in ("=", "<>") else F.lit(None).cast("boolean")
    known = F.when(numbers, test(x["v"].try_cast("double"), y["v"].try_cast("double"))).when(x["t"] == y["t"], test(x["v"], y["v"])).otherwise(apart)
    return Value(F.when(x.isNotNull() & y.isNotNull(), known), BOOL)


# Boolean logic


def boolean(op: str, a: Value, b: Value, context: str, ansi: bool) -> Value:
    """AND, OR, XOR. Unless ansi: AND is null if either is, OR takes one null as false."""
    for v in (a, b):
        if v.type not in (BOOL, NULL):
            raise SemanticError(f"Invalid argument types {a.type}, {b.type} for function {op.lower()} in {context}")
    x, y = (v.column.cast("boolean") for v in (a, b))
    either = x.isNull() | y.isNull()
    if op == "XOR":
        return Value(x != y, BOOL)
    if ansi:
        return Value(x & y if op == "AND" else x | y, BOOL)
    if op == "AND":
        return Value(F.when(either, F.lit(None).cast("boolean")).otherwise(x & y), BOOL)
    some = F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))
    return Value(F.when(x.isNull() & y.isNull(), F.lit(None).cast("boolean")).otherwise(some), BOOL)


def negation(a: Value, context: str) -> Value:
    if a.type not in (BOOL, NULL):
        raise SemanticError(f"Invalid argument types {a.type} for function not in {context}")
    return Value(~a.column.cast("boolean"), BOOL)


# Lists


def make_list(items: list[Value]) -> Value:
    if not items:
        return Value(F.array().cast("array<bigint>"), list_of(NULL))
    kind = common([v.type for v in items])
    if kind == NULL:
        return Value(F.array(*[v.column for v in items]), list_of(NULL))
    return Value(F.array(*[cast(v, kind) for v in items]), list_of(kind))


def index(base: Value, at: Value, context: str) -> Value:
    """The item at a position from 0, from the end if negative; null outside the list."""
    if NULL in (base.type, at.type):
        return null()
    if base.type.name != "List" or at.type != INT:
        raise SemanticError(f"Invalid argument types {base.type}, {at.type} for function list_index in {context}")
    i = at.column
    place = F.when(i < 0, i + F.size(base.column)).otherwise(i)
    return Value(F.get(base.column, F.when(place >= 0, place).cast("int")), base.type.item)


def cut(base: Value, start: Value | None, end: Value | None, context: str) -> Value:
    """Items from start (included) to end, both counted as in index(); null bounds are open."""
    if base.type == NULL:
        return null()
    if base.type.name != "List" or any(v is not None and v.type not in (INT, NULL) for v in (start, end)):
        raise SemanticError(f"Invalid argument types {base.type} for function list_slice in {context}")
    n = F.size(base.column).cast("bigint")

    def bound(v: Value | None, open_: Column) -> Column:
        if v is None or v.type == NULL:
            return open_
        at = F.when(v.column < 0, v.column + n).otherwise(v.column)
        return F.coalesce(F.least(F.greatest(at, F.lit(0).cast("bigint")), n), open_)

    low, high = bound(start, F.lit(0).cast("bigint")), bound(end, n)
    size = F.greatest(high - low, F.lit(0).cast("bigint")).cast("int")
    return Value(F.when(base.column.isNotNull(), F.slice(base.column, (low + 1).cast("int"), size)), base.type)


def membership(a: Value, b: Value, context: str) -> Value:
    if NULL in (a.type, b.type):
        return null(BOOL)
    if b.type.name != "List":
        raise SemanticError(f"Invalid argument types {a.type}, {b.type} for function in in {context}")
    if b.type.item == NULL:
        return Value(F.when(F.size(b.column) == 0, F.lit(False)), BOOL)
    if not _comparable(a.type, b.type.item):
        return Value(F.when(a.column.isNotNull() & b.column.isNotNull(), F.lit(False)), BOOL)
    kind = common([a.type, b.type.item])
    if a.type in (NODE, REL):
        return Value(F.exists(b.column, lambda x: x["id"] == a.column["id"]), BOOL)
    return Value(F.exists(cast(b, list_of(kind)), lambda x: x == cast(a, kind)), BOOL)


def text_test(op: str, a: Value, b: Value, context: str) -> Value:
    for v in (a, b):
        if v.type not in (STRING, NULL, ANY):
            raise SemanticError(f"Invalid argument types {a.type}, {b.type} for function {op.lower()} in {context}")
    x, y = printed(a), printed(b)
    return Value({"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](x, y), BOOL)
