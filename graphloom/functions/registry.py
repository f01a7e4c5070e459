"""Functions by name: scalar ones on typed values, and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from graphloom.errors import SemanticError
from graphloom.functions import operators as ops
from graphloom.functions import temporal as t
from graphloom.functions.types import (
    ANY, BOOL, DATE, DATE_TIME, DURATION, FLOAT, INT, LOCAL_DATE_TIME, LOCAL_TIME, NODE, NULL, NUMBERS, PATH, REL, STRING, Type, Value, common, list_of, spark_type,
)

Scalar = Callable[[list[Value], str], Value]
SCALARS: dict[str, Scalar] = {}
AGGREGATES = ("count", "sum", "avg", "min", "max", "collect", "stdev")


def scalar(*names: str, counts: tuple[int, int] | None = None, takes: Callable[[Type], bool] | None = None):
    """Registers a function of a list of values and the text of the call. counts: how many arguments
    there may be; takes: which types the first may have."""

    def add(make: Scalar) -> Scalar:
        def checked(name: str) -> Scalar:
            def run(args: list[Value], context: str) -> Value:
                if counts is not None and not counts[0] <= len(args) <= counts[1]:
                    raise refuse(name, args, context)
                if takes is not None and not takes(args[0].type):
                    raise refuse(name, args, context)
                return make(args, context)

            return run

        SCALARS.update({name: checked(name) for name in names})
        return make

    return add


def call(name: str, args: list[Value], context: str) -> Value:
    if name not in SCALARS:
        raise SemanticError(f"Unknown function {name} in {context}")
    return SCALARS[name](args, context)


def refuse(name: str, args: list[Value], context: str) -> SemanticError:
    return SemanticError(f"Invalid argument types {', '.join(str(a.type) for a in args)} for function {name} in {context}")


def _operator(name: str, count: int, make: Callable) -> None:
    def check(args: list[Value], context: str) -> Value:
        if len(args) != count:
            raise refuse(name, args, context)
        return make(*args, context)

    SCALARS[name] = check


for _op, _name in (("+", "add"), ("-", "subtract"), ("*", "multiply"), ("/", "divide"), ("%", "modulo"), ("^", "pow")):
    _operator(_name, 2, lambda a, b, c, op=_op: ops.arithmetic(op, a, b, c))
for _op, _name in (("=", "eq"), ("<>", "not_eq"), (">", "gt"), (">=", "gt_eq"), ("<", "lt"), ("<=", "lt_eq")):
    _operator(_name, 2, lambda a, b, c, op=_op: ops.comparison(op, a, b))
for _name in ("and", "or", "xor"):
    _operator(_name, 2, lambda a, b, c, op=_name.upper(): ops.boolean(op, a, b, c, False))
_operator("not", 1, ops.negation)
_operator("is_null", 1, lambda a, c: Value(a.column.isNull(), BOOL))
_operator("is_not_null", 1, lambda a, c: Value(a.column.isNotNull(), BOOL))
_operator("unary_add", 1, lambda a, c: ops.negative("+", a, c))
_operator("unary_substract", 1, lambda a, c: ops.negative("-", a, c))
_operator("list_index", 2, ops.index)
_operator("list_slice", 3, ops.cut)


# Temporal: a function makes its type of text, of itself, and of types that contain it.


def _temporal(name: str, kind: Type, parse, now, of: dict[Type, Callable]):
    def make(args: list[Value], context: str) -> Value:
        if not args and now is not None:
            return Value(now(), kind)
        if len(args) == 1:
            (a,) = args
            if a.type == NULL:
                return ops.null(kind)
            if a.type == STRING:
                return Value(parse(a.column), kind)
            if a.type == kind:
                return a
            if a.type in of:
                return Value(F.when(a.column.isNotNull(), of[a.type](a.column)), kind)
        raise refuse(name, args, context)

    SCALARS[name] = make


def _clock(at):
    day = F.date_trunc("day", at).cast("timestamp_ntz")
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(day.cast("timestamp"))
    return F.struct((micros * 1000).cast("bigint").alias("ns"))


def _local(at):
    return at["utc"] + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), at["offset_s"].cast("decimal(18,6)"))


def _now_zoned():
    local = F.localtimestamp()
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    return F.struct(utc.alias("utc"), F.timestamp_diff("SECOND", utc, local).cast("int").alias("offset_s"))


_temporal("date", DATE, t.parse_date, F.current_date, {LOCAL_DATE_TIME: lambda c: c.cast("date"), DATE_TIME: lambda c: _local(c).cast("date")})
_temporal("localtime", LOCAL_TIME, t.parse_local_time, lambda: _clock(F.localtimestamp()), {LOCAL_DATE_TIME: _clock, DATE_TIME: lambda c: _clock(_local(c))})
_temporal("localdatetime", LOCAL_DATE_TIME, t.parse_local_date_time, F.localtimestamp, {DATE_TIME: _local})
_temporal("datetime", DATE_TIME, t.parse_date_time, _now_zoned, {})
_temporal("duration", DURATION, t.parse_duration, None, {})


# Text, numbers, conversion


def _text(name: str, make):
    def one(args: list[Value], context: str) -> Value:
        if len(args) != 1 or args[0].type not in (STRING, NULL, ANY):
            raise refuse(name, args, context)
        return Value(make(ops.printed(args[0])), STRING)

    SCALARS[name] = one


for _name, _make in (("upper", F.upper), ("lower", F.lower), ("toUpper", F.upper), ("toLower", F.lower), ("trim", F.trim), ("reverse", F.reverse)):
    _text(_name, _make)


def _number(name: str, make, kind: Type | None = FLOAT):
    def one(args: list[Value], context: str) -> Value:
        if len(args) != 1 or args[0].type not in (*NUMBERS, NULL):
            raise refuse(name, args, context)
        if args[0].type == NULL:
            return ops.null(kind or INT)
        return Value(make(args[0].column), kind or args[0].type)

    SCALARS[name] = one


for _name, _make in (("sqrt", F.sqrt), ("exp", F.exp), ("log", F.ln), ("log10", F.log10), ("sin", F.sin), ("cos", F.cos)):
    _number(_name, _make)
_number("abs", F.abs, None)
_number("floor", lambda c: F.floor(c).cast("double"))
_number("ceil", lambda c: F.ceil(c).cast("double"))
_number("round", lambda c: F.round(c).cast("double"))
_number("sign", lambda c: F.signum(c).cast("bigint"), INT)


def _plain(kind: Type) -> bool:
    return kind in (*NUMBERS, STRING, BOOL, NULL, ANY)


@scalar("toInteger", counts=(1, 1), takes=_plain)
def _to_integer(args, context):
    """A number without its fraction, also from a text; null for a text that is no number."""
    (a,) = args
    if a.type != STRING:
        return Value(a.column.cast("bigint"), INT)
    return Value(F.coalesce(a.column.try_cast("bigint"), a.column.try_cast("double").try_cast("bigint")), INT)


@scalar("toFloat", counts=(1, 1), takes=_plain)
def _to_float(args, context):
    (a,) = args
    return Value(a.column.try_cast("double"), FLOAT)


@scalar("toString", counts=(1, 1))
def _to_string(args, context):
    return Value(ops.printed(args[0]), STRING)


@scalar("coalesce", counts=(1, 99))
def _coalesce(args, context):
    kind = common([a.type for a in args])
    return Value(F.coalesce(*[ops.cast(a, kind) for a in args]), kind)


@scalar("substring", counts=(2, 3), takes=lambda t: t in (STRING, NULL))
def _substring(args, context):
    text, start = args[0].column, args[1].column.cast("int")
    size = args[2].column.cast("int") if len(args) > 2 else F.char_length(text)
    return Value(F.substring(text, start + 1, size), STRING)


# Lists, entities and paths


@scalar("size", "length", counts=(1, 1))
def _size(args, context):
    (a,) = args
    if a.type == STRING:
        return Value(F.char_length(a.column).cast("bigint"), INT)
    if a.type == PATH:
        return Value(F.size(a.column["rels"]).cast("bigint"), INT)
    if a.type.name == "List":
        return Value(F.when(a.column.isNotNull(), F.size(a.column)).cast("bigint"), INT)
    if a.type == NULL:
        return ops.null(INT)
    raise refuse("size", args, context)


@scalar("head", "last", counts=(1, 1))
def _end(args, context):
    at = Value(F.lit(-1 if context.startswith("last") else 0), INT)
    return ops.index(args[0], at, context)


@scalar("range", counts=(2, 3), takes=lambda t: t == INT)
def _range(args, context):
    low, high = args[0].column, args[1].column
    step = args[2].column if len(args) > 2 else F.lit(1).cast("bigint")
    empty = F.array().cast("array<bigint>")
    return Value(F.when((high - low) * step >= 0, F.sequence(low, high, step)).otherwise(empty), list_of(INT))


@scalar("nodes")
def _nodes(args, context):
    if len(args) != 1 or args[0].type != PATH:
        raise refuse("nodes", args, context)
    return Value(args[0].column["nodes"], list_of(Type(NODE.name, props=dict(args[0].type.props).get("nodes", ()))))


@scalar("relationships")
def _relationships(args, context):
    if len(args) != 1 or args[0].type != PATH:
        raise refuse("relationships", args, context)
    return Value(args[0].column["rels"], list_of(Type(REL.name, props=dict(args[0].type.props).get("rels", ()))))


@scalar("labels")
def _labels(args, context):
    if len(args) != 1 or args[0].type != NODE:
        raise refuse("labels", args, context)
    return Value(args[0].column["labels"], list_of(STRING))


@scalar("type")
def _type(args, context):
    if len(args) != 1 or args[0].type != REL:
        raise refuse("type", args, context)
    return Value(args[0].column["rtype"], STRING)


@scalar("id", counts=(1, 1), takes=lambda t: t in (NODE, REL))
def _id(args, context):
    return Value(args[0].column["id"], INT)


def aggregate(name: str, value: Value | None, distinct: bool, context: str) -> Value:
    """The aggregate of a value; nulls don't count. None stands for count(*)."""
    if value is None:
        return Value(F.count(F.lit(1)), INT)
    c = value.column["id"] if value.type in (NODE, REL) and name == "count" else value.column
    if name == "count":
        return Value(F.count_distinct(c) if distinct else F.count(c), INT)
    if name == "collect":
        return Value(F.collect_set(c) if distinct else F.collect_list(c), list_of(value.type))
    if name in ("min", "max"):
        return Value((F.min if name == "min" else F.max)(c), value.type)
    if value.type not in (*NUMBERS, NULL):
        raise refuse(name, [value], context)
    if name == "sum":
        zero = F.lit(0).cast(spark_type(value.type if value.type in NUMBERS else INT))
        return Value(F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), zero), value.type if value.type in NUMBERS else INT)
    if name == "stdev":
        return Value(F.stddev_samp(c), FLOAT)
    return Value(F.sum_distinct(c) / F.nullif(F.count_distinct(c), F.lit(0)) if distinct else F.avg(c), FLOAT)
