"""Bindings of variables to columns, and expressions evaluated over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import SemanticError
from graphloom.functions import operators as ops
from graphloom.functions.registry import AGGREGATES, aggregate, call
from graphloom.functions.types import BOOL, FLOAT, INT, NODE, NULL, PATH, REL, STRING, Type, Value, common, list_of, map_of, of_spark, spark_type
from graphloom.plans import ast as a
from graphloom.sources.graph import NodeTable, RelTable


@dataclass
class NodeVar:
    """A node: column `prefix` holds its id, `prefix__key` its properties, `prefix__labels` labels."""

    prefix: str
    tables: list[NodeTable]
    keys: set[str] = field(default_factory=set)
    whole: bool = False
    labels: bool = False

    def __post_init__(self):
        self.labels = self.labels or self.whole

    def types(self) -> dict[str, Type]:
        return merged_types(self.tables)

    def columns(self) -> list[str]:
        names = [self.prefix, *[f"{self.prefix}__{k}" for k in sorted(self.keys)]]
        return [*names, f"{self.prefix}__labels"] if self.labels else names


@dataclass
class RelVar:
    """A relationship: `prefix` its id, properties as above; if whole also __rtype, __start, __end."""

    prefix: str
    tables: list[RelTable]
    keys: set[str] = field(default_factory=set)
    whole: bool = False
    has_id: bool = False

    def types(self) -> dict[str, Type]:
        return merged_types(self.tables)

    def columns(self) -> list[str]:
        names = [f"{self.prefix}__{k}" for k in sorted(self.keys)]
        names = [self.prefix, *names] if self.has_id else names
        return [*names, *[f"{self.prefix}__{k}" for k in ("rtype", "start", "end")]] if self.whole else names


@dataclass
class RelListVar:
    """Relationships of a variable-length step: `prefix__ids`, and `prefix__rels` if whole."""

    prefix: str
    tables: list[RelTable]
    whole: bool = False

    def columns(self) -> list[str]:
        return [f"{self.prefix}__ids", *([f"{self.prefix}__rels"] if self.whole else [])]


@dataclass
class PathVar:
    """A named path over bound variables, in order."""

    steps: list

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for s in self.steps for c in s.columns()))


@dataclass
class ValueVar:
    name: str
    type: Type

    def columns(self) -> list[str]:
        return [self.name]


def merged_types(tables: list) -> dict[str, Type]:
    """The properties of some tables; of different types, a common one, or text."""
    found: dict[str, list[Type]] = {}
    for table in tables:
        for k, kind in table.types.items():
            found.setdefault(k, []).append(kind)
    return {k: common(v) for k, v in found.items()}


def property_column(table, key: str, kind: Type, prefix: str = "") -> Column:
    """A table's property as the merged type, or a null of it."""
    if key not in table.types:
        return F.lit(None).cast(spark_type(kind))
    return ops.cast(Value(F.col(f"`{prefix}{key}`"), table.types[key]), kind)


def props_struct(prefix: str, types: dict[str, Type]) -> list[Column]:
    """The props field, or none if there are no properties."""
    if not types:
        return []
    return [F.struct(*[F.col(f"{prefix}__{k}").alias(k) for k in types]).alias("props")]


def node_value(var: NodeVar) -> Column:
    fields = [F.col(var.prefix).alias("id"), F.col(f"{var.prefix}__labels").alias("labels"), *props_struct(var.prefix, var.types())]
    return F.when(F.col(var.prefix).isNotNull(), F.struct(*fields))


def rel_value(var: RelVar) -> Column:
    p = var.prefix
    fields = [F.col(p).alias("id"), *[F.col(f"{p}__{k}").alias(k) for k in ("rtype", "start", "end")], *props_struct(p, var.types())]
    return F.when(F.col(p).isNotNull(), F.struct(*fields))


@dataclass
class Frame:
    """Rows so far, and what the visible variables are."""

    df: DataFrame | None  # None: one empty row
    scope: dict[str, object]

    def rows(self, spark) -> DataFrame:
        return spark.range(1).select() if self.df is None else self.df

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for v in self.scope.values() for c in v.columns()))


class Evaluator:
    """Expressions over a scope. bound: values of expressions already computed, by their text."""

    def __init__(self, scope: dict[str, object], params: dict, semantics: str = "reference", bound: dict[str, Value] | None = None, aggregates: bool = False):
        self.scope, self.params, self.semantics = scope, params, semantics
        self.bound = bound or {}
        self.aggregates = aggregates

    def __call__(self, expr: a.Expr, native: bool = False) -> Value:
        """native: whether AND and OR may be Spark's own, as they may where null and false alike drop a row."""
        return self._of(expr, str(expr), native)

    def condition(self, expr: a.Expr) -> Column:
        value = self(expr, native=True)
        if value.type not in (BOOL, NULL):
            raise SemanticError(f"Filter expression must be a boolean, got {value.type} in {expr}")
        return value.column.cast("boolean")

    def _of(self, e: a.Expr, context: str, native: bool = False) -> Value:
        if str(e) in self.bound:
            return self.bound[str(e)]
        go = lambda x: self._of(x, context)
        if isinstance(e, a.Literal):
            return literal(e.value)
        if isinstance(e, a.Parameter):
            if e.name not in self.params:
                raise SemanticError(f"Parameter {e.name} is not given in {context}")
            return literal(self.params[e.name])
        if isinstance(e, a.Variable):
            return self._variable(e.name, context)
        if isinstance(e, a.Property):
            return self._property(e, context)
        if isinstance(e, a.ListOf):
            return ops.make_list([go(x) for x in e.items])
        if isinstance(e, a.MapOf):
            parts = [(k, go(v)) for k, v in e.items]
            return Value(F.struct(*[v.column.alias(k) for k, v in parts]), map_of({k: v.type for k, v in parts}))
        if isinstance(e, a.Index):
            return ops.index(go(e.base), go(e.at), context)
        if isinstance(e, a.Slice):
            return ops.cut(go(e.base), *[None if x is None else go(x) for x in (e.start, e.end)], context)
        if isinstance(e, a.Unary):
            return ops.negation(go(e.operand), context) if e.op == "NOT" else ops.negative(e.op, go(e.operand), context)
        if isinstance(e, a.IsNull):
            c = self._presence(e.operand, context)
            return Value(c.isNotNull() if e.negated else c.isNull(), BOOL)
        if isinstance(e, a.HasLabel):
            return self._has_label(e, context)
        if isinstance(e, a.Binary):
            return self._binary(e, context, native)
        if isinstance(e, a.Case):
            return self._case(e, context)
        if isinstance(e, a.Call):
            return self._call(e, context)
        raise SemanticError(f"Invalid expression in {context}")

    def _binary(self, e: a.Binary, context: str, native: bool) -> Value:
        if e.op in ("AND", "OR", "XOR"):
            left, right = (self._of(x, context, native) for x in (e.left, e.right))
            return ops.boolean(e.op, left, right, context, native or self.semantics == "ansi")
        if e.op in ("=", "<>") and all(isinstance(x, a.Variable) and isinstance(self.scope.get(x.name), (NodeVar, RelVar)) for x in (e.left, e.right)):
            x, y = (self.scope[v.name] for v in (e.left, e.right))
            same = F.col(x.prefix) == F.col(y.prefix) if type(x) is type(y) else F.lit(False)
            return Value(same if e.op == "=" else ~same, BOOL)
        left, right = self._of(e.left, context), self._of(e.right, context)
        if e.op in ("=", "<>", "<", "<=", ">", ">="):
            return ops.comparison(e.op, left, right)
        if e.op == "IN":
            return ops.membership(left, right, context)
        if e.op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            return ops.text_test(e.op, left, right, context)
        return ops.arithmetic(e.op, left, right, context)

    def _case(self, e: a.Case, context: str) -> Value:
        arms = [(c if e.operand is None else a.Binary("=", e.operand, c), v) for c, v in e.branches]
        tests = [self._of(c, context).column.cast("boolean") for c, _ in arms]
        values = [self._of(v, context) for _, v in arms] + [self._of(e.otherwise or a.Literal(None), context)]
        kind = common([v.type for v in values])
        out = F.when(tests[0], ops.cast(values[0], kind))
        for test, value in zip(tests[1:], values[1:-1], strict=True):
            out = out.when(test, ops.cast(value, kind))
        return Value(out.otherwise(ops.cast(values[-1], kind)), kind)

    def _call(self, e: a.Call, context: str) -> Value:
        if e.name.lower() in AGGREGATES and (e.star or len(e.args) == 1):
            if not self.aggregates:
                raise SemanticError(f"Aggregation function {e.name} is not allowed in expression {context}")
            inner = Evaluator(self.scope, self.params, self.semantics)
            if not e.star and isinstance(e.args[0], a.Variable) and e.name.lower() == "count":
                return aggregate("count", Value(inner._presence(e.args[0], context), INT), e.distinct, context)
            return aggregate(e.name.lower(), None if e.star else inner(e.args[0]), e.distinct, context)
        if e.distinct:
            raise SemanticError(f"DISTINCT is not allowed in expression {context}")
        if len(e.args) == 1 and isinstance(e.args[0], a.Variable):
            var = self.scope.get(e.args[0].name)
            if isinstance(var, RelListVar) and e.name in ("size", "length"):
                return Value(F.size(f"{var.prefix}__ids").cast("bigint"), INT)
            if isinstance(var, PathVar) and e.name == "length":
                return Value(path_length(var), INT)
            if isinstance(var, (NodeVar, RelVar)) and e.name == "id":
                return Value(F.col(var.prefix), INT)
        return call(e.name, [self._of(x, context) for x in e.args], f"{e}")

    def _presence(self, e: a.Expr, context: str) -> Column:
        """A column that is null exactly if e is."""
        var = self.scope.get(e.name) if isinstance(e, a.Variable) and str(e) not in self.bound else None
        if isinstance(var, NodeVar) or (isinstance(var, RelVar) and var.has_id):
            return F.col(var.prefix)
        return self._of(e, context).column

    def _variable(self, name: str, context: str) -> Value:
        var = self.scope.get(name)
        if var is None:
            raise SemanticError(f"Variable {name} is not defined in {context}")
        if isinstance(var, NodeVar):
            kind = Type(NODE.name, props=tuple(var.types().items()) if var.whole else ())
            return Value(node_value(var) if var.whole else F.struct(F.col(var.prefix).alias("id")), kind, var)
        if isinstance(var, RelVar):
            kind = Type(REL.name, props=tuple(var.types().items()) if var.whole else ())
            return Value(rel_value(var) if var.whole else F.struct(F.col(var.prefix).alias("id")), kind, var)
        if isinstance(var, RelListVar):
            kind = Type(REL.name, props=tuple(merged_types(var.tables).items()) if var.whole else ())
            return Value(F.col(f"{var.prefix}__rels" if var.whole else f"{var.prefix}__ids"), list_of(kind), var)
        if isinstance(var, PathVar):
            kinds = {"nodes": [s for s in var.steps if isinstance(s, NodeVar)], "rels": [s for s in var.steps if not isinstance(s, NodeVar)]}
            props = tuple((k, tuple(merged_types([t for s in steps for t in s.tables]).items())) for k, steps in kinds.items())
            return Value(path_value(var), Type(PATH.name, props=props), var)
        return Value(F.col(f"`{var.name}`"), var.type)

    def _property(self, e: a.Property, context: str) -> Value:
        var = self.scope.get(e.base.name) if isinstance(e.base, a.Variable) else None
        if isinstance(var, (NodeVar, RelVar)):
            kind = var.types().get(e.key)
            return ops.null() if kind is None else Value(F.col(f"{var.prefix}__{e.key}"), kind)
        base = self._of(e.base, context)
        if base.type.name == "Map":
            kinds = dict(base.type.fields)
            if e.key not in kinds:
                raise SemanticError(f"Eval error: field not found {e.key} in {context}")
            return Value(base.column[e.key], kinds[e.key])
        if base.type in (NODE, REL):
            kind = dict(base.type.props).get(e.key)
            return ops.null() if kind is None else Value(base.column["props"][e.key], kind)
        if base.type == NULL:
            return ops.null()
        raise SemanticError(f"Eval error: type error {base.type} has no properties in {context}")

    def _has_label(self, e: a.HasLabel, context: str) -> Value:
        var = self.scope.get(e.operand.name)
        if not isinstance(var, NodeVar):
            raise SemanticError(f"Variable {e.operand} is not a node in {context}")
        column = F.col(f"{var.prefix}__labels")

        def holds(x: a.LabelExpr) -> Column:
            if x.op == "name":
                return F.array_contains(column, x.name)
            tests = [holds(p) for p in x.parts]
            out = tests[0]
            for test in tests[1:]:
                out = out & test if x.op == "&" else out | test
            return out

        return Value(holds(e.labels), BOOL)


def literal(value) -> Value:
    """A constant of a query or of its parameters."""
    if value is None:
        return ops.null()
    if isinstance(value, bool):
        return Value(F.lit(value), BOOL)
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise SemanticError(f"Invalid literal {value} for type Integer")
        return Value(F.lit(value).cast("bigint"), INT)
    if isinstance(value, float):
        return Value(F.lit(value), FLOAT)
    if isinstance(value, str):
        return Value(F.lit(value), STRING)
    if isinstance(value, (list, tuple)):
        return ops.make_list([literal(v) for v in value])
    if isinstance(value, dict):
        parts = {k: literal(v) for k, v in value.items()}
        return Value(F.struct(*[v.column.alias(k) for k, v in parts.items()]), map_of({k: v.type for k, v in parts.items()}))
    column = F.lit(value)
    import datetime

    return Value(column, of_spark(_SPARK_OF[type(value)]())) if isinstance(value, (datetime.date, datetime.datetime)) else Value(column, STRING)


def _spark_of():
    import datetime

    from pyspark.sql import types as T

    return {datetime.date: T.DateType, datetime.datetime: T.TimestampNTZType}


_SPARK_OF = _spark_of()


def path_length(var: PathVar) -> Column:
    total = F.lit(0).cast("bigint")
    for step in var.steps:
        if isinstance(step, RelListVar):
            total = total + F.size(f"{step.prefix}__ids")
        elif isinstance(step, RelVar):
            total = total + 1
    return total


def path_value(var: PathVar) -> Column:
    """struct<nodes, rels>: nodes inside a variable-length step are known by id alone."""
    nodes = [s for s in var.steps if isinstance(s, NodeVar)]
    rels = [s for s in var.steps if isinstance(s, (RelVar, RelListVar))]
    node_types, rel_types = merged_types([t for s in nodes for t in s.tables]), merged_types([t for s in rels for t in s.tables])

    def fields(prefix: str, own: dict[str, Type], all_: dict[str, Type]) -> list[Column]:
        if not all_:
            return []
        columns = [(F.col(f"{prefix}__{k}") if own.get(k) == kind else F.lit(None).cast(spark_type(kind)) if k not in own else ops.cast(Value(F.col(f"{prefix}__{k}"), own[k]), kind)).alias(k) for k, kind in all_.items()]
        return [F.struct(*columns).alias("props")]

    def node(s: NodeVar) -> Column:
        return F.struct(F.col(s.prefix).alias("id"), F.col(f"{s.prefix}__labels").alias("labels"), *fields(s.prefix, s.types(), node_types))

    def known(ids: Column) -> Column:
        props = [F.lit(None).cast(f"struct<{','.join(f'`{k}`:{spark_type(v)}' for k, v in node_types.items())}>").alias("props")] if node_types else []
        return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(None).cast("array<string>").alias("labels"), *props))

    def rel(s: RelVar) -> Column:
        p = s.prefix
        return F.array(F.struct(F.col(p).alias("id"), *[F.col(f"{p}__{k}").alias(k) for k in ("rtype", "start", "end")], *fields(p, s.types(), rel_types)))

    node_parts, rel_parts = [], []
    for at, step in enumerate(var.steps):
        if isinstance(step, NodeVar):
            node_parts.append(F.array(node(step)))
        elif isinstance(step, RelVar):
            node_parts.append(None)
            rel_parts.append(rel(step))
        else:
            before = F.col(var.steps[at - 1].prefix)
            inside = F.aggregate(
                F.col(f"{step.prefix}__rels"), F.array(before), lambda seen, r: F.concat(seen, F.array(F.when(r["start"] == F.element_at(seen, -1), r["end"]).otherwise(r["start"])))
            )
            node_parts.append(known(F.slice(inside, F.lit(2), F.greatest(F.size(inside) - 2, F.lit(0)))))
            rel_parts.append(F.col(f"{step.prefix}__rels"))
    for at, step in enumerate(var.steps):
        if isinstance(step, RelListVar):  # a step of no relationships has its node on both sides; show one
            after = node_parts[at + 1]
            node_parts[at + 1] = F.when(F.size(f"{step.prefix}__ids") > 0, after).otherwise(F.slice(after, 1, 0))
    node_parts = [x for x in node_parts if x is not None]
    empty = F.array().cast("array<struct<id:bigint,rtype:string,start:bigint,end:bigint>>")
    value = F.struct(F.concat(*node_parts).alias("nodes"), (F.concat(*rel_parts) if rel_parts else empty).alias("rels"))
    return F.when(F.col(nodes[0].prefix).isNotNull(), value)
