"""CREATE and constraints: each makes a new version of the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import ConstraintError, NotSupported, SemanticError
from graphloom.functions import operators as ops
from graphloom.functions.types import NULL, STRING, Type, Value, common, of_spark, spark_type
from graphloom.plans import ast as a
from graphloom.plans.scope import Evaluator, Frame, NodeVar, RelVar
from graphloom.sources.graph import Constraint, NodeTable, PropertyGraph, RelTable
from graphloom.sources.shared import materialize, small


def create(spark, graph: PropertyGraph, frame: Frame, clause: a.Create, params: dict, semantics: str, numbers) -> tuple[PropertyGraph, Frame]:
    """(new graph, rows with the created variables): for every row one of each item of the patterns.

    The rows, properties included, are stored once, numbered without gaps, so that ids stay what they
    are; properties may use variables of earlier clauses only. The given graph stays as it is: it is
    what the query reads, and what remains if a constraint fails.
    """
    before, graph = graph, graph.copy()
    outer = dict(frame.scope)
    evaluator = Evaluator(outer, params, semantics)
    scope = dict(outer)
    nodes: list[tuple[NodeVar, tuple[str, ...], dict[str, Value]]] = []
    rels: list[tuple[RelVar, str, str, str, dict[str, Value]]] = []

    def properties(found: a.MapOf | None) -> dict[str, Value]:
        values = {k: evaluator(v) for k, v in (found.items if found else ())}
        return {k: v if v.type != NULL else ops.null(STRING) for k, v in values.items()}

    for part in clause.parts:
        names = []
        for node in part.chain.nodes:
            name = node.variable or f"  new{next(numbers)}"
            if name in scope:
                if node.labels or node.properties:
                    raise SemanticError(f"Variable '{name}' is already defined in {part}")
                if not isinstance(scope[name], NodeVar):
                    raise SemanticError(f"Invalid CREATE entity in {part}")
            else:
                if node.labels is None or node.labels.op == "|":
                    raise SemanticError(f"Invalid CREATE entity in {part}")
                labels = tuple(node.labels.names())
                values = properties(node.properties)
                var = NodeVar(f"{name.strip()}_{next(numbers)}", [], set(values), True)
                nodes.append((var, labels, values))
                scope[name] = var
            names.append(name)
        for at, rel in enumerate(part.chain.rels):
            if isinstance(rel, a.Quantified):
                raise SemanticError(f"Quantified path patterns cannot be used in CREATE at {part}")
            if rel.length is not None or rel.direction == a.BOTH or rel.types is None or rel.types.op != "name":
                raise SemanticError(f"Invalid CREATE entity in {part}")
            if rel.variable in scope:
                raise SemanticError(f"Variable '{rel.variable}' is already defined in {part}")
            ends = (names[at], names[at + 1]) if rel.direction == a.OUT else (names[at + 1], names[at])
            values = properties(rel.properties)
            var = RelVar(f"{rel.variable or 'rel'}_{next(numbers)}", [], set(values), True, True)
            rels.append((var, rel.types.name, scope[ends[0]].prefix, scope[ends[1]].prefix, values))
            if rel.variable:
                scope[rel.variable] = var
    made = {f"{var.prefix}__{k}": v.column for var, *_, values in [*nodes, *rels] for k, v in values.items()}
    df, count = _numbered(frame.rows(spark).withColumns(made) if made else frame.rows(spark))
    for at, (var, labels, _) in enumerate(nodes):
        df = df.withColumn(var.prefix, F.col("__n") * len(nodes) + (graph.next_node + at))
        df = df.withColumn(f"{var.prefix}__labels", F.array(*[F.lit(x) for x in labels]))
    for at, (var, kind, start, end, _) in enumerate(rels):
        df = df.withColumn(var.prefix, F.col("__n") * len(rels) + (graph.next_rel + at))
        df = df.withColumns({f"{var.prefix}__rtype": F.lit(kind), f"{var.prefix}__start": F.col(start), f"{var.prefix}__end": F.col(end)})
    df = df.drop("__n")
    graph.next_node += count * len(nodes)
    graph.next_rel += count * len(rels)
    added: list[NodeTable | RelTable] = []
    for var, labels, values in nodes:
        types = {k: v.type for k, v in values.items()}
        _storable(types)
        columns = [F.col(var.prefix).alias("id"), *[F.col(f"{var.prefix}__{k}").alias(k) for k in types]]
        table = NodeTable(labels, df.select(*columns), types)
        var.tables = [table]
        added.append(table)
        graph.nodes = _with_nodes(graph.nodes, table)
    for var, kind, _, _, values in rels:
        types = {k: v.type for k, v in values.items()}
        _storable(types)
        columns = [F.col(var.prefix).alias("id"), *[F.col(f"{var.prefix}__{k}").alias(k) for k in ("start", "end", *types)]]
        table = RelTable(kind, df.select(*columns).where("start is not null and end is not null"), types)
        var.tables = [table]
        added.append(table)
        graph.rels = _with_rels(graph.rels, table)
    for constraint in graph.constraints.values():
        validate(before, constraint, added)
    return graph, Frame(df, {k: v for k, v in scope.items() if not k.startswith("  ")})


def append_nodes(graph: PropertyGraph, labels: tuple[str, ...], df: DataFrame) -> PropertyGraph:
    """A graph with a node for every row of df, its columns as properties; constraints are tested.

    The bulk form of CREATE: rows are stored and numbered where they are, none pass the driver.
    """
    before, graph = graph, graph.copy()
    rows, count, types = numbered_nodes(df, graph.next_node)
    graph.next_node += count
    table = NodeTable(labels, rows, types)
    graph.nodes = _with_nodes(graph.nodes, table)
    for constraint in graph.constraints.values():
        validate(before, constraint, [table])
    return graph


def numbered_nodes(df: DataFrame, first: int) -> tuple[DataFrame, int, dict[str, Type]]:
    """(rows of df as nodes, with ids from first on without gaps; their number; types of properties)."""
    types = {f.name: of_spark(f.dataType) for f in df.schema.fields}
    _storable(types)
    rows, count = _numbered(df.select(*[F.col(f"`{k}`").cast(spark_type(v)).alias(k) for k, v in types.items()]))
    return rows.select((F.col("__n") + first).alias("id"), *[f"`{k}`" for k in types]), count, types


def _storable(types: dict[str, Type]) -> None:
    for k, kind in types.items():
        if kind.name in ("Duration", "Map", "Node", "Rel", "Path"):
            raise NotSupported(f"property {k} can't be stored as {kind}")


def _numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """df, stored once, with __n from 0 without gaps, and its row count.

    Rows are numbered within the partitions they were stored by; where each partition starts is
    summed up over one row for each of them, and joined back whenever the rows are read.
    """
    stored = materialize(df.withColumn("__m", F.monotonically_increasing_id()))
    counts = stored.groupBy(F.shiftright("__m", 33).alias("__p")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("__p", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")))
    rows = stored.withColumn("__p", F.shiftright("__m", 33)).join(small(starts.drop("n")), "__p")
    number = F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__n", number).drop("__m", "__p", "__start"), starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _merged(old, new) -> tuple[DataFrame, dict[str, Type]]:
    types = {k: common([t.types[k] for t in (old, new) if k in t.types]) for k in (*old.types, *new.types)}
    fixed = [c for c in ("id", "start", "end") if c in old.df.columns]
    parts = []
    for t in (old, new):
        columns = [ops.cast(Value(F.col(f"`{k}`"), t.types[k]), kind).alias(k) if k in t.types else F.lit(None).cast(spark_type(kind)).alias(k) for k, kind in types.items()]
        parts.append(t.df.select(*fixed, *columns))
    return reduce(DataFrame.unionByName, parts), types


def _with_nodes(tables: list[NodeTable], new: NodeTable) -> list[NodeTable]:
    for at, old in enumerate(tables):
        if set(old.labels) == set(new.labels) and not old.apart:
            df, types = _merged(old, new)
            return [*tables[:at], NodeTable(old.labels, df, types), *tables[at + 1 :]]
    return [*tables, new]


def _with_rels(tables: list[RelTable], new: RelTable) -> list[RelTable]:
    for at, old in enumerate(tables):
        if old.type == new.type:
            old.with_ids()
            df, types = _merged(old, new)
            return [*tables[:at], RelTable(old.type, df, types, base=old.base), *tables[at + 1 :]]
    return [*tables, new]


# Constraints


def create_constraint(graph: PropertyGraph, statement: a.CreateConstraint) -> PropertyGraph:
    if statement.name in graph.constraints:
        if statement.if_not_exists:
            return graph
        raise ConstraintError(f"constraint '{statement.name}' already exists")
    constraint = Constraint(statement.name, statement.entity, statement.label, statement.kind, statement.properties)
    graph = graph.copy()
    validate(graph, constraint)
    graph.constraints[statement.name] = constraint
    return graph


def drop_constraint(graph: PropertyGraph, statement: a.DropConstraint) -> PropertyGraph:
    if statement.name not in graph.constraints:
        if statement.if_exists:
            return graph
        raise ConstraintError(f"constraint '{statement.name}' not found")
    graph = graph.copy()
    del graph.constraints[statement.name]
    return graph


def validate(graph: PropertyGraph, constraint: Constraint, added: list[NodeTable | RelTable] | None = None) -> None:
    """Raises ConstraintError if a row of the label or type is against the constraint.

    Rows that lack a property are no duplicates; a node key, and NOT NULL, ask for every property.
    With added, the graph's rows are known to meet it: only the added tables are tested, among
    themselves and by a semi-join with the graph's keys.
    """
    node = constraint.entity == "node"
    ours = lambda tables: [t for t in tables if (isinstance(t, NodeTable) and constraint.label in t.labels if node else isinstance(t, RelTable) and t.type == constraint.label)]
    stored = ours(graph.nodes if node else graph.rels)
    tested = stored if added is None else ours(added)
    if not tested:
        return
    kinds = {k: common([t.types[k] for t in (*stored, *tested) if k in t.types]) for k in constraint.properties}

    def rows_of(tables) -> DataFrame:
        parts = []
        for t in tables:
            columns = [ops.cast(Value(F.col(f"`{k}`"), t.types[k]), kinds[k]).alias(k) if k in t.types else F.lit(None).cast(spark_type(kinds[k])).alias(k) for k in constraint.properties]
            parts.append(t.df.select(*columns))
        return reduce(DataFrame.unionByName, parts)

    rows = rows_of(tested)
    lacking = reduce(lambda x, y: x | y, [F.col(f"`{k}`").isNull() for k in constraint.properties])
    if constraint.kind in ("node key", "not null") and not rows.where(lacking).isEmpty():
        raise ConstraintError(f"constraint violation: {constraint.name} - missing property of {', '.join(constraint.properties)}")
    if constraint.kind in ("unique", "node key"):
        keys = [f"`{k}`" for k in constraint.properties]
        whole = rows.where(~lacking)
        twice = whole.groupBy(*keys).count().where("count > 1").drop("count").first()
        if twice is None and added is not None and stored:
            twice = whole.join(rows_of(stored), list(constraint.properties), "left_semi").first()
        if twice is not None:
            raise ConstraintError(f"constraint violation: {constraint.name} - duplicate value {tuple(twice)}")
