"""Scans and expansions: node and relationship tables as joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import NotSupported
from graphloom.functions.types import Type, spark_type
from graphloom.plans.ast import BOTH, IN, OUT, LabelExpr
from graphloom.plans.scope import NodeVar, RelListVar, RelVar, property_column
from graphloom.sources.graph import NodeTable, PropertyGraph, RelTable
from graphloom.sources.shared import materialize

#: Steps of a variable-length expansion that one plan unrolls; longer ones are stored step by step.
UNROLLED = 4
#: Steps after which an expansion without an upper bound is given up.
MOST_STEPS = 10_000


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scan_nodes(spark, var: NodeVar) -> DataFrame:
    """The columns of var over its tables; tables without matching labels are never read."""
    types = var.types()
    parts = []
    for table in var.tables:
        columns = [F.col("id").alias(var.prefix)]
        columns += [property_column(table, k, types[k]).alias(f"{var.prefix}__{k}") for k in sorted(var.keys)]
        if var.labels:
            columns.append(F.array(*[F.lit(x) for x in table.labels]).alias(f"{var.prefix}__labels"))
        parts.append(table.df.select(*columns))
    if not parts:
        schema = [f"`{var.prefix}` bigint", *[f"`{var.prefix}__{k}` {spark_type(types[k])}" for k in sorted(var.keys)]]
        if var.labels:
            schema.append(f"`{var.prefix}__labels` array<string>")
        return spark.createDataFrame([], ", ".join(schema))
    return union_all(parts)


@dataclass
class Branch:
    """One table traversed one way: from column `src` to column `dst`."""

    table: RelTable
    src: str
    dst: str
    src_label: str | None
    dst_label: str | None


def branches(graph: PropertyGraph, types: LabelExpr | None, direction: str) -> list[Branch]:
    """Every table and way of a relationship pattern. A self-loop without direction goes both ways."""
    if types is not None and _has_and(types):
        raise NotSupported(f"relationship types joined by & in {types}")
    found = []
    for table in graph.rels:
        if types is not None and not types.holds([table.type]):
            continue
        if direction in (OUT, BOTH):
            found.append(Branch(table, "start", "end", table.start_label, table.end_label))
        if direction in (IN, BOTH):
            found.append(Branch(table, "end", "start", table.end_label, table.start_label))
    return found


def _has_and(x: LabelExpr) -> bool:
    return x.op == "&" or any(_has_and(p) for p in x.parts)


def with_label(tables: list[NodeTable], label: str | None) -> list[NodeTable]:
    return tables if label is None else [t for t in tables if label in t.labels]


def feasible(found: list[Branch], from_: list[NodeTable], to: list[NodeTable], all_nodes: list[NodeTable]) -> tuple[list[Branch], list[NodeTable], bool]:
    """The branches that can link the tables, the tables they lead to, and whether every node that
    they lead to is in `to` for certain (then no join has to test it)."""
    kept = [b for b in found if with_label(from_, b.src_label) and with_label(to, b.dst_label)]
    names = {id(t) for b in kept for t in with_label(to, b.dst_label)}
    led = [t for t in to if id(t) in names]
    allowed = {id(t) for t in to}
    certain = all(id(t) in allowed for b in kept for t in with_label(all_nodes, b.dst_label))
    return kept, led, certain


def in_row(kept: list[Branch], side: str, tables: list[NodeTable], all_nodes: list[NodeTable]) -> bool:
    """Whether every branch's node at a side ("src" or "dst") is the relationship's own row."""
    for b in kept:
        label = b.src_label if side == "src" else b.dst_label
        if b.table.row_side != getattr(b, side) or not any(b.table.row_node is t for t in tables):
            return False
        if [id(t) for t in with_label(all_nodes, label)] != [id(b.table.row_node)]:
            return False
    return bool(kept)


def scan_rels(spark, kept: list[Branch], var: RelVar, src: str, dst: str, at_src: NodeVar | None = None, at_dst: NodeVar | None = None) -> DataFrame:
    """Columns src, dst and those of var over the branches.

    at_src and at_dst are nodes whose columns the relationships' rows hold, see in_row().
    """
    types = var.types()
    parts = []
    for b in kept:
        df = b.table.wide if at_src or at_dst else b.table.with_ids() if var.has_id else b.table.df
        columns = [F.col(b.src).alias(src), F.col(b.dst).alias(dst)]
        if var.has_id:
            columns.append(F.col("id").alias(var.prefix))
        columns += [property_column(b.table, k, types[k]).alias(f"{var.prefix}__{k}") for k in sorted(var.keys)]
        if var.whole:
            columns += [F.lit(b.table.type).alias(f"{var.prefix}__rtype"), F.col("start").alias(f"{var.prefix}__start"), F.col("end").alias(f"{var.prefix}__end")]
        for node in filter(None, (at_src, at_dst)):
            columns += [property_column(b.table.row_node, k, v, "n__").alias(f"{node.prefix}__{k}") for k, v in node.types().items() if k in node.keys]
            if node.labels:
                columns.append(F.array(*[F.lit(x) for x in b.table.row_node.labels]).alias(f"{node.prefix}__labels"))
        parts.append(df.select(*columns))
    if parts:
        return union_all(parts)
    schema = [f"`{src}` bigint", f"`{dst}` bigint"]
    if var.has_id:
        schema.append(f"`{var.prefix}` bigint")
    schema += [f"`{var.prefix}__{k}` {spark_type(types[k])}" for k in sorted(var.keys)]
    if var.whole:
        schema += [f"`{var.prefix}__rtype` string", f"`{var.prefix}__start` bigint", f"`{var.prefix}__end` bigint"]
    return spark.createDataFrame([], ", ".join(schema))


def step_rows(spark, kept: list[Branch], var: RelListVar, keep: list[Column]) -> DataFrame:
    """(src, dst, rid, and rel if whole) over the branches; keep: conditions on the rel's own columns."""
    types: dict[str, Type] = RelVar(var.prefix, [b.table for b in kept]).types()
    parts = []
    for b in kept:
        df = b.table.with_ids()
        columns = [F.col(b.src).alias("src"), F.col(b.dst).alias("dst"), F.col("id").alias("rid")]
        props = [F.struct(*[property_column(b.table, k, v).alias(k) for k, v in types.items()]).alias("props")] if types else []
        rel = F.struct(F.col("id").alias("id"), F.lit(b.table.type).alias("rtype"), F.col("start").alias("start"), F.col("end").alias("end"), *props)
        parts.append(df.select(*columns, rel.alias("rel")))
    if not parts:
        return spark.createDataFrame([], "src bigint, dst bigint, rid bigint, rel struct<id:bigint,rtype:string,start:bigint,end:bigint>")
    rows = union_all(parts)
    for condition in keep:
        rows = rows.where(condition)
    return rows if var.whole else rows.drop("rel")


def var_expand(df: DataFrame, steps: DataFrame, var: RelListVar, start: str, end: str, low: int, high: int | None, trail: bool) -> DataFrame:
    """Appends paths of low to high relationships from column start: their lists and column end.

    In a trail no relationship occurs twice. Without an upper bound, or beyond UNROLLED steps, each
    step's rows are stored, so that no later step computes them again, and the expansion ends when
    a step finds no more. Stored rows hold the paths alone, one for each different start; the other
    columns of df are joined to them in the end.
    """
    if high is None and not trail:
        raise NotSupported("a walk without an upper bound may never end")
    stored = high is None or high > UNROLLED
    front = _front(df.select(start).distinct() if stored else df, steps, var, start, end)
    found = [front] if low == 0 else []
    length = 0
    while high is None or length < high:
        length += 1
        if length > MOST_STEPS:
            raise NotSupported(f"no end after {MOST_STEPS} steps")
        front = _onward(front, steps, var, end, trail).select(*front.columns)
        if stored:
            front = materialize(front)
            if front.isEmpty():
                break
        if length >= low:
            found.append(front)
    out = union_all(found) if found else front.where(F.lit(False))
    return df.join(out, start) if stored else out


def _front(df: DataFrame, steps: DataFrame, var: RelListVar, start: str, end: str) -> DataFrame:
    """df with empty paths that end where they start."""
    front = df.withColumn(end, F.col(start)).withColumn(f"{var.prefix}__ids", F.array().cast("array<bigint>"))
    if var.whole:
        front = front.withColumn(f"{var.prefix}__rels", F.array().cast(f"array<{steps.schema['rel'].dataType.simpleString()}>"))
    return front


def _onward(front: DataFrame, steps: DataFrame, var: RelListVar, end: str, trail: bool) -> DataFrame:
    """The paths of front, each a step longer, with the columns of the step."""
    ids, rels = f"{var.prefix}__ids", f"{var.prefix}__rels"
    joined = front.join(steps, F.col(end) == F.col("src"))
    if trail:
        joined = joined.where(~F.array_contains(ids, F.col("rid")))
    joined = joined.withColumn(ids, F.array_append(ids, F.col("rid"))).withColumn(end, F.col("dst"))
    return joined.withColumn(rels, F.array_append(rels, F.col("rel"))) if var.whole else joined


def shortest(ends: DataFrame, steps: DataFrame, var: RelListVar, start: str, end: str, low: int, high: int | None, every: bool, rings: bool, wanted: bool) -> DataFrame:
    """(start, end, lists) of a shortest path, or of every one, for each pair of nodes that paths link.

    ends holds the different starts, or, if wanted, the different pairs (start, end) that are asked
    for. Level by level, a node is reached from each start once: what leads to it again later is
    dropped, so the work is bounded by pairs of nodes, not by trails. A shortest path holds no node
    twice, so it is a trail, but for a way back to the start by the relationship that led away from
    it; if rings (steps go either way in a trail), ways back to the start are searched apart.
    low is 0 or 1. Levels are stored, but for one path each of up to UNROLLED steps (_few_levels()).
    """
    keep = [start, end, f"{var.prefix}__ids", *([f"{var.prefix}__rels"] if var.whole else [])]
    starts = ends.select(start).distinct()
    if not every and high is not None and high <= UNROLLED:
        out = _few_levels(starts, steps, var, start, end, low, high, rings).select(*keep)
        return out.join(ends, [start, end], "left_semi") if wanted else out
    found = []
    if low == 0:
        found.append(_front(starts, steps, var, start, end))

    def search(first: list[str], apart: bool) -> None:
        """first: more columns by which states differ. apart: only ways back to the start are kept."""
        key = [start, *first, end]
        front = _front(starts, steps, var, start, end)
        reached = [front.select(start, end)] if (rings or low == 0) and not apart else []
        left = ends if wanted else None
        if left is not None:
            left = left.where(F.col(start).eqNullSafe(F.col(end))) if apart else left
            for done in reached:
                left = left.join(done, [start, end], "left_anti")
        length = 0
        while high is None or length < high:
            length += 1
            if length > MOST_STEPS:
                raise NotSupported(f"no end after {MOST_STEPS} steps")
            rows = _onward(front, steps, var, end, False)
            if first and length == 1:
                rows = rows.withColumn(first[0], F.col("rid"))
            if apart:  # the last step of a ring is not its first one
                rows = rows.where((F.col(end) != F.col(start)) | (length == 1) | (F.col("rid") != F.col(first[0])))
            rows = rows.select(*keep, *first)
            for done in reached:
                rows = rows.join(done, key, "left_anti")
            if not every:
                rows = rows.dropDuplicates(key)
            rows = materialize(rows)
            if rows.isEmpty():
                break
            if apart:
                closed = rows.where(F.col(start) == F.col(end)).select(*keep)
                found.append(closed if every else closed.dropDuplicates([start]))
                front = rows.where(F.col(start) != F.col(end)).join(closed.select(start).distinct(), start, "left_anti")
                reached.append(front.select(*key).distinct())
            else:
                found.append(rows)
                front = rows
                reached.append(rows.select(*key).distinct())
            if left is not None:
                left = left.join(found[-1].select(start, end), [start, end], "left_anti")
                open_ = materialize(left)
                if open_.isEmpty():
                    break
                left = open_
                front = front.join(open_.select(start).distinct(), start, "left_semi")

    search([], False)
    if rings and low == 1:
        search([f"{var.prefix}__first"], True)
    if not found:
        return _front(starts, steps, var, start, end).where(F.lit(False)).select(*keep)
    out = union_all([f.select(*keep) for f in found])
    return out.join(ends, [start, end], "left_semi") if wanted else out


def _few_levels(starts: DataFrame, steps: DataFrame, var: RelListVar, start: str, end: str, low: int, high: int, rings: bool) -> DataFrame:
    """shortest() for one path each, as one plan: every level keeps one path to a node (of rings: for
    each first step, which a way back must not end with), then the shortest of all levels is taken."""
    first = [f"{var.prefix}__first"] if rings else []
    front = _front(starts, steps, var, start, end)
    columns = front.columns
    found = [front] if low == 0 else []
    for length in range(1, high + 1):
        rows = _onward(front, steps, var, end, rings)
        rows = rows.withColumn(first[0], F.col("rid")) if first and length == 1 else rows
        front = rows.select(*columns, *first)
        if 1 < length < high:
            front = front.dropDuplicates([start, *first, end])
        found.append(front.select(*columns))
    order = Window.partitionBy(start, end).orderBy(F.size(f"{var.prefix}__ids"))
    return union_all(found).withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
