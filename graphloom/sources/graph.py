"""The property graph: node tables by label set, relationship tables by type."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import SemanticError
from graphloom.functions.types import Type, of_spark, spark_type
from graphloom.sources.shared import materialize

#: Ids of the k-th registered table start at k * ID_BLOCK; created entities count from 1.
ID_BLOCK = 1 << 48


@dataclass(frozen=True)
class NodeTable:
    """Nodes of one set of labels. df has the column `id` and a column for each property.

    A table that is kept apart is not joined with what CREATE adds (its owner replaces it).
    """

    labels: tuple[str, ...]
    df: DataFrame
    types: dict[str, Type]
    apart: bool = False


@dataclass
class RelTable:
    """Relationships of one type. df has `start`, `end`, properties, and `id` unless it is yet to
    be given; start_label and end_label name a label that all nodes at that end have, if known."""

    type: str
    df: DataFrame
    types: dict[str, Type]
    start_label: str | None = None
    end_label: str | None = None
    base: int = 0
    #: The end ("start" or "end") whose node is the same row of the same table, if there is one, that
    #: node's table, and df with the node's properties as columns `n__<property>`.
    row_side: str | None = None
    row_node: NodeTable | None = None
    wide: DataFrame | None = None

    def with_ids(self) -> DataFrame:
        """df with ids; they are given once and stored, since row numbers of a plan that runs again
        may differ. Queries that ask for no ids never come here."""
        if "id" not in self.df.columns:
            self.df = materialize(self.df.withColumn("id", F.monotonically_increasing_id() + F.lit(self.base)))
        return self.df


@dataclass
class Constraint:
    name: str
    entity: str
    label: str
    kind: str
    properties: tuple[str, ...]


@dataclass
class PropertyGraph:
    """A version of the graph; changes make a new one (see operators.mutate)."""

    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    constraints: dict[str, Constraint] = field(default_factory=dict)
    next_node: int = 1
    next_rel: int = 1
    tables: int = 0

    def copy(self) -> PropertyGraph:
        return replace(self, nodes=list(self.nodes), rels=list(self.rels), constraints=dict(self.constraints))

    def add_nodes(self, labels: str | tuple[str, ...], df: DataFrame, key: str, properties: list[str] | None = None) -> PropertyGraph:
        """Registers df's rows as nodes; key is a unique integer column, kept as a property."""
        self.tables += 1
        labels = (labels,) if isinstance(labels, str) else tuple(labels)
        names = properties if properties is not None else df.columns
        types = {f.name: of_spark(f.dataType) for f in df.schema.fields if f.name in names}
        rows = df.select((F.col(key).cast("bigint") + F.lit(self.tables * ID_BLOCK)).alias("id"), *[_stored(F.col(n), types[n]).alias(n) for n in names if n != "id"])
        types.pop("id", None)
        self.nodes.append(NodeTable(labels, rows, types))
        return self

    def node_id(self, label: str, key: Column) -> Column:
        """The id of the node of a registered table whose key is given."""
        for number, table in enumerate(self.nodes, 1):
            if label in table.labels:
                return key.cast("bigint") + F.lit(number * ID_BLOCK)
        raise SemanticError(f"no nodes are registered for label {label}")

    def add_rels(self, kind: str, df: DataFrame, start: tuple[str, str | Column], end: tuple[str, str | Column], key: str | None = None, properties: list[str] | None = None, row_is: str | None = None) -> PropertyGraph:
        """Registers df's rows as relationships from start to end, each a (label, key column).

        key is a unique integer column; without one, ids are given when first asked for. row_is is
        "start" or "end" if df is the table that this end's nodes were registered from: a row is
        then both the node and its relationship, and no query joins the table to itself. Rows without
        a start or an end are no relationships. Both nodes have to exist: queries that use no
        property of a node don't look for it.
        """
        for _, c in (start, end):
            df = df.where(F.col(c).isNotNull()) if isinstance(c, str) else df
        self.tables += 1
        base = self.tables * ID_BLOCK
        names = properties if properties is not None else df.columns
        types = {f.name: of_spark(f.dataType) for f in df.schema.fields if f.name in names}
        ends = [self.node_id(label, F.col(c) if isinstance(c, str) else c) for label, c in (start, end)]
        columns = [ends[0].alias("start"), ends[1].alias("end")]
        if key is not None:
            columns.insert(0, (F.col(key).cast("bigint") + F.lit(base)).alias("id"))
        own = [_stored(F.col(n), types[n]).alias(n) for n in names]
        table = RelTable(kind, df.select(*columns, *own), types, start[0], end[0], base)
        if row_is is not None and key is not None:
            label = start[0] if row_is == "start" else end[0]
            table.row_side, table.row_node = row_is, next(t for t in self.nodes if label in t.labels)
            table.wide = df.select(*columns, *own, *[_stored(F.col(n), v).alias(f"n__{n}") for n, v in table.row_node.types.items()])
        self.rels.append(table)
        return self


def _stored(column: Column, kind: Type) -> Column:
    return column.cast(spark_type(kind)) if kind.name not in ("List", "Map") else column
