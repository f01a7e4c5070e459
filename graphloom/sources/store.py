"""Graphs kept on disk: Parquet for each table, and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.functions.types import Type, of_spark
from graphloom.sources.graph import Constraint, NodeTable, PropertyGraph, RelTable


def save(spark: SparkSession, graph: PropertyGraph, path: str) -> None:
    """Writes a graph to a new folder of any file system that Spark writes to.

    The manifest comes last: a folder without one holds no graph.
    """
    nodes, rels = [], []
    for k, table in enumerate(graph.nodes):
        table.df.write.parquet(f"{path}/nodes/{k}")
        nodes.append({"labels": list(table.labels)})
    for k, table in enumerate(graph.rels):
        table.with_ids().write.parquet(f"{path}/rels/{k}")
        rels.append({"type": table.type, "start": table.start_label, "end": table.end_label, "base": table.base})
    constraints = [vars(c) for c in graph.constraints.values()]
    manifest = {"nodes": nodes, "rels": rels, "constraints": constraints, "next_node": graph.next_node, "next_rel": graph.next_rel, "tables": graph.tables}
    spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.text(f"{path}/manifest")


def open_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph that save() wrote; its tables are read when a query needs them."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    graph = PropertyGraph(next_node=manifest["next_node"], next_rel=manifest["next_rel"], tables=manifest["tables"])
    for k, node in enumerate(manifest["nodes"]):
        df = spark.read.parquet(f"{path}/nodes/{k}")
        graph.nodes.append(NodeTable(tuple(node["labels"]), df, _types(df, {"id"})))
    for k, rel in enumerate(manifest["rels"]):
        df = spark.read.parquet(f"{path}/rels/{k}")
        graph.rels.append(RelTable(rel["type"], df, _types(df, {"id", "start", "end"}), rel["start"], rel["end"], rel["base"]))
    for c in manifest["constraints"]:
        graph.constraints[c["name"]] = Constraint(**(c | {"properties": tuple(c["properties"])}))
    return graph


def _types(df, fixed: set[str]) -> dict[str, Type]:
    return {f.name: of_spark(f.dataType) for f in df.schema.fields if f.name not in fixed}
