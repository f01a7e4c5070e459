"""Nodes from streams: every micro-batch becomes a stored part of a session's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.types import of_spark, spark_type
from graphloom.operators.mutate import numbered_nodes, validate
from graphloom.session import GraphSession
from graphloom.sources.graph import NodeTable
from graphloom.sources.shared import files


class _Store:
    """Nodes of one stream in a folder: one part for each batch, `epoch=<number>`.

    A part counts once its writer has committed it; a batch that is tried again finds it, or writes
    it anew. All parts are one table, so a plan does not grow with the batches.
    """

    def __init__(self, session: GraphSession, labels: tuple[str, ...], schema, path: str):
        self.session, self.labels, self.path = session, labels, path
        self.types = {f.name: of_spark(f.dataType) for f in schema.fields}
        self.schema = ", ".join(["id bigint", *(f"`{k}` {spark_type(v)}" for k, v in self.types.items())])
        self.table: NodeTable | None = None
        parts = files(session.spark, f"{path}/epoch=*/_SUCCESS")
        self.epochs = {int(p.rsplit("epoch=", 1)[1].split("/")[0]) for p in parts}
        if self.epochs:
            self._attach()
            most = self.table.df.agg(F.max("id")).first()[0] or 0
            session.graph.next_node = max(session.graph.next_node, most + 1)

    def _attach(self) -> None:
        """Puts the table of all committed parts in the place of the one before."""
        spark, graph = self.session.spark, self.session.graph.copy()
        parts = [f"{self.path}/epoch={n}" for n in sorted(self.epochs)]
        df = spark.read.schema(self.schema).parquet(*parts)
        table = NodeTable(self.labels, df, self.types, True)
        graph.nodes = [*[t for t in graph.nodes if t is not self.table], table]
        self.table, self.session.graph = table, graph

    def add(self, batch: DataFrame, epoch: int) -> None:
        if epoch in self.epochs:
            return
        graph = self.session.graph
        rows, count, _ = numbered_nodes(batch, graph.next_node)
        for constraint in graph.constraints.values():
            validate(graph, constraint, [NodeTable(self.labels, rows, self.types)])
        rows.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        self.epochs.add(epoch)
        self._attach()
        self.session.graph.next_node = max(self.session.graph.next_node, graph.next_node + count)


def stream_nodes(session: GraphSession, stream: DataFrame, labels: tuple[str, ...], checkpoint: str, store: str | None = None) -> StreamingQuery:
    """Starts a query that adds a node with these labels for every row of the stream.

    The nodes are kept in the folder `store` (by default beside the checkpoint), which has to last as
    long as the checkpoint does: started again with both, also in another session, the query first
    gives the session's graph the nodes of all batches before, and each batch is added once.
    Rows late for a window are the stream's own matter (withWatermark). A batch that breaks a
    constraint stops the query and leaves the graph as it was; statements read the version of the
    moment at which they are planned. Ids of entities that an earlier session created, but did
    not save, may be given again.
    """
    nodes = _Store(session, labels, stream.schema, store or f"{checkpoint.rstrip('/')}-nodes")
    return stream.writeStream.foreachBatch(nodes.add).option("checkpointLocation", checkpoint).start()
