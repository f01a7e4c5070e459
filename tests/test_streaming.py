"""Streams of rows as nodes."""

import pytest
from pyspark.sql import functions as F

from graphloom.format import rows_of
from graphloom.session import GraphSession
from graphloom.streaming.ingest import stream_nodes


def test_every_batch_is_added_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(40).select(F.col("id").alias("key"), (F.col("id") % 4).cast("int").alias("kind"))
    rows.where("key < 25").repartition(3).write.parquet(source)
    g = GraphSession(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream_nodes(g, stream, ("Event",), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    rows.where("key >= 25").write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert rows_of(g.cypher("MATCH (e:Event) RETURN count(*), count(DISTINCT id(e)), sum(e.key)")) == [f"40\t40\t{sum(range(40))}"]
    assert rows_of(g.cypher("MATCH (e:Event {kind: 1}) RETURN min(e.key)")) == ["1"]


def test_a_batch_against_a_constraint_stops_the_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).select((F.col("id") * 0).alias("key")).write.parquet(source)
    g = GraphSession(spark)
    g.cypher("CREATE CONSTRAINT one FOR (e:Event) REQUIRE e.key IS UNIQUE")
    query = stream_nodes(g, spark.readStream.schema("key bigint").parquet(source), ("Event",), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception, match="constraint violation"):
        query.processAllAvailable()
    assert rows_of(g.cypher("MATCH (e) RETURN count(*)")) == ["0"]


def test_a_restarted_stream_has_its_nodes_again(spark, tmp_path):
    source, rows = str(tmp_path / "in"), spark.range(30).select(F.col("id").alias("key"))
    for part in ("key < 10", "key >= 10"):
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
        g = GraphSession(spark)
        g.cypher("CREATE CONSTRAINT one FOR (e:Event) REQUIRE e.key IS UNIQUE")
        query = stream_nodes(g, spark.readStream.schema("key bigint").parquet(source), ("Event",), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    g.cypher("CREATE (:Event {key: 99})")
    assert rows_of(g.cypher("MATCH (e:Event) RETURN count(*), count(DISTINCT id(e)), sum(e.key)")) == [f"31\t31\t{sum(range(30)) + 99}"]
