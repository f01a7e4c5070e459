"""The driver's tables as a property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.graph import PropertyGraph


def sales_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders, with their foreign keys.

    Line items have no key of their own, so CONTAINS and SUPPLIED_BY get ids only if a query asks
    for them. Every scan stays lazy: columns and rows that a query leaves out are not read.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, customer, supplier, part, orders, lineitem = map(read, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    g = PropertyGraph()
    g.add_nodes("Region", region, "r_regionkey").add_nodes("Nation", nation, "n_nationkey")
    g.add_nodes(("Customer", "Party"), customer, "c_custkey").add_nodes(("Supplier", "Party"), supplier, "s_suppkey")
    g.add_nodes("Part", part, "p_partkey").add_nodes("Order", orders, "o_orderkey")
    g.add_rels("IN_REGION", nation, ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey", [], "start")
    g.add_rels("IN_NATION", customer, ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey", [], "start")
    g.add_rels("IN_NATION", supplier, ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey", [], "start")
    g.add_rels("PLACED", orders, ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey", [], "end")
    line = [c for c in lineitem.columns if c not in ("l_orderkey", "l_partkey", "l_suppkey")]
    g.add_rels("CONTAINS", lineitem, ("Order", "l_orderkey"), ("Part", "l_partkey"), None, line)
    g.add_rels("SUPPLIED_BY", lineitem, ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), None, line)
    return g


def event_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users and their events; NEXT leads from an event to the user's next one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.select("user_id").distinct()
    g = PropertyGraph()
    g.add_nodes("User", users, "user_id").add_nodes("Event", events, "event_id")
    g.add_rels("DID", events, ("User", "user_id"), ("Event", "event_id"), "event_id", [], "end")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    following = events.select("event_id", "user_id", F.lead("event_id").over(order).alias("next_id")).where("next_id is not null")
    g.add_rels("NEXT", following, ("Event", "event_id"), ("Event", "next_id"), "event_id", [])
    return g


def turn_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Turns of conversations; TURN_NEXT leads from a turn to the following one."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = turns.withColumn("turn_id", F.col("conv_id") * 1000 + F.col("turn"))
    g = PropertyGraph()
    g.add_nodes("Turn", turns, "turn_id", ["conv_id", "turn", "role", "turn_id"])
    order = Window.partitionBy("conv_id").orderBy("turn")
    following = turns.select("turn_id", F.lead("turn_id").over(order).alias("next_id")).where("next_id is not null")
    g.add_rels("TURN_NEXT", following, ("Turn", "turn_id"), ("Turn", "next_id"), "turn_id", [])
    return g
