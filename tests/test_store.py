"""Saved graphs, registered tables, and the prompt."""

import pytest

from graphloom.__main__ import answer
from graphloom.errors import ConstraintError
from graphloom.format import rows_of
from graphloom.session import GraphSession
from graphloom.sources.graph import PropertyGraph
from graphloom.sources.store import open_graph, save


def test_a_saved_graph_is_the_same(spark, tmp_path):
    g = GraphSession(spark)
    g.cypher("CREATE (a:A:B {k: 1, t: localtime('10:00:00'), xs: [1, 2], d: date('2020-01-02')})-[:R {w: 1.5}]->(b:C {z: datetime('2020-01-01T00:00:00+01:00')})")
    g.cypher("CREATE CONSTRAINT one FOR (a:A) REQUIRE a.k IS UNIQUE")
    path = str(tmp_path / "graph")
    save(spark, g.graph, path)
    back = GraphSession(spark, open_graph(spark, path))
    text = "MATCH p = (a:A)-[r:R]->(c) RETURN a, r, c, p"
    assert rows_of(back.cypher(text)) == rows_of(g.cypher(text))
    with pytest.raises(ConstraintError):
        back.cypher("CREATE (:A {k: 1})")
    assert rows_of(back.cypher("CREATE (x:A {k: 2}) RETURN id(x)")) == ["3"]


def registered(spark, rows_hold_nodes):
    people = spark.createDataFrame([(1, "a", 2, 5), (2, "b", None, 6), (3, "c", 1, None)], "pid int, name string, boss int, team int")
    teams = spark.createDataFrame([(5, "x"), (6, "y"), (7, "z")], "tid int, team_name string")
    g = PropertyGraph()
    g.add_nodes(("Person", "Being"), people, "pid").add_nodes("Team", teams, "tid")
    side = "start" if rows_hold_nodes else None
    g.add_rels("BOSS", people, ("Person", "pid"), ("Person", "boss"), "pid", [], side)
    g.add_rels("IN", people, ("Person", "pid"), ("Team", "team"), "pid", ["name"], side)
    return GraphSession(spark, g)


@pytest.mark.parametrize("text", [
    "MATCH (a:Person)-[:BOSS]->(b) RETURN a.name, b.name", "MATCH (a)-[:BOSS]->(b:Person) RETURN count(*)", "MATCH (a:Person {name: 'a'})-[:BOSS]-(b) RETURN b.pid, b.name",
    "MATCH (t:Team)<-[i:IN]-(p) RETURN t.team_name, p.name, i.name", "MATCH (p:Person)-[i]->(x) RETURN p.name, type(i), x.team_name", "MATCH (t:Team) OPTIONAL MATCH (t)<-[:IN]-(p:Person) RETURN t.team_name, p.name",
    "MATCH (p:Person) OPTIONAL MATCH (p)-[:BOSS]->(b)-[:IN]->(t) RETURN p.name, b.name, t.team_name", "MATCH (a:Being)-[:BOSS]->(b)-[:BOSS]->(a) RETURN a.name, b.name", "MATCH (a)-[:BOSS*]->(b) RETURN a.name, b.name",
    "MATCH (a:Person WHERE a.pid > 1)-[:IN]->(t) RETURN a, t", "MATCH p = (a)-[:BOSS]->(b)-[:IN]->(t:Team) RETURN p", "MATCH (a:Team)-[:BOSS]->(b) RETURN a", "MATCH (t:Team), (p:Person)-[:IN]->(t) RETURN t.tid, p.pid",
])
def test_rows_that_hold_their_node_change_plans_only(spark, text):
    assert sorted(rows_of(registered(spark, True).cypher(text))) == sorted(rows_of(registered(spark, False).cypher(text)))


def test_rows_that_hold_their_node_are_not_joined_to_themselves(spark):
    plan = registered(spark, True).explain("MATCH (p:Person)-[:IN]->(t:Team) RETURN p.name")
    assert "Join" not in plan
    assert sorted(rows_of(registered(spark, True).cypher("MATCH (p:Person)-[:IN]->(t) RETURN p.name, t.team_name"))) == ["'a'\t'x'", "'b'\t'y'"]


def test_prompt(spark):
    g = GraphSession(spark)
    assert answer(g, "RETURN 1 AS x").startswith("x\n1\n1 rows")
    assert "parse error" in answer(g, "RETURN") or "At least one" in answer(g, "RETURN")
    assert "Scan" in answer(g, ".explain MATCH (n) RETURN n")
