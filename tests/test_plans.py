"""What plans look like: tables read, columns read, filters pushed down, order of joins."""

import re

import pytest

from graphloom.queries import CYPHER, sales_graph
from graphloom.session import GraphSession

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sales(spark):
    return GraphSession(spark, sales_graph(spark, SF_DIR))


def plan_of(session, text):
    return session.cypher(text)._jdf.queryExecution().executedPlan().toString()


def tables_read(plan):
    return sorted(re.findall(rf"{SF_DIR}/(\w+)\.parquet", plan))


def test_labels_choose_tables(sales):
    assert tables_read(plan_of(sales, "MATCH (n:Part) RETURN n.p_name")) == ["part"]
    assert tables_read(plan_of(sales, "MATCH (n:Party) RETURN count(*)")) == ["customer", "supplier"]
    assert tables_read(plan_of(sales, "MATCH (n:Robot) RETURN n")) == []


def test_nodes_without_used_properties_are_not_read(sales):
    assert tables_read(plan_of(sales, "MATCH (:Order)-[:CONTAINS]->(:Part) RETURN count(*)")) == ["lineitem"]
    assert tables_read(plan_of(sales, "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_name, o.o_totalprice")) == ["customer", "orders"]
    assert tables_read(plan_of(sales, "MATCH (c)-[:IN_NATION]->(n:Nation) RETURN c.c_name, n.n_name")) == ["customer", "nation", "supplier"]


def test_columns_and_filters_reach_the_scan(sales):
    plan = plan_of(sales, "MATCH (o:Order {o_orderkey: 7}) WHERE o.o_totalprice > 10 RETURN o.o_orderstatus AS s")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    assert "EqualTo(o_orderkey,7)" in plan and "GreaterThan(o_totalprice" in plan


def test_a_cycle_goes_by_keys_before_it_is_closed(sales):
    steps = sales.explain(CYPHER["expand_into_cycle"][1]).split("\n\n")[0].split("\n")
    kinds = [re.sub(r" .*\[:(\w+)\].*", r" \1", s) for s in steps if s.startswith("Expand")]
    assert kinds == ["ExpandAll IN_NATION", "ExpandAll PLACED", "ExpandAll SUPPLIED_BY", "ExpandInto IN_NATION"]


def test_no_python_at_run_time(sales):
    for _, (graph, text, _) in CYPHER.items():
        if graph is sales_graph:
            assert not re.search("Python|Pandas|Arrow", plan_of(sales, text))


def test_top_k_is_one_operator(sales):
    assert "TakeOrderedAndProject" in plan_of(sales, "MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC LIMIT 3")
