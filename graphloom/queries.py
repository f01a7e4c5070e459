"""Registered queries: Cypher over the driver's tables, each with DuckDB SQL that gives its rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import ConstraintError, CypherError
from graphloom.functions import registry
from graphloom.session import GraphSession
from graphloom.sources.graph import PropertyGraph
from graphloom.sources.shared import shared_dir
from graphloom.sources.tables import event_graph, sales_graph, turn_graph

#: name -> (graph, Cypher, SQL or None)
CYPHER: dict[str, tuple[Callable, str, str | None]] = {}


def add(name: str, cypher: str, sql: str | None, graph: Callable = sales_graph) -> None:
    CYPHER[name] = (graph, cypher, sql)


@lru_cache(maxsize=8)
def registered(graph: Callable, spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """A graph is registered once for a session and a folder, as tables of a catalog are; that
    keeps schemas and file lists, not rows."""
    return graph(spark, sf_dir)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, text, _ = CYPHER[name]
    return GraphSession(spark, registered(graph, spark, sf_dir)).cypher(text)


FLAGSHIP = "two_hop_filter"
add(
    FLAGSHIP,
    "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 1000 RETURN c.c_name AS name, o.o_totalprice AS price",
    "SELECT c_name AS name, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000",
)

# Scans

add("node_scan_label", "MATCH (n:Nation) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation")
add("node_scan_all", "MATCH (n) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS n")
add("node_label_or", "MATCH (n:Region|Nation) RETURN n.r_name AS region, n.n_name AS nation", "SELECT r_name AS region, NULL AS nation FROM region UNION ALL SELECT NULL, n_name FROM nation")
add("node_label_and", "MATCH (n:Party&Supplier) WHERE n.s_acctbal < 0 RETURN n.s_suppkey AS k", "SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 0")
add("node_label_shared", "MATCH (n:Party) RETURN n:Customer AS customer, count(*) AS n", "SELECT true AS customer, count(*) AS n FROM customer UNION ALL SELECT false, count(*) FROM supplier")
add("node_label_unknown", "MATCH (n:Nowhere) RETURN n.x AS x, id(n) AS i", "SELECT CAST(NULL AS VARCHAR) AS x, CAST(NULL AS BIGINT) AS i WHERE false")
add("inline_props", "MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'")
add("index_seek_point", "MATCH (o:Order {o_orderkey: 7}) WHERE o.o_totalprice > 0 RETURN o.o_orderkey AS k, o.o_orderstatus AS s", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey = 7 AND o_totalprice > 0")
add("where_and_or_not", "MATCH (p:Part) WHERE (p.p_size < 10 OR p.p_size > 40) AND NOT p.p_brand = 'Brand#11' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT p_brand = 'Brand#11'")
add("inline_where", "MATCH (p:Part WHERE p.p_size = 5) RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size = 5")
add("where_constant_false", "MATCH (r:Region) WHERE 1 = 2 RETURN r.r_name AS name", "SELECT r_name AS name FROM region WHERE 1 = 2")

# Expansions

add("expand_out", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN c.c_custkey AS k, n.n_name AS nation", "SELECT c_custkey AS k, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
add("expand_in", "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
add("expand_both", "MATCH (n:Nation)-[:IN_REGION]-(x) RETURN n.n_name AS nation, x.r_name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
add("expand_both_unlabelled", "MATCH (a)-[:IN_REGION]-(b) RETURN count(*) AS n", "SELECT 2 * count(*) AS n FROM nation")
add("expand_no_property", "MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem")
add("expand_type_list", "MATCH (x)-[:IN_NATION|IN_REGION]->(y) RETURN y.n_name AS nation, y.r_name AS region, count(*) AS n", "SELECT n_name AS nation, NULL AS region, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY n_name UNION ALL SELECT NULL, r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
add("expand_type_unknown", "MATCH (a:Nation)-[:NO_SUCH]->(b) RETURN a.n_name AS name", "SELECT n_name AS name FROM nation WHERE false")
add("rel_properties", "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 49 RETURN o.o_orderkey AS o, p.p_name AS p, l.l_quantity AS q, l.l_linenumber AS n", "SELECT o_orderkey AS o, p_name AS p, l_quantity AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49")
add("rel_inline_props", "MATCH (:Order)-[l:CONTAINS {l_returnflag: 'R'}]->(p:Part) RETURN p.p_brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY p_brand")
add("expand_into_cycle", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:SUPPLIED_BY]->(s) RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey GROUP BY n_name")
add("four_hop_rollup", "MATCH (r:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(:Part) RETURN r.r_name AS region, count(*) AS n, count(DISTINCT c.c_custkey) AS customers, round(sum(l.l_extendedprice)) AS price", "SELECT r_name AS region, count(*) AS n, count(DISTINCT c_custkey) AS customers, round(sum(l_extendedprice)) AS price FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name")
add("comma_join", "MATCH (c:Customer)-[:PLACED]->(o:Order), (o)-[:SUPPLIED_BY]->(s:Supplier) WHERE c.c_acctbal > 9000 RETURN c.c_custkey AS c, s.s_suppkey AS s", "SELECT c_custkey AS c, l_suppkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 9000")
add("cartesian", "MATCH (r:Region), (n:Nation) RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation")
add("theta_join", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier) WHERE c.c_acctbal < s.s_acctbal RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal < s_acctbal GROUP BY n_name")
add("node_equality", "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE a <> b RETURN a.n_name AS a, b.n_name AS b", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey")

# Variable length

_CHAIN = "WITH e AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), n AS (SELECT * FROM e WHERE b IS NOT NULL)"
add("var_1_3", "MATCH (a:Event)-[r:NEXT*1..3]->(b:Event) RETURN a.event_id AS a, b.event_id AS b, size(r) AS n", f"{_CHAIN} SELECT a, b, CAST(1 AS BIGINT) AS n FROM n UNION ALL SELECT x.a, y.b, 2 FROM n x JOIN n y ON x.b = y.a UNION ALL SELECT x.a, z.b, 3 FROM n x JOIN n y ON x.b = y.a JOIN n z ON y.b = z.a", event_graph)
add("var_exact_2", "MATCH (a:Event)-[:NEXT*2]->(b) RETURN a.event_id AS a, b.event_id AS b", f"{_CHAIN} SELECT x.a, y.b FROM n x JOIN n y ON x.b = y.a", event_graph)
add("var_zero", "MATCH (a:Event {event_type: 'purchase'})-[r:NEXT*0..1]->(b) RETURN a.event_id AS a, b.event_id AS b, size(r) AS n", f"{_CHAIN} SELECT event_id AS a, event_id AS b, CAST(0 AS BIGINT) AS n FROM events WHERE event_type = 'purchase' UNION ALL SELECT a, b, 1 FROM n JOIN events ON event_id = a WHERE event_type = 'purchase'", event_graph)
add("var_backwards", "MATCH (a:Event {event_type: 'purchase'})<-[:NEXT*1..2]-(b) RETURN a.event_id AS a, b.event_id AS b", f"{_CHAIN}, p AS (SELECT b AS a, a AS b FROM n) SELECT p.a, p.b FROM p JOIN events ON event_id = a WHERE event_type = 'purchase' UNION ALL SELECT p.a, q.b FROM p JOIN p q ON p.b = q.a JOIN events ON event_id = p.a WHERE event_type = 'purchase'", event_graph)
add("var_undirected_trail", "MATCH (a:Turn {turn: 0})-[r:TURN_NEXT*1..3]-(b) RETURN a.conv_id AS c, b.turn AS t, size(r) AS n", "SELECT x.conv_id AS c, y.turn AS t, y.turn AS n FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn BETWEEN 1 AND 3 WHERE x.turn = 0", turn_graph)
_TURNS = "WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS a, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), p AS (SELECT a, b, CAST(1 AS BIGINT) AS n FROM t WHERE b IS NOT NULL UNION ALL SELECT p.a, t.b, n + 1 FROM p JOIN t ON p.b = t.a WHERE t.b IS NOT NULL)"
add("var_unbounded", "MATCH p = (a:Turn)-[:TURN_NEXT*]->(b:Turn) RETURN a.turn_id AS a, b.turn_id AS b, length(p) AS n", f"{_TURNS} SELECT a, b, n FROM p", turn_graph)
add("var_into", "MATCH (a:Turn)-[:TURN_NEXT]->(m:Turn)-[:TURN_NEXT]->(b:Turn), (a)-[r:TURN_NEXT*1..4]->(b) RETURN a.turn_id AS a, size(r) AS n", f"{_TURNS} SELECT a, n FROM p WHERE n = 2", turn_graph)
add("path_length", "MATCH p = (u:User)-[:DID]->(e:Event)-[:NEXT]->(f:Event) RETURN u.user_id AS u, length(p) AS n, count(*) AS c", f"{_CHAIN} SELECT user_id AS u, CAST(2 AS BIGINT) AS n, count(*) AS c FROM n JOIN events ON event_id = a GROUP BY user_id", event_graph)
add("shortest_path", "MATCH p = ANY SHORTEST PATHS (a:Turn {turn: 0})-[:TURN_NEXT*1..4]-(b:Turn) RETURN b.turn_id AS b, length(p) AS n", "SELECT conv_id * 1000 + turn AS b, turn AS n FROM conversations WHERE turn BETWEEN 1 AND 4", turn_graph)
add("quantified_path", "MATCH (a:Turn {turn: 0}) ((x)-[:TURN_NEXT]->(y) WHERE x.turn < 3){1,4} (b:Turn) RETURN b.turn_id AS b", "SELECT conv_id * 1000 + turn AS b FROM conversations WHERE turn BETWEEN 1 AND 3", turn_graph)

# Projection, aggregation, order, sets

add("with_chain", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, o WHERE o.o_totalprice > 300000 MATCH (c)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, o.o_orderkey AS k", "SELECT n_name AS nation, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
add("with_where", "MATCH (p:Part) WITH p.p_size AS size, p.p_brand AS brand WHERE size = 7 RETURN size, brand", "SELECT CAST(p_size AS BIGINT) AS size, p_brand AS brand FROM part WHERE p_size = 7")
add("with_aggregate_filter", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 15 RETURN c.c_custkey AS k, n", "SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) > 15")
add("with_star", "MATCH (n:Nation) WITH *, n.n_regionkey AS r WHERE r = 1 RETURN n.n_name AS name, r", "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_regionkey = 1")
add("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
add("agg_count", "MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) AS n", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus")
add("agg_sum_avg", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, round(sum(c.c_acctbal)) AS s, round(avg(c.c_acctbal)) AS a, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi", "SELECT c_mktsegment AS seg, round(sum(c_acctbal)) AS s, round(avg(c_acctbal)) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_mktsegment")
add("agg_distinct", "MATCH (o:Order)-[:SUPPLIED_BY]->(s:Supplier) RETURN o.o_orderpriority AS p, count(DISTINCT s.s_suppkey) AS n", "SELECT o_orderpriority AS p, count(DISTINCT l_suppkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
add("agg_expression", "MATCH (p:Part) RETURN p.p_brand AS b, count(*) * 2 + 1 AS n", "SELECT p_brand AS b, count(*) * 2 + 1 AS n FROM part GROUP BY p_brand")
add("collect_size", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n.n_name) AS names RETURN r.r_name AS region, size(names) AS n", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
add("distinct", "MATCH (p:Part) RETURN DISTINCT p.p_brand AS brand, p.p_size AS size", "SELECT DISTINCT p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part")
add("order_skip_limit", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10 OFFSET 5")
add("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("union_all", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("unwind", "UNWIND [3, 1, 2] AS k MATCH (r:Region) WHERE r.r_regionkey = k RETURN k, r.r_name AS name", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region WHERE r_regionkey IN (1, 2, 3)")

# Expressions

add("arith_mix", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size * 2 - 3 AS i, p.p_size + 0.5 AS f, -p.p_size AS neg", "SELECT p_partkey AS k, CAST(p_size * 2 - 3 AS BIGINT) AS i, p_size + CAST(0.5 AS DOUBLE) AS f, CAST(-p_size AS BIGINT) AS neg FROM part")
add("int_division", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size / 7 AS d, (0 - p.p_size) / 7 AS e, (0 - p.p_size) % 7 AS m", "SELECT p_partkey AS k, CAST(p_size // 7 AS BIGINT) AS d, CAST(-(p_size // 7) AS BIGINT) AS e, CAST(-(p_size % 7) AS BIGINT) AS m FROM part")
add("pow_mod", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size ^ 2 AS sq, p.p_size % 2.5 AS m", "SELECT p_partkey AS k, CAST(p_size * p_size AS DOUBLE) AS sq, p_size % CAST(2.5 AS DOUBLE) AS m FROM part")
add("null_logic", "RETURN false AND null AS a, false OR null AS b, true OR null AS c, true XOR null AS d, NOT null AS e, null = null AS f, 1 < null AS g", "SELECT CAST(NULL AS BOOLEAN) AS a, false AS b, true AS c, CAST(NULL AS BOOLEAN) AS d, CAST(NULL AS BOOLEAN) AS e, CAST(NULL AS BOOLEAN) AS f, CAST(NULL AS BOOLEAN) AS g")
add("is_null", "MATCH (n:Party) WHERE n.c_name IS NULL RETURN n.s_name AS name", "SELECT s_name AS name FROM supplier")
add("cross_type_compare", "MATCH (r:Region) RETURN r.r_name = 1 AS eq, r.r_name <> 1 AS ne, r.r_name < 1 AS lt, r.r_regionkey = 1.0 AS num", "SELECT false AS eq, true AS ne, CAST(NULL AS BOOLEAN) AS lt, r_regionkey = 1 AS num FROM region")
add("list_index_slice", "MATCH (r:Region) WITH r.r_regionkey AS k, [10, 20, 30, 40] AS xs RETURN k, xs[k] AS x, xs[-1] AS last, size(xs[1..-1]) AS n, xs[9] AS none", "SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(CASE WHEN r_regionkey < 4 THEN 10 * (r_regionkey + 1) END AS BIGINT) AS x, CAST(40 AS BIGINT) AS last, CAST(2 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS none FROM region")
add("string_predicates", "MATCH (p:Part) WHERE p.p_brand STARTS WITH 'Brand' AND p.p_type CONTAINS 'A' AND NOT p.p_name ENDS WITH 'q' AND p.p_size IN [1, 2, 3] RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_brand LIKE 'Brand%' AND p_type LIKE '%A%' AND NOT p_name LIKE '%q' AND p_size IN (1, 2, 3)")
add("string_concat", "MATCH (n:Nation) RETURN n.n_name + ':' + n.n_regionkey AS t, upper(n.n_name) AS u, lower(n.n_name) AS l", "SELECT n_name || ':' || n_regionkey AS t, upper(n_name) AS u, lower(n_name) AS l FROM nation")
add("case_coalesce", "MATCH (n:Party) RETURN CASE WHEN n.c_acctbal > 0 THEN 'in' WHEN n.c_acctbal <= 0 THEN 'out' ELSE 'other' END AS side, count(*) AS n", "SELECT CASE WHEN b > 0 THEN 'in' WHEN b <= 0 THEN 'out' ELSE 'other' END AS side, count(*) AS n FROM (SELECT c_acctbal AS b FROM customer UNION ALL SELECT NULL FROM supplier) GROUP BY 1")
add("date_duration", "MATCH (o:Order {o_orderstatus: 'F'}) RETURN o.o_orderkey AS k, date(o.o_orderdate) + duration('P1M3D') AS later, date(o.o_orderdate) - duration('P1M') AS before", "SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH + INTERVAL 3 DAY AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS before FROM orders WHERE o_orderstatus = 'F'")
add("date_diff", "MATCH (o:Order) WITH o.o_orderkey AS k, date(o.o_orderdate) - date('1990-01-01') AS d RETURN k, d = duration('P0D') AS same, toString(d) AS t", "SELECT o_orderkey AS k, false AS same, 'P0M' || (CAST(o_orderdate AS DATE) - DATE '1990-01-01') || 'DT0S0' AS t FROM orders")
add("local_date_time", "MATCH (e:Event) WHERE e.ts + duration('PT1H') < localdatetime('2024-01-10T00:00:00') RETURN count(*) AS n", "SELECT count(*) AS n FROM events WHERE ts + INTERVAL 1 HOUR < TIMESTAMP '2024-01-10 00:00:00'", event_graph)

add("concat_operator", "MATCH (n:Nation) RETURN n.n_name || '/' || n.n_name AS t, size([n.n_nationkey] || [1, 2]) AS n", "SELECT n_name || '/' || n_name AS t, CAST(3 AS BIGINT) AS n FROM nation")
add("map_literal", "MATCH (n:Nation) WITH {name: n.n_name, at: {region: n.n_regionkey}} AS m RETURN m.name AS name, m.at.region + 1 AS r", "SELECT n_name AS name, CAST(n_regionkey + 1 AS BIGINT) AS r FROM nation")
add("conversions", "MATCH (p:Part) RETURN p.p_partkey AS k, toInteger(toString(p.p_size)) + 1 AS i, toFloat(toString(p.p_size)) / 4 AS f, toInteger(p.p_name) AS none", "SELECT p_partkey AS k, CAST(p_size + 1 AS BIGINT) AS i, p_size / CAST(4 AS DOUBLE) AS f, CAST(NULL AS BIGINT) AS none FROM part")
add("math", "MATCH (p:Part) RETURN p.p_partkey AS k, abs(10 - p.p_size) AS a, sqrt(p.p_size * p.p_size) AS s, floor(p.p_size / 4.0) AS f, ceil(p.p_size / 4.0) AS c, sign(10 - p.p_size) AS g", "SELECT p_partkey AS k, CAST(abs(10 - p_size) AS BIGINT) AS a, CAST(p_size AS DOUBLE) AS s, CAST(floor(p_size / CAST(4 AS DOUBLE)) AS DOUBLE) AS f, CAST(ceil(p_size / CAST(4 AS DOUBLE)) AS DOUBLE) AS c, CAST(sign(10 - p_size) AS BIGINT) AS g FROM part")
add("local_time", "MATCH (e:Event) WITH localtime(e.ts) AS t, e.event_id AS k RETURN k, toString(t + duration('PT25H')) = toString(t + duration('PT1H')) AS round, t < localtime('12:00:00') AS early", "SELECT event_id AS k, true AS round, CAST(ts AS TIME) < TIME '12:00:00' AS early FROM events", event_graph)
add("zoned_date_time", "MATCH (n:Nation) WITH n.n_name AS name, datetime('2024-01-31T23:30:00+02:00') + duration('P' + n.n_regionkey + 'M') AS z RETURN name, z > datetime('2024-03-01T00:00:00+00:00') AS late, toString(date(z)) AS d", "SELECT n_name AS name, n_regionkey >= 2 AS late, CAST(CAST(DATE '2024-01-31' + to_months(CAST(n_regionkey AS INTEGER)) AS DATE) AS VARCHAR) AS d FROM nation")
add("infinity", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_retailprice < INF AS a, 1 / 0.0 = INF AS b", "SELECT p_partkey AS k, true AS a, true AS b FROM part")
add("stdev", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, round(stdev(c.c_acctbal)) AS s", "SELECT c_mktsegment AS seg, round(stddev_samp(c_acctbal)) AS s FROM customer GROUP BY c_mktsegment")
add("mixed_list", "MATCH (r:Region) WITH r.r_name AS name, [r.r_name, r.r_regionkey, true] AS xs RETURN name, size(xs) AS n, size(xs[1..]) AS m", "SELECT r_name AS name, CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS m FROM region")

# Paths and their selectors

add("with_order_before_where", "MATCH (c:Customer) WITH c.c_custkey AS k ORDER BY k SKIP 2 LIMIT 10 WHERE k % 2 = 0 RETURN k", "SELECT k FROM (SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 10 OFFSET 2) t WHERE k % 2 = 0")
add("walk", "MATCH WALK (a:Turn {turn: 1})-[r:TURN_NEXT*2]-(b:Turn) RETURN a.turn_id AS a, b.turn_id AS b, count(*) AS n", f"{_TURNS}, u AS (SELECT a, b FROM t WHERE b IS NOT NULL UNION ALL SELECT b, a FROM t WHERE b IS NOT NULL) SELECT x.a, y.b, count(*) AS n FROM u x JOIN u y ON x.b = y.a WHERE x.a % 1000 = 1 GROUP BY x.a, y.b", turn_graph)
add("var_prefilter", "MATCH (o:Order {o_orderstatus: 'P'})-[l:CONTAINS*1..2 {l_returnflag: 'N'}]->(p) RETURN o.o_orderkey AS k, count(*) AS n", "SELECT o_orderkey AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_returnflag = 'N' GROUP BY o_orderkey")
add("path_functions", "MATCH p = (a:Turn {turn: 0})-[:TURN_NEXT]->(b)-[:TURN_NEXT]->(c) WITH nodes(p) AS ns, relationships(p) AS rs RETURN ns[0].turn_id AS a, ns[-1].turn_id AS c, size(ns) AS n, size(rs) AS m, type(rs[0]) AS t", f"{_TURNS} SELECT x.a, y.b AS c, CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS m, 'TURN_NEXT' AS t FROM t x JOIN t y ON x.b = y.a WHERE x.a % 1000 = 0 AND y.b IS NOT NULL", turn_graph)
add("all_shortest", "MATCH p = ALL SHORTEST PATHS (a:Turn {turn: 0})-[:TURN_NEXT*1..3]-(b:Turn) RETURN b.turn_id AS b, length(p) AS n", "SELECT conv_id * 1000 + turn AS b, turn AS n FROM conversations WHERE turn BETWEEN 1 AND 3", turn_graph)
add("all_shortest_parallel", "MATCH p = ALL SHORTEST PATHS (o:Order {o_orderstatus: 'P'})-[:CONTAINS*1..2]->(x:Part) RETURN o.o_orderkey AS o, x.p_partkey AS x, count(*) AS n", "SELECT o_orderkey AS o, l_partkey AS x, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1, 2")
add("shortest_k", "MATCH p = SHORTEST 2 PATHS (a:Turn {turn: 1})-[:TURN_NEXT*1..3]->(b:Turn) RETURN b.turn_id AS b, length(p) AS n", "SELECT conv_id * 1000 + turn AS b, turn - 1 AS n FROM conversations WHERE turn BETWEEN 2 AND 4", turn_graph)
add("shortest_groups", "MATCH p = SHORTEST 1 PATH GROUPS (o:Order {o_orderstatus: 'P'})-[:CONTAINS*1..2]->(x:Part) RETURN o.o_orderkey AS o, x.p_partkey AS x, count(*) AS n", "SELECT o_orderkey AS o, l_partkey AS x, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1, 2")
add("any_k", "MATCH p = ANY 2 PATHS (o:Order {o_orderstatus: 'P'})-[:CONTAINS*1..2]->(x:Part) RETURN o.o_orderkey AS o, x.p_partkey AS x, count(*) AS n", "SELECT o_orderkey AS o, l_partkey AS x, least(count(*), 2) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1, 2")


# Statements that write, as functions


def create_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node and a relationship for every nation, created, then matched in a later statement."""
    g = GraphSession(spark, registered(sales_graph, spark, sf_dir))
    g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (:Office {code: n.n_nationkey})-[:SERVES {since: 2000}]->(n)")
    return g.cypher("MATCH (o:Office)-[s:SERVES]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN o.code AS code, s.since AS since, n.n_name AS nation, r.r_name AS region")


def constraint_keeps_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique constraint over all orders, and whether it turned a duplicate away."""
    g = GraphSession(spark, registered(sales_graph, spark, sf_dir))
    g.cypher("CREATE CONSTRAINT order_key FOR (o:Order) REQUIRE o.o_orderkey IS UNIQUE")
    try:
        g.cypher("MATCH (o:Order) WHERE o.o_orderkey < 3 CREATE (:Order {o_orderkey: o.o_orderkey})")
        refused = False
    except ConstraintError:
        refused = True
    return g.cypher("MATCH (o:Order) RETURN count(*) AS n, $refused AS refused", {"refused": refused})


def load_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's rows as maps, joined to the graph."""
    g = GraphSession(spark, registered(sales_graph, spark, sf_dir))
    return g.cypher(f"LOAD PARQUET FROM '{sf_dir}/nation.parquet' AS row MATCH (r:Region) WHERE r.r_regionkey = row.n_regionkey RETURN row.n_name AS nation, r.r_name AS region")


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as CSV, read back as maps of texts and made nodes of."""
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.csv(path, header=True)
    g = GraphSession(spark)
    g.cypher(f"LOAD CSV FROM '{path}' OPTIONS {{header: true}} AS row CREATE (:Nation {{key: toInteger(row.n_nationkey), name: row.n_name}})")
    return g.cypher("MATCH (n:Nation) RETURN n.key AS k, n.name AS name")


def load_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/region.parquet").write.json(path)
    return GraphSession(spark).cypher(f"LOAD JSON FROM '{path}' AS row RETURN row.r_regionkey + 1 AS k, row.r_name AS name")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that have to be refused, each with the kind of error that it met."""
    graph, found = registered(sales_graph, spark, sf_dir), []
    for name, text in REFUSED.items():
        try:
            GraphSession(spark, graph).cypher(text)
            found.append((name, "none"))
        except CypherError as error:
            found.append((name, type(error).__name__))
    return spark.createDataFrame(found, "statement string, error string")


#: Statements of refusals(), by what is wrong with them.
REFUSED = {
    "no return items": "MATCH () RETURN *",
    "relationship twice": "MATCH (a)-[r]->(b)-[r]->(c) RETURN a",
    "aggregate of an aggregate": "MATCH (n:Nation) RETURN sum(count(n))",
    "unknown format": "LOAD XML FROM 'x' AS r RETURN r",
    "unknown option": "LOAD CSV FROM 'x' OPTIONS {quote: 'q'} AS r RETURN r",
    "late load": "MATCH (n:Nation) LOAD CSV FROM 'x' AS r RETURN r",
    "endless walk": "MATCH WALK (a)-[*]->(b) RETURN a",
    "unknown variable": "MATCH (n:Nation) RETURN m.n_name",
}


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of each kind over the sales graph: whether a good and a bad CREATE are let in, and DDL results."""
    key = "FOR (l:Lot) REQUIRE (l.part, l.no) IS NODE KEY"
    cases = {
        "node key": (key, "CREATE (:Lot {part: 1, no: -1})", "MATCH (l:Lot) WHERE l.part < 3 CREATE (:Lot {part: l.part, no: l.no})"),
        "node key whole": (key, "CREATE (:Lot {part: 2, no: -1})", "CREATE (:Lot {part: 1})"),
        "not null": ("FOR (l:Lot) REQUIRE l.part IS NOT NULL", "CREATE (:Lot {part: 3})", "CREATE (:Lot {no: 3})"),
        "unique relationship": ("FOR ()-[u:USES]-() REQUIRE u.slip IS UNIQUE", "CREATE (:Lot {part: 1})-[:USES {slip: -1}]->(:Lot {part: 1})", "CREATE (:Lot {part: 1})-[:USES {slip: 1}]->(:Lot {part: 1})"),
    }
    found = []
    for name, (rule, good, bad) in cases.items():
        g = GraphSession(spark, registered(sales_graph, spark, sf_dir))
        g.cypher("MATCH (p:Part) CREATE (:Lot {part: p.p_partkey, no: p.p_size})-[:USES {slip: p.p_partkey}]->(p)")
        said = [g.cypher(f"CREATE CONSTRAINT rule {rule}").first()[0]]
        tried = []
        for text in (good, bad):
            try:
                g.cypher(text)
                tried.append(True)
            except ConstraintError:
                tried.append(False)
        said.append(g.cypher("DROP CONSTRAINT rule").first()[0])
        g.cypher(bad)
        found.append((name, *tried, *said))
    return spark.createDataFrame(found, "name string, good boolean, bad boolean, made string, gone string")


def whole_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, relationships and paths as RETURN gives them, taken apart."""
    g = GraphSession(spark, registered(sales_graph, spark, sf_dir))
    g.cypher("MATCH (n:Nation) CREATE p = (:Office {code: n.n_nationkey})-[:SERVES {since: 2000}]->(n)")
    rows = g.cypher("MATCH p = (o:Office)-[s:SERVES]->(n:Nation) RETURN o, s, n, p, length(p) AS steps")
    return rows.select(
        F.col("o.props.code").alias("code"), F.array_join("o.labels", ":").alias("labels"), F.col("s.rtype").alias("kind"), F.col("s.props.since").alias("since"),
        (F.col("s.start") == F.col("o.id")).alias("leaves"), (F.col("s.end") == F.col("n.id")).alias("arrives"), F.col("n.props.n_name").alias("nation"), F.col("steps"),
    )


def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph saved to a folder, opened again, and asked."""
    from graphloom.sources.store import open_graph, save

    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    save(spark, registered(sales_graph, spark, sf_dir), path)
    return GraphSession(spark, open_graph(spark, path)).cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS nation, r.r_name AS region")


def streamed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of nodes, then matched."""
    from graphloom.streaming.ingest import stream_nodes

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    folder = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")
    g = GraphSession(spark)
    query = stream_nodes(g, spark.readStream.schema(events.schema).parquet(f"{folder}/in"), ("Event",), f"{folder}/checkpoint")
    query.processAllAvailable()
    query.stop()
    return g.cypher("MATCH (e:Event) RETURN e.event_type AS t, count(*) AS n, count(DISTINCT id(e)) AS ids")


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one's own, used in a query."""
    registry.scalar("twice")(lambda args, context: replace(args[0], column=args[0].column * 2))
    return GraphSession(spark, registered(sales_graph, spark, sf_dir)).cypher("MATCH (r:Region) RETURN r.r_name AS name, twice(r.r_regionkey) AS k")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical steps of a query, one a row."""
    g = GraphSession(spark, registered(sales_graph, spark, sf_dir))
    text = g.explain("MATCH (c:Customer {c_custkey: 1})-[:PLACED]->(o:Order) RETURN o.o_orderkey")
    return spark.createDataFrame([(k, x) for k, x in enumerate(text.split("\n\n")[0].splitlines())], "at bigint, step string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run, name) for name in CYPHER} | {
    f.__name__: f
    for f in (
        create_then_match, constraint_keeps_keys, load_parquet, load_csv, load_json, refusals, constraints, whole_entities, stored_graph, streamed_nodes, user_function, explained,
    )
}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, _, sql) in CYPHER.items() if sql} | {
    "create_then_match": "SELECT CAST(n_nationkey AS BIGINT) AS code, CAST(2000 AS BIGINT) AS since, n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "constraint_keeps_keys": "SELECT count(*) AS n, true AS refused FROM orders",
    "load_csv": "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation",
    "load_json": "SELECT CAST(r_regionkey + 1 AS BIGINT) AS k, r_name AS name FROM region",
    "refusals": "SELECT * FROM (VALUES ('no return items', 'SemanticError'), ('relationship twice', 'SemanticError'), ('aggregate of an aggregate', 'SemanticError'), ('unknown format', 'SemanticError'), ('unknown option', 'SemanticError'), ('late load', 'SemanticError'), ('endless walk', 'NotSupported'), ('unknown variable', 'SemanticError')) AS t(statement, error)",
    "constraints": "SELECT name, true AS good, false AS bad, 'Constraint created' AS made, 'Constraint dropped' AS gone FROM (VALUES ('node key'), ('node key whole'), ('not null'), ('unique relationship')) AS t(name)",
    "whole_entities": "SELECT CAST(n_nationkey AS BIGINT) AS code, 'Office' AS labels, 'SERVES' AS kind, CAST(2000 AS BIGINT) AS since, true AS leaves, true AS arrives, n_name AS nation, CAST(1 AS BIGINT) AS steps FROM nation",
    "stored_graph": "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "streamed_nodes": "SELECT event_type AS t, count(*) AS n, count(*) AS ids FROM events GROUP BY event_type",
    "explained": "SELECT CAST(at AS BIGINT) AS at, step FROM (VALUES (0, 'Scan c [''Customer:Party'']'), (1, 'Filter (c.c_custkey) = (1)'), (2, 'ExpandAll c -[:PLACED]-> o [''PLACED'']'), (3, 'ProduceResult')) AS t(at, step)",
    "user_function": "SELECT r_name AS name, CAST(2 * r_regionkey AS BIGINT) AS k FROM region",
    "load_parquet": "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
}
