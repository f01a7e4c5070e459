"""Queries over a random road map, held against a plain matcher."""

from collections import Counter, defaultdict

import pytest
from plain import Map, line, value

from graphloom.errors import NotSupported, ParseError, SemanticError
from graphloom.format import rows_of
from graphloom.session import GraphSession

ROADS = Map()
ARROWS = {">": ("-", "->"), "<": ("<-", "-"), "-": ("-", "-")}


@pytest.fixture(scope="module")
def g(spark):
    session = GraphSession(spark)
    session.cypher(ROADS.create())
    return session


def run(g, text, **params):
    return sorted(rows_of(g.cypher(text, params)))


def lines(rows):
    return sorted(line(*r) for r in rows)


@pytest.mark.parametrize(("labels", "test"), [
    (":Depot", lambda x: "Depot" in x), (":Hub", lambda x: "Hub" in x), (":Depot&Hub", lambda x: {"Depot", "Hub"} <= set(x)),
    (":Depot|Hub", lambda x: True), ("", lambda x: True), (":Airport", lambda x: False), (":Airport|Hub", lambda x: "Hub" in x), (":Airport&Hub", lambda x: False),
])
def test_labels(g, labels, test):
    want = [s for s in ROADS.stops if test(s.labels)]
    assert run(g, f"MATCH (s{labels}) RETURN s.code") == lines([(s.props["code"],) for s in want])
    assert run(g, f"MATCH (s{labels}) RETURN s") == sorted(ROADS.node_text(s.id) for s in want)


@pytest.mark.parametrize("bays", range(6))
def test_properties(g, bays):
    want = lambda test: lines([(s.props["code"], s.props.get("zone")) for s in ROADS.stops if test(s.props)])
    assert run(g, "MATCH (s) WHERE s.bays > $n RETURN s.code, s.zone", n=bays) == want(lambda p: p["bays"] > bays)
    assert run(g, f"MATCH (s {{bays: {bays}}}) RETURN s.code, s.zone") == want(lambda p: p["bays"] == bays)
    assert run(g, "MATCH (s WHERE s.bays <= $n AND s.zone = 'N') RETURN s.code, s.zone", n=bays) == want(lambda p: p["bays"] <= bays and p.get("zone") == "N")
    assert run(g, f"MATCH (s) WHERE {bays} = {bays + 1} RETURN s") == []


def test_columns_are_named_as_written(g):
    assert g.cypher("MATCH (s) RETURN s.code, s.bays * 2, s.zone AS z").columns == ["s.code", "(s.bays) * (2)", "z"]


@pytest.mark.parametrize("way", ARROWS)
@pytest.mark.parametrize("kinds", [("ROAD",), ("RAIL",), ("ROAD", "RAIL")])
def test_one_step(g, way, kinds):
    left, right = ARROWS[way]
    steps = ROADS.steps(way, kinds)
    assert run(g, f"MATCH (a){left}[w:{'|'.join(kinds)}]{right}(b) RETURN a.code, w.no, b.code") == lines([(ROADS.code(a), w.props["no"], ROADS.code(b)) for a, w, b in steps])
    assert run(g, f"MATCH (a:Hub){left}[w:{'|'.join(kinds)} {{km: 2.5}}]{right}() RETURN w") == sorted(ROADS.way_text(w) for a, w, _ in steps if w.props["km"] == 2.5 and "Hub" in ROADS.of[a].labels)


@pytest.mark.parametrize("trail", [False, True])
def test_two_steps(spark, g, trail):
    session = GraphSession(spark, g.graph, rel_uniqueness="trail") if trail else g
    steps = ROADS.steps("-")
    want = [(ROADS.code(a), v.id, ROADS.code(b), w.id, ROADS.code(d)) for a, v, b in steps for c, w, d in steps if b == c and not (trail and v is w)]
    assert run(session, "MATCH (a)-[v]-(b)-[w]-(d) RETURN a.code, v.no, b.code, w.no, d.code") == lines(want)


@pytest.mark.parametrize(("span", "low", "high"), [("*", 1, 99), ("*2", 2, 2), ("*..2", 1, 2), ("*0..1", 0, 1), ("*3..", 3, 99), ("*2..3", 2, 3)])
@pytest.mark.parametrize("way", [">", "<"])
def test_variable_length(g, way, span, low, high):
    left, right = ARROWS[way]
    want = [(ROADS.code(a), len(ws), ws[0].id if ws else None, ws[-1].id if ws else None, ROADS.code(b)) for a, ws, b in ROADS.trails(low, high, way)]
    assert run(g, f"MATCH (a){left}[w{span}]{right}(b) RETURN a.code, size(w), w[0].no, w[-1].no, b.code") == lines(want)


def test_variable_length_of_one_kind_either_way_and_into(g):
    either = [(ROADS.code(a), sum(w.props["km"] for w in ws[:1]), ROADS.code(b)) for a, ws, b in ROADS.trails(1, 3, "-", ("RAIL",))]
    assert run(g, "MATCH (a)-[w:RAIL*1..3]-(b) RETURN a.code, w[0].km, b.code") == lines(either)
    rings = [(ROADS.code(a), [w.id for w in ws][0]) for a, ws, b in ROADS.trails(1, 4) if a == b]
    assert run(g, "MATCH (a)-[w*1..4]->(a) RETURN a.code, w[0].no") == lines(rings)
    walks = Counter((ROADS.code(a), ROADS.code(b)) for a, _, b in ROADS.trails(3, 3, walk=True))
    assert run(g, "MATCH WALK (a)-[w*3]->(b) RETURN a.code, b.code, count(*)") == lines([(*k, n) for k, n in walks.items()])
    with pytest.raises(NotSupported):
        g.cypher("MATCH WALK (a)-[*]->(b) RETURN a")


def test_cycles_and_names_used_again(g):
    steps = ROADS.steps()
    assert run(g, "MATCH (a)-->(b)-->(a) RETURN a.code, b.code") == lines([(ROADS.code(a), ROADS.code(b)) for a, _, b in steps for c, _, d in steps if (b, a) == (c, d)])
    assert run(g, "MATCH (a)-[w]->(a) RETURN w.no") == lines([(w.id,) for a, w, b in steps if a == b])
    with pytest.raises(SemanticError):
        g.cypher("MATCH (a)-[w]->(b)<-[w]-(c) RETURN a")


def test_parts(g):
    steps = ROADS.steps()
    assert run(g, "MATCH (a:Hub), (b {bays: 1}) RETURN a.code, b.code") == lines([(a.props["code"], b.props["code"]) for a in ROADS.stops for b in ROADS.stops if "Hub" in a.labels and b.props["bays"] == 1])
    assert run(g, "MATCH (a)-[v:RAIL]->(b), (c)-[w:RAIL]->(b) RETURN v.no, w.no") == lines([(v.id, w.id) for _, v, b in steps for _, w, d in steps if b == d and v.kind == w.kind == "RAIL"])


def test_with_goes_on_from_its_rows(g):
    out = Counter(w.start for w in ROADS.ways)
    want = [(ROADS.code(a), n, w.id) for a, n in out.items() if n > 1 for w in ROADS.ways if w.end == a]
    assert run(g, "MATCH (a)-[w]->() WITH a, count(w) AS n WHERE n > 1 MATCH ()-[v]->(a) RETURN a.code, n, v.no") == lines(want)
    assert run(g, "MATCH (a) WITH a MATCH (a:Hub) RETURN a.code") == lines([(s.props["code"],) for s in ROADS.stops if "Hub" in s.labels])
    assert run(g, "MATCH (a:Depot) WITH a AS b, a.bays AS n RETURN b.bays = n, count(*)") == lines([(True, sum("Depot" in s.labels for s in ROADS.stops))])


@pytest.mark.parametrize(("text", "message"), [
    ("MATCH (s) WITH s.code RETURN 1", "must be aliased"), ("MATCH (a)-->(b) WITH b RETURN a", "Variable a is not defined"), ("MATCH () RETURN *", "At least one return item"),
    ("MATCH (s) RETURN max(count(s.bays))", "not allowed"), ("MATCH (s) WHERE sum(s.bays) > 3 RETURN s", "not allowed"), ("MATCH (s) RETURN s LIMIT s.bays", "Pagination limit|not defined"),
    ("RETURN 1 AS a UNION RETURN 2 AS b", "same colum names"), ("MATCH (s) RETURN relationships(s)", "Invalid argument types Node for function relationships"),
])
def test_refused(g, text, message):
    with pytest.raises(SemanticError, match=message):
        g.cypher(text)


def test_optional_match_keeps_rows(g):
    rail = defaultdict(list)
    for w in ROADS.ways:
        if w.kind == "RAIL":
            rail[w.start].append(w.id)
    want = [(s.props["code"], n) for s in ROADS.stops for n in rail[s.id] or [None]]
    assert run(g, "MATCH (s) OPTIONAL MATCH (s)-[w:RAIL]->() RETURN s.code, w.no") == lines(want)
    late = [(s.props["code"], n) for s in ROADS.stops for n in [n for n in rail[s.id] if n > 6] or [None]]
    assert run(g, "MATCH (s) OPTIONAL MATCH (s)-[w:RAIL]->() WHERE w.no > 6 RETURN s.code, w.no") == lines(late)
    assert run(g, "OPTIONAL MATCH (s:Airport) RETURN s, s.code") == ["null\tnull"]


def test_aggregates(g):
    groups = defaultdict(list)
    for w in ROADS.ways:
        groups[w.kind].append(w.props["km"])
    want = [(k, len(x), sum(x), sum(x) / len(x), min(x), max(x), len(set(x))) for k, x in groups.items()]
    assert run(g, "MATCH ()-[w]->() RETURN type(w) AS kind, count(*) AS n, sum(w.km) AS s, avg(w.km) AS a, min(w.km) AS low, max(w.km) AS high, count(DISTINCT w.km) AS d") == lines(want)
    zones = [s.props["zone"] for s in ROADS.stops if "zone" in s.props]
    assert run(g, "MATCH (s) RETURN count(s.zone), count(DISTINCT s.zone), size(collect(s.zone)), count(*) + 1") == lines([(len(zones), len(set(zones)), len(zones), len(ROADS.stops) + 1)])
    assert run(g, "MATCH (s:Airport) RETURN count(s), sum(s.bays), min(s.bays)") == ["0\t0\tnull"]


def test_order_skip_limit_distinct(g):
    by = sorted(ROADS.stops, key=lambda s: (-s.props["bays"], s.props["code"]))
    for skip, limit in ((0, 3), (2, 2), (5, 9), (9, 1)):
        got = rows_of(g.cypher(f"MATCH (s) RETURN s.bays, s.code ORDER BY s.bays DESC, s.code SKIP {skip} LIMIT {limit}"))
        assert got == [line(s.props["bays"], s.props["code"]) for s in by[skip : skip + limit]]
    assert rows_of(g.cypher("MATCH (s) RETURN DISTINCT s.bays AS b ORDER BY b")) == [value(b) for b in sorted({s.props["bays"] for s in by})]
    assert len(run(g, "MATCH (s) RETURN s LIMIT -3")) == len(by)
    assert rows_of(g.cypher("UNWIND [3, null, 1] AS x RETURN x ORDER BY x")) == ["1", "3", "null"]
    assert rows_of(g.cypher("UNWIND [3, null, 1] AS x RETURN x ORDER BY x DESC")) == ["null", "3", "1"]


def test_union_unwind_and_parameters(g):
    bays, no = [s.props["bays"] for s in ROADS.stops], [w.id for w in ROADS.ways]
    assert run(g, "MATCH (s) RETURN s.bays AS x UNION MATCH ()-[w]->() RETURN w.no AS x") == lines((x,) for x in {*bays, *no})
    assert run(g, "MATCH (s) RETURN s.bays AS x UNION ALL MATCH ()-[w]->() RETURN w.no AS x") == lines((x,) for x in bays + no)
    assert run(g, "UNWIND $codes AS c MATCH (s {code: c}) RETURN c, s.bays", codes=["s3", "s1", "s9"]) == lines([(c, ROADS.stops[int(c[1]) - 1].props["bays"]) for c in ("s1", "s3")])
    assert run(g, "UNWIND [] AS x RETURN x") == run(g, "UNWIND null AS x RETURN x") == []


def path_text(start: int, ways: list) -> str:
    """A path as it is printed: the first node whole, then relationships and the numbers of nodes."""
    out, at = f"({ROADS.node_text(start)})", start
    for w in ways:
        ahead = w.start == at
        at = w.end if ahead else w.start
        out += f"-[{Map.way_text(w)}]->({at})" if ahead else f"<-[{Map.way_text(w)}]-({at})"
    return out


def test_paths(g):
    assert run(g, "MATCH p = (a)-[:RAIL]->(b) RETURN p") == sorted(path_text(a, [w]) for a, w, _ in ROADS.steps(">", ("RAIL",)))
    trails = [(a, ws, b) for a, ws, b in ROADS.trails(2, 2) if a == 1]
    assert run(g, "MATCH p = (a {code: 's1'})-[*2]->() RETURN p, length(p), size(nodes(p)), size(relationships(p))") == sorted(f"{path_text(a, ws)}\t2\t3\t2" for a, ws, _ in trails)
    assert run(g, "MATCH p = (a)-[w]-(b) WHERE a.code = 's4' RETURN length(p), w.no") == lines([(1, w.id) for a, w, _ in ROADS.steps("-") if a == 4])


def shortest(low: int = 1, high: int = 99) -> dict:
    """The trails of every (start, end) by length, then in any order."""
    found = defaultdict(list)
    for a, ws, b in sorted(ROADS.trails(low, high), key=lambda t: len(t[1])):
        found[a, b].append(len(ws))
    return found


def test_shortest_paths(g):
    found = shortest()
    name = lambda k, *n: (ROADS.code(k[0]), ROADS.code(k[1]), *n)
    assert run(g, "MATCH p = ANY SHORTEST PATHS (a)-[*]->(b) RETURN a.code, b.code, length(p)") == lines(name(k, x[0]) for k, x in found.items())
    assert run(g, "MATCH p = ALL SHORTEST PATHS (a)-[*]->(b) RETURN a.code, b.code, length(p)") == lines(name(k, n) for k, x in found.items() for n in x if n == x[0])
    assert run(g, "MATCH p = SHORTEST 2 PATHS (a)-[*]->(b) RETURN a.code, b.code, length(p)") == lines(name(k, n) for k, x in found.items() for n in x[:2])
    assert run(g, "MATCH p = SHORTEST 2 PATH GROUPS (a)-[*]->(b) RETURN a.code, b.code, length(p)") == lines(name(k, n) for k, x in found.items() for n in x if n in sorted(set(x))[:2])
    assert run(g, "MATCH p = ANY 3 PATHS (a)-[*1..4]->(b) RETURN a.code, b.code, count(*)") == lines(name(k, min(3, len(x))) for k, x in shortest(1, 4).items())
    one = {k: x for k, x in shortest(2, 99).items() if k[0] == 1}
    assert run(g, "MATCH p = ANY SHORTEST PATHS (a {code: 's1'})-[*2..]->(b) RETURN a.code, b.code, length(p)") == lines(name(k, x[0]) for k, x in one.items())


def test_quantified_patterns(g):
    fits = lambda ws: all(w.props["km"] > 1 for w in ws)
    want = [(ROADS.code(a), ROADS.code(b)) for a, ws, b in ROADS.trails(1, 3) if fits(ws)]
    assert run(g, "MATCH (a) ((x)-[w]->(y) WHERE w.km > 1){1,3} (b) RETURN a.code, b.code") == lines(want)
    want = [(ROADS.code(a), ROADS.code(b)) for a, ws, b in ROADS.trails(1, 99, kinds=("RAIL",)) if all(ROADS.of[w.start].props["bays"] < 4 for w in ws)]
    assert run(g, "MATCH (a) ((x)-[:RAIL]->(y) WHERE x.bays < 4)+ (b) RETURN a.code, b.code") == lines(want)


def test_entities_in_lists_keep_their_properties(g):
    first = min(ROADS.stops, key=lambda s: s.props["code"]).props
    assert run(g, "MATCH (s) WITH s ORDER BY s.code WITH collect(s) AS all RETURN size(all), all[0].bays * 2, all[0].gone") == [line(len(ROADS.stops), first["bays"] * 2, None)]
    assert run(g, "MATCH (s {code: 's1'}) WITH s, null AS x, [null] AS xs, s.gone AS y MATCH (s)-[*1..2]->(t) RETURN DISTINCT x, xs, y") == ["null\t[null]\tnull"]


def fresh(spark) -> GraphSession:
    session = GraphSession(spark)
    session.cypher(ROADS.create())
    return session


def test_create_from_rows(spark):
    session, n = fresh(spark), len(ROADS.stops)
    before = session.graph
    hubs = [s for s in ROADS.stops if "Hub" in s.labels]
    assert run(session, "MATCH (s:Hub) CREATE (k:Kiosk {at: s.code, size: s.bays + 1})<-[:OWNS]-(s) RETURN k.at, k.size") == lines([(s.props["code"], s.props["bays"] + 1) for s in hubs])
    ids = run(session, "MATCH (k:Kiosk)<-[o:OWNS]-(s) RETURN id(k), id(o)")
    assert {int(x.split("\t")[0]) for x in ids} == {n + 1 + i for i in range(len(hubs))}
    assert {int(x.split("\t")[1]) for x in ids} == {len(ROADS.ways) + 1 + i for i in range(len(hubs))}
    assert GraphSession(spark, before).cypher("MATCH (n) RETURN n").count() == n
    assert run(session, "MATCH (n) RETURN count(n)") == [str(n + len(hubs))]


def test_create_is_not_seen_by_its_own_query(spark):
    session, n = fresh(spark), len(ROADS.stops)
    assert run(session, "MATCH (s) CREATE (:Depot {code: 'x'}) WITH s MATCH (t) RETURN count(t)") == [str(n * n)]
    assert run(session, "MATCH (t) RETURN count(t)") == [str(2 * n)]


@pytest.mark.parametrize("text", ["CREATE (s)", "CREATE (s:Depot|Hub)", "CREATE (s:Depot)-[:ROAD]-(t:Hub)", "CREATE (s:Depot)-[:ROAD*3]->(t:Hub)", "CREATE (s:Depot)-[:ROAD|RAIL]->(t:Hub)", "CREATE (s:Hub)-[:ROAD]->(t:Hub), (t:Depot)"])
def test_create_refuses(spark, text):
    with pytest.raises(SemanticError):
        GraphSession(spark).cypher(text)


def test_every_storable_type(spark):
    session = GraphSession(spark)
    given = {"whole": "7", "part": "-0.25", "text": "'quay'", "day": "date('1999-12-31')", "clock": "localtime('23:59:58')", "stamp": "localdatetime('2031-07-04T05:06:07.25')", "zoned": "datetime('2001-02-03T04:05:06 -0330')", "list": "[4, 5]"}
    printed = given | {"day": "1999-12-31", "clock": "23:59:58", "stamp": "2031-07-04 05:06:07.250", "zoned": "2001-02-03 04:05:06 -03:30"}
    text = lambda props: ", ".join(f"{k}: {v}" for k, v in props.items())
    want = [f"{{id: 1, labels: [Box], props: {{{text(printed)}}}}}"]
    assert rows_of(session.cypher(f"CREATE (b:Box {{{text(given)}}})")) == want
    assert rows_of(session.cypher("MATCH (b) RETURN b")) == want
    with pytest.raises(NotSupported):
        session.cypher("CREATE (b:Box {wait: duration('PT5M')})")


def test_empty_graph(spark):
    session = GraphSession(spark)
    assert run(session, "MATCH (s) RETURN s.code") == run(session, "MATCH (s)-[w*]->(t) RETURN s") == []
    assert run(session, "MATCH (s) RETURN count(*), max(s.bays)") == ["0\tnull"]


@pytest.mark.parametrize("text", ["", "MATCH", "RETURN 3 -", "MATCH (s RETURN s", "RETURN 'quay", "MATCH (s)-[w*2..y]->(t) RETURN s"])
def test_parse_errors(spark, text):
    with pytest.raises(ParseError):
        GraphSession(spark).cypher(text)


def test_explain_shows_steps_and_spark_plan(g):
    text = g.explain("MATCH (h:Hub)-[w:RAIL]->(t) RETURN h.code")
    assert "-[w:RAIL]-> t ['RAIL']" in text and "Physical Plan" in text


def test_shortest_paths_in_a_dense_graph(spark):
    """Twenty ways from each stop: trails of six steps are 64 millions from one stop, nodes are 300."""
    import random

    from graphloom.sources.graph import PropertyGraph

    rng, n = random.Random(9), 300
    ways = [(k * 20 + j, k, rng.randrange(n)) for k in range(n) for j in range(20)]
    graph = PropertyGraph().add_nodes("Stop", spark.createDataFrame([(k,) for k in range(n)], "k bigint"), "k")
    graph.add_rels("WAY", spark.createDataFrame(ways, "no bigint, a bigint, b bigint"), ("Stop", "a"), ("Stop", "b"), "no", [])
    g = GraphSession(spark, graph)
    far, front, length = {}, {0}, 0
    while front:
        length += 1
        front = {b for _, a, b in ways if a in front and b not in far}
        far |= dict.fromkeys(front, length)
    assert run(g, "MATCH p = ANY SHORTEST PATHS (a:Stop {k: 0})-[:WAY*1..6]->(b) RETURN b.k, length(p)") == lines(far.items())
    assert run(g, "MATCH (a:Stop {k: 0}), (b:Stop {k: 7}) MATCH p = ALL SHORTEST PATHS (a)-[:WAY*]->(b) RETURN DISTINCT length(p)") == [str(far[7])]
