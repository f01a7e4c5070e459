"""LOAD, constraints and what a refused statement leaves."""

import csv
from pathlib import Path

import pytest
from plain import line, value

from graphloom.errors import ConstraintError, SemanticError
from graphloom.format import rows_of
from graphloom.session import GraphSession

CSV = Path(__file__).with_name("data_ports.csv")


def test_load_csv(spark):
    """Fields are texts, an empty one is null; with a header a row is a map, else a list."""
    with CSV.open() as file:
        raw = [[x or None for x in row] for row in csv.reader(file)]
    g = GraphSession(spark)
    maps = ["{" + ", ".join(f"{k}: {value(v)}" for k, v in zip(raw[0], row, strict=True)) + "}" for row in raw[1:]]
    assert sorted(rows_of(g.cypher(f"LOAD CSV FROM '{CSV}' AS r RETURN r"))) == sorted(maps)
    assert sorted(rows_of(g.cypher(f"load csv from '{CSV}' OPTIONS {{header: true}} AS r RETURN r.port, toInteger(r.berths) * 2"))) == sorted(line(r[0], int(r[1]) * 2 if r[1] else None) for r in raw[1:])
    lists = [line(row, row[-1]) for row in raw]
    assert sorted(rows_of(g.cypher(f"LOAD CSV FROM '{CSV}' OPTIONS {{HEADER: false, delimiter: ','}} AS r RETURN r, r[-1]"))) == sorted(lists)
    g.cypher(f"LOAD CSV FROM '{CSV}' AS r CREATE (:Port {{name: r.port, coast: r.coast}})")
    assert rows_of(g.cypher("MATCH (p:Port) RETURN p.name, p.coast ORDER BY p.name")) == sorted(line(r[0], r[2]) for r in raw[1:])


def test_load_json_and_parquet(spark, tmp_path):
    rows = spark.createDataFrame([(4, "p"), (5, None)], "k int, s string")
    rows.write.json(str(tmp_path / "j"))
    rows.write.parquet(str(tmp_path / "q"))
    g = GraphSession(spark)
    for kind, folder in (("JSON", "j"), ("PARQUET", "q")):
        assert sorted(rows_of(g.cypher(f"LOAD {kind} FROM '{tmp_path / folder}' AS r RETURN r.k + 1, r.s"))) == ["5\t'p'", "6\tnull"]


@pytest.mark.parametrize(("clause", "message"), [
    ("LOAD YAML FROM 'f' AS r RETURN r", "Unsupported LOAD format 'YAML'"), ("LOAD CSV FROM 'f' OPTIONS {quote: 1} AS r RETURN r", "Unknown LOAD option 'quote'"),
    ("LOAD CSV FROM 'f' OPTIONS {header: 'yes'} AS r RETURN r", "Option 'header' must be a boolean"), ("LOAD CSV FROM 'f' OPTIONS {delimiter: ''} AS r RETURN r", "must be a single character"),
    ("UNWIND [1] AS x LOAD CSV FROM 'f' AS r RETURN r", "LOAD clause must be the first clause"),
])
def test_load_refuses(spark, clause, message):
    with pytest.raises(SemanticError, match=message):
        GraphSession(spark).cypher(clause)


class Theatre:
    """Seats under constraints, beside a plain list of the rows that were let in."""

    def __init__(self, spark, *constraints: str):
        self.g, self.rows = GraphSession(spark), []
        for text in constraints:
            assert rows_of(self.g.cypher(f"CREATE CONSTRAINT {text}")) == ["'Constraint created'"]

    def offer(self, ok: bool, *props: str) -> None:
        text = "CREATE " + ", ".join(f"(:Seat {{{p}}})" for p in props)
        if ok:
            self.g.cypher(text)
            self.rows += props
        else:
            with pytest.raises(ConstraintError):
                self.g.cypher(text)
        assert rows_of(self.g.cypher("MATCH (s:Seat) RETURN count(*), max(id(s))")) == [line(len(self.rows), len(self.rows) or None)]


def test_unique(spark):
    """Rows without the key pass; rows are held against stored ones and against each other."""
    t = Theatre(spark, "plate FOR (s:Seat) REQUIRE s.plate IS UNIQUE")
    t.offer(True, "plate: 10", "plate: 20")
    t.offer(False, "plate: 20")
    t.offer(False, "plate: 30", "plate: 30")
    t.offer(True, "plate: 30")
    t.offer(True, "box: 1", "box: 1")
    assert rows_of(t.g.cypher("MATCH (s:Seat {plate: 20}) WHERE s.plate = 30 RETURN s")) == []


def test_node_key_asks_for_all_parts(spark):
    t = Theatre(spark, "place FOR (s:Seat) REQUIRE (s.line, s.chair) IS NODE KEY")
    t.offer(True, "line: 'A', chair: 1", "line: 'A', chair: 2", "line: 'B', chair: 1")
    t.offer(False, "line: 'B', chair: 1")
    t.offer(False, "line: 'C'")
    t.offer(False, "chair: 3, box: 2")
    t.offer(True, "line: 'B', chair: 2")


def test_not_null(spark):
    t = Theatre(spark, "tier FOR (s:Seat) REQUIRE s.tier IS NOT NULL")
    t.offer(True, "tier: 'stalls'", "tier: 'stalls'")
    t.offer(False, "plate: 1")
    t.offer(False, "tier: null")


@pytest.mark.parametrize(("rule", "good", "bad"), [("b.no IS UNIQUE", "no: 2", "no: 1"), ("b.no IS NOT NULL", "no: 1", "by: 'x'"), ("(b.no, b.by) IS UNIQUE", "no: 1, by: 'y'", "no: 1, by: 'x'")])
def test_relationship_constraints(spark, rule, good, bad):
    g = GraphSession(spark)
    g.cypher(f"CREATE CONSTRAINT booked FOR ()-[b:BOOKS]-() REQUIRE {rule}")
    made = "CREATE (:Guest)-[:BOOKS {%s}]->(:Seat)"
    g.cypher(made % "no: 1, by: 'x'")
    g.cypher(made % good)
    with pytest.raises(ConstraintError):
        g.cypher(made % bad)
    assert rows_of(g.cypher("MATCH (n) RETURN count(*)")) == ["4"]


def test_constraints_come_and_go(spark):
    g = GraphSession(spark)
    make = "CREATE CONSTRAINT plate {}FOR (s:Seat) REQUIRE s.plate IS UNIQUE"
    g.cypher("CREATE (:Seat {plate: 5}), (:Seat {plate: 6})")
    g.cypher(make.format(""))
    with pytest.raises(ConstraintError, match="already exists"):
        g.cypher(make.format(""))
    g.cypher(make.format("IF NOT EXISTS "))
    assert rows_of(g.cypher("DROP CONSTRAINT plate")) == ["'Constraint dropped'"]
    g.cypher("CREATE (:Seat {plate: 6})")
    with pytest.raises(ConstraintError, match="duplicate"):
        g.cypher(make.format(""))
    g.cypher("DROP CONSTRAINT plate IF EXISTS")
    with pytest.raises(ConstraintError, match="not found"):
        g.cypher("DROP CONSTRAINT plate")
