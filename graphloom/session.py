"""GraphSession: Cypher statements over a property graph, as DataFrames."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import NotSupported, SemanticError
from graphloom.functions.types import NULL
from graphloom.operators import mutate
from graphloom.plans import ast as a
from graphloom.plans.match import Matcher
from graphloom.plans.needs import Needs
from graphloom.plans.parser import parse
from graphloom.plans.project import Projector
from graphloom.plans.scope import Evaluator, Frame, ValueVar
from graphloom.sources.graph import PropertyGraph
from graphloom.sources.load import load


class GraphSession:
    """Runs statements on a graph; CREATE and constraints replace it by its next version.

    semantics: 'reference' (AND is null if a side is, OR takes one null as false) or 'ansi'.
    rel_uniqueness: 'none', or 'trail', where no relationship occurs twice in a MATCH.
    """

    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None, semantics: str = "reference", rel_uniqueness: str = "none"):
        self.spark, self.graph = spark, graph or PropertyGraph()
        self.semantics, self.rel_uniqueness = semantics, rel_uniqueness

    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        """The statement's rows. A CREATE takes place before this returns. Reads are lazy, but for long
        variable lengths, shortest paths and ids of relationships without a key, which are stored while
        the query is planned."""
        statement = parse(text)
        if isinstance(statement, a.CreateConstraint):
            self.graph = mutate.create_constraint(self.graph, statement)
            return self._message("Constraint created")
        if isinstance(statement, a.DropConstraint):
            self.graph = mutate.drop_constraint(self.graph, statement)
            return self._message("Constraint dropped")
        df, graph, _ = self._query(statement, params or {})
        self.graph = graph
        return df

    def explain(self, text: str, params: dict | None = None) -> str:
        """The logical steps of a query, one a line, and Spark's plan. Nothing is created; what a read
        stores while it is planned (see cypher()) is stored here too."""
        statement = parse(text)
        if not isinstance(statement, a.Query) or any(isinstance(c, a.Create) for p in statement.parts for c in p.clauses):
            raise NotSupported("only queries that read are explained")
        df, _, steps = self._query(statement, params or {})
        plan = df._jdf.queryExecution().toString()
        return "\n".join([*steps, "", plan])

    def _message(self, text: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(text).alias("result"))

    def _query(self, query: a.Query, params: dict) -> tuple[DataFrame, PropertyGraph, list[str]]:
        graph, frames, steps = self.graph, [], []
        for part in query.parts:
            df, graph = self._single(part, params, graph, steps)
            frames.append(df)
        out = frames[0]
        for df in frames[1:]:
            if df.columns != out.columns:
                raise SemanticError(f"All subqueries in UNION should return same colum names {out.columns} {df.columns}")
            out = out.union(df)
        return (out.distinct() if len(frames) > 1 and not query.all else out), graph, steps

    def _single(self, query: a.SingleQuery, params: dict, graph: PropertyGraph, steps: list[str]) -> tuple[DataFrame, PropertyGraph]:
        read = self.graph  # a query does not see what it creates
        numbers = itertools.count()
        matcher = Matcher(self.spark, read, params, Needs(query), self.semantics, self.rel_uniqueness)
        matcher.numbers = numbers
        projector = Projector(self.spark, params, self.semantics, numbers)
        frame = Frame(None, {})
        created = False
        for at, clause in enumerate(query.clauses):
            last = at == len(query.clauses) - 1
            if isinstance(clause, a.Match):
                frame = matcher.match(frame, clause)
            elif isinstance(clause, a.Projection):
                if clause.final and not last:
                    raise SemanticError("RETURN must be the last clause")
                frame = projector(frame, clause)
                steps.append("ProduceResult" if clause.final else "Project")
                if clause.final:
                    steps[-1:-1] = matcher.steps
                    return self._result(frame, params), graph
            elif isinstance(clause, a.Unwind):
                frame = self._unwind(frame, clause, params, numbers)
            elif isinstance(clause, a.Load):
                if at:
                    raise SemanticError(f"LOAD clause must be the first clause in a query: LOAD {clause.format}")
                name = f"v{next(numbers)}"
                df, kind = load(self.spark, clause, name)
                frame = Frame(df, {clause.variable: ValueVar(name, kind)})
            elif isinstance(clause, a.Create):
                before = set(frame.scope)
                graph, frame = mutate.create(self.spark, graph, frame, clause, params, self.semantics, numbers)
                made = {k: v for k, v in frame.scope.items() if k not in before}
                created = True
        if not created:
            raise SemanticError("a query must end with RETURN or CREATE")
        return self._result(Frame(frame.df, made), params), graph

    def _unwind(self, frame: Frame, clause: a.Unwind, params: dict, numbers) -> Frame:
        if clause.variable in frame.scope:
            raise SemanticError(f"Variable '{clause.variable}' is already defined in UNWIND {clause.expr}")
        value = Evaluator(frame.scope, params, self.semantics)(clause.expr)
        name = f"v{next(numbers)}"
        rows = frame.rows(self.spark)
        if value.type.name == "List":
            df = rows.select(*frame.columns(), F.explode(value.column).alias(name))
            kind = value.type.item
        else:
            df = rows.select(*frame.columns(), value.column.alias(name)).where(F.col(name).isNotNull())
            kind = value.type
        return Frame(df, {**frame.scope, clause.variable: ValueVar(name, kind)})

    def _result(self, frame: Frame, params: dict) -> DataFrame:
        """The visible variables as columns; values of no known type (all null) become text columns."""
        evaluator = Evaluator(frame.scope, params, self.semantics)
        columns = []
        for name in frame.scope:
            value = evaluator(a.Variable(name))
            column = value.column.cast("string") if value.type == NULL else value.column
            columns.append(column.alias(name))
        return frame.rows(self.spark).select(*columns)
