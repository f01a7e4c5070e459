"""A prompt for statements: python -m graphloom [folder of a saved graph]."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from graphloom.errors import CypherError
from graphloom.format import rows_of
from graphloom.session import GraphSession
from graphloom.sources.store import open_graph

HELP = "Statements end at the line's end. .explain STATEMENT shows the plan, .quit leaves."


def answer(session: GraphSession, line: str) -> str:
    """What the prompt prints for one line: a table, a plan, or why not."""
    try:
        if line.startswith(".explain "):
            return session.explain(line.removeprefix(".explain "))
        if line == ".help":
            return HELP
        began = time.perf_counter()
        df = session.cypher(line)
        rows = rows_of(df)
        return "\n".join(["\t".join(df.columns), *rows, f"{len(rows)} rows, {time.perf_counter() - began:.3f} s"])
    except CypherError as error:
        return str(error)


def main(args: list[str]) -> None:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    session = GraphSession(spark, open_graph(spark, args[0]) if args else None)
    print(HELP)
    for line in iter(lambda: input("> ").strip(), ".quit"):
        if line:
            print(answer(session, line))


if __name__ == "__main__":
    try:
        main(sys.argv[1:])
    except EOFError:
        pass
