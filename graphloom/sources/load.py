"""LOAD: files as rows of one variable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import SemanticError
from graphloom.functions.types import STRING, Type, list_of, map_of, of_spark
from graphloom.plans.ast import Load


def load(spark: SparkSession, clause: Load, name: str) -> tuple[DataFrame, Type]:
    """(rows, type): the file's rows as the column name.

    CSV cells are text: with a header a row is a map, without one a list. Parquet and JSON rows are
    maps of their own types. Any file system that Spark reads will do.
    """
    kind = clause.format.lower()
    if kind not in ("csv", "parquet", "json"):
        raise SemanticError(f"Unsupported LOAD format '{clause.format}' in LOAD {clause.format} FROM '{clause.source}'")
    where = f"LOAD {clause.format} FROM '{clause.source}'"
    allowed = {"header", "delimiter"} if kind == "csv" else set()
    for option in clause.options:
        if option not in allowed:
            raise SemanticError(f"Unknown LOAD option '{option}' in {where}")
    header, delimiter = clause.options.get("header", True), clause.options.get("delimiter", ",")
    if not isinstance(header, bool):
        raise SemanticError(f"Option 'header' must be a boolean in {where}")
    if not isinstance(delimiter, str):
        raise SemanticError(f"Option 'delimiter' must be a string in {where}")
    if len(delimiter) != 1:
        raise SemanticError(f"Option 'delimiter' must be a single character in {where}")
    if kind == "csv":
        rows = spark.read.option("header", header).option("sep", delimiter).option("escape", '"').csv(clause.source)
        if not header:
            return rows.select(F.array(*[F.col(c) for c in rows.columns]).alias(name)), list_of(STRING)
    else:
        rows = spark.read.format(kind).load(clause.source)
    value = F.struct(*[F.col(f"`{c}`").alias(c) for c in rows.columns])
    return rows.select(value.alias(name)), map_of({f.name: of_spark(f.dataType) for f in rows.schema.fields})
