"""Shared pieces of the training-data operators: reading, shared storage, words."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import discard, materialize, put_file, shared_dir

__all__ = ["discard", "materialize", "shared_dir"]

#: Characters that separate words (space and the ASCII controls tab to return).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; texts may be 100 kB and more, so batches stay small.
ARROW_ROWS = 512
#: A side of a join is broadcast only up to so many rows (each of a few numbers).
BROADCAST_ROWS = 10_000

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A read table, dealt out anew if a file with few row groups would keep cores idle.

    Rows are counted by partition, which reads no columns; if one has more than twice its share of
    the rows for the cores there are, the table is shuffled once, else it is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    counts = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
    uneven = counts.total is not None and counts.most > 2 * -(-counts.total // cores)
    return rows.repartition(cores) if uneven else rows


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (materialized) table has at most so many rows, else df itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once, so that they need no installed copy."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root, packed = Path(__file__).resolve().parents[2], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted((root / "graphloom").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    context.addPyFile(put_file(spark, "graphloom.zip", packed.getvalue()))
    _shipped.add(context.applicationId)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Readies the session for Python workers; small batches of texts bound a worker's memory."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def sheltered(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with its columns under numbers, so that no working column can clash with them, and the
    columns to select in the end. `text`, `source`, `doc_id` and `n_chars` are added under _ names."""
    own = [F.col(f"`{c}`").alias(f"{k}") for k, c in enumerate(docs.columns)]
    named = [F.col(c).alias(f"_{c}") for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns]
    return docs.select(*own, *named), [F.col(f"`{k}`").alias(c) for k, c in enumerate(docs.columns)]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it in its lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order (null and blank texts: none), with built-in functions."""
    trimmed = F.btrim(text, F.lit(SPACES))
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, empty).otherwise(F.split(trimmed, SPACE_RUN))


def labelled_sample(labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """At most per_class training ids for either value of a label: (doc_id, y).

    The fold of a row is crc32(doc_id as text) mod modulus; the fold held_out is never used.
    The rows of the smallest hashes of doc_id are taken, so reruns choose alike.
    """
    rows = labels.where(
        F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~is_held_out(modulus, held_out)
    ).select("doc_id", F.col(label).cast("int").alias("y"))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [
        rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    return parts[0].unionAll(parts[1])


def is_held_out(modulus: int, held_out: int, doc_id: str = "doc_id") -> Column:
    """Whether a row is in the fold that is kept from training (null ids: no)."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
    return F.coalesce(fold == held_out, F.lit(False))
