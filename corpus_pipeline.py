"""The corpus pipeline: what good, different, secret-free, mixed documents are as pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage works on all rows that the
one before it kept. run() writes each stage's rows to the folder that all executors share and
reads them back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import materialize, spread, table
from graphloom.llm.mixing import mixed_documents
from graphloom.llm.piece_fst import encode_documents
from graphloom.llm.quality import keep_good
from graphloom.llm.secrets import redact
from graphloom.llm.simhash import keep_one_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores below one half.

    Null and empty texts are scored like others, equal rows alike; an empty table gives an empty one.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of a similarity of 0.8 or more on five-word shingles.

    Texts without words (null, empty, blank) are one group; of equal rows one stays, of a group the
    least doc_id, nulls last. An empty table gives an empty one.
    """
    return keep_one_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mask; n_chars follows the text.

    Rows stay as many as they are; null texts stay null. An empty table gives an empty one.
    """
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, none for those that it leaves out.

    Texts without words add nothing and are left out; null sources are a source, repeated rows count
    each. An empty table gives an empty one.
    """
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' SentencePiece numbers: doc_id, piece_ids, n_pieces, restored.

    Null and empty texts have none; repeated rows stay. An empty table gives an empty one.
    """
    return encode_documents(docs, most_kept=150_000)  # the workers of the stages before have caches of their own


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("source mixing", mixture),
    ("SentencePiece encoding", pieces),
]

#: Fitted models, near-duplicates and piece encoding have no SQL form; tests/llm/test_plain_models.py holds
#: run() against plain versions of the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, of all documents of sf_dir."""
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
