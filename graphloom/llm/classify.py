"""What both text classifiers share: batches of texts, and labelled texts as features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import labelled_sample, let
from graphloom.llm.fingerprints import shingle_hashes


def score_column(text: Column, score: Callable[[list[str]], np.ndarray]) -> Column:
    """score(texts) for every text (null: empty), a batch at a time."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(["" if t is None else t for t in texts]), dtype="float64")

    return scored(text)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, y) of the training sample; the sample's ids (2 * per_class rows at most) are broadcast.

    Of exact and near copies in the sample one stays, else words that only they share would look
    like signs of their label. Texts whose least, or greatest, shingle hash is the same count as
    copies; at a similarity of 0.9 that finds 99 of 100.
    """
    chosen = labelled_sample(labels, label, modulus, held_out, per_class)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    hashes = shingle_hashes(F.col("text"))
    rows = rows.withColumn("ends", let(hashes, lambda h: F.struct(F.array_min(h).alias("least"), F.array_max(h).alias("most"))))
    for end in ("least", "most"):
        order = Window.partitionBy(f"ends.{end}").orderBy("doc_id", "text", "y")
        rows = rows.withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("copy")
    return rows.select("doc_id", "text", "y")
