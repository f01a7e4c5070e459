"""The queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import spread, table
from graphloom.llm.mixing import ORACLE_SQL as MIXING_SQL


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import score_toxicity

    return score_toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import score_quality

    return score_quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.embedding_dedup import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash import simhash_groups

    groups = simhash_groups(spread(table(spark, sf_dir, "documents")))
    return groups.select("doc_id", F.lower(F.lpad(F.hex(F.col("lanes")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.token_counts import count_tokens

    return count_tokens(spread(table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.piece_fst import encode_documents

    return encode_documents(spread(table(spark, sf_dir, "documents")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_toxicity,
        op3_quality_classifier,
        op4_embedding_near_dedup,
        op5_simhash_near_dedup,
        op6_secret_scans,
        op7_token_counts,
        op8_sentencepiece,
        op9_source_mixing,
        op10_url_filters,
        pipeline,
    )
}
#: DuckDB SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {"op9_source_mixing": MIXING_SQL}
