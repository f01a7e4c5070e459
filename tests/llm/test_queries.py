"""The registered queries: names, columns and one row for every row of their tables."""

import duckdb
import pytest

from graphloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_document_fingerprints": ("documents", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]),
    "op2_toxicity": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op3_quality_classifier": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op4_embedding_near_dedup": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op5_simhash_near_dedup": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op6_secret_scans": ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    "op7_token_counts": ("documents", ["doc_id", "n_tokens", "n_pretokens"]),
    "op8_sentencepiece": ("documents", ["doc_id", "piece_ids", "n_pieces", "restored"]),
    "op9_source_mixing": ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    "op10_url_filters": ("pages", ["page_id", "host", "path", "rule", "verdict", "block_score"]),
}


def test_registered():
    import __spark_entry__

    assert set(QUERIES) == {*COLUMNS, "pipeline"} and set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    source, columns = COLUMNS[name]
    df = QUERIES[name](spark, SF)
    assert df.columns == columns
    key = columns[0]
    got = sorted(r[0] for r in df.select(key).collect())
    assert got == sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
