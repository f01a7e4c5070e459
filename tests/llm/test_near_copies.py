"""The pipeline's near-dedup against a brute-force version on shingle sets."""

import re

import numpy as np
import pytest

from graphloom.llm import shingle_join
from graphloom.llm.simhash import keep_one_each

DOCS = "doc_id bigint, text string"


def plain_set(text: str | None) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^ \t-\r]+", lowered)
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a: frozenset, b: frozenset) -> bool:
    shared = len(a & b)
    return a == b or 5 * shared >= 4 * (len(a) + len(b) - shared)


def plain_kept(rows: list[tuple]) -> list[int]:
    """The least ids of the components of all similar pairs."""
    by_set = {}
    for i, text in rows:
        key = plain_set(text)
        by_set[key] = min(i, by_set.get(key, i))
    sets = sorted(by_set, key=by_set.get)
    root = {s: s for s in sets}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[k + 1 :]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and similar(a, b):
                x, y = sorted((top(a), top(b)), key=by_set.get)
                root[y] = x
    return sorted(by_set[s] for s in sets if root[s] is s)


def kept(spark, rows: list[tuple]) -> list[int]:
    return sorted(r.doc_id for r in keep_one_each(spark.createDataFrame(rows, DOCS)).collect())


def edited(words: list[str], edits: int) -> list[str]:
    """Spread edits of one word each: five shingles of len(words) - 4 change with each."""
    mine = list(words)
    for k in range(edits):
        mine[int((k + 0.5) * len(words) / edits)] = f"edit{k}"
    return mine


def pairs_with_edits(sizes_edits: list[tuple[int, int]], copies: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for size, edits in sizes_edits:
        for _ in range(copies):
            words = list(rng.choice([f"v{i}" for i in range(5000)], size))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited(words, edits)))]
    return rows


def test_no_pair_at_the_threshold_is_lost(spark):
    rows = pairs_with_edits([(600, 13), (400, 8), (300, 6)], 20, 1)
    assert all(similar(plain_set(rows[k][1]), plain_set(rows[k + 1][1])) for k in range(0, len(rows), 2))
    assert kept(spark, rows) == list(range(0, len(rows), 2))


def test_no_pair_below_the_threshold_is_dropped(spark):
    rows = pairs_with_edits([(600, 14), (400, 10), (300, 8), (200, 6)], 20, 2)
    assert not any(similar(plain_set(rows[k][1]), plain_set(rows[k + 1][1])) for k in range(0, len(rows), 2))
    assert kept(spark, rows) == list(range(len(rows)))


def test_short_texts_with_a_word_appended(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 30]:
        for _ in range(10):
            words = [f"s{i}" for i in rng.integers(0, 10**6, size + 1)]
            rows += [(len(rows), " ".join(words[:-1])), (len(rows) + 1, "\t".join(words).upper())]
    expected = [k for k in range(len(rows)) if k % 2 == 0 or len(rows[k][1].split()) < 9]
    assert kept(spark, rows) == expected == plain_kept(rows)


@pytest.mark.parametrize("small", [2, 32])
def test_crowded_buckets_lose_no_link(spark, small, monkeypatch):
    """Copies that are like the original, but not like each other, and one line that all texts have."""
    monkeypatch.setattr(shingle_join, "SMALL", small)
    monkeypatch.setattr(shingle_join, "PAIRS", 8)
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    line = [f"line{i}" for i in range(12)]
    base = list(rng.choice(vocabulary, 60))
    texts = [base[:k] + [f"x{k}"] + base[k + 1 :] for k in range(5, 55)] + [base]
    texts += [list(rng.choice(vocabulary, int(rng.integers(3, 40)))) + line for _ in range(60)]
    texts += [line + [f"t{k % 7}"] * (k % 3) for k in range(20)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert kept(spark, rows) == plain_kept(rows)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_documents_are_brute_force(spark, size):
    import corpus_pipeline

    sf = f"/root/testdata/sf{size}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert got == plain_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
