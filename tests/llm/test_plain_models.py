"""Trees, calibration and the whole pipeline against plain versions."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece

from graphloom.llm import mixing, secrets
from graphloom.llm.boosting import BoostedTrees, isotonic
from graphloom.llm.pieces import MODEL_PATH
from graphloom.llm.quality import fit_quality
from test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"


def plain_margins(x, y, trees, depth, rate, bins, ridge, least):
    """Boosting by trying every cut of every feature in every node, one row at a time."""
    start = np.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))
    margin = np.full(len(y), start)
    cuts = [sorted(set(np.quantile(c, np.arange(1, bins) / bins))) for c in x.T]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            following = []
            for rows in nodes:
                best, chosen = 1e-6, None
                for f, candidates in enumerate(cuts):
                    for c in candidates:
                        low = x[rows, f] <= c
                        if low.sum() < least or (~low).sum() < least:
                            continue
                        gain = sum(g[part].sum() ** 2 / (h[part].sum() + ridge) for part in (rows[low], rows[~low])) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                        if gain > best + 1e-12:
                            best, chosen = gain, low
                following += [rows, rows[:0]] if chosen is None else [rows[chosen], rows[~chosen]]
            nodes = following
        for rows in nodes:
            if len(rows):
                margin[rows] += -rate * g[rows].sum() / (h[rows].sum() + ridge)
    return margin


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_boosted_trees_are_a_plain_split_search(depth):
    rng = np.random.default_rng(depth)
    x = np.column_stack([rng.normal(size=160), rng.integers(0, 4, 160), rng.random(160)])
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 1) | (rng.random(160) < 0.1)).astype(int)
    trees = BoostedTrees(trees=4, depth=depth, rate=0.3, bins=16)
    assert np.allclose(trees.fit(x, y).margin(x), plain_margins(x, y, 4, depth, 0.3, 16, trees.ridge, trees.least))


def test_isotonic_is_the_largest_of_least_means():
    """The value at a score is the largest, over where a run begins, of the least mean, over where it ends."""
    rng = np.random.default_rng(4)
    score = np.round(rng.normal(size=60), 1)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * score))).astype(int)
    levels = np.unique(score)
    mean = lambda i, j: y[(score >= levels[i]) & (score <= levels[j])].mean()
    best = [max(min(mean(i, j) for j in range(k, len(levels))) for i in range(k + 1)) for k in range(len(levels))]
    at, probability = isotonic(score, y)
    for k, level in enumerate(levels):
        block = np.isclose(best, best[k])
        rows = np.isin(score, levels[block])
        assert np.isclose(np.interp(level, at, probability), (y[rows].sum() + 0.5) / (rows.sum() + 1))


def plain_redacted(text):
    """The text with a mask for every span, found by Python's own expressions."""
    if text is None:
        return None
    found = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[1]) >= 12]
    found += [(m.start(), k, m.end()) for k, p in ((1, secrets.ACCESS), (2, secrets.HEX)) for m in re.finditer(p, text)]
    for m in re.finditer(secrets.CANDIDATE, text):
        if not secrets.looks_random(m[0]):
            continue
        at, hits = m.start(), sorted((s, e) for s, _, e in found if _ < 3 and s < m.end() and m.start() < e)
        for s, e in [*hits, (m.end(), m.end())]:
            if s > at and (not hits or secrets.looks_random(text[at:s])):
                found.append((at, 3, s))
            at = max(at, e)
    out, at = [], 0
    for s, _, e in sorted(found):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_the_pipeline_is_a_plain_one(spark):
    """The model's scores, all pairs of shingle sets, Python's expressions, SQL and the library, one after another."""
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    rows = [r.asDict() for r in docs.collect()]
    scores = fit_quality(docs, labels).score([r["text"] or "" for r in rows])
    good = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    single = set(plain_kept([(r["doc_id"], r["text"]) for r in good]))
    clean = [r | {"text": plain_redacted(r["text"])} for r in good if r["doc_id"] in single]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in clean])
    result = con.sql(mixing.ORACLE_SQL)
    taken = {row[result.columns.index("doc_id")]: (row[result.columns.index("taken")], row[result.columns.index("size")]) for row in result.fetchall()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    want = Counter()
    for r in clean:
        n, size = taken[r["doc_id"]]
        if size:
            want[r["doc_id"], tuple(library.encode(r["text"]))] += n // size
    got = Counter((r.doc_id, tuple(r.piece_ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want
