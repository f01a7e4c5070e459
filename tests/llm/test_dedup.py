"""SimHash and embedding near-duplicates, against brute force on small tables."""

from dataclasses import replace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm.components import connected_components
from graphloom.llm.embedding_dedup import SignTables, embedding_links
from graphloom.llm.simhash import FIVE_WORDS, THREE_WORDS, fingerprint, keep_one_each, simhash_groups

DOCS = "doc_id bigint, text string"


def closed(links: dict) -> dict:
    """The least id that links lead to, for each id."""
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, others in links.items():
            least = min([root[i], *(root[j] for j in others)])
            for j in [i, *others]:
                changed |= root[j] != least
                root[j] = least
    return root


def plain_simhash(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(n: int, seed: int = 1) -> list[str]:
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    made = []
    for _ in range(n):
        words = list(rng.choice(vocabulary, rng.integers(1, 120)))
        made.append(" ".join(words))
        if rng.random() < 0.5:
            words[rng.integers(len(words))] = "Changed"
            made.append("\t".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return made


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)]
    links = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = closed(links)
    alone = [i for i in links if links[i] == {i}]
    assert {i: got.get(i, i) for i in links} == want and not set(alone) & set(got)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_is_brute_force(spark):
    rows = list(enumerate([*texts(120), "", None, " \n ", "one", "ONE", "one two", "É é", "x" * 50_000, "a b c " * 30_000, texts(1)[0]], 10))
    rows += [rows[3], (None, "one"), (None, "nothing like it at all")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], DOCS + ", rid int, lanes string")
    got = simhash_groups(df).select("doc_id", F.hex(F.col("lanes")[0]).alias("h"), "component_id").collect()
    prints = [(i, plain_simhash(t)) for i, t in rows]
    assert sorted((r.doc_id or -1, int(r.h, 16)) for r in got) == sorted((i or -1, p) for i, p in prints)
    by_print = {}
    for i, p in prints:
        by_print.setdefault(p, []).append(i)
    root = closed({p: {q for q in by_print if (p ^ q).bit_count() <= 2} for p in by_print})
    least = {}
    for p, ids in by_print.items():
        for i in ids:
            if i is not None:
                least[root[p]] = min(least.get(root[p], i), i)
    want = sorted((i or -1, least.get(root[p], -1)) for i, p in prints)
    assert sorted((r.doc_id or -1, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_simhash_splits_hot_blocks(spark):
    """Many fingerprints in one block: cut into blocks of 8 rows, the same components come out."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[:k] + ["other"] + words[k + 1 :])) for k in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    small = simhash_groups(df, replace(THREE_WORDS, block_rows=8)).collect()
    assert {r.doc_id: r.component_id for r in small} == {r.doc_id: r.component_id for r in simhash_groups(df).collect()}


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows, groups = [], []
    for g in range(40):
        words = list(rng.choice(vocabulary, 300))
        ids = []
        for copy in range(3):
            mine = list(words)
            for at in rng.choice(300, copy, replace=False):
                mine[at] = "edit"
            ids.append(len(rows) + 1)
            rows.append((len(rows) + 1, " ".join(mine), "en", 7))
        groups.append(ids)
    rows += [(rows[0][0], rows[0][1], "en", 7), (None, rows[4][1], "en", 7), (900, "", "en", 7), (901, None, "en", 7), (902, " ", "en", 7)]
    df = spark.createDataFrame(rows, DOCS + ", lang string, __mark int")
    kept = keep_one_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*(ids[0] for ids in groups), 900]
    assert keep_one_each(df.limit(0)).count() == 0


def test_similar_texts_are_found_and_others_left(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [list(rng.choice(vocabulary, 400)) for _ in range(50)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k, words in enumerate(base):  # 7 spread edits of 400 words: Jaccard similarity about 0.84
        mine = list(words)
        for at in range(20, 400, 55):
            mine[at] = "edit"
        rows.append((100 + k, " ".join(mine)))
        rows.append((200 + k, " ".join(words[:150] + list(rng.choice(vocabulary, 250)))))
    got = {r.doc_id: r.component_id for r in simhash_groups(spark.createDataFrame(rows, DOCS), FIVE_WORDS).collect()}
    assert sum(got[100 + k] == k for k in range(50)) >= 42
    assert all(got[200 + k] == 200 + k for k in range(50))


def test_fingerprint_of_nothing_is_zero():
    assert [int(fingerprint(t, THREE_WORDS)[0]) for t in (None, "", " \t\n")] == [0, 0, 0]


def brute(rows, least=0.93):
    def unit(v):
        if v is None or any(x is None for x in v) or not len(v):
            return None
        v = np.array(v, float)
        return None if not np.isfinite(v).all() or not v.any() else v / np.linalg.norm(v)

    units = [(unit(v), label) for _, v, label in rows]
    near = [[j for j, (w, m) in enumerate(units) if j != i and u is not None and w is not None and len(u) == len(w) and label is not None and label == m and u @ w >= least] for i, (u, label) in enumerate(units)]
    root = closed(dict(enumerate(near)))
    ids = [r[0] for r in rows]
    component = {}
    for i, r in root.items():
        if ids[i] is not None:
            component[r] = min(component.get(r, ids[i]), ids[i])
    return [(ids[i], len(near[i]), component.get(root[i])) for i in range(len(rows))]


def vectors(n=400, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=dim)
        rows.append((len(rows), [float(np.float32(x)) for x in v], int(k % 3)))
        for _ in range(rng.integers(0, 3)):
            w = v + rng.normal(size=dim) * 0.12
            rows.append((len(rows), [float(np.float32(x)) for x in w], int(k % 3)))
    return rows


ODD = [
    (9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1),
    (9006, [1.0] * 16, None), (9007, [1.0] * 16, None), (9008, [2.0] * 16, 1), (9009, [1.0] * 16, 1), (9009, [1.0] * 16, 1), (None, [1.0] * 16, 1), (9010, [1.0] * 15, 1), (9011, [3e38] * 16, 1), (9012, [1e-40] * 16, 1),
]


def test_embeddings_are_brute_force(spark):
    rows = vectors() + ODD
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id bigint, embedding array<float>, label int, rid int, links int")
    for config in (SignTables(), SignTables(block_rows=16, bits=2, tables=12)):
        got = embedding_links(df, config).collect()
        rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in rows]
        key = lambda t: tuple(-1 if x is None else x for x in t)
        assert sorted((key((r.vec_id, r.n_links, r.component_id)) for r in got)) == sorted(map(key, brute(rows32)))
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_embeddings_of_an_empty_table(spark):
    assert embedding_links(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("copies", [1, 50])
def test_equal_vectors_count_as_often_as_they_occur(spark, copies):
    rows = [(k, [1.0, 2.0, 3.0], 5) for k in range(copies)] + [(100, [1.0, 2.0, 3.01], 5), (101, [3.0, 2.0, 1.0], 5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert got[0] == (copies, 0) and got[100] == (copies, 0) and got[101] == (0, 101)
