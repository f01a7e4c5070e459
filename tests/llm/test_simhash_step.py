"""SimHash is what finds the pipeline's near-duplicates; shingles only add what it may have missed."""

from dataclasses import replace
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_copies import DOCS, kept, pairs_with_edits, plain_kept, plain_set, similar

from graphloom.llm import shingle_join, simhash
from graphloom.llm.common import arrow_rows, materialize
from graphloom.llm.components import connected_components


@pytest.fixture
def no_prefixes(monkeypatch):
    """Leaves the search by shingles nothing to find."""
    made = simhash.set_prints
    monkeypatch.setattr(simhash, "set_prints", lambda *args: materialize(made(*args).withColumn("prefix", F.array().cast("array<bigint>"))))


def test_simhash_alone_finds_copies(spark, no_prefixes):
    rows = pairs_with_edits([(600, 6), (400, 4), (300, 3)], 20, 7)  # similarities of about 0.9
    left = kept(spark, rows)
    assert set(range(0, len(rows), 2)) <= set(left)
    assert len(left) - len(rows) // 2 <= 2


def test_simhash_alone_links_none_in_error(spark, no_prefixes):
    rows = pairs_with_edits([(600, 14), (400, 10), (300, 8)], 20, 8)  # similarities just below 0.8
    assert kept(spark, rows) == list(range(len(rows)))


def test_a_large_group_of_copies_is_found_by_simhash_alone(spark, no_prefixes):
    """More copies than a key gives all pairs of, in one group, and a second group beside it."""
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(2):
        base = list(rng.choice([f"v{i}" for i in range(3000)], 300))
        for k in range(90):
            rows.append((len(rows), " ".join(base[: 3 * k] + [f"x{k}"] + base[3 * k + 1 :])))
    assert kept(spark, rows) == [0, 90] == plain_kept(rows)


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_pairs_are_within_the_bits(spark, block_rows):
    """Every pair differs in few bits, and all near ones of two texts that share a key are there, or a way by hubs."""
    rows = pairs_with_edits([(200, 1), (30, 1)], 10, 10)
    base = rows[0][1].split()
    rows += [(1000 + k, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in range(60)]
    arrow_rows(spark)
    docs = spark.createDataFrame(rows, DOCS).withColumn("mark", F.xxhash64("text"))
    sets = shingle_join.distinct_sets(simhash.set_prints(docs, partial(simhash.majority, lanes=8)))
    config = replace(simhash.FIVE_WORDS, max_bits=simhash.COMPARED_BITS, block_rows=block_rows)
    found = simhash.near_sets(sets, config)
    lanes = {r.rid: np.array(r.lanes, np.int64).view(np.uint64) for r in sets.collect()}
    pairs = {(r.a, r.b) for r in found.collect()}
    far = {p: int(np.bitwise_count(lanes[p[0]] ^ lanes[p[1]]).sum()) for p in pairs}
    assert pairs and all(a != b and n <= simhash.COMPARED_BITS for (a, b), n in far.items())
    text = {r.mark: r.text for r in docs.collect()}
    texts = {r.rid: plain_set(text[r.mark]) for r in sets.collect()}
    root = {r: r for r in lanes}

    def top(r):
        while root[r] != r:
            r = root[r]
        return r

    for a, b in pairs:
        if similar(texts[a], texts[b]):
            root[top(b)] = top(a)
    group = [r for r in texts if len(texts[r] & plain_set(rows[0][1])) > 100]
    assert len(group) > 60 and len({top(r) for r in group}) == 1


def test_fingerprints_are_majorities_of_bits():
    rng = np.random.default_rng(11)
    for n in (1, 2, 5, 255, 256, 700):
        hashes = rng.integers(0, 2**64, n, np.uint64)
        got = simhash.majority(hashes, 8)
        assert len(got) == 8
        want = sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in hashes) > n)
        assert int(got[0]) == want == int(simhash.majority(hashes, 1)[0])
    assert not simhash.majority(np.zeros(0, np.uint64), 8).any()


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_a_key_gives_fewer_pairs_than_its_sets(spark, block_rows):
    """Copies that all share one key: links grow with their number, not with its square, and join them all."""
    base = list(np.random.default_rng(12).choice([f"v{i}" for i in range(3000)], 300))
    arrow_rows(spark)
    for copies in (15, 30, 60):
        rows = [(k, " ".join(base[: 3 * k] + [f"x{k}"] + base[3 * k + 1 :])) for k in range(copies)]
        docs = spark.createDataFrame(rows, DOCS).withColumn("mark", F.xxhash64("text"))
        sets = shingle_join.distinct_sets(simhash.set_prints(docs, partial(simhash.majority, lanes=8)))
        config = replace(simhash.FIVE_WORDS, max_bits=simhash.COMPARED_BITS, tables=((),), block_rows=block_rows)
        near = simhash.near_sets(sets, config)
        assert copies - 1 <= near.count() <= copies - 1 + (copies // 8 + 1) ** 2 * (block_rows == 8)
        roots = connected_components(simhash.linked_sets(near, sets, docs)).select("root", "node").collect()
        assert len({r.node for r in roots}) == copies and len({r.root for r in roots}) == 1


def test_each_set_is_tried_once_before_the_rest(spark, monkeypatch):
    tried, tell = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *args: tried.append(pairs.distinct().count()) or tell(pairs, *args))
    base = list(np.random.default_rng(13).choice([f"v{i}" for i in range(3000)], 300))
    rows = [(k, " ".join(base[: 3 * k] + [f"x{k}"] + base[3 * k + 1 :])) for k in range(80)]
    assert kept(spark, rows) == [0]
    assert 0 < tried[0] < 80 and sum(tried) < 160
