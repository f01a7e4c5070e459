"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.buckets import BLOCK_ROWS, map_buckets
from graphloom.llm.common import WORD, arrow_rows, discard, materialize, sheltered
from graphloom.llm.components import connected_components
from graphloom.llm.shingle_join import OVER, apart, dealt_pairs, distinct_sets, fitting, set_prints, similar_sets, verified

_WORD = re.compile(WORD)
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class SimHash:
    """What two texts must share to be near-duplicates.

    shingle: words of a shingle. lanes: 64-bit words of a fingerprint. repeats: whether a shingle
    counts as often as it occurs. max_bits: differing bits of linked fingerprints. tables: bits of
    the fingerprint that form the key of each candidate table. block_rows: rows of a bucket that one
    task compares at once.
    """

    shingle: int
    lanes: int
    repeats: bool
    max_bits: int
    tables: tuple[tuple[int, ...], ...]
    block_rows: int = BLOCK_ROWS


def pigeonhole(bits: int, blocks: int, max_bits: int) -> tuple[tuple[int, ...], ...]:
    """Keys that any two fingerprints of at most max_bits differing bits share at least once.

    Of `blocks` blocks, at most max_bits differ, so blocks - max_bits are equal; each choice of so
    many blocks is a table.
    """
    parts = np.array_split(np.arange(bits), blocks)
    return tuple(tuple(int(b) for p in chosen for b in p) for chosen in itertools.combinations(parts, blocks - max_bits))


def sampled_blocks(bits: int, tables: int, width: int, seed: int = 5) -> tuple[tuple[int, ...], ...]:
    """Blocks of `width` bits drawn at random, for distances too large for the pigeonhole bound."""
    rng = np.random.default_rng(seed)
    return tuple(tuple(sorted(int(b) for b in rng.choice(bits, width, replace=False))) for _ in range(tables))


#: Three-word shingles, repeats included; two differing bits of 64. Exact: 6 tables of 32 bits.
THREE_WORDS = SimHash(3, 1, True, 2, pigeonhole(64, 4, 2))
#: An estimate for five-word shingle sets of Jaccard similarity 0.8 or more: their cosine is
#: 2J / (1 + J) = 0.889, an angle of 27.3 degrees, or 77.7 of 512 bits. It loses pairs near 0.8 and
#: all but guesses at few shingles; keep_one_each, which must do neither, lets more bits differ, compares
#: the sets of what it finds and looks for the rest by shingles.
FIVE_WORDS = SimHash(5, 8, False, 84, sampled_blocks(512, 64, 20))
#: Differing bits up to which keep_one_each compares sets: 77.7 and four standard deviations of 8.1.
COMPARED_BITS = 110
#: Of every 2 ** SPARE keys of one of its tables, about one is taken, so that chance pairs are few.
SPARE = 4


def fingerprint(text: str | None, config: SimHash) -> np.ndarray:
    """The fingerprint's 64-bit lanes; texts without words have all bits zero."""
    found = _WORD.findall((text or "").translate(_UPPER))
    if not found:
        return np.zeros(config.lanes, np.uint64)
    if len(found) <= config.shingle:
        shingles = [" ".join(found)]
    else:
        shingles = map(" ".join, zip(*(found[i:] for i in range(config.shingle)), strict=False))
    if not config.repeats:
        shingles = set(shingles)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, 42) for s in shingles), np.uint64), config.lanes)


def majority(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The 64-bit lanes whose bits are set in over half of the shingles' hashes; no shingles give zeros."""
    counts = np.zeros(64 * lanes, np.int64)
    for start in range(0, len(hashes), 255):  # so many sums of one bit fit a byte
        part = _mixed(hashes[start : start + 255], lanes)
        counts += np.unpackbits(part.view(np.uint8), 1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def _mixed(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The hashes and, in further columns, other hashes of the same shingles, made from them."""
    first = hashes[:, None]
    with np.errstate(over="ignore"):
        x = first + np.arange(1, lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.ascontiguousarray(np.concatenate([first, x ^ (x >> np.uint64(31))], 1), "<u8")


def fingerprint_column(text: Column, config: SimHash) -> Column:
    """array<bigint> of the fingerprint's lanes."""

    @F.pandas_udf("array<bigint>")
    def lanes(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, config).view(np.int64) for t in texts])

    return lanes(text)


class _Keys:
    """Rows (key, rid, lanes) of distinct fingerprints, one for each table."""

    def __init__(self, config: SimHash):
        self.config = config

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = self.config.tables
        for batch in batches:
            if not batch.num_rows:
                continue
            lanes = _lanes(batch.column("lanes"), self.config.lanes)
            bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(len(lanes), -1), 1, bitorder="little").astype(np.int64)
            rid = batch.column("rid")
            for number, chosen in enumerate(tables):
                key = (bits[:, chosen] << np.arange(len(chosen))).sum(1) + (number << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key), rid, batch.column("lanes")], ["key", "rid", "lanes"])


def _lanes(column: pa.Array, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, width)


class _SetKeys:
    """Rows (key, rid, place) of sets (rid, n, lanes), one for each table; place is n, at the place 0."""

    def __init__(self, config: SimHash):
        self.keys = _Keys(config)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.array(batch.column("n").to_numpy().astype(np.int64) << 32)
            for made in self.keys(iter([batch])):
                yield pa.RecordBatch.from_arrays([made.column("key"), made.column("rid"), place], ["key", "rid", "place"])


class _Hubs:
    """Pairs (a, b, far), a < b, of one bucket's rows (rid, n, lanes): each row with the first one that is near.

    Near are fingerprints of at most max_bits differing bits (far) whose sets' sizes allow a similarity of
    0.8. So a bucket gives fewer pairs than rows, however many copies it holds. Where two blocks of a
    bucket meet, only the first rows of either are compared: the others have theirs in their own block.
    """

    def __init__(self, config: SimHash):
        self.config = config

    def __call__(self, rows: pa.Table) -> pa.Table | None:
        order = np.argsort(rows.column("rid").to_numpy())
        rid, n = (rows.column(c).to_numpy()[order].astype(np.int64) for c in ("rid", "n"))
        lanes = _lanes(rows.column("lanes"), self.config.lanes)[order]
        which = np.arange(len(rid))
        if not rows.column("lone")[0].as_py():
            side = rows.column("side").to_numpy()[order]
            which = np.sort([i for s in np.unique(side) for i, *_ in self._stars(which[side == s], n, lanes)])
        made = [(np.full(len(near), rid[i]), rid[near], far) for i, near, far in self._stars(which, n, lanes) if len(near)]
        return pa.table(dict(zip(("a", "b", "far"), map(np.concatenate, zip(*made, strict=True)), strict=True))) if made else None

    def _stars(self, rest: np.ndarray, n: np.ndarray, lanes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The first of the rows that are left, those near it and by how many bits, until none is left."""
        while len(rest):
            i, rest = rest[0], rest[1:]
            near = fitting(n[rest], n[i])
            far = np.bitwise_count(lanes[rest[near]] ^ lanes[i]).sum(1, dtype=np.int64)
            near[near] = far <= self.config.max_bits
            yield i, rest[near], far[far <= self.config.max_bits]
            rest = rest[~near]


class _Near:
    """Links of one bucket: every connected part of it as links to its least rid.

    A search from each unvisited row compares the rows just reached with those not yet reached,
    so a group of m close copies takes about m comparisons, not m squared.
    """

    def __init__(self, config: SimHash):
        self.config = config

    def __call__(self, rows: pa.Table) -> pa.Table | None:
        lanes = _lanes(rows.column("lanes"), self.config.lanes)
        rid = rows.column("rid").to_numpy()
        rest, a, b = np.arange(len(rid)), [], []
        while len(rest) > 1:
            reached, front, rest = [rest[:1]], rest[:1], rest[1:]
            while len(front) and len(rest):
                hit = np.zeros(len(rest), bool)
                for start in range(0, len(front), 64):
                    open_ = np.flatnonzero(~hit)
                    far = np.bitwise_count(lanes[front[start : start + 64], None] ^ lanes[rest[open_]]).sum(2, dtype=np.int64)
                    hit[open_] = (far <= self.config.max_bits).any(0)
                front, rest = rest[hit], rest[~hit]
                reached.append(front)
            part = rid[np.concatenate(reached)]
            if len(part) > 1:
                least = part.min()
                a.append(part[part != least])
                b.append(np.full(len(a[-1]), least))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else None


def near_components(prints: DataFrame, config: SimHash) -> DataFrame:
    """(rid, lanes, root) for the distinct fingerprints of prints (lanes).

    rid names a fingerprint: itself at 64 bits, else a 64-bit hash of it. root is the least rid
    that links lead to.
    """
    lane = F.col("lanes")
    rid = lane[0] if config.lanes == 1 else F.xxhash64(*[lane[k] for k in range(config.lanes)])
    distinct = materialize(prints.select("lanes").distinct().withColumn("rid", rid))
    keys = distinct.select("rid", "lanes").mapInArrow(_Keys(config), "key bigint, rid bigint, lanes array<bigint>")
    roots = connected_components(map_buckets(keys, _Near(config), "a bigint, b bigint", config.block_rows))
    roots = roots.select(F.col("node").alias("rid"), "root")
    return distinct.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))


def simhash_groups(docs: DataFrame, config: SimHash = THREE_WORDS) -> DataFrame:
    """(doc_id, lanes, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links lead to, the row's own included; null ids count
    only if a whole component has none. Texts are lower-cased (A-Z) and cut into words at ASCII
    space; fewer words than a shingle make one shingle, none (null, empty, blank) a zero
    fingerprint, linked like any other. Repeated rows stay. Other columns are not read, so their
    names can't clash. An empty table gives an empty one.
    """
    arrow_rows(docs.sparkSession)
    prints = materialize(docs.select("doc_id", fingerprint_column(F.col("text"), config).alias("lanes")))
    first = prints.groupBy("lanes").agg(F.min("doc_id").alias("first"))
    roots = near_components(prints, config)
    joined = materialize(roots.join(first, "lanes").select("lanes", "root", "first"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("lanes", "component_id")
    return prints.join(named, "lanes").select("doc_id", "lanes", "component_id")


def near_sets(sets: DataFrame, config: SimHash) -> DataFrame:
    """Pairs (a, b, far) of distinct sets (rid, n, lanes) whose fingerprints share a table's key and differ in
    far bits, at most max_bits, as a table; of a key of more than two sets, pairs with hubs instead of all, so
    that a key gives fewer pairs than it has sets. Pairs may repeat.

    Sets of fewer than four shingles are left out, since none is similar to a different one.
    """
    lane = [F.col("lanes")[k] for k in range(config.lanes)]
    known = sets.where(F.col("n") >= OVER).select("rid", "n", "lanes")
    keys = known.mapInArrow(_SetKeys(config), "key bigint, rid bigint, place bigint")
    met = dealt_pairs(keys, 2)
    pairs = met.where("a is not null").select("a", "b").distinct()
    for side in "ab":
        pairs = pairs.join(known.select(F.col("rid").alias(side), *[x.alias(f"{side}{k}") for k, x in enumerate(lane)]), side)
    far = sum(F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(config.lanes)).cast("bigint")
    many = materialize(met.where("a is null").select("key", "rid").join(known, "rid").select("key", "rid", "n", "lanes"))
    hubs = map_buckets(many, _Hubs(config), "a bigint, b bigint, far bigint", config.block_rows)
    near = materialize(pairs.select("a", "b", far.alias("far")).where(F.col("far") <= config.max_bits).unionAll(hubs))
    for table in (met, many):
        discard(table)
    return near


def linked_sets(near: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join all sets that similar pairs of near (a, b, far) join; more are left out.

    Each set is tried with the nearest of the lesser sets that it has, so with one however many there are;
    then what these links have left apart is tried with all.
    """
    nearest = near.groupBy("b").agg(F.min_by("a", F.struct("far", F.xxhash64("a", "b"))).alias("a")).select("a", "b")
    roots = materialize(connected_components(materialize(verified(nearest, sets, texts))))
    rest = verified(apart(near.select("a", "b").distinct(), roots), sets, texts)
    return materialize(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(rest))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of the least doc_id.

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more, and what such links lead to. SimHash finds them: tables of the sets' fingerprints, differing
    bits, then the sets of each pair compared. Since bits bound no similarity, the pairs that this may
    have missed are looked for between what is still apart, by shingles (shingle_join.py), so that
    none is lost and none linked in error. Texts without words are alike. All columns of docs are returned as they are. Null ids come after all others; among rows
    of the same id the least hash of the text wins, and of equal rows one stays.
    """
    arrow_rows(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    prints = set_prints(texts, partial(majority, lanes=FIVE_WORDS.lanes))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("mark").alias("m"))
    first = prints.groupBy("rid").agg(F.min(order).alias("first"))
    sets = distinct_sets(prints)
    width = max(16, sets.count().bit_length() + SPARE)
    config = replace(FIVE_WORDS, max_bits=COMPARED_BITS, tables=sampled_blocks(64 * FIVE_WORDS.lanes, len(FIVE_WORDS.tables), width))
    near = near_sets(sets, config)
    roots = similar_sets(sets, texts, linked_sets(near, sets, texts)).withColumnRenamed("node", "rid")
    rooted = first.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.col("first.i").alias("id"), F.col("first.m").alias("mark")).distinct())
    for table in (prints, sets, near):
        discard(table)
    rows, restored = sheltered(docs)
    marked = rows.withColumn("_mark", F.xxhash64("_text"))
    found = marked.join(kept, F.col("_doc_id").eqNullSafe(F.col("id")) & (F.col("_mark") == F.col("mark")), "left_semi")
    number = F.row_number().over(Window.partitionBy("_doc_id", "_mark").orderBy(F.lit(0)))
    return found.withColumn("_row", number).where("_row = 1").select(*restored)
