"""Exact similarity of shingle sets: overlap of every candidate, and a prefix filter with bounds in buckets for
the pairs that SimHash (simhash.py) has not joined."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.buckets import map_buckets
from graphloom.llm.common import WORD, bounded, discard, materialize
from graphloom.llm.components import connected_components

_WORD = re.compile(WORD)
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words of a shingle, and the least Jaccard similarity of linked sets as a fraction.
SHINGLE = 5
OVER, UNDER = 4, 5
#: A set's sketch has a power of two of bits, so many for each shingle at least: bit k tells whether an
#: odd number of its shingles has k for its low bits.
SKETCH = 4
#: Texts of the sample that tells which shingles are common; at least so many of them hold such one.
SAMPLE, COMMON, MOST_COMMON = 8192, 4, 50_000
#: Buckets of up to so many rows give all their pairs at once; in larger ones hubs are linked first.
SMALL = 32
#: Partners that a set is tried with first, of those its sketch leaves in a bucket.
NEAREST = 4
#: Pairs of one set that one row of the set serves.
PAIRS = 256
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 32 and len(self) < 1 << 16:
            self[word] = found
        return found


_word_hash = _WordHashes().__getitem__


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles: of all its words if they are fewer than five."""
    found = _WORD.findall((text or "").translate(_UPPER))
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_word_hash, found), np.uint64, len(found))
    size = min(SHINGLE, len(hashes))
    many = len(hashes) - size + 1
    x = np.full(many, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            x = x * _FACTOR + hashes[k : k + many]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(x ^ (x >> np.uint64(31)))


def _list(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


class _Sets:
    """(mark, shingles) of texts (mark, text)."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), _list(made)], ["mark", "shingles"])


class _Prints:
    """(doc_id, mark, rid, n, lanes, sketch, prefix, rare) of texts (doc_id, mark, text).

    rid is a hash of the set, n its size, lanes what `fingerprint` makes of it. The prefix is the part of the set that any similar set
    must meet with its own: the first n - ceil(0.8 n) + 1 shingles in an order that all sets share,
    by hash, with the common ones (given by rising frequency) last; `rare` of it are not common.
    """

    def __init__(self, common: np.ndarray, fingerprint: Callable[[np.ndarray], np.ndarray]):
        self.fingerprint = fingerprint
        self.sorted = np.sort(common)
        self.rank = np.argsort(common)

    def prefix(self, found: np.ndarray) -> tuple[np.ndarray, int]:
        least = len(found) - -(-OVER * len(found) // UNDER) + 1
        rare = len(found)
        if len(self.sorted) and len(found):
            at = np.minimum(np.searchsorted(self.sorted, found), len(self.sorted) - 1)
            known = self.sorted[at] == found
            last = found[known][np.argsort(self.rank[at[known]])]
            rare -= len(last)
            found = np.concatenate([found[~known], last])
        return found[:least], min(rare, least)

    @staticmethod
    def sketch(found: np.ndarray) -> np.ndarray:
        bits = max(64, 1 << (SKETCH * len(found) - 1).bit_length()) if len(found) else 64
        odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            rid = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            sketches = [self.sketch(s) for s in sets]
            prefixes = [self.prefix(s) for s in sets]
            sizes = [pa.array(x, pa.int32()) for x in ([len(s) for s in sets], [rare for _, rare in prefixes])]
            lanes = _list([self.fingerprint(s) for s in sets])
            made = [batch.column("doc_id"), batch.column("mark"), pa.array(rid), sizes[0], lanes, _list(sketches), _list([p for p, _ in prefixes]), sizes[1]]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "mark", "rid", "n", "lanes", "sketch", "prefix", "rare"])


def fitting(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may be similar."""
    return UNDER * np.minimum(na, nb) >= OVER * np.maximum(na, nb)


def _fits(na: np.ndarray, nb: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that share a shingle at these places may be similar."""
    most = np.minimum(at_a, at_b) + np.minimum(na - at_a, nb - at_b)
    return fitting(na, nb) & ((OVER + UNDER) * most >= OVER * (na + nb))


class _Pairs:
    """Of rows (key, rid, place) sorted by key: the pairs (a, b) of keys of up to `small` rows that
    sizes and places allow; rows of larger keys are passed on. A run of one key is held over
    batches only up to `small` rows."""

    def __init__(self, small: int):
        self.small = small

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = np.zeros((3, 0), np.int64), []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("key", "rid", "place")])], 1)
            end = rows[0, -1]
            last = np.searchsorted(rows[0], end)
            if end in crowded or rows.shape[1] - last > self.small:  # the rows of a crowded key need not wait
                crowded, last = [*crowded, end], rows.shape[1]
            held = rows[:, last:]
            yield self._found(rows[:, :last], crowded)
            crowded = crowded[-1:]
        yield self._found(held, [])

    def _found(self, rows: np.ndarray, crowded: list[int]) -> pa.RecordBatch:
        key, rid, place = rows
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        length = np.diff(np.append(starts, len(key)))
        many = np.repeat((length > self.small) | np.isin(key[starts], crowded), length)
        several = np.repeat(length > 1, length) & ~many
        more = [x[many] for x in (key, rid, place)]
        key, rid, n, at = key[several], rid[several], place[several] >> 32, place[several] & 0xFFFFFFFF
        a, b = [], []
        for gap in range(1, self.small):
            i = np.flatnonzero(key[gap:] == key[:-gap])
            if not len(i):
                break
            i = i[_fits(n[i], n[i + gap], at[i], at[i + gap])]
            a.append(np.minimum(rid[i], rid[i + gap]))
            b.append(np.maximum(rid[i], rid[i + gap]))
        pairs = np.stack([np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b)])
        pairs = pairs[:, np.lexsort(pairs)]
        pairs = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(0)])[: pairs.shape[1]]]
        none = [pa.nulls(pairs.shape[1], pa.int64())] * 3
        left = [pa.concat_arrays([pa.array(x), pa.nulls(len(more[0]), pa.int64())]) for x in pairs]
        right = [pa.concat_arrays([x, pa.array(y)]) for x, y in zip(none, more, strict=True)]
        return pa.RecordBatch.from_arrays([*left, *right], ["a", "b", "key", "rid", "place"])


class _Candidates:
    """Pairs of a bucket that no bound rules out, as (a, b) with a < b.

    Similar sets differ in at most a ninth of na + nb shingles. That bounds their sizes, the number
    of differing bits of their sketches, and how far apart the places of the shared shingle are.
    hubs: rows are linked to the first row that they may be similar to, so that a bucket gives fewer
    pairs than rows. nearest: each row outside the bucket's largest component gives its NEAREST
    partners of another `root`. all: all pairs of different `root`.
    """

    def __init__(self, mode: str):
        self.mode = mode
        self.hubs = mode == "hubs"

    def __call__(self, rows: pa.Table) -> pa.Table | None:
        rid = rows.column("rid").to_numpy()
        order = np.argsort(rid)
        rid, n, at = rid[order], rows.column("n").to_numpy()[order].astype(np.int64), rows.column("at").to_numpy()[order].astype(np.int64)
        root = rows.column("root").to_numpy()[order] if "root" in rows.column_names else rid
        cross = rows.column("side").to_numpy()[order] if "side" in rows.column_names and not rows.column("lone")[0].as_py() else None
        sketches = _Sketches(rows.column("sketch"), order)
        rest, a, b = np.arange(len(rid)), [], []
        if self.mode == "nearest":
            names, counts = np.unique(root, return_counts=True)
            for i in np.flatnonzero(root != names[counts.argmax()]):
                may = np.flatnonzero(_fits(n, n[i], at, at[i]) & (root != root[i]))
                may = may if cross is None else may[cross[may] != cross[i]]
                far = sketches.far(i, may) / (n[may] + n[i])
                best = np.argsort(far, kind="stable")[:NEAREST]
                best = may[best[(OVER + UNDER) * far[best] <= 2 * UNDER - OVER - UNDER]]
                a.append(np.minimum(rid[i], rid[best]))
                b.append(np.maximum(rid[i], rid[best]))
            rest = rest[:0]
        while len(rest) > 1:
            i, rest = rest[0], rest[1:]
            near = _fits(n[rest], n[i], at[rest], at[i]) & (root[rest] != root[i])
            if cross is not None and not self.hubs:
                near &= cross[rest] != cross[i]
            if near.any():
                may = rest[near]
                near[near] = (OVER + UNDER) * sketches.far(i, may) <= (2 * UNDER - OVER - UNDER) * (n[may] + n[i])
                found = rest[near]
                a.append(np.full(len(found), rid[i]))
                b.append(rid[found])
                if self.hubs:
                    rest = rest[~near]
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else None


class _Sketches:
    """The sketches of a bucket's rows, as a matrix for each length."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray):
        column = column.combine_chunks()
        words = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, start = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(words) - words
        self.words, self.row, self.of = words[order], np.zeros(len(order), np.int64), {}
        for w in np.unique(words):
            mine = np.flatnonzero(self.words == w)
            self.row[mine] = np.arange(len(mine))
            self.of[w] = flat[start[order[mine], None] + np.arange(w)]

    def far(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many bits of i's sketch differ from each other one's, the longer folded to the shorter."""
        out = np.zeros(len(others), np.int64)
        mine = self.of[self.words[i]][self.row[i]]
        for w in np.unique(self.words[others]):
            which = self.words[others] == w
            theirs, short = self.of[w][self.row[others[which]]], min(w, len(mine))
            folded = np.bitwise_xor.reduce(theirs.reshape(len(theirs), -1, short), 1)
            out[which] = np.bitwise_count(folded ^ np.bitwise_xor.reduce(mine.reshape(-1, short), 0)).sum(1, dtype=np.int64)
        return out


_PAIR = "a bigint, b bigint"


def set_prints(docs: DataFrame, fingerprint: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, mark, rid, n, lanes, sketch, prefix, rare) for every row of docs (doc_id, mark, text), as a table."""
    part = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.col("mark"), F.lit(part)) == 0).dropDuplicates(["mark"]).select("mark", "text")
    each = sample.mapInArrow(_Sets(), "mark bigint, shingles array<bigint>").select(F.explode("shingles").alias("s"))
    common = each.groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST_COMMON)
    known = np.array([r.s for r in common.collect()][::-1], np.int64).view(np.uint64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, mark bigint, rid bigint, n int, lanes array<bigint>, sketch array<bigint>, prefix array<bigint>, rare int"
    return materialize(docs.select("doc_id", "mark", "text").mapInArrow(_Prints(known, fingerprint), schema))


def distinct_sets(prints: DataFrame) -> DataFrame:
    """One row (rid, mark, n, lanes, sketch, prefix, rare) for each set of prints, as a table."""
    return materialize(prints.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("mark", "n", "lanes", "sketch", "prefix", "rare")]))


def dealt_pairs(keys: DataFrame, small: int | None = None) -> DataFrame:
    """(a, b) of the sets that share a key, of rows (key, rid, place), as a table; place is n << 32 and the
    place of the key. Only sizes and places are looked at, pairs may repeat, and the rows of keys of
    more than `small` sets (SMALL unless given) come as they are, with no a and b."""
    dealt = keys.repartition("key").sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(_Pairs(small or SMALL), f"{_PAIR}, key bigint, rid bigint, place bigint"))


def similar_sets(distinct: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) for the distinct sets that have a partner of similarity 0.8 or more.

    links (a, b) are verified already; pairs that these join are not tried again. Of the others no pair
    is lost and none is linked in error, but for equal 64-bit hashes of different shingles.
    docs (mark, text) are read again for the sets of the candidates. Keys that are rare in the sample
    are dealt out by key, with nothing but a set's number, size and place; common ones, and the rare
    ones that turn out to be shared by many, are compared as buckets of map_buckets().
    """
    roots = materialize(connected_components(links))
    place = (F.shiftleft(F.col("n").cast("bigint"), 32) + F.col("at")).alias("place")
    keys = distinct.select("rid", "n", "rare", F.posexplode("prefix").alias("at", "key")).select("key", "rid", place, (F.col("at") < F.col("rare")).alias("few"))
    found = dealt_pairs(keys.where("few").drop("few"))
    pairs = apart(found.where("a is not null").select("a", "b").distinct(), roots)
    crowded = found.where("a is null").select("key", "rid", "place").unionAll(keys.where("not few").drop("few"))
    size, at = (F.shiftright("place", 32)).cast("int").alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("at")
    many = materialize(crowded.join(distinct.select("rid", "sketch"), "rid").select("key", "rid", size, at, "sketch"))
    full = not many.isEmpty()
    # What is still apart in crowded buckets is joined to hubs, then tried with its nearest partners,
    # then with every one: few pairs are left for that, however large a group of copies is.
    for mode in ("hubs", "nearest", "all") if full else ("",):
        if mode:
            named = many.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
            met = map_buckets(named, _Candidates(mode), _PAIR)
            pairs = pairs.unionAll(met) if mode == "hubs" else met
        more = materialize(verified(pairs, distinct, docs))
        if not more.isEmpty():
            joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # as good as the links so far
            roots = materialize(connected_components(joined.unionAll(more)))
    for table in (found, many):
        discard(table)
    return roots


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that links have not joined."""
    for side in "ab":
        pairs = pairs.join(bounded(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))), side, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _near_sketches(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs whose sketches differ in no more bits than similar sets can.

    Each shingle that only one of two sets has turns one bit, so the differing bits are no more than
    those shingles. The longer of two sketches is folded to the length of the other.
    """
    for side in "ab":
        pairs = pairs.join(distinct.select(F.col("rid").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    bits = lambda x, y: F.zip_with(x, y, lambda p, q: F.coalesce(p, F.lit(0)).bitwiseXOR(F.coalesce(q, F.lit(0))))
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x, y: F.when(F.size(x) > F.size(y), bits(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)))).otherwise(F.col(x))
    far = F.aggregate(bits(folded("sa", "sb"), folded("sb", "sa")), F.lit(0), lambda n, x: n + F.bit_count(x))
    return pairs.where((OVER + UNDER) * far <= (2 * UNDER - OVER - UNDER) * (F.col("na") + F.col("nb"))).select("a", "b")


def verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of sets whose exact similarity is 0.8 or more."""
    pairs = materialize(_near_sketches(pairs.distinct(), distinct))
    if pairs.isEmpty():
        return pairs
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
    marks = materialize(distinct.select("rid", "mark").join(bounded(wanted), "rid", "left_semi"))
    texts = docs.select("mark", "text").join(bounded(marks.select("mark"), 200_000), "mark", "left_semi").dropDuplicates(["mark"])
    sets = materialize(texts.mapInArrow(_Sets(), "mark bigint, shingles array<bigint>").join(marks, "mark").select("rid", "shingles"))
    # A set of many pairs is repeated, so that its pairs spread over many tasks.
    often = lambda side: pairs.groupBy(side).count().where(F.col("count") > PAIRS).select(F.col(side).alias("rid"), F.ceil(F.col("count") / PAIRS).cast("int").alias("__n"))
    for side, hot in [(side, materialize(often(side))) for side in "ba"]:
        dealt, copies = pairs.withColumn("__n", F.lit(1)), sets.withColumn("__part", F.lit(0))
        if not hot.isEmpty():
            dealt = dealt.drop("__n").join(bounded(hot.withColumnRenamed("rid", side)), side, "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
            copies = sets.join(bounded(hot), "rid", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__n")
        dealt = dealt.withColumn("__part", F.pmod(F.xxhash64("a", "b"), F.col("__n")).cast("int")).drop("__n")
        pairs = dealt.join(copies.withColumnsRenamed({"rid": side, "shingles": f"set_{side}"}), [side, "__part"]).drop("__part")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where((OVER + UNDER) * shared >= OVER * (F.size("set_a") + F.size("set_b"))).select("a", "b")
