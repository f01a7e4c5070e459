"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.buckets import BLOCK_ROWS, map_buckets
from graphloom.llm.common import arrow_rows, materialize
from graphloom.llm.components import connected_components

#: Rows of one label for each bucket of a table, at most on average.
BUCKET_ROWS = 8


@dataclass(frozen=True)
class SignTables:
    """tables of `bits` random hyperplanes each.

    Two vectors at cosine 0.93 lie 21.6 degrees apart, so they agree in one sign with probability
    0.88, in 12 with 0.216, and meet in one of 32 tables with 0.9996; closer ones more often.
    """

    min_cosine: float = 0.93
    tables: int = 32
    bits: int = 12
    seed: int = 4
    block_rows: int = BLOCK_ROWS

    def sized(self, rows: int, most_bits: int = 40) -> SignTables:
        """Tables for so many rows of one label: a bit more each time the rows double, so that buckets
        stay as full as they are, and more tables, so that a link is found as likely as now. Work
        then grows with the power 1.18 of the rows, as two signs agree with probability 0.88."""
        same = 1 - math.acos(self.min_cosine) / math.pi
        missed = self.tables * math.log1p(-(same**self.bits))
        bits = min(max(self.bits, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))), most_bits)
        return replace(self, bits=bits, tables=math.ceil(missed / math.log1p(-(same**bits)) - 1e-9))

    def planes(self, dim: int) -> np.ndarray:
        rng = np.random.default_rng((self.seed, dim))
        return rng.standard_normal((dim, self.tables * self.bits))

    def signatures(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors @ self.planes(vectors.shape[1]) >= 0).reshape(len(vectors), self.tables, self.bits)
        return (signs << np.arange(self.bits)).sum(2)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) for each length of vector, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        vectors = flat[starts[at, None] + np.arange(n)]
        yield at, vectors / np.linalg.norm(vectors / np.abs(vectors).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(vectors).max(1, keepdims=True)


class _Keys:
    """Rows (key, rid, table, copies, vector) of distinct vectors, one for each table."""

    def __init__(self, config: SignTables):
        self.config = config

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _by_length(batch.column("vector")):
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                group = part.column("grp").to_numpy()
                signs = self.config.signatures(vectors).astype(np.uint64)
                for table in range(self.config.tables):
                    with np.errstate(over="ignore"):
                        key = (group.view(np.uint64) ^ (signs[:, table] << np.uint64(10)) ^ np.uint64(table)) * np.uint64(0x9E3779B97F4A7C15)
                    columns = [pa.array(key.view(np.int64)), part.column("rid"), part.column("grp"), pa.array(np.full(len(at), table, np.int32)), part.column("copies"), part.column("vector")]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "rid", "grp", "table", "copies", "vector"])


class _Links:
    """For one bucket: (rid, peer, links) with the links first found in this bucket.

    links counts the rows (copies) at the other ends; peer is the least rid of the connected part,
    in which rid lies, of the bucket's links. Pairs stay inside this function, a block at a time.
    """

    def __init__(self, config: SignTables):
        self.config = config

    def __call__(self, rows: pa.Table) -> pa.Table | None:
        group, table = rows.column("grp").to_numpy(), rows.column("table").to_numpy()
        if (group != group[0]).any() or (table != table[0]).any():  # two keys of one hash
            parts = {(g, t) for g, t in zip(group.tolist(), table.tolist(), strict=True)}
            found = [self(rows.filter(pa.array((group == g) & (table == t)))) for g, t in sorted(parts)]
            found = [x for x in found if x is not None]
            return pa.concat_tables(found) if found else None
        (_, vectors), *_ = _by_length(rows.column("vector"))
        rid, copies = rows.column("rid").to_numpy(), rows.column("copies").to_numpy()
        side, lone = rows.column("side").to_numpy(), rows.column("lone")[0].as_py()
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(rid), 512):
            i, j = np.nonzero(vectors[start : start + 512] @ vectors.T >= self.config.min_cosine - 1e-9)
            i += start
            fresh = (i < j) & (lone | (side[i] != side[j]))
            near += self._linked(vectors, i[fresh], j[fresh])
        return self._table(rid, copies, vectors, table, near)

    def together(self, rows: pa.Table) -> pa.Table | None:
        """The same for a table of several small buckets, sorted by __cell."""
        found = []
        for at, vectors in _by_length(rows.column("vector")):
            part = rows.take(pa.array(at))
            cell, group, table, rid, copies, side, lone = (part.column(c).to_numpy() for c in ("__cell", "grp", "table", "rid", "copies", "side", "lone"))
            near = []
            for gap in range(1, len(cell)):
                i = np.flatnonzero(cell[gap:] == cell[:-gap])
                if not len(i):
                    break
                j = i + gap
                fresh = (group[i] == group[j]) & (table[i] == table[j]) & (lone[i] | (side[i] != side[j]))
                near += self._linked(vectors, i[fresh], j[fresh])
            found.append(self._table(rid, copies, vectors, table, near))
        found = [x for x in found if x is not None]
        return pa.concat_tables(found) if found else None

    def _linked(self, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The pairs of positions whose cosine is large enough, a part at a time."""
        out = []
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            hit = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= self.config.min_cosine
            if hit.any():
                out.append((a[hit], b[hit]))
        return out

    def _table(self, rid: np.ndarray, copies: np.ndarray, vectors: np.ndarray, table: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table | None:
        if not near:
            return None
        linked = np.unique(np.concatenate([x for pair in near for x in pair]))
        place = np.zeros(len(rid), np.int64)
        place[linked] = np.arange(len(linked))
        near = [(place[a], place[b]) for a, b in near]
        rid, copies, table = rid[linked], copies[linked], table[linked]
        signs, links = self.config.signatures(vectors[linked]), np.zeros(len(rid), np.int64)
        before = np.arange(self.config.tables)
        for i, j in near:
            for at in range(0, len(i), 1 << 14):
                a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                first = ~((signs[a] == signs[b]) & (before < table[a, None])).any(1)
                links += np.bincount(a[first], copies[b[first]], len(rid)).astype(np.int64) + np.bincount(b[first], copies[a[first]], len(rid)).astype(np.int64)
        root = _roots(len(rid), near)
        least = np.full(len(rid), np.iinfo(np.int64).max)
        np.minimum.at(least, root, rid)
        return pa.table({"rid": rid, "peer": least[root], "links": links})


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least position that pairs lead to, for every position."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in pairs:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def embedding_links(vectors: DataFrame, config: SignTables = SignTables()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Rows of the same label link at a cosine of config.min_cosine or more. Vectors that are null,
    empty, zero or hold a null or non-finite component, and rows without a label, link with
    nothing: no links, a component of their own, kept. Vectors of different lengths don't link.
    Equal vectors are compared once and count as often as they occur; repeated vec_ids are rows
    like any other. A null vec_id is not a component's smallest id unless all of its are null
    (component_id is then null and kept false). Other columns are not read. Empty tables give
    empty ones.
    """
    arrow_rows(vectors.sparkSession, 4096)
    # Single-precision vectors are shuffled as they are; their cosines are taken in double precision.
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    value = F.col("embedding").cast(kind)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & finite & F.exists(value, lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("label").alias("grp0"), value.alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.withColumn("h1", F.xxhash64("grp0", "vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector", "grp0"))
    distinct = rows.where("usable").groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.any_value("grp0").alias("grp0"), F.any_value("vector").alias("vector")
    )
    grp = F.xxhash64("grp0", F.size("vector")).alias("grp")
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("rid"), grp, "h1", "h2", "copies", "first", "vector"))
    most = distinct.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    config = config.sized(most)
    keys = distinct.select("rid", "grp", "copies", "vector").mapInArrow(
        _Keys(config), f"key bigint, rid bigint, grp bigint, table int, copies bigint, vector {kind}"
    )
    found = materialize(map_buckets(keys, _Links(config), "rid bigint, peer bigint, links bigint", config.block_rows))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("rid").alias("a"), F.col("peer").alias("b")).distinct())
    named = distinct.select("rid", "h1", "h2", "copies", "first").join(counts, "rid", "left")
    named = named.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    named = materialize(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    hit = rows.where("usable").select("vec_id", "h1", "h2").join(named, ["h1", "h2"])
    alone = rows.where("not usable").select("vec_id", F.col("vec_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    both = hit.select("vec_id", "component_id", "n_links").unionAll(alone)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return both.select("vec_id", F.col("n_links").cast("bigint"), "component_id", kept.alias("kept"))
