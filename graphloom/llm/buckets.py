"""Work on buckets of candidate rows without collecting a bucket or emitting its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded, materialize

#: Rows of a bucket that one task compares at once; larger buckets are compared block by block.
BLOCK_ROWS = 4096
#: Rows of a bucket that is compared together with others.
SMALL_ROWS = 64


def map_buckets(rows: DataFrame, visit: Callable[[pa.Table], pa.Table | None], schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Applies visit to every bucket of rows (key: bigint, rid: bigint, ...).

    A bucket with more than block_rows rows is cut into blocks by a hash of rid, and every pair of
    blocks is visited by itself, so hot buckets spread over many tasks and no comparison is lost.
    visit gets the rows of one bucket, or of one pair of blocks, with a column `side`: the block
    of each row. `lone` is false where two different blocks meet; then only pairs of rows from
    different sides are new. Buckets of one row are skipped.
    """
    hot = materialize(rows.groupBy("key").count().where(F.col("count") > block_rows))
    blocks = F.ceil(F.col("count") / block_rows).cast("int")
    cold = rows.withColumn("__n", F.lit(1))
    if not hot.isEmpty():
        counts = hot.select("key", blocks.alias("__n"))
        cold = rows.join(bounded(counts), "key", "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    placed = cold.withColumn("side", F.pmod(F.xxhash64("rid"), F.col("__n")).cast("int"))
    placed = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    low, high = F.least("side", "__other"), F.greatest("side", "__other")
    placed = placed.withColumn("lone", low == high)
    cell = F.when(F.col("__n") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    placed = placed.withColumn("__cell", cell).drop("__n", "__other")
    dealt = placed.repartition("__cell").sortWithinPartitions("__cell", "key", "lone")
    return dealt.mapInArrow(_Runs(visit), schema)


class _Runs:
    """Cuts sorted batches into runs of one cell; a run has at most about two blocks of rows.

    If visit has a function `together`, it gets the small runs that lie within a batch, all at once.
    """

    def __init__(self, visit: Callable[[pa.Table], pa.Table | None]):
        self.visit = visit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("__cell").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [batch.num_rows]])
            length = np.diff(cuts)
            alone = length == 1
            if hasattr(self.visit, "together"):
                alone |= length <= SMALL_ROWS
            alone[[0, -1]] = False  # these may go on in other batches
            few = np.repeat(alone & (length > 1), length)
            if few.any():
                out = self.visit.together(pa.Table.from_batches([batch.filter(pa.array(few))]))
                if out is not None and out.num_rows:
                    yield from out.to_batches()
            for start, stop in zip(cuts[:-1][~alone].tolist(), cuts[1:][~alone].tolist(), strict=True):
                if held and held[0].column("__cell")[0].as_py() != cells[start]:
                    yield from self._run(held)
                    held = []
                if held or stop == batch.num_rows:
                    held.append(batch.slice(start, stop - start))
                elif stop - start > 1:
                    yield from self._run([batch.slice(start, stop - start)])
        yield from self._run(held)

    def _run(self, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in held) > 1:
            out = self.visit(pa.Table.from_batches(held).drop_columns(["__cell"]))
            if out is not None and out.num_rows:
                yield from out.to_batches()
