"""Mixing sources to target weights by hash thresholds, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded, materialize, sheltered, words

#: Weights of the sources in order, repeating, and how often a source may be taken at most.
WEIGHTS = (5, 2, 1)
MOST = 3
#: A row's hash has HASH_DIGITS hexadecimal digits; a histogram level splits by LEVEL_DIGITS of them.
HASH_DIGITS = 15
LEVEL_DIGITS = 2
LEVELS = 3


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of each text (null: 0) and the hash that orders a source."""
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of().alias("h"))


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def hash_of(doc_id: str = "doc_id") -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("bigint")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) for every source, one row each.

    Sources in the order of their code points (null last) weigh WEIGHTS, repeating, and share the
    total size. No target exceeds MOST times its source's size; what is above is shared again by
    weight among the others. That ends where every target is min(level * weight, cap): sorted by
    cap / weight, the sources up to some point are at their caps and the rest share what is left.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS))
    rows = by_source.withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size") * MOST).withColumn("turn", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    before = Window.orderBy("turn", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # Among the first of these levels that its source does not reach lies the common level.
    rows = rows.withColumn("level", left / share)
    fits = rows.withColumn("common", F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "level"))).over(everything))
    target = F.least(F.col("common.level") * F.col("weight"), F.col("cap").cast("double"))
    return fits.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def budgets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, cut): what is taken of each source.

    Every document is taken `whole` times, and those whose hash is below `cut` once more. The cut
    is found in histograms: sizes are summed by source and leading hash digits, and only the
    bucket in which the budget ends is split by further digits. Of the last bucket's hashes the
    one at which the budget ends is taken if that comes nearer to it.
    """
    named = materialize(targets(sized))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0)
    goal = named.withColumn("whole", whole.cast("bigint"))
    goal = goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    at = goal.select("source", "source_size", "target", "whole", "budget", F.lit(0).cast("bigint").alias("low"))
    for level in range(1, LEVELS + 2):
        digits = HASH_DIGITS if level > LEVELS else level * LEVEL_DIGITS
        width, before = 16 ** (HASH_DIGITS - digits), 16 ** (HASH_DIGITS - (level - 1) * LEVEL_DIGITS)
        edge = at.select(F.col("source").alias("s"), "low")
        inside = sized.where("size > 0").join(bounded(edge), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + before))
        buckets = inside.groupBy("source", F.expr(f"h div {width}L").alias("bucket")).agg(F.sum("size").alias("bucket_size"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = buckets.withColumn("upto", F.sum("bucket_size").over(running))
        again = at.select(F.col("source").alias("s"), "budget")
        sums = sums.join(bounded(again), F.col("source").eqNullSafe(F.col("s")))
        if level <= LEVELS:
            ends = F.col("upto") > F.col("budget")
            first = F.min(F.when(ends, F.struct("bucket", "upto", "bucket_size"))).alias("e")
            found = sums.groupBy("source").agg(first).where("e is not null")
            found = found.select(F.col("source").alias("s"), (F.col("e.bucket") * width).alias("next"), (F.col("e.upto") - F.col("e.bucket_size")).alias("spent"))
            at = at.join(bounded(materialize(found)), F.col("source").eqNullSafe(F.col("s")), "left")
            at = at.withColumn("budget", F.when(F.col("next").isNull(), F.lit(0.0)).otherwise(F.col("budget") - F.col("spent")))
            at = materialize(at.withColumn("low", F.coalesce("next", "low")).drop("s", "next", "spent"))
        else:
            taken = F.col("upto") - F.col("bucket_size") / 2 <= F.col("budget")
            found = sums.groupBy("source").agg(F.max(F.when(taken, F.col("bucket"))).alias("top"))
            at = at.join(bounded(materialize(found.withColumnRenamed("source", "s"))), F.col("source").eqNullSafe(F.col("s")), "left")
            at = at.withColumn("cut", F.when(F.col("top").isNotNull(), F.col("top") + 1).otherwise(F.col("low")))
    return materialize(at.select("source", "source_size", "target", "whole", "cut"))


def times_taken() -> Column:
    """How often a row with its source's budget is taken: 0 to MOST."""
    return F.least(F.col("whole") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0), F.lit(MOST)).cast("bigint")


def with_budgets(rows: DataFrame, budget: DataFrame) -> DataFrame:
    named = budget.withColumnRenamed("source", "s")
    return rows.join(bounded(named), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    taken is the document's size times how often the mix repeats it. Null, empty and blank texts
    have size 0 and are taken as 0 words; a source without words has target 0. Rows of the same
    doc_id have the same hash and are taken alike; null ids share one. Choices depend on nothing
    but doc_id and the sums, so reruns agree. Columns but these three are not read. Sources are
    ordered and filled up in one task, over a table of one row for each source; it, not the
    documents, is sent to every executor if it is small, and joined by shuffle if not. Empty
    tables give empty ones.
    """
    sized = materialize(sizes(docs))
    mixed = with_budgets(sized, budgets(sized))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * times_taken()).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix has them: a row for each time that it is taken, in its own columns.

    Texts without words are left out, as they add nothing to the mix.
    """
    sized = materialize(sizes(docs))
    budget = budgets(sized).select(F.col("source").alias("s"), "whole", "cut")
    rows, restored = sheltered(docs)
    rows = rows.withColumns({"h": hash_of("_doc_id"), "size": size_of(F.col("_text"))}).where("size > 0")
    rows = rows.join(bounded(budget), F.col("_source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("times", times_taken()).where("times > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return rows.select(*restored)


#: The same mix in DuckDB SQL: instead of histograms, a sum over each source in hash order.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS turn,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (all_weight - coalesce(sum(weight) OVER b, 0)) AS level
      FROM c WINDOW b AS (ORDER BY turn, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
             coalesce(least((SELECT arg_min(level, turn) FROM l WHERE level <= turn) * weight, CAST(cap AS DOUBLE)), 0.0) AS target
      FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
k AS (SELECT source, h, sum(size) AS n FROM d WHERE size > 0 GROUP BY source, h),
r AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM k),
e AS (SELECT d.*, q.source_size, q.target, q.whole,
             coalesce(r.upto - r.n / 2 <= q.target - q.whole * q.source_size, false) AS once_more
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
      LEFT JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.h = d.h)
SELECT doc_id, size, source_size, target,
       CAST(size * least(whole + CASE WHEN once_more THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM e
"""
