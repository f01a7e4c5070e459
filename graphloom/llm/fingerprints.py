"""One-permutation MinHash fingerprints, with built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import let, words

#: A shingle's hash gives its bin by the top 8 bits; 4 low bits of each bin's minimum are stored.
BINS = 256
BIN_SHIFT = 56
LOW_BITS = 4
#: Random bins that an empty bin tries before it goes through all filled bins in a random order.
DRAWS = 6
SHINGLE = 5
#: Rows of one slice of the doc_id order, and the most slices there can be.
SLICE_ROWS = 2_000
MOST_SLICES = 65_536


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the word shingles; fewer words than a shingle make one, no words none."""

    def of(hashes: Column) -> Column:
        whole = F.array(F.xxhash64(hashes))
        parts = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - size),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]),
        )
        none = F.array().cast("array<bigint>")
        return F.when(F.size(hashes) == 0, none).when(F.size(hashes) < size, whole).otherwise(parts)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def minimum_bins(hashes: Column) -> Column:
    """The least hash of each bin, in bin order; a bin without hashes holds its greatest value.

    Hashes are binned by one sort: the first of each run of equal top bits is the bin's minimum.
    The greatest value of every bin is sorted in with them, so that no bin is missing.
    """

    def firsts(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda h, i: (i == 0) | (F.shiftrightunsigned(h, BIN_SHIFT) != F.shiftrightunsigned(F.get(ordered, i - 1), BIN_SHIFT)),
        )

    return let(F.sort_array(F.concat(hashes, _empty_bins())), firsts)


def _empty_bins() -> Column:
    """The greatest value of each bin b (as a signed byte: -128 first, as hashes sort)."""
    return F.expr(f"transform(sequence(-{BINS // 2}L, {BINS // 2 - 1}L), b -> (shiftleft(b, {BIN_SHIFT}) | {2**BIN_SHIFT - 1}L))")


def _filled(value: Column) -> Column:
    return F.expr(f"{2**BIN_SHIFT - 1}L") != value.bitwiseAND(F.lit(2**BIN_SHIFT - 1))


def densify(bins: Column) -> Column:
    """Fills every empty bin from a filled one, chosen by a random probing order of its own.

    A bin first tries DRAWS random bins. If all are empty it takes the filled bin that comes first
    in a random order, which ends the search however few bins are filled. Two sets that agree on
    the bins probed choose alike, so collisions keep the probability of the similarity.
    """

    def dense(values: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: _filled(F.get(values, j)))

        def fill(used: Column) -> Column:
            def one(value: Column, i: Column) -> Column:
                drawn = F.aggregate(
                    F.sequence(F.lit(1), F.lit(DRAWS)),
                    value,
                    lambda got, t: F.when(_filled(got), got).otherwise(F.get(values, F.xxhash64(i, t).bitwiseAND(BINS - 1).cast("int"))),
                )

                def rest(got: Column) -> Column:
                    order = F.transform(used, lambda j: F.xxhash64(i, F.lit(0), j).bitwiseAND(F.lit(-BINS)).bitwiseOR(j.cast("bigint")))
                    first = F.array_min(order).bitwiseAND(BINS - 1).cast("int")
                    return F.when(_filled(got), got).otherwise(F.get(values, first))

                return F.when(_filled(value), value).otherwise(let(drawn, rest))

            return F.transform(values, one)

        return let(filled, fill)

    return let(bins, dense)


def pack(values: Column) -> Column:
    """Low bits of each value, hashed with its bin, packed as 64-bit words.

    Bins filled from the same one hold the same value; hashed with the bin, their low bits agree
    with another set's by chance independently.
    """
    per = 64 // LOW_BITS
    return F.transform(
        F.sequence(F.lit(0), F.lit(BINS // per - 1)),
        lambda w: F.aggregate(
            F.sequence(F.lit(0), F.lit(per - 1)),
            F.lit(0).cast("bigint"),
            lambda word, k: F.shiftleft(word, LOW_BITS).bitwiseOR(F.xxhash64(F.get(values, w * per + k), w, k).bitwiseAND(2**LOW_BITS - 1)),
        ),
    )


def fingerprint(text: Column) -> Column:
    """array<bigint> of packed low bits; an empty array for a text without words."""

    def of(hashes: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.when(F.size(hashes) == 0, none).otherwise(let(densify(minimum_bins(hashes)), pack))

    return let(shingle_hashes(text), of)


def as_hex(words_: Column) -> Column:
    """Two fingerprints are equal exactly if their strings are; no words give a zero fingerprint."""
    digits = F.array_join(F.transform(words_, lambda w: F.lpad(F.hex(w), 16, "0")), "")
    return F.when(F.size(words_) == 0, F.lit("0" * (BINS * LOW_BITS // 4))).otherwise(F.lower(digits))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity (0 to 1) of the shingle sets of two fingerprints.

    Low bits of different minima agree by chance with probability 2^-LOW_BITS, for which the
    share of agreeing bins is corrected. Two empty sets are alike (1), an empty and another not.
    """
    ones = 0x1111111111111111  # the lowest bit of every group of four

    def differing(x: Column) -> Column:
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    chance = 2.0**-LOW_BITS
    share = 1 - apart / BINS
    corrected = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    one_empty = (F.size(a) == 0) != (F.size(b) == 0)
    return F.when(one_empty, 0.0).when(F.size(a) == 0, 1.0).otherwise(corrected)


def _slices(ids: DataFrame) -> list[list[int]]:
    """Quantiles of doc_id that cut its order into slices, in groups of about the square root."""
    rows = ids.count()
    parallel = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = min(MOST_SLICES, max(8 * parallel, math.ceil(rows / SLICE_ROWS)))
    shares = ",".join(str(k / slices) for k in range(slices))
    bounds = ids.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {20 * slices})")).first()[0] or [0]
    bounds = sorted(set(bounds))
    step = math.isqrt(len(bounds)) or 1
    return [bounds[k : k + step] for k in range(0, len(bounds), step)]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has the last quarter of its code points (rounded down) replaced by the first
    as many, or all, of the next document's text, by ascending doc_id; the first follows the last.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness to the next document's). Null texts count as empty; rows without a doc_id
    come after all others; rows of equal ids are ordered by text, and of equal texts too any order
    gives the same values. A single document is its own next. Columns but doc_id and text are not
    read. An empty table gives an empty one.

    The order is cut into slices at values of doc_id, so that no task holds more than a slice. The
    first document of each slice is also sent, as a guest, to the end of the slice before.
    """
    slices = _slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null"))
    heads = [v for part in slices for v in part]
    offsets = [0]
    for part in slices:
        offsets.append(offsets[-1] + len(part))
    firsts = F.array(*[F.lit(part[0]).cast("bigint") for part in slices])
    parts = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in part]) for part in slices])
    last = len(heads) - 1

    def below(values: Column, key: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= key)) - 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("g", F.greatest(below(firsts, F.col("doc_id")), F.lit(0)))
    inner = F.greatest(below(F.get(parts, F.col("g")), F.col("doc_id")), F.lit(0))
    slice_ = F.when(F.col("doc_id").isNull(), last).otherwise(F.get(F.array(*[F.lit(o) for o in offsets[:-1]]), F.col("g")) + inner)
    rows = rows.withColumn("slice", slice_)
    head = F.get(F.get(parts, F.col("g")), F.col("slice") - F.get(F.array(*[F.lit(o) for o in offsets]), F.col("g")))
    is_head = F.col("doc_id").isNotNull() & (head == F.col("doc_id"))
    if not heads or docs.select("doc_id").where("doc_id is not null").isEmpty():
        is_head = F.lit(True)  # all ids are null: every row may be the first
    rows = rows.withColumn("print", fingerprint(F.col("text")))
    at = F.struct(F.col("slice").alias("slice"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("slice") - 1, F.lit(len(heads))).alias("slice"), F.lit(True).alias("guest"))
    placed = rows.select("doc_id", "text", "print", F.inline(F.when(is_head, F.array(at, guest)).otherwise(F.array(at))))
    order = Window.partitionBy("slice").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")
    after = F.lead(F.struct("text", "print")).over(order).alias("after")
    both = placed.select("doc_id", "text", "print", "guest", after).where("not guest")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("after.text"), F.lit(1), cut))
    both = both.select("doc_id", n.cast("bigint").alias("n_chars"), "print", F.col("after.print").alias("next_print"), edited.alias("edited"))
    both = both.withColumn("edited_print", fingerprint(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
