"""Document fingerprints by one-permutation MinHash, with DataFrame functions alone.

Every five-word shingle is hashed once (64 bits): the top 7 bits name one of 128 bins, and a bin keeps its least hash.
An empty bin takes the value of the first non-empty bin in its own random order of the bins (optimal densification:
each empty bin makes an independent choice, the same for all texts). The 8 low bits of each bin make the packed
fingerprint, 256 hex digits. Two unrelated bins agree in 8 bits with probability 1/256, so likeness is
`(share of equal bins - 1/256) / (1 - 1/256)`, not below 0.

Cases: null text counts as empty; texts without words have the empty fingerprint, of likeness 1 to itself and 0 to
others; texts of fewer than five words are one shingle; equal texts have equal fingerprints; rows of one doc_id and
one text are one document in the order and each get the result; of different texts with one doc_id, the order is
that of a hash; a null doc_id comes last; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, written

WIDTH, BIN_BITS, LOW_BITS = 5, 7, 8
BINS, BLANK = 1 << BIN_BITS, " \t\n\x0b\x0c\r"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def shingle_hashes(text: Column) -> Column:
    """array<long> of the hashes of a text's shingles; empty without words."""
    words = F.transform(F.split(F.btrim(text, F.lit(BLANK)), SPACE), lambda w: F.xxhash64(w))
    windows = lambda h: F.when(F.size(h) < WIDTH, F.array(F.xxhash64(h))).otherwise(F.transform(F.sequence(F.lit(1), F.size(h) - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(h, i, WIDTH))))
    return F.when(F.btrim(text, F.lit(BLANK)) == "", F.array().cast("array<bigint>")).otherwise(let(words, windows))


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def low_bits(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int")


def densified(least: Column) -> Column:
    """The low bits of all bins, from the least hashes of the bins that have any."""

    def borrowed(b: Column) -> Column:
        rank = lambda h: F.xxhash64(b, bin_of(h)).bitwiseAND(F.lit(-(1 << LOW_BITS))).bitwiseOR(low_bits(h).cast("bigint"))
        return low_bits(F.array_min(F.transform(least, rank)))

    own = F.map_from_arrays(F.transform(least, bin_of), F.transform(least, low_bits))
    some = let(own, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at(m, b), borrowed(b))))
    # of a full set, the hashes are in the signed order: the upper half of the bins comes first
    full = F.concat(F.slice(least, BINS // 2 + 1, BINS // 2), F.slice(least, 1, BINS // 2))
    return F.when(F.size(least) == 0, F.array().cast("array<int>")).when(F.size(least) == BINS, F.transform(full, low_bits)).otherwise(some)


def fingerprint(text: Column) -> Column:
    """array<tinyint> of 128 bins (8 bits each); empty without words."""
    least = let(F.sort_array(shingle_hashes(text)), lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))
    return F.transform(let(least, densified), lambda x: (x - F.when(x > 127, 256).otherwise(0)).cast("tinyint"))


def packed(bins: Column) -> Column:
    """Hex digits of a fingerprint, two a bin."""
    return F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(F.pmod(x.cast("int"), F.lit(256)))), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 1 / (1 << LOW_BITS)
    either = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(either, (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def neighbours(keys: DataFrame) -> DataFrame:
    """Adds next_id and next_th to the distinct (doc_id, th) rows: the next in descending doc_id, after the last the first.

    The order is cut into ranges; a window runs inside each, and the ranges' first rows, one a range, link them up.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("th").asc()]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the cut comes from a sample, so it is written once for both uses
    ranged = written(keys.sparkSession, keys.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("pid").orderBy(*order)
    near = ranged.withColumn("ahead", F.lead(F.struct("doc_id", "th")).over(inside)).withColumn("is_first", F.row_number().over(inside) == 1)
    firsts = near.where("is_first").select(F.col("pid").alias("f_pid"), F.struct("doc_id", "th").alias("first"))
    by_range = W.orderBy("f_pid")
    after = firsts.select("f_pid", F.coalesce(F.lead("first").over(by_range), F.first("first").over(by_range.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    linked = near.join(F.broadcast(after), F.col("pid") == F.col("f_pid")).withColumn("next", F.coalesce("ahead", "after"))
    return linked.select(*keys.columns, F.col("next.doc_id").alias("next_id"), F.col("next.th").alias("next_th"))


def on(left: DataFrame, right: DataFrame, ids: tuple[str, str], ths: tuple[str, str]) -> Column:
    return (left[ths[0]] == right[ths[1]]) & left[ids[0]].eqNullSafe(right[ids[1]])


def op7_fingerprint(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    keys = rows.select("doc_id", "th", F.length("text").alias("n")).groupBy("doc_id", "th").agg(F.max("n").alias("n"))
    order = written(spark, neighbours(keys), "order")
    # the start of each text that its predecessor needs goes to the predecessor
    needs = order.select(F.col("next_id").alias("k_id"), F.col("next_th").alias("k_th"), F.col("doc_id").alias("to_id"), F.col("th").alias("to_th"), F.floor(F.col("n") / 3).cast("int").alias("m"))
    starts = rows.join(needs, on(rows, needs, ("doc_id", "k_id"), ("th", "k_th"))).select("to_id", "to_th", "m", F.substring("text", F.lit(1), F.col("m")).alias("start"))
    starts = starts.groupBy("to_id", "to_th").agg(F.first("m").alias("m"), F.first("start").alias("start"))
    both = rows.join(starts, on(rows, starts, ("doc_id", "to_id"), ("th", "to_th")))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("m")), F.col("start"))
    both = both.select("doc_id", "th", "text", edited.alias("edited"))
    made = both.select("doc_id", "th", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("bins"), fingerprint(F.col("edited")).alias("edited_bins"))
    made = written(spark, made, "fingerprints")
    other = made.select(F.col("doc_id").alias("o_id"), F.col("th").alias("o_th"), F.col("bins").alias("next_bins")).dropDuplicates(["o_id", "o_th"])
    step = order.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "next_id", "next_th")
    nexts = step.join(other, on(step, other, ("next_id", "o_id"), ("next_th", "o_th"))).select("s_id", "s_th", "next_bins")
    out = made.join(nexts, on(made, nexts, ("doc_id", "s_id"), ("th", "s_th")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
