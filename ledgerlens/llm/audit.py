"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

Every document gets five failure flags. Documents with equal flags, part and labels are counted together, and a CUBE over
the flags (by part) gives, for each of the 32 subsets of filters, the row in which all flags of the subset are false: the
documents that survive the subset. Survivors don't depend on an order, so every step of every order is a pair of subsets,
the one before the step and the one after it; a join of the steps with both gives all counts.

The filters, over words `[^\\x20\\x09-\\x0D]+`: A: few words; B: few distinct words; C: many capitals; D: marks; E: the same
text as a document of smaller doc_id, in any part, removed or not.

Repeated rows meet in an aggregation with partial sums before anything is joined, and texts meet by SHA-256, with one row a
text, part and label: large groups of copies are counted where they are read. What the CUBE reads is bounded by the number
of parts (128 rows a part), and so is all that follows.

Cases: null text counts as empty (fails A alone, or A and E); a null or empty source is the part ''; rows of a null doc_id
neither have nor are earlier copies, and have no labels; repeated rows count each, and as they share a doc_id are no copies
of each other; a document of several label rows has a label if any row says so; other columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, written
from .fingerprint import BLANK, let

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_OF_100, CAPITALS_OF_100, MARKS = 200, 50, 2, "[#$%&*|]"
COUNTS = ("docs", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The flags that a text alone decides."""
    words = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))
    trimmed = F.btrim(text, F.lit(BLANK))
    sizes = F.when(trimmed == "", F.struct(F.lit(0).alias("n"), F.lit(0).alias("d"))).otherwise(let(F.split(trimmed, SPACE), words))
    return {"sizes": sizes, "fail_c": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * CAPITALS_OF_100, "fail_d": text.rlike(MARKS)}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fail_a ... fail_e, docs, good, toxic): counts of documents by part and flags."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("th"), *(c.alias(n) for n, c in text_flags(text).items()))
    own = own.withColumn("fail_a", F.col("sizes.n") < LEAST_WORDS).withColumn("fail_b", 100 * F.col("sizes.d") < DISTINCT_OF_100 * F.col("sizes.n")).drop("sizes")
    flags = ["fail_a", "fail_b", "fail_c", "fail_d"]
    rows = own.groupBy("doc_id", "part", "th", *flags).agg(F.count(F.lit(1)).alias("docs"))
    known = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy("doc_id")
    known = known.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("q"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("t"))
    rows = rows.join(known, "doc_id", "left").withColumns({"q": F.coalesce("q", F.lit(0)), "t": F.coalesce("t", F.lit(0))})
    # one row a text, part and label, with its least doc_id and the rows that have it
    texts = rows.groupBy("th", "part", *flags, "q", "t", F.col("doc_id").isNull().alias("no_id")).agg(F.sum("docs").alias("n"), F.min("doc_id").alias("first_id"), F.min_by("docs", "doc_id").alias("n_first"))
    earliest = F.min("first_id").over(W.partitionBy("th"))
    texts = texts.withColumn("kept_e", F.when(F.col("no_id"), F.col("n")).when(F.col("first_id") == earliest, F.col("n_first")).otherwise(F.lit(0)))
    both = F.explode(F.array(F.struct(F.lit(False).alias("fail_e"), F.col("kept_e").alias("n")), F.struct(F.lit(True).alias("fail_e"), (F.col("n") - F.col("kept_e")).alias("n"))))
    split = texts.select("part", *flags, "q", "t", both.alias("x")).where("x.n > 0")
    return split.groupBy("part", *flags, F.col("x.fail_e").alias("fail_e")).agg(F.sum("x.n").alias("docs"), F.sum(F.col("x.n") * F.col("q")).alias("good"), F.sum(F.col("x.n") * F.col("t")).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, docs, good, toxic) for all 32 subsets of filters (bit i is filter i): what survives the subset."""
    names = [f"fail_{f.lower()}" for f in FILTERS]
    cubed = counts.cube("part", *names).agg(F.grouping("part").alias("all_parts"), *(F.grouping(n).alias(f"over_{n}") for n in names), *(F.sum(c).alias(c) for c in COUNTS))
    # a flag that is summed over is null, one of the subset is false
    passed = cubed.where(F.col("all_parts") == 0).where(" and ".join(f"coalesce({n}, false) = false" for n in names))
    subset = sum((((1 - F.col(f"over_{n}")).cast("int") * (1 << i)) for i, n in enumerate(names)), F.lit(0))
    found = passed.select("part", subset.alias("subset"), *COUNTS)
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"))
    return grid.join(found, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, none, before, after, alone, others, every): 600 rows, the subsets that each step compares."""
    rows, every = [], (1 << len(FILTERS)) - 1
    for order in permutations(range(len(FILTERS))):
        for i, f in enumerate(order):
            before = sum(1 << g for g in order[:i])
            rows.append(("".join(FILTERS[g] for g in order), i + 1, 0, before, before | 1 << f, 1 << f, every - (1 << f), every))
    return spark.createDataFrame(rows, "filter_order string, step int, none int, before int, after int, alone int, others int, every int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step, zeros included."""
    spark = docs.sparkSession
    # few rows a part, read by several branches
    left = written(spark, survivors(written(spark, flagged(docs, labels), "flag-counts")), "survivors")
    out = F.broadcast(steps(spark))
    for name in ("before", "after", "none", "alone", "others", "every"):
        of = left.select("part", F.col("subset").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in COUNTS))
        out = out.join(of, [name] if name == "before" else ["part", name])
    removed = F.col("before_docs") - F.col("after_docs")
    out = out.withColumn("removed", removed).withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "alone")))
    return out.select(
        "part", "filter_order", "step", F.col("after_docs").alias("kept"), "removed", (F.col("none_docs") - F.col("alone_docs") - F.col("removed")).alias("redundant"),
        (F.col("others_docs") - F.col("every_docs")).alias("unique_fails"), (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )


def op11_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


OP11_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT *, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask FROM f),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT v.k || w.k || x.k || y.k || z.k AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM k v, k w, k x, k y, k z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o),
t AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM s),
r AS (
  SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost
  FROM g, t GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
