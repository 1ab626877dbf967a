"""Mixing sources to target weights by DataFrame functions alone.

Every document gets a hash key; within its source documents are range-sorted by that key, word counts are summed
from the front, and the source is cut at its exact budget. The sort is distributed: the leading hex digits of the
key cut each source into `4096` even ranges, a window sums inside one range, and the ranges' totals (a bounded
number of rows a source) give each range its start. A source with a third of all rows is so spread over all tasks.

Cases: null text has size 0 and is never taken; a null source is a source of its own, after all others; repeated
rows are separate documents; an empty table gives no rows; extra columns pass, whatever their names, but that `mix()`
replaces those it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, whole_row, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
BLANK = " \t\n\x0b\x0c\r"
SHARE, CAP, DIGITS, SEED = 1.5, 2, 3, "mix-1"


def mix_key(seed: str = SEED) -> Column:
    """Hash-random key of a document; the text is part of it, so documents with one id do not tie."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(m_source, source_size, target) from (m_source, m_size): one row a source.

    Filling by weight with a ceiling has a closed form: a source is full exactly if its ceiling a unit of weight is
    at most the common level, so sources are put in the order of that ratio and the first level that fits is taken.
    """
    per = sizes.groupBy("m_source").agg(F.sum("m_size").alias("source_size"))
    by_name = W.orderBy(F.col("m_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("m_w", weight.cast("long"))
    by_ratio = W.orderBy(F.col("source_size") / F.col("m_w"), F.col("m_source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    # level if all sources before this one are full and this and all later ones are not
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap)
    left = F.sum("m_w").over(every) - F.coalesce(F.sum("m_w").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) * F.lit(share) - full) / left
    per = per.withColumn("m_level", level).withColumn("m_ceiling", F.col("source_size") * F.lit(cap))
    open_ = F.col("m_level") * F.col("m_w") < F.col("m_ceiling")
    common = F.min(F.when(open_, F.struct(F.col("source_size") / F.col("m_w"), F.coalesce(F.col("m_source"), F.lit("")), F.col("m_level")))).over(every)["m_level"]
    target = F.when(common.isNull(), F.col("m_ceiling").cast("double")).otherwise(F.least(F.col("m_ceiling").cast("double"), common * F.col("m_w")))
    return per.select("m_source", "source_size", target.alias("target"))


def planned(docs: DataFrame, keep: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(m_row, m_size, source_size, target, taken) of each row of `docs`; m_row is `keep`, in which no name can clash.

    A whole epoch takes all documents; what is left of the budget goes to the front of the key order, where the
    document at the cut gives only the words that still fit.
    """
    keyed = docs.select(keep.alias("m_row"), F.col("source").alias("m_source"), word_count(F.col("text")).alias("m_size"), mix_key(seed).alias("m_key")).withColumn("m_range", F.substring("m_key", 1, DIGITS))
    narrow = docs.select(F.col("source").alias("m_source"), word_count(F.col("text")).alias("m_size"), F.substring(mix_key(seed), 1, DIGITS).alias("m_range"))
    ranges = narrow.groupBy("m_source", "m_range").agg(F.sum("m_size").alias("m_size"))
    starts = F.coalesce(F.sum("m_size").over(W.partitionBy("m_source").orderBy("m_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("m_source", "m_range", "m_size", starts.alias("m_start"))
    plan = ranges.alias("r").join(source_targets(ranges.select("m_source", "m_size"), weights, share, cap).alias("t"), F.col("r.m_source").eqNullSafe(F.col("t.m_source"))).select(
        F.col("r.m_source").alias("p_source"), F.col("r.m_range").alias("p_range"), "m_start", "source_size", "target"
    )
    inside = W.partitionBy("m_source", "m_range").orderBy("m_key").rowsBetween(W.unboundedPreceding, -1)
    ordered = keyed.withColumn("m_before", F.coalesce(F.sum("m_size").over(inside), F.lit(0)))
    joined = ordered.join(plan, F.col("m_source").eqNullSafe(F.col("p_source")) & (F.col("m_range") == F.col("p_range")), "left")
    budget = F.floor(F.col("target") + F.lit(0.5))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("m_start") - F.col("m_before")
    taken = epochs * F.col("m_size") + F.greatest(F.lit(0), F.least(F.col("m_size"), rest))
    return joined.select("m_row", "m_size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """Adds m_size, source_size, target and taken (words the mix takes, repeats counted) to each row of `docs`; columns of
    these names are replaced, all others pass untouched."""
    own = ["m_size", "source_size", "target", "taken"]
    rest = [c for c in docs.columns if c not in own]
    return planned(docs, whole_row(docs, rest), **how).select("m_row.*", *own)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of `docs`, with all their columns, repeated as the budgets say; the document at a cut keeps its
    first words."""
    plan = planned(docs, whole_row(docs), **how).where("taken > 0")
    rows = plan.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("m_size")).cast("int"))))
    fits = F.least(F.col("m_size"), F.col("taken") - (F.col("m_copy") - 1) * F.col("m_size"))
    whole = F.col("m_row.text")
    # blanks in front belong to the first word, not to a slice of their own
    inner = F.ltrim(whole, F.lit(BLANK))
    words = F.slice(F.split(inner, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, fits.cast("int"))
    head = F.concat(F.substring(whole, F.lit(1), F.length(whole) - F.length(inner)), F.array_join(words, ""))
    text = F.when(fits >= F.col("m_size"), whole).otherwise(head)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col("m_row")[c]).alias(c) for c in docs.columns))


def op8_mix(docs: DataFrame) -> DataFrame:
    return planned(docs.select("doc_id", "text", "source"), F.col("doc_id")).select(F.col("m_row").alias("doc_id"), F.col("m_size").alias("size"), "source_size", "target", "taken")


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
             - CAST(coalesce(sum(source_size) OVER o, 0) AS DOUBLE) * 2)
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM w
  WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, CAST(source_size AS DOUBLE) / w) AS level FROM l WHERE level * w < 2 * source_size),
t AS (SELECT l.source, l.source_size, least(CAST(2 * l.source_size AS DOUBLE), coalesce(c.level * l.w, 2 * l.source_size)) AS target
      FROM l LEFT JOIN c ON true),
b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
            + greatest(0, least(size, budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - before)) AS BIGINT) AS taken
FROM b
"""
