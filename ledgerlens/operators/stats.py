"""Statistics by column: information value, stability, AUC, null flags, correlation. All columns in one job.

`long` tables hold (column, value, label). Running sums over a column's values go by range and then within ranges, and
quantiles are found by rank from running counts, so no task sees a whole column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import numeric_columns, text_columns
from ..sources.scratch import written

FLOOR, FEW_VALUES = 1e-6, 200_000


def unpivot(df: DataFrame, columns: list[str], label: str | None = None, kind: str = "double") -> DataFrame:
    rows = df.select(*([F.col(label).cast("int").alias("label")] if label else []), *(F.col(c).cast(kind).alias(c) for c in columns))
    return rows.unpivot(["label"] if label else [], columns, "column", "value")


def prefix_sums(df: DataFrame, value: str, sums: list[str], by: list[str], descending: bool = False) -> DataFrame:
    """Adds `{s}_run`: the sum of s over all rows of the group up to this value (rows must have distinct values).

    Rows are put in order over all tasks once and written, with the number of their range: two steps read them, and
    the bounds of the ranges come from a sample.
    """
    ranged = written(df.sparkSession, df.repartitionByRange(*by, value).withColumn("ps_range", F.spark_partition_id()), "ranges")
    order = F.desc if descending else F.asc
    totals = ranged.groupBy(*by, "ps_range").agg(*(F.sum(s).alias(f"{s}_r") for s in sums))
    earlier = W.partitionBy(*by).orderBy(order("ps_range")).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*by, "ps_range", *(F.coalesce(F.sum(f"{s}_r").over(earlier), F.lit(0)).alias(f"{s}_start") for s in sums))
    inside = W.partitionBy(*by, "ps_range").orderBy(order(value)).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(starts, [*by, "ps_range"])
    return out.withColumns({f"{s}_run": F.sum(s).over(inside) + F.col(f"{s}_start") for s in sums}).drop("ps_range", *(f"{s}_start" for s in sums))


def quantiles(df: DataFrame, value: str, qs: tuple[float, ...], by: list[str] | None = None, most: int = FEW_VALUES, error: float = 1e-4) -> DataFrame:
    """(by, n_known, n_unique, quantiles): exact quantiles of the known values, interpolated between neighbours; `n_unique` is
    exact up to 1,000 and about right above. Without `by` there is one row, also of an empty table.

    A first scan sketches each group's distinct values and the places of its quantiles; this runs when the plan is built.
    Groups of at most `most` distinct values are one aggregation. For larger ones a second scan counts what lies below a
    bracket around each sketched quantile and takes the few values inside; ranks tell the values, and where a bracket
    misses one, it is widened and the scan repeated. Nothing is sorted but the values inside brackets.
    """
    by, spark = by or [], df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("q_value"))
    sketch = rows.groupBy(*by).agg(F.count("q_value").alias("q_n"), F.approx_count_distinct("q_value", 0.02).alias("q_u"))
    if (sketch.agg(F.max("q_u")).first()[0] or 0) <= most:
        counts = rows.groupBy(*by, "q_value").agg(F.count(F.lit(1)).alias("q_k"))
        few = counts.groupBy(*by).agg(F.coalesce(F.sum("q_k"), F.lit(0)).alias("n_known"), F.count("q_value").alias("n_unique"), F.percentile("q_value", F.array(*map(F.lit, qs)), F.col("q_k")).alias("quantiles"))
        # a row a group, which most callers join twice
        return written(spark, few, "quantiles") if by else few
    sketch = written(spark, sketch, "sketch")
    unique = written(spark, _small_counts(rows, sketch, by), "unique")
    every, found = range(len(qs)), None
    while found is None or not found.where(F.exists("q_v", lambda x: x["lo"].isNull() | x["hi"].isNull())).isEmpty():
        marks = F.array(*(F.lit(min(1.0, max(0.0, q + d))) for d in (-error, error) for q in qs))
        cuts = rows.groupBy(*by).agg(F.percentile_approx("q_value", marks, min(10_000_000, int(4 / error))).alias("q_c"))
        wide = error >= 1  # brackets that hold all values
        inside = (lambda i: F.lit(True)) if wide else (lambda i: (F.col("q_value") >= F.col("q_c")[i]) & (F.col("q_value") <= F.col("q_c")[i + len(qs)]))
        both = rows.join(cuts, by) if by else rows.crossJoin(F.broadcast(cuts))
        below = both.groupBy(*by).agg(*((F.lit(0) if wide else F.count_if(F.col("q_value") < F.col("q_c")[i])).cast("long").alias(f"q_b{i}") for i in every))
        near = both.select(*by, "q_value", F.explode(F.filter(F.array(*(F.when(inside(i), i) for i in every)), lambda x: x.isNotNull())).alias("q_i"))
        run = prefix_sums(near.groupBy(*by, "q_i", "q_value").agg(F.count(F.lit(1)).alias("q_k")), "q_value", ["q_k"], [*by, "q_i"])
        total = sketch.join(below, by) if by else sketch.crossJoin(F.broadcast(below))
        placed = run.join(total, by) if by else run.crossJoin(F.broadcast(total))
        before = F.element_at(F.array(*(F.col(f"q_b{i}") for i in every)), F.col("q_i") + 1)
        rank = F.element_at(F.array(*map(F.lit, map(float, qs))), F.col("q_i") + 1) * (F.col("q_n") - 1)
        here = lambda r: F.max(F.when((before + F.col("q_k_run") - F.col("q_k") <= r) & (r < before + F.col("q_k_run")), F.col("q_value")))
        ends = placed.groupBy(*by, "q_i").agg(here(F.floor(rank)).alias("lo"), here(F.ceil(rank)).alias("hi"), F.max(rank - F.floor(rank)).alias("part"))
        one = lambda i: F.max(F.when(F.col("q_i") == i, F.struct("lo", "hi", "part")))
        missing = F.struct(*(F.lit(None).cast("double").alias(n) for n in ("lo", "hi", "part")))
        found = written(spark, ends.groupBy(*by).agg(F.array(*(F.coalesce(one(i), missing) for i in every)).alias("q_v")), "quantiles")
        error *= 16
    value_of = F.transform("q_v", lambda x: F.when(x["lo"] == x["hi"], x["lo"]).otherwise(x["lo"] * (1 - x["part"]) + x["hi"] * x["part"]))
    out = unique.join(found, by) if by else unique.crossJoin(F.broadcast(found))
    return out.select(*by, F.col("q_n").alias("n_known"), F.col("q_u").alias("n_unique"), value_of.alias("quantiles"))


def _small_counts(rows: DataFrame, sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketch with exact numbers of distinct values for the groups that have up to about 1,000."""
    few = sketch.where("q_u < 1100")
    own = rows.join(few.select(*by), by, "left_semi") if by else rows.crossJoin(F.broadcast(few.select(F.lit(1).alias("q_one"))))
    exact = own.groupBy(*by, "q_value").agg(F.lit(1).alias("q_x")).groupBy(*by).agg(F.count("q_x").alias("q_exact"))
    both = sketch.join(exact, by, "left") if by else sketch.crossJoin(F.broadcast(exact))
    return both.select(*by, "q_n", F.when((F.col("q_u") < 1100) & F.col("q_exact").isNotNull(), F.col("q_exact")).otherwise(F.col("q_u")).alias("q_u"))


def auc(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(column, auc): Mann-Whitney with half credit for ties; null without both classes. Null values are left out."""
    by = by or ["column"]
    counts = long.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum((1 - F.col("label")).cast("long")).alias("q"))
    run = prefix_sums(counts, "value", ["q"], by)
    whole = run.groupBy(*by).agg(F.sum(F.col("p") * (F.col("q_run") - F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return whole.select(*by, (F.col("u") / F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("np").cast("double") * F.col("nq"))).alias("auc"))


def safe_auc(a: Column) -> Column:
    return F.greatest(F.coalesce(a, F.lit(0.5)), 1 - F.coalesce(a, F.lit(0.5)))


def interior_edges(long: DataFrame, bins: int, exact: bool = True) -> DataFrame:
    """(column, n_unique, n_known, edges): distinct quantiles without the outer two."""
    qs = tuple(i / bins for i in range(bins + 1))
    if exact:
        cut = quantiles(long, "value", qs, ["column"])
    else:
        cut = long.where(F.col("value").isNotNull()).groupBy("column").agg(F.percentile_approx("value", F.array(*map(F.lit, qs)), 10_000).alias("quantiles"), F.approx_count_distinct("value").alias("n_unique"), F.count("value").alias("n_known"))
    q = F.array_distinct(F.col("quantiles"))
    return cut.select("column", "n_unique", "n_known", F.slice(q, 2, F.greatest(F.size(q) - 2, F.lit(0))).alias("edges"))


def _iv(bins: DataFrame) -> DataFrame:
    """(column, iv) from (column, bin, p, q)."""
    total = bins.groupBy("column").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    share = lambda a, b: F.greatest(F.col(a) / F.col(b), F.lit(FLOOR))
    good, bad = share("q", "tq"), share("p", "tp")
    one = bins.join(total, "column").where("tp > 0 AND tq > 0").groupBy("column").agg(F.sum((good - bad) * F.log(good / bad)).alias("iv"))
    return total.select("column").join(one, "column", "left").select("column", F.coalesce("iv", F.lit(0.0)).alias("iv"))


def information_value(df: DataFrame, label: str, columns: list[str] | None = None, bins: int = 10, least: int = 0, exact: bool = True) -> DataFrame:
    """(column, iv): each of at most `bins` distinct values is a bin, else quantile bins closed on the left. Columns
    with fewer than `least` known rows get 0."""
    columns = columns or numeric_columns(df, without=(label,))
    long = unpivot(df, columns, label).where(F.col("value").isNotNull())
    edged = long.join(F.broadcast(interior_edges(long, bins, exact)), "column")
    at = F.when(F.col("n_unique") <= bins, F.col("value")).otherwise(F.size(F.filter("edges", lambda e: e <= F.col("value"))).cast("double"))
    counts = edged.groupBy("column", at.alias("bin"), "n_known").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    iv = _iv(counts.where(F.col("n_known") >= least).select("column", "bin", "p", "q"))
    return _all(df, columns).join(iv, "column", "left").select("column", F.coalesce("iv", F.lit(0.0)).alias("iv"))


def categorical_iv(df: DataFrame, label: str, columns: list[str] | None = None, least: int = 50) -> DataFrame:
    """(column, iv) with a bin for each level."""
    columns = columns or text_columns(df)
    long = unpivot(df, columns, label, "string").where(F.col("value").isNotNull())
    counts = long.groupBy("column", F.col("value").alias("bin")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    known = counts.groupBy("column").agg(F.sum(F.col("p") + F.col("q")).alias("n")).where(F.col("n") >= least).select("column")
    return _all(df, columns).join(_iv(counts.join(known, "column")), "column", "left").select("column", F.coalesce("iv", F.lit(0.0)).alias("iv"))


def _all(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in columns], "column string")


def iv_grade(iv: Column, n_unique: Column | None = None) -> Column:
    high = F.when((iv > 0.5) & (n_unique > 50), "high_card") if n_unique is not None else F.when(F.lit(False), "")
    return high.when(iv > 0.5, "LEAK?").when(iv > 0.3, "strong").when(iv > 0.1, "medium").when(iv > 0.02, "weak").otherwise("none")


def psi(expected: DataFrame, actual: DataFrame, columns: list[str], bins: int = 10, exact: bool = True) -> DataFrame:
    """(column, psi): bins are quantiles of the expected values, open at both ends; a constant or empty column has 0."""
    a, b = unpivot(expected, columns).where("value IS NOT NULL"), unpivot(actual, columns).where("value IS NOT NULL")
    edges = interior_edges(a, bins, exact).select("column", "edges")
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).join(F.broadcast(edges), "column")
    counts = both.groupBy("column", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("bin")).agg(F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1).alias("a"))
    # every bin of the expected side is there; one that only the actual side reaches is too
    total = counts.groupBy("column").agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    e, x = F.greatest(F.col("e") / F.col("te"), F.lit(FLOOR)), F.greatest(F.col("a") / F.col("ta"), F.lit(FLOOR))
    out = counts.join(total, "column").where("te > 0 AND ta > 0").groupBy("column").agg(F.sum((x - e) * F.log(x / e)).alias("psi"))
    return _all(expected, columns).join(out, "column", "left").select("column", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def psi_grade(p: Column) -> Column:
    return F.when(p > 0.25, "SHIFT!").when(p > 0.1, "moderate").otherwise("stable")


def null_flag_auc(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(column, null_rate, null_auc): how well being null predicts the label, from four counts; 0.5 if rarely or nearly
    always null."""
    y = F.col(label)
    one = df.agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"), F.count(F.lit(1)).alias("n"), *(x for i, c in enumerate(columns) for x in (F.sum(F.when(F.col(c).isNull(), y).otherwise(0)).alias(f"p{i}"), F.count_if(F.col(c).isNull()).alias(f"n{i}"))))
    row = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("pn"), F.col(f"n{i}").alias("nn")) for i, c in enumerate(columns)))).alias("r")
    rate = F.col("nn") / F.col("n")
    a = (1 + F.col("pn") / F.col("p") - (F.col("nn") - F.col("pn")) / F.col("q")) / 2
    made = F.when((rate > 0.001) & (rate < 0.999) & (F.col("p") > 0) & (F.col("q") > 0), safe_auc(a)).otherwise(0.5)
    return one.select("p", "q", "n", row).select("p", "q", "n", "r.*").select("column", rate.alias("null_rate"), made.alias("null_auc"))


def univariate_auc(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(column, auc) after filling nulls with the median, on the better side of 0.5."""
    long = unpivot(df, columns, label)
    mid = quantiles(long, "value", (0.5,), ["column"]).select("column", F.col("quantiles")[0].alias("mid"))
    filled = long.join(F.broadcast(mid), "column", "left").select("column", "label", F.coalesce("value", "mid").alias("value"))
    return _all(df, columns).join(auc(filled), "column", "left").select("column", safe_auc(F.col("auc")).alias("auc"))


def pair_sums(df: DataFrame, columns: list[str], shift: list[float], fan: int = 32) -> DataFrame:
    """(i, n, s, q, p): for each column i, arrays over columns j of: rows where both are known, sums and sums of squares of i
    over them, sums of products of i and j; values are taken less `shift`.

    Tasks multiply blocks of rows with their null masks; a row of arrays a column leaves each task, and is added up in two
    steps, so no task sees more than a share of the tasks' rows.
    """
    rows = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    width, middle = len(columns), np.array(shift)
    names, kind = ("n", "s", "q", "p"), "i int, part int, n array<double>, s array<double>, q array<double>, p array<double>"

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((4, width, width)), 0
        for batch in batches:
            seen += batch.num_rows
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)], 1) - middle
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0), known.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        if seen:
            part = TaskContext.get().partitionId() % fan
            lists = [pa.array(list(t), pa.list_(pa.float64())) for t in total]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, part, np.int32)), *lists], ["i", "part", *names])

    def add(table: pa.Table) -> pa.Table:
        sums = [pa.array([np.sum(table.column(c).to_pylist(), axis=0)], pa.list_(pa.float64())) for c in names]
        return pa.table([table.column("i").slice(0, 1), table.column("part").slice(0, 1), *sums], ["i", "part", *names])

    parts = rows.mapInArrow(block, kind).groupBy("i", "part").applyInArrow(add, kind)
    return parts.groupBy("i").applyInArrow(add, kind).drop("part")


def correlation_flags(df: DataFrame, columns: list[str] | None = None, least: float = 0.98) -> DataFrame:
    """(a, b, corr): pairs of columns whose absolute correlation (over rows where both are known) is high. One scan for the
    columns' means, which keep sums small, and one for all pairs; the plan doesn't grow with the pairs. A pair of which one
    side doesn't vary is left out; NaN counts as null."""
    columns = columns or numeric_columns(df)
    known = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns))
    means = known.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(columns))).first()
    sums = pair_sums(known, columns, list(means))
    # `columns` squared numbers: each pair's two halves meet by number
    one = sums.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "p")).alias("j", "x")).select("i", "j", "x.*")
    low, high = one.where("i < j"), one.where("i > j").select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("t"), F.col("q").alias("r"))
    both = low.join(high, ["i", "j"])
    vx, vy = F.col("n") * F.col("q") - F.col("s") * F.col("s"), F.col("n") * F.col("r") - F.col("t") * F.col("t")
    varied = (vx > 1e-12 * F.col("n") * F.col("q")) & (vy > 1e-12 * F.col("n") * F.col("r"))
    corr = F.round(F.abs((F.col("n") * F.col("p") - F.col("s") * F.col("t")) / F.sqrt(vx) / F.sqrt(vy)), 4)
    names = F.array(*map(F.lit, columns))
    out = both.where(varied).select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), corr.alias("corr"))
    return out.where(F.col("corr") >= least).orderBy(F.desc("corr"), "a", "b")


def analyze(df: DataFrame, label: str, without: tuple[str, ...] = ()) -> DataFrame:
    """One row a column: null rate, distinct values, IV and its grade, AUC of the values and of the null flag."""
    from .splits import column_profile

    numbers, texts = numeric_columns(df, without=(label, *without)), text_columns(df, without=without)
    columns = numbers + texts
    iv = information_value(df, label, numbers, least=50)
    if texts:
        iv = iv.unionByName(categorical_iv(df, label, texts))
    out = column_profile(df, columns).select("column", "n_unique").join(null_flag_auc(df, label, columns), "column").join(iv, "column")
    out = out.join(univariate_auc(df, label, numbers), "column", "left").withColumn("auc", F.coalesce("auc", F.lit(0.5)))
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("column", "n_unique", r("null_rate"), r("iv"), iv_grade(F.col("iv"), F.col("n_unique")).alias("grade"), r("auc"), r("null_auc")).orderBy(F.desc(F.greatest("iv", 2 * (F.col("null_auc") - 0.5))), "column")


def analyze_features(train: DataFrame, other: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(column, iv, iv_grade, psi, psi_grade) by falling IV."""
    both = information_value(train, label, columns).join(psi(train, other, columns), "column")
    return both.select("column", "iv", iv_grade(F.col("iv")).alias("iv_grade"), "psi", psi_grade(F.col("psi")).alias("psi_grade")).orderBy(F.desc("iv"), "column")
