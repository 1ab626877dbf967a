"""Time splits, filters, projections and set operations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quantile_split(df: DataFrame, t: str = "t_us", qs: tuple[float, float] = (0.70, 0.85), exact: bool = True) -> DataFrame:
    """Adds `split`: train up to the first quantile of time, val up to the second, oot after. The two quantiles are found when
    the plan is built and stand in it as numbers, however often the split rows are read. `exact=False` takes sketched ones."""
    from .stats import quantiles

    if exact:
        at = quantiles(df, t, qs).select("quantiles").first()[0]
    else:
        at = df.agg(F.percentile_approx(t, F.array(*map(F.lit, qs)), 100_000)).first()[0]
    first, second = at or (None, None)
    return df.withColumn("split", F.when(F.col(t) <= F.lit(first), "train").when(F.col(t) <= F.lit(second), "val").otherwise("oot"))


def step_split(df: DataFrame, step: str, last_train: int = 500, last_val: int = 600) -> DataFrame:
    return df.withColumn("split", F.when(F.col(step) <= last_train, "train").when(F.col(step) <= last_val, "val").otherwise("oot"))


def calendar_split(df: DataFrame, time: str, val_from: str, oot_from: str) -> DataFrame:
    at = lambda s: F.lit(s).cast(df.schema[time].dataType)
    return df.withColumn("split", F.when(F.col(time) < at(val_from), "train").when(F.col(time) < at(oot_from), "val").otherwise("oot"))


def date_range(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Closed at both ends."""
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def segment(df: DataFrame, predicate: str = "1=1") -> DataFrame:
    return df.where(F.expr(predicate))


def class_balance(df: DataFrame, label: str = "label", by: str = "split") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("rate"), F.sum(1 - F.col(label)).alias("negatives"))


def column_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, n_unique, null_rate). Exact numbers of distinct values come from one unpivot to (number of the column, value as
    text) and two aggregations, the first with partial sums where rows are read: rows aren't copied once a column for each
    distinct count. NaN counts as a value."""
    columns = columns or df.columns
    numbers = df.sparkSession.createDataFrame(list(enumerate(columns)), "cp_i int, column string")
    rows = df.agg(F.count(F.lit(1)).alias("cp_n"))
    if exact:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("cp_i"), F.col(f"`{c}`").cast("string").alias("cp_v")) for i, c in enumerate(columns)))).alias("x")).select("x.*")
        counts = long.groupBy("cp_i", "cp_v").agg(F.count(F.lit(1)).alias("cp_k"))
        per = counts.groupBy("cp_i").agg(F.count("cp_v").alias("n_unique"), F.sum(F.when(F.col("cp_v").isNull(), F.col("cp_k")).otherwise(0)).alias("cp_null"))
    else:
        one = df.agg(*(x for i, c in enumerate(columns) for x in (F.approx_count_distinct(F.col(f"`{c}`")).alias(f"u{i}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"))))
        per = one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("cp_i"), F.col(f"u{i}").alias("n_unique"), F.col(f"n{i}").alias("cp_null")) for i in range(len(columns))))).alias("r")).select("r.*")
    both = F.broadcast(numbers).join(per, "cp_i", "left").crossJoin(F.broadcast(rows))
    return both.select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), (F.col("cp_null") / F.when(F.col("cp_n") > 0, F.col("cp_n"))).alias("null_rate"))


def uninformative(profile: DataFrame, null_rate: float = 0.99, few: int = 5) -> list[str]:
    """Columns with one value at most, or nearly all null with few values. One row a column comes to the driver."""
    return [r["column"] for r in profile.where((F.col("n_unique") <= 1) | ((F.col("null_rate") > null_rate) & (F.col("n_unique") <= few))).select("column").collect()]


def mostly_null(profile: DataFrame, null_rate: float = 0.50) -> list[str]:
    return [r["column"] for r in profile.where(F.col("null_rate") > null_rate).select("column").collect()]


def without_derived(df: DataFrame, prefixes: str = "VCDM") -> DataFrame:
    """Drops columns whose name is one of the letters and digits only."""
    return df.drop(*(c for c in df.columns if re.fullmatch(rf"[{prefixes}]\d+", c)))


def fill_numeric(df: DataFrame, value: float = -1.0) -> DataFrame:
    from ..schema import numeric_columns

    return df.na.fill(value, subset=numeric_columns(df)) if numeric_columns(df) else df


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """`greatest` and `least` skip nulls; here null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in the order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_first", F.row_number().over(w)).where("rn_first = 1").drop("rn_first")


def last_n(df: DataFrame, n: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first n rows in `order` (give it descending) for each `by` key, or of all rows."""
    if not by:
        return df.orderBy(*order).limit(n)
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn_last", F.row_number().over(w)).where(F.col("rn_last") <= n).drop("rn_last")


def schema_difference(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    return sorted(set(a.columns) - set(b.columns)), sorted(set(b.columns) - set(a.columns))


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
