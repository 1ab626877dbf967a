"""Frequency, count, target and weight-of-evidence encodings.

A null category is left out of a fit unless `nulls="level"` makes it a level of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiles import lookup

LEVEL = "__NAN__"


def with_levels(df: DataFrame, columns: list[str], nulls: str = "default") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(LEVEL)) for c in columns}) if nulls == "level" else df


def frequency(df: DataFrame, columns: list[str], name: str, nulls: str = "default") -> DataFrame:
    """Share of each (composite) value among the rows where all its columns are known."""
    rows = with_levels(df, columns, nulls).where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("of_all"))
    return counts.crossJoin(F.broadcast(total)).select(*columns, (F.col("n") / F.col("of_all")).alias(name))


def counts(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))


def additive(total: Column, n: Column, prior: Column, m: float = 20.0) -> Column:
    return (total + m * prior) / (n + m)


def sigmoid_blend(total: Column, n: Column, prior: Column, least: float = 20.0, width: float = 10.0) -> Column:
    weight = 1 / (1 + F.exp(-(n - least) / width))
    return weight * total / n + (1 - weight) * prior


def target(df: DataFrame, column: str, label: str, name: str, kind: str = "additive", where: Column | None = None, nulls: str = "default", **shape: float) -> DataFrame:
    """(column, name): smoothed label rate by value, over the rows of `where`, whose own rate is the prior.

    Kinds: additive (also `bayes`, its other form), sigmoid, raw.
    """
    rows = with_levels(df, [column], nulls)
    if where is not None:
        rows = rows.where(where)
    prior = rows.agg(F.avg(label).alias("prior"))
    sums = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count(label).alias("n")).crossJoin(F.broadcast(prior))
    s, n, p = F.col("s"), F.col("n"), F.col("prior")
    made = {"additive": additive, "bayes": additive, "sigmoid": sigmoid_blend, "raw": lambda s, n, p: s / n}[kind](s, n, p, **shape)
    return sums.select(column, made.alias(name))


def global_rate(df: DataFrame, label: str, name: str = "prior", where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).agg(F.avg(label).alias(name))


def out_of_fold(df: DataFrame, row_id: str, column: str, label: str, name: str, folds: int = 5, m: float = 20.0, fold: Column | None = None) -> DataFrame:
    """Each row's rate from the other folds: sums by value less those by value and fold, so two aggregates in all. Folds
    are a hash of the row id unless `fold` says otherwise."""
    rows = df.withColumn("oof_fold", F.pmod(F.xxhash64(F.lit("fold"), row_id), F.lit(folds)) if fold is None else fold)
    by_fold = rows.where(F.col(column).isNotNull()).groupBy(column, "oof_fold").agg(F.sum(F.col(label).cast("double")).alias("s_f"), F.count(label).alias("n_f"))
    whole = by_fold.groupBy(column).agg(F.sum("s_f").alias("s_all"), F.sum("n_f").alias("n_all"))
    prior = df.agg(F.avg(label).alias("prior"))
    out = lookup(lookup(rows, by_fold, [column, "oof_fold"]), whole, column).crossJoin(F.broadcast(prior))
    rest_s, rest_n = F.coalesce(F.col("s_all") - F.col("s_f"), F.lit(0.0)), F.coalesce(F.col("n_all") - F.col("n_f"), F.lit(0))
    return out.withColumn(name, additive(rest_s, rest_n, F.col("prior"), m)).drop("oof_fold", "s_f", "n_f", "s_all", "n_all", "prior")


def weight_of_evidence(df: DataFrame, column: str, label: str, name: str, floor: float = 1e-6) -> DataFrame:
    """ln of the value's share among the positives over its share among the negatives."""
    sums = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    total = sums.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    share = lambda a, b: F.greatest(F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)), F.lit(floor))
    return sums.crossJoin(F.broadcast(total)).select(column, F.log(share("p", "tp") / share("q", "tq")).alias(name))
