"""Group profiles fitted on history and looked up by row.

All statistics of one entity come from one aggregation and reach the rows through one join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import PART_ROWS, dealt, scan


def entity_profile(df: DataFrame, key: str, value: str, stats: Iterable[str] = ("mean", "std", "count"), prefix: str = "", std_default: float | None = 0.0, min_support: int = 1) -> DataFrame:
    """One row a non-null key. Statistics: mean std min max median p90 q25 q75 count sum span; a single row's deviation
    is `std_default`; keys under `min_support` rows are left out."""
    v = F.col(value)
    known = {
        "mean": F.avg(v), "std": F.coalesce(F.stddev_samp(v), F.lit(std_default)) if std_default is not None else F.stddev_samp(v), "min": F.min(v), "max": F.max(v), "median": F.median(v),
        "p90": F.percentile(v, F.lit(0.9)), "q25": F.percentile(v, F.lit(0.25)), "q75": F.percentile(v, F.lit(0.75)), "count": F.count(v), "sum": F.sum(v), "span": F.max(v) - F.min(v),
    }
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("support_n"), *(known[s].alias(prefix + s) for s in stats))
    return out.where(F.col("support_n") >= min_support).drop("support_n")


def distinct_profile(df: DataFrame, key: str, attributes: dict[str, str], exact: bool = True) -> DataFrame:
    """Distinct non-null values of each attribute by key: {output name: attribute}."""
    count = F.count_distinct if exact else F.approx_count_distinct
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(count(F.col(a)).alias(n) for n, a in attributes.items()))


def mode_profile(df: DataFrame, key: str, attribute: str, name: str, missing: Any = "__NAN__") -> DataFrame:
    """Most frequent non-null value, the smallest of equals, in two aggregations: no group is held in one place."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key, attribute).agg(F.count(attribute).alias("n"))
    best = counts.groupBy(key).agg(F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), F.col(attribute).alias("v")))).alias("b"))
    return best.select(key, F.coalesce(F.col("b.v"), F.lit(missing)).alias(name))


def first_profile(df: DataFrame, key: str, values: list[str], order: list[str], prefix: str = "home_") -> DataFrame:
    """First non-null value of each column in the order."""
    at = F.struct(*order)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(prefix + v) for v in values))


def last_profile(df: DataFrame, key: str, value: str, order: list[str], name: str = "last") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(name))


def centroid_profile(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.median(lat).alias("centroid_lat"), F.median(lon).alias("centroid_lon"))


def lookup(df: DataFrame, profile: DataFrame, key: str | list[str], defaults: dict[str, Any] | None = None, null_safe: bool = False) -> DataFrame:
    """Left join of a profile by key, with defaults where it has none; whether it is broadcast is left to its size.

    A default may be a value or a column. `null_safe` also matches null keys.
    """
    keys = [key] if isinstance(key, str) else list(key)
    right = profile.select(*(F.col(k).alias(f"lk_{i}") for i, k in enumerate(keys)), *(c for c in profile.columns if c not in keys))
    same = lambda a, b: a.eqNullSafe(b) if null_safe else a == b
    on = [same(df[k], right[f"lk_{i}"]) for i, k in enumerate(keys)]
    out = df.join(right, on, "left").drop(*(f"lk_{i}" for i in range(len(keys))))
    fill = {c: d if isinstance(d, Column) else F.lit(d) for c, d in (defaults or {}).items()}
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in fill.items()}) if fill else out


def star(df: DataFrame, sides: list[tuple[DataFrame, str | list[str]]]) -> DataFrame:
    """Left joins of several side tables, one after the other."""
    for side, key in sides:
        df = lookup(df, side, key)
    return df


def novelty_flag(df: DataFrame, known: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1 where the pair isn't among the known ones; a null key is never known."""
    pairs = known.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys).distinct().withColumn("seen_before", F.lit(1))
    return lookup(df, pairs, keys).withColumn(name, F.col("seen_before").isNull().cast("int")).drop("seen_before")


def gap_stats(df: DataFrame, key: str, t: str, row_id: str, burst_s: int = 60, most: int = PART_ROWS) -> DataFrame:
    """Median, deviation, minimum of the seconds between a key's rows, gaps under `burst_s`, and gaps a day."""
    known = df.where(F.col(key).isNotNull()).select(*dict.fromkeys((key, t, row_id)))
    rows = scan(dealt(known, key, [t, row_id], most), {"sc_prev": ("lag", F.col(t))}).plain()
    gaps = rows.select(key, t, ((F.col(t) - F.col("sc_prev")) / 1e6).alias("gap"))
    days = F.greatest((F.max(t) - F.min(t)) / 86_400e6, F.lit(1.0))
    return gaps.groupBy(key).agg(
        F.coalesce(F.median("gap"), F.lit(0.0)).alias("median_gap"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("std_gap"), F.coalesce(F.min("gap"), F.lit(0.0)).alias("min_gap"),
        F.count_if(F.col("gap") < burst_s).alias("burst"), (F.count("gap") / days).alias("daily_rate"),
    )


def daily_counts(df: DataFrame, key: str, t: str) -> DataFrame:
    """Mean and deviation of an entity's rows a day, over days with any."""
    per_day = df.groupBy(key, F.floor(F.col(t) / 86_400_000_000).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy(key).agg(F.avg("n").alias("mean_daily"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std_daily"))


def rfm(df: DataFrame, key: str, t: str, amount: str) -> DataFrame:
    """Recency (days to the latest time of all rows), frequency, monetary mean."""
    end = df.agg(F.max(t).alias("t_end"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(t).alias("t_last"), F.count(F.lit(1)).alias("frequency"), F.avg(amount).alias("monetary")).crossJoin(F.broadcast(end)).select(key, ((F.col("t_end") - F.col("t_last")) / 86_400e6).alias("recency"), "frequency", "monetary")


def circular_profile(df: DataFrame, key: str, hour: Column) -> DataFrame:
    """Mean direction of the hours and how concentrated they are (0 to 1)."""
    angle = hour * (2 * math.pi / 24)
    s, c = F.avg(F.sin(angle)), F.avg(F.cos(angle))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(s.alias("mean_sin"), c.alias("mean_cos"), F.sqrt(s * s + c * c).alias("concentration"), F.atan2(s, c).alias("mean_angle"))


def sharing(df: DataFrame, attribute: str, entity: str, name: str) -> DataFrame:
    """How many entities share each value of an attribute."""
    return df.where(F.col(attribute).isNotNull()).groupBy(attribute).agg(F.count_distinct(entity).alias(name))


def corridor(df: DataFrame, keys: list[str], amount: str, label: str | None = None) -> DataFrame:
    """Count, mean, quartiles and their band (and the label's rate) by a composite key."""
    q1, q3 = F.percentile(amount, F.lit(0.25)), F.percentile(amount, F.lit(0.75))
    rate = [F.avg(label).alias("rate")] if label else []
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(amount).alias("mean"), F.median(amount).alias("median"), (q1 - 1.5 * (q3 - q1)).alias("low"), (q3 + 1.5 * (q3 - q1)).alias("high"), *rate)


def failure_rate(df: DataFrame, key: str, failed: Column) -> DataFrame:
    return df.groupBy(key).agg((F.count_if(failed) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("failure_rate"))


def dispute_ratios(df: DataFrame, key: str, t: str, amount: str, disputed: Column) -> DataFrame:
    """Share of an entity's rows that were disputed, of their amounts, and days from its last dispute to its last row
    (null without one)."""
    total = F.sum(amount)
    last = F.max(F.when(disputed, F.col(t)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        (F.count_if(disputed) / F.count(F.lit(1))).alias("dispute_rate"), (F.coalesce(F.sum(F.when(disputed, F.col(amount))), F.lit(0.0)) / F.when(total != 0, total)).alias("dispute_amount_ratio"),
        ((F.max(t) - last) / 86_400e6).alias("days_since_dispute"),
    )


def high_rate_flag(df: DataFrame, history: DataFrame, value: str, name: str = "is_high_velocity", q: float = 0.95) -> DataFrame:
    """1 above the quantile that the training history sets (not the rows' own split)."""
    from .stats import quantiles

    cut = quantiles(history, value, (q,)).select(F.col("quantiles")[0].alias("high_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(name, F.coalesce((F.col(value) > F.col("high_cut")).cast("int"), F.lit(0))).drop("high_cut")


def trajectory(df: DataFrame, key: str, t: str, row_id: str, amount: str, most: int = PART_ROWS) -> DataFrame:
    """Slope, variance, largest jump of an entity's log amounts in order, and its last five against the rest."""
    known = df.select(F.col(key).alias("tr_key"), F.col(t).alias("tr_t"), F.col(row_id).alias("tr_id"), F.log1p(F.col(amount)).alias("x"))
    rows = scan(dealt(known, "tr_key", ["tr_t", "tr_id"], most), {"rn": ("count", F.lit(1)), "sc_x": ("lag", F.col("x"))}).plain()
    rows = lookup(rows, known.groupBy("tr_key").agg(F.count(F.lit(1)).alias("n")), "tr_key", null_safe=True)
    rows = rows.select(F.col("tr_key").alias(key), "x", "rn", (F.col("n") - F.col("rn") + 1).alias("back"), (F.col("x") - F.col("sc_x")).alias("jump"))
    recent, rest = F.max(F.when(F.col("back") <= 5, F.col("x"))), F.avg(F.when(F.col("back") > 5, F.col("x")))
    return rows.groupBy(key).agg(F.coalesce(F.regr_slope("x", F.col("rn").cast("double")), F.lit(0.0)).alias("slope"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"), F.coalesce(F.max("jump"), F.lit(0.0)).alias("max_jump"), (recent - F.coalesce(rest, recent)).alias("bust_score"))


def client_average(df: DataFrame, key: str, score: str) -> DataFrame:
    """Each row's score replaced by its entity's mean, by an aggregation and a join: a hot entity is summed in parts."""
    mean = df.groupBy(key).agg(F.avg(score).alias("client_score"))
    return lookup(df, mean, key, null_safe=True)
