"""Rolling label rates by entity and day, with the label's own delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DAY


def daily_labels(df: DataFrame, key: str, t: str, label: str) -> DataFrame:
    """(key, day, frauds, n): the table that rolling rates are made of."""
    return df.where(F.col(key).isNotNull()).groupBy(key, F.floor(F.col(t) / DAY).alias("day")).agg(F.sum(F.col(label).cast("long")).alias("frauds"), F.count(label).alias("n"))


def rolling_rate(df: DataFrame, labels: DataFrame, key: str, t: str, label: str, days: int = 28, delay: int = 1, prior: float = 10.0, name: str = "rate_28d", volume: str | None = None) -> DataFrame:
    """Adds the smoothed label rate of the key over days [d - days, d - delay] by `labels` (key, t, label).

    The days of both tables are aggregated first, so the window runs over key and day, not over rows.
    """
    known = daily_labels(labels, key, t, label)
    asked = df.where(F.col(key).isNotNull()).select(key, F.floor(F.col(t) / DAY).alias("day")).distinct().withColumns({"frauds": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    spine = known.unionByName(asked).groupBy(key, "day").agg(F.sum("frauds").alias("frauds"), F.sum("n").alias("n"))
    frame = W.partitionBy(key).orderBy("day").rangeBetween(-days, -delay)
    rates = spine.select(F.col(key).alias("rr_key"), F.col("day").alias("rr_day"), F.coalesce(F.sum("frauds").over(frame), F.lit(0)).alias("rr_f"), F.coalesce(F.sum("n").over(frame), F.lit(0)).alias("rr_n"))
    base = labels.agg(F.coalesce(F.avg(label), F.lit(0.0)).alias("rr_g"))
    out = df.join(rates, (F.col(key) == F.col("rr_key")) & (F.floor(F.col(t) / DAY) == F.col("rr_day")), "left").crossJoin(F.broadcast(base))
    f, n = F.coalesce("rr_f", F.lit(0)), F.coalesce("rr_n", F.lit(0))
    made = {name: (f + prior * F.col("rr_g")) / (n + prior)}
    if volume:
        made |= {volume: n, f"{name}_high": (made[name] > 5 * F.col("rr_g")).cast("int")}
    return out.withColumns(made).drop("rr_key", "rr_day", "rr_f", "rr_n", "rr_g")
