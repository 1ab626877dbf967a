"""Features from an entity's own sequence of rows. Entities with over `most` rows are cut into parts (see `scan`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km
from ..schema import DAY
from .profiles import lookup
from .scan import PART_ROWS, dealt, scan, with_history


def gap(df: DataFrame, key: str, t: str, row_id: str, name: str = "gap_s", most: int = PART_ROWS) -> DataFrame:
    """Seconds since the entity's previous row, and days since its first."""
    rows = scan(dealt(df, key, [t, row_id], most), {"sc_prev": ("lag", F.col(t)), "sc_t0": ("first", F.col(t))}).plain()
    return rows.withColumns({name: (F.col(t) - F.col("sc_prev")) / 1e6, "age_days": (F.col(t) - F.col("sc_t0")) / DAY}).drop("sc_prev", "sc_t0")


def amount_rank(df: DataFrame, key: str, t: str, row_id: str, value: str, n: int = 30, most: int = PART_ROWS) -> DataFrame:
    """Share of the last n amounts that are not above this one (null without any), and whether it is the largest ever."""
    rows = scan(dealt(df, key, [t, row_id], most), {"sc_top": ("max_before", F.col(value))})
    both = with_history(rows, n)
    last = F.collect_list(value).over(rows.window().rowsBetween(-n, -1))
    at_most = F.size(F.filter(F.col("sc_last"), lambda x: x <= F.col(value)))
    out = both.withColumn("sc_last", last).where("sc_own").withColumns({"amount_rank": at_most / F.when(F.size("sc_last") > 0, F.size("sc_last")), "is_max_ever": F.coalesce((F.col(value) > F.col("sc_top")).cast("int"), F.lit(1))})
    return out.drop("sc_last", "sc_own", "sc_top", "sc_part")


def first_seen(df: DataFrame, key: str, attribute: str, t: str, row_id: str, name: str, most: int = PART_ROWS) -> DataFrame:
    """1 on the first row of an entity with this value of the attribute."""
    rows = scan(dealt(df, [key, attribute], [t, row_id], most), {"sc_n": ("count_before", F.lit(1))}).plain()
    return rows.withColumn(name, (F.col("sc_n") == 0).cast("int")).drop("sc_n")


def geo_speed(df: DataFrame, key: str, t: str, row_id: str, lat: str, lon: str, most: int = PART_ROWS) -> DataFrame:
    """Distance from the previous row and the speed it means; null without a previous row or time between."""
    before = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(t).alias("t"))
    rows = scan(dealt(df, key, [t, row_id], most), {"sc_prev": ("lag", before)}).plain()
    km = haversine_km(F.col("sc_prev.lat"), F.col("sc_prev.lon"), F.col(lat), F.col(lon))
    hours = (F.col(t) - F.col("sc_prev.t")) / 3600e6
    return rows.withColumns({"km_from_last": km, "km_per_hour": km / F.when(hours > 0, hours)}).drop("sc_prev")


def since_event(df: DataFrame, key: str, t: str, row_id: str, event: Column, name: str, most: int = PART_ROWS) -> DataFrame:
    """Seconds since the entity's latest earlier row of a kind."""
    rows = scan(dealt(df, key, [t, row_id], most), {"sc_last": ("last_before", F.when(event, F.col(t)))}).plain()
    return rows.withColumn(name, (F.col(t) - F.col("sc_last")) / 1e6).drop("sc_last")


def events_before(df: DataFrame, key: str, t: str, event: Column, window: int, name: str) -> DataFrame:
    """Rows of a kind in the window before each row's time; entities are dealt by stretch of time, each row also as history of
    the next stretch."""
    stretch = F.floor(F.col(t) / window)
    rows = df.withColumn("eb_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("eb_stretch", F.when(F.col("eb_own"), stretch).otherwise(stretch + 1))
    return rows.withColumn(name, F.count_if(event).over(W.partitionBy(key, "eb_stretch").orderBy(t).rangeBetween(-window, -1))).where("eb_own").drop("eb_own", "eb_stretch")


def peer_zscore(df: DataFrame, cohort: str, value: str, name: str) -> DataFrame:
    """Deviation from the cohort's mean, by an aggregation and a join: a hot cohort is summed in parts."""
    stats = df.where(F.col(cohort).isNotNull()).groupBy(cohort).agg(F.avg(value).alias("peer_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("peer_std"))
    out = lookup(df, stats, cohort)
    return out.withColumn(name, (F.col(value) - F.col("peer_mean")) / F.greatest(F.col("peer_std"), F.lit(0.01))).drop("peer_mean", "peer_std")


def cusum_baseline(df: DataFrame, key: str, t: str, row_id: str, value: str, most: int = PART_ROWS) -> DataFrame:
    """(key, mu, sigma) from the first half of each entity's rows, two at least."""
    known = df.where(F.col(key).isNotNull()).select(key, t, row_id, value)
    rows = lookup(scan(dealt(known, key, [t, row_id], most), {"rn": ("count", F.lit(1))}).plain(), known.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)
    base = rows.where(F.col("rn") <= F.greatest(F.lit(2), F.floor(F.col("n") / 2))).groupBy(key).agg(F.avg(value).alias("mu"), F.count(value).alias("nb"), F.stddev_samp(value).alias("sd"))
    spread = F.when(F.col("nb") > 1, F.coalesce("sd", F.lit(0.0))).otherwise(F.lit(1.0))
    return base.select(key, "mu", F.greatest(spread, 0.01 * F.abs("mu") + 1).alias("sigma"))


def cusum(df: DataFrame, baseline: DataFrame, key: str, t: str, row_id: str, value: str, k: float = 0.5, h: float = 5.0, split: str | None = None, most: int = PART_ROWS) -> DataFrame:
    """Upper cumulative sum `S = max(0, S' + (x - mu)/sigma - k)` along an entity's rows (restarting in each split).

    With P the running sum of the steps, `S = P - min(0, least P so far)`: scans, no loop, so a large entity is many parts.
    Entities without a baseline get 0. Also the sum's slope, whether it is above h, and how often it fell back to 0 from
    above h.
    """
    rows = lookup(df, baseline, key)
    step = F.when(F.col("mu").isNull(), 0.0).otherwise((F.col(value) - F.col("mu")) / F.col("sigma") - k)
    rows = scan(dealt(rows, [key, split] if split else [key], [t, row_id], most), {"cs_p": ("sum", step)})
    s = F.col("cs_p") - F.least(F.lit(0.0), F.col("cs_low"))
    rows = scan(rows, {"cs_low": ("min", F.col("cs_p"))}).with_columns({"cusum": F.when(F.col("mu").isNull(), 0.0).otherwise(s)})
    rows = scan(rows, {"cs_before": ("lag", F.col("cusum"))})
    before = F.col("cs_before")
    rows = rows.with_columns({"cusum_slope": F.coalesce(F.col("cusum") - before, F.lit(0.0)), "cusum_triggered": (F.col("cusum") > h).cast("int"), "cs_reset": ((before > h) & (F.col("cusum") <= 1e-9)).cast("int")})
    return scan(rows, {"cusum_resets": ("sum", F.col("cs_reset"))}).plain().drop("cs_p", "cs_low", "cs_before", "cs_reset", "mu", "sigma")


def ewma(df: DataFrame, key: str, t: str, row_id: str, value: str, alpha: float = 0.3, name: str = "ewma", most: int = PART_ROWS) -> DataFrame:
    """(key, name): exponentially weighted mean of an entity's known values in order, the first one as the start.

    Each value's weight follows from how many come after it, so one sum by entity gives the mean, in parts.
    """
    known = df.where(F.col(value).isNotNull()).select(key, t, row_id, value)
    rows = lookup(scan(dealt(known, key, [t, row_id], most), {"rn": ("count", F.lit(1))}).plain(), known.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, null_safe=True)
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("rn")) * F.when(F.col("rn") > 1, alpha).otherwise(1.0)
    return rows.groupBy(key).agg(F.sum(weight * F.col(value)).alias(name))


def running_best(df: DataFrame, order: str, value: str, name: str = "best_so_far") -> DataFrame:
    """Largest value so far; for logs, which are small: one ordered window over all rows."""
    return df.withColumn(name, F.max(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def new_best(values: Column, least_gain: float = 0.0005) -> Column:
    """For an ordered array: flags of the values that beat the best by `least_gain`; only such a value moves the best."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.array().cast("array<boolean>").alias("flags"))
    fold = lambda acc, x: F.struct(F.when(acc["best"].isNull() | (x > acc["best"] + least_gain), x).otherwise(acc["best"]).alias("best"), F.concat(acc["flags"], F.array(acc["best"].isNull() | (x > acc["best"] + least_gain))).alias("flags"))
    return F.aggregate(values, start, fold, lambda acc: acc["flags"])
