"""Counts and sums over the time before each row, exact on ties, with one shuffle for all windows of an entity. They are
differences of running sums: a row costs the same whatever its windows hold. Means, largest values and deviations go through windows.

`ties`: "prior" counts rows that come before by (time, row id), "strict" earlier times only, "inclusive" all rows up to
and at the row's time, itself among them. With `spread`, rows are dealt by entity and stretch of time (the longest
window), each also as history of the next stretch: a hot entity then runs in as many tasks as it has stretches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DAY, HOUR, MINUTE
from .dominance import window_distinct
from .scan import PART_ROWS, dealt, scan

DAILY = {"1h": HOUR, "6h": 6 * HOUR, "1d": DAY, "7d": 7 * DAY}
FAST = {"10m": 10 * MINUTE, "1h": HOUR, "1d": DAY, "7d": 7 * DAY}
STACK = {"60s": MINUTE, "600s": 10 * MINUTE, "1h": HOUR, "1d": DAY, "7d": 7 * DAY}


def velocity(df: DataFrame, key: str, t: str, value: str, row_id: str, windows: dict[str, int] = DAILY, aggs: Iterable[str] = ("count", "sum"), ties: str = "prior", prefix: str | None = None, history: str | None = None, spread: bool = False) -> DataFrame:
    """Adds `{prefix}_{window}_{agg}`. Aggregates: count sum max avg std distinct (the latter four not with "prior").
    Distinct values are counted by `window_distinct`, never gathered.

    `history` names a boolean column: only rows where it is true count, though all rows get the features. Null keys
    are an entity of their own and get zeros.
    """
    prefix = prefix or key
    longest = max(windows.values())
    parts: list[str] = [key]
    rows = df
    if spread:
        stretch = F.floor(F.col(t) / longest)
        rows = df.withColumn("v_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("v_stretch", F.when(F.col("v_own"), stretch).otherwise(stretch + 1))
        parts = [key, "v_stretch"]
    counts = (F.col(history) if history else F.lit(True)) & F.col(key).isNotNull()
    v = F.when(counts, F.col(value))
    aggs = list(aggs)
    out = df
    if any(a != "distinct" for a in aggs):
        by, near = W.partitionBy(*parts), -1 if ties == "strict" else 0
        upto = by.orderBy(t, row_id).rowsBetween(W.unboundedPreceding, -1) if ties == "prior" else by.orderBy(t).rangeBetween(W.unboundedPreceding, near)
        summed = {"one": F.when(counts, 1), **(addends(v) if "sum" in aggs else {})}
        ends = {"upto": upto} | {f"from_{n}": by.orderBy(t).rangeBetween(W.unboundedPreceding, -w - 1) for n, w in windows.items()}
        run = rows.withColumns({f"v_{x}": c for x, c in summed.items()})
        run = run.withColumns({f"v_{x}_{end}": F.sum(f"v_{x}").over(w) for end, w in ends.items() for x in summed})
        made: dict[str, Column] = {}
        for name, w in windows.items():
            frame = by.orderBy(t).rangeBetween(-w, near)
            inside = {x: difference(F.col(f"v_{x}_upto"), F.col(f"v_{x}_from_{name}")) for x in summed}
            total = total_of(inside) if "digits" in inside else None
            known = {
                "count": lambda: inside["one"], "sum": lambda: F.when(inside["one"] > 0, total).otherwise(F.lit(0.0)), "avg": lambda: F.avg(v).over(frame),  # noqa: B023
                "max": lambda: F.coalesce(F.max(v).over(frame), F.lit(0.0)), "std": lambda: F.stddev_samp(v).over(frame),  # noqa: B023
            }
            made |= {f"{prefix}_{name}_{a}": known[a]() for a in aggs if a != "distinct"}
        out = run.withColumns(made).drop(*(f"v_{x}" for x in summed), *(f"v_{x}_{end}" for end in ends for x in summed))
        if spread:
            out = out.where("v_own").drop("v_own", "v_stretch")
    if "distinct" in aggs:
        out = window_distinct(out, key, t, v, {f"{prefix}_{name}_distinct": w for name, w in windows.items()}, ties != "strict")
    return out


def addends(v: Column) -> dict[str, Column]:
    """What running sums of amounts are made of. A difference of two sums would keep the errors of what lies before the window, so
    they are exact: amounts up to 1e18 as decimals; their rest behind ten digits, and larger amounts, as floating-point numbers;
    infinite ones and NaN are counted, NaN on both sides, in the halves of one number."""
    x = v.cast("double")
    plain = ~F.isnan(x) & (F.abs(x) < 1e18)
    digits = F.when(plain, x).cast("decimal(28,10)")
    up, down = ((F.isnan(x) | (x == float(f"{sign}inf"))).cast("long") for sign in ("", "-"))
    return {"digits": digits, "rest": F.when(plain, x - digits.cast("double")).when(up + down == 0, x), "odd": up + F.shiftleft(down, 32)}


def difference(a: Column, b: Column) -> Column:
    """a - b of running sums, which are null before the first known value."""
    return F.when(a.isNull(), F.lit(0)).when(b.isNull(), a).otherwise(a - b)


def total_of(inside: dict[str, Column]) -> Column:
    total = inside["digits"].cast("double") + inside["rest"]
    up, down = inside["odd"].bitwiseAND((1 << 32) - 1) > 0, F.shiftright(inside["odd"], 32) > 0
    return F.when(inside["odd"] == 0, total).when(up & down, float("nan")).when(up, float("inf")).otherwise(float("-inf"))


def velocity_matrix(df: DataFrame, keys: Iterable[str], t: str, value: str, row_id: str, windows: dict[str, int] = DAILY, aggs: Iterable[str] = ("count", "sum", "avg", "std", "distinct"), spread: bool = False) -> DataFrame:
    """All windows and aggregates of several keys over strictly earlier rows: one shuffle a key."""
    for key in keys:
        df = velocity(df, key, t, value, row_id, windows, aggs, ties="strict", spread=spread)
    return df


def diversity(df: DataFrame, key: str, entity: str, t: str, window: int, name: str, limit: int | None = None, most: int = PART_ROWS) -> DataFrame:
    """Distinct entities that an address, device or card met in the window up to each row (its own among them), and
    `{name}_high` above a limit; counted by previous occurrences, so neither a hot key nor a wide window is gathered."""
    out = window_distinct(df, key, t, F.when(F.col(key).isNotNull(), F.col(entity)), {name: window}, most=most)
    return out if limit is None else out.withColumn(f"{name}_high", (F.col(name) > limit).cast("int"))


def so_far(df: DataFrame, key: str, t: str, sums: dict[str, Column], most: int = PART_ROWS) -> DataFrame:
    """Adds for each name the sum over the entity's rows up to and at each row's time, and `sf_first`, its first time: rows of
    one time are summed first, then scanned in parts."""
    per = df.groupBy(F.col(key).alias("sf_key"), F.col(t).alias("sf_t")).agg(*(F.sum(x).alias(n) for n, x in sums.items()))
    run = scan(dealt(per, "sf_key", ["sf_t"], most), {**{f"sf_{n}": ("sum", F.col(n)) for n in sums}, "sf_first": ("first", F.col("sf_t"))}).plain()
    run = run.select("sf_key", "sf_t", "sf_first", *(F.col(f"sf_{n}").alias(n) for n in sums))
    return df.join(run, F.col(key).eqNullSafe(F.col("sf_key")) & (F.col(t) == F.col("sf_t"))).drop("sf_key", "sf_t")


def stretched(df: DataFrame, key: str, t: str, length: int, made: dict[str, tuple[int, int, Column]]) -> DataFrame:
    """Adds for each name an aggregate over the entity's rows with times in [t - far, t - near]: (far, near, aggregate), far at
    most `length`. Rows are dealt by entity and stretch of that length, each also as history of the next one."""
    stretch = F.floor(F.col(t) / length)
    rows = df.withColumn("v_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("v_stretch", F.when(F.col("v_own"), stretch).otherwise(stretch + 1))
    by = W.partitionBy(key, "v_stretch").orderBy(t)
    return rows.withColumns({n: x.over(by.rangeBetween(-far, -near)) for n, (far, near, x) in made.items()}).where("v_own").drop("v_own", "v_stretch")


def recent_history(df: DataFrame, t: str, start: Column, longest: int) -> DataFrame:
    """Rows that any window of a split that begins at `start` can still see: cut before the shuffle."""
    return df.where(F.col(t) >= start - longest)


def burst_ratio(short: str, long: str) -> Column:
    return (F.col(short) + 1) / (F.col(long) + 1)


def velocity_ratio(count_day: str, count_month: str) -> Column:
    return F.col(count_day) / F.greatest(F.col(count_month) / 30, F.lit(0.1))


def velocity_zscore(count_day: str, mean_daily: str, std_daily: str) -> Column:
    return (F.col(count_day) - F.col(mean_daily)) / F.greatest(F.col(std_daily), F.lit(1.0))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers have it: by zero it is infinite or, of zero or NaN, NaN, and no error."""
    by_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def escalation(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Largest amount of a day against the mean of thirty, and the amount against the week's largest."""
    out = stretched(df, key, t, 30 * DAY, {"v_top": (DAY, 0, F.max(value)), "v_mean": (30 * DAY, 1, F.avg(value)), "v_week": (7 * DAY, 0, F.max(value))})
    made = {"escalation": F.col("v_top") / F.greatest(F.coalesce("v_mean", F.lit(1.0)), F.lit(1.0)), "vs_week_max": quotient(F.col(value), F.col("v_week"))}
    return out.withColumns(made).drop("v_top", "v_mean", "v_week")


def share_shift(df: DataFrame, key: str, t: str, row_id: str, flag: Column, name: str = "share_shift", window: int = 7 * DAY, most: int = PART_ROWS) -> DataFrame:
    """Share of flagged rows in the last week less their share so far."""
    x = flag.cast("double")
    out = so_far(stretched(df, key, t, window, {"v_week": (window, 0, F.avg(x))}), key, t, {"v_sum": x, "v_n": x.isNotNull().cast("long")}, most)
    return out.withColumn(name, F.col("v_week") - F.col("v_sum") / F.when(F.col("v_n") > 0, F.col("v_n"))).drop("v_week", "v_sum", "v_n", "sf_first")


def drift(df: DataFrame, key: str, t: str, value: str, name: str = "drift") -> DataFrame:
    """Mean of the last thirty days less the mean of the thirty days that began ninety days ago."""
    out = stretched(df, key, t, 90 * DAY, {"v_new": (30 * DAY, 1, F.avg(value)), "v_old": (90 * DAY, 60 * DAY, F.avg(value))})
    return out.withColumn(name, F.col("v_new") - F.col("v_old")).drop("v_new", "v_old")


def recipient_profile(df: DataFrame, to: str, sender: str, t: str, amount: str, most: int = PART_ROWS) -> DataFrame:
    """Distinct senders in a week, amount received in a day, mean amount so far, days since first seen, by row of the
    recipient; flags of a new recipient, of many senders, and of a day over ten times the mean of its days so far."""
    out = stretched(df, to, t, DAY, {"received_1d": (DAY, 0, F.sum(amount))})
    out = so_far(out, to, t, {"v_sum": F.col(amount), "v_n": F.col(amount).isNotNull().cast("long")}, most)
    age = (F.col(t) - F.col("sf_first")) / DAY
    daily = F.col("v_sum") / F.greatest(age, F.lit(1.0))
    out = window_distinct(out, to, t, F.col(sender), {"senders_7d": 7 * DAY}, most=most)
    made = {"recipient_age_days": age, "recipient_new": (age < 7).cast("int"), "many_senders": (F.col("senders_7d") > 5).cast("int"), "received_mean": F.col("v_sum") / F.when(F.col("v_n") > 0, F.col("v_n")), "received_spike": (F.col("received_1d") > 10 * daily).cast("int")}
    return out.withColumns(made).drop("v_sum", "v_n", "sf_first")
