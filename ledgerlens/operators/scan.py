"""Running state along an entity's rows, for entities of any size: a segmented scan.

A window over an entity is one task, however many rows the entity has. Here the rows of entities with over `most` rows are
cut into ranges of (entity, order), each range a part; windows run inside parts, every part hands on one small carry (last
row, first row, sum, count, maximum, minimum), and the carries of an entity's earlier parts are combined and added. All other
entities are one part each, in the same plan. Results are those of a window over the entity, up to the order in which
floating-point numbers are added.

Building a scan runs a count by entity; only where an entity is large are its rows put in order and written, since the cut
comes from a sample and several steps read it.

Cases: a null entity is an entity of its own; an empty table gives an empty result; order columns must tell rows apart; other
columns pass, whatever their names but those that begin with `sc_`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

PART_ROWS, MOST_BROADCAST = 1 << 18, 1_000_000


def small(df: DataFrame, n: int) -> DataFrame:
    """Sent to all tasks if its `n` rows are few enough, else left to a shuffle."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)))


@dataclass(frozen=True)
class Dealt:
    """Rows with the number of their part (`sc_part`, 0 where an entity is one part)."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    parts: int

    def window(self) -> W:
        return W.partitionBy(*self.keys, "sc_part").orderBy(*self.order)

    def plain(self) -> DataFrame:
        return self.rows.drop("sc_part")

    def with_columns(self, made: dict[str, Column]) -> Dealt:
        return replace(self, rows=self.rows.withColumns(made))


def dealt(df: DataFrame, keys: str | list[str], order: list[str], most: int = PART_ROWS) -> Dealt:
    """Deals rows to parts of about `most` rows of one entity."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = df.sparkSession
    names = [f"sc_k{i}" for i in range(len(keys))]
    sizes = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.count(F.lit(1)).alias("sc_n"))
    large = written(spark, sizes.where(F.col("sc_n") > most), "large-entities")
    found = large.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("sc_n"), F.lit(0)).alias("n")).first()
    if not found["k"]:
        return Dealt(df.withColumn("sc_part", F.lit(0)), tuple(keys), tuple(order), 0)
    parts = max(2, math.ceil(found["n"] / most))
    on, few = same(keys, names), small(large.drop("sc_n"), found["k"])
    hot = df.join(few, on, "left_semi").repartitionByRange(parts, *keys, *order).withColumn("sc_part", F.spark_partition_id() + 1)
    cold = df.join(few, on, "left_anti").withColumn("sc_part", F.lit(0))
    return Dealt(cold.unionByName(written(spark, hot, "parts")), tuple(keys), tuple(order), parts)


def _local(kind: str, x: Column, w: W) -> Column:
    """The value inside a part."""
    so_far, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    return {
        "sum": lambda: F.coalesce(F.sum(x).over(so_far), F.lit(0)), "sum_before": lambda: F.coalesce(F.sum(x).over(before), F.lit(0)), "count": lambda: F.count(x).over(so_far), "count_before": lambda: F.count(x).over(before),
        "max": lambda: F.max(x).over(so_far), "max_before": lambda: F.max(x).over(before), "min": lambda: F.min(x).over(so_far), "last_before": lambda: F.last(x, ignorenulls=True).over(before),
        "lag": lambda: F.lag(F.struct(x.alias("x"))).over(w), "first": lambda: F.first(F.struct(x.alias("x"))).over(so_far),
    }[kind]()


def _carry(kind: str, x: Column, at: Column) -> Column:
    """What a part hands on."""
    one = F.struct(x.alias("x"))
    return {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0)), "count": lambda: F.count(x), "max": lambda: F.max(x), "min": lambda: F.min(x), "last": lambda: F.max_by(x, F.when(x.isNotNull(), at)),
        "lag": lambda: F.max_by(one, at), "first": lambda: F.min_by(one, at),
    }[kind.removesuffix("_before")]()


def _combined(kind: str, c: Column, earlier: W) -> Column:
    """The carry of all earlier parts of an entity."""
    return {
        "sum": lambda: F.sum(c), "count": lambda: F.sum(c), "max": lambda: F.max(c), "min": lambda: F.min(c), "last": lambda: F.last(c, ignorenulls=True), "lag": lambda: F.last(c), "first": lambda: F.first(c),
    }[kind.removesuffix("_before")]().over(earlier)


def _finished(kind: str, local: Column, carried: Column) -> Column:
    base = kind.removesuffix("_before")
    if base in ("sum", "count"):
        return local + F.coalesce(carried, F.lit(0))
    if base in ("max", "min"):
        return (F.greatest if base == "max" else F.least)(local, carried)
    return F.coalesce(carried, local)["x"] if base == "first" else F.coalesce(local, carried)["x"] if base == "lag" else F.coalesce(local, carried)


def scan(rows: Dealt, made: dict[str, tuple[str, Column]]) -> Dealt:
    """Adds a running value for each name: (kind, column). Kinds: sum, count, max, min (this row among them), sum_before,
    count_before, max_before (without it), lag (previous row's), last_before (latest earlier known), first (first row's)."""
    w = rows.window()
    plain = {n: F.col(n)["x"] for n, (kind, _) in made.items() if kind in ("lag", "first")}
    local = rows.rows.withColumns({n: _local(kind, x, w) for n, (kind, x) in made.items()})
    if not rows.parts:
        return replace(rows, rows=local.withColumns(plain) if plain else local)
    names = [f"sc_k{i}" for i in range(len(rows.keys))]
    at = F.struct(*rows.order)
    hot = rows.rows.where("sc_part > 0").groupBy(*(F.col(k).alias(n) for k, n in zip(rows.keys, names, strict=True)), F.col("sc_part").alias("sc_p"))
    sums = hot.agg(*(_carry(kind, x, at).alias(f"sc_{n}") for n, (kind, x) in made.items()))
    # about as many rows as parts: an entity that is cut has over a part's rows
    earlier = W.partitionBy(*names).orderBy("sc_p").rowsBetween(W.unboundedPreceding, -1)
    carries = sums.select(*names, "sc_p", *(_combined(kind, F.col(f"sc_{n}"), earlier).alias(f"sc_{n}") for n, (kind, _) in made.items()))
    both = local.join(small(carries, 3 * rows.parts), same([*rows.keys, "sc_part"], [*names, "sc_p"]), "left")
    done = both.withColumns({n: _finished(kind, F.col(n), F.col(f"sc_{n}")) for n, (kind, _) in made.items()})
    return replace(rows, rows=done.drop("sc_p", *names, *(f"sc_{n}" for n in made)))


def with_history(rows: Dealt, n: int) -> DataFrame:
    """The rows with `sc_own` true, and before each part the `n` rows of its entity that come before it, with `sc_own` false:
    a window of up to `n` earlier rows inside (keys, sc_part) is then that of the entity."""
    own = rows.rows.withColumn("sc_own", F.lit(True))
    if not rows.parts:
        return own
    names = [f"sc_k{i}" for i in range(len(rows.keys))]
    numbered = replace(rows, rows=rows.rows.where("sc_part > 0"))
    numbered = scan(numbered, {"sc_g": ("count_before", F.lit(1))}).rows
    starts = numbered.groupBy(*(F.col(k).alias(m) for k, m in zip(rows.keys, names, strict=True)), F.col("sc_part").alias("sc_to")).agg(F.min("sc_g").alias("sc_start"))
    # the rows wanted lie in two stretches of n rows at most
    wanted = starts.where("sc_start > 0").withColumn("sc_b", F.explode(F.array_distinct(F.array(F.floor((F.col("sc_start") - 1) / n), F.greatest(F.floor((F.col("sc_start") - n) / n), F.lit(0))))))
    on = same([*rows.keys, "sc_b0"], [*names, "sc_b"]) & (F.col("sc_g") < F.col("sc_start")) & (F.col("sc_g") >= F.col("sc_start") - n)
    before = numbered.withColumn("sc_b0", F.floor(F.col("sc_g") / n)).join(small(wanted, 6 * rows.parts), on)
    return own.unionByName(before.withColumns({"sc_part": F.col("sc_to"), "sc_own": F.lit(False)}).select(*own.columns))
