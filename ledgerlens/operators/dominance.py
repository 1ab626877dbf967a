"""Dominance counting: how many rows of an entity have a place below p and a value of at most x, for many (p, x) at once.

This answers what moving windows can't without their rows: the rank of a value among a window's values, and the number of
distinct values in a window. Places 0, 1, 2 ... of an entity's rows form a binary tree; the places below p are one block of
2**l for each bit of p that is set, and a rest inside a block of BASE rows. In each block the rows and the questions meet in
the order of the value, and a running count answers all of them; the rest is looked up in the block's own BASE rows at most.
So a row appears once a level, a question asks at most once a level, and no block is gathered: running counts go through
`scan`, which cuts large blocks into parts.

Cases: a null value of a row is below no x, and a null x has no rows; equal values count; a null entity is an entity of its
own; questions on entities without rows get 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .scan import PART_ROWS, dealt, scan

BASE_BITS = 5
BASE = 1 << BASE_BITS


def high_bit(n: Column) -> Column:
    """The place of the highest bit of a number from 1, without a logarithm's rounding."""
    return F.length(F.bin(n)) - 1


def count_below(points: DataFrame, asks: DataFrame, most: int = PART_ROWS) -> DataFrame:
    """(id, n): sums over `asks` (id, key, p, x, sign) of sign * (rows of `points` (key, g, x) with g < p and a value <= x).

    `key` is one column, a struct where an entity has several; `g` numbers an entity's rows from 0 without gaps.
    """
    top = points.groupBy("key").agg(F.max("g").alias("top"))
    # a question may lie behind the last row: at as many places as there are rows
    levels = F.when(F.col("top") + 1 >= BASE, F.sequence(F.lit(BASE_BITS), high_bit(F.col("top") + 1))).otherwise(F.array().cast("array<int>"))
    block = lambda place, level: F.expr(f"shiftright({place}, {level})")
    # an entity's rows are in every level that a question on it can ask
    tree = points.where(F.col("x").isNotNull()).join(top.withColumnRenamed("key", "top_key"), F.col("key").eqNullSafe(F.col("top_key")))
    tree = tree.select("key", "g", "x", F.explode(levels).alias("level")).select("key", "level", block("g", "level").alias("block"), "x", F.lit(0).alias("kind"), F.lit(None).cast(asks.schema["id"].dataType).alias("id"), F.lit(0).alias("sign"), "g")
    known = asks.where(F.col("x").isNotNull() & (F.col("p") > 0))
    bits = F.filter(F.sequence(F.lit(BASE_BITS), F.greatest(F.lit(BASE_BITS), high_bit(F.col("p")))), lambda i: F.call_function("shiftright", F.col("p"), i).bitwiseAND(1) == 1)
    pieces = known.select("id", "key", "p", "x", "sign", F.explode(bits).alias("level")).select("key", "level", (block("p", "level") - 1).alias("block"), "x", F.lit(1).alias("kind"), "id", "sign", F.lit(0).cast("long").alias("g"))
    # blocks that several questions of one id add and take away again cancel
    pieces = pieces.groupBy("key", "level", "block", "x", "kind", "id", "g").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
    both = tree.unionByName(pieces)
    counted = scan(dealt(both, ["key", "level", "block"], ["x", "kind", "id", "g"], most), {"n": ("sum", F.lit(1) - F.col("kind"))}).plain()
    whole = counted.where("kind = 1").select("id", (F.col("n") * F.col("sign")).alias("n"))
    # what is left of p lies in one block of BASE rows
    leaves = points.where(F.col("x").isNotNull()).groupBy("key", block("g", BASE_BITS).alias("leaf")).agg(F.collect_list(F.struct("g", "x")).alias("rows")).select(F.col("key").alias("l_key"), F.col("leaf").alias("l_leaf"), "rows")
    rest = known.where(F.col("p") % BASE != 0).join(leaves, F.col("key").eqNullSafe(F.col("l_key")) & (block("p", BASE_BITS) == F.col("l_leaf")))
    rest = rest.select("id", (F.size(F.filter("rows", lambda r: (r["g"] < F.col("p")) & (r["x"] <= F.col("x")))) * F.col("sign")).cast("long").alias("n"))
    zero = asks.select("id", F.lit(0).cast("long").alias("n"))
    return whole.unionAll(rest).unionAll(zero).groupBy("id").agg(F.sum("n").alias("n"))


def places(df: DataFrame, key: str, t: str, row_id: str, window: int, most: int = PART_ROWS) -> DataFrame:
    """(key, id, g, lo) of each row: how many rows of its entity come before it by (time, row id), and how many are more than
    `window` earlier.

    Rows and the starts of their windows are put in one order; running counts of rows tell where the starts fall.
    """
    marks = F.array(F.struct(F.col(t).alias("at"), F.lit(1).alias("kind")), F.struct((F.col(t) - window).alias("at"), F.lit(0).alias("kind")))
    flat = df.select(F.col(key).alias("key"), F.col(row_id).alias("id"), F.explode(marks).alias("m")).select("key", "id", "m.*")
    counted = scan(dealt(flat, "key", ["at", "kind", "id"], most), {"n": ("sum_before", F.col("kind"))}).plain()
    return counted.groupBy("key", "id").agg(F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("g"), F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("lo"))


def window_rank(df: DataFrame, key: str, t: str, row_id: str, value: str, window: int, name: str, most: int = PART_ROWS) -> DataFrame:
    """Adds the share of the entity's earlier rows (by time and row id) at most `window` ago whose known value isn't above this
    row's; null without any, and for a null value. Row ids must be distinct."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(t).alias("t"), F.col(row_id).alias("id"), F.col(value).alias("x"))
    at = places(rows, "key", "t", "id", window, most)
    rows = written(df.sparkSession, at.join(rows.select("id", "x"), "id"), "places")
    ask = lambda p, sign: F.struct(F.col(p).cast("long").alias("p"), F.lit(sign).alias("sign"))
    asks = rows.select("id", "key", "x", F.explode(F.array(ask("g", 1), ask("lo", -1))).alias("a")).select("id", "key", "x", "a.*")
    below = count_below(rows.select("key", "g", "x"), asks, most)
    size = F.col("g") - F.col("lo")
    found = rows.join(below, "id").select(F.col("id").alias("wr_id"), (F.col("n") / F.when(size > 0, size)).alias("wr_share"))
    return df.join(found, F.col(row_id) == F.col("wr_id"), "left").withColumn(name, F.col("wr_share")).drop("wr_id", "wr_share")


def window_distinct(df: DataFrame, key: str, t: str, value: Column, windows: dict[str, int], inclusive: bool = True, most: int = PART_ROWS) -> DataFrame:
    """Adds, for each (name, length) of `windows`, the number of distinct known values among the entity's rows from that long
    before each row up to its time (`inclusive`), or before its time; `value` may be of any type that can be ordered.

    A value counts at the first of its rows in the window: the one whose previous occurrence lies before the window's start.
    Rows of one entity, time and value are one; so are the answers for one entity and time.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(t).alias("t"), value.alias("v"))
    no_value = F.lit(None).cast(rows.schema["v"].dataType)
    # kinds: 0 counts the values of earlier times, 1 is a value, 2 counts those up to and at the time
    ends = [F.struct((F.col("t") - w).alias("at"), F.lit(0).alias("kind"), F.lit(i).alias("what")) for i, w in enumerate(windows.values())]
    ends.append(F.struct(F.col("t").alias("at"), F.lit(2 if inclusive else 0).alias("kind"), F.lit(-1).alias("what")))
    asked = rows.select("key", "t").distinct().select("key", "t", no_value.alias("v"), F.explode(F.array(*ends)).alias("m")).select("key", "t", "v", "m.*")
    values = rows.where("v IS NOT NULL").distinct().select("key", "t", "v", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("what"))
    placed = scan(dealt(asked.unionByName(values), "key", ["at", "kind", "v", "t", "what"], most), {"n": ("sum_before", (F.col("kind") == 1).cast("int"))}).plain()
    placed = written(spark, placed, "places")
    points = scan(dealt(placed.where("kind = 1").select("key", "v", F.col("n").alias("g")), ["key", "v"], ["g"], most), {"x": ("lag", F.col("g"))}).plain()
    points = written(spark, points.select("key", "g", F.coalesce("x", F.lit(-1)).cast("long").alias("x")), "previous")
    ends = placed.where("kind <> 1").groupBy("key", "t").agg(F.max(F.when(F.col("what") == -1, F.col("n"))).alias("p"), *(F.max(F.when(F.col("what") == i, F.col("n"))).alias(f"lo{i}") for i in range(len(windows))))
    ends = written(spark, ends.withColumn("id", F.monotonically_increasing_id()), "window-ends")
    one = lambda i: F.struct(F.lit(i).alias("w"), (F.col(f"lo{i}") - 1).cast("long").alias("x"))
    asks = ends.select("id", "key", F.col("p").cast("long").alias("p"), F.explode(F.array(*map(one, range(len(windows))))).alias("a"))
    asks = asks.select(F.struct("id", "a.w").alias("id"), "key", "p", "a.x", F.lit(1).alias("sign"))
    below = count_below(points, asks, most).groupBy("id.id").agg(*(F.max(F.when(F.col("id.w") == i, F.col("n"))).alias(f"n{i}") for i in range(len(windows))))
    # all values before the window's start are below, and none of them counts
    found = ends.join(below, "id").select(F.col("key").alias("wd_key"), F.col("t").alias("wd_t"), *(F.greatest(F.col(f"n{i}") - F.col(f"lo{i}"), F.lit(0)).cast("int").alias(f"wd_{i}") for i in range(len(windows))))
    out = df.join(found, F.col(key).eqNullSafe(F.col("wd_key")) & (F.col(t) == F.col("wd_t")))
    return out.withColumns({name: F.col(f"wd_{i}") for i, name in enumerate(windows)}).drop("wd_key", "wd_t", *(f"wd_{i}" for i in range(len(windows))))
