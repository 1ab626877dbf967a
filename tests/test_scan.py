"""Segmented scans and dominance counting against windows over whole entities and against loops."""

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators import dominance, profiles, scan, sequence, velocity
from ledgerlens.schema import DAY


@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows are one entity's; null entities, ties of time, null values, an extra column with an operator's name."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", "c", None]) if i < 900 else f"e{i % 50}", rng.randrange(400), rng.choice([None, 1.0, 2.5, -3.0, 7.0, rng.random()]), rng.choice("xyz"), "n") for i in range(1000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, k string, t long, v double, c string, n string")


def same_rows(a, b, digits=9):
    key = lambda r: tuple((x is None, round(x, digits) if isinstance(x, float) else x) for x in r)
    left, right = (sorted(map(key, x.collect())) for x in (a, b.select(*a.columns)))
    assert left == right


KINDS = ("sum", "count", "max", "min", "sum_before", "count_before", "max_before", "last_before", "lag", "first")


@pytest.mark.parametrize("most", [40, 7, 10**6])
def test_scan_equals_windows(hot, most):
    rows = scan.dealt(hot, "k", ["t", "id"], most)
    got = scan.scan(rows, {f"r_{kind}": (kind, F.col("v")) for kind in KINDS})
    w = W.partitionBy("k").orderBy("t", "id")
    so_far, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    v = F.col("v")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    want = hot.withColumns(
        {
            "r_sum": zero(F.sum(v).over(so_far)), "r_count": F.count(v).over(so_far), "r_max": F.max(v).over(so_far), "r_min": F.min(v).over(so_far), "r_sum_before": zero(F.sum(v).over(before)), "r_count_before": F.count(v).over(before),
            "r_max_before": F.max(v).over(before), "r_last_before": F.last(v, ignorenulls=True).over(before), "r_lag": F.lag(v).over(w), "r_first": F.first(v).over(so_far),
        }
    )
    same_rows(want, got.plain())
    if most < 100:
        # one entity with half of the rows is many parts of about even size
        sizes = [r["count"] for r in got.rows.where("k = 'hot'").groupBy("sc_part").count().collect()]
        assert len(sizes) >= 300 / most and max(sizes) <= 3 * most + 5
    assert scan.scan(scan.dealt(hot.limit(0), "k", ["t", "id"], most), {"s": ("sum", v)}).plain().count() == 0


@pytest.mark.parametrize("most, n", [(9, 5), (30, 30), (6, 20), (10**6, 4)])
def test_history_of_parts(hot, most, n):
    rows = scan.with_history(scan.dealt(hot, ["k", "c"], ["t", "id"], most), n)
    frame = lambda *by: W.partitionBy(*by).orderBy("t", "id").rowsBetween(-n, -1)
    got = rows.withColumn("last", F.collect_list("id").over(frame("k", "c", "sc_part"))).where("sc_own").select("id", F.to_json("last").alias("last"))
    same_rows(hot.select("id", F.to_json(F.collect_list("id").over(frame("k", "c"))).alias("last")), got)


@pytest.mark.parametrize("most", [50, 10**6])
def test_window_rank_matches_a_loop(hot, most):
    rows = [(r["id"], r["k"], r["t"], r["v"]) for r in hot.collect()]
    got = {r["id"]: r["share"] for r in dominance.window_rank(hot, "k", "t", "id", "v", 90, "share", most).collect()}
    assert len(got) == len(rows)
    for i, k, t, v in rows:
        mine = [x for j, kk, s, x in rows if kk == k and (s, j) < (t, i) and s >= t - 90 and x is not None]
        if v is None or not mine:
            assert got[i] is None
        else:
            assert math.isclose(got[i], sum(x <= v for x in mine) / len(mine))
    assert dominance.window_rank(hot.limit(0), "k", "t", "id", "v", 90, "share").count() == 0


@pytest.mark.parametrize("most, inclusive", [(50, True), (10**6, True), (64, False)])
def test_window_distinct_matches_a_loop(hot, most, inclusive):
    rows = [(r["id"], r["k"], r["t"], r["v"]) for r in hot.collect()]
    out = dominance.window_distinct(hot, "k", "t", F.col("v"), {"d20": 20, "d300": 300}, inclusive, most)
    got = {r["id"]: (r["d20"], r["d300"]) for r in out.collect()}
    assert out.columns == [*hot.columns, "d20", "d300"] and len(got) == len(rows)
    for i, k, t, _ in rows:
        seen = lambda w: len({x for _, kk, s, x in rows if kk == k and t - w <= s <= t - (not inclusive) and x is not None})
        assert got[i] == (seen(20), seen(300))


def test_window_distinct_of_a_wide_window(spark):
    """100,000 rows of one entity, all in one window: a row's answer costs a logarithm of that."""
    n = 100_000
    df = spark.range(n).select(F.col("id"), F.lit(1).alias("k"), F.col("id").alias("t"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("v"))
    got = dominance.window_distinct(df, "k", "t", F.col("v"), {"d": n}, most=20_000)
    seen, want = set(), {}
    for r in df.orderBy("id").collect():
        seen.add(r["v"])
        want[r["id"]] = len(seen)
    assert {r["id"]: r["d"] for r in got.collect()} == want


def test_operators_cut_hot_entities(spark):
    """Every operator that runs along an entity gives the same rows whether its entities are cut into parts or not."""
    rng = random.Random(11)
    data = [(i, "hot" if i % 2 else rng.choice(["a", "b", None]), rng.randrange(120) * DAY // 4, float(rng.randrange(1, 40)), rng.choice("pqrs"), rng.uniform(-60, 60), rng.uniform(-90, 90)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, k string, t long, v double, c string, lat double, lon double")
    base = sequence.cusum_baseline(df, "k", "t", "id", "v")
    calls = {
        "gap": lambda m: sequence.gap(df, "k", "t", "id", most=m), "rank": lambda m: sequence.amount_rank(df, "k", "t", "id", "v", 7, most=m), "seen": lambda m: sequence.first_seen(df, "k", "c", "t", "id", "new", most=m),
        "geo": lambda m: sequence.geo_speed(df, "k", "t", "id", "lat", "lon", most=m), "since": lambda m: sequence.since_event(df, "k", "t", "id", F.col("c") == "p", "s", most=m),
        "base": lambda m: sequence.cusum_baseline(df, "k", "t", "id", "v", most=m), "cusum": lambda m: sequence.cusum(df, base, "k", "t", "id", "v", k=0.1, h=1.0, split="c", most=m), "ewma": lambda m: sequence.ewma(df, "k", "t", "id", "v", most=m),
        "gaps": lambda m: profiles.gap_stats(df, "k", "t", "id", most=m), "trajectory": lambda m: profiles.trajectory(df, "k", "t", "id", "v", most=m),
        "share": lambda m: velocity.share_shift(df, "k", "t", "id", F.col("c") == "q", most=m), "recipient": lambda m: velocity.recipient_profile(df, "k", "c", "t", "v", most=m),
        "diversity": lambda m: velocity.diversity(df, "k", "c", "t", 3 * DAY, "d", 2, most=m),
    }
    for name, call in calls.items():
        plain, cut = call(10**6), call(30)
        assert plain.columns == cut.columns and not any(c.startswith(("sc_", "sf_")) for c in cut.columns), name
        same_rows(plain, cut, 7)


def test_windows_over_stretches_match_loops(spark):
    rng = random.Random(12)
    data = [(i, rng.choice(["a", "b"]), rng.randrange(150) * DAY, float(rng.randrange(1, 9))) for i in range(200)]
    df = spark.createDataFrame(data, "id long, k string, t long, v double")
    mean = lambda x: sum(x) / len(x) if x else None
    got = {r["id"]: r for r in velocity.drift(velocity.share_shift(velocity.escalation(df, "k", "t", "v"), "k", "t", "id", F.col("v") > 4), "k", "t", "v").collect()}
    for i, k, t, v in data:
        own = [(s, x) for _, kk, s, x in data if kk == k]
        part = lambda far, near: [x for s, x in own if t - far <= s <= t - near]
        assert got[i]["escalation"] == pytest.approx(max(part(DAY, 0)) / max(mean(part(30 * DAY, 1)) or 1.0, 1.0)) and got[i]["vs_week_max"] == v / max(part(7 * DAY, 0))
        assert got[i]["share_shift"] == pytest.approx(mean([x > 4 for x in part(7 * DAY, 0)]) - mean([x > 4 for s, x in own if s <= t]))
        new, old = mean(part(30 * DAY, 1)), mean(part(90 * DAY, 60 * DAY))
        assert got[i]["drift"] == (None if new is None or old is None else pytest.approx(new - old))
