import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import risk, sequence, splits, velocity
from ledgerlens.schema import DAY, HOUR


def rows(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 2, 3, None]), rng.randrange(40) * HOUR // 2, float(rng.randrange(100))) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, e int, t long, v double")


def brute(data, w, ties):
    out = {}
    for i, e, t, _ in data:
        def counts(j, f, u):
            if f is None or f != e or u < t - w or u > t:
                return False
            return u < t or (ties == "prior" and j < i) or ties == "inclusive"

        inside = [v for j, f, u, v in data if counts(j, f, u)]
        out[i] = (len(inside), sum(inside))
    return out


@pytest.mark.parametrize("ties", ["prior", "strict", "inclusive"])
@pytest.mark.parametrize("spread", [False, True])
def test_velocity_is_exact(spark, ties, spread):
    data = rows()
    out = velocity.velocity(frame(spark, data), "e", "t", "v", "id", {"a": HOUR, "b": 6 * HOUR}, ties=ties, spread=spread)
    got = {r["id"]: r for r in out.collect()}
    for name, w in (("a", HOUR), ("b", 6 * HOUR)):
        expected = brute(data, w, ties)
        for i, (n, s) in expected.items():
            assert got[i][f"e_{name}_count"] == n
            assert got[i][f"e_{name}_sum"] == pytest.approx(s)


def test_later_rows_change_nothing(spark):
    data = rows(150)
    later = data + [(1000 + i, e, t + 400 * HOUR, v) for i, e, t, v in data]
    one = {r["id"]: tuple(r) for r in velocity.velocity(frame(spark, data), "e", "t", "v", "id").collect()}
    two = {r["id"]: tuple(r) for r in velocity.velocity(frame(spark, later), "e", "t", "v", "id").collect()}
    assert all(two[i] == x for i, x in one.items())


def test_empty_and_single(spark):
    assert velocity.velocity(frame(spark, []), "e", "t", "v", "id").count() == 0
    r = velocity.velocity(frame(spark, [(1, 1, 5, 2.0)]), "e", "t", "v", "id").first()
    assert r["e_1h_count"] == 0 and r["e_1h_sum"] == 0.0


def test_rolling_rate_matches_brute_force(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(4), rng.randrange(60) * DAY + 5, rng.randrange(2)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, k int, t long, y int")
    g = sum(y for *_, y in data) / len(data)
    got = {r["id"]: r["rate_28d"] for r in risk.rolling_rate(df, df, "k", "t", "y").collect()}
    for i, k, t, _ in data:
        past = [y for _, kk, u, y in data if kk == k and t // DAY - 28 <= u // DAY <= t // DAY - 1]
        assert got[i] == pytest.approx((sum(past) + 10 * g) / (len(past) + 10))


def test_cusum_matches_the_loop(spark):
    data = [r for r in rows(120, 5) if r[1] is not None]
    df = frame(spark, data)
    base = sequence.cusum_baseline(df, "e", "t", "id", "v")
    stats = {r["e"]: (r["mu"], r["sigma"]) for r in base.collect()}
    got = {r["id"]: r["cusum"] for r in sequence.cusum(df, base, "e", "t", "id", "v").collect()}
    for e in (1, 2, 3):
        s = 0.0
        for i, _, _, v in sorted((r for r in data if r[1] == e), key=lambda r: (r[2], r[0])):
            s = max(0.0, s + (v - stats[e][0]) / stats[e][1] - 0.5)
            assert got[i] == pytest.approx(s, abs=1e-9)


def test_new_best_and_ewma(spark):
    r = spark.range(1).select(sequence.new_best(F.array(*map(F.lit, (0.1, 0.1004, 0.2, 0.15)))).alias("b")).first()
    assert r["b"] == [True, False, True, False]
    got = {r["e"]: r["ewma"] for r in sequence.ewma(frame(spark, rows(90, 8)), "e", "t", "id", "v", 0.4, most=10).collect()}
    want = {}
    for _, e, _, v in sorted(rows(90, 8), key=lambda r: (r[2], r[0])):
        want[e] = 0.4 * v + 0.6 * want[e] if e in want else v
    assert got == pytest.approx(want)


def test_splits(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(101)], "id long, t double")
    n = {r["split"]: r["n"] for r in splits.quantile_split(df, "t").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 71, "val": 15, "oot": 15}
    assert splits.quantile_split(df.limit(0), "t").count() == 0
