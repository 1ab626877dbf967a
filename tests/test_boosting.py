"""Histogram boosting against a booster of plain loops, and its losses against numeric derivatives."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boosting, metrics


def table(spark, n=400, seed=3, telling=0.0):
    """Two numbers and a noisy label; with `telling`, a null of `a` makes the label likelier."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.choice([None, rng.randrange(12) / 2, *([-1.0, -1.0] if telling else [])]), rng.choice([math.nan, None, *(rng.random() for _ in range(6))])
        z = (a or 0) - (1 if telling else 3) + (telling if a is None else 0) + (2 if b is not None and b > 0.6 else 0) + rng.gauss(0, 1)
        rows.append((i, a, b, 7.0, int(z > 0.5), "train" if i % 4 else "val"))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, label int, split string")


@pytest.mark.parametrize("loss, value", [(boosting.logistic, lambda q, y: -math.log(q)), (boosting.focal(2.0, 0.25), lambda q, y: -(0.25 if y else 0.75) * (1 - q) ** 2 * math.log(q)), (boosting.focal(0.5, 0.6), lambda q, y: -(0.6 if y else 0.4) * (1 - q) ** 0.5 * math.log(q))])
def test_derivatives(loss, value):
    at = lambda m, y: value(boosting.sigmoid(np.array(m if y else -m)).item(), y)
    for m in (-3.0, -0.4, 0.0, 0.7, 2.5):
        for y in (0, 1):
            e = 1e-4
            first, second = (x.item() for x in loss(np.array([m]), np.array([float(y)])))
            assert first == pytest.approx((at(m + e, y) - at(m - e, y)) / (2 * e), abs=1e-6)
            numeric = (at(m + e, y) - 2 * at(m, y) + at(m - e, y)) / e**2
            assert second == pytest.approx(max(numeric, 1e-9), abs=1e-5)


def loops(rows, model, trees, depth, rate, l2, least, weight):
    """Margins of all rows by trees grown node by node, every split tried."""
    data = [([0 if x is None or math.isnan(x) else 1 + sum(e <= x for e in edges) for x, edges in zip(r[1:4], model.edges)], r[4], r[5]) for r in rows]
    margin = [model.base] * len(data)
    for _ in range(trees):
        stats = []
        for (_, y, part), m in zip(data, margin):
            p = 1 / (1 + math.exp(-m))
            w = (weight if y else 1) * (part == "train")
            stats.append((w * (p - y), w * p * (1 - p)))
        total = lambda at: (sum(stats[i][0] for i in at), sum(stats[i][1] for i in at))
        part_of = lambda s: s[0] ** 2 / (s[1] + l2)

        def place(at, level):
            g, h = total(at)
            best = None
            for nulls in (True, False):
                for c in range(3):
                    for cut in range(1, 64):
                        left = [i for i in at if (nulls if data[i][0][c] == 0 else data[i][0][c] <= cut)]
                        a, b = total(left), total(set(at) - set(left))
                        if a[1] < least or b[1] < least:
                            continue
                        gain = part_of(a) + part_of(b) - part_of((g, h))
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-8):
                            best = (gain, left)
            if level == depth or best is None:
                for i in at:
                    margin[i] += -rate * g / (h + l2)
            else:
                place(best[1], level + 1)
                place([i for i in at if i not in set(best[1])], level + 1)

        place(list(range(len(data))), 0)
    return margin


def test_booster_equals_loops(spark):
    rows, df = table(spark, 120)
    model = boosting.fit_booster(df, ["a", "b", "c"], rounds=4, depth=2, rate=0.3, l2=1.5, least_weight=0.5, class_weight=2.0, keep=2, every=100)
    got = {r["id"]: r["score"] for r in boosting.score_booster(df, model).collect()}
    want = loops(rows, model, 4, 2, 0.3, 1.5, 0.5, 2.0)
    assert len(model.trees) == 4 and all(got[r[0]] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-9) for r, m in zip(rows, want))
    assert sum(model.importance().values()) > 0 and model.importance()["c"] == 0


def test_nulls_and_early_stop(spark):
    """Nulls that tell the label are worth more than the -1 that stands for them; the stop keeps the best round of `val`."""
    _, df = table(spark, 1500, 5, telling=3.0)
    how = {"rounds": 40, "depth": 3, "rate": 0.2, "patience": 15, "every": 5}
    ap = lambda x: metrics.average_precision(x.where("split = 'val'")).first()["auprc"]
    filled = df.withColumn("a", F.coalesce("a", F.lit(-1.0)))
    model = boosting.fit_booster(df, ["a", "b"], **how)
    own, plain = ap(boosting.score_booster(df, model)), ap(boosting.score_booster(filled, boosting.fit_booster(filled, ["a", "b"], **how)))
    assert own > plain + 0.02
    assert own == pytest.approx(max(x for _, x in model.history)) and len(model.trees) == max(model.history, key=lambda x: (x[1], -x[0]))[0]
    focal = boosting.fit_booster(df, ["a", "b"], loss=boosting.focal(), rounds=10, depth=2)
    assert ap(boosting.score_booster(df, focal)) > 0.5


def test_cases(spark):
    _, df = table(spark, 60)
    one = boosting.fit_booster(df.where("label = 1"), ["a"], rounds=3)
    assert one.trees == [] and boosting.score_booster(df, one).where("score > 0.99").count() == 60
    assert boosting.score_booster(df.limit(0), one).count() == 0 and boosting.score_booster(df, one).columns == [*df.columns, "score"]
    nothing = boosting.fit_booster(df.limit(0), ["a"], rounds=3)
    assert boosting.score_booster(df, nothing).select("score").distinct().first()["score"] == 0.5
    flat = boosting.fit_booster(df.withColumn("split", F.lit("train")), ["c"], rounds=2)
    assert all(t.column == [-1] for t in flat.trees)


def test_poisson_numbers(spark):
    for mean in (1, 7, 30, 400):
        r = spark.range(4000).select(metrics.poisson(F.lit(mean), F.lit("s"), F.col("id")).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.min("w").alias("lo")).first()
        assert r["m"] == pytest.approx(mean, rel=0.06) and r["v"] == pytest.approx(mean, rel=0.12) and r["lo"] >= 0
    assert spark.range(3).select(metrics.poisson(F.lit(0), F.col("id")).alias("w")).agg(F.max("w")).first()[0] == 0


def test_whole_evaluation(spark, tmp_path):
    """Load, fit, transform, check, train, measure, decide, record: the first run is kept, the same again is not, a broken one
    crashes, and the log tells all three."""
    from types import SimpleNamespace

    from ledgerlens.operators import evaluate, snapshots
    from ledgerlens.operators.pipeline import FittedState

    rng = random.Random(1)
    rows = [(i, x := rng.gauss(0, 1), rng.choice("pq"), int(x + rng.gauss(0, 0.7) > 0.8), ("train", "train", "val", "oot")[i % 4]) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string, label int, split string")
    seen = {}

    def fit(history, labels, config):
        seen["fit"] = (history.columns, history.select("split").distinct().collect()[0][0])
        return FittedState({"rates": history.join(labels, "row_id").groupBy("c").agg(F.avg("label").alias("rate"))})

    def transform(x, state, config):
        assert "label" not in x.columns
        return x.join(state.tables["rates"], "c", "left").select("row_id", "split", "x", "rate")

    plan, root = SimpleNamespace(fit=fit, transform=transform), str(tmp_path / "runs")
    config = {"model": {"rounds": 10, "depth": 2, "rate": 0.3}, "resamples": 20, "metrics": {"hard_psi": 5.0}}
    run = lambda p, words: evaluate.run_experiment(p, df, root, "d", words, "row_id", config=config)
    first = run(plan, "Rates by class")
    assert first["status"] == "keep" and first["parent_exp"] is None and list(first["top_features"])[0] == "x" and "label" not in seen["fit"][0] and seen["fit"][1] == "train"
    m = first["metrics_summary"]
    assert 0.5 < m["auroc"] <= 1 and m["auprc_val_ci"][0] <= m["auprc_val"] <= m["auprc_val_ci"][1] and m["n_features"] == 2
    assert run(plan, "The same again")["status"] == "discard"
    broken = SimpleNamespace(fit=fit, transform=lambda x, state, config: transform(x, state, config).withColumn("rate", F.lit(None).cast("double")))
    last = run(broken, "All null")
    assert last["status"] == "crash" and "null rates" in last["messages"][-1]
    assert [r["status"] for r in snapshots.history(spark, root)] == ["keep", "discard", "crash"] and snapshots.best_kept(spark, root) == "exp_001"
    assert evaluate.decision({"psi_rejected": True}, None) == "reject_psi"
