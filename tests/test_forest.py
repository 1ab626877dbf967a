"""Isolation forests against loops and planted outliers; stacked models against leaks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boosting, forest, metrics, stacking


def test_forest_finds_planted_outliers(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2), None if i % 11 == 0 else rng.random(), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    model = forest.fit_forest(df, ["a", "b", "c"], "id", trees=60)
    again = forest.fit_forest(df.repartition(7), ["a", "b", "c"], "id", trees=60)
    assert model.trees == again.trees and len(model.trees) == 60
    held = [(i, rng.gauss(0, 1), rng.gauss(5, 2), rng.random(), 0) for i in range(400)] + [(400 + i, rng.choice([-1, 1]) * rng.uniform(4, 9), rng.uniform(-20, 30), 0.5, 1) for i in range(40)]
    scored = forest.score_forest(spark.createDataFrame(held, df.schema), model, "score").collect()
    assert metrics.roc_auc(spark.createDataFrame(scored)).first()["auc"] > 0.95

    def path(tree, x):
        column, cut, left, length = tree
        node = 0
        while column[node] >= 0:
            v = x[column[node]]
            node = left[node] if v is not None and v < cut[node] else left[node] + 1
        return length[node]

    for r in scored[:50]:
        mean = sum(path(t, (r["a"], r["b"], r["c"])) for t in model.trees) / 60
        assert r["score"] == pytest.approx(2 ** (-mean / forest.mean_path(256)))
    assert forest.mean_path(2) == 1 and forest.mean_path(256) == pytest.approx(10.24, abs=0.01)


def test_forest_leaves_and_cases(spark):
    """Leaves tell how many rows stopped there: with their sizes, paths add up; few, equal and no rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (64, 2))
    column, cut, left, length = forest.grow(x, 3)
    at = np.zeros(64, int)
    depth = np.zeros(64, int)
    while (inner := np.array(column)[at] >= 0).any():
        for i in np.flatnonzero(inner):
            at[i] = left[at[i]] + (not x[i, column[at[i]]] < cut[at[i]])
            depth[i] += 1
    for leaf in set(at):
        assert length[leaf] == pytest.approx(depth[at == leaf][0] + forest.mean_path(int((at == leaf).sum()))) and depth[at == leaf][0] <= 6
    df = spark.createDataFrame([(i, 1.0, None) for i in range(5)], "id long, a double, b double")
    model = forest.fit_forest(df, ["a", "b"], "id", trees=3)
    assert all(t[0] == [-1] for t in model.trees) and forest.score_forest(df, model).columns == ["id", "a", "b", "isolation"]
    none = forest.fit_forest(df.limit(0), ["a"], "id", trees=3)
    assert none.trees == [] and forest.score_forest(df, none).where("isolation = 1").count() == 5


def test_stacking_never_scores_a_seen_row(spark):
    rng = random.Random(4)
    rows = [(i, a := rng.gauss(0, 1), b := rng.gauss(0, 1), int(a + b + rng.gauss(0, 0.5) > 0.7), ("train", "train", "val", "oot")[i % 4]) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label int, split string")
    how = {"rounds": 8, "depth": 2, "rate": 0.4}
    out, models, top = stacking.stack(df, "row_id", {"by_a": ["a"], "by_b": ["b"]}, folds=3, first=how, second={"rounds": 12, "rate": 0.4})
    got = {r["row_id"]: r for r in out.withColumn("fold", stacking.fold_of("row_id", 3)).collect()}
    assert len(got) == 1200 and top.columns == ["by_a", "by_b"]
    # a training row's score is that of the model of its fold, which is the model fitted without that fold
    for fold in range(3):
        alone = boosting.fit_booster(df.where((F.col("split") == "val") | ((F.col("split") == "train") & (stacking.fold_of("row_id", 3) != fold))), ["a"], **how)
        assert [t.value for t in alone.trees] == [pytest.approx(t.value) for t in models["by_a"][fold].trees]
    for i, a, _, _, split in rows[:200]:
        each = [1 / (1 + math.exp(-m.margins(m.bins([np.array([a])]))[0])) for m in models["by_a"]]
        assert got[i]["by_a"] == pytest.approx(each[got[i]["fold"]] if split == "train" else sum(each) / 3)
    ap = lambda score: metrics.average_precision(out.where("split = 'oot'"), score=score).first()["auprc"]
    assert ap("score") > max(ap("by_a"), ap("by_b")) + 0.05
    assert stacking.score_folds(out.limit(0).withColumn("f", F.lit(0)), models["by_a"], "f", "x").count() == 0
