"""Metrics of scored rows (label, score): areas, thresholds, intervals, stability, the composite score."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import auc, prefix_sums, psi

WEIGHTS = {"auprc": 0.50, "precision": 0.25, "psi": 0.10, "train_psi": 0.05, "ci": 0.05, "gap": 0.05}
RAMPS = {"psi": (0.10, 0.25), "train_psi": (0.10, 0.25), "ci": (0.02, 0.10), "gap": (0.03, 0.15)}
HARD_PSI = 0.25


def by_threshold(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, score, p, k, p_run, k_run): positives and rows at each score, and from the top down to it."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(score).isNotNull()).select(*by, F.lit(0).alias("one_group"), F.col(score), F.col(label), *([F.col(weight)] if weight else []))
    counts = rows.groupBy(*by, "one_group", F.col(score).alias("score")).agg(F.sum(w * F.col(label)).alias("p"), F.sum(w).alias("k")).where("k > 0")
    return prefix_sums(counts, "score", ["p", "k"], [*by, "one_group"], descending=True).drop("one_group")


def average_precision(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, auprc): precision at each distinct score weighted by the recall it adds; null without positives."""
    by = by or []
    run = by_threshold(df, label, score, by, weight)
    whole = run.groupBy(*by).agg(F.sum(F.col("p") * F.col("p_run") / F.col("k_run")).alias("s"), F.sum("p").alias("np"))
    return whole.select(*by, (F.col("s") / F.when(F.col("np") > 0, F.col("np"))).alias("auprc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    by = by or []
    rows = df.select(*by, F.lit("score").alias("column"), F.col(score).alias("value"), F.col(label).alias("label"))
    return auc(rows, [*by, "column"]).drop("column")


def precision_at_recall(df: DataFrame, recall: float, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by, precision, threshold, recall): the best precision at which the recall is reached, at the lowest threshold
    of equals; precision 0 at threshold 0.5 without positives."""
    by = by or []
    run = by_threshold(df, label, score, by)
    total = run.groupBy(*by).agg(F.sum("p").alias("np"))
    run = run.join(total, by) if by else run.crossJoin(F.broadcast(total))
    got = F.col("p_run") / F.when(F.col("np") > 0, F.col("np"))
    best = F.max(F.when(got >= recall, F.struct((F.col("p_run") / F.col("k_run")).alias("precision"), (-F.col("score")).alias("t"), got.alias("recall"))))
    return run.groupBy(*by).agg(best.alias("b")).select(*by, F.coalesce("b.precision", F.lit(0.0)).alias("precision"), F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"), F.coalesce("b.recall", F.lit(0.0)).alias("recall"))


def confusion(df: DataFrame, threshold: Column | float, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Counts, false positive rate and review burden (flagged rows a positive) at a threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    flag, y = F.col(score) >= t, F.col(label) == 1
    c = df.groupBy(*(by or [])).agg(F.count_if(flag & y).alias("tp"), F.count_if(flag & ~y).alias("fp"), F.count_if(~flag & y).alias("fn"), F.count_if(~flag & ~y).alias("tn"))
    return c.withColumns({"fpr": F.col("fp") / F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") + F.col("tn")), "review_burden": (F.col("tp") + F.col("fp")) / F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") + F.col("fn"))})


def recall_at_fpr(df: DataFrame, fpr: float, label: str = "label", score: str = "score") -> DataFrame:
    run = by_threshold(df, label, score)
    total = run.agg(F.sum("p").alias("np"), F.sum(F.col("k") - F.col("p")).alias("nq"))
    ok = (F.col("k_run") - F.col("p_run")) <= fpr * F.col("nq")
    return run.crossJoin(F.broadcast(total)).agg(F.coalesce(F.max(F.when(ok, F.col("p_run") / F.col("np"))), F.lit(0.0)).alias("recall"))


def lift(df: DataFrame, share: float = 0.1, label: str = "label", score: str = "score") -> DataFrame:
    """Positives' rate among the first rows that make up at least `share` of all, over the rate of all."""
    run = by_threshold(df, label, score)
    total = run.agg(F.sum("p").alias("np"), F.sum("k").alias("n"))
    first = F.min_by(F.col("p_run") / F.col("k_run"), F.when(F.col("k_run") >= share * F.col("n"), F.col("k_run")))
    return run.crossJoin(F.broadcast(total)).agg((first / (F.max("np") / F.max("n"))).alias("lift"))


def brier(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def gini_by(df: DataFrame, by: str, label: str = "label", score: str = "score") -> DataFrame:
    """(by, gini): twice the area less one, by period, for its stability."""
    return roc_auc(df, label, score, [by]).select(by, (2 * F.col("auc") - 1).alias("gini"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same on every run, partitioning and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def poisson(mean: Column, *seed: Column) -> Column:
    """A Poisson number of a whole mean, from the seed: by its distribution function up to 30, then a rounded normal."""
    u, v = uniform(F.lit("u"), *seed), uniform(F.lit("v"), *seed)
    longest = (mean + 8 * F.sqrt(mean.cast("double")) + 12).cast("int")
    start = F.struct(F.exp(-mean.cast("double")).alias("p"), F.exp(-mean.cast("double")).alias("c"), F.lit(0).alias("w"))

    def further(acc: Column, j: Column) -> Column:
        p = acc["p"] * mean / j
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["w"] + (acc["c"] <= u).cast("int")).alias("w"))

    counted = F.aggregate(F.sequence(F.lit(1), longest), start, further, lambda acc: acc["w"])
    bell = F.sqrt(-2 * F.log(1 - v)) * F.cos(2 * math.pi * u)
    rounded = F.greatest(F.floor(F.round(mean + F.sqrt(mean.cast("double")) * bell + 0.5, 6)), F.lit(0))
    return F.when(mean <= 0, 0).when(mean <= 30, counted).otherwise(rounded).cast("long")


def bootstrap_ci(df: DataFrame, label: str = "label", score: str = "score", n: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high) of the average precision over n resamples.

    A resample draws each row a Poisson(1) number of times, so the rows of one score and label, k of them, are drawn
    Poisson(k) times: scores are resampled, not rows, and the work goes by distinct scores times n. 0 without positives.
    """
    rows = df.where(F.col(score).isNotNull()).groupBy(F.lit(0).alias("one_group"), F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("k"), F.lit(1).alias("one"))
    placed = prefix_sums(rows, "score", ["one"], ["one_group"], descending=True).select(F.col("one_run").alias("place"), "p", "k")
    drawn = placed.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    of = lambda mean, name: poisson(mean, F.lit(seed), F.lit(name), F.col("place"), F.col("replicate"))
    drawn = drawn.select("replicate", "place", of(F.col("p"), "p").alias("wp"), of(F.col("k") - F.col("p"), "n").alias("wn"))
    run = prefix_sums(drawn.select("replicate", "place", "wp", (F.col("wp") + F.col("wn")).alias("wk")).where("wk > 0"), "place", ["wp", "wk"], ["replicate"])
    ap = run.groupBy("replicate").agg((F.sum(F.col("wp") * F.col("wp_run") / F.col("wk_run")) / F.when(F.sum("wp") > 0, F.sum("wp"))).alias("auprc")).where(F.col("auprc").isNotNull())
    a = (1 - level) / 2
    return ap.agg(F.coalesce(F.percentile("auprc", F.lit(a)), F.lit(0.0)).alias("low"), F.coalesce(F.percentile("auprc", F.lit(1 - a)), F.lit(0.0)).alias("high"))


def score_psi(expected: DataFrame, actual: DataFrame, score: str = "score") -> DataFrame:
    return psi(expected.select(score), actual.select(score), [score]).select("psi")


def ramp(value: float, start: float, full: float) -> float:
    return 0.0 if value <= start or full <= start else min(1.0, (value - start) / (full - start))


def composite_score(auprc: float, precision: float, psi: float, train_psi: float = 0.0, ci: float = 0.0, gap: float = 0.0, config: Mapping[str, Any] | None = None) -> tuple[float, bool]:
    """(score, rejected): quality less ramped penalties; a shifted score distribution rejects outright."""
    config = config or {}
    weights, ramps = WEIGHTS | config.get("weights", {}), RAMPS | config.get("ramps", {})
    if psi >= config.get("hard_psi", HARD_PSI):
        return 0.0, True
    values = {"psi": psi, "train_psi": train_psi, "ci": ci, "gap": gap}
    return weights["auprc"] * auprc + weights["precision"] * precision - sum(weights[k] * ramp(v, *ramps[k]) for k, v in values.items()), False


def composite_column(auprc: Column, precision: Column, psi: Column, train_psi: Column, ci: Column, gap: Column) -> Column:
    """The same as a column, with the default weights."""
    score = WEIGHTS["auprc"] * auprc + WEIGHTS["precision"] * precision
    for k, v in (("psi", psi), ("train_psi", train_psi), ("ci", ci), ("gap", gap)):
        a, b = RAMPS[k]
        score = score - WEIGHTS[k] * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - a) / (b - a)))
    return F.when(psi >= HARD_PSI, 0.0).otherwise(score)


def rank_average(df: DataFrame, row_id: str, scores: list[str], name: str = "ensemble") -> DataFrame:
    """Mean over models of each row's average rank share: a prefix sum of counts by score, no global window."""
    out = df
    total = df.agg(F.count(F.lit(1)).alias("ra_total"))
    parts = []
    for i, s in enumerate(scores):
        counts = df.groupBy(F.lit(0).alias("one_group"), F.col(s).alias("v")).agg(F.count(F.lit(1)).alias("k"))
        run = prefix_sums(counts, "v", ["k"], ["one_group"]).select(F.col("v").alias(f"ra_v{i}"), (F.col("k_run") - (F.col("k") - 1) / 2).alias(f"ra_r{i}"))
        out = out.join(run, F.col(s) == F.col(f"ra_v{i}"), "left").drop(f"ra_v{i}")
        parts.append(F.col(f"ra_r{i}"))
    out = out.crossJoin(F.broadcast(total))
    mean = sum(parts[1:], parts[0]) / F.lit(float(len(scores))) / F.col("ra_total")
    return out.withColumn(name, mean).drop("ra_total", *(f"ra_r{i}" for i in range(len(scores))))


def overfit_report(train: DataFrame, val: DataFrame, features: list[str], label: str = "label", score: str = "score", top: int = 15, shifted: float = 0.10) -> DataFrame:
    """(metric, value): areas of both sides and their gap, the scores' stability, and the stability of those of the first
    `top` features that shifted."""
    a, b = (roc_auc(x, label, score).select(F.coalesce("auc", F.lit(0.5)).alias(n)) for x, n in ((train, "auroc_train"), (val, "auroc_val")))
    areas = a.crossJoin(b).withColumn("auroc_gap", F.col("auroc_train") - F.col("auroc_val")).crossJoin(score_psi(train, val, score).select(F.col("psi").alias("score_psi")))
    long = areas.unpivot([], ["auroc_train", "auroc_val", "auroc_gap", "score_psi"], "metric", "value")
    by_feature = psi(train, val, features[:top]).where(F.col("psi") > shifted).select(F.concat(F.lit("psi:"), "column").alias("metric"), F.col("psi").alias("value"))
    return long.unionByName(by_feature)


def keep_rule(new: Column, best: Column, rejected: Column, least_gain: float = 0.001) -> Column:
    return F.when(rejected, "reject_psi").when(best.isNull() | (new > best + least_gain), "keep").otherwise("discard")
