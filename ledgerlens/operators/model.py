"""Gradient-boosted trees on assembled features, class weights, importances, subsampled ensembles."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import numeric_columns


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds `weight`: negatives over positives for positives, 1 for the rest; from a one-row aggregate."""
    w = df.agg((F.sum(1 - F.col(label)) / F.greatest(F.sum(label), F.lit(1))).alias("pos_weight"))
    return df.crossJoin(F.broadcast(w)).withColumn("weight", F.when(F.col(label) == 1, F.col("pos_weight")).otherwise(1.0)).drop("pos_weight")


def assembled(df: DataFrame, features: list[str], fill: float = -1.0) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fill)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def train_and_evaluate(df: DataFrame, config: dict[str, Any] | None = None, features: list[str] | None = None, label: str = "label", split: str = "split") -> tuple[DataFrame, Any]:
    """Fits on `train`, stops by the loss on `val`, and returns all rows with `score`, and the model."""
    config = config or {}
    features = features or numeric_columns(df, without=(label,))
    rows = class_weight(assembled(df, features, config.get("fill", -1.0)), label).withColumn("is_val", F.col(split) == "val")
    gbt = GBTClassifier(
        labelCol=label, weightCol="weight", validationIndicatorCol="is_val", maxDepth=config.get("max_depth", 5), maxIter=config.get("trees", 40), stepSize=config.get("rate", 0.1),
        subsamplingRate=config.get("subsample", 0.8), featureSubsetStrategy=str(config.get("columns", "0.8")), seed=config.get("seed", 42),
    )
    model = gbt.fit(rows.where(F.col(split).isin("train", "val")))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction", "is_val", "weight"), model


def importances(spark, model: Any, features: list[str], top: int = 20) -> DataFrame:
    rows = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows[:top], "feature string, importance double")


def subsampled_ensemble(df: DataFrame, ratios: tuple[int, ...] = (3, 10, 30), config: dict[str, Any] | None = None, features: list[str] | None = None, label: str = "label", seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Mean score of models that see all positives and so many negatives a positive, drawn by row."""
    features = features or numeric_columns(df, without=(label,))
    share = df.where("split = 'train'").agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q")).first()
    scored = df
    for i, r in enumerate(ratios):
        keep = min(1.0, r * (share["p"] or 0) / max(1, share["q"] or 0))
        draw = F.pmod(F.xxhash64(F.lit(seed + i), row_id), F.lit(1 << 30)) < int(keep * (1 << 30))
        part = df.where((F.col("split") != "train") | (F.col(label) == 1) | draw)
        _, model = train_and_evaluate(part, (config or {}) | {"seed": seed + i}, features, label)
        scored = model.transform(assembled(scored, features)).withColumn(f"s{i}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    mean = reduce(lambda a, b: a + b, (F.col(f"s{i}") for i in range(len(ratios)))) / float(len(ratios))
    return scored.withColumn("score", mean).drop(*(f"s{i}" for i in range(len(ratios))))


def benchmark(df: DataFrame, derived: list[str], label: str = "label", config: dict[str, Any] | None = None) -> dict[str, float]:
    """Average precision on oot of all numeric columns and of those without the derived ones, nulls as -999."""
    from .metrics import average_precision

    out, everything = {}, numeric_columns(df, without=(label,))
    for name, features in (("full", everything), ("stripped", [c for c in everything if c not in derived])):
        scored, _ = train_and_evaluate(df, (config or {}) | {"fill": -999.0}, features, label)
        out[name] = average_precision(scored.where("split = 'oot'"), label).first()["auprc"] or 0.0
    return out | {"gap": out["full"] - out["stripped"]}
