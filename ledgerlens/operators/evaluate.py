"""A whole evaluation as one function: split rows through the fit and transform contract to metrics, a decision and a record."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import numeric_columns
from ..sources.scratch import written
from . import boosting, metrics, snapshots, validate
from .pipeline import run_plan


def evaluate(plan: Any, df: DataFrame, row_id: str, label: str = "label", config: dict[str, Any] | None = None) -> dict[str, Any]:
    """Fits the plan on `train`, transforms all splits without their labels, checks the features, trains boosted trees that stop
    by the average precision of `val`, and measures all splits.

    `config`: `features` (columns; all numeric ones by default), `model` (arguments of `fit_booster`), `recall`, `checks`
    (arguments of `validate`), `metrics` (weights and limits of the composite score). A failed check ends it: `error` is
    `checks` and `messages` say why.
    """
    config = config or {}
    rows, state = run_plan(plan, df, row_id, label, config)
    rows = written(df.sparkSession, rows, "evaluation")
    features = config.get("features") or numeric_columns(rows, without=(label, row_id))
    parts = {s: rows.where(F.col("split") == s) for s in ("train", "val", "oot")}
    passed, messages = validate.validate({s: x.select(*features, label) for s, x in parts.items()}, label, **config.get("checks", {}))
    if not passed:
        return {"error": "checks", "messages": messages}
    leaking = [r["column"] for r in validate.leaks(parts["train"], label, features).collect()]
    model = boosting.fit_booster(rows, features, label, **config.get("model", {}))
    scored = written(df.sparkSession, boosting.score_booster(rows, model), "scores")
    own = {s: scored.where(F.col("split") == s) for s in parts}
    out: dict[str, Any] = {"n_features": len(features), "leakage_warnings": leaking, "rounds": len(model.trees)}
    for s, suffix in (("train", "_train"), ("val", "_val"), ("oot", "")):
        out[f"auprc{suffix}"] = metrics.average_precision(own[s], label).first()["auprc"] or 0.0
        out[f"auroc{suffix}"] = (metrics.roc_auc(own[s], label).first() or {"auc": None})["auc"] or 0.5
        out[f"precision_at_recall{suffix}"] = metrics.precision_at_recall(own[s], config.get("recall", 0.5), label).first()["precision"]
    ci = metrics.bootstrap_ci(own["val"], label, n=config.get("resamples", 200)).first()
    shift = lambda a, b: metrics.score_psi(own[a], own[b]).first()[-1] or 0.0
    out |= {"auprc_val_ci": [ci["low"], ci["high"]], "ci_width_val": ci["high"] - ci["low"], "psi": shift("train", "oot"), "train_val_psi": shift("train", "val"), "auroc_train_val_gap": out["auroc_train"] - out["auroc_val"]}
    score, rejected = metrics.composite_score(out["auprc_val"], out["precision_at_recall_val"], out["psi"], out["train_val_psi"], out["ci_width_val"], out["auroc_train_val_gap"], config.get("metrics"))
    return out | {"composite_score": score, "psi_rejected": rejected, "top_features": model.importance(), "model": model, "state": state}


def decision(result: dict[str, Any], best: float | None, least_gain: float = 0.001) -> str:
    """crash, reject_psi, keep or discard, against the best kept composite score."""
    if "error" in result:
        return "timeout" if result["error"] == "timeout" else "crash"
    if result["psi_rejected"]:
        return "reject_psi"
    return "keep" if best is None or result["composite_score"] > best + least_gain else "discard"


def run_experiment(plan: Any, df: DataFrame, root: str, dataset: str, hypothesis: str, row_id: str, label: str = "label", config: dict[str, Any] | None = None) -> dict[str, Any]:
    """Evaluates, decides against the best kept record of the data set in the log of `root`, records, and returns the record."""
    spark = df.sparkSession
    result = evaluate(plan, df, row_id, label, config)
    kept = [r for r in snapshots.history(spark, root) if r["dataset"] == dataset and r["status"] == "keep"]
    best = kept[-1]["metrics_summary"].get("composite_score") or 0.0 if kept else None
    summary = {k: v for k, v in result.items() if k not in ("model", "state", "top_features", "messages")}
    more = {"leakage_warnings": result.get("leakage_warnings", []), "messages": result.get("messages", [])}
    return snapshots.save(spark, root, dataset, hypothesis, decision(result, best, (config or {}).get("least_gain", 0.001)), summary, importances=result.get("top_features"), **more)
