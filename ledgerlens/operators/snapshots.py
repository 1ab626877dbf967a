"""Snapshots of experiments in a shared folder: a folder each, and an append-only index that tells the best kept one."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from ..sources.shared_log import SharedFolder, SharedLog
from ..sources.sinks import clean


def folder_name(number: int, hypothesis: str, longest: int = 40) -> str:
    """`exp_007_name`, the name by the rule of `text.sanitized`."""
    kept = filter(lambda c: c.isalnum() or c in "-_ ", hypothesis)
    words = "".join(kept).strip().split(" ")
    return f"exp_{number:03d}_{'_'.join(words)[:longest].rstrip('_').lower()}"


def history(spark: SparkSession, root: str) -> list[dict[str, Any]]:
    """The index records in the order of their numbers."""
    return [json.loads(text) for text in SharedLog(spark, f"{root}/index").texts()]


def save(spark: SparkSession, root: str, dataset: str, hypothesis: str, status: str, metrics: dict[str, Any], code: list[str] | None = None, importances: dict[str, float] | None = None, top: int = 10, **more: Any) -> dict[str, Any]:
    """Stores one run in a shared folder and returns its index record; a kept run becomes the best one. Runs that are stored at
    once get numbers of their own."""
    files, made = SharedFolder(spark, root), {}
    best = sorted((importances or {}).items(), key=lambda x: (-x[1], x[0]))[:top]

    def record(number: int) -> str:
        name = folder_name(number, hypothesis)
        made.update(clean({"id": f"exp_{number:03d}", "dir": name, "dataset": dataset, "hypothesis": hypothesis, "status": status, "seq": number, "parent_exp": best_kept(spark, root), "metrics_summary": metrics, "top_features": dict(best), **more}))
        # the folder stands before the index tells of it
        for path in code or []:
            files.put(path, name)
        files.write(f"{name}/metrics.json", json.dumps(clean(metrics), indent=1))
        files.write(f"{name}/metadata.json", json.dumps(made, indent=1))
        return json.dumps(made) + "\n"

    SharedLog(spark, f"{root}/index").append(record)
    files.write("summary.json", json.dumps(clean(summary(history(spark, root))), indent=1))
    return made


def summary(records: list[dict[str, Any]], metric: str = "composite_score") -> dict[str, dict[str, Any]]:
    """By data set: runs, kept and discarded ones, the best kept score, the first kept one, and the gain in percent."""
    out: dict[str, dict[str, Any]] = {}
    for r in sorted(records, key=lambda r: r["seq"]):
        d = out.setdefault(r["dataset"], {"total": 0, "kept": 0, "best": None, "baseline": None})
        d["total"] += 1
        score = (r.get("metrics_summary") or {}).get(metric)
        if r["status"] == "keep":
            d["kept"] += 1
            if score is not None:
                d["baseline"] = score if d["baseline"] is None else d["baseline"]
                d["best"] = score if d["best"] is None else max(d["best"], score)
    for d in out.values():
        d["discarded"] = d["total"] - d["kept"]
        d["improvement_pct"] = round((d["best"] - d["baseline"]) / abs(d["baseline"]) * 100, 1) if d["baseline"] else None
    return out


def best_kept(spark: SparkSession, root: str) -> str | None:
    """The latest kept run, by the index."""
    return next((r["id"] for r in reversed(history(spark, root)) if r["status"] == "keep"), None)


def restore(spark: SparkSession, root: str, experiment: str, into: str) -> list[str]:
    """Copies an experiment's stored code files to a local folder and returns their names."""
    files = SharedFolder(spark, root)
    folder = next(r["dir"] for r in history(spark, root) if r["id"] == experiment)
    names = [n for n in files.names(folder) if n not in ("metrics.json", "metadata.json") and not n.startswith(".")]
    for n in names:
        files.fetch(f"{folder}/{n}", into)
    return names
