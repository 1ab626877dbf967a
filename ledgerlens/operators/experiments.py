"""Queries over an append-only log of experiments.

A record: id, dataset, hypothesis, status (keep, discard, crash, timeout, reject_psi), seq (order), metrics and a map of
top features. Logs are small, so ordered windows over one dataset are fine here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_int
from ..functions.text import campaign, tags

METRICS = ("composite_score", "auprc_val", "auroc_val", "precision_at_recall_val", "auprc", "auroc", "composite_score_oot", "precision_at_recall", "psi", "auroc_train", "auroc_train_val_gap", "train_val_psi", "ci_width_val")
LOG = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "dir", "dataset", "hypothesis", "status", "timestamp", "parent_exp")]
    + [
        T.StructField("metrics_summary", T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS] + [T.StructField("n_features", T.IntegerType()), T.StructField("auprc_val_ci", T.ArrayType(T.DoubleType())), T.StructField("auprc_ci", T.ArrayType(T.DoubleType()))])),
        T.StructField("top_features", T.MapType(T.StringType(), T.DoubleType())), T.StructField("feature_psi", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("feature_train_val_psi", T.MapType(T.StringType(), T.DoubleType())), T.StructField("leakage_warnings", T.ArrayType(T.StringType())),
    ]
)

#: Families of techniques and the keywords that tell them, in a hypothesis or a feature's name.
TECHNIQUES = {
    "velocity": ("velocity", "vel_", "gap", "burst", "daily_rate", "time_since"),
    "behavioral": ("behav_", "deviation", "zscore", "profile", "hour_deviation"),
    "target_encoding": ("target_enc", "_te", "smoothing", "min_samples", "oof"),
    "interaction_te": ("interaction", "card_x_", "card1_x_", "_x_"),
    "identity": ("identity", "modal", "match", "profile_match", "consistency"),
    "entity_sharing": ("entity", "shared_", "n_cards_per", "sharing"),
    "amount_patterns": ("amt_", "round", "cents", "decimal", "corridor", "iqr"),
    "geo_features": ("geo_", "distance", "lat", "long", "city_pop"),
    "geo_distance": ("haversine", "geo_dist", "from_home", "centroid"),
    "time_features": ("hour", "day_of_week", "weekend", "cyclical", "night"),
    "cyclic_time": ("sin_hour", "cos_hour", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "cyclic"),
    "terminal_risk": ("term_fraud", "terminal_risk", "merchant_risk", "term_is_high", "term_log_volume"),
    "anomaly": ("anomaly", "mahalanobis", "isolation", "outlier"),
    "model_tuning": ("depth", "learning_rate", "n_estimators", "trees", "ensemble", "subsample", "colsample"),
    "class_weight": ("weight", "scale_pos", "focal", "imbalance", "undersamp"),
    "feature_selection": ("drop", "remove", "select", "prune", "importance"),
    "aggregation": ("agg", "count", "mean", "std", "per_card", "per_merchant"),
    "uid_construction": ("uid", "uid_", "_uid", "construct_uid", "card1_addr1"),
    "window_velocity": ("vel_1h", "vel_24h", "vel_7d", "window_velocity", "rolling_count", "vel_60s", "vel_600s"),
    "rolling_terminal": ("term_fraud_28d", "rolling_term", "term_compromise", "rolling_fraud_rate"),
}
#: Keywords of ambitious techniques, and patterns of the advanced recipes.
AMBITIOUS = (
    "uid", "construct_uid", "card1_addr1", "window_velocity", "vel_1h", "vel_24h", "vel_7d", "vel_60s", "vel_600s", "rolling_term", "term_fraud_28d", "rolling_fraud_rate", "term_compromise", "fingerprint",
    "von_mises", "von mises", "recipe 15", "recipe 16", "recipe 17", "recipe 18", "recipe 19", "recipe15", "recipe16", "recipe17", "recipe18", "recipe19",
)
RECIPES = {
    "15 (UID)": r"recipe\s*15|construct_uid|\buid_\b|card1_addr1", "16 (window velocity)": r"recipe\s*16|window_velocity|vel_(?:1h|24h|7d|60s|600s)", "17 (rolling terminal)": r"recipe\s*17|rolling_term|term_fraud_28d|term_compromise",
    "18 (fingerprint)": r"recipe\s*18|fingerprint", "19 (von Mises)": r"recipe\s*19|von[\s_]?mises",
}


def numbered(log: DataFrame) -> DataFrame:
    """Adds `seq`, the number in the id."""
    return log.withColumn("seq", F.try_to_number(F.regexp_extract("id", r"(\d+)", 1), F.lit("999999999")).cast("int"))


def next_id(log: DataFrame) -> DataFrame:
    return numbered(log).agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_id"))


def best_kept(log: DataFrame, by: str = "dataset") -> DataFrame:
    """The latest kept record of each dataset."""
    return log.where("status = 'keep'").groupBy(by).agg(F.max_by(F.struct(*[c for c in log.columns if c != by]), "seq").alias("r")).select(by, "r.*")


def decisions(log: DataFrame, score: str, rejected: Column, least_gain: float = 0.001) -> DataFrame:
    """Replays keep and discard along the log: a record is kept if it beats the best kept so far by the least gain."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.array().cast("array<struct<id:string,decided:string>>").alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        keep = ~x["rejected"] & x["score"].isNotNull() & (acc["best"].isNull() | (x["score"] > acc["best"] + least_gain))
        status = F.when(x["score"].isNull(), "crash").when(x["rejected"], "reject_psi").when(keep, "keep").otherwise("discard")
        return F.struct(F.when(keep, x["score"]).otherwise(acc["best"]).alias("best"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), status.alias("decided")))).alias("out"))

    rows = log.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("seq", "id", F.col(score).cast("double").alias("score"), F.coalesce(rejected, F.lit(False)).alias("rejected")))).alias("rows"))
    return rows.select("dataset", F.explode(F.aggregate("rows", start, fold, lambda acc: acc["out"])).alias("o")).select("dataset", "o.*")


def dataset_summary(log: DataFrame, score: str) -> DataFrame:
    """Totals, best, first kept and improvement in percent (one digit) by dataset."""
    kept = F.col("status") == "keep"
    s = log.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(F.col("status") == "discard").alias("discarded"), F.count_if(F.col("status") == "crash").alias("crashed"),
        F.max(F.when(kept, F.col(score))).alias("best"), F.min_by(score, F.when(kept, F.col("seq"))).alias("baseline"),
    )
    return s.withColumn("improvement_pct", F.round((F.col("best") - F.col("baseline")) / F.when(F.col("baseline") != 0, F.abs("baseline")) * 100, 1))


def compare(log: DataFrame, a: str, b: str, metrics: list[str]) -> DataFrame:
    """(metric, a, b, change) of two records."""
    x, y = log.where(F.col("id") == a), log.where(F.col("id") == b)
    long = lambda df, n: df.select(*(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([], metrics, "metric", n)
    return long(x, "a").join(long(y, "b"), "metric", "full").withColumn("change", F.col("b") - F.col("a"))


def feature_names(log: DataFrame) -> Column:
    return F.coalesce(F.array_join(F.map_keys("top_features"), " "), F.lit("")) if "top_features" in log.columns else F.lit("")


def ambition(log: DataFrame, n_features: str = "n_features") -> DataFrame:
    """Adds the growth of the feature count over the last known one (0 without one) and a tier from three signs: a keyword in
    the hypothesis or a feature's name, growth by eight or more, an advanced recipe named in the hypothesis. Two signs are
    `ambitious`; one, or growth by four to seven, is `moderate`."""
    n = F.coalesce(F.col(n_features), F.lit(0))
    before = F.last(F.when(n > 0, n), ignorenulls=True).over(W.partitionBy("dataset").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    growth = F.coalesce(n - before, F.lit(0))
    hypothesis = F.lower(F.coalesce("hypothesis", F.lit("")))
    words = F.concat_ws(" ", hypothesis, F.lower(feature_names(log)))
    signs = as_int(words.rlike("|".join(AMBITIOUS))) + as_int(growth >= 8) + as_int(hypothesis.rlike(r"recipe\s*1[5-9]"))
    tier = F.when(signs >= 2, "ambitious").when((signs == 1) | growth.between(4, 7), "moderate").otherwise("standard")
    return log.withColumns({"feature_delta": growth, "ambition": tier})


def ambition_report(log: DataFrame, recent: int = 30, n_features: str = "n_features") -> DataFrame:
    """One row a dataset over its last `recent` records: mean and largest growth of the feature count (over records that know it
    and have one before them), records of a campaign and distinct campaigns, how often each advanced recipe is named, and
    the shares of the tiers in percent."""
    rows = log.withColumn("ar_back", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("seq")))).where(F.col("ar_back") <= recent)
    n = F.coalesce(F.col(n_features), F.lit(0))
    known = F.when(n > 0, F.max(F.when(n > 0, 1)).over(W.partitionBy("dataset").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)))
    rows = ambition(rows, n_features).withColumn("ar_growth", F.when(known.isNotNull(), F.col("feature_delta"))).withColumn("ar_campaign", F.lower(campaign(F.col("hypothesis"))["name"]))
    share = lambda tier: F.avg((F.col("ambition") == tier).cast("double")) * 100
    recipes = {f"recipe_{label[:2]}": F.count_if(F.coalesce("hypothesis", F.lit("")).rlike("(?i)" + pattern)) for label, pattern in RECIPES.items()}
    return rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.avg("ar_growth"), F.lit(0.0)).alias("mean_delta"), F.coalesce(F.max("ar_growth"), F.lit(0)).alias("max_delta"), F.count("ar_campaign").alias("tagged"),
        F.count_distinct("ar_campaign").alias("campaigns"), *(x.alias(name) for name, x in recipes.items()), *(share(t).alias(f"{t}_pct") for t in ("ambitious", "moderate", "standard")),
    )


def techniques(log: DataFrame) -> Column:
    """The families that a record's hypothesis or the names of its top features tell."""
    return tags(F.concat_ws(" ", F.coalesce("hypothesis", F.lit("")), feature_names(log)), TECHNIQUES)


def technique_rates(log: DataFrame) -> DataFrame:
    """(technique, keeps, discards, rate) over records that didn't crash."""
    rows = log.where(~F.col("status").isin("crash", "timeout")).select("status", F.explode(techniques(log)).alias("technique"))
    s = rows.groupBy("technique").agg(F.count_if(F.col("status") == "keep").alias("keeps"), F.count_if(F.col("status") != "keep").alias("discards"))
    return s.withColumn("rate", F.col("keeps") / (F.col("keeps") + F.col("discards"))).orderBy(F.desc("keeps"), "technique")


def untried(log: DataFrame, spark: SparkSession, excluded: tuple[str, ...] = ()) -> DataFrame:
    known = spark.createDataFrame([(t,) for t in TECHNIQUES if t not in excluded], "technique string")
    return known.join(technique_rates(log).select("technique"), "technique", "left_anti")


def importance_trend(log: DataFrame, last: int = 5) -> DataFrame:
    """(dataset, feature, first, last, trend) over the last kept records; a missing feature counts as 0."""
    recent = log.where("status = 'keep'").withColumn("back", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("seq")))).where(F.col("back") <= last)
    flat = recent.select("dataset", "seq", F.explode("top_features").alias("feature", "gain"))
    ends = recent.groupBy("dataset").agg(F.min("seq").alias("s0"), F.max("seq").alias("s1"))
    s = flat.join(ends, "dataset").groupBy("dataset", "feature").agg(F.coalesce(F.max(F.when(F.col("seq") == F.col("s0"), F.col("gain"))), F.lit(0.0)).alias("first"), F.coalesce(F.max(F.when(F.col("seq") == F.col("s1"), F.col("gain"))), F.lit(0.0)).alias("last"))
    trend = F.when(F.col("first") == 0, F.when(F.col("last") > 0, "new").otherwise("absent")).when(F.col("last") > 1.1 * F.col("first"), "growing").when(F.col("last") < 0.9 * F.col("first"), "declining").otherwise("stable")
    return s.withColumn("trend", trend)


def streak(log: DataFrame, window: int = 10) -> DataFrame:
    """(dataset, status, length) of the run of equal statuses at the end of each log's last records."""
    recent = log.withColumn("back", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("seq")))).where(F.col("back") <= window)
    now = F.first("status").over(W.partitionBy("dataset").orderBy("back").rowsBetween(W.unboundedPreceding, 0))
    broken = F.sum((F.col("status") != now).cast("int")).over(W.partitionBy("dataset").orderBy("back").rowsBetween(W.unboundedPreceding, 0))
    return recent.withColumns({"now": now, "broken": broken}).where("broken = 0").groupBy("dataset", F.col("now").alias("status")).agg(F.count(F.lit(1)).alias("length"))


def campaigns(log: DataFrame, window: int = 15, stalled: int = 3) -> DataFrame:
    """(dataset, name, steps, done, kept, ago, is_stalled) of the campaigns in each log's last records."""
    rows = log.withColumn("back", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("seq")))).where(F.col("back") <= window).withColumn("c", campaign(F.col("hypothesis"))).where("c.name IS NOT NULL")
    s = rows.groupBy("dataset", F.col("c.name").alias("name")).agg(F.max("c.steps").alias("steps"), F.count_distinct("c.step").alias("done"), F.count_if(F.col("status") == "keep").alias("kept"), (F.min("back") - 1).alias("ago"))
    return s.withColumn("is_stalled", (F.col("ago") >= stalled) & (F.col("done") < F.col("steps")))


def warnings(log: DataFrame) -> DataFrame:
    """(id, warning) by the metrics' limits."""
    m = F.col("metrics_summary")
    found = F.array(
        F.when(m["auroc_train_val_gap"] > 0.10, "overfit").when(m["auroc_train_val_gap"] > 0.03, "gap"),
        F.when(m["train_val_psi"] > 0.15, "shift").when(m["train_val_psi"] > 0.10, "drift"), F.when(m["ci_width_val"] > 0.02, "wide interval"),
    )
    return log.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("warning"))


def lost_signal(analysis: DataFrame) -> DataFrame:
    """Columns that are mostly null and yet tell the label."""
    return analysis.where((F.col("null_rate") > 0.5) & ((F.col("iv") > 0.05) | (F.col("null_auc") > 0.55)))


def dead_features(analysis: DataFrame) -> DataFrame:
    return analysis.where((F.col("iv") < 0.005) & (F.col("null_rate") < 0.5))


def index_totals(log: DataFrame, score: str) -> DataFrame:
    return log.groupBy("dataset").agg(F.count(F.lit(1)).alias("experiments"), F.max(F.when(F.col("status") == "keep", F.col(score))).alias("best_kept"))


def is_stale(at: int | None, now: int, every: int) -> bool:
    """Whether a stored analysis is to be made anew."""
    return at is None or now - at >= every


def recommendations(trend: DataFrame, untried_rows: DataFrame, runs: DataFrame) -> list[str]:
    """Short texts from the collected, small results."""
    out = [f"try {r['technique']}" for r in untried_rows.orderBy("technique").limit(1).collect()]
    for r in trend.orderBy("feature").collect():
        if r["trend"] == "growing":
            out.append(f"build on {r['feature']}")
        elif r["trend"] == "declining" and r["last"] > 0.05:
            out.append(f"look at why {r['feature']} falls")
    out += [f"{r['length']} x {r['status']} in a row: change direction" for r in runs.collect() if r["status"] != "keep" and r["length"] >= 3]
    return out


def context_text(log: DataFrame, score: str, spark: SparkSession, journal: str = "", index: str = "") -> str:
    """A short report for whoever plans the next experiment; of a journal its last 4 KB, of an index its first 6 KB."""
    lines = ["# Summary"] + [f"{r['dataset']}: {r['kept']} of {r['total']} kept, best {r['best']}" for r in dataset_summary(log, score).orderBy("dataset").collect()]
    lines += ["# Techniques"] + [f"{r['technique']}: {r['keeps']} kept, {r['discards']} not" for r in technique_rates(log).collect()]
    lines += ["# Campaigns"] + [f"{r['name']}: {r['done']}/{r['steps']}" + " stalled" * r["is_stalled"] for r in campaigns(log).orderBy("name").collect()]
    if "metrics_summary" in log.columns:
        lines += ["# Warnings"] + [f"{r['id']}: {r['warning']}" for r in warnings(log).orderBy("id", "warning").collect()]
    for title, part in (("# Journal", journal.encode()[-4096:]), ("# Index", index.encode()[:6144])):
        lines += [title, part.decode("utf-8", "ignore")] if part else []
    lines += ["# Next"] + recommendations(importance_trend(log), untried(log, spark), streak(log))
    return "\n".join(lines)
