"""Transactions with a sparse identity table: two plans, by synthetic entities and by modal profiles.

Config: row_id, amount, categoricals, uid (columns), identity (columns that come from the identity table), card, emails,
device, address, interactions (pairs of columns).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import amount_pattern, cyclic, ratio, zscore
from ..operators.anomaly import mahalanobis_like, standardisation
from ..operators.encodings import LEVEL, frequency, target, with_levels
from ..operators.pipeline import FittedState
from ..operators.profiles import distinct_profile, entity_profile, gap_stats, lookup, mode_profile, novelty_flag
from ..schema import numeric_columns, uid
from .common import apply_frequencies, fit_frequencies, joined_labels, numeric_only, scalar

DEFAULTS = {
    "row_id": "row_id", "amount": "amount", "categoricals": (), "target_encoded": (), "uid": (), "identity": (), "card": "card", "email": "email", "product": "product", "device": "device", "address": "address",
    "network": "network", "interactions": (), "anomaly_columns": 20,
}


def phase(df: DataFrame) -> DataFrame:
    """Fractional phases of the day and the week."""
    hs, hc = cyclic(F.pmod(F.col("t_us") / 3_600_000_000, F.lit(24.0)), 24)
    ds, dc = cyclic(F.pmod(F.col("t_us") / 86_400_000_000, F.lit(7.0)), 7)
    return df.withColumns({"txn_hour_sin": hs, "txn_hour_cos": hc, "txn_dow_sin": ds, "txn_dow_cos": dc})


def presence(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumn("id_cluster_present", F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull().cast("int")) if columns else df


def fit(history: DataFrame, labels: DataFrame, config: dict[str, Any], both: DataFrame | None = None) -> FittedState:
    c = DEFAULTS | config
    both = joined_labels(history, labels, c["row_id"]).withColumnRenamed(labels.columns[1], "label") if both is None else both
    keyed = history.withColumn("uid", uid(*c["uid"]))
    users = entity_profile(keyed, "uid", c["amount"], ("mean", "std", "min", "max", "count"), "uid_amt_")
    users = lookup(users, distinct_profile(keyed, "uid", {"uid_email_distinct": c["email"], "uid_prod_distinct": c["product"]}), "uid").withColumnRenamed("uid_amt_count", "uid_count")
    numbers = [x for x in numeric_columns(history, without=(c["row_id"], "t_us"))][: c["anomaly_columns"]]
    tables = {"users": users, "gaps": gap_stats(history, c["card"], "t_us", c["row_id"]), "anomaly": standardisation(history, numbers)} | fit_frequencies(history, list(c["categoricals"]))
    tables |= {f"te_{x}": target(both, x, "label", f"{x}_te", nulls="level") for x in c["target_encoded"]}
    return FittedState(tables, {"rate": scalar(both.agg(F.avg("label").alias("g")).first(), "g"), "numbers": numbers})


def transform(df: DataFrame, state: FittedState, config: dict[str, Any]) -> DataFrame:
    c = DEFAULTS | config
    amount = F.col(c["amount"])
    out = presence(df, c["identity"])
    for x in c["target_encoded"]:
        level = out.withColumn("te_key", F.coalesce(F.col(x).cast("string"), F.lit(LEVEL)))
        out = lookup(level, state.tables[f"te_{x}"].withColumnRenamed(x, "te_key"), "te_key", {f"{x}_te": state.scalars["rate"]}).drop("te_key")
    out = apply_frequencies(out, state.tables)
    out = lookup(out.withColumn("uid", uid(*c["uid"])), state.tables["users"], "uid", {"uid_amt_mean": -1.0, "uid_amt_std": -1.0, "uid_amt_min": -1.0, "uid_amt_max": -1.0, "uid_count": 1, "uid_email_distinct": -1, "uid_prod_distinct": -1})
    names = {"median_gap": "v_median_gap", "std_gap": "v_std_gap", "min_gap": "v_min_gap", "burst": "v_burst", "daily_rate": "v_daily_rate"}
    out = lookup(out, state.tables["gaps"].withColumnsRenamed(names), c["card"], dict.fromkeys(names.values(), 0))
    out = mahalanobis_like(out, state.tables["anomaly"], state.scalars["numbers"])
    p = amount_pattern(amount)
    out = phase(out).withColumns({"log_amount": F.log1p(amount), "amt_is_round_10": p["is_round_10"], "amt_is_round_100": p["is_round_100"], "amt_cents": p["cents"], "amt_has_cents": p["has_cents"], "amt_below_100": p["below_100"], "amt_below_1000": p["below_1000"]})
    return numeric_only(out, keep=("split",))


def fit_modal(history: DataFrame, labels: DataFrame, config: dict[str, Any]) -> FittedState:
    """The second plan: per-card identity counts and modes, deviations by card, network and address, interactions."""
    c = DEFAULTS | config
    card = distinct_profile(history, c["card"], {"card_n_email": c["email"], "card_n_device": c["device"], "card_n_addr": c["address"]})
    for part in (mode_profile(history, c["card"], c["device"], "modal_device"), entity_profile(history, c["card"], c["amount"], ("mean", "std", "count"), "card_amt_")):
        card = lookup(card, part, c["card"])
    tables = {
        "card": card, "pairs": history.select(c["card"], c["email"]).distinct(), "network": entity_profile(history, c["network"], c["amount"], ("mean", "std"), "net_amt_"),
        "address": entity_profile(history, c["address"], c["amount"], ("mean", "std", "count"), "addr_amt_"), "email": entity_profile(history, c["email"], c["amount"], ("mean",), "email_amt_"),
    } | fit_frequencies(history, list(c["categoricals"]))
    tables |= {f"pair_{a}_{b}": frequency(history, [a, b], f"{a}_{b}_freq", nulls="level") for a, b in c["interactions"]}
    return FittedState(tables)


def transform_modal(df: DataFrame, state: FittedState, config: dict[str, Any]) -> DataFrame:
    """An unknown e-mail address counts as new: null is never a known pair."""
    c = DEFAULTS | config
    amount = F.col(c["amount"])
    out = presence(phase(df), c["identity"])
    out = lookup(out, state.tables["card"], c["card"], {"card_n_email": 0, "card_n_device": 0, "card_n_addr": 0, "card_amt_count": 0})
    out = novelty_flag(out, state.tables["pairs"], [c["card"], c["email"]], "card_email_is_new")
    for name, key in (("network", c["network"]), ("address", c["address"]), ("email", c["email"])):
        out = lookup(out, state.tables[name], key, {"addr_amt_count": 0} if name == "address" else None)
    p = amount_pattern(amount)
    out = out.withColumns({
        "is_modal_device": F.coalesce((F.col(c["device"]).cast("string") == F.col("modal_device")).cast("int"), F.lit(0)),
        "card_amt_zscore": zscore(amount, F.col("card_amt_mean"), F.col("card_amt_std")), "card_amt_ratio": ratio(amount, F.col("card_amt_mean")), "net_amt_zscore": zscore(amount, F.col("net_amt_mean"), F.col("net_amt_std")),
        "addr_amt_zscore": zscore(amount, F.col("addr_amt_mean"), F.col("addr_amt_std")), "email_amt_ratio": ratio(amount, F.col("email_amt_mean")), "amt_log": F.log1p(amount), "amt_is_round": p["is_whole"], "amt_cents": F.round(amount % 1, 6),
    })
    for a, b in c["interactions"]:
        keyed = with_levels(out.withColumns({"ia": F.col(a), "ib": F.col(b)}), ["ia", "ib"], "level")
        table = state.tables[f"pair_{a}_{b}"]
        out = lookup(keyed, table.withColumnsRenamed({a: "ia", b: "ib"}), ["ia", "ib"], {f"{a}_{b}_freq": 0.0}).drop("ia", "ib")
    return numeric_only(apply_frequencies(out, state.tables), keep=("split",))
