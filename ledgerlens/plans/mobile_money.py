"""Transfers between two accounts with balances before and after.

Config: row_id, kind, amount, sender, receiver, step, and the four balance columns.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import balance_features, step_features, type_features, zscore
from ..operators.encodings import counts, target
from ..operators.pipeline import FittedState
from ..operators.profiles import entity_profile, lookup
from ..sources.scratch import written
from .common import joined_labels, numeric_only, scalar

DEFAULTS = {"row_id": "row_id", "kind": "type", "amount": "amount", "sender": "nameOrig", "receiver": "nameDest", "step": "step", "old_from": "oldbalanceOrg", "new_from": "newbalanceOrig", "old_to": "oldbalanceDest", "new_to": "newbalanceDest"}


def fit(history: DataFrame, labels: DataFrame, config: dict[str, Any], both: DataFrame | None = None) -> FittedState:
    c = DEFAULTS | config
    both = joined_labels(history, labels, c["row_id"]).withColumnRenamed(labels.columns[1], "label") if both is None else both
    transfer, cash = F.col(c["kind"]) == "TRANSFER", F.col(c["kind"]) == "CASH_OUT"
    g = both.agg(F.avg("label").alias("g"), F.avg(F.when(transfer, F.col("label"))).alias("gt"), F.avg(F.when(cash, F.col("label"))).alias("gc"), F.avg(c["amount"]).alias("m"), F.stddev_samp(c["amount"]).alias("s")).first()
    # all of one account in one table, written: its size is then known, and rows are dealt once for it or not at all
    accounts = lambda key, side, more, where: lookup(lookup(counts(history, key, f"{side}_freq"), target(both, key, "label", f"{side}_fraud_rate", "sigmoid"), key), target(both, key, "label", more, "sigmoid", where=where), key)
    tables = {
        "type": entity_profile(history, c["kind"], c["amount"], ("mean", "std"), "type_", std_default=1.0), "senders": accounts(c["sender"], "sender", "sender_cashout_fraud_rate", cash),
        "receivers": accounts(c["receiver"], "receiver", "receiver_transfer_fraud_rate", transfer),
    }
    tables = {name: written(history.sparkSession, table, name) for name, table in tables.items()}
    rate = scalar(g, "g")
    return FittedState(tables, {"rate": rate, "transfer": scalar(g, "gt", rate), "cash": scalar(g, "gc", rate), "mean": scalar(g, "m"), "std": scalar(g, "s", 1.0)})


def transform(df: DataFrame, state: FittedState, config: dict[str, Any]) -> DataFrame:
    c = DEFAULTS | config
    s, amount = state.scalars, F.col(c["amount"])
    sender, receiver = c["sender"], c["receiver"]
    out = lookup(df, state.tables["type"], c["kind"], {"type_mean": s["mean"], "type_std": 1.0})
    out = lookup(out, state.tables["senders"], sender, {"sender_freq": 0, "sender_fraud_rate": s["rate"], "sender_cashout_fraud_rate": s["cash"]})
    out = lookup(out, state.tables["receivers"], receiver, {"receiver_freq": 0, "receiver_fraud_rate": s["rate"], "receiver_transfer_fraud_rate": s["transfer"]})
    out = out.withColumns(type_features(F.col(c["kind"])) | balance_features(amount, F.col(c["old_from"]), F.col(c["new_from"]), F.col(c["old_to"]), F.col(c["new_to"])) | step_features(F.col(c["step"])))
    out = out.withColumns({
        "log_amount": F.log1p(amount), "amount_zscore": zscore(amount, F.lit(s["mean"]), F.lit(s["std"])), "amount_type_zscore": zscore(amount, F.col("type_mean"), F.col("type_std")),
        "log_sender_freq": F.log1p("sender_freq"), "log_receiver_freq": F.log1p("receiver_freq"), "log_old_from": F.log1p(c["old_from"]), "log_old_to": F.log1p(c["old_to"]),
    })
    return numeric_only(out.drop("type_mean", "type_std"), keep=("split",), fill=None)
