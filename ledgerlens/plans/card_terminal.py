"""Minimal card transactions: a customer, a terminal, an amount, a time.

Config: row_id, customer, terminal, amount. Rows carry `t_us` and `split`.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import amount_pattern, ratio, zscore
from ..operators.encodings import target
from ..operators.pipeline import FittedState
from ..operators.profiles import distinct_profile, entity_profile, lookup
from ..operators.risk import rolling_rate
from ..operators.velocity import DAILY, burst_ratio, velocity
from ..sources.scratch import written
from .common import clock, joined_labels, numeric_only, scalar

DEFAULTS = {"row_id": "row_id", "customer": "customer", "terminal": "terminal", "amount": "amount"}


def fit(history: DataFrame, labels: DataFrame, config: dict[str, Any], both: DataFrame | None = None) -> FittedState:
    c = DEFAULTS | config
    both = joined_labels(history, labels, c["row_id"]).withColumnRenamed(labels.columns[1], "label") if both is None else both
    whole = both.agg(F.avg(c["amount"]).alias("m"), F.stddev_samp(c["amount"]).alias("s"), F.avg("label").alias("g")).first()
    customers = entity_profile(history, c["customer"], c["amount"], ("mean", "std", "p90"), "cust_", std_default=1.0)
    customers = lookup(customers, distinct_profile(history, c["customer"], {"cust_n_term_train": c["terminal"]}), c["customer"])
    terminals = entity_profile(history, c["terminal"], c["amount"], ("mean", "std", "count"), "term_", std_default=1.0)
    terminals = lookup(terminals, target(both, c["terminal"], "label", "term_static_fraud_rate", "raw"), c["terminal"])
    # written, so that their size is known when rows are joined to them
    customers, terminals = (written(history.sparkSession, x, n) for x, n in ((customers, "customers"), (terminals, "terminals")))
    days = both.select(c["terminal"], "t_us", "label")
    return FittedState({"customers": customers, "terminals": terminals, "labels": days}, {"mean": scalar(whole, "m"), "std": scalar(whole, "s", 1.0), "rate": scalar(whole, "g")})


def transform(df: DataFrame, state: FittedState, config: dict[str, Any]) -> DataFrame:
    """Every row's windows see all earlier rows, of its own split and of others."""
    c = DEFAULTS | config
    s, amount = state.scalars, F.col(c["amount"])
    out = df
    # first of all, while rows are narrow: these are dealt twice
    for key, short in ((c["customer"], "cust"), (c["terminal"], "term")):
        out = velocity(out, key, "t_us", c["amount"], c["row_id"], DAILY, spread=True)
        out = out.withColumn(f"{short}_burst_1h_1d", burst_ratio(f"{key}_1h_count", f"{key}_1d_count"))
    out = clock(out)
    out = lookup(out, state.tables["customers"], c["customer"], {"cust_mean": s["mean"], "cust_std": s["std"], "cust_p90": s["mean"], "cust_n_term_train": 1})
    out = lookup(out, state.tables["terminals"], c["terminal"], {"term_mean": 0.0, "term_std": 0.0, "term_count": 0, "term_static_fraud_rate": s["rate"]})
    pattern = amount_pattern(amount)
    out = out.withColumns({"amt_zscore_cust": zscore(amount, F.col("cust_mean"), F.col("cust_std")), "amt_vs_p90": ratio(amount, F.col("cust_p90"), 1.0), "amt_zscore_term": zscore(amount, F.col("term_mean"), F.col("term_std")), "amt_is_small": pattern["is_small"], "amt_is_round": pattern["is_round_10"]})
    out = rolling_rate(out, state.tables["labels"], c["terminal"], "t_us", "label", name="term_fraud_rate_28d")
    out = out.withColumnsRenamed({"term_mean": "term_mean_amt", "term_std": "term_std_amt", "term_count": "term_tx_count"}).drop("cust_mean", "cust_std", "cust_p90", "hour", "dow")
    return numeric_only(out, keep=("split",))


