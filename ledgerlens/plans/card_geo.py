"""Card transactions with places and demographics.

Config: row_id, card, amount, merchant, category, lat, lon, merch_lat, merch_lon, city_pop, categoricals.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km, hour_gap, ratio, zscore
from ..operators.encodings import target
from ..operators.pipeline import FittedState
from ..operators.profiles import distinct_profile, entity_profile, first_profile, lookup
from ..operators.velocity import FAST, burst_ratio, velocity
from .common import apply_frequencies, clock, fit_frequencies, joined_labels, numeric_only, scalar

DEFAULTS = {"row_id": "row_id", "card": "card_id", "amount": "amount", "merchant": "merchant", "category": "category", "lat": "lat", "lon": "long", "merch_lat": "merch_lat", "merch_lon": "merch_long", "city_pop": "city_pop", "categoricals": ("category", "gender", "state")}


def fit(history: DataFrame, labels: DataFrame, config: dict[str, Any], both: DataFrame | None = None) -> FittedState:
    c = DEFAULTS | config
    both = joined_labels(history, labels, c["row_id"]).withColumnRenamed(labels.columns[1], "label") if both is None else both
    history = clock(history)
    home = first_profile(history, c["card"], [c["lat"], c["lon"]], ["t_us", c["row_id"]])
    away = lookup(history, home, c["card"]).withColumn("km", haversine_km(F.col(f"home_{c['lat']}"), F.col(f"home_{c['lon']}"), F.col(c["merch_lat"]), F.col(c["merch_lon"])))
    cards = entity_profile(history, c["card"], c["amount"], ("mean", "std", "p90"), "cust_", std_default=1.0)
    for part in (home, entity_profile(away, c["card"], "km", ("mean", "std", "p90"), "dist_", std_default=1.0), entity_profile(history, c["card"], "hour", ("mean",), "hour_"), distinct_profile(history, c["card"], {"cust_n_merchants_train": c["merchant"], "cust_n_categories_train": c["category"]})):
        cards = lookup(cards, part, c["card"])
    whole = both.agg(F.avg(c["amount"]).alias("m"), F.stddev_samp(c["amount"]).alias("s"), F.avg("label").alias("g")).first()
    spread = cards.agg(F.avg("cust_n_merchants_train").alias("n"), F.avg("dist_mean").alias("d")).first()
    tables = {"cards": cards, "te_category": target(both, c["category"], "label", "category_te"), "te_merchant": target(both, c["merchant"], "label", "merchant_te")} | fit_frequencies(history, list(c["categoricals"]))
    return FittedState(tables, {"mean": scalar(whole, "m"), "std": scalar(whole, "s", 1.0), "rate": scalar(whole, "g"), "merchants": scalar(spread, "n", 1.0), "km": scalar(spread, "d", 1.0)})


def transform(df: DataFrame, state: FittedState, config: dict[str, Any]) -> DataFrame:
    """The card is a typed key: a number stays a number in the lookup."""
    c = DEFAULTS | config
    s, amount = state.scalars, F.col(c["amount"])
    out = clock(df)
    out = lookup(out, state.tables["te_category"], c["category"], {"category_te": s["rate"]})
    out = lookup(out, state.tables["te_merchant"], c["merchant"], {"merchant_te": s["rate"]})
    out = apply_frequencies(out, state.tables)
    lat, lon = f"home_{c['lat']}", f"home_{c['lon']}"
    out = lookup(out, state.tables["cards"], c["card"], {"cust_mean": s["mean"], "cust_std": s["std"], "cust_p90": s["mean"], "dist_mean": s["km"], "dist_std": 1.0, "dist_p90": s["km"], "hour_mean": 12.0, "cust_n_merchants_train": s["merchants"], "cust_n_categories_train": 5, lat: F.col(c["lat"]), lon: F.col(c["lon"])})
    km = haversine_km(F.col(lat), F.col(lon), F.col(c["merch_lat"]), F.col(c["merch_lon"]))
    out = out.withColumn("haversine_km", km).withColumns({"log_haversine_km": F.log1p("haversine_km"), "amt_zscore_cust": zscore(amount, F.col("cust_mean"), F.col("cust_std")), "amt_vs_p90": ratio(amount, F.col("cust_p90"), 1.0), "hour_deviation": hour_gap(F.col("hour"), F.col("hour_mean"))})
    out = velocity(out, c["card"], "t_us", c["amount"], c["row_id"], FAST, prefix="card_id", spread=True)
    out = out.withColumns({
        "burst_10m_1h": burst_ratio("card_id_10m_count", "card_id_1h_count"), "burst_1h_1d": burst_ratio("card_id_1h_count", "card_id_1d_count"),
        "dist_zscore_cust": zscore(F.col("haversine_km"), F.col("dist_mean"), F.col("dist_std"), 0.1), "dist_vs_p90": ratio(F.col("haversine_km"), F.col("dist_p90"), 1.0),
        "log_amt_x_log_dist": F.log1p(amount) * F.col("log_haversine_km"), "vel_1h_x_dist": F.col("card_id_1h_count") * F.col("log_haversine_km"),
        "log_city_pop": F.log1p(c["city_pop"]), "amt_per_city_pop": amount / F.greatest(F.col(c["city_pop"]), F.lit(1)),
    })
    return numeric_only(out.drop("cust_mean", "cust_std", "cust_p90", "dist_mean", "dist_std", "dist_p90", "hour_mean", lat, lon, "hour", "dow"), keep=("split",))
