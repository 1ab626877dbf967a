"""Scalar features of amounts, times, places and balances, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_ORDER = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
EARTH_KM = 6371.0


def as_int(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    angle = c * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def fourier(seconds: Column) -> dict[str, Column]:
    """Sine and cosine of the hour, the day and the week."""
    return {f"{n}_{k}": f for n, p in (("hour", 3600.0), ("day", 86400.0), ("week", 604800.0)) for k, f in zip(("sin", "cos"), cyclic(seconds, p), strict=True)}


def is_night(hour: Column, late: int = 22, early: int = 6) -> Column:
    return as_int((hour >= late) | (hour <= early))


def is_weekend(weekday: Column) -> Column:
    """Monday is 0."""
    return as_int(weekday >= 5)


def zscore(x: Column, mean: Column, std: Column, floor: float = 0.01) -> Column:
    """Null stays null: the floor is not taken for a missing deviation."""
    return (x - mean) / F.when(std.isNotNull(), F.greatest(std, F.lit(floor)))


def ratio(x: Column, of: Column, floor: float = 0.01) -> Column:
    return x / F.when(of.isNotNull(), F.greatest(of, F.lit(floor)))


def amount_pattern(amount: Column) -> dict[str, Column]:
    """Round amounts and amounts just under a limit; remainders are rounded, as binary fractions are not exact."""
    rest = lambda m: F.round(amount % m, 6)
    cents = F.round((amount * 100) % 100, 4)
    return {
        "is_round_10": as_int(rest(10.0) < 0.01), "is_round_100": as_int(rest(100.0) < 0.01), "is_whole": as_int(rest(1.0) == 0), "cents": cents, "has_cents": as_int(cents > 0.5),
        "below_100": as_int((amount >= 95) & (amount < 100)), "below_1000": as_int((amount >= 990) & (amount < 1000)), "is_small": as_int(amount < 50), "is_micro": as_int(amount < 1),
        "corridor_90": as_int((amount >= 90) & (amount < 100)), "corridor_450": as_int((amount >= 450) & (amount < 500)), "corridor_900": as_int((amount >= 900) & (amount < 1000)),
    }


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def geo_flags(km: Column, far: float = 200.0) -> dict[str, Column]:
    return {"log_distance": F.log1p(km), "is_far": as_int(km > far)}


def hour_gap(a: Column, b: Column) -> Column:
    """Distance around the clock."""
    d = F.abs(a - b)
    return F.least(d, 24 - d)


def hour_sigma(hour: Column, mean: Column, std: Column) -> dict[str, Column]:
    """Deviation from an entity's usual hour in its deviations (one hour at least), and whether it is over two."""
    z = F.abs(hour - mean) / F.when(std.isNotNull(), F.greatest(std, F.lit(1.0)))
    return {"hour_deviation_sigma": z, "is_odd_hour": as_int(z > 2)}


def amount_extremes(amount: Column, top: Column, median: Column) -> dict[str, Column]:
    """An amount against an entity's largest and median one."""
    return {"ratio_to_max": ratio(amount, top), "ratio_to_median": ratio(amount, median), "above_median": as_int(amount > median), "is_over_max": as_int(amount > top)}


def entity_flags(count: Column, rate: Column, base: Column, times: float = 3.0) -> dict[str, Column]:
    """Whether an entity is new, its log volume, and whether its rate is over so many times the base rate."""
    n = F.coalesce(count, F.lit(0))
    return {"is_new_entity": as_int(n == 0), "log_volume": F.log1p(n), "is_high_risk": as_int(rate > times * base)}


def band_flags(amount: Column, low: Column, median: Column, high: Column) -> dict[str, Column]:
    """Whether an amount is outside its category's quartile band, and its ratio to the category's median."""
    return {"outside_band": as_int((amount < low) | (amount > high)), "ratio_to_category_median": ratio(amount, median)}


def interactions(amount: Column, km: Column, count: Column, population: Column) -> dict[str, Column]:
    """Products of log amount, log distance and velocity, and the amount by head of a place."""
    return {"log_amount_x_log_km": F.log1p(amount) * F.log1p(km), "velocity_x_log_km": count * F.log1p(km), "amount_per_head": amount / F.greatest(population, F.lit(1))}


def matches(value: Column, usual: Column) -> Column:
    """1 where a value is the entity's usual one; an unknown one doesn't match."""
    return as_int(value == usual)


def angular_distance(hour: Column, mean_sin: Column, mean_cos: Column) -> Column:
    """1 - cos of the angle between an hour and a mean direction."""
    s, c = cyclic(hour, 24)
    r = F.sqrt(mean_sin * mean_sin + mean_cos * mean_cos)
    return 1 - (s * mean_sin + c * mean_cos) / F.when(r > 0, r)


def is_unusual_hour(distance: Column, concentration: Column) -> Column:
    return as_int((distance > 0.5) & (concentration > 0.5))


def balance_features(amount: Column, old_from: Column, new_from: Column, old_to: Column, new_to: Column) -> dict[str, Column]:
    sent, got = F.abs((old_from - new_from) - amount), F.abs((new_to - old_to) - amount)
    return {
        "orig_balance_error": sent, "dest_balance_error": got, "log_orig_balance_error": F.log1p(sent), "log_dest_balance_error": F.log1p(got),
        "orig_after_zero": as_int(new_from == 0), "orig_was_zero": as_int(old_from == 0), "dest_was_zero": as_int(old_to == 0), "amount_exceeds": as_int(amount > old_from + 1), "amount_to_balance": amount / (old_from + 1),
    }


def type_features(kind: Column) -> dict[str, Column]:
    code = F.lit(-1)
    for i, name in enumerate(TYPE_ORDER):
        code = F.when(kind == name, i).otherwise(code)
    transfer, cash = as_int(kind == "TRANSFER"), as_int(kind == "CASH_OUT")
    return {"type_enc": code, "is_transfer": transfer, "is_cash_out": cash, "is_fraud_type": transfer + cash}


def step_features(step: Column) -> dict[str, Column]:
    return {"step_mod_24": step % 24, "step_mod_168": step % 168, "step_bin_day": F.floor(step / 24)}


def account_age(now: Column, first: Column, first_buy: Column, used_days: Column, limit: Column, balance: Column) -> dict[str, Column]:
    """Ages are in days of microsecond times."""
    age = (now - first) / 86_400_000_000
    return {"age_days": age, "signup_to_first_buy": (first_buy - first) / 86_400_000_000, "is_new": as_int(age < 30), "active_share": used_days / F.when(age > 0, age), "utilisation": balance / F.when(limit != 0, limit)}


def first_used_day(t_us: Column, days_since: Column) -> Column:
    """Day on which a card was first used: a stable part of a synthetic entity."""
    return F.floor(t_us / 86_400_000_000) - days_since


def clock_skew_bucket(seconds: Column) -> Column:
    """Right-closed buckets; null outside."""
    edges = (-1, 30, 120, 300, 900)
    out = F.when(seconds > edges[-1], len(edges) - 1)
    for i in range(len(edges) - 1):
        out = out.when((seconds > edges[i]) & (seconds <= edges[i + 1]), i)
    return out
