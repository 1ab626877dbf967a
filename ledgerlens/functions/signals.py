"""Device, session and familiarity signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_int, clock_skew_bucket


def device_risk(battery: Column, charging: Column, debugger: Column, headless: Column, client_s: Column, server_s: Column) -> dict[str, Column]:
    """Signs of an emulator and their weighted sum. `battery` is 0 to 100; -1 or null is a level that wasn't reported."""
    level, skew = F.coalesce(battery, F.lit(-1)), F.abs(client_s - server_s)
    missing, full = as_int(level == -1), as_int((level == 100) & F.coalesce(charging, F.lit(False)))
    emulator = F.greatest(full, missing)
    total = 0.3 * emulator + 0.3 * as_int(debugger) + 0.2 * as_int(headless) + 0.2 * as_int(skew > 300)
    return {
        "battery_missing": missing, "battery_round": as_int(level % 10 == 0), "battery_full": full, "emulator_score": emulator, "emulator_detected": as_int((emulator > 0.5) | headless), "clock_skew": skew,
        "skew_bucket": clock_skew_bucket(skew), "device_risk": total,
    }


def session_features(fill_s: Column, pasted: Column, fields: Column, actions: Column, minutes: Column, pages: Column | None = None) -> dict[str, Column]:
    """Pace and depth of a session; actions are counted over a minute at least."""
    made = {"fill_fast": as_int(fill_s < 3), "fill_slow": as_int(fill_s > 600), "paste_ratio": pasted / F.when(fields > 0, fields), "actions_per_minute": actions / F.greatest(minutes.cast("double"), F.lit(1.0))}
    return made if pages is None else made | {"pages_before": pages - 1}


def mean_of_flags(*flags: Column) -> Column:
    """Mean over the flags that are known; null if none is."""
    known = sum((f.isNotNull().cast("int") for f in flags[1:]), flags[0].isNotNull().cast("int"))
    total = sum((F.coalesce(f.cast("double"), F.lit(0.0)) for f in flags[1:]), F.coalesce(flags[0].cast("double"), F.lit(0.0)))
    return total / F.when(known > 0, known)


def familiarity(*is_new: Column) -> dict[str, Column]:
    """Share of known attributes, and whether all are new at once."""
    n = len(is_new)
    known = reduce(lambda a, b: a + b, (1 - as_int(x) for x in is_new))
    return {"known_ratio": known / float(n), "all_new": as_int(known == 0)}


def cross_layer(known_ratio: Column, amount_rank: Column, max_ever: Column, new_recipient: Column, new_device: Column, age_days: Column, amount: Column, device_shared: Column) -> dict[str, Column]:
    """Signals of identity times signals of behaviour: instability by deviation, three novelties at once, and what a young
    account (under 30 days) moves and shares."""
    young = as_int(age_days < 30)
    return {
        "stability_x_deviation": (1 - known_ratio) * amount_rank, "triple_novelty": (as_int(max_ever) + as_int(new_recipient) + as_int(new_device)) / 3.0,
        "new_account_x_amount": young * amount, "new_account_x_shared_device": young * as_int(device_shared),
    }


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.when(union > 0, union)
