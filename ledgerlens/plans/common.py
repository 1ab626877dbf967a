"""What the feature plans share."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cyclic, is_night, is_weekend
from ..operators.encodings import frequency
from ..operators.profiles import lookup
from ..schema import text_columns


def clock(df: DataFrame, t: str = "t_us") -> DataFrame:
    """hour and dow (Monday is 0) with their circles and flags, from microseconds since 1970 (a Thursday)."""
    hour, dow = F.pmod(F.floor(F.col(t) / 3_600_000_000), F.lit(24)), F.pmod(F.floor(F.col(t) / 86_400_000_000) + 3, F.lit(7))
    hs, hc = cyclic(hour, 24)
    ds, dc = cyclic(dow, 7)
    return df.withColumns({"hour": hour, "dow": dow, "hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc, "is_night": is_night(hour), "is_weekend": is_weekend(dow)})


def joined_labels(history: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    return history.join(labels, row_id)


def fit_frequencies(history: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    return {f"freq_{c}": frequency(history, [c], f"{c}_freq_enc") for c in columns}


def apply_frequencies(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    for name, table in tables.items():
        if name.startswith("freq_"):
            c = name.removeprefix("freq_")
            df = lookup(df, table, c, {f"{c}_freq_enc": 0.0})
    return df


def numeric_only(df: DataFrame, keep: tuple[str, ...], fill: float | None = -1.0) -> DataFrame:
    """Drops the text columns but `keep`, and fills nulls of numbers."""
    from ..operators.splits import fill_numeric

    out = df.drop(*(c for c in text_columns(df) if c not in keep))
    return fill_numeric(out, fill) if fill is not None else out


def scalar(row: Any, name: str, default: float = 0.0) -> float:
    return default if row is None or row[name] is None else float(row[name])
