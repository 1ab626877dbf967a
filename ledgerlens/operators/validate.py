"""Checks of transformed splits: structure, leaks, overfitted target encodings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .splits import schema_difference
from .stats import _all, auc, unpivot

TE_NAME = re.compile(r"(_te|_target_enc)$|_te_")


def leaks(df: DataFrame, label: str, columns: list[str], limit: float = 0.90) -> DataFrame:
    """(column, auc) of columns that alone nearly give the label away; nulls count as 0, constant columns are left out."""
    filled = df.select(label, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    varied = unpivot(filled, columns, label)
    several = varied.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi").select("column")
    return auc(varied.join(several, "column")).where((F.col("auc") > limit) | (F.col("auc") < 1 - limit)).orderBy("column")


def encoding_overfit(train: DataFrame, val: DataFrame, label: str, columns: list[str] | None = None, limit: float = 0.15) -> DataFrame:
    """(column, gap) of target encodings that tell the label in training far better than in validation."""
    columns = columns if columns is not None else [c for c in train.columns if TE_NAME.search(c)]
    if not columns:
        return train.sparkSession.createDataFrame([], "column string, gap double")
    side = lambda df, n: _all(df, columns).join(auc(unpivot(df, columns, label)), "column", "left").select("column", F.abs(F.coalesce("auc", F.lit(0.5)) - 0.5).alias(n))
    return side(train, "a").join(side(val, "b"), "column").select("column", (F.col("a") - F.col("b")).alias("gap")).where(F.col("gap") > limit).orderBy(F.desc("gap"))


def validate(splits: dict[str, DataFrame], label: str, base_width: int | None = None, max_null_rate: float = 0.05, max_width: int = 200, max_growth: float = 3.0) -> tuple[bool, list[str]]:
    """(passed, messages): one aggregate a split, the rest is read off the schemas."""
    messages: list[str] = []
    first_name, first = next(iter(splits.items()))
    for name, df in splits.items():
        if len(set(df.columns)) != len(df.columns):
            messages.append(f"{name}: repeated column names")
            continue
        missing, extra = schema_difference(first, df)
        if missing or extra:
            messages.append(f"{name}: columns differ from {first_name}: -{missing} +{extra}")
        features = [c for c in df.columns if c != label]
        odd = [f.name for f in df.schema.fields if f.name != label and not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        if odd:
            messages.append(f"{name}: not numeric: {odd}")
        if len(features) > max_width:
            messages.append(f"{name}: {len(features)} columns; the most is {max_width}")
        if base_width and len(features) > max_growth * base_width:
            messages.append(f"{name}: {len(features)} columns from {base_width}")
        row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(f"n{i}") for i, c in enumerate(features)), *([F.min(label).alias("lo"), F.max(label).alias("hi"), F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()).alias("bad")] if label in df.columns else [])).first()
        if label in df.columns and row["bad"]:
            messages.append(f"{name}: the label isn't 0 or 1 in {row['bad']} rows")
        rates = sorted(((row[f"n{i}"] or 0.0, c) for i, c in enumerate(features)), reverse=True)
        worst = [(c, round(r, 4)) for r, c in rates if r > max_null_rate][:5]
        if worst:
            messages.append(f"{name}: null rates over {max_null_rate}: {worst}")
    return not messages, messages
