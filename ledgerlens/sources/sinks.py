"""Parquet, JSON line and tab-separated sinks, with values cleaned for JSON."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared_log import SharedLog


def write_splits(df: DataFrame, folder: str, prefix: str) -> None:
    for split in ("train", "val", "oot"):
        df.where(F.col("split") == split).drop("split").write.mode("overwrite").parquet(f"{folder}/{prefix}_{split}.parquet")


def clean_columns(df: DataFrame, digits: int = 6) -> DataFrame:
    """NaN and infinities become null, doubles are rounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.round(c, digits)).alias(f.name)
        out.append(c)
    return df.select(*out)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    clean_columns(df).write.mode(mode).json(path)


def clean(value: Any, digits: int = 6) -> Any:
    """The same for one record in Python."""
    if isinstance(value, dict):
        return {str(k): clean(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v, digits) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, digits) if math.isfinite(value) else None
    return value


def append_record(spark: SparkSession, folder: str, record: dict[str, Any]) -> int:
    """Adds a record to the log in a shared folder; returns its number. `readers.read_log` reads `folder/records`."""
    return SharedLog(spark, folder).append(lambda _: json.dumps(clean(record)) + "\n")


def append_tsv(spark: SparkSession, folder: str, fields: list[str], record: dict[str, Any]) -> int:
    """The same as tab-separated text, each part with the names of its fields; `readers.read_tsv` reads `folder/records`."""
    line = "\t".join(str(record.get(k, "")) for k in fields)
    return SharedLog(spark, folder, "tsv").append(lambda _: "\t".join(fields) + "\n" + line + "\n")
