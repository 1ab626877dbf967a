"""Scans: split files, CSV, TSV, JSON lines, configuration, and parameterised SQL."""

from __future__ import annotations

import dataclasses
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "val", "oot")


def read_splits(spark: SparkSession, folder: str, prefix: str, label: str | None = None) -> DataFrame:
    """`{folder}/{prefix}_{split}.parquet` of the three splits as one table with a column `split`; `label` is renamed."""
    parts = [spark.read.parquet(f"{folder}/{prefix}_{s}.parquet").withColumn("split", F.lit(s)) for s in SPLITS]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.withColumnRenamed(label, "label") if label and label != "label" else out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def from_template(spark: SparkSession, sql: str, names: dict[str, str], values: dict[str, Any], segment: str = "1=1") -> DataFrame:
    """Runs a query with `{table}` style names (identifiers only) and `:value` parameters; `{segment}` is a predicate."""
    for key, name in names.items():
        if not re.fullmatch(r"[A-Za-z_][\w]*(\.[A-Za-z_][\w]*)*", name):
            raise ValueError(f"not an identifier: {key}={name!r}")
    return spark.sql(sql.format(**names, segment=segment), args=values)


def load_config(path: str) -> dict[str, Any]:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def config_as(kind: type, values: dict[str, Any]) -> Any:
    """A frozen dataclass from a dictionary, unknown keys ignored."""
    return kind(**{f.name: values[f.name] for f in dataclasses.fields(kind) if f.name in values})


def load_plan(path: str) -> Any:
    """A user's feature module (`fit`, `transform`) from a file."""
    import importlib.util

    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module
