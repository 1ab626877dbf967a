"""Results kept as Parquet under a key of the query and its window."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def cache_key(sql: str, segment: str, split: str, start: str, end: str) -> str:
    return "_".join((hashlib.sha256(sql.encode()).hexdigest()[:16], segment, split, start, end))


def _path(spark: SparkSession, folder: str, key: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{key}.parquet")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], max_rows: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The stored rows of `key`, or those of `make`, stored first; `max_rows` is cut in the given order."""
    path, files = _path(spark, folder, key)
    if not files.exists(path):
        df = make()
        if max_rows is not None:
            df = (df.orderBy(*order) if order else df).limit(max_rows)
        df.write.parquet(path.toString())
    return spark.read.parquet(path.toString())


def invalidate(spark: SparkSession, folder: str, key: str) -> bool:
    path, files = _path(spark, folder, key)
    return bool(files.delete(path, True))
