"""Spark session defaults: UTC, adaptive execution, partitions sized by bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Skewed joins and small shuffle partitions are left to adaptive execution; sizes are by partition, not by table.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def session(app: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()
