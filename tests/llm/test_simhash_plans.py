"""Rows of index keys are never broadcast, however small Spark takes them for."""

from pyspark.sql import functions as F

from ledgerlens.llm import simhash


def test_rows_of_keys_are_not_broadcast(spark):
    named = spark.range(2000).select(F.xxhash64("id").alias("node"), F.col("id").alias("label"))
    for keys in (simhash.whole_keys, simhash.keys_of):
        flat = simhash.exploded(named, keys(F.col("node")))
        ends = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        plan = flat.join(ends, "key")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    pairs = named.select(F.col("node").alias("x"), F.explode(F.array("label", "node")).alias("y"))
    written = []
    keep, simhash.written = simhash.written, lambda s, df, name: written.append(df) or df
    try:
        simhash.between(named, simhash.linked(pairs))
    finally:
        simhash.written = keep
    first = written[0].where("a IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert "leftHint=(strategy=merge)" in first
