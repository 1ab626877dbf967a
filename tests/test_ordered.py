"""A stream that comes out of order gives the answers of the batch."""

import random

from pyspark.sql import functions as F

from ledgerlens.schema import HOUR, MINUTE
from ledgerlens.streaming.ordered import ordered_velocity


def test_disordered_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i % 3, (i * 2 + 100) * MINUTE + rng.randrange(3) * MINUTE, float(rng.randrange(1, 9))) for i in range(240)]
    # within 20 minutes of their order, in twelve files; then one far later event, and one that comes too late
    order = sorted(rows, key=lambda r: r[2] + rng.randrange(20) * MINUTE)
    files = [order[i : i + 20] for i in range(0, 240, 20)] + [[(900, 0, 99 * HOUR, 1.0)], [(901, 1, 3 * HOUR, 50.0)], [(902, 2, 199 * HOUR, 1.0)]]
    kind = "row_id long, k long, t long, amount double"
    src = tmp_path / "in"
    for i, part in enumerate(files):
        spark.createDataFrame(part, kind).withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.parquet(str(tmp_path / "parts" / f"{i}"))
    src.mkdir()
    for i in range(len(files)):
        made = next((tmp_path / "parts" / f"{i}").glob("part-*.parquet"))
        made.rename(src / f"{i:03d}.parquet")
        import os

        os.utime(src / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    events = spark.readStream.schema(kind + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = ordered_velocity(events, "k", "row_id", "t", "amount", HOUR, late="25 minutes")
    q = out.writeStream.outputMode("append").format("memory").queryName("q_ordered").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r["row_id"]: (r["n"], r["total"]) for r in spark.table("q_ordered").collect()}
    rows.append((900, 0, 99 * HOUR, 1.0))
    for i, k, t, _ in rows:
        own = [a for j, kk, s, a in rows if kk == k and t - HOUR <= s and (s, j) < (t, i)]
        assert got[i] == (len(own), sum(own))
    # the last event's time hasn't passed, and the late one was dropped
    assert set(got) == {r[0] for r in rows}
    dropped = sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1
