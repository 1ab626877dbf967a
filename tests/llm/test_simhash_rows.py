"""How often op13 joins the rows of its buckets."""

import random
import re

from pyspark.sql import functions as F

from ledgerlens.llm import common, simhash


def test_rows_of_buckets_are_joined_four_times(spark, monkeypatch):
    """Once for their leaders, once for the open ones' label and further leader, twice for what is left of large buckets."""
    common.ready(spark)
    rng, base = random.Random(6), 0x0123456789ABCDEF
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(30), rng.randrange(1, 6))) for _ in range(90)})
    rows = spark.createDataFrame([(i, simhash.signed(v)) for i, v in enumerate(values)], "doc_id long, node long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "node"))
    joins, write = [], simhash.written

    def counted(session, df, label):
        joins.extend(re.findall(r"Join Inner, .*key#", df._jdf.queryExecution().optimizedPlan().toString()))
        return write(session, df, label)

    monkeypatch.setattr(simhash, "written", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_simhash(rows.withColumn("text", F.lit(""))).collect()}
    label = {i: i for i in range(len(values))}
    for _ in range(12):
        label = {i: min(label[j] for j, y in enumerate(values) if (x ^ y).bit_count() <= 4) for i, x in enumerate(values)}
    assert got == label and len(joins) == 4


def test_rows_of_closed_buckets_are_not_joined(spark, monkeypatch):
    """A group of near copies is joined by its whole segments; of the index's keys, only rows of buckets with several
    components are, so a group twice as large makes twice the rows."""
    common.ready(spark)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "node"))
    write, made = simhash.written, []

    def counted(session, df, label):
        out = write(session, df, label)
        if {"node", "key"} <= set(out.columns):
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    base, sums = 0x0123456789ABCDEF, []
    for n in (12, 24):
        # one bit of `base` changed, all in two segments
        rows = spark.createDataFrame([(i, simhash.signed(base ^ 1 << i)) for i in range(n)], "doc_id long, node long")
        made.clear()
        got = simhash.near_simhash(rows.withColumn("text", F.lit(""))).collect()
        assert {r["component_id"] for r in got} == {0}
        assert sum(made) <= 5 * n
        sums.append(sum(made))
    assert sums[1] <= 2.5 * sums[0]
