"""The pipeline's language stage learns from all labelled rows."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import common, langid

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_models_and_least_gains_come_from_all_labelled_rows(spark, monkeypatch):
    import corpus_pipeline

    common.ready(spark)
    more = langid.TRAIN_DOCS + 500
    rows = spark.range(more).select(F.col("id").alias("doc_id"), F.concat(F.lit("the man and the sea number "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    rows = rows.unionAll(spark.range(more, more + 50).select("id", F.lit("der mann und das meer"), F.lit("de"))).unionAll(spark.range(-9, 0).select("id", F.lit("la mer"), F.lit(None)))
    learned, judged = [], []
    fit, floors = langid.expected_pieces, langid.quantiles
    monkeypatch.setattr(langid, "expected_pieces", lambda counts, *a: (learned.append({r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect()}), fit(counts, *a))[1])
    monkeypatch.setattr(langid, "quantiles", lambda found, *a: (judged.append(found.count()), floors(found, *a))[1])
    kept = corpus_pipeline.language_stage(spark, common.written(spark, rows, "many"), SMALL)
    assert learned == [{"en": 7 * more, "de": 5 * 50}] * langid.ROUNDS
    assert judged == [more + 50]
    assert kept.where("lang IS NOT NULL").count() == more + 50
