"""Connected components over a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b): label is the least node that can be reached.

    Every round takes the least label among a node's neighbours and then the label of its label, so the number of
    rounds grows with the logarithm of a component's width. Each round's table is written, which cuts the lineage.
    """
    spark = links.sparkSession
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).where("src <> dst")
    edges = written(spark, both.distinct(), "edges")
    labels = written(spark, edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(spark, low.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        moved = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
