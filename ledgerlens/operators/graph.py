"""Entities linked by shared attributes: components, rates of communities, ranks, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, written


def shared_links(df: DataFrame, entity: str, attribute: str) -> DataFrame:
    """(a, b): each entity of an attribute's value and the least entity of that value. As many links as members,
    and the same components as all pairs would give."""
    pairs = df.where(F.col(entity).isNotNull() & F.col(attribute).isNotNull()).select(F.col(entity).alias("b"), F.col(attribute).alias("x")).distinct()
    least = pairs.groupBy("x").agg(F.min("b").alias("a"))
    return pairs.join(least, "x").where("a <> b").select("a", "b").distinct()


def memberships(df: DataFrame, entity: str, attribute: str) -> DataFrame:
    """(node, x): the entities and their attribute values, once each: the edges of the graph of both."""
    return df.where(F.col(entity).isNotNull() & F.col(attribute).isNotNull()).select(F.col(entity).alias("node"), F.col(attribute).alias("x")).distinct()


def degree_neighbours(df: DataFrame, entity: str, attribute: str) -> DataFrame:
    """(entity, links): over the entity's values, how many other holders they have, without making the pairs."""
    pairs = df.where(F.col(entity).isNotNull() & F.col(attribute).isNotNull()).select(entity, attribute).distinct()
    holders = pairs.groupBy(attribute).agg((F.count(F.lit(1)) - 1).alias("others"))
    return pairs.join(holders, attribute).groupBy(entity).agg(F.sum("others").alias("links"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): least node that links reach, by least labels and pointer jumping."""
    spark = links.sparkSession
    both = written(spark, links.select(F.col("a").alias("s"), F.col("b").alias("d")).unionAll(links.select(F.col("b").alias("s"), F.col("a").alias("d"))).distinct(), "edges")
    labels = written(spark, both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("d"), F.first("s")).alias("component")), "labels")
    moved = 1
    while moved:
        near = both.join(labels.withColumnRenamed("node", "d"), "d").groupBy(F.col("s").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = written(spark, low.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        moved = new.where("was <> component").limit(1).count()
        labels = new.select("node", "component")
    return labels


def community_rate(df: DataFrame, comps: DataFrame, entity: str, label: str) -> DataFrame:
    """(component, members, rate)."""
    rows = df.join(comps, df[entity] == comps["node"])
    return rows.groupBy("component").agg(F.count_distinct(entity).alias("members"), F.avg(label).alias("rate"))


def pagerank(links: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds over undirected links; ranks add up to the number of nodes."""
    spark = links.sparkSession
    both = links.select(F.col("a").alias("s"), F.col("b").alias("d")).unionAll(links.select(F.col("b").alias("s"), F.col("a").alias("d"))).distinct()
    both = written(spark, both.join(both.groupBy("s").agg(F.count(F.lit(1)).alias("deg")), "s"), "ranked-edges")
    ranks = both.select(F.col("s").alias("node")).distinct().withColumn("rank", F.lit(1.0))
    for i in range(rounds):
        sent = both.join(ranks, both["s"] == ranks["node"]).groupBy(F.col("d").alias("node")).agg((F.lit(1 - damping) + damping * F.sum(F.col("rank") / F.col("deg"))).alias("rank"))
        ranks = written(spark, sent, "ranks") if i % 5 == 4 else sent
    return ranks


def shared_pagerank(df: DataFrame, entity: str, attribute: str, damping: float = 0.85, close: float = 1e-6) -> DataFrame:
    """(node, rank) of the entities in the graph of entities and attribute values; ranks of both add up to their number.
    Values take the ranks of entities and then entities those of values, until four such rounds change no entity's rank
    by over `close` times its number of values. Rank by number of values contracts, so this ends."""
    spark, pairs = df.sparkSession, memberships(df, entity, attribute)
    of_nodes, of_values = (pairs.groupBy(c).agg(F.count(F.lit(1)).alias(n)) for c, n in (("node", "n"), ("x", "m")))
    of_nodes = written(spark, of_nodes, "degrees")
    edges = written(spark, pairs.join(of_nodes, "node").join(of_values, "x"), "ranked-edges")
    taken = lambda share: F.lit(1 - damping) + damping * F.sum(share)
    ranks = written(spark, edges.select("node").distinct().withColumn("rank", F.lit(1.0)), "ranks")
    moved = close + 1
    while moved > close:
        new = ranks
        for _ in range(4):
            values = edges.join(new, "node").groupBy("x").agg(taken(F.col("rank") / F.col("n")).alias("value_rank"))
            new = edges.join(values, "x").groupBy("node").agg(taken(F.col("value_rank") / F.col("m")).alias("rank"))
        both = written(spark, new.join(ranks.withColumnRenamed("rank", "was"), "node").join(of_nodes, "node"), "ranks")
        moved = both.agg(F.max(F.abs(F.col("rank") - F.col("was")) / F.col("n"))).first()[0] or 0.0
        ranks = both.select("node", "rank")
    return ranks


def distance_by_shared(df: DataFrame, entity: str, attribute: str, sources: DataFrame) -> DataFrame:
    """(node, hops): over how many shared values each entity reaches its nearest source (node), without a limit; entities
    that reach none are left out. A round takes the last entities found to their values and on to the values' holders,
    which can only be among the last two rounds' or new."""
    spark, folder = df.sparkSession, scratch_path(df.sparkSession, "hops")
    pairs = written(spark, memberships(df, entity, attribute), "members")
    kept = lambda rows, hop: rows.write.parquet(f"{folder}/{hop}") or spark.read.schema(rows.schema).parquet(f"{folder}/{hop}")
    last = kept(sources.select("node").where("node IS NOT NULL").distinct().withColumn("hops", F.lit(0)), 0)
    before, hop = last, 0
    while last.limit(1).count():
        hop += 1
        values = last.select("node").join(pairs, "node").select("x").distinct()
        step = values.join(pairs, "x").select("node").distinct().join(last.unionAll(before).select("node"), "node", "left_anti")
        before, last = last, kept(step.withColumn("hops", F.lit(hop)), hop)
    return spark.read.schema(last.schema).parquet(*(f"{folder}/{i}" for i in range(hop + 1)))


def distance_to(links: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops) of the nodes that reach a source (node), within `most` links if given."""
    spark = links.sparkSession
    both = written(spark, links.select(F.col("a").alias("s"), F.col("b").alias("d")).unionAll(links.select(F.col("b").alias("s"), F.col("a").alias("d"))).distinct(), "edges")
    found, hop, new = sources.select("node").distinct().withColumn("hops", F.lit(0)), 0, 1
    while new and (most is None or hop < most):
        hop += 1
        step = found.where(F.col("hops") == hop - 1).join(both, F.col("node") == F.col("s")).select(F.col("d").alias("node")).distinct()
        found = written(spark, found.unionAll(step.join(found.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))), "hops")
        new = found.where(F.col("hops") == hop).limit(1).count()
    return found
