"""Vectors of entities by sparse random projection of what they share.

Every entity starts with a sparse random vector from a hash of itself. A round averages the vectors of each attribute value's
entities, and then of each entity's values: as many rows as memberships, never pairs of entities. A vector is the weighted sum of
the rounds, so entities that share values, directly or over others, come to lie close, and equal neighbourhoods coincide.

Averages are sums with partial sums where rows are read, so a value that a third of all entities have is added up in parts; what
each round makes is written, so a lost executor repeats one round.

Cases: null entities and null values are no members; repeated rows are one membership; an entity without known values has no
vector; values of different attributes never meet; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .metrics import uniform


def memberships(df: DataFrame, entity: str, attributes: list[str]) -> DataFrame:
    """Distinct (entity, attribute, value as text)."""
    held = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes)))
    return df.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), held.alias("m")).select("entity", "m.*").where("value IS NOT NULL").distinct()


def starting(entity: Column, dim: int, seed: int) -> Column:
    """The square root of 3, its negative, or mostly 0: by a hash of the entity."""
    u = uniform(F.lit(seed), F.lit(dim), entity)
    return F.when(u < 1 / 6, math.sqrt(3)).when(u >= 5 / 6, -math.sqrt(3)).otherwise(0.0)


def embedding(df: DataFrame, entity: str, attributes: list[str], dims: int = 16, weights: tuple[float, ...] = (0.0, 1.0, 0.5), seed: int = 3) -> DataFrame:
    """(entity, e0, e1, ...): `weights` are those of the starting vectors and of each round's."""
    spark, names = df.sparkSession, [f"e{i}" for i in range(dims)]
    held = written(spark, memberships(df, entity, attributes), "memberships")
    now = held.select("entity").distinct().select("entity", *(starting(F.col("entity"), i, seed).alias(n) for i, n in enumerate(names)))
    rounds = []
    for weight in weights:
        if rounds:
            means = lambda *by: held.join(now, list(now.columns[: -len(names)])).groupBy(*by).agg(*(F.avg(n).alias(n) for n in names))  # noqa: E731, B023
            now = written(spark, means("attribute", "value"), "value-vectors")
            now = means("entity")
        now = written(spark, now, "entity-vectors")
        rounds.append((weight, now))
    parts = [d.select("entity", *((F.col(n) * w).alias(n) for n in names)) for w, d in rounds if w]
    total = reduce(DataFrame.unionAll, parts or [now.select("entity", *(F.lit(0.0).alias(n) for n in names))])
    return total.groupBy(F.col("entity").alias(entity)).agg(*(F.sum(n).alias(n) for n in names))
