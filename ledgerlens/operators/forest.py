"""Isolation forest: rows that random cuts set apart early are unusual.

Each tree is built in a task from `sample` rows chosen by a hash of their ids, so the trees don't depend on partitions; trees
come to the driver as arrays (a number of nodes that `trees` and `sample` bound), and all rows are scored in one scan.

Cases: a null or NaN goes to the right of every cut on its column and is no end of a column's range; a tree without rows, or
whose rows don't differ, is one leaf; fewer rows than `sample` all take part; an empty table gives scores of 1 to any row (path 0);
other columns pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import numbers


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n values: the path that a leaf of n rows leaves out."""
    return 0.0 if n < 2 else 2 * sum(1 / i for i in range(1, n)) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Per tree: column of each node (-1 is a leaf), cut, left child (the right one follows it), path length of a leaf."""

    columns: list[str]
    trees: list[tuple[list[int], list[float], list[int], list[float]]]
    sample: int

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row of x."""
        total = np.zeros(len(x))
        for column, cut, left, length in (tuple(map(np.array, t)) for t in self.trees):
            at = np.zeros(len(x), np.int64)
            while (inner := column[at] >= 0).any():
                rows, n = np.flatnonzero(inner), at[inner]
                at[rows] = left[n] + ~(x[rows, column[n]] < cut[n])
            total += length[at]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, seed: int) -> tuple[list[int], list[float], list[int], list[float]]:
    """A tree over the rows of x: random columns, random cuts inside the rows' range, as deep as a balanced tree of them."""
    rng, limit = np.random.default_rng(seed), math.ceil(math.log2(max(2, len(x))))
    column, cut, left, length = [-1], [0.0], [0], [0.0]
    open_ = [(0, np.arange(len(x)), 0)]
    while open_:
        node, rows, depth = open_.pop()
        own = x[rows]
        known = ~np.isnan(own)
        low, high = np.where(known, own, np.inf).min(0, initial=np.inf), np.where(known, own, -np.inf).max(0, initial=-np.inf)
        wide = np.flatnonzero(low < high)
        if depth >= limit or len(rows) < 2 or not len(wide):
            length[node] = depth + mean_path(len(rows))
            continue
        c = int(rng.choice(wide))
        at = float(rng.uniform(low[c], high[c]))
        at = at if at > low[c] else float(high[c])  # both sides keep a row
        column[node], cut[node], left[node] = c, at, len(column)
        goes = own[:, c] < at
        for part in (rows[goes], rows[~goes]):
            open_.append((len(column), part, depth + 1))
            for name, value in ((column, -1), (cut, 0.0), (left, 0), (length, 0.0)):
                name.append(value)
    return column, cut, left, length


def fit_forest(df: DataFrame, columns: list[str], row_id: str, trees: int = 100, sample: int = 256, seed: int = 7) -> IsolationForest:
    """Trees of `sample` rows each; which rows is decided by hashes of the row ids."""
    n = df.count()
    share = int(min(1.0, 2 * sample / max(1, n)) * (1 << 30))
    names = [f"f{i}" for i in range(len(columns))]
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(row_id)), F.lit(1 << 30))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)
    rows = df.select(F.explode(chosen).alias("tree"), F.col(row_id), *(F.col(c).cast("double").alias(f) for c, f in zip(columns, names, strict=True))).withColumn("draw", draw(F.col("tree")))

    def build(table: pa.Table) -> pa.Table:
        own = table.sort_by([("draw", "ascending"), *((f, "ascending") for f in names)]).slice(0, sample)
        x = np.stack([own.column(f).to_numpy().astype(float) for f in names], 1)
        tree = own.column("tree")[0].as_py()
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.float64())
        return pa.table([pa.array([tree], pa.int32()), *(pa.array([v], pa.list_(k)) for v, k in zip(grow(x, seed * 100_003 + tree), kinds, strict=True))], ["tree", "c", "cut", "l", "len"])

    got = rows.select("tree", "draw", *names).groupBy("tree").applyInArrow(build, "tree int, c array<int>, cut array<double>, l array<int>, len array<double>").collect()
    return IsolationForest(columns, [(r["c"], r["cut"], r["l"], r["len"]) for r in sorted(got, key=lambda r: r["tree"])], min(sample, n))


def score_forest(df: DataFrame, model: IsolationForest, name: str = "isolation") -> DataFrame:
    """Adds the score, 0 to 1: near 1 where paths are short, 0.5 where they are as long as those of random rows."""
    at = [f"if_{i}" for i in range(len(model.columns))]
    rest = df.drop(name)
    rows = rest.withColumns({a: F.col(c).cast("double") for a, c in zip(at, model.columns, strict=True)})
    usual = mean_path(model.sample) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(numbers(batch, at), 1)
            kept = [batch.column(i) for i in range(batch.num_columns - len(at))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(2.0 ** (-model.paths(x) / usual))], [*batch.schema.names[: len(kept)], name])

    return rows.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())]))
