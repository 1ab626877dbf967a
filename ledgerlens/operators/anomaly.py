"""Anomaly scores: distance from the mean, reconstruction error, cluster distance, hidden states."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .profiles import lookup, rfm
from .scan import PART_ROWS, dealt, scan
from .stats import quantiles


def standardisation(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and deviations, nulls as 0."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return df.agg(*(x for i, c in enumerate(filled) for x in (F.avg(c).alias(f"zm{i}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"zs{i}"))))


def mahalanobis_like(df: DataFrame, fitted: DataFrame, columns: list[str], floor: float = 0.001) -> DataFrame:
    """Root of the summed squared z-scores and the largest squared z-score, over at most 20 columns."""
    z2 = [F.pow((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"zm{i}")) / F.greatest(F.col(f"zs{i}"), F.lit(floor)), 2) for i, c in enumerate(columns)]
    out = df.crossJoin(F.broadcast(fitted)).withColumns({"anomaly_mahalanobis": F.sqrt(sum(z2[1:], z2[0])), "anomaly_max_zscore": F.greatest(*z2) if len(z2) > 1 else z2[0]})
    return out.drop(*(f"z{k}{i}" for i in range(len(columns)) for k in "ms"))


def nearest_centroid(point: list[Column], centers) -> dict[str, Column]:
    """Number and distance of the nearest of a few centroids, which are literals of the plan: no join."""
    gaps = F.array(*(F.sqrt(sum(((x - float(c)) * (x - float(c)) for x, c in zip(point[1:], center[1:], strict=True)), (point[0] - float(center[0])) * (point[0] - float(center[0])))) for center in centers))
    return {"cluster": (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"), "distance": F.array_min(gaps)}


def rfm_clusters(df: DataFrame, key: str, t: str, amount: str, clusters: int = 8, seed: int = 42):
    """(profile with cluster and distance, fitted model) of recency, frequency and monetary value."""
    base = rfm(df, key, t, amount)
    stats = standardisation(base, ["recency", "frequency", "monetary"])
    z = base.crossJoin(F.broadcast(stats))
    z = z.select(key, *((F.col(c) - F.col(f"zm{i}")) / F.greatest(F.col(f"zs{i}"), F.lit(0.001)) for i, c in enumerate(("recency", "frequency", "monetary")))).toDF(key, "zr", "zf", "zmo")
    rows = VectorAssembler(inputCols=["zr", "zf", "zmo"], outputCol="features").transform(z)
    n = rows.count()
    if n < 2:
        return rows.select(key, F.lit(0).alias("rfm_cluster"), F.lit(0.0).alias("rfm_distance")), None
    model = KMeans(k=max(2, min(clusters, n // 2)), seed=seed).fit(rows)
    near = nearest_centroid([F.col(c) for c in ("zr", "zf", "zmo")], model.clusterCenters())
    return rows.select(key, near["cluster"].alias("rfm_cluster"), near["distance"].alias("rfm_distance")), model


def rfm_distance(df: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Distance, its log and the cluster by row; an unknown entity has the median distance."""
    mid = quantiles(profile, "rfm_distance", (0.5,)).select(F.col("quantiles")[0].alias("rfm_mid"))
    out = lookup(df, profile, key, {"rfm_cluster": -1}).crossJoin(F.broadcast(mid))
    return out.withColumn("rfm_distance", F.coalesce("rfm_distance", "rfm_mid")).withColumn("rfm_log_distance", F.log1p("rfm_distance")).drop("rfm_mid")


class Autoencoder:
    """Four linear layers with rectifiers between, trained by Adam to rebuild standardised columns."""

    def __init__(self, width: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        sizes = [width, max(2, width // 2 + 1), max(1, width // 4 + 1), max(2, width // 2 + 1), width]
        self.layers = [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:], strict=False)]
        self.center, self.scale = np.zeros(width), np.ones(width)

    def rebuild(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            if keep is not None:
                keep.append(x)
            x = x @ w + b
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0)
        return x

    def fit(self, x: np.ndarray, epochs: int = 30, rate: float = 0.005, seed: int = 42) -> Autoencoder:
        self.center, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z, rng = np.clip((x - self.center) / self.scale, -10, 10), np.random.default_rng(seed)
        moments, step = [[np.zeros_like(p), np.zeros_like(p)] for layer in self.layers for p in layer], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                step += 1
                inputs: list = []
                d = 2 * (self.rebuild(z[part], inputs) - z[part]) / z[part].size
                for i in range(len(self.layers) - 1, -1, -1):
                    w, b = self.layers[i]
                    grads = (inputs[i].T @ d, d.sum(0))
                    d = (d @ w.T) * (inputs[i] > 0) if i else d
                    for j, (p, g) in enumerate(zip((w, b), grads, strict=True)):
                        m = moments[2 * i + j]
                        m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                        p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        return self

    def errors(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -10, 10)
        return (self.rebuild(z) - z) ** 2


def fit_autoencoder(df: DataFrame, label_free: DataFrame, columns: list[str], row_id: str, sample: int = 20_000, least: int = 100) -> Autoencoder | None:
    """Fits on about `sample` rows of negatives (`label_free`, already filtered), chosen by hash; None under `least` rows
    or two columns."""
    n = label_free.count()
    if n < least or len(columns) < 2:
        return None
    chosen = label_free.where(F.pmod(F.xxhash64(F.lit("ae"), row_id), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
    x = np.array(chosen.orderBy(row_id).select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).collect(), float)
    return Autoencoder(len(columns)).fit(x)


def reconstruction_error(df: DataFrame, model: Autoencoder, columns: list[str]) -> DataFrame:
    """Adds mean, log and largest reconstruction error by row, in Arrow batches."""
    @F.pandas_udf("mean double, largest double")
    def errors(rows: pd.Series) -> pd.DataFrame:
        e = model.errors(np.stack(rows.to_list()).astype(float)) if len(rows) else np.zeros((0, 1))
        return pd.DataFrame({"mean": e.mean(1), "largest": e.max(1)})

    out = df.withColumn("ae", errors(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))))
    return out.withColumns({"ae_error": F.col("ae.mean"), "ae_log_error": F.log1p("ae.mean"), "ae_max_error": F.col("ae.largest")}).drop("ae")


class GaussianHmm:
    """Hidden states with diagonal normals; fitted by expectation-maximisation on a bounded set of sequences."""

    def __init__(self, states: int, width: int):
        self.start, self.move = np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        self.move /= self.move.sum(1, keepdims=True)
        self.mean, self.var = np.zeros((states, width)), np.ones((states, width))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        d = (x[:, None, :] - self.mean) ** 2 / self.var + np.log(2 * np.pi * self.var)
        return -0.5 * d.sum(2)

    def likelihoods(self, x: np.ndarray) -> np.ndarray:
        """Densities of rows by state, up to a factor by row."""
        log_b = self.log_density(x)
        return np.exp(log_b - log_b.max(1, keepdims=True)) + 1e-300

    def passage(self, x: np.ndarray, first: bool) -> np.ndarray:
        """(k, k) what rows make of the forward vector before them, up to a factor; of the start distribution if `first`,
        then in each line."""
        b = self.likelihoods(x)
        m = np.tile(self.start * b[0], (len(self.start), 1)) if first else self.move * b[0]
        for row in b[1:]:
            m = m / m.sum() @ self.move * row
        return m / m.sum()

    def posteriors(self, x: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """State probabilities by row, and summed transition probabilities: scaled forward and backward passes, from the
        forward vector of the row before and the backward vector of the last row if x is a part of a sequence."""
        b = self.likelihoods(x)
        n, k = b.shape
        a, scale, beta = np.zeros((n, k)), np.zeros(n), np.ones((n, k))
        for i in range(n):
            a[i] = (a[i - 1] @ self.move if i else self.start if before is None else before @ self.move) * b[i]
            scale[i] = a[i].sum()
            a[i] /= scale[i]
        pairs = np.zeros((k, k))
        if after is not None:
            beta[-1] = after
        for i in range(n - 2, -1, -1):
            beta[i] = self.move @ (b[i + 1] * beta[i + 1]) / scale[i + 1]
            pairs += a[i][:, None] * self.move * (b[i + 1] * beta[i + 1]) / scale[i + 1]
        g = a * beta
        return g / g.sum(1, keepdims=True), pairs

    def fit(self, sequences: list[np.ndarray], rounds: int = 10) -> GaussianHmm:
        every = np.vstack(sequences)
        k = len(self.start)
        self.mean = np.quantile(every, (np.arange(k) + 0.5) / k, axis=0)
        self.var = np.tile(every.var(0) + 1e-3, (k, 1))
        for _ in range(rounds):
            got = [self.posteriors(x) for x in sequences]
            g = np.vstack([p for p, _ in got])
            weight = g.sum(0)[:, None] + 1e-6
            self.start = np.mean([p[0] for p, _ in got], 0) + 1e-6
            self.start /= self.start.sum()
            moves = sum(m for _, m in got) + 1e-3
            self.move = moves / moves.sum(1, keepdims=True)
            self.mean = g.T @ every / weight
            self.var = g.T @ every**2 / weight - self.mean**2 + 1e-3
        return self


HMM_COLUMNS = ("h_amount", "h_hour", "h_dow")


def hmm_rows(df: DataFrame, amount: str, t: str) -> DataFrame:
    return df.withColumns({"h_amount": F.log1p(F.col(amount)), "h_hour": F.pmod(F.floor(F.col(t) / 3_600_000_000), F.lit(24)) / 24.0, "h_dow": F.pmod(F.floor(F.col(t) / 86_400_000_000) + 3, F.lit(7)) / 7.0})


def fit_hmm(df: DataFrame, key: str, t: str, row_id: str, amount: str, states: int = 3, sequences: int = 200, longest: int = 200, least: int = 10) -> GaussianHmm | None:
    """Fits on about `sequences` entities chosen by hash, the first `longest` rows of each (a bound on a model's sample)."""
    from pyspark.sql import Window as W

    rows = hmm_rows(df.where(F.col(key).isNotNull()), amount, t)
    n = rows.select(key).distinct().count()
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("hmm"), key), F.lit(1 << 30)) < int(min(1.0, sequences / max(1, n)) * (1 << 30)))
    chosen = chosen.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(t, row_id))).where(F.col("rn") <= longest)
    got: dict = {}
    for r in chosen.orderBy(key, "rn").select(key, *HMM_COLUMNS).collect():
        got.setdefault(r[0], []).append(list(r)[1:])
    seqs = [np.array(s, float) for s in got.values() if len(s) >= 3]
    return GaussianHmm(states, len(HMM_COLUMNS)).fit(seqs) if len(seqs) >= least else None


def hmm_features(df: DataFrame, model: GaussianHmm, key: str, t: str, row_id: str, amount: str, most: int = PART_ROWS, chunk: int = 512, fan: int = 256) -> DataFrame:
    """(row_id, hmm_state, hmm_p0.., hmm_entropy): posteriors along each entity's rows. Entities are cut into chunks of 512
    rows (places by a scan); each chunk of a longer entity passes on a small matrix, matrices are multiplied in a tree, and
    from it come the vectors that each chunk's forward and backward passes begin with, so results are those of the whole
    entity, and no task sees more than a chunk's rows or `fan` matrices."""
    k, spark = len(model.start), df.sparkSession
    rows = hmm_rows(df, amount, t).select(F.col(row_id).cast("long").alias("row_id"), F.col(key).alias("key"), F.col(t).alias("at"), *HMM_COLUMNS)
    rows = scan(dealt(rows, "key", ["at", "row_id"], most), {"rn": ("count", F.lit(1))}).plain()
    narrow = written(spark, rows.select("row_id", "key", F.floor((F.col("rn") - 1) / chunk).alias("chunk"), "rn", *HMM_COLUMNS), "hmm-rows")
    name, kind = narrow.schema["key"].dataType.simpleString(), pa.list_(pa.float64())

    def values(table: pa.Table) -> np.ndarray:
        return np.nan_to_num(np.stack([table.column(c).to_numpy().astype(float) for c in HMM_COLUMNS], 1))

    def row(table: pa.Table, at: int, m: np.ndarray) -> pa.Table:
        return pa.table({"key": table.column("key").slice(0, 1), "chunk": pa.array([at], pa.int64()), "m": pa.array([m.ravel().tolist()], kind)})

    def pass_on(table: pa.Table) -> pa.Table:
        own = table.sort_by("rn")
        at = own.column("chunk")[0].as_py()
        return row(own, at, model.passage(values(own), at == 0))

    def matrices(own: pa.Table) -> list[np.ndarray]:
        return [np.array(x).reshape(k, k) for x in own.column("m").to_pylist()]

    def multiply(table: pa.Table) -> pa.Table:
        own = table.sort_by("chunk")
        whole = np.eye(k)
        for x in matrices(own):
            whole = whole @ x
            whole /= whole.sum()
        return row(own, own.column("chunk")[0].as_py() // fan, whole)

    def descend(table: pa.Table) -> pa.Table:
        own = table.sort_by("chunk")
        m = matrices(own)
        before, after = [np.array(own.column("up_before")[0].as_py())], [np.array(own.column("up_after")[0].as_py())]
        for x in m[:-1]:
            before.append(before[-1] @ x / (before[-1] @ x).sum())
        for x in m[:0:-1]:
            after.append(x @ after[-1] / (x @ after[-1]).max())
        return pa.table({"key": own.column("key"), "chunk": own.column("chunk"), "before": pa.array([x.tolist() for x in before], kind), "after": pa.array([x.tolist() for x in after[::-1]], kind)})

    def run(table: pa.Table, ends: pa.Table) -> pa.Table:
        own = table.sort_by("rn")
        x = values(own)
        if ends.num_rows:
            before, after = (np.array(ends.column(c)[0].as_py()) for c in ("before", "after"))
            g = model.posteriors(x, None if own.column("chunk")[0].as_py() == 0 else before, after)[0]
        else:
            g = model.posteriors(x)[0] if len(x) >= 2 else np.tile(model.start, (len(x), 1))
        cols = {"row_id": own.column("row_id"), "hmm_state": pa.array(g.argmax(1).astype(np.int32)), "hmm_entropy": pa.array(-(g * np.log(g + 1e-12)).sum(1))}
        return pa.table(cols | {f"hmm_p{i}": pa.array(g[:, i].copy()) for i in range(k)})

    longer = narrow.where("chunk = 1").select(F.col("key").alias("longer")).distinct()
    parts = narrow.join(longer, F.col("key").eqNullSafe(F.col("longer")), "left_semi")
    levels = [written(spark, parts.groupBy("key", "chunk").applyInArrow(pass_on, f"key {name}, chunk long, m array<double>"), "hmm-matrices")]
    up = F.floor(F.col("chunk") / fan)
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        levels.append(written(spark, levels[-1].groupBy("key", up.alias("up")).applyInArrow(multiply, f"key {name}, chunk long, m array<double>"), "hmm-matrices"))
    vector = lambda x: F.array(*map(F.lit, x))
    ends = levels[-1].select("key", "chunk", vector(model.start.tolist()).alias("before"), vector([1.0] * k).alias("after"))
    for level in reversed(levels[:-1]):
        above = ends.select(F.col("key").alias("up_key"), F.col("chunk").alias("up_chunk"), F.col("before").alias("up_before"), F.col("after").alias("up_after"))
        members = level.join(above, F.col("key").eqNullSafe(F.col("up_key")) & (up == F.col("up_chunk"))).drop("up_key")
        ends = members.groupBy("key", "up_chunk").applyInArrow(descend, f"key {name}, chunk long, before array<double>, after array<double>")
    return narrow.groupBy("key", "chunk").cogroup(ends.groupBy("key", "chunk")).applyInArrow(run, "row_id long, hmm_state int, hmm_entropy double, " + ", ".join(f"hmm_p{i} double" for i in range(k)))
