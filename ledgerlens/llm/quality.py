"""Quality classification by positive-unlabelled learning.

A small network with one hidden layer over features of the whole text (shares of byte classes, repetition and shape of
words and lines, hashed byte pairs) is trained on trusted positives and on unlabelled web text with the non-negative
unbiased risk: `prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])`. Negative labels are never used.

The class prior is estimated from positives and unlabelled text alone: networks that tell one from the other score the
half of the samples they were not trained on, and of all levels of that score the one is taken at which the bound on
`share of unlabelled above / share of positives above` is least; that ratio is the prior (best bin estimation).

Bounds on the samples the classifier is fitted to: about `positives` positives and `unlabelled` documents, one text of
each doc_id. Scoring covers whole texts of all rows.

Cases: null and empty texts are scored as texts without words; without a positive label everything scores 0; repeated
rows score alike; null and repeated labels are ignored; extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, schema_of, slices

POSITIVES, UNLABELLED, PAIRS, HIDDEN, EPOCHS, SEED = 3000, 6000, 64, 16, 30, 7
LEVEL = 0.7
#: Classes of bytes.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:?'\"-()", b"#$%&*|!<>{}[]~^_=+\\/@`")
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _i
SHAPE = 9
WIDTH = len(CLASSES) + 1 + SHAPE + PAIRS


def features(text: bytes | None) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    b = np.frombuffer(text or b"", np.uint8)
    if not len(b):
        return out
    k = len(CLASSES) + 1
    out[:k] = np.bincount(_CLASS[b], minlength=k) / len(b)
    pairs = np.bincount((b[:-1].astype(np.uint32) * 40503 + b[1:].astype(np.uint32) * 2654435) >> 4 & (PAIRS - 1), minlength=PAIRS)
    out[k + SHAPE :] = np.sqrt(pairs / len(b))
    words, lines = text.split(), text.split(b"\n")
    if words:
        n, kinds = len(words), set(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        twice = sum(map(bytes.__eq__, words, words[1:])) / n
        upper = sum(w.isupper() for w in kinds) / len(kinds)
        out[k : k + SHAPE] = [np.log1p(n) / 10, len(kinds) / n, len(kinds) / n * np.log1p(n) / 10, sizes.mean() / 20, min(2.0, sizes.std() / 10), twice, upper, len(set(lines)) / len(lines), min(1.0, len(lines) / n)]
    return out


def feature_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and the packed features of each row's text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for _, texts in slices(batch, batch.num_columns - 1, 256) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(x, pa.binary())], [*batch.schema.names[:-1], "x"])

    schema = schema_of(rows, keep, "x binary")
    return rows.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(make, schema)


class Network:
    """One hidden layer; `center` and `scale` standardise the features."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        self.center, self.scale, self.prior = center, scale, 0.0
        self.p = [rng.normal(0, 1 / np.sqrt(len(center)), (len(center), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.center) / self.scale, -8, 8) @ self.p[0] + self.p[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.p[2] + self.p[3][0]

    def gradients(self, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """Of the parameters, given those of the logits."""
        h = self.hidden(x)
        back = d[:, None] * self.p[2] * (1 - h * h)
        return [np.clip((x - self.center) / self.scale, -8, 8).T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk_gradients(net: Network, pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk with the logistic loss `l(z, y) = log(1 + exp(-y z))`, and its gradients.

    Where the negatives' part is below zero, its gradient is followed the other way, which undoes the overfit.
    """
    zp, zu = net.logits(pos), net.logits(unl)
    as_pos, p_neg, u_neg = np.logaddexp(0, -zp).mean(), np.logaddexp(0, zp).mean(), np.logaddexp(0, zu).mean()
    rest = u_neg - prior * p_neg
    up, down = -sigmoid(-zp) / len(zp), sigmoid(zp) / len(zp)
    to_u = sigmoid(zu) / len(zu)
    if rest >= 0:
        to_p = prior * (up - down)
    else:
        to_p, to_u = prior * down, -to_u
    g = [a + b for a, b in zip(net.gradients(pos, to_p), net.gradients(unl, to_u), strict=True)]
    return prior * as_pos + max(0.0, rest), g


def adam(params: list[np.ndarray], state: list[tuple], g: list[np.ndarray], step: int, rate: float) -> None:
    for i, (p, d) in enumerate(zip(params, g, strict=True)):
        m, v = state[i]
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        state[i] = (m, v)
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def contrast_gradients(net: Network, pos: np.ndarray, unl: np.ndarray) -> list[np.ndarray]:
    """Of the logistic loss that tells positives from unlabelled rows."""
    zp, zu = net.logits(pos), net.logits(unl)
    parts = net.gradients(pos, -sigmoid(-zp) / len(zp)), net.gradients(unl, sigmoid(zu) / len(zu))
    return [a + b for a, b in zip(*parts, strict=True)]


def trained(pos: np.ndarray, unl: np.ndarray, gradients, epochs: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    both = np.vstack([pos, unl])
    net = Network(both.mean(0), both.std(0) + 0.01, rng)
    state, step = [(np.zeros_like(p), np.zeros_like(p)) for p in net.p], 0
    steps, decay = max(20, len(unl) // 256), 1e-3 * max(1.0, 3000 / len(pos))
    for epoch in range(epochs):
        for _ in range(steps):
            step += 1
            a, b = rng.integers(0, len(pos), 256), rng.integers(0, len(unl), 512)
            g = gradients(net, pos[a], unl[b])
            g[0] += decay * net.p[0]
            adam(net.p, state, g, step, 0.01 / (1 + epoch / 10))
    return net


def best_bin(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """The prior from scores of rows the network has not seen: the ratio of the shares above a level where, with the
    deviation that samples of these sizes may show, it is least."""
    pos, unl = np.sort(pos), np.sort(unl)
    level = np.concatenate([pos, unl])
    above = lambda x: 1 - np.searchsorted(x, level) / len(x)
    p, u = above(pos), above(unl)
    slack = 1.01 * np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    best = ((u + slack) / np.maximum(p, 1e-9)).argmin()
    return float(np.clip(u[best] / p[best], 0.01, 0.98))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, epochs: int = EPOCHS // 3, seed: int = SEED) -> float:
    """The share of positives among unlabelled rows, from two halves that score each other."""
    if min(len(pos), len(unl)) < 4:
        return 0.5
    found = []
    for side in (0, 1):
        net = trained(pos[side::2], unl[side::2], contrast_gradients, epochs, seed)
        found.append(best_bin(net.logits(pos[1 - side :: 2]), net.logits(unl[1 - side :: 2])))
    return float(np.mean(found))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    if not len(pos) or not len(unl):
        return None
    prior = estimate_prior(pos, unl) if prior is None else prior
    net = trained(pos, unl, lambda n, a, b: risk_gradients(n, a, b, prior)[1], epochs, seed)
    net.prior = prior
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network | None:
    """Fits to the positives of `labels` (doc_id, quality) as they are given: leave held-out rows out before."""
    good = labels.where("quality = 1")
    if good.isEmpty():
        return None
    trusted = labelled_sample(docs, good, "quality", positives)
    total = docs.count()
    web = docs.where(F.pmod(F.xxhash64(F.lit("web"), "doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, unlabelled / max(1, total)) * (1 << 30)))
    web = web.groupBy("doc_id").agg(F.min("text").alias("text"))
    load = lambda rows: np.array([np.frombuffer(r["x"], np.float32) for r in feature_rows(rows.orderBy("doc_id"), ["doc_id"]).select("x").collect()], float).reshape(-1, WIDTH)
    return fit(load(trusted), load(web))


def score_quality(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """`keep` columns, score and predicted of each row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, texts in slices(batch, batch.num_columns - 1, 256):
                x = np.stack([features(t) for t in texts]).astype(float)
                out.append(sigmoid(sent.value.logits(x)) if sent.value else np.zeros(len(x)))
            z = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(z), pa.array((z >= LEVEL).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    schema = schema_of(docs, keep, "score double, predicted int")
    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(score, schema)


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    net = fit_quality(docs.select("doc_id", "text"), labels.where(remainder(F.col("doc_id"), 4) != 2))
    flagged = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return score_quality(flagged, net, ["doc_id", "held_out"])
