"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a learned word vector, the mean of learned vectors of its character n-grams (3 to 8 bytes, with word
marks), and three statistics of the training labels: the log odds of the word and the largest and mean log odds of its
n-grams. A word of over 40 bytes stands as several overlapping pieces, so that all its bytes count. Two gated
recurrent layers read a window of 32 words in either direction, attention pools their states, and a linear layer
scores the window. Windows start every 24 words, so they overlap, and all windows of a text are scored. A logistic
layer over the highest, second highest and mean window score and the text's length gives the document's.

Training: counts of hashed words and n-grams by label over a sample of labelled rows (about `per_class` documents a
class, one text of each doc_id), then all windows of those documents' whole texts. A label belongs to a document, so a
batch draws documents and of each a window, at first any, later one by how toxic the network holds it to be: the
windows that carry a toxic document's label, and those of clean ones that look like it. A fifth of the documents is left
out of the windows and fits the document layer. What reaches the driver is tables by hash bucket and the sample's texts, at
most MOST_BYTES of them: where the sample has more, its longest texts train no windows (all texts count and are scored).

Cases: null and empty texts get the document layer's score of no evidence; with one class of labels only, all scores
are that class's share; null labels are ignored; repeated rows score alike; extra columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import copy
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, slices
from .quality import adam, sigmoid

PER_CLASS, WINDOW, STRIDE, HIDDEN, SEED = 2500, 32, 24, 8, 11
MOST_BYTES = 96 << 20
BITS, GRAMS, VECTOR, STEPS = 16, (3, 4, 5, 6, 8), 8, 600
STATS, LONGEST, OVERLAP, CHUNK, AT_ONCE, KEPT = 3, 40, max(GRAMS) - 1, 1024, 16_384, 500_000
EDGE = b".,;:!?#$%&*|\"'()[]{}<>-_~^+=/\\"
BUCKETS = 1 << BITS
_BASE = np.uint64(0x9E3779B97F4A7C15)


def units(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z). One over LONGEST bytes becomes, without marks at its edges, overlapping pieces that hold
    all its n-grams; a piece begins with a blank and has word marks only where the word begins and ends."""
    words = text.lower().split()
    if not words or max(map(len, words)) <= LONGEST:
        return words
    out = []
    for w in words:
        if len(w) > LONGEST:
            core, step = b"\x02" + w.strip(EDGE) + b"\x03", LONGEST + 2 - OVERLAP
            out += [b" " + core[a : a + LONGEST + 2] for a in range(0, max(1, len(core) - OVERLAP), step)]
        else:
            out.append(w)
    return out


def cores(words: list[bytes]) -> list[bytes]:
    """Units without marks at their edges, between word marks; pieces of long words as they are."""
    return [w[1:] if w[:1] == b" " else b"\x02" + w.strip(EDGE) + b"\x03" for w in words]


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, n-gram buckets padded with BUCKETS, number of n-grams) of each core."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    most = sum(max(0, int(sizes.max()) - k + 1) for k in GRAMS) if len(words) else 0
    own, grams, counts = np.zeros(len(words), np.int32), np.full((len(words), most), BUCKETS, np.int32), np.zeros(len(words), np.int64)
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            codes = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), size).astype(np.uint64) + np.uint64(1)
            prefix = np.zeros((len(rows), size + 1), np.uint64)
            for i in range(size):
                prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i]
            spread = lambda h: (((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int32)
            own[rows] = spread(prefix[:, -1] + np.uint64(size))
            at = 0
            for k in GRAMS:
                if size >= k:
                    power = np.uint64(pow(int(_BASE), k, 2**64))
                    grams[rows, at : at + size - k + 1] = spread(prefix[:, k:] - prefix[:, :-k] * power)
                    at += int(size) - k + 1
            counts[rows] = at
    return own, grams, counts


def label_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int, dict[int, int]]:
    """Documents of each label that hold each word bucket and n-gram bucket; these tables have BUCKETS rows at most. And the
    texts' bytes by their sizes' binary digits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 2, BUCKETS), np.int64)
        docs, sizes = np.zeros(2, np.int64), np.zeros(64, np.int64)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for a, texts in slices(batch, 0, 256):
                for text, label in zip(texts, labels[a : a + 256], strict=True):
                    docs[label] += 1
                    sizes[len(text).bit_length()] += len(text)
                    if words := cores(sorted(set(units(text)))):
                        parts = [[np.unique(x) for x in hashed(words[b : b + AT_ONCE])[:2]] for b in range(0, len(words), AT_ONCE)]
                        own, used = (np.unique(np.concatenate(x)) for x in zip(*parts, strict=True))
                        table[0, label, own] += 1
                        table[1, label, used[used < BUCKETS]] += 1
        kind, label, bucket = np.nonzero(table)
        value = table[kind, label, bucket]
        kind, label, bucket, value = (np.append(x, y) for x, y in ((kind, [2, 2] + [3] * 64), (label, [0, 1] + [0] * 64), (bucket, [0, 0, *range(64)]), (value, [*docs, *sizes])))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (kind, label, bucket, value)], ["kind", "label", "bucket", "n"])

    rows = sample.select(F.col("text").cast("binary"), F.when(F.col("label") == 1, 1).otherwise(0).alias("label"))
    got = rows.mapInArrow(count, "kind long, label long, bucket long, n long").groupBy("kind", "label", "bucket").agg(F.sum("n").alias("n")).collect()
    tables, docs, sizes = np.zeros((2, 2, BUCKETS)), [0, 0], {}
    for r in got:
        if r["kind"] == 2:
            docs[r["label"]] += r["n"]
        elif r["kind"] == 3:
            sizes[r["bucket"]] = r["n"]
        else:
            tables[r["kind"], r["label"], r["bucket"]] = r["n"]
    return tables[0], tables[1], docs[0], docs[1], sizes


def longest_within(sizes: dict[int, int], most: int) -> int:
    """The greatest power of two below which all texts together have `most` bytes at most, from bytes by binary digits."""
    total = 0
    for digits in range(64):
        total += sizes.get(digits, 0)
        if total > most:
            return 1 << digits >> 1
    return 1 << 62


def log_odds(table: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    """Shrunk log odds of the toxic label by bucket; 0 for what was not seen and for the padding."""
    share = (table[1] + 0.5) / (toxic + 1) / ((table[0] + 0.5) / (clean + 1))
    trust = 1 - np.exp(-table.sum(0) / 4)
    return np.append(np.clip(np.log(share) * trust, -3, 6) * (table.sum(0) > 0), 0)


class Windows:
    """The network; `p` are its parameters, `word_odds` and `gram_odds` its statistics."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.word_odds, self.gram_odds = word_odds, gram_odds
        d, h = 2 * VECTOR + STATS, HIDDEN
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {
            "word": rng.normal(0, 0.05, (BUCKETS, VECTOR)), "gram": np.vstack([rng.normal(0, 0.05, (BUCKETS, VECTOR)), np.zeros(VECTOR)]),
            "wx": normal(d, 6 * h), "bx": np.zeros(6 * h), "uf": normal(h, 3 * h), "ub": normal(h, 3 * h),
            "wa": normal(2 * h, h), "va": normal(h), "wo": normal(2 * h), "bo": np.zeros(1) - 1,
        }

    def stats(self, own: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        odds = self.gram_odds[grams]
        # padding must not count: it depends on the other words of a batch
        top = np.where(n > 0, np.where(grams < BUCKETS, odds, -np.inf).max(1, initial=-np.inf), 0)
        return np.stack([self.word_odds[own], top, odds.sum(1) / np.maximum(n, 1)], 1)

    def inputs(self, own: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Input vectors of words."""
        chars = self.p["gram"][grams].sum(1) / np.maximum(n, 1)[:, None]
        return np.hstack([self.p["word"][own], chars, self.stats(own, grams, n)])

    def project(self, words: list[bytes]) -> np.ndarray:
        """Gate inputs of both directions by word; a last row of zeros pads windows."""
        out = np.zeros((len(words) + 1, 6 * HIDDEN), np.float32)
        # words of one length together: their n-grams need no padding
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for a in range(0, len(words), 2048):
            some = order[a : a + 2048]
            out[some] = self.inputs(*hashed(cores([words[i] for i in some]))) @ self.p["wx"] + self.p["bx"]
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows: x (time, windows, 6 hidden), mask (time, windows, 1)."""
        t, b, h = x.shape[0], x.shape[1], HIDDEN
        states = np.empty((t, b, 2 * h), x.dtype)
        for side, (u, times) in enumerate((("uf", range(t)), ("ub", range(t - 1, -1, -1)))):
            u = self.p[u].astype(x.dtype, copy=False)
            s, steps = np.zeros((b, h), x.dtype), []
            for i in times:
                xi = x[i, :, side * 3 * h : (side + 1) * 3 * h]
                su = s @ u
                zr = 1 / (1 + np.exp(-(xi[:, : 2 * h] + su[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(xi[:, 2 * h :] + r * su[:, 2 * h :])
                new = n + z * (s - n)
                if tape is not None:
                    steps.append((i, s, z, r, n, su[:, 2 * h :]))
                s = s + mask[i] * (new - s)
                states[i, :, side * h : (side + 1) * h] = s
            if tape is not None:
                tape[side] = steps
        a = np.tanh(states @ self.p["wa"].astype(x.dtype, copy=False))
        e = np.where(mask[:, :, 0] > 0, a @ self.p["va"].astype(x.dtype, copy=False), -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        if tape is not None:
            tape.update(states=states, a=a, w=w, pooled=pooled)
        return pooled @ self.p["wo"].astype(x.dtype, copy=False) + x.dtype.type(self.p["bo"][0])

    def backward(self, x: np.ndarray, mask: np.ndarray, tape: dict, d: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the inputs, and of x, given those of the logits."""
        h, p = HIDDEN, self.p
        g = {"wo": tape["pooled"].T @ d, "bo": np.array([d.sum()])}
        d_pool = d[:, None] * p["wo"]
        w, states, a = tape["w"], tape["states"], tape["a"]
        d_states = w[:, :, None] * d_pool
        d_w = (states * d_pool).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["va"] = np.einsum("tbh,tb->h", a, d_e)
        d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
        g["wa"] = np.einsum("tbi,tbj->ij", states, d_a)
        d_states = d_states + d_a @ p["wa"].T
        d_x = np.zeros_like(x)
        for side, name in enumerate(("uf", "ub")):
            u, gu, carry = p[name], np.zeros_like(p[name]), 0.0
            for i, s, z, r, n, sn in reversed(tape[side]):
                ds = d_states[i, :, side * h : (side + 1) * h] + carry
                new, m = ds * mask[i], mask[i]
                dz, dn = new * (s - n) * z * (1 - z), new * (1 - z) * (1 - n * n)
                dr = dn * sn * r * (1 - r)
                du = np.hstack([dz, dr, dn * r])
                d_x[i, :, side * 3 * h : (side + 1) * 3 * h] = np.hstack([dz, dr, dn])
                gu += s.T @ du
                carry = ds * (1 - m) + new * z + du @ u.T
            g[name] = gu
        return g, d_x


def starts(n: int) -> range:
    """Where the windows of a text of n words begin: the last one reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


class Bags:
    """All windows of documents: `tokens` (window, place) into `kinds` (len(kinds) pads), `of` the document of a window,
    `first` and `size` of each document's windows, `label` of each document."""

    def __init__(self, texts: list[bytes], labels: list[int]):
        split = [units(t) for t in texts]
        split, labels = [w for w in split if w], [y for w, y in zip(split, labels, strict=True) if w]
        self.kinds = sorted({w for x in split for w in x})
        place = {w: i for i, w in enumerate(self.kinds)}
        self.tokens = np.concatenate([windows_of([place[w] for w in x], len(self.kinds)) for x in split] or [np.zeros((0, WINDOW), np.int32)])
        self.size = np.array([len(starts(len(x))) for x in split], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(split)), self.size)
        self.label = np.array(labels, np.int64)

    def draws(self, z: np.ndarray | None) -> np.ndarray:
        """Running sums of the windows' chances within their documents: even ones, or a tenth even and the rest by logits."""
        even = 1 / self.size[self.of]
        if z is not None:
            e = np.exp(np.clip(z, -30, 30))
            even = 0.1 * even + 0.9 * e / np.bincount(self.of, e)[self.of]
        return np.cumsum(even)

    def draw(self, rng: np.random.Generator, sums: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """A window of each of `n` random ones of `docs`: a document's chances add up to 1."""
        own = rng.choice(docs, n)
        at = np.searchsorted(sums, own + rng.random(n))
        return np.clip(at, self.first[own], self.first[own] + self.size[own] - 1)


def windows_of(ids: list[int], pad: int) -> np.ndarray:
    """The overlapping windows of a text's unit ids, the last one filled up with `pad`."""
    at = starts(len(ids))
    row = np.full(at[-1] + WINDOW, pad, np.int32)
    row[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(row, WINDOW)[::STRIDE]


def window_logits(net: Windows, table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Logits of windows of rows of `table`, whose last row pads."""
    out = [np.zeros(0)]
    for a in range(0, len(tokens), CHUNK):
        part = tokens[a : a + CHUNK].T
        out.append(net.forward(table[part], (part < len(table) - 1)[:, :, None].astype(table.dtype)))
    return np.concatenate(out)


def summed(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows of `values` by the row they go to."""
    return np.stack([np.bincount(at, values[:, k], rows) for k in range(values.shape[1])], 1)


def train(net: Windows, bags: Bags, steps: int = STEPS, seed: int = SEED) -> None:
    """Adam on the logistic loss; 48 of a batch's 128 windows are of toxic documents."""
    rng = np.random.default_rng(seed)
    pad = len(bags.kinds)
    sides = np.flatnonzero(bags.label == 1), np.flatnonzero(bags.label == 0)
    names = list(net.p)
    state = [(np.zeros_like(net.p[k]), np.zeros_like(net.p[k])) for k in names]
    share = len(sides[0]) / len(bags.label)
    sums = bags.draws(None)
    for step in range(1, steps + 1):
        if step in (steps // 6, steps // 2):
            now = Scorer(net).net
            sums = bags.draws(window_logits(now, now.project(bags.kinds), bags.tokens))
        rows = np.concatenate([bags.draw(rng, sums, sides[0], 48), bags.draw(rng, sums, sides[1], 80)])
        label = bags.label[bags.of[rows]].astype(float)
        used, back = np.unique(bags.tokens[rows], return_inverse=True)
        back = back.reshape(len(rows), WINDOW)
        blank = used == pad
        own, grams, n = hashed(cores([bags.kinds[0 if i == pad else i] for i in used]))
        vectors = net.inputs(own, grams, n)
        vectors[blank] = 0
        x = (vectors @ net.p["wx"] + net.p["bx"])[back].transpose(1, 0, 2)
        mask = (bags.tokens[rows] < pad).T[:, :, None].astype(float)
        tape: dict = {}
        z = net.forward(x, mask, tape)
        # the batch has more toxic windows than the sample: weigh them back
        weight = np.where(label == 1, share / (48 / 128), (1 - share) / (80 / 128))
        g, d_x = net.backward(x, mask, tape, (sigmoid(z) - label) * weight / len(rows))
        flat = (d_x * mask).transpose(1, 0, 2).reshape(-1, d_x.shape[2])
        by_word = summed(len(used), back.ravel(), flat)
        g["wx"], g["bx"] = vectors.T @ by_word, by_word[~blank].sum(0)
        d_in = by_word @ net.p["wx"].T
        d_in[blank] = 0
        g["word"] = summed(BUCKETS, own, d_in[:, :VECTOR])
        spread = d_in[:, VECTOR : 2 * VECTOR] / np.maximum(n, 1)[:, None]
        real = grams < BUCKETS
        g["gram"] = summed(BUCKETS + 1, grams[real], np.repeat(spread, real.sum(1), 0))
        for k in ("wx", "uf", "ub", "wa", "wo"):
            g[k] += 1e-3 * net.p[k]
        for k in ("word", "gram"):
            g[k] += 1e-4 * net.p[k] * (g[k] != 0)
        adam([net.p[k] for k in names], state, [g[k] for k in names], step, 0.02 if step < steps * 0.7 else 0.005)


def summary(z: np.ndarray, words: int) -> list[float]:
    """What the document layer sees of the window logits."""
    top = np.sort(z)[::-1] if len(z) else np.full(1, -4.0)
    return [float(top[0]), float(top[1] if len(top) > 1 else top[0]), float(top.mean()), float(np.log1p(words))]


class Scorer:
    """Scores texts with a trained network; keeps the gate inputs of the words it has met, forgotten beyond a bound."""

    def __init__(self, net: Windows, most: int = KEPT):
        self.net, self.most = copy.copy(net), most
        self.net.p = {k: p.astype(np.float32) for k, p in net.p.items()}
        self.net.word_odds, self.net.gram_odds = net.word_odds.astype(np.float32), net.gram_odds.astype(np.float32)
        self.known: dict[bytes, int] = {}
        self.room = net.project([])

    def learn(self, words: set[bytes]) -> np.ndarray:
        """The gate inputs by `known`, with those of all `words`, and a last row of zeros."""
        if len(self.known) > self.most:
            self.known = {}
        new, n = sorted(words.difference(self.known)), len(self.known)
        need = n + len(new) + 1
        if need > len(self.room):
            # rows to spare, so that a table is not copied for each batch
            grown = np.empty((need * 3 // 2, self.room.shape[1]), self.room.dtype)
            grown[:n] = self.room[:n]
            self.room = grown
        self.room[n:need] = self.net.project(new)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return self.room[:need]

    def summaries(self, texts: list[bytes | None]) -> np.ndarray:
        split = [units(t or b"") for t in texts]
        table = self.learn(set().union(*split))
        pad = len(table) - 1
        out: list[list[float]] = [[] for _ in split]
        pieces, counts = [], []
        for words in split:
            at = starts(len(words)) if words else range(0)
            counts.append(len(at))
            if words:
                pieces.append(windows_of(list(map(self.known.__getitem__, words)), pad))
        every = np.concatenate(pieces) if pieces else np.zeros((0, WINDOW), np.int32)
        z, at = window_logits(self.net, table, every), 0
        for i, (words, c) in enumerate(zip(split, counts, strict=True)):
            out[i] = summary(z[at : at + c], len(words))
            at += c
        return np.array(out).reshape(-1, 4)


@functools.lru_cache(1)
def scorer_of(net: Windows) -> Scorer:
    """One scorer for all tasks in which a worker meets the same network."""
    return Scorer(net)


def summarised(rows: DataFrame, net: Windows, keep: list[str], layer: np.ndarray | None = None) -> DataFrame:
    """`keep` columns and either the four summary values or, with a document layer, score and predicted."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent.value)
        for batch in batches:
            parts = [scorer.summaries(texts) for _, texts in slices(batch, batch.num_columns - 1, 256)]
            x = np.vstack(parts) if parts else np.zeros((0, 4))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            if layer is None:
                made = [pa.array(np.ascontiguousarray(x[:, k])) for k in range(4)]
            else:
                p = sigmoid(x @ layer[:4] + layer[4])
                made = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:-1], *names])

    names = [f"x{k}" for k in range(4)] if layer is None else ["score", "predicted"]
    kinds = ["double"] * 4 if layer is None else ["double", "int"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {k}" for n, k in zip(names, kinds, strict=True)])
    return rows.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def document_layer(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small penalty; four weights and the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(5), np.diag([0.05] * 4 + [1e-6]) * max(1.0, len(x) / 100)
    for _ in range(30):
        p = sigmoid(a @ w)
        grad = a.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve(a.T @ ((weight * np.maximum(p * (1 - p), 1e-6))[:, None] * a) + penalty + 1e-9 * np.eye(5), grad)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, steps: int = STEPS, most_bytes: int = MOST_BYTES) -> tuple[Windows | None, np.ndarray]:
    """The network and the document layer from `labels` (doc_id, toxic) as given: leave held-out rows out before. The windows
    are those of the sample's shorter texts, which have `most_bytes` together: a bound on what a driver holds."""
    known = labels.where(F.col("toxic").isin(0, 1))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        share = 0.99 if 1 in sizes else 0.01
        return None, np.array([0, 0, 0, 0, np.log(share / (1 - share))])
    sample = labelled_sample(docs, known, "toxic", per_class).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)))
    inner = sample.where("fold > 0")
    words, grams, clean, toxic, bytes_by_size = label_counts(inner)
    within = F.octet_length("text") < longest_within(bytes_by_size, most_bytes)
    net = Windows(log_odds(words, clean, toxic), log_odds(grams, clean, toxic))
    texts = sorted(tuple(r) for r in inner.where(within).select("doc_id", "label", F.col("text").cast("binary")).collect())
    bags = Bags([bytes(t) for *_, t in texts], [y for _, y, _ in texts])
    if len(set(bags.label.tolist())) < 2:
        share = sizes[1] / (sizes[0] + sizes[1])
        return None, np.array([0, 0, 0, 0, np.log(share / (1 - share))])
    train(net, bags, steps)
    rows = summarised(sample.select("doc_id", "text", "label", "fold"), net, ["doc_id", "label", "fold"]).collect()
    rows = sorted(tuple(r) for r in rows)
    x, y, fold = np.array([r[3:] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    # the sample holds the classes in other shares than the labels do, and the documents left out say more
    real = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    return net, document_layer(x, y, real / real.mean() * np.where(fold == 0, 1.0, 0.1))


def score_toxicity(docs: DataFrame, model: tuple[Windows | None, np.ndarray], keep: list[str]) -> DataFrame:
    """`keep` columns, score and predicted of each row of `docs`."""
    net, layer = model
    return summarised(docs, net or Windows(np.zeros(BUCKETS), np.zeros(BUCKETS + 1)), keep, layer)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_toxicity(docs.select("doc_id", "text"), labels.where(remainder(F.col("doc_id"), 5) != 0))
    flagged = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return score_toxicity(flagged, model, ["doc_id", "held_out"])
