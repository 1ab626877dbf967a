"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary, estimated from labelled documents by
expectation-maximisation over all segmentations. A text's likelihood under a language is the product over its words of
the forward sum over all segmentations of the word; no piece crosses a space, so that is the sum over all
segmentations of the text. The prediction is the language of highest posterior, with its posterior as the score.

A posterior says which of the learned languages a text is nearest to, not whether it is in any of them. So `gain` stands
beside it: by how much, in log units a byte, the predicted language explains the text better than the vocabulary's own
weights do, which know no language. `least_gains` learns from labelled documents how small the gain of a text may be.

Fitting uses about `train_docs` documents a language (a bound on a classifier's sample; all are used where there are
fewer), or all labelled documents where that is None; prediction covers whole texts of all rows.

Cases: null text, or text without a letter, is `und` with score and gain 0, and so is everything if nothing is labelled; null
languages aren't learned; repeated rows are predicted alike; extra columns are left out of the result; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import quantiles
from .common import PIECE_MODEL, gathered, remainder, schema_of, slices, written
from .lattice import Cache, expected_counts, log_marginals, vocabulary

TRAIN_DOCS, ROUNDS, PRIOR = 3000, 3, 2000.0
UNKNOWN = "und"


def emit_counts(counters: dict[str, Counter], limit: int) -> Iterator[pa.RecordBatch]:
    """Hands over partial counts once there are over `limit`, so that a task's memory is bounded."""
    if sum(map(len, counters.values())) > limit:
        for key, counter in counters.items():
            rows = iter(counter.items())
            while part := list(islice(rows, 50_000)):
                words, n = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["part", "word", "n"])
        counters.clear()


def word_counts(docs: DataFrame, part: str | None = None) -> DataFrame:
    """(part, word, n) over whole texts, words lower-cased in A-Z; `part` names a column that splits the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, texts in slices(batch, 1, 256):
                for key, text in zip(keys[a : a + 256], texts, strict=True):
                    if text:
                        found.setdefault(key, Counter()).update(text.lower().split())
                yield from emit_counts(found, 300_000)
        yield from emit_counts(found, 0)

    rows = docs.select((F.col(part) if part else F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "part string, word binary, n long").groupBy("part", "word").agg(F.sum("n").alias("n"))


def expected_pieces(counts: DataFrame, models: dict[str, np.ndarray], path: str) -> dict[str, np.ndarray]:
    """One estimation step over (part, word, n): expected uses of each piece by part. Only these tables, whose size the
    vocabulary and the number of parts bound, come to the driver."""
    sent = counts.sparkSession.sparkContext.broadcast(models)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, sums = vocabulary(path), {}
        for batch in gathered(batches):
            parts, words, n = (batch.column(i).to_pylist() for i in range(3))
            for key in set(parts) & set(sent.value):
                own = [i for i, p in enumerate(parts) if p == key]
                got = expected_counts(v, [b" " + words[i] for i in own], np.array([n[i] for i in own], float), sent.value[key])
                sums[key] = sums[key] + got if key in sums else got
        for key, got in sums.items():
            used = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(got[used])], ["part", "piece", "uses"])

    rows = counts.mapInArrow(step, "part string, piece int, uses double").groupBy("part", "piece").agg(F.sum("uses").alias("uses")).collect()
    out = {key: np.zeros(len(p)) for key, p in models.items()}
    for r in rows:
        out[r["part"]][r["piece"]] = r["uses"]
    return out


def start_model(path: str) -> np.ndarray:
    v = vocabulary(path)
    return np.where(v.used[:-1], np.exp(v.score[:-1]), 0)


def training_rows(labelled: DataFrame, train_docs: int | None = TRAIN_DOCS) -> tuple[DataFrame, list[str]]:
    """About `train_docs` labelled rows a language, by a hash of the doc_id (None: all rows), and the languages."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return labelled.limit(0), []
    if train_docs is None:
        return labelled, sorted(sizes)
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, train_docs / n)))), F.col("lang"))
    return labelled.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)), sorted(sizes)


def fit_languages(labelled: DataFrame, path: str = PIECE_MODEL, train_docs: int | None = TRAIN_DOCS, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Piece probabilities by language from rows with `doc_id`, `text` and `lang`."""
    sample, names = training_rows(labelled, train_docs)
    if not names:
        return {}
    counts = written(labelled.sparkSession, word_counts(sample, "lang"), "lang-words")
    first = start_model(path)
    models = dict.fromkeys(names, first)
    for _ in range(rounds):
        models = {k: (e + PRIOR * first) / (e.sum() + PRIOR) for k, e in expected_pieces(counts, models, path).items()}
    return models


def has_letter(data: bytes) -> bool:
    """Whether a character of a letter category occurs; numerals such as fractions and circled digits aren't letters."""
    return bool(re.search(rb"[A-Za-z]", data)) or any(map(str.isalpha, re.findall(r"[^\W\d_]", data.decode("utf-8", "replace"))))


def predict_languages(docs: DataFrame, models: dict[str, np.ndarray], path: str = PIECE_MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with lang_pred, score and gain for each row of `docs`."""
    names = sorted(models)
    table = np.stack([*(models[k] for k in names), start_model(path)], 1) if names else None
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        known, size = Cache(lambda words: list(log_marginals(v, [b" " + w for w in words], sent.value)), 100_000), len(names)
        for batch in batches:
            langs, scores, gains = [], [], []
            for _, texts in slices(batch, batch.num_columns - 1, 256):
                split = [t.lower().split() if t and names and has_letter(t) else [] for t in texts]
                of = known.add(w for x in split for w in set(x))
                for words in split:
                    if not words:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        gains.append(0.0)
                        continue
                    uses = Counter(words)
                    total = np.fromiter(uses.values(), float, len(uses)) @ np.concatenate([of[w] for w in uses]).reshape(-1, size + 1)
                    total, general = total[:-1], total[-1]
                    best = int(total.argmax())
                    langs.append(names[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                    gains.append(float((total[best] - general) / sum(map(len, words), len(words))))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gains, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score", "gain"])

    schema = schema_of(docs, keep, "lang_pred string, score double, gain double")
    return docs.select(*keep, F.col("text").cast("binary").alias("text_bytes")).mapInArrow(score, schema)


def least_gains(labelled: DataFrame, models: dict[str, np.ndarray], path: str = PIECE_MODEL, train_docs: int | None = TRAIN_DOCS, share: float = 0.01) -> dict[str, float]:
    """`gain_floors` of labelled rows that are not predicted yet."""
    rows, _ = training_rows(labelled, train_docs)
    return gain_floors(written(labelled.sparkSession, predict_languages(rows, models, path, keep=("lang",)), "lang-gains"), share)


def gain_floors(found: DataFrame, share: float = 0.01) -> dict[str, float]:
    """For each language, a gain that a text in it has: half of what all but `share` of the rows (lang, lang_pred, gain) reach
    whose language is predicted (if that is negative, half as much again below it). The quantiles are exact over all rows."""
    low = quantiles(found.where("lang = lang_pred"), "gain", (share,), ["lang"]).collect()
    return {r["lang"]: r["quantiles"][0] - abs(r["quantiles"][0]) / 2 for r in low}


def op2_language(docs: DataFrame, path: str = PIECE_MODEL) -> DataFrame:
    flagged = docs.select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    models = fit_languages(flagged.where(~F.col("held_out")), path)
    return predict_languages(flagged.select("doc_id", "held_out", "text"), models, path, keep=("doc_id", "held_out"))
