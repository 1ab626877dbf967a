"""Language-model scoring by subword lattice likelihood.

A text is a sequence of words (lower-cased in A-Z) and an end. The lattice of a word has the pieces of a fixed public
vocabulary as edges and, for a word of the training texts, one edge more over all of it. The word's probability is the
sum over all paths: a forward recursion in log space over the pieces, weighted by `D V / N`, plus the whole-word
edge's `(c - D) / N` (absolute discounting, with D from the numbers of words seen once and twice). The pieces' weights
are the vocabulary's own scores, which two rounds of expected counts over the training vocabulary fit to the corpus
with the scores as prior; pieces and a stop add up to one. No piece crosses a space, so the sum over all segmentations
of a text is the product of its words' sums.

The training documents' languages with at least a hundredth of them are latent classes (so at most 100; the others are
one class): each has its own weights, and a text's probability is the mixture of its probabilities under the classes.
A scored text's own language is not used.

Beside this score stands `lattice_score`: the vocabulary's own weights alone over all segmentations, with no whole-word
edge, no counts and no classes (after each piece a word goes on or stops with a half each, and so does a text after each
word).

Word counts, which grow with the corpus, stay distributed. The most frequent words are sent to every task: those above a
count at which their tables and their bytes can't exceed HEAD_BYTES, however many words and classes there are. The others
meet their counts in a join, after which each distinct word is spelled out once a task.

Cases: null and empty texts hold the end alone; with no training rows, known counts are zero and the vocabulary's
scores are the model; repeated rows each get their result; rows of one doc_id and different texts are apart; extra
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_MODEL, gathered, remainder, slices, written
from .langid import expected_pieces, start_model, word_counts
from .lattice import Cache, log_marginals, vocabulary

ROUNDS, PRIOR, HEAD_BYTES, LEAST_CLASS = 2, 2000.0, 256 << 20, 0.01
OTHERS = ""


class LatticeModel:
    """`counts`: (word, by) with the counts of each class, distributed. Per class (arrays): docs, tokens, distinct words,
    discount; `pieces`: weights by id and class; `stop`: of the spelling; `total` and `distinct` over all."""

    def __init__(self, counts, classes, docs, tokens, distinct, discount, pieces, stop):
        self.counts, self.classes, self.docs, self.tokens, self.distinct = counts, classes, docs, tokens, distinct
        self.discount, self.pieces, self.stop = discount, pieces, stop
        self.total, self.types, self.bytes = 0, 0, 0

    def base(self, count: float) -> float:
        return math.log10((count + 0.5) / (self.total + 0.5 * (self.types + 1)))


def least_head_count(model: LatticeModel) -> int:
    """The words of at least this count have tables and bytes of at most HEAD_BYTES together: there are at most `total / count`
    of them, which hold at most `bytes / count` bytes."""
    row = 8 * (2 * len(model.classes) + 4) + 128
    return max(1, math.ceil((model.total * row + model.bytes) / HEAD_BYTES))


def word_scores(model: LatticeModel, by: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """log10 probability of words by class from their counts and natural-log lattice sums (both words by classes)."""
    n = np.maximum(model.tokens, 1)
    backed = np.where(model.tokens > 0, model.discount * model.distinct / n, 0.5)
    whole = np.maximum(by - model.discount, 0) / n
    with np.errstate(divide="ignore"):
        spelled = (spelled + np.log(backed * model.stop)) / math.log(10)
        whole = np.log10(whole)
    top = np.maximum(whole, spelled)
    return top + np.log10(10 ** (whole - top) + 10 ** (spelled - top))


def fit(train: DataFrame, path: str = PIECE_MODEL, rounds: int = ROUNDS) -> LatticeModel:
    """Fits the model to the rows of `train` (text, lang)."""
    spark = train.sparkSession
    lang = F.coalesce("lang", F.lit(OTHERS))
    sizes = {r["lang"]: r["n"] for r in train.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    docs_all = sum(sizes.values())
    named = sorted(k for k, n in sizes.items() if k != OTHERS and n >= LEAST_CLASS * docs_all)
    classes = named + [OTHERS] * (docs_all == 0 or sum(sizes[k] for k in named) < docs_all)
    part = F.when(lang.isin(named), lang).otherwise(F.lit(OTHERS))
    long = written(spark, word_counts(train.select("text", part.alias("part")), "part"), "lm-words")
    seen = {r["part"]: r for r in long.groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
    of = lambda key: np.array([seen[c][key] if c in seen else 0 for c in classes], float)
    docs = np.array([sizes.get(c, 0) if c != OTHERS else docs_all - sum(sizes[k] for k in named) for c in classes], float)
    discount = np.clip(of("n1") / np.maximum(of("n1") + 2 * of("n2"), 1), 0.1, 0.9)
    first = start_model(path)
    models, stop = dict.fromkeys(classes, first / 2), dict.fromkeys(classes, 0.5)
    types = long.select("part", "word", F.lit(1).cast("long").alias("n"))
    for _ in range(rounds if seen else 0):
        uses = expected_pieces(types, models, path)
        for i, c in enumerate(classes):
            whole = uses[c].sum() + PRIOR + of("v")[i] + 1
            models[c], stop[c] = (uses[c] + PRIOR * first) / whole, (of("v")[i] + 1) / whole
    by_word = long.groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("part") == c, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, c in enumerate(classes)))
    counts = written(spark, by_word, "lm-counts")
    model = LatticeModel(counts, classes, docs, of("n") + docs, of("v"), discount, np.stack([models[c] for c in classes], 1), np.array([stop[c] for c in classes]))
    sums = counts.agg(F.count(F.lit(1)).alias("types"), F.sum(F.octet_length("word") * sum((F.col(f"n{i}") for i in range(1, len(classes))), F.col("n0"))).alias("bytes")).first()
    model.total, model.types, model.bytes = int(of("n").sum() + docs_all), sums["types"] + (docs_all > 0), sums["bytes"] or 0
    return model



def score(docs: DataFrame, model: LatticeModel, path: str = PIECE_MODEL) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score of each row of `docs`."""
    spark, size = docs.sparkSession, len(model.classes)
    each = [f"n{i}" for i in range(size)]
    counts = model.counts.withColumn("c", sum((F.col(x) for x in each[1:]), F.col(each[0])))
    top = counts.where(F.col("c") >= least_head_count(model)).select("word", *each).collect()
    words, by = [bytes(r[0]) for r in top], np.array([r[1:] for r in top], float).reshape(-1, size)
    # a last column: the vocabulary's own weights
    tables = np.hstack([model.pieces, start_model(path)[:, None] / 2])
    spelled = log_marginals(vocabulary(path), [b" " + w for w in words], tables) if words else np.zeros((0, size + 1))
    head = {w: i for i, w in enumerate(words)}
    bases = np.array([model.base(n) for n in by.sum(1)])
    own = (spelled[:, size:] - 2 * math.log(2)) / math.log(10)  # the word stops, and the text goes on
    plain = LatticeModel(None, model.classes, model.docs, model.tokens, model.distinct, model.discount, model.pieces, model.stop)
    sent = spark.sparkContext.broadcast((head, bases, np.hstack([word_scores(model, by, spelled[:, :size]), own]), tables, plain))
    docs_all = int(model.docs.sum())
    end_base, end_known = model.base(docs_all), int(docs_all > 0)
    end_score = np.append(np.log10(np.where(model.tokens > 0, np.maximum(model.docs, 0.5) / np.maximum(model.tokens, 1), 0.5)), math.log10(0.5))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = [f"s{i}" for i in range(size + 1)]
    schema = f"doc_id {kind}, held_out boolean, mark binary, word binary, uses long, is_doc long, n_tokens long, n_known long, base double, {', '.join(f'{x} double' for x in sums)}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        head, bases, scores, *_ = sent.value
        for batch in batches:
            ids, held = batch.column(0), batch.column(1)
            names = ids.to_pylist()
            for a, texts in slices(batch, 2, 128):
                at, mark, word, n, total, known, base, by = [], [], [], [], [], [], [], []
                for i, text in enumerate(texts, a):
                    # equal rows share a mark, by which a text's parts meet again
                    digest = xxhash.xxh3_128(text or b"")
                    digest.update(repr(names[i]).encode())
                    digest = digest.digest()
                    own = Counter((text or b"").lower().split())
                    found = [(head[w], k) for w, k in own.items() if w in head]
                    tail = [w for w in own if w not in head]
                    places, uses = [x for x, _ in found], np.array([k for _, k in found], float)
                    count = sum(own.values())
                    # a word holds no space, so this key is one row's own and none is hot
                    at += [i] + [None] * len(tail)
                    mark += [digest] * (len(tail) + 1)
                    word += [b" " + digest + str(i).encode(), *tail]
                    n += [0, *(own[w] for w in tail)]
                    total += [count + 1] + [0] * len(tail)
                    known += [int(uses.sum()) + end_known] + [0] * len(tail)
                    base += [uses @ bases[places] + end_base] + [0.0] * len(tail)
                    by.append(uses @ scores[places] + end_score)
                    by.append(np.zeros((len(tail), size + 1)))
                take, by = pa.array(at, pa.int64()), np.vstack(by)
                is_doc = pa.array([int(x > 0) for x in total], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), held.take(take), pa.array(mark, pa.binary()), pa.array(word, pa.binary()), pa.array(n, pa.int64()), is_doc, pa.array(total, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), *(pa.array(by[:, k]) for k in range(size + 1))],
                    ["doc_id", "held_out", "mark", "word", "uses", "is_doc", "n_tokens", "n_known", "base", *sums],
                )

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the scores of the words outside the head; a join's rows come by word, so each is spelled about once."""
        v, (*_, tables, m) = vocabulary(path), sent.value
        known = Cache(lambda words: list(log_marginals(v, [b" " + w for w in words], tables)), 100_000)
        for batch in gathered(batches):
            tail = np.flatnonzero(batch.column("is_doc").to_numpy(zero_copy_only=False) == 0)
            out = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in sums], 1)
            if len(tail):
                words = batch.column("word").take(pa.array(tail)).to_pylist()
                of = known.add(words)
                by = np.stack([batch.column(x).to_numpy(zero_copy_only=False)[tail] for x in each], 1).astype(float)
                uses = batch.column("uses").to_numpy(zero_copy_only=False)[tail]
                spelled = np.stack([of[w] for w in words])
                out[tail, :size] = uses[:, None] * word_scores(m, by, spelled[:, :size])
                out[tail, size] = uses * (spelled[:, size] - 2 * math.log(2)) / math.log(10)
            kept = [batch.column(x) for x in ("doc_id", "held_out", "mark", "is_doc", "n_tokens", "n_known", "base")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(size + 1))], ["doc_id", "held_out", "mark", "is_doc", "n_tokens", "n_known", "base", *sums])

    narrow = docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text"))
    parts = narrow.mapInArrow(rows, schema)
    joined = parts.join(counts.withColumnRenamed("word", "k_word"), F.col("word") == F.col("k_word"), "left")
    c, is_doc = F.coalesce("c", F.lit(0)), F.col("is_doc") == 1
    value = F.log10((c + 0.5) / F.lit(model.total + 0.5 * (model.types + 1)))
    joined = joined.select(
        "doc_id", "held_out", "mark", "word", "uses", "is_doc", "n_tokens", F.when(is_doc, F.col("n_known")).when(c > 0, F.col("uses")).otherwise(F.lit(0)).alias("n_known"),
        F.when(is_doc, F.col("base")).otherwise(F.col("uses") * value).alias("base"), *sums, *(F.coalesce(x, F.lit(0)).alias(x) for x in each),
    )
    scored = joined.mapInArrow(spell, f"doc_id {kind}, held_out boolean, mark binary, is_doc long, n_tokens long, n_known long, base double, {', '.join(f'{x} double' for x in sums)}")
    # rows of one doc_id and one text add up together and are divided again
    copies = F.sum("is_doc")
    out = scored.groupBy("mark").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), copies.alias("copies"), F.floor(F.sum("n_tokens") / copies).cast("long").alias("n_tokens"), F.floor(F.sum("n_known") / copies).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.sum("base") / copies).alias("base_score"), *((F.sum(x) / copies).alias(x) for x in sums),
    )
    share = np.maximum(model.docs, 1) / np.maximum(model.docs, 1).sum()
    *classes, lattice = sums
    best = F.array_max(F.array(*classes))
    mixture = sum((F.lit(float(w)) * F.pow(F.lit(10.0), F.col(x) - best) for x, w in zip(classes[1:], share[1:], strict=True)), F.lit(float(share[0])) * F.pow(F.lit(10.0), F.col(classes[0]) - best))
    out = out.withColumn("score", best + F.log10(mixture)).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.col(lattice).alias("lattice_score"))


def op5_lattice(docs: DataFrame, path: str = PIECE_MODEL) -> DataFrame:
    flagged = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "text", "lang")
    return score(flagged, fit(flagged.where(~F.col("held_out")), path), path)
