"""Token counts by an exact length histogram.

Documents are encoded with a public byte-level vocabulary; only their lengths leave the encoding pass, aggregated
by length before the shuffle. Suffix sums over the histogram then answer, for every context limit that a document
length sets, how many documents and tokens are beyond it, the truncated total and the quantile reached. The sums
run in blocks of 1024 lengths with the blocks' totals added, so no task sees more than a block of lengths.

Cases: null and empty texts have length 0; bytes that aren't UTF-8 are encoded as replacement characters; very long texts,
also runs of white space or of letters of millions of characters, are encoded whole; repeated rows count each; other columns
are left out; an empty table gives an empty histogram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BYTE_BPE, slices, written

#: Fixed value: how the vocabulary's public definition cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern means it, in runs that its search has no room for.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1024,}")
BLOCK = 1024


def encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_length(enc, text: str) -> int:
    """Tokens of a text. Of a long run of white space all but the last character (all at the text's end) are one piece; the last
    one goes with what follows."""
    total, a = 0, 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += len(enc.encode_ordinary(text[a : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
        a = end
    return total + len(enc.encode_ordinary(text[a:] if a else text))


def token_lengths(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """(length) of each document, in tokens."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out = [encoded_length(enc, t.decode("utf-8", "replace")) if t else 0 for _, texts in slices(batch, 0) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["length"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lengths, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(length, docs) with, for the limit `length`: documents and tokens at or above it, the total if every document is
    cut there, the total of those that fit whole, and the share of documents that fit."""
    # two branches read the counts, so they are written: texts are encoded once
    counts = written(lengths.sparkSession, lengths.groupBy("length").agg(F.count(F.lit(1)).alias("docs")), "lengths")
    h = counts.withColumn("h_block", F.floor(F.col("length") / BLOCK))
    h = h.withColumn("h_tokens", F.col("length") * F.col("docs"))
    later = W.orderBy(F.desc("h_block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = h.groupBy("h_block").agg(F.sum("docs").alias("b_docs"), F.sum("h_tokens").alias("b_tokens"))
    every = W.partitionBy()
    blocks = blocks.select(
        F.col("h_block").alias("b_block"),
        F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("l_docs"), F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("l_tokens"),
        F.sum("b_docs").over(every).alias("total_docs"), F.sum("b_tokens").over(every).alias("total_tokens"),
    )
    inside = W.partitionBy("h_block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    s = h.withColumn("i_docs", F.sum("docs").over(inside)).withColumn("i_tokens", F.sum("h_tokens").over(inside))
    s = s.join(blocks, F.col("h_block") == F.col("b_block"))
    at_docs, at_tokens = F.col("i_docs") + F.col("l_docs"), F.col("i_tokens") + F.col("l_tokens")
    return s.select(
        "length", "docs", at_docs.alias("docs_from"), at_tokens.alias("tokens_from"),
        (F.col("total_tokens") - at_tokens + F.col("length") * at_docs).alias("truncated_total"),
        (F.col("total_tokens") - at_tokens + F.col("length") * F.col("docs")).alias("whole_total"),
        ((F.col("total_docs") - at_docs + F.col("docs")) / F.col("total_docs")).alias("share_within"),
        "total_docs", "total_tokens",
    )


def length_quantile(hist: DataFrame, share: float) -> DataFrame:
    """One row: the least length within which at least `share` of all documents fit."""
    return hist.where(F.col("share_within") >= share).agg(F.min("length").alias("length"))


def total_at(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens of the corpus if every document is cut to `limit` tokens, for any limit."""
    first = hist.where(F.col("length") >= limit).agg(F.coalesce(F.max("docs_from"), F.lit(0)).alias("n"), F.max("tokens_from").alias("t"))
    total = hist.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"))
    return total.crossJoin(first).select((F.col("total") - F.coalesce("t", F.lit(0)) + F.col("n") * limit).alias("truncated_total"))


def op3_lengths(docs: DataFrame) -> DataFrame:
    return histogram(token_lengths(docs))
