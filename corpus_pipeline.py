"""A training corpus from raw documents: quality, language, near duplicates, source mix, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame; all
but the last return the columns of `docs`. `run` writes each stage's rows to the shared folder and reads them again.

Cases: rows with null or empty text have no quality and no language and are rejected by the first two stages; rows
that share a doc_id are one document, of which one row stays; rows without a doc_id aren't compared and stay; an empty
table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import dedup, encode, langid, mixing, quality
from ledgerlens.llm.common import quoted, ready, table, whole_row, written

LEAST_POSTERIOR = 0.5
#: No stage but the mix can be said in SQL (fitted models, encodings): the stages are tested against brute force.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns as one struct, so that no name can clash with an operator's own."""
    return docs.select("doc_id", "text", whole_row(docs).alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted to `labels.quality` of these rows, predicts to be good."""
    net = quality.fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score_quality(packed(docs), net, ["row"]).where("predicted = 1").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a language learned from these rows' `lang`: with letters, a posterior of at least LEAST_POSTERIOR, and a gain over
    the vocabulary's own weights that labelled documents of that language have. Noise and other languages have none.

    Models and least gains come from all labelled rows. Each text is scored once: the scores are written beside the rows."""
    models = langid.fit_languages(docs.select("doc_id", "text", "lang"), train_docs=None)
    found = written(spark, langid.predict_languages(packed(docs), models, keep=("row",)), "languages")
    least = langid.gain_floors(found.select("row.lang", "lang_pred", "gain"))
    enough = F.lit(False)
    for lang, gain in sorted(least.items()):
        enough = F.when(F.col("lang_pred") == lang, F.col("gain") >= gain).otherwise(enough)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_POSTERIOR) & enough).select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that of the least doc_id (of its rows the one with the least text),
    and all rows without a doc_id."""
    stays = dedup.near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    rows = docs.join(stays, "doc_id", "left_semi").select(whole_row(docs).alias("row"))
    # repeated rows meet in parts before the shuffle
    first = rows.groupBy("row.doc_id").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row.*")
    return first.unionAll(docs.where(F.col("doc_id").isNull()).select(*map(quoted, docs.columns)))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the sources' budgets say; the text at a cut keeps its first words, and n_chars follows it."""
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the piece ids of their texts."""
    return encode.encode(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("dedup", dedup_stage), ("mix", mix_stage), ("encode", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(spark, docs, f"stage-{name}")
    return docs
