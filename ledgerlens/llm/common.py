"""What the corpus operators share: word rule, hash splits, input reading and lineage cuts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import written as written

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it is not installed (local mode, shared file system), and hands
    them fewer rows at once than Spark's default, which is meant for narrow rows: texts are long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    # workers live on between tasks: let them give freed memory back
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "1"), ("MALLOC_MMAP_THRESHOLD_", "262144"), ("MALLOC_TRIM_THRESHOLD_", "262144")):
        env.setdefault(name, value)
    known = env.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, known) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """The name of a column as Spark's parser takes it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame, names: list[str] | None = None) -> Column:
    """All columns, or those named, as one struct."""
    return F.struct(*(F.col(quoted(c)) for c in (docs.columns if names is None else names)))


def schema_of(docs: DataFrame, keep: Iterable[str], more: str) -> StructType:
    """The schema of the columns `keep` of `docs` and of those that `more` declares."""
    return StructType([docs.schema[c] for c in keep] + StructType.fromDDL(more).fields)


def in_arrow(docs: DataFrame, make: Callable, schema: StructType) -> DataFrame:
    """`mapInArrow` over columns known by their places, as it takes no names with quotes in them."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(make, schema)


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of the value as text modulo `divisor`; a null value counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % F.lit(divisor)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of words; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch, column: int, step: int = 512):
    """(start, values) of a column of an Arrow batch, a few at a time: the Python copies of long texts stay small.
    Strings come as their UTF-8 bytes."""
    import pyarrow as pa

    whole = batch.column(column)
    if pa.types.is_string(whole.type):
        whole = whole.cast(pa.binary())
    for a in range(0, len(whole), step):
        yield a, whole.slice(a, step).to_pylist()


def gathered(batches, rows: int = 50_000):
    """The same rows in larger Arrow batches, for work whose overhead is by batch; only for narrow rows."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of about `per_class` labelled documents a class, chosen by a hash of the doc_id.

    The chosen labels number about twice `per_class` whatever the tables' sizes, so they are broadcast. Of several rows
    with one doc_id and label, the one of the least text is taken.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).distinct()
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sorted(sizes.items()):
        share = F.when(F.col("label") == label, min(1.0, per_class / n)).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
