"""SimHash near-dedup: 64-bit fingerprints of four-word shingles, linked at 4 or fewer differing bits by pigeonring filtering.

1. Every text's shingles, repeats included, are hashed (XXH64); a bit of the fingerprint is set if it is set in over half
   of the hashes. Equal fingerprints are one node, so copies are counted where they are read.
2. The 64 bits lie on a ring of 5 segments. If two fingerprints differ in at most 4 bits, there is a segment from which
   every run of l consecutive segments differs in at most floor(4 l / 5) bits: 0 in the first, 1 in the first two, 2 in
   three, 3 in four. The index takes the first two steps: a key is a segment, and the next one without one of its bits.
   Nodes that share a key are candidates, the longer runs prune them, and the full distance is the last run's.
3. Nodes that agree in two whole segments meet first, each compared with two nodes of its bucket: of five keys a node, this
   makes most near copies one component. A bucket of the index whose nodes are in one component is then done, whatever its
   size: it is counted, but its rows are never joined.
4. The open buckets' rows are joined with three nodes of the bucket. Small buckets are compared in full, between components;
   of large ones all nodes are compared with those three: a number of pairs linear in the bucket's size. What is then open
   of a large bucket: the few nodes that aren't in its main component are compared with all others. The rest goes through
   midpoints, without pairs: two fingerprints are linked exactly if some value is at most 2 bits from both, so all nodes
   that can reach a value with 2 changed bits are one component; only components are handed on. No link is lost by a
   bucket's size.

Cases: null text counts as empty; a text without words has fingerprint zero and is linked like any other; fewer words than
four are one shingle; rows that share a doc_id are one document, with the links of all its fingerprints; rows without a
doc_id have a fingerprint, but no component; repeated rows each get the same result; bytes that aren't UTF-8 are hashed as
they are; very long texts are hashed in stretches; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .components import components

WIDTH, SEED, BITS, MOST, SEGMENTS = 4, 42, 64, 4, 5
SMALL, MINOR, STRETCH = 24, 64, 1 << 18
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: (first bit, bits) of each segment of the ring.
RING = [(i * BITS // SEGMENTS, (i + 1) * BITS // SEGMENTS - i * BITS // SEGMENTS) for i in range(SEGMENTS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment(i: int) -> int:
    start, n = RING[i % SEGMENTS]
    return ((1 << n) - 1) << start


def simhash(text: bytes | None) -> int:
    """Fingerprint of a text's bytes as a signed 64-bit number."""
    import xxhash

    ones, n, words, a = np.zeros(BITS, np.int64), 0, [], 0
    text = (text or b"").lower()
    while a < len(text):
        cut = BLANK.search(text, a + STRETCH)
        end = cut.start() if cut else len(text)
        words, a = words[len(words) - min(len(words), WIDTH - 1) :] + text[a:end].split(), end
        if len(words) < WIDTH:
            continue
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + WIDTH]), SEED) for i in range(len(words) - WIDTH + 1)), np.uint64, len(words) - WIDTH + 1)
        n += len(h)
        for b in range(0, len(h), 4096):
            ones += np.unpackbits(h[b : b + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    if not n and words:
        return signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, node): the fingerprint of each row's text, as a number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [simhash(t) for _, texts in slices(batch, 1, 256) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], ["doc_id", "node"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(make, f"doc_id {kind}, node long")


def keys_of(node: Column) -> Column:
    """array of the index keys of a node: for each segment and each bit of the next one, both without that bit. A number for
    the place stands in a segment that the key leaves out; where keys of two places agree by chance, candidates are added."""
    return masked(node, [[1 << RING[(i + 1) % SEGMENTS][0] + b for b in range(RING[(i + 1) % SEGMENTS][1])] for i in range(SEGMENTS)])


def whole_keys(node: Column) -> Column:
    """array of five keys: each segment with the next one, no bit left out."""
    return masked(node, [[0]] * SEGMENTS)


def masked(node: Column, leave_out: list[list[int]]) -> Column:
    """Each segment with the next one, without each of the bits that `leave_out` has for it, and with a number for the place."""
    out, place = [], 0
    for i, bits in enumerate(leave_out):
        masks = [signed((segment(i) | segment(i + 1)) & ~bit) for bit in bits]
        marks = [signed((place + b) << RING[(i + 2) % SEGMENTS][0]) for b in range(len(bits))]
        place += len(bits)
        pairs = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for m, k in zip(masks, marks, strict=True)))
        out.append(F.transform(pairs, lambda x: node.bitwiseAND(x["m"]).bitwiseOR(x["k"])))
    return F.concat(*out)


def on_ring(x: Column, y: Column) -> Column:
    """Whether two nodes are linked: some segment begins runs that all keep within their budgets, the last being all bits."""
    differ = x.bitwiseXOR(y)
    runs, some = [], None
    for i in range(SEGMENTS):
        mask, fits = 0, None
        for length in range(1, SEGMENTS):
            mask |= segment(i + length - 1)
            step = F.bit_count(differ.bitwiseAND(F.lit(signed(mask)))) <= MOST * length // SEGMENTS
            fits = step if fits is None else fits & step
        runs.append(fits)
    for fits in runs:
        some = fits if some is None else some | fits
    return some & (F.bit_count(differ) <= MOST)


def linked(pairs: DataFrame) -> DataFrame:
    """The distinct linked pairs (a, b) of candidates (x, y)."""
    return pairs.where((F.col("x") != F.col("y")) & on_ring(F.col("x"), F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def exploded(nodes: DataFrame, keys: Column) -> DataFrame:
    """The rows of `nodes`, one a key. Spark takes them for as small as `nodes`, so the hint keeps it from sending them to the
    driver and all tasks for a join."""
    return nodes.select(*nodes.columns, F.explode(keys).alias("key")).hint("merge")


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """`named` (node, label) after links (a, b) between labels."""
    labels = components(links).toDF("label", "new")
    return written(named.sparkSession, named.join(labels, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "named")


def between(named: DataFrame, links: DataFrame) -> DataFrame:
    """The distinct links (a, b) between the labels of linked nodes, so that only what is new goes through further rounds."""
    of = lambda c: named.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    # candidates come out of arrays: more than Spark takes them for
    found = links.hint("merge").join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b")
    return written(named.sparkSession, found.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), "links")


def alike(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of the nodes that agree in two whole segments to the least and the greatest node of their bucket."""
    flat = exploded(nodes.select("node"), whole_keys(F.col("node")))
    ends = flat.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    rows = written(nodes.sparkSession, flat.join(ends, "key"), "alike")
    return linked(rows.select(F.col("node").alias("x"), F.col("lo").alias("y")).unionAll(rows.select("node", "hi")))


def open_buckets(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `named` (node, label), the buckets with several labels. Of two nodes: (x, y). Of others, by node: (key, node, label,
    members, lo, hi, lead), where lead is a node that a hash chooses."""
    spark, by = named.sparkSession, F.xxhash64("node", "key")
    flat = exploded(named.select("node", "label"), keys_of(F.col("node")))
    ends = F.count(F.lit(1)).alias("members"), F.min("node").alias("lo"), F.max("node").alias("hi")
    several = flat.groupBy("key").agg(*ends, F.min("label").alias("least"), F.max("label").alias("most"), F.max_by("node", by).alias("lead")).where("least <> most")
    several = written(spark, several.drop("least", "most"), "buckets")
    rows = written(spark, flat.join(several.where("members > 2"), "key"), "open")
    return several.where("members = 2").select(F.col("lo").alias("x"), F.col("hi").alias("y")), rows


def minorities(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For buckets of which all but MINOR nodes at most are in one component: the links (a, b) of those nodes to all others of
    the bucket. Of the other buckets with several components: (node, label)."""
    now = labelled_rows(rows, labels)
    sizes = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", "n").alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    left = written(rows.sparkSession, now.join(sizes, "key").select("key", "node", "label", "main", "others"), "open")
    own = left.where(F.col("others") <= MINOR)
    minor = own.where("label <> main").groupBy("key").agg(F.collect_list("node").alias("minor"))
    found = own.join(minor, "key").select(F.col("node").alias("x"), F.explode(F.filter("minor", lambda y: (F.bit_count(F.col("node").bitwiseXOR(y)) <= MOST) & (F.col("node") != y))).alias("y"))
    return linked(found), left.where(F.col("others") > MINOR).select("node", "label").distinct()


def by_midpoints(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the labels of `nodes` (node, label) that make one component of all within MOST bits."""
    spark = nodes.sparkSession
    changes = [0, *(1 << i for i in range(BITS)), *(1 << i | 1 << j for i, j in combinations(range(BITS), 2))]
    changes = F.array(*(F.lit(signed(c)) for c in changes))
    links, labels = None, nodes
    while True:
        near = labels.select("label", F.explode(F.transform(changes, lambda c: F.col("node").bitwiseXOR(c))).alias("z"))
        meet = near.groupBy("z").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("a", "b").distinct()
        meet = written(spark, meet, "midpoints")
        links = meet if links is None else links.unionAll(meet)
        if meet.isEmpty():
            return links
        new = components(links).withColumnRenamed("label", "new")
        labels = written(spark, labels.join(new, labels["label"] == new["node"], "left").select(labels["node"], F.coalesce("new", labels["label"]).alias("label")), "midpoint-labels")


def near_simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    base = written(spark, fingerprints(docs), "simhashes")
    known = base.where(F.col("doc_id").isNotNull())
    nodes = written(spark, known.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    links = alike(nodes)
    # rows of one doc_id with several fingerprints are one document
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    links = written(spark, links.unionAll(known.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()), "links")
    named = written(spark, labelled_rows(nodes.select("node"), components(links)), "named")
    pairs, left = open_buckets(named)
    small = left.where(F.col("members") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("node", "label")).alias("m"))
    full = small.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["node"] > x["node"]) & (y["label"] != x["label"])), lambda y: F.struct(x["node"].alias("x"), y["node"].alias("y")))))).alias("p")).select("p.x", "p.y")
    large = left.where(F.col("members") > SMALL)
    led = large.select(F.col("node").alias("x"), F.explode(F.array("lo", "hi", "lead")).alias("y"))
    named = merged(named, between(named, linked(pairs.unionAll(full).unionAll(led))))
    few, rest = minorities(large.select("key", "node"), named)
    links, rest = between(named, few), written(spark, rest, "rest")
    named = merged(named, links if rest.isEmpty() else links.unionAll(by_midpoints(rest)))
    # a component's id is the least doc_id of its nodes
    of = nodes.join(named, "node")
    least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = of.select("node", "label").join(least, "label").select("node", "component_id")
    out = base.join(ids, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def op13_simhash(docs: DataFrame) -> DataFrame:
    return near_simhash(docs)
