"""Near duplicates by MinHash with sequential Bayesian verification.

1. One pass hashes every text's distinct five-word shingles (64 bits), and takes 250 minima, of which 50 bands of 5
   make the candidates: a pair at the threshold of 0.75 shares no band with probability 1.3e-6. Equal sets (told by a
   fingerprint of 128 bits) are one node with a number, however many rows have that set.
2. Nodes that share a band meet in the band's bucket. In each bucket all nodes are first compared with one leader (the
   smallest set, then another): a number of pairs linear in the bucket's size. A bucket whose nodes are then all in one
   component is done, whatever its size: its other pairs can't change the result.
3. What is left of small buckets is compared in full. What is left of large ones (many texts with one long passage in
   common) goes through an exact prefix filter: any two sets at the threshold share one of the rarest quarter of their
   shingles at positions that leave enough room for the overlap, so common passages make no candidates. Sets meet
   only within a class of sizes and its neighbour, and a shingle that many prefixes share is dealt over many tasks.
4. Each candidate is verified in sequence: signatures are compared 50 minima at a time, and a pair is dropped as soon
   as the posterior probability (uniform prior) that its similarity reaches the threshold is under `miss`; the rest are
   confirmed on the full sets.

Only texts of candidates are read again, each once: their sets are kept for later steps. The broadcast of their ids is
behind a check of their number.

Cases: texts without words have an empty set, are linked with nothing and are their own component; texts of fewer than
five words are one shingle; rows that share a doc_id are one document, with the links of all its texts; rows without
a doc_id have no component and aren't kept; repeated rows each get the same result; extra columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, slices, written
from .components import components

WIDTH, BANDS, BAND_ROWS, BLOCK = 5, 50, 5, 50
NEED, OF, MISS = 75, 100, 1e-6
SMALL, MOST_BROADCAST, SPLIT = 24, 1_000_000, 2000
K = BANDS * BAND_ROWS
_RANDOM = np.random.default_rng(20240607)
MULT = _RANDOM.integers(0, 2**31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PLUS = _RANDOM.integers(0, 2**32, K, dtype=np.uint32)
PLACE = _RANDOM.integers(0, 2**63, max(WIDTH, BAND_ROWS) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT = _RANDOM.integers(0, 2**63, BANDS, dtype=np.uint64)
LETTER = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
BASE, STRETCH = 0x9E3779B97F4A7C15, 1 << 18
#: The bytes between words.
BLANK = re.compile(rb"[\x20\x09-\x0D]")
IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers (rounded up to a power of 2) of BASE and of its inverse modulo 2**64."""
    return _powers(1 << max(12, (n - 1).bit_length()))


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x))
    return tuple(both)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, lower-cased in A-Z: a polynomial of a word's bytes from running sums over a stretch
    of text (about STRETCH bytes, to the next blank), mixed with its length."""
    out, a = [], 0
    text = text.lower()
    while a < len(text):
        cut = BLANK.search(text, a + STRETCH)
        end = cut.start() if cut else len(text)
        b = np.frombuffer(text, np.uint8, end - a, a)
        a = end
        edge = np.flatnonzero(np.diff(IS_BLANK[b], prepend=True, append=True))
        start, stop = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            up, down = powers(len(b) + 1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(LETTER[b] * up[: len(b)], out=sums[1:])
            out.append(mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * PLACE[0]))
    return np.concatenate(out) if len(out) != 1 else out[0]


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(h) < width:
            return mixed(np.array([(h * PLACE[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
        n = len(h) - width + 1
        total = h[:n] * PLACE[0]
        for j in range(1, width):
            total += h[j : j + n] * PLACE[j]
    return np.unique(mixed(total))


def name_of(h: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(h.tobytes())


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of each of K random permutations of the hashes' upper 32 bits."""
    x, out, room = (h >> np.uint64(32)).astype(np.uint32)[:, None], np.full(K, 2**32 - 1, np.uint32), np.empty((128, K), np.uint32)
    for a in range(0, len(x), 128):
        y = room[: len(x[a : a + 128])]
        np.multiply(x[a : a + 128], MULT, out=y)
        y += PLUS
        np.minimum(out, y.min(0), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((low.astype(np.uint64).reshape(BANDS, BAND_ROWS) * PLACE[:BAND_ROWS]).sum(1) + SALT).view(np.int64)


def least_matches(miss: float = MISS, share: float = NEED / OF) -> list[int]:
    """For 50, 100, ... compared minima: the fewest matches at which P(similarity >= share | matches) is at least `miss`."""
    out = []
    for n in range(BLOCK, K + 1, BLOCK):
        below, m = 0.0, -1
        while below < miss:  # under a uniform prior the posterior is a binomial's distribution function
            m += 1
            below += math.comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
        out.append(m)
    return out


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, th and text (bytes): a document's rows are told apart by the hash of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, fp, bands, sig): size and fingerprint of each text's set, band keys and 16 bits of each minimum."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, bands, sig = [], [], [], []
            for text in (t for _, texts in slices(batch, 2, 256) for t in texts):
                h = shingles(text)
                n.append(len(h))
                fp.append(name_of(h))
                low = minima(h) if len(h) else None
                bands.append(band_keys(low) if len(h) else [])
                sig.append(low.astype(np.uint16).tobytes() if len(h) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "th", "n", "fp", "bands", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_of(docs).mapInArrow(make, f"doc_id {kind}, th long, n long, fp binary, bands array<long>, sig binary")


def likely(pairs: DataFrame, nodes: DataFrame, miss: float = MISS) -> DataFrame:
    """The pairs (a, b) that no step of the sequential test drops."""
    least = least_matches(miss)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, K) for i in (2, 3))
            live, same = np.arange(len(a)), np.zeros(len(a), int)
            for step, need in enumerate(least):
                part = slice(step * BLOCK, (step + 1) * BLOCK)
                same[live] += (a[live, part] == b[live, part]).sum(1)
                live = live[same[live] >= need]
            take = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    sig = nodes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(test, "a long, b long")


class Sets:
    """Shingle hashes of nodes, made from their texts when first asked for and kept in the shared folder."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes, self.made = docs, nodes, None

    def of(self, ids: DataFrame) -> DataFrame:
        """(node, h), one row a node, for at least the distinct nodes of `ids` (node)."""
        spark = self.docs.sparkSession
        new = ids if self.made is None else ids.join(self.made.select("node"), "node", "left_anti")
        new = written(spark, new.join(self.nodes.select("node", "fp", "doc_id", "th"), "node"), "set-ids")
        count = new.count()
        if count or self.made is None:
            made = written(spark, self.read(F.broadcast(new) if count <= MOST_BROADCAST else new), "sets")
            if made.count() > count:  # repeated rows
                made = written(spark, made.dropDuplicates(["node"]), "sets")
            self.made = made if self.made is None else self.made.unionAll(made)
        return self.made

    def read(self, ids: DataFrame) -> DataFrame:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nodes, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, texts in slices(batch, 2, 256):
                    h = [shingles(t) for t in texts]
                    own = [i for i, x in enumerate(h) if name_of(x) == names[a + i]]
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[a + i] for i in own], pa.int64()), pa.array([h[i].view(np.int64) for i in own], pa.list_(pa.int64()))], ["node", "h"])

        rows = rows_of(self.docs).join(ids, ["doc_id", "th"]).select("node", "fp", "text")
        return rows.mapInArrow(make, "node long, h array<long>")


def verified(pairs: DataFrame, nodes: DataFrame, sets: Sets) -> DataFrame:
    """The distinct pairs (a, b) at the threshold, first by signatures in sequence, then on the full sets."""
    spark = pairs.sparkSession
    left = written(spark, likely(pairs, nodes), "likely")
    ids = left.select(F.col("a").alias("node")).unionAll(left.select(F.col("b").alias("node"))).distinct()
    known = sets.of(ids)
    both = left.join(known.toDF("a", "h_a"), "a").join(known.toDF("b", "h_b"), "b")
    both = both.select("a", "b", F.size("h_a").alias("n_a"), F.size("h_b").alias("n_b"), F.size(F.array_intersect("h_a", "h_b")).alias("o"))
    return written(spark, both.where(OF * F.col("o") >= NEED * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b"), "links")


def ordered(frame: DataFrame, x: str, y: str) -> DataFrame:
    return frame.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def fits(x: str, y: str):
    return OF * F.least(x, y) >= NEED * F.greatest(x, y)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, node, n, members) of the buckets that still hold several components."""
    now = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return now.join(several, "key")


def prefix_pairs(sets: Sets, members: DataFrame) -> DataFrame:
    """Candidates (a, b) among `members` (node, label) of different labels: every pair at the threshold is among them."""
    spark = members.sparkSession
    known = sets.of(members.select("node")).join(members.select("node"), "node", "left_semi")
    flat = known.select("node", F.size("h").alias("n"), F.explode("h").alias("s"))
    often = flat.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # rare shingles first; those of one set alone take the first places but pair with nothing
    ranks = flat.join(often, "s", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    first = ranks.withColumn("pos", F.row_number().over(W.partitionBy("node").orderBy("df", "s")))
    first = first.where((F.col("pos") <= F.col("n") - F.ceil(F.col("n") * NEED / OF) + 1) & (F.col("df") > 1)).join(members, "node")
    # sizes of a pair differ by a class at most
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(OF / NEED)).cast("int")
    first = written(spark, first.select("s", "node", "n", "pos", "label", size_class.alias("c")), "prefix")
    parts = first.groupBy("s", "c").agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("parts")).where("parts > 1")
    parts = parts.select("s", F.explode(F.array("c", F.col("c") + 1)).alias("c"), "parts").groupBy("s", "c").agg(F.max("parts").alias("parts"))
    cut = first.join(parts, ["s", "c"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = cut.select("s", "c", F.pmod(F.xxhash64("node"), "parts").alias("part"), *(F.col(i).alias(f"{i}_x") for i in ("node", "n", "pos", "label")))
    # each set stands in its own class and in the one below it, in all parts of that class
    y = first.select("s", F.explode(F.array("c", F.col("c") - 1)).alias("c"), F.col("c").alias("c_y"), *(F.col(i).alias(f"{i}_y") for i in ("node", "n", "pos", "label")))
    y = y.join(parts, ["s", "c"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    room = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) + 1
    # overlap >= 75/175 of both sizes together; a first common shingle at these places allows `room` at most
    near = ((F.col("c_y") > F.col("c")) | (F.col("node_x") < F.col("node_y"))) & (F.col("label_x") != F.col("label_y")) & (room * (NEED + OF) >= NEED * (F.col("n_x") + F.col("n_y")))
    found = x.join(y, ["s", "c", "part"]).where(near)
    return ordered(found, "node_x", "node_y")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    base = written(spark, signatures(docs), "signatures")
    known = base.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # rows of one set agree in n, bands and sig; its text is found by its least doc_id; the written numbers are its own
    nodes = known.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = written(spark, nodes.select(F.monotonically_increasing_id().alias("node"), "fp", "r.doc_id", "r.th", "n", "bands", "sig"), "nodes")
    sets = Sets(docs, nodes)
    flat = nodes.select(F.explode("bands").alias("key"), "node", "n")
    buckets = flat.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min_by("node", "n").alias("lead"), F.min("n").alias("lead_n")).where("members > 1")
    rows = written(spark, flat.join(buckets, "key"), "buckets")
    links = verified(ordered(rows.where(fits("n", "lead_n")), "node", "lead"), nodes, sets)
    # rows of one doc_id with different texts are one document
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    names = nodes.select("node", "fp")
    same = known.select("doc_id", "fp").join(several, "doc_id").where("a <> fp").select("a", "fp").distinct()
    same = same.join(names.toDF("x", "a"), "a").join(names.toDF("y", "fp"), "fp")
    links = links.unionAll(ordered(same, "x", "y"))
    labels = components(links)
    # another leader for the large buckets that aren't one component yet
    open_rows = labelled(rows.select("key", "node", "n", "members"), labels)
    large = written(spark, open_rows.where(F.col("members") > SMALL), "large")
    second = large.groupBy("key").agg(F.max_by(F.struct("node", "n", "label"), F.xxhash64("node", "key")).alias("l"))
    again = large.join(second, "key").where((F.col("l.label") != F.col("label")) & fits("n", "l.n"))
    tried = verified(ordered(again.select("node", F.col("l.node").alias("lead")), "node", "lead"), nodes, sets)
    links = links.unionAll(tried)
    labels = components(links)
    open_rows = written(spark, labelled(rows.select("key", "node", "n", "members"), labels), "open")
    small = open_rows.where(F.col("members") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n", "label"))).alias("m"))
    pairs = small.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, F.size("m")), lambda y: (y["label"] != x["label"]) & (OF * F.least(x["n"], y["n"]) >= NEED * F.greatest(x["n"], y["n"]))), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))).alias("p")).select("p.a", "p.b")
    members = open_rows.where(F.col("members") > SMALL).select("node", "label").distinct()
    rest = pairs.unionAll(prefix_pairs(sets, members)).distinct()
    links = links.unionAll(verified(rest, nodes, sets))
    labels = components(links)
    # a component's id is the least doc_id of its nodes
    linked = nodes.select("node", "doc_id").join(labels, "node")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("least"))
    ids = nodes.select("node", "fp", "doc_id").join(labels, "node", "left").join(least, "label", "left").select("fp", F.coalesce("least", "doc_id").alias("least"))
    mine = base.select("doc_id", "n", "fp").join(ids, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")))
    return mine.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op1_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
