"""Exact top-k search by BM25 over an inverted index with block-max WAND pruning, run per shard and merged exactly.

Distinct rows are dealt to shards by a hash. Each shard's postings meet the global document frequencies in a join by
term and become an index: the weight of every posting, by term and then by row, and for every term the greatest weight
in each block of 128 rows that holds it. A shard's index and the queries reach one task as one sorted stream, index
first, so a task holds one shard and a block of queries, however many queries there are.

Queries run together over stretches of 16 and then 128 blocks, in order of the rows. For each query:

1. A block whose sum of the query's block maxima is under the threshold (the k-th best score so far; at first the k-th
   greatest weight of any one of its terms) is skipped with all its postings.
2. The query's terms stand in order of their bounds. Those before the pivot, whose bounds together stay under the
   threshold, can't lift a row to it alone: only rows with a term at or behind the pivot are candidates, and their
   scores from those terms are summed from the postings of the blocks left.
3. A candidate whose score plus the block maxima of the terms before the pivot is under the threshold is dropped. Only
   for the rest are the postings of those terms looked up, or, where many rows are left, taken by a matrix product.

What is the same for many queries is done for all of them at once (block bounds, frequent terms); postings of other terms
are joined and summed query by query, in arrays as long as one stretch: memory that a query writes stays in the cache.

Every step compares bounds that no score exceeds, so nothing is lost. The shards' best k are merged by score.

Scores are rounded to 6 digits and ties go to the lower (conv_id, turn), nulls last, so results are exact and repeatable.

Cases: texts without words are found by no query and find nothing; words of a query that occur nowhere else count for
the row itself; repeated rows are indexed once with their number and are all found, and each distinct query is answered
once; rows without a conv_id can be found but don't ask; extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

K1, B, TOP, EVERY = 1.2, 0.75, 10, 20
#: A shard holds about so many rows and bytes; a task answers about so many queries with one copy of a shard's index.
SHARD, SHARD_BYTES, TASK_QUERIES = 16_384, 16 << 20, 65_536
BLOCK, FIRST, BLOCKS, QUERIES = 128, 16, 128, 256
#: So many queries share one product with the frequent terms.
TOGETHER = 32
#: With more than this share of a stretch's rows left, the terms before the pivot are a product too.
MANY = 1 / 16
#: Terms in at least this share of a stretch's rows are scored by a matrix product.
FREQUENT = 1 / 16
#: Bounds are sums in another order than scores, and scores are rounded.
SLACK, OVER = 1e-5, 1 + 1e-9


def shard_postings(rows: DataFrame) -> DataFrame:
    """(shard, term, n, docs, tf) of `rows` (shard, conv_id, turn, text, copies): places and uses of each term in a shard,
    and the number of rows it is in. The empty term holds the rows' ids, numbers and lengths."""

    def build(table: pa.Table) -> pa.Table:
        shard, conv, turn, copies = (table.column(c).to_pylist() for c in ("shard", "conv_id", "turn", "copies"))
        order = sorted(range(table.num_rows), key=lambda i: (conv[i] is None, conv[i] or 0, turn[i] is None, turn[i] or 0))
        found: dict[bytes, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        sizes, text = [], table.column("text")
        for place, i in enumerate(order):
            words = (text[i].as_py() or b"").lower().split()
            sizes.append(len(words))
            for w, k in Counter(words).items():
                found[w][0].append(place)
                found[w][1].append(k)
        pack = lambda x: np.array(x, np.int32).tobytes()
        many = np.array([copies[i] for i in order], np.int64)
        ids = pickle.dumps(([conv[i] for i in order], [turn[i] for i in order], many.tolist()))
        terms = [b"", *found]
        docs, tf = [ids, *(pack(found[w][0]) for w in terms[1:])], [pack(sizes), *(pack(found[w][1]) for w in terms[1:])]
        n = [0, *(int(many[found[w][0]].sum()) for w in terms[1:])]
        return pa.table({"shard": pa.array([shard[0]] * len(terms), pa.int64()), "term": pa.array(terms, pa.binary()), "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.binary()), "tf": pa.array(tf, pa.binary())})

    return rows.groupBy("shard").applyInArrow(build, "shard long, term binary, n long, docs binary, tf binary")


def expanded(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which piece, place) of every element of the pieces that begin at `starts` and hold `sizes` elements."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def joined(x: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    return np.concatenate([x[a:b] for a, b in parts])


class ShardIndex:
    """Postings with weights in one piece, cut into runs of one term and one block of rows with their greatest weight.

    `all_postings` counts those of the terms asked for, `scored` those that queries made use of (those of terms before the
    pivot if `counting` is set)."""

    def __init__(self, postings: list[tuple[bytes, int, bytes, bytes]], total: int, mean: float):
        first = next(p for p in postings if p[0] == b"")
        self.conv, self.turn, self.copies = (pa.array(x, pa.int64()) for x in pickle.loads(first[2]))
        sizes = np.frombuffer(first[3], np.int32)
        self.n = len(sizes)
        norm = K1 * (1 - B + B * sizes / mean) if mean else np.full(self.n, K1)
        terms = sorted(p for p in postings if p[0])
        self.place = {p[0]: i for i, p in enumerate(terms)}
        n = np.array([len(p[2]) // 4 for p in terms], np.int64)
        df = np.repeat(np.array([p[1] for p in terms], float), n)
        self.rows = np.frombuffer(b"".join([p[2] for p in terms]), np.int32)
        tf = np.frombuffer(b"".join([p[3] for p in terms]), np.int32)
        self.weight = np.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm[self.rows])
        self.starts = np.append(0, np.cumsum(n))
        blocks = -(-self.n // BLOCK)
        cell = np.repeat(np.arange(len(terms)), n) * blocks + self.rows // BLOCK
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        self.run_block = (cell[begin] % max(1, blocks)).astype(np.int64)
        self.run_start = np.append(begin, len(self.rows))
        self.run_max = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.run_of = np.searchsorted(begin, self.starts)
        self.blocks = blocks
        self.seed: dict[int, np.ndarray] = {}
        self.cuts: dict[int, np.ndarray] = {}
        self.often: dict[int, tuple[np.ndarray, ...]] = {}
        self.held = [np.zeros(0, np.float32)] * 2
        self.counting, self.all_postings, self.scored = False, 0, 0

    def kth(self, top: int) -> np.ndarray:
        """The `top`-th greatest weight of each term: a query with it has that many rows of at least this score."""
        if top not in self.seed:
            self.seed[top] = np.zeros(len(self.starts) - 1)
            for t in np.flatnonzero(np.diff(self.starts) >= top).tolist():
                self.seed[top][t] = np.partition(self.weight[self.starts[t] : self.starts[t + 1]], -top)[-top]
        return self.seed[top]

    def stretches(self) -> Iterator[tuple[int, int]]:
        """(first block, blocks): a short stretch first, after which thresholds are near their end."""
        a, n = 0, FIRST
        while a < self.blocks:
            yield a, min(n, self.blocks - a)
            a, n = a + n, BLOCKS

    def search(self, queries: list[dict[bytes, int]], top: int) -> list[list[tuple[float, int]]]:
        """(score, row) of the best rows of each query, best first."""
        n_q = len(queries)
        term = np.fromiter((self.place.get(w, -1) for words in queries for w in words), np.int64)
        uses = np.fromiter((k for words in queries for k in words.values()), np.int64)
        q_of, term, uses = (x[term >= 0] for x in (np.repeat(np.arange(n_q), [len(words) for words in queries]), term, uses))
        least = np.zeros(n_q)
        np.maximum.at(least, q_of, self.kth(top)[term] * uses)
        least -= SLACK
        best: list[list[tuple[float, int]]] = [[] for _ in queries]
        pivots = np.ones(n_q, bool)
        for a, blocks in self.stretches():
            self.search_stretch(a, blocks, (q_of, term, uses), least, pivots, best, top)
        return best

    def search_stretch(self, a: int, blocks: int, pairs: tuple[np.ndarray, ...], least: np.ndarray, pivots: np.ndarray, best: list[list[tuple[float, int]]], top: int) -> None:
        """Brings `best` and the thresholds `least` up to the rows of a stretch; `pairs`: (query, term, uses), by query. Queries
        whose pivot left many rows have none (`pivots`) from the next stretch on: all their frequent terms are one product."""
        (q_of, term, uses), n_q, per = pairs, len(best), blocks * BLOCK
        # the runs of each (query, term) in this stretch
        lo, hi = self.runs(term, a), self.runs(term, a + blocks)
        first, size = self.run_start[lo], self.run_start[hi] - self.run_start[lo]
        self.all_postings += int(size.sum())
        # frequent terms: a product of weights, first of those behind the pivot
        kinds, dense, dense32, usual, most = self.frequent(a, blocks)
        often = size >= FREQUENT * per
        asks, own, use = q_of[often], np.searchsorted(kinds, term[often]), uses[often].astype(float)
        high = most.max(1)[np.searchsorted(usual, term[often])] if len(asks) else np.zeros(0)
        before = self.before_pivot(asks, use * high, least) & pivots[asks]
        late32, early = np.zeros((n_q, len(kinds)), np.float32), np.zeros((n_q, len(kinds)))
        late32[asks[~before], own[~before]] = use[~before]
        early[asks[before], own[before]] = use[before]
        early32 = early.astype(np.float32)
        late_size, early_size = (np.bincount(asks[x], size[often][x], n_q).astype(int) for x in (~before, before))
        rests = early @ most[np.searchsorted(usual, kinds)]
        # bounds of blocks: a product for terms with a row a block, and the other terms' runs
        common = size >= blocks
        bounding = np.zeros((n_q, len(usual)))
        bounding[q_of[common], np.searchsorted(usual, term[common])] = uses[common]
        few, rare = np.flatnonzero(~often & (size > 0)), np.flatnonzero(~common & (size > 0))
        pair, run = expanded(lo[rare], (hi - lo)[rare])
        cell = (q_of[rare] * blocks - a)[pair] + self.run_block[run]
        bounds = bounding @ most + np.bincount(cell, self.run_max[run] * uses[rare][pair], n_q * blocks).reshape(n_q, blocks)
        # 32 bits tell which rows can reach the threshold; their scores are made in 64 bits
        error = 1.2e-7 * (np.bincount(q_of, minlength=n_q) + 4) * bounds.max(1) + 1e-6
        live = (bounds > 0) & (bounds * OVER >= least[:, None])
        floor = np.where(live, np.maximum((least - error)[:, None] - rests * OVER, 1e-30), np.inf).astype(np.float32)
        self.scored += int(late_size[live.any(1)].sum())
        # whether no postings of the query are in blocks left out, and whether it uses a word of few rows twice
        all_left, twice = (live | (bounds <= 0)).all(1).tolist(), np.zeros(n_q, np.int64)
        np.maximum.at(twice, q_of[few], uses[few])
        asking, twice = live.any(1).tolist(), (twice > 1).tolist()
        often_cut, few_cut = (np.searchsorted(x, np.arange(n_q + 1)).tolist() for x in (asks, q_of[few]))
        places = list(zip(first[few].tolist(), (first + size)[few].tolist(), strict=True))
        for g in range(0, n_q, TOGETHER):
            n = min(TOGETHER, n_q - g)
            near, scores = np.matmul(late32[g : g + n], dense32, out=self.room(0, n, per)), {}
            # rows of few terms, query by query: what is held at a time stays small
            for i in range(g, g + n):
                some = slice(few_cut[i], few_cut[i + 1])
                if not asking[i] or not places[some]:
                    continue
                if all_left[i]:
                    row, value = joined(self.rows, places[some]), joined(self.weight, places[some])
                    if twice[i]:
                        value *= np.repeat(uses[few[some]], size[few[some]])
                else:
                    owner, run = expanded(lo[few[some]], (hi - lo)[few[some]])
                    keep = live[i][self.run_block[run] - a]
                    owner, run = owner[keep], run[keep]
                    piece, at = expanded(self.run_start[run], self.run_start[run + 1] - self.run_start[run])
                    row, value = self.rows[at], self.weight[at] * uses[few[some]][owner[piece]]
                self.scored += len(row)
                scores[i] = np.bincount(row - a * BLOCK, value, per)
                near[i - g] += scores[i]
            cell = np.flatnonzero(near.reshape(n, blocks, BLOCK) >= floor[g : g + n, :, None])
            ends = np.searchsorted(cell, np.arange(n + 1) * per).tolist()
            left = [(i, cell[x:y] - (i - g) * per) for i, x, y in zip(range(g, g + n), ends, ends[1:]) if y > x]
            # terms before the pivot: looked up for the rows left, or in one product where these are many
            many = [i for i, found in left if early_size[i] and len(found) > per * MANY]
            pivots[many] = False
            more = dict(zip(many, np.matmul(early32[many], dense32, out=self.room(1, len(many), per)), strict=True)) if many else {}
            for i, found in left:
                row = near[i - g][found]
                if i in more:
                    row += more[i][found]
                    self.scored += int(early_size[i])
                elif early_size[i]:
                    used = np.flatnonzero(early32[i])
                    part = dense32[used[:, None], found]
                    row += early32[i, used] @ part
                    if self.counting:
                        self.scored += int(np.count_nonzero(part))
                found = found[row >= self.level(row, least[i], error[i], top)]
                some = slice(often_cut[i], often_cut[i + 1])
                row = use[some] @ dense[own[some, None], found]
                if i in scores:
                    row += scores[i][found]
                best[i] = self.merged(best[i], found + a * BLOCK, row.round(6), top)
                if len(best[i]) == top:
                    least[i] = max(least[i], best[i][-1][0] - SLACK)

    @staticmethod
    def level(near: np.ndarray, least: float, error: float, top: int) -> float:
        """What a row's approximate score must reach: the threshold or the k-th best of these rows, less the errors."""
        if len(near) > 4 * top:
            least = max(least, float(np.partition(near, -top)[-top]) - error - SLACK)
        return least - error

    @staticmethod
    def merged(best: list[tuple[float, int]], found: np.ndarray, row: np.ndarray, top: int) -> list[tuple[float, int]]:
        if len(found) > top:
            floor = np.partition(row, -top)[-top]
            # of the rows that tie at the k-th score, the first come first; better ones all stay
            pick = np.concatenate([np.flatnonzero(row > floor), np.flatnonzero(row == floor)[:top]])
            found, row = found[pick], row[pick]
        return sorted(best + list(zip(row.tolist(), found.tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:top]

    @staticmethod
    def before_pivot(q_of: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a frequent (query, term) of bound `high` stands before its query's pivot: from the lowest bound up, as long
        as their sum is under the threshold."""
        order = np.lexsort((high, q_of))
        total = np.append(0, np.cumsum(high[order]))
        start = np.searchsorted(q_of[order], q_of[order])
        before = np.zeros(len(q_of), bool)
        before[order] = (total[1:] - total[start]) * OVER + 1e-6 < least[q_of[order]]
        return before

    def room(self, which: int, n: int, per: int) -> np.ndarray:
        """The same memory each time: fresh pages cost more than what is written to them."""
        if self.held[which].size < n * per:
            self.held[which] = np.empty(n * per, np.float32)
        return self.held[which][: n * per].reshape(n, per)

    def frequent(self, a: int, blocks: int) -> tuple[np.ndarray, ...]:
        """Of a stretch: the terms in a share FREQUENT of its rows, their weights in 64 and in 32 bits; the terms with a row
        a block, and their greatest weight in each block."""
        if a not in self.often:
            every = np.arange(len(self.starts) - 1)
            lo, hi = self.runs(every, a), self.runs(every, a + blocks)
            size = self.run_start[hi] - self.run_start[lo]
            kinds, usual = np.flatnonzero(size >= FREQUENT * blocks * BLOCK), np.flatnonzero(size >= blocks)
            dense, most = self.dense(kinds, a, blocks), np.zeros((len(usual), blocks))
            which, run = expanded(lo[usual], (hi - lo)[usual])
            most[which, self.run_block[run] - a] = self.run_max[run]
            self.often[a] = kinds, dense, dense.astype(np.float32), usual, most
        return self.often[a]

    def runs(self, term: np.ndarray, block: int) -> np.ndarray:
        """The first run of each term at or after a block."""
        if block not in self.cuts:
            owner = np.repeat(np.arange(len(self.run_of) - 1), np.diff(self.run_of))
            step = self.blocks + 1
            self.cuts[block] = np.searchsorted(owner * step + self.run_block, np.arange(len(self.run_of) - 1) * step + min(block, self.blocks))
        return self.cuts[block][term]

    def dense(self, terms: np.ndarray, a: int, blocks: int) -> np.ndarray:
        """Weights of terms (rows) in a stretch of rows (columns); only for terms in a share FREQUENT of them."""
        first = self.run_start[self.runs(terms, a)]
        which, at = expanded(first, self.run_start[self.runs(terms, a + blocks)] - first)
        out = np.zeros((len(terms), blocks * BLOCK))
        out[which, self.rows[at] - a * BLOCK] = self.weight[at]
        return out


def search(rows: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(conv_id, turn, rank, hit_conv_id, hit_turn, score): the best `top` of `rows` for each row of `queries`."""
    spark = rows.sparkSession
    ids = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    text = F.col("text").cast("binary").alias("text")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(words).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    total, mean = stats["n"], (stats["words"] or 0) / max(1, stats["n"])
    shards = max(1, -(-total // SHARD), -(-(stats["bytes"] or 0) // SHARD_BYTES))
    parts = max(1, -(-queries.count() // TASK_QUERIES))
    distinct = rows.select(*ids, text).groupBy("conv_id", "turn", "text").agg(F.count(F.lit(1)).alias("copies"))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(shards)).cast("long"))
    postings = written(spark, shard_postings(dealt), "postings")
    df = postings.groupBy("term").agg(F.sum("n").alias("df"))
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    no = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    index = postings.join(df, "term").select("shard", "term", "df", "docs", "tf", *no("long", "conv_id", "turn"), *no("binary", "text"), every(parts, "part"))
    asks = queries.select(*ids, text).where(F.col("conv_id").isNotNull()).distinct()
    asks = asks.withColumn("part", F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(parts)))
    asks = asks.select(every(shards, "shard"), *no("binary", "term"), *no("long", "df"), *no("binary", "docs", "tf"), "conv_id", "turn", "text", "part")
    both = index.unionByName(asks).repartitionById(shards * parts, (F.col("shard") * parts + F.col("part")).cast("int"))
    # an index comes before its queries, in any order of its terms
    stream = both.sortWithinPartitions("shard", "part", F.col("term").isNull(), "conv_id", "turn")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        postings: list[tuple] = []
        own: ShardIndex | None = None
        held: list[tuple] = []

        def hits() -> pa.RecordBatch:
            found = own.search([Counter((t or b"").lower().split()) for *_, t in held], top)
            asks = [(c, n, xxhash.xxh3_64_intdigest(t or b"") >> 1) for c, n, t in held]
            held.clear()
            which = pa.array(np.repeat(np.arange(len(asks)), [len(some) for some in found]))
            row, score = pa.array([d for some in found for _, d in some], pa.int64()), pa.array([s for some in found for s, _ in some], pa.float64())
            cols = [pa.array(x, pa.int64()).take(which) for x in zip(*asks, strict=True)] + [x.take(row) for x in (own.conv, own.turn, own.copies)]
            return pa.RecordBatch.from_arrays([*cols, score], ["conv_id", "turn", "asked", "hit_conv_id", "hit_turn", "copies", "score"])

        import xxhash

        for batch in batches:
            keys = list(zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), strict=True))
            index, asked = (list(zip(*(batch.column(c).to_pylist() for c in names), strict=True)) for names in (("term", "df", "docs", "tf"), ("conv_id", "turn", "text")))
            for key, posting, (conv, turn, text) in zip(keys, index, asked, strict=True):
                if key != now:
                    if held:
                        yield hits()
                    now, postings, own = key, [], None
                if posting[0] is not None:
                    postings.append(posting)
                    continue
                if own is None:
                    if not postings:
                        continue
                    own, postings = ShardIndex(postings, total, mean), []
                held.append((conv, turn, text))
                if len(held) == QUERIES:
                    yield hits()
        if held:
            yield hits()

    found = stream.mapInArrow(answer, "conv_id long, turn long, asked long, hit_conv_id long, hit_turn long, copies long, score double")
    best = W.partitionBy("conv_id", "turn", "asked").orderBy(F.desc("score"), F.col("hit_conv_id").asc_nulls_last(), F.col("hit_turn").asc_nulls_last())
    first = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    # repeated rows are all found
    copies = first.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(top)))))
    ranked = copies.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("conv_id", "turn", "rank", "hit_conv_id", "hit_turn", "score")


def op4_search(turns: DataFrame) -> DataFrame:
    """Every turn of the conversations whose id is divisible by 20, against all turns."""
    return search(turns, turns.where(F.col("conv_id") % EVERY == 0))


OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM conversations),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
t AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
p AS (SELECT t.r, t.w, t.tf, ln(1 + (n.n - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(d.w) / n.mean)) AS weight
      FROM t JOIN f USING (w) JOIN d USING (r), n),
a AS (SELECT min(r) AS r FROM d WHERE conv_id % 20 = 0 GROUP BY conv_id, turn, t),
s AS (SELECT q.r AS q, p.r AS d, round(sum(q.tf * p.weight), 6) AS score FROM a JOIN t q USING (r) JOIN p ON p.w = q.w GROUP BY ALL),
k AS (SELECT x.conv_id, x.turn, y.conv_id AS hit_conv_id, y.turn AS hit_turn, score,
        row_number() OVER (PARTITION BY s.q ORDER BY score DESC, y.conv_id NULLS LAST, y.turn NULLS LAST) AS rank
      FROM s JOIN d x ON x.r = s.q JOIN d y ON y.r = s.d)
SELECT conv_id, turn, CAST(rank AS INT) AS rank, hit_conv_id, hit_turn, score FROM k WHERE rank <= 10
"""
