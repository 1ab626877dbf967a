"""Phrase collocation mining: phrases of 2 to `most` words that stand together more often than their parts explain.

1. Words: pieces of text between marks of punctuation are cut into words, and words are counted by language.
2. N-grams become rows (language, phrase, count so far) and meet in a hash aggregation by language and phrase. An n-gram of
   which a part is rarer than `least` can't be a candidate, nor can one that holds it: so n-grams whose parts are rarer
   make no row. What is frequent is told by a bitmap of `marks` bits, made from the hashes of the frequent parts: its size
   is fixed, a bit too many costs a row, and no bit is missing. Counts are those of whole phrases, never of hashes.
   Pairs of words, nearly all of them rare, are first counted by a 64-bit hash, which only says which pairs become rows.
3. Each candidate is cut after each of its words and joined with the counts of both sides; the score is a whole number
   from Decimal arithmetic, the lowest cut counts.
4. Candidates inside a longer one that is nearly as frequent go, by an anti-join with the one-word extensions: what holds
   a phrase with two more words is at most as frequent as the extension by one of them.
5. The first `top` a language: hashed parts of a language are ranked first, then their first rows together.

Languages and frequent words are hot keys only before the aggregations, whose partial sums are made where texts are read.

Cases: null text counts as empty; a null language is `und`, together with rows that say so; repeated rows count each; ties
of a score go by count and then by the phrase's bytes; words are bytes, so invalid UTF-8 stays as it is; very long texts
are read in stretches, whole; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, written
from .dedup import LETTER, PLACE, mixed, powers
from .langid import emit_counts

LEAST, MOST_WORDS, TOP, INSIDE = 30, 4, 2000, (80, 100)
SCALE, MARKS, PARTS, STRETCH, JOINED = 2_000_000, 1 << 26, 32, 1 << 18, 1 << 22
#: Bytes that end a piece, and bytes between words.
ENDS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
BETWEEN = ENDS | np.isin(np.arange(256), list(b" \t"))
AS_BLANKS = bytes(32 if x else i for i, x in enumerate(BETWEEN))


def salt(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def stretches(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, stop, hash, piece, new) of the words of a lower-case text, about STRETCH bytes at a time; each array begins
    with the last words of the one before it, and words from `new` on weren't seen yet."""
    b, a, pieces, held = np.frombuffer(text, np.uint8), 0, 0, None
    while a < len(b):
        end = min(len(b), a + STRETCH)
        while end < len(b) and not BETWEEN[b[end]]:
            cut = np.flatnonzero(BETWEEN[b[end : end + STRETCH]])
            end += int(cut[0]) if len(cut) else min(STRETCH, len(b) - end)
        part = b[a:end]
        edge = np.flatnonzero(np.diff(BETWEEN[part], prepend=True, append=True))
        start, stop = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            up, down = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(LETTER[part] * up[: len(part)], out=sums[1:])
            h = mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * PLACE[0])
        ends = np.cumsum(ENDS[part])
        piece = pieces + ends[start]
        pieces += int(ends[-1])
        new = [start + a, stop + a, h, piece]
        n = 0 if held is None else len(held[0])
        now = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        held, a = [x[len(x) - min(len(x), MOST_WORDS - 1) :] for x in now], end
        yield (*now, n)


def gram_hash(h: np.ndarray, n: int, of: np.uint64) -> np.ndarray:
    """Hashes of all runs of `n` words."""
    size = max(0, len(h) - n + 1)
    with np.errstate(over="ignore"):
        total = np.full(size, of + np.uint64(n), np.uint64)
        for j in range(n):
            total += h[j : j + size] * PLACE[j]
    return mixed(total)


def has(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    place = h >> np.uint64(65 - (len(marks) * 64).bit_length())
    return (marks[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequent_runs(h: np.ndarray, piece: np.ndarray, n: int, part: int, marks: np.ndarray, of: np.uint64, new: int) -> np.ndarray:
    """First words of the runs of `n` words inside a piece that end at a word not seen before and whose parts of `part` words
    are all marked."""
    size = max(0, len(h) - n + 1)
    good = has(marks, gram_hash(h, part, of))
    fits = (piece[:size] == piece[n - 1 :]) & (np.arange(size) + n > new)
    for j in range(n - part + 1):
        fits &= good[j : j + size]
    return np.flatnonzero(fits)


def joined_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts in lower case with an end of piece between them), JOINED bytes or one text at a time."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, texts in slices(batch, 1, 256):
            for lang, text in zip(langs[a : a + 256], texts, strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    size[lang] += len(text)
                    if size[lang] > JOINED:
                        yield lang, b"\n".join(held.pop(lang)).lower()
                        size[lang] = 0
    for lang, texts in held.items():
        yield lang, b"\n".join(texts).lower()


def strings(text: bytes, start: np.ndarray, stop: np.ndarray, at: np.ndarray, n: int) -> list[bytes]:
    """The runs of `n` words from `at`, joined by blanks."""
    if not len(at):
        return []
    b = np.frombuffer(text, np.uint8)
    plain = np.ones(len(at), bool)
    for j in range(n - 1):
        plain &= (start[at + j + 1] - stop[at + j] == 1) & (b[stop[at + j]] == 32)
    spans = lambda some: zip(start[some].tolist(), stop[some + n - 1].tolist(), strict=True)
    return [text[x:y] for x, y in spans(at[plain])] + [b" ".join(text[x:y].split()) for x, y in spans(at[~plain])]


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "word").agg(F.sum("n").alias("n")).select(F.col("part").alias("lang"), F.col("word").alias("phrase"), F.col("n").alias("f"))


def word_rows(docs: DataFrame) -> DataFrame:
    """(part, word, n): counts of words so far, by language."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for lang, text in joined_texts(batches):
            # the bytes that end a piece become blanks: `split` takes all blanks there are
            text, a = text.translate(AS_BLANKS), 0
            while a < len(text):
                cut = text.find(b" ", a + JOINED)
                end = cut if cut >= 0 else len(text)
                found.setdefault(lang, Counter()).update(text[a:end].split())
                a = end
                yield from emit_counts(found, 300_000)
        yield from emit_counts(found, 0)

    return texts_of(docs).mapInArrow(make, "part string, word binary, n long")


def pair_hashes(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """(h): hashes of the pairs of marked words, one row a pair."""
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in joined_texts(batches):
            of = salt(lang)
            for _, _, h, piece, new in stretches(text):
                at = frequent_runs(h, piece, 2, 1, sent.value, of, new)
                yield pa.RecordBatch.from_arrays([pa.array(gram_hash(h, 2, of)[at].view(np.int64))], ["h"])

    return texts_of(docs).mapInArrow(make, "h long")


def gram_rows(docs: DataFrame, marks: np.ndarray, part: int, sizes: tuple[int, ...]) -> DataFrame:
    """(part, word, n): counts so far of the n-grams of the given sizes whose parts of `part` words are all marked."""
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for lang, text in joined_texts(batches):
            of, own = salt(lang), found.setdefault(lang, Counter())
            for start, stop, h, piece, new in stretches(text):
                for n in sizes:
                    own.update(strings(text, start, stop, frequent_runs(h, piece, n, part, sent.value, of, new), n))
            yield from emit_counts(found, 300_000)
        yield from emit_counts(found, 0)

    return texts_of(docs).mapInArrow(make, "part string, word binary, n long")


def phrase_hashes(phrases: DataFrame) -> DataFrame:
    """(h) of each (lang, phrase)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.concatenate([x[2][x[4] :] for x in stretches(phrase)])
                out.append(gram_hash(h, len(h), salt(lang))[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(make, "h long")


def marked(hashes: DataFrame, marks: int = MARKS) -> np.ndarray:
    """A bitmap of `marks` bits with those of `hashes` (h) set; it comes to the driver, and its size is fixed."""
    place = F.shiftrightunsigned("h", 65 - marks.bit_length())
    words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    got, out = words.toArrow(), np.zeros(marks // 64, np.uint64)
    out[got["w"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def counts_of(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, marks: int = MARKS) -> tuple[DataFrame, DataFrame]:
    """((lang, n): words a language; (lang, phrase, f, size): phrases of 1 to `most` words that occur `least` times)."""
    spark = docs.sparkSession
    words = written(spark, counted(word_rows(docs)), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = words.where(F.col("f") >= least).withColumn("size", F.lit(1))
    bits = marked(phrase_hashes(found), marks)
    pairs = pair_hashes(docs, bits).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bits = marked(pairs, marks)
    for part, sizes in ((2, (2, 3)), *((n - 1, (n,)) for n in range(4, most + 1))):
        sizes = tuple(n for n in sizes if n <= most)
        blanks = F.length("phrase") - F.length(F.translate(F.decode("phrase", "ISO-8859-1"), " ", ""))
        rows = counted(gram_rows(docs, bits, part, sizes)).where(F.col("f") >= least).withColumn("size", (blanks + 1).cast("int"))
        rows = written(spark, rows, "phrases")
        found = found.unionAll(rows)
        bits = marked(phrase_hashes(rows.where(F.col("size") == max(sizes))), marks)
    return totals, found


def cuts_of(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, size, k, first, rest): each phrase cut after each of its words but the last."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ks, firsts, rests = [], [], [], []
            for i, phrase in enumerate(batch.column(1).to_pylist()):
                words = phrase.split(b" ")
                for k in range(1, len(words)):
                    at.append(i)
                    ks.append(k)
                    firsts.append(b" ".join(words[:k]))
                    rests.append(b" ".join(words[k:]))
            same = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*same.columns, pa.array(ks, pa.int32()), pa.array(firsts, pa.binary()), pa.array(rests, pa.binary())], ["lang", "phrase", "a", "size", "k", "first", "rest"])

    return phrases.select("lang", "phrase", F.col("f").alias("a"), "size").mapInArrow(make, "lang string, phrase binary, a long, size int, k int, first binary, rest binary")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, top: int = TOP, marks: int = MARKS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language."""
    totals, found = counts_of(docs, least, most, marks)
    found = written(docs.sparkSession, found, "frequent")
    cuts = written(docs.sparkSession, cuts_of(found.where("size > 1")), "cuts")
    known = found.select("lang", "phrase", "f")
    both = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase's one-word extensions are the longer phrases that lose it at either end
    longer = cuts.where("k = size - 1").select("lang", F.col("first").alias("phrase"), "a").unionAll(cuts.where("k = 1").select("lang", F.col("rest").alias("phrase"), "a"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("e"))
    inside = found.where("size > 1").join(longer, ["lang", "phrase"]).where(F.col("e").cast("decimal(20, 0)") * INSIDE[1] >= F.col("f").cast("decimal(20, 0)") * INSIDE[0])
    stays = lowest.join(inside.select("lang", "phrase"), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    stays = stays.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = stays.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def op12_phrases(docs: DataFrame) -> DataFrame:
    return collocations(docs)


OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS g FROM w),
f AS (SELECT lang, g, string_split(g, ' ') AS w, count(*) AS f FROM g GROUP BY lang, g),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(w) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(w) > 1 AND f >= 30),
x AS (SELECT lang, g, w, f AS a, unnest(range(1, len(w))) AS k FROM c),
y AS (SELECT x.lang, x.g, x.a, x.k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * x.a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.g = array_to_string(x.w[1:x.k], ' ') JOIN f r ON r.lang = x.lang AND r.g = array_to_string(x.w[x.k + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
s AS (SELECT DISTINCT x.lang, array_to_string(x.w[i.i:i.i + j.j - 1], ' ') AS g, x.f AS a
  FROM c x, range(1, 5) i(i), range(2, 4) j(j) WHERE i.i + j.j - 1 <= len(x.w) AND j.j < len(x.w)),
e AS (SELECT lang, g, max(a) AS e FROM s GROUP BY lang, g),
k AS (SELECT z.* FROM z LEFT JOIN e ON e.lang = z.lang AND e.g = z.g WHERE NOT coalesce(100 * e.e >= 80 * z.a, false))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM k JOIN t ON t.lang = k.lang QUALIFY rank <= 2000
"""
