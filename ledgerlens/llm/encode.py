"""Encoding and decoding with a public piece vocabulary by a max-plus scan.

A text, after one space, is cut into pieces so that the sum of their scores is greatest. Pieces never go past a
space or a line end into what follows, so most of the work is the best cutting of short strings, found for many
distinct ones at once. Documents over `chunk` bytes are split into chunks that need not end at such a place. Every
chunk yields a transfer matrix: entry (a, b) is the greatest score of any cutting that starts `a` bytes into the chunk
(these belong to a piece from before) and ends `b` bytes into the next one. The product of such matrices in (max, +)
is associative, so they are combined in a tree, 16 at a time; going down the tree again gives each chunk the states
at its ends, and each chunk is then traced back on its own.

Scores are whole numbers, and of cuttings that tie the one with the longest last piece is taken, then the longest piece
before it, and so on. A matrix therefore comes with the order of its cuttings by that rule (for one end state, over the
start states), which products carry along. So the ids don't depend on where, or whether, a text is chunked.

Bytes without a piece become byte pieces; a literal word mark does so too. Decoding gives the very text back.

Cases: null text has null ids; empty text has no ids; equal texts have equal ids, so repeated giant texts are encoded
once; extra columns pass through, whatever their names (a column `ids` is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE_MODEL, in_arrow, slices, whole_row, written
from .lattice import NONE, Cache, Recent, Vocabulary, best_segmentations, vocabulary

CHUNK, FAN, SHORT, TOGETHER, KEPT = 32_768, 16, 2048, 32, 400_000
SEGMENT = re.compile(rb"\n| *[^ \n]+| +")
CUT = re.compile(rb"(?<=[^ ])(?= )|(?=\n)|(?<=\n)")


def encode_batch(texts: list[bytes | None], known: Cache) -> list[bytes | None]:
    """Ids of each text as little-endian 32-bit bytes."""
    split = [None if t is None else SEGMENT.findall(b" " + t) if t else [] for t in texts]
    of = known.add(set().union(*filter(None, split)))
    return [None if x is None else b"".join(map(of.__getitem__, x)) for x in split]


@functools.lru_cache(1)
def best_of(path: str) -> Recent:
    """The best cuttings of strings that this worker has met, also in its earlier tasks."""
    v = vocabulary(path)
    return Recent(lambda words: best_segmentations(v, words), KEPT)


def edges(v: Vocabulary, data: bytes) -> list[list[tuple[int, int, int]]]:
    """For each end position: (start, id, score) of the pieces that end there, longest first."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(data) + 1)]
    if len(data) < SHORT:
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - v.longest), end):
                piece = v.ids.get(data[start:end])
                if piece is not None:
                    out[end].append((start, piece, int(v.points[piece])))
    else:
        spans = v.spans(np.frombuffer(data, np.uint8)[None, :])
        for k in range(len(spans), 0, -1):
            row = spans[k - 1][0]
            for start in np.flatnonzero(row < v.n).tolist():
                out[start + k].append((start, int(row[start]), int(v.points[row[start]])))
    return out


def cuts(data: bytes, longest: int) -> tuple[int, int] | None:
    """The first place (not before any state of the chunk's start) and the last one that no piece crosses."""
    found = [m.start() for m in CUT.finditer(data)]
    found = [c for c in found if longest <= c < len(data)]
    return (found[0], found[-1]) if found else None


def best_path(v: Vocabulary, data: bytes, size: int) -> list[int]:
    """Ids of the best cutting of `data` whose last piece starts before `size`."""
    into, end = edges(v, data), len(data)
    best, back = [NONE] * (end + 1), [(0, 0)] * (end + 1)
    best[0] = 0
    for p in [*range(1, min(size, end) + 1), *([end] if end > size else [])]:
        for start, piece, score in into[p]:
            if start < size and best[start] + score > best[p]:
                best[p], back[p] = best[start] + score, (start, piece)
    ids, p = [], end
    while p > 0:
        p, piece = back[p]
        ids.append(piece)
    return ids[::-1]


def parted(data: bytes, longest: int) -> tuple[tuple[int, int] | None, list[bytes]]:
    """The outer cuts of a chunk and the strings between them."""
    place = cuts(data, longest)
    return place, SEGMENT.findall(data[place[0] : place[1]]) if place else []


def ranks(key: np.ndarray) -> np.ndarray:
    """Places of the keys in their order, by column."""
    return key.argsort(0, kind="stable").argsort(0, kind="stable")


def reach(v: Vocabulary, data: bytes, size: int, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest scores from each start state to each position, by pieces that start before `size`, and the order of their
    cuttings by the rule for ties (the longest last piece first)."""
    into, end = edges(v, data), len(data)
    score, order = np.full((end + 1, states), NONE), np.zeros((end + 1, states), np.int64)
    for p in range(end + 1):
        last, before = np.zeros(states, np.int64), np.zeros(states, np.int64)
        for start, _, points in into[p]:
            if start < size:
                made = score[start] + points
                better = made > score[p]
                if better.any():
                    score[p][better], last[better], before[better] = made[better], p - start, order[start][better]
        if p < min(states, size + 1):
            # the piece from before that ends here is longer than any that starts in the chunk
            score[p, p], last[p] = 0, v.longest + 1
        if states > 1:
            order[p] = ranks(last * states + before)
    return np.maximum(score, NONE), order


def transfer(v: Vocabulary, data: bytes, ahead: bytes, place: tuple[int, int] | None, middle: int) -> np.ndarray:
    """Greatest scores from each start state to each end state of a chunk followed by the bytes `ahead`, and the order of
    the start states: an array of shape (2, k, k).

    Between its outer cuts (`place`, with the score `middle`) a chunk has one state; without cuts all are carried.
    """
    k, size = v.longest, len(data)
    first, last, states = (*place, 1) if place else (0, 0, k)
    # from `last` (or the start) to the end, and beyond it by each end state
    score, order = reach(v, data[last:] + ahead[: k - 1], size - last, states)
    out = np.full((2, k, k), NONE)
    out[1] = 0
    ends = score[size - last :].T
    out[0, :states, : ends.shape[1]], out[1, :states, : ends.shape[1]] = ends, order[size - last :].T
    if place is None:
        return out
    head, order = reach(v, data[:first], first, k)
    out[0] = np.maximum(head[first][:, None] + middle + out[0, 0][None, :], NONE)
    out[1] = order[first][:, None]
    return out


def best_before(score: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states (first axis) of greatest score, by column; of those that tie, the first by the rule for ties."""
    return np.where(score == score.max(0), order, -1).argmax(0)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The transfer of two chunks in a row."""
    k = len(a[0])
    total = np.maximum(a[0].T[:, :, None] + b[0][:, None, :], NONE)  # by state between, start and end
    via = best_before(total, np.broadcast_to(b[1][:, None, :], total.shape))
    start, end = np.arange(k)[:, None], np.arange(k)[None, :]
    return np.stack([total.max(0), ranks(b[1][via, end] * k + a[1][start, via])])


def chunked(data: bytes, chunk: int, longest: int) -> list[tuple[bytes, bytes]]:
    """(chunk, the bytes after it that a piece may reach); the last chunk isn't shorter than a piece can be."""
    starts = list(range(0, len(data), chunk))
    if len(starts) > 1 and len(data) - starts[-1] < 2 * longest:
        starts.pop()
    ends = [*starts[1:], len(data)]
    return [(data[a:b], data[b : b + longest - 1]) for a, b in zip(starts, ends, strict=True)]


def encode_giant(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """(t_key, ids) for distinct (t_key, text) rows, by chunks."""
    import pandas as pd

    spark = texts.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = vocabulary(path).longest
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = chunked(b" " + text, chunk, longest)
                for a in range(0, len(parts), 256):
                    some = parts[a : a + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array(range(a, a + len(some)), pa.int64()), pa.array([x for x, _ in some], pa.binary()), pa.array([y for _, y in some], pa.binary())], ["t_key", "idx", "data", "ahead"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        score_of = Cache(lambda words: [int(v.points[np.frombuffer(x, "<i4")].sum()) for x in best_segmentations(v, words)])
        for batch in batches:
            out, ahead = [], batch.column(3).to_pylist()
            for a, data in slices(batch, 2, TOGETHER):
                parts = [parted(d, v.longest) for d in data]
                of = score_of.add(w for _, middle in parts for w in middle)
                out += [transfer(v, d, x, place, sum(of[w] for w in middle)).tobytes() for d, x, (place, middle) in zip(data, ahead[a:], parts, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["t_key", "idx", "m"])

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        k = vocabulary(path).longest
        group = group.sort_values("idx")
        m = None
        for x in group["m"]:
            x = np.frombuffer(x, np.int64).reshape(2, k, k)
            m = x if m is None else product(m, x)
        return pd.DataFrame({"t_key": [group["t_key"].iloc[0]], "idx": [int(group["idx"].iloc[0]) // FAN], "m": [m.tobytes()]})

    def descend(group: pd.DataFrame) -> pd.DataFrame:
        """From a group's states to those of its members: best scores forward, then back from the end."""
        k = vocabulary(path).longest
        group = group.sort_values("idx").reset_index(drop=True)
        mats = [np.frombuffer(x, np.int64).reshape(2, k, k) for x in group["m"]]
        best = [np.full(k, NONE)]
        best[0][int(group["g_in"].iloc[0])] = 0
        for m in mats:
            best.append(np.maximum((best[-1][:, None] + m[0]).max(0), NONE))
        state, out = int(group["g_out"].iloc[0]), []
        for i in range(len(mats) - 1, -1, -1):
            before = int(best_before((best[i] + mats[i][0][:, state])[:, None], mats[i][1][:, state, None])[0])
            out.append((before, state))
            state = before
        group["s_in"], group["s_out"] = zip(*out[::-1], strict=True)
        return group[["t_key", "idx", "s_in", "s_out"]]

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        known = Cache(lambda words: best_segmentations(v, words))
        for batch in batches:
            out, (ahead, s_in, s_out) = [], (batch.column(x).to_pylist() for x in ("ahead", "s_in", "s_out"))
            for a, some in slices(batch, batch.schema.get_field_index("data"), TOGETHER):
                parts = [parted(d, v.longest) for d in some]
                of = known.add(w for _, middle in parts for w in middle)
                for i, (data, (place, middle)) in enumerate(zip(some, parts, strict=True), a):
                    if place is None:
                        out.append(best_path(v, data[s_in[i] :] + ahead[i][: s_out[i]], len(data) - s_in[i]))
                        continue
                    ids = np.frombuffer(b"".join([of[w] for w in middle]), "<i4").tolist()
                    first, last = place
                    out.append(best_path(v, data[s_in[i] : first], first - s_in[i]) + ids + best_path(v, data[last:] + ahead[i][: s_out[i]], len(data) - last))
            yield pa.RecordBatch.from_arrays([batch.column("t_key"), batch.column("idx"), pa.array(out, pa.list_(pa.int32()))], ["t_key", "idx", "ids"])

    chunks = written(spark, texts.select("t_key", F.col("text").cast("binary").alias("text")).mapInArrow(cut, "t_key string, idx long, data binary, ahead binary"), "chunks")
    levels = [written(spark, chunks.mapInArrow(matrices, "t_key string, idx long, m binary"), "matrices-0")]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("t_key", F.floor(F.col("idx") / FAN).alias("g")).applyInPandas(lambda _, x: combine(x), "t_key string, idx long, m binary")
        levels.append(written(spark, up, f"matrices-{len(levels)}"))
    states = levels[-1].select("t_key", "idx", F.lit(0).cast("long").alias("s_in"), F.lit(0).cast("long").alias("s_out"))
    for level in reversed(levels[:-1]):
        above = states.select("t_key", F.col("idx").alias("g"), F.col("s_in").alias("g_in"), F.col("s_out").alias("g_out"))
        members = level.withColumn("g", F.floor(F.col("idx") / FAN)).join(above, ["t_key", "g"])
        states = members.groupBy("t_key", "g").applyInPandas(lambda _, x: descend(x), "t_key string, idx long, s_in long, s_out long")
    traced = chunks.join(states, ["t_key", "idx"]).mapInArrow(trace, "t_key string, idx long, ids array<int>")
    whole = traced.groupBy("t_key").agg(F.array_sort(F.collect_list(F.struct("idx", "ids"))).alias("parts"))
    return whole.select("t_key", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str = PIECE_MODEL, chunk: int = CHUNK) -> DataFrame:
    """Adds `ids` (array<int>) to each row of `docs`."""
    docs = docs.drop("ids")
    giant = F.coalesce(F.octet_length("text") > chunk, F.lit(False))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = best_of(path)
        for batch in batches:
            out = []
            for _, texts in slices(batch, at, 256):
                out += encode_batch(texts, known)
            ends = np.cumsum([0, *(len(x) // 4 if x else 0 for x in out)])
            flat = pa.array(np.frombuffer(b"".join([x for x in out if x]), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([x is None for x in out]))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names)

    at, names = docs.columns.index("text"), [*docs.columns, "ids"]
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    few = in_arrow(docs.where(~giant), small, schema)
    keyed = docs.where(giant).select(F.sha2("text", 256).alias("t_key"), whole_row(docs).alias("row"))
    texts = keyed.groupBy("t_key").agg(F.first("row.text").alias("text"))
    many = keyed.join(encode_giant(texts, path, chunk), "t_key").select("row.*", "ids")
    return few.unionAll(many)


@functools.lru_cache(1)
def piece_bytes(path: str) -> pa.Array:
    return pa.array(vocabulary(path).pieces, pa.large_binary())


def texts_of(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The text of each list of ids, without the space before it: all pieces are taken at once, one behind the other."""
    taken = pieces.take(ids.flatten())
    at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    ends = at[np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())])]
    data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    some = np.diff(ends) > 0
    data = np.delete(data, ends[:-1][some] - ends[0])
    ends = np.append(0, np.cumsum(np.diff(ends) - some))
    out = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    if ids.null_count:
        out = pc.if_else(ids.is_null(), pa.scalar(None, pa.large_binary()), out)
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())


def decode(encoded: DataFrame, path: str = PIECE_MODEL, into: str = "text") -> DataFrame:
    """Adds or replaces the column `into` with the text of `ids`; null ids give null."""
    encoded = encoded.drop(into)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_bytes(path)
        for batch in batches:
            out = [texts_of(batch.column(at).slice(a, 256), pieces) for a in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(out) if out else pa.array([], pa.string())], names)

    at, names = encoded.columns.index("ids"), [*encoded.columns, into]
    return in_arrow(encoded, texts, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))


def op6_encode(docs: DataFrame, path: str = PIECE_MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_hash and whether decoding gives the text back, for each row."""
    both = decode(encode(docs.select("doc_id", "text"), path), path, into="decoded")
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
