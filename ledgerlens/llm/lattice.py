"""Piece lattices over a fixed public vocabulary, vectorised over batches of byte strings of one length.

The vocabulary file gives ranks, not probabilities: Zipf's law turns them into weights (`1 / (rank + 10)`, normalised).
A space stands for the vocabulary's word mark. Each byte is a piece of its own too, so every byte string has at least
one segmentation. All functions take byte strings; a batch is grouped by length, then a few array operations look up
all its substrings and one recursion runs over positions for all of them at once. Strings of over LONG bytes go through
the same recursions in log space, a stretch of STEP positions at a time, so their look-ups take bounded memory.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

import numpy as np

BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SLOTS, GAIN, LONG, BATCH, STEP, ROOM = 18, 12.0, 48, 4096, 16_384, 1 << 19
#: Scores of encodings are whole numbers of this part of a natural log unit; NONE is lower than any text's score.
POINT, NONE = 1 << 20, -(1 << 57)


class Vocabulary:
    """pieces: bytes by id; score: log weight by id; the last row of any table by id stands for 'no such piece'."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.n, self.pieces, rank = n, [b""] * n, np.full(n, 1e18)
        self.byte_ids = np.full(256, -1)
        for i in range(n):
            if model.is_byte(i):
                code = int(model.id_to_piece(i)[3:5], 16)
                self.pieces[i], self.byte_ids[code] = bytes([code]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[i], rank[i] = model.id_to_piece(i).replace("▁", " ").encode(), min(-model.get_score(i), n)
        weight = 1 / (rank + 10)
        least = weight[weight > 1e-9].min() * np.exp(-10)
        weight[self.byte_ids] = least
        self.score = np.append(np.where(weight >= least, np.log(weight / weight[weight >= least].sum()), -np.inf), -np.inf)
        # whole numbers add up to the same sum in any order, so ties are ties wherever a text is cut
        self.points = np.rint(np.where(np.isfinite(self.score), self.score, 0) * POINT).astype(np.int64)
        self.reached = np.append(self.points[:-1], NONE)
        # a byte that is also a piece as a character keeps that piece alone; its byte piece stays for decoding
        self.ids: dict[bytes, int] = {}
        for i, piece in enumerate(self.pieces):
            if piece and (piece not in self.ids or rank[i] < 1e18):
                self.ids[piece] = i
        self.sizes = np.array([*map(len, self.pieces), 0])
        self.longest = int(self.sizes.max())
        self.used = np.zeros(n + 1, bool)
        self.used[list(self.ids.values())] = True
        self.newline_cuts = not any(b"\n" in p and len(p) > 1 for p in self.pieces)
        self.powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                self.powers[k + 1] = self.powers[k] * BASE
        keys = np.array([self._hash(p) for p in self.ids], np.uint64)
        own = np.array(list(self.ids.values()), np.int32)
        self.key = np.zeros(n + 1, np.uint64)
        self.key[own] = keys
        # ids by the top bits of a hash; slots that several pieces share are marked, and their other pieces are in further
        # tables with other multipliers
        self.tables = []
        left, salt = np.arange(len(own)), MIX
        while len(left):
            with np.errstate(over="ignore"):
                slot = (keys[left] * salt) >> np.uint64(64 - SLOTS)
            table, shared = np.full(1 << SLOTS, n, np.int32), np.zeros(1 << SLOTS, bool)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = own[left[first]]
            left, slot = np.delete(left, first), np.delete(slot, first)
            shared[slot] = True
            self.tables.append((salt, table, shared))
            self.filled = self.tables[0][1] < n
            salt = np.uint64(int(salt) * int(BASE) % 2**64 | 1)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(BASE) + b + 1) % 2**64
        return h

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of substrings by their hash; n where there is none."""
        out = np.full(hashes.size, self.n, np.int32)
        rest, todo = hashes.ravel(), None
        for salt, table, shared in self.tables:
            slot = (rest * salt) >> np.uint64(64 - SLOTS)
            if todo is None:  # most substrings meet an empty slot
                todo = np.flatnonzero(self.filled[slot])
                slot, rest = slot[todo], rest[todo]
            found = table[slot]
            own = self.key[found] == rest
            out[todo[own]] = found[own]
            again = np.flatnonzero(shared[slot] & ~own)
            if not len(again):
                break
            todo, rest = todo[again], rest[again]
        return out.reshape(hashes.shape)

    def spans(self, codes: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, ...: ids of the substrings of k bytes by row and start."""
        rows, size = codes.shape
        prefix = np.zeros((rows, size + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                prefix[:, i + 1] = prefix[:, i] * BASE + (codes[:, i].astype(np.uint64) + np.uint64(1))
            return [self.lookup(prefix[:, k:] - prefix[:, :-k] * self.powers[k]) for k in range(1, min(size, self.longest) + 1)]


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def batches(words: list[bytes]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(positions in `words`, their bytes as a matrix) in groups of one length and at most BATCH rows, empty ones left out."""
    return alike(words, np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable"))


def alike(words: list[bytes], order: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    edges = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, edges):
        size = sizes[group[0]] if len(group) else 0
        step = max(1, min(BATCH, (1 << 20) // max(1, size * min(size, 24))))
        for a in range(0, len(group) if size else 0, step):
            part = group[a : a + step]
            yield part, np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), size)


def short_and_long(words: list[bytes]) -> tuple[Iterable, Iterable]:
    """Batches of the words of up to LONG bytes; of the others (positions, bytes padded to one length, lengths)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    return alike(words, order[sizes[order] <= LONG]), padded(words, order[sizes[order] > LONG])


def padded(words: list[bytes], order: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words in order of their lengths, together as long as none is twice as long as another and all are within ROOM bytes."""
    a = 0
    while a < len(order):
        least, b = len(words[order[a]]), a + 1
        while b < len(order) and len(words[order[b]]) <= 2 * least and (b - a + 1) * len(words[order[b]]) <= ROOM:
            b += 1
        part = order[a:b]
        sizes = np.array([len(words[i]) for i in part])
        yield part, np.frombuffer(b"".join([words[i].ljust(sizes[-1], b"\0") for i in part]), np.uint8).reshape(len(part), sizes[-1]), sizes
        a = b


def scaled(v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Probabilities by id (and column) times GAIN per byte, so that a product along a word stays in range."""
    gain = GAIN ** v.sizes.astype(float)
    out = np.zeros((v.n + 1, *p.shape[1:]))
    out[: len(p)] = p
    out[~v.used] = 0
    return out * (gain if p.ndim == 1 else gain[:, None])


def log_marginals(v: Vocabulary, words: list[bytes], p: np.ndarray) -> np.ndarray:
    """Natural log of the sum over all segmentations of each word, for each column of `p` (ids by columns)."""
    q = scaled(v, p)
    out = np.zeros((len(words), p.shape[1]))
    short, long = short_and_long(words)
    for part, codes, sizes in long:
        out[part] = _long(v, codes, sizes, p)
    for part, codes in short:
        size = codes.shape[1]
        ids = v.spans(codes)
        alpha = np.zeros((size + 1, len(part), p.shape[1]))
        alpha[0] = 1
        for i in range(1, size + 1):
            for k in range(1, min(i, len(ids)) + 1):
                own = ids[k - 1][:, i - k]
                if k <= 2:
                    alpha[i] += alpha[i - k] * q[own]
                elif len(rows := np.flatnonzero(own < v.n)):
                    alpha[i, rows] += alpha[i - k, rows] * q[own[rows]]
        with np.errstate(divide="ignore"):
            out[part] = np.log(alpha[size]) - size * np.log(GAIN)
        if len(low := np.flatnonzero(~(alpha[size] > 1e-280).all(1))):
            out[part[low]] = _long(v, codes[low], np.full(len(low), size), p)
    return out


def stretches(v: Vocabulary, codes: np.ndarray) -> Iterable[tuple[int, int, list[np.ndarray]]]:
    """(first, end, ids) for stretches of start positions: ids[k - 1][:, i] names the substring of k bytes at first + i."""
    size = codes.shape[1]
    for a in range(0, size, STEP):
        yield a, min(size, a + STEP), v.spans(codes[:, a : a + STEP + v.longest - 1])


def log_weights(v: Vocabulary, p: np.ndarray) -> np.ndarray:
    q = np.zeros((v.n + 1, *p.shape[1:]))
    q[: len(p)] = p
    q[~v.used] = 0
    with np.errstate(divide="ignore"):
        return np.log(q)


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    x = np.stack(terms)
    top = x.max(0)
    base = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return base + np.log(np.exp(x - base).sum(0))


def forward(v: Vocabulary, codes: np.ndarray, q: np.ndarray) -> Iterable[np.ndarray]:
    """For positions 0, 1, ..., size: log of the sum over all segmentations up to there, by row (and class)."""
    ahead: list[list[np.ndarray]] = [[] for _ in range(v.longest + 1)]  # what reaches the next positions
    now = np.zeros((len(codes), *q.shape[1:]))
    yield now
    for a, b, ids in stretches(v, codes):
        for i in range(b - a):
            for k in range(1, len(ids) + 1):
                if i < ids[k - 1].shape[1]:
                    ahead[k - 1].append(now + q[ids[k - 1][:, i]])
            now = log_sum(ahead.pop(0))
            ahead.append([])
            yield now


def _long(v: Vocabulary, codes: np.ndarray, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log marginals in log space, with what a piece can still reach as the only state; bytes from `sizes` on don't count."""
    out = np.zeros((len(codes), p.shape[1]))
    for i, now in enumerate(forward(v, codes, log_weights(v, p))):
        done = np.flatnonzero(sizes == i)
        out[done] = now[done]
    return out


def _long_counts(v: Vocabulary, codes: np.ndarray, sizes: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (forward-backward in log space)."""
    q, out, size = log_weights(v, p), np.zeros(v.n + 1), codes.shape[1]
    alpha = np.stack(list(forward(v, codes, q)))
    rows = np.arange(len(codes))
    total, beta = alpha[sizes, rows], np.full((size + 1, len(codes)), -np.inf)
    for a in reversed(range(0, size, STEP)):
        b, ids = min(size, a + STEP), v.spans(codes[:, a : a + STEP + v.longest - 1])
        beta[sizes, rows] = 0
        for i in range(b - 1, a - 1, -1):
            made = log_sum([q[x[:, i - a]] + beta[i + k] for k, x in enumerate(ids, 1) if i - a < x.shape[1]])
            beta[i] = np.where(i < sizes, made, beta[i])
        for k, x in enumerate(ids, 1):
            n = min(b - a, x.shape[1])
            own = x[:, :n].T
            with np.errstate(invalid="ignore"):
                gain = np.exp(alpha[a : a + n] + q[own] + beta[a + k : a + k + n] - total) * weights
            out += np.bincount(own.ravel(), np.nan_to_num(gain).ravel(), v.n + 1)
    return out


def expected_counts(v: Vocabulary, words: list[bytes], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations (forward-backward), words weighted."""
    q, out = scaled(v, p), np.zeros(v.n + 1)
    short, long = short_and_long(words)
    for part, codes, sizes in long:
        out += _long_counts(v, codes, sizes, p, weights[part])
    for part, codes in short:
        size = codes.shape[1]
        ids = v.spans(codes)
        use: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        alpha, beta = np.zeros((size + 1, len(part))), np.zeros((size + 1, len(part)))
        alpha[0], beta[size] = 1, 1
        for i in range(1, size + 1):
            for k in range(1, min(i, len(ids)) + 1):
                own = ids[k - 1][:, i - k]
                rows = np.flatnonzero(own < v.n)
                if len(rows):
                    own = own[rows]
                    w = q[own]
                    alpha[i, rows] += alpha[i - k, rows] * w
                    use.append((i - k, i, rows, own, w))
        total = alpha[size]
        low = np.flatnonzero(~(total > 1e-280))
        share = np.where(total > 1e-280, weights[part] / np.where(total > 1e-280, total, 1), 0)
        for a, b, rows, _, w in reversed(use):
            beta[a, rows] += w * beta[b, rows]
        own = np.concatenate([x[3] for x in use])
        gain = np.concatenate([alpha[a, rows] * w * beta[b, rows] * share[rows] for a, b, rows, _, w in use])
        out += np.bincount(own, gain, v.n + 1)
        if len(low):
            out += _long_counts(v, codes[low], np.full(len(low), size), p, weights[part[low]])
    return out[:-1]


def best_segmentations(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The segmentation of highest score of each word, as little-endian 32-bit ids; of those that tie, the one with the
    longest last piece, then the longest piece before it, and so on."""
    out: list[bytes] = [b""] * len(words)
    for part, codes in batches(words):
        ids, size = v.spans(codes), codes.shape[1]
        piece, back = _viterbi(v, ids, size)
        rows, place = np.arange(len(part)), np.full(len(part), size)
        steps: list[np.ndarray] = []
        while place.any():
            steps.append(piece[place, rows])
            place = place - back[place, rows]
        table = np.stack(steps[::-1], 1).astype("<i4")
        counts = (table >= 0).sum(1)
        flat = table[table >= 0].tobytes()
        at = 0
        for r, c in zip(part.tolist(), counts.tolist(), strict=True):
            out[r] = flat[at : at + 4 * c]
            at += 4 * c
    return out


def _viterbi(v: Vocabulary, ids: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The last piece of the best segmentation up to each position, and its length, by row; at 0 no piece (-1, 0)."""
    rows = ids[0].shape[0]
    best, back = np.full((size + 1, rows), NONE), np.zeros((size + 1, rows), np.int16)
    piece = np.full((size + 1, rows), -1, np.int32)
    best[0] = 0
    by_start = [np.ascontiguousarray(x.T) for x in ids]
    found = [(x < v.n).any(1).tolist() for x in by_start]
    for i in range(1, size + 1):
        for k in range(min(i, len(ids)), 0, -1):
            if found[k - 1][i - k]:
                own = by_start[k - 1][i - k]
                score = best[i - k] + v.reached[own]
                better = score > best[i]
                np.copyto(best[i], score, where=better)
                np.copyto(piece[i], own, where=better)
                back[i][better] = k
    return piece, back


class Cache:
    """Value of each distinct string, made for many at once and forgotten beyond `most` strings; no effect on results."""

    def __init__(self, make: Callable[[list[bytes]], list], most: int = 200_000):
        self.make, self.most, self.known = make, most, {}

    def add(self, words: Iterable[bytes]) -> dict:
        if len(self.known) > self.most:
            self.known.clear()
        new = list(set(words).difference(self.known))
        if new:
            self.known.update(zip(new, self.make(new), strict=True))
        return self.known


class Recent(Cache):
    """A cache that, when it is full, forgets first what was not asked for since it was last full: frequent strings stay."""

    def __init__(self, make: Callable[[list[bytes]], list], most: int = 200_000):
        super().__init__(make, most)
        self.older: dict = {}

    def add(self, words: Iterable[bytes]) -> dict:
        if len(self.known) > self.most // 2:
            self.older, self.known = self.known, {}
        new = set(words).difference(self.known)
        kept = new.intersection(self.older)
        self.known.update(zip(kept, map(self.older.__getitem__, kept), strict=True))
        new = list(new - kept)
        if new:
            self.known.update(zip(new, self.make(new), strict=True))
        return self.known
