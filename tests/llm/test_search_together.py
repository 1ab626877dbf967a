"""Whole texts as queries over one shard: what many queries hold at a time, and the same best rows as scoring everything."""

import collections
import pickle
import tracemalloc

import numpy as np

from ledgerlens.llm import search


def shard(texts):
    counts = [collections.Counter(t) for t in texts]
    df = collections.Counter(w for c in counts for w in c)
    found = collections.defaultdict(lambda: ([], []))
    for i, c in enumerate(counts):
        for w, k in c.items():
            found[w][0].append(i)
            found[w][1].append(k)
    pack = lambda x: np.array(x, np.int32).tobytes()
    ids = pickle.dumps((list(range(len(texts))), [0] * len(texts), [1] * len(texts)))
    postings = [(b"", 0, ids, pack([len(t) for t in texts]))] + [(w, df[w], pack(a), pack(b)) for w, (a, b) in found.items()]
    return search.ShardIndex(postings, len(texts), sum(map(len, texts)) / len(texts)), counts


def test_whole_texts_find_their_best_rows_in_little_memory():
    """Before, 256 queries held the scores of all rows of a stretch at once (115 MB here)."""
    rng = np.random.default_rng(5)
    kinds = [f"w{i}".encode() for i in range(3000)]
    share = 1 / (np.arange(3000) + 3)
    texts = [[kinds[i] for i in rng.choice(3000, rng.integers(3, 60), p=share / share.sum())] for _ in range(12_000)]
    texts[9000:9050] = [texts[3]] * 50
    # words of one stretch only, so that whole blocks fall out
    texts[4000:4200] = [[b"only", b"here"] * 3 + t[:2] for t in texts[4000:4200]]
    index, counts = shard(texts)
    queries = counts[:9000:45] + counts[4000:4040] + [collections.Counter([b"only", b"only", b"w2990"]), collections.Counter([b"none"]), collections.Counter()]
    index.search(queries[:1], 10)
    tracemalloc.start()
    got = index.search(queries, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for q, hits in zip(queries, got, strict=True):
        score = np.zeros(len(texts))
        for w, k in q.items():
            if w in index.place:
                part = slice(*index.starts[[index.place[w], index.place[w] + 1]])
                score[index.rows[part]] += k * index.weight[part]
        score = score.round(6)
        best = np.lexsort((np.arange(len(texts)), -score))[:10]
        assert [d for _, d in hits] == [d for d in best.tolist() if score[d] > 0]
        assert np.allclose([s for s, _ in hits], score[[d for _, d in hits]] if hits else [], rtol=0, atol=2e-6)
    assert peak < 60 << 20
