"""The corpus operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import functools
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import common, components, dedup, encode, fingerprint, langid, lattice, lengths, lm, mixing, quality, search, toxicity

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
ODD = [(-1, None), (-2, ""), (-3, "a▁b  c\t\n  \n"), (-4, "x" * 3000), (-5, "日本語テキスト" * 200 + " é"), (-6, " \n "), (-7, "one two"), (-7, "one two"), (None, "no id here at all")]


@pytest.fixture(scope="module")
def docs(spark):
    common.ready(spark)
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    rows = spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1.0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, ids string, score double")
    return docs.limit(40).unionByName(rows, allowMissingColumns=True)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


# --- lattice ---


def test_lattice_matches_brute_force():
    v = lattice.vocabulary(common.PIECE_MODEL)
    p = np.where(v.used[:-1], np.exp(v.score[:-1]), 0)
    some = [b" the", b" thereafter", " é日".encode(), b"\x00\xff", b" " + b"ab" * 40]

    def brute(w):
        a, best = [1.0] + [0.0] * len(w), [0.0] + [-math.inf] * len(w)
        for i in range(1, len(w) + 1):
            for k in range(1, min(i, v.longest) + 1):
                j = v.ids.get(w[i - k : i])
                if j is not None:
                    a[i] += a[i - k] * p[j]
                    best[i] = max(best[i], best[i - k] + v.score[j])
        return math.log(a[-1]), best[-1]

    got = lattice.log_marginals(v, some, np.stack([p, p / 2], 1))
    for w, (x, _), seg in zip(some, got, lattice.best_segmentations(v, some), strict=True):
        ids = np.frombuffer(seg, "<i4")
        total, best = brute(w)
        assert x == pytest.approx(total, rel=1e-9) and v.score[ids].sum() == pytest.approx(best)
        assert b"".join(v.pieces[i] for i in ids) == w
    e = lattice.expected_counts(v, [b" the"], np.array([2.0]), p)
    h = 1e-6
    i = v.ids[b" the"]
    q = p.copy()
    q[i] *= 1 + h
    slope = (lattice.log_marginals(v, [b" the"], q[:, None])[0, 0] - lattice.log_marginals(v, [b" the"], p[:, None])[0, 0]) / h
    assert e[i] == pytest.approx(2 * slope, rel=1e-3)


# --- op1 ---


def brute_components(rows):
    sets = []
    for d, t in rows:
        w = words(t)
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    label = {d: d for d, _ in sets if d is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if a is not None and b is not None and a != b and s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {(d, len(s), find(d) if d is not None else None) for d, s in sets}


def test_near_duplicates_match_brute_force(spark, odd):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(70)]
    made = []
    for i in range(60):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(120)] = f"z{rng.randrange(900)}"
        made.append((1000 + i, " ".join(near)))
        made.append((2000 + i, " ".join(passage + [f"q{i}_{j}" for j in range(rng.randrange(5, 60))])))
    rows = spark.createDataFrame(made, "doc_id long, text string").unionAll(odd.select("doc_id", "text"))
    got = dedup.op1_near_dedup(rows).collect()
    assert len(got) == rows.count()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components([tuple(r) for r in rows.collect()])
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_repeated_rows(spark):
    """Two linked documents a thousand times each, one doc_id with many texts, and null ids: rows count, links don't grow."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "other")
    made = [(1, text)] * 1000 + [(2, near)] * 1000 + [(3, f"{text} tail{i}") for i in range(40)] + [(4, " ".join(f"u{i} of" for i in range(9)))] * 3 + [(None, text)] * 2
    made += [(5, " ".join(f"x{i}" for i in range(20))), (5, " ".join(f"y{i}" for i in range(20))), (6, " ".join(f"y{i}" for i in range(20)))]
    got = collections.Counter(tuple(r) for r in dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect())
    assert got == collections.Counter({(1, 56, 1, True): 1000, (2, 56, 1, False): 1000, (3, 57, 1, False): 40, (4, 14, 4, True): 3, (None, 56, None, False): 2, (5, 16, 5, True): 2, (6, 16, 5, False): 1})


def test_near_duplicates_of_nothing(none):
    assert dedup.op1_near_dedup(none).count() == 0


def test_sequential_test_misses_little():
    for n, m in zip(range(dedup.BLOCK, dedup.K + 1, dedup.BLOCK), dedup.least_matches(), strict=True):
        below = sum(math.comb(n + 1, j) * 0.75**j * 0.25 ** (n + 1 - j) for j in range(m))
        assert below < dedup.MISS and m > 0.3 * n


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


# --- op2 ---


def test_language(docs, odd, none):
    out = langid.op2_language(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() and out.where("score < 0 OR score > 1").count() == 0
    got = {r["doc_id"]: r for r in langid.op2_language(odd).collect()}
    assert got[-1]["lang_pred"] == got[-2]["lang_pred"] == got[-6]["lang_pred"] == "und" and got[-5]["lang_pred"] != "und"
    assert langid.op2_language(none).count() == 0
    flags = {r["doc_id"]: r["held_out"] for r in out.collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in flags.items())


# --- op3 ---


def spelled(v, weights, word):
    """Sum over all segmentations of a word, by a plain recursion."""
    a = [1.0] + [0.0] * len(word)
    for i in range(1, len(word) + 1):
        for k in range(1, min(i, v.longest) + 1):
            j = v.ids.get(word[i - k : i])
            if j is not None:
                a[i] += a[i - k] * weights[j]
    return a[-1]


def test_language_matches_brute_force(spark, docs):
    """Predictions and posteriors from a plain sum over segmentations, also of long words."""
    v = lattice.vocabulary(common.PIECE_MODEL)
    models = langid.fit_languages(docs.limit(80))
    names = sorted(models)
    texts = ["The of and", "x", "rewhtion" * 9, "Thisisoneverylongwordwithoutanyspaceinside" * 2 + " and more", "the der la il"] + [" ".join(r["text"].split()[:12]) for r in docs.limit(12).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict_languages(rows, models).collect():
        total = [sum(math.log(spelled(v, models[k], b" " + w)) for w in words(texts[r["doc_id"]])) for k in names]
        best = int(np.argmax(total))
        assert r["lang_pred"] == names[best] and r["score"] == pytest.approx(1 / sum(math.exp(x - total[best]) for x in total), rel=1e-6)


def test_long_words_are_learned(spark):
    """Text without spaces: two languages told apart by words of hundreds of bytes alone."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(kinds) for _ in range(80)), lang) for i in range(60) for kinds, lang in [(("the", "ing", "ation"), "x") if i % 2 else (("der", "ung", "schaft"), "y")]]
    models = langid.fit_languages(spark.createDataFrame(rows[:40], "doc_id long, text string, lang string"))
    got = langid.predict_languages(spark.createDataFrame(rows[40:], "doc_id long, text string, lang string"), models, keep=("doc_id", "lang")).collect()
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.99 for r in got)
    v = lattice.vocabulary(common.PIECE_MODEL)
    p = models["x"]
    some = [b" " + r[1].encode()[: 60 + 20 * i] for i, r in enumerate(rows[:5])]
    for w, got in zip(some, lattice.log_marginals(v, some, p[:, None])[:, 0], strict=True):
        assert got == pytest.approx(math.log(spelled(v, p, w)), rel=1e-9)
    counts = lattice.expected_counts(v, some, np.ones(5), p)
    assert (counts * v.sizes[:-1]).sum() == pytest.approx(sum(map(len, some)))


def test_token_lengths_match_merges_by_hand(spark, docs):
    """Lengths from the vocabulary file alone: text cut by the pattern, then the lowest-ranked pair merged, again and again."""
    import base64

    import regex

    ranks = {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in open(common.BYTE_BPE, "rb")}

    def merged(word):
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == math.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return len(parts)

    texts = [None, "", "Hello  world's 123\n\n", "日本語 é", "x" * 50] + [r["text"][:400] for r in docs.limit(6).collect()]
    expected = sorted(sum(merged(w.encode()) for w in regex.findall(lengths.PATTERN, t or "")) for t in texts)
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r["length"] for r in lengths.token_lengths(rows).collect()) == expected


def test_length_histogram(docs, odd, none):
    sizes = [r["length"] for r in lengths.token_lengths(odd).collect()]
    hist = lengths.op3_lengths(odd)
    count = collections.Counter(sizes)
    for r in hist.collect():
        n = r["length"]
        assert r["docs"] == count[n] and r["docs_from"] == sum(x >= n for x in sizes) and r["truncated_total"] == sum(min(x, n) for x in sizes)
        assert r["whole_total"] == sum(x for x in sizes if x <= n)
    for limit in (0, 5, 100, 10**6):
        assert lengths.total_at(hist, limit).first()[0] == sum(min(x, limit) for x in sizes)
    assert lengths.length_quantile(hist, 0.5).first()[0] == sorted(sizes)[math.ceil(len(sizes) * 0.5) - 1]
    assert lengths.op3_lengths(none).count() == 0


def test_token_lengths_of_long_blanks_and_invalid_bytes(spark, docs):
    """Runs of white space of millions of characters, inside and at the end, and bytes that aren't UTF-8, against the encoder on
    short ones; a run in which each piece is as long as the vocabulary has it."""
    enc = lengths.encoder(common.BYTE_BPE)
    common.ready(spark)
    for blank in (" ", "\n", " \n", "\t ", "\u3000", "\r\n"):
        for n in (1023, 1024, 1025, 3001):
            for text in ("a" + blank * n + "b c", blank * n, "'s" + blank * n, blank * n + "1 2" + blank * n + "#"):
                assert lengths.encoded_length(enc, text) == len(enc.encode_ordinary(text))
    texts = ["a" + " " * 5_000_000 + "b", "\n" * 5_000_000, "a" + " \n\t" * 1_700_000 + "b", "x" * 2_000_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").unionAll(spark.sql("SELECT cast(X'61FF2062' AS string)"))
    got = [r["length"] for r in lengths.token_lengths(rows).collect()]
    assert len(got) == 5 and all(x > 1000 for x in got[:4]) and got[4] == len(enc.encode_ordinary("a\ufffd b"))
    assert lengths.op3_lengths(rows).where("total_docs = 5").count() > 0


# --- op4 ---


def brute_search(data, top=10):
    """Sorted (conv_id, turn, rank, hit_conv_id, hit_turn, score) by each distinct asking row."""
    docs_ = [collections.Counter(words(t)) for *_, t in data]
    size = [sum(c.values()) for c in docs_]
    mean, n = sum(size) / len(size), len(data)
    df = collections.Counter(w for c in docs_ for w in c)
    out = []
    for (a, b, _), q in {x: c for x, c in zip(data, docs_, strict=True)}.items():
        if a is None or a % 20:
            continue
        found = []
        for (c, d, _), own, z in zip(data, docs_, size, strict=True):
            s = sum(k * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own[w] * 2.2 / (own[w] + 1.2 * (0.25 + 0.75 * z / mean)) for w, k in q.items() if own[w])
            if s > 0:
                found.append((-round(s, 6), c is None, c or 0, d, c))
        out += [(a, b, i, x[4], x[3], round(-x[0], 5)) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def searched(spark, data):
    rows = search.op4_search(spark.createDataFrame(data, "conv_id long, turn long, text string")).collect()
    return sorted(((r["conv_id"], r["turn"], r["rank"], r["hit_conv_id"], r["hit_turn"], round(r["score"], 5)) for r in rows), key=str)


def close(got, expected):
    assert len(got) == len(expected)
    for x, y in zip(got, expected, strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], abs=3e-5)


def test_search_matches_brute_force(spark):
    rng = random.Random(2)
    data = [(i // 3, i % 3, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(12)))) for i in range(120)] + [(None, 0, "a b"), (7, 1, None), (20, 0, "a b c")]
    close(searched(spark, data), brute_search(data))
    assert search.op4_search(spark.createDataFrame(data, "conv_id long, turn long, text string").limit(0)).count() == 0


def test_search_keeps_better_rows_after_ties(spark):
    """A thousand rows that tie, better ones after them, and one row many times over."""
    data = [(i, 0, "ok thanks") for i in range(1, 1001)] + [(2000 + i, 0, "ok thanks really") for i in range(3)] + [(5000, 0, "ok then")] * 30
    close(searched(spark, data), brute_search(data))


def test_search_skips_postings_but_no_row():
    """Short queries over many rows, in several stretches and shards: the same as scoring everything, with less read."""
    rng = np.random.default_rng(4)
    kinds = [f"w{i}".encode() for i in range(400)]
    share = 1 / (np.arange(400) + 3)
    texts = [[kinds[i] for i in rng.choice(400, rng.integers(3, 40), p=share / share.sum())] for _ in range(9000)]
    texts[8000:8200] = [texts[3]] * 200
    counts = [collections.Counter(t) for t in texts]
    df = collections.Counter(w for c in counts for w in c)
    mean = sum(map(len, texts)) / len(texts)
    found = collections.defaultdict(lambda: ([], []))
    for i, c in enumerate(counts):
        for w, k in c.items():
            found[w][0].append(i)
            found[w][1].append(k)
    pack = lambda x: np.array(x, np.int32).tobytes()
    ids = __import__("pickle").dumps((list(range(9000)), [0] * 9000, [1] * 9000))
    index = search.ShardIndex([(b"", 0, ids, pack([len(t) for t in texts]))] + [(w, df[w], pack(a), pack(b)) for w, (a, b) in found.items()], 9000, mean)
    index.counting = True
    queries = [collections.Counter(t[:3]) for t in texts[::60]] + [collections.Counter([b"w0"]), collections.Counter([b"none"])]
    got = index.search(queries, 10)
    for q, hits in zip(queries, got, strict=True):
        score = np.zeros(9000)
        for w, k in q.items():
            if w in index.place:
                part = slice(*index.starts[[index.place[w], index.place[w] + 1]])
                score[index.rows[part]] += k * index.weight[part]
        score = score.round(6)
        best = np.lexsort((np.arange(9000), -score))[:10]
        assert [d for _, d in hits] == [d for d in best.tolist() if score[d] > 0]
    assert index.scored < 0.6 * index.all_postings


# --- op5 ---


def test_language_model(spark, docs, odd, none):
    rows = docs.unionByName(odd.select(*docs.columns))
    got = lm.op5_lattice(rows).collect()
    data = [tuple(r) for r in rows.select("doc_id", "text").collect()]
    assert len(got) == len(data)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    count = collections.Counter(w for d, t in data if not held(d) for w in words(t))
    ends = sum(not held(d) for d, _ in data)
    n, v = sum(count.values()) + ends, len(count) + 1
    part = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    expected = sorted((d is None, d or 0, len(words(t)) + 1, sum(count[w] > 0 for w in words(t)) + 1, round(sum(part(count[w]) for w in words(t)) + part(ends), 4)) for d, t in data)
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got)
    assert all(a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=2e-4) for a, b in zip(found, expected, strict=True))
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > 1.2 * sum(r["base_score"] for r in out)
    assert lm.op5_lattice(none).count() == 0


def test_language_model_matches_brute_force(spark, docs):
    """The score of whole texts from the model's parameters, by plain sums over segmentations, edges and classes."""
    v = lattice.vocabulary(common.PIECE_MODEL)
    model = lm.fit(docs.limit(60))
    first = langid.start_model(common.PIECE_MODEL)
    count = {bytes(r["word"]): np.array(list(r)[1:], float) for r in model.counts.collect()}
    texts = ["", "the of", "Unheardofword the", "x" * 90 + " and"] + [" ".join(r["text"].split()[:10]) for r in docs.limit(8).collect()]
    rows = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    got = {r["doc_id"]: r for r in lm.score(rows, model).collect()}
    share = np.maximum(model.docs, 1) / np.maximum(model.docs, 1).sum()
    for i, text in enumerate(texts):
        total, plain = np.log10(np.maximum(model.docs, 0.5) / np.maximum(model.tokens, 1)), math.log10(0.5)
        for w in words(text):
            own = np.array([spelled(v, model.pieces[:, k], b" " + w) for k in range(len(share))])
            by = count.get(w, np.zeros(len(share)))
            total = total + np.log10(np.maximum(by - model.discount, 0) / model.tokens + model.discount * model.distinct / model.tokens * model.stop * own)
            plain += math.log10(spelled(v, first / 2, b" " + w) / 4)
        assert got[i]["score"] == pytest.approx(math.log10((share * 10 ** (total - total.max())).sum()) + total.max(), rel=1e-9)
        assert got[i]["lattice_score"] == pytest.approx(plain, rel=1e-9)


def test_language_model_head_is_bounded_by_bytes(spark, docs, monkeypatch):
    """Few words sent to the tasks, or all: the same scores."""
    rows = docs.limit(40)
    many = {r["doc_id"]: r["score"] for r in lm.op5_lattice(rows).collect()}
    monkeypatch.setattr(lm, "HEAD_BYTES", 10_000)
    few = {r["doc_id"]: r["score"] for r in lm.op5_lattice(rows).collect()}
    assert few.keys() == many.keys() and all(few[k] == pytest.approx(many[k], rel=1e-9) for k in few)


def test_language_model_adds_up_to_one_at_most(spark, docs):
    model = lm.fit(docs.limit(60))
    v = lattice.vocabulary(common.PIECE_MODEL)
    few = [r["word"] for r in model.counts.select("word").collect()]
    by = np.array([list(r)[1:] for r in model.counts.collect()], float)
    known = 10 ** lm.word_scores(model, by, lattice.log_marginals(v, [b" " + bytes(w) for w in few], model.pieces))
    end = model.docs / model.tokens
    assert (known.sum(0) + end <= 1 + 1e-9).all() and (model.pieces.sum(0) + model.stop <= 1 + 1e-9).all()


# --- op6 ---


def brute_encoding(v, text):
    """The best cutting of a whole text, without words or chunks: greatest score, then the longest last piece, and so on."""
    data = b" " + text.encode() if text else b""
    best, back = [0] + [None] * len(data), [None] * (len(data) + 1)
    for end in range(1, len(data) + 1):
        for size in range(min(end, v.longest), 0, -1):
            piece = v.ids.get(data[end - size : end])
            if piece is not None and best[end - size] is not None and (best[end] is None or best[end - size] + int(v.points[piece]) > best[end]):
                best[end], back[end] = best[end - size] + int(v.points[piece]), (size, piece)
    ids, end = [], len(data)
    while end:
        size, piece = back[end]
        ids.append(piece)
        end -= size
    return ids[::-1]


def test_encoding_matches_brute_force_wherever_it_is_cut(spark, docs):
    v = lattice.vocabulary(common.PIECE_MODEL)
    rng = random.Random(8)
    texts = ["x" * 3000 + "yz" * 200, "aaaa aaaaaaa " * 30, "ab" * 500, "a" * 997, "aab" * 700 + "\n\n  b", "日本" * 400, "", "the end"]
    texts += ["".join(rng.choice("aabx ") for _ in range(n)) for n in (301, 640, 2000)] + ["".join(rng.choice("theran") for _ in range(1500))]
    texts += [r["text"] for r in docs.limit(30).collect()]
    expected = {t: brute_encoding(v, t) for t in texts}
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, t_key string, row int")
    for chunk in (300, 32_768, 1 << 30):
        for r in encode.encode(rows, chunk=chunk).collect():
            assert r["ids"] == expected[r["text"]], (chunk, r["text"][:40])
            assert r["t_key"] == "clash" and r["row"] == 1


def test_products_of_transfers_are_associative():
    v = lattice.vocabulary(common.PIECE_MODEL)
    data = b" " + b"aabab" * 30 + b" tail aaab" * 12
    parts = encode.chunked(data, 60, v.longest)
    m = [encode.transfer(v, d, x, None, 0) for d, x in parts]
    left = encode.product(encode.product(m[0], m[1]), m[2])
    right = encode.product(m[0], encode.product(m[1], m[2]))
    known = left[0] > lattice.NONE / 2
    assert (left[0][known] == right[0][known]).all()
    for end in range(v.longest):
        rows = np.flatnonzero(known[:, end])
        assert list(rows[left[1][rows, end].argsort()]) == list(rows[right[1][rows, end].argsort()])


def test_encoding_round_trip(odd, none):
    cut = encode.encode(odd, chunk=300)
    assert cut.count() == odd.count() and {"source", "score", "ids"} <= set(cut.columns)
    assert encode.op6_encode(odd).where("NOT round_trip").count() == 0
    assert encode.op6_encode(none).count() == 0


# --- op7 ---


def test_fingerprints(spark, odd, none):
    got = fingerprint.op7_fingerprint(odd)
    rows = {(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = {}
    for i, (d, t) in enumerate(order):
        m = len(t) // 3
        by[d] = (len(t), hashlib.sha256((t[: len(t) - m] + order[(i + 1) % len(order)][1][:m]).encode()).hexdigest())
    out = got.collect()
    assert len(out) == odd.count()
    assert all((r["n_chars"], r["edited_sha256"]) == by[r["doc_id"]] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert len({r["fingerprint"] for r in out if r["doc_id"] == -7}) == 1
    assert fingerprint.op7_fingerprint(none).count() == 0


def brute_fingerprint(text):
    """Every bin's bits by plain loops, with the hash that the column functions use."""
    import xxhash

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    chain = lambda parts: functools.reduce(lambda seed, b: xxhash.xxh64(b, seed=seed).intdigest(), parts, 42)
    h = [chain([w]) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    if not h:
        return ""
    eight = [x.to_bytes(8, "little") for x in h]
    found = [chain(eight)] if len(h) < 5 else [chain(eight[i : i + 5]) for i in range(len(h) - 4)]
    least = {}
    for x in found:
        least[x >> 57] = min(x, least.get(x >> 57, x))
    out = []
    for b in range(128):
        if b in least:
            out.append(least[b] & 255)
        else:
            rank = {signed(chain([b.to_bytes(4, "little"), k.to_bytes(4, "little")]) & ~255 | x & 255): x & 255 for k, x in least.items()}
            out.append(rank[min(rank)])
    return "".join(f"{x:02x}" for x in out)


def test_fingerprint_bits_match_brute_force(spark):
    rng = random.Random(6)
    texts = ["", " \n ", "one", "a b c d", "a b c d e", "A b  c\td e f"] + [" ".join(f"w{rng.randrange(4000)}" for _ in range(n)) for n in (9, 60, 400, 3000)] + ["日本 語 é ü ß x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in fingerprint.op7_fingerprint(rows).collect():
        assert r["fingerprint"] == brute_fingerprint(texts[r["doc_id"]])
        after = texts[(r["doc_id"] - 1) % len(texts)]
        cut = len(texts[r["doc_id"]]) // 3
        edited = texts[r["doc_id"]][: len(texts[r["doc_id"]]) - cut] + after[:cut]
        assert r["edited_fingerprint"] == brute_fingerprint(edited) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_likeness_estimates_similarity(spark):
    rng = random.Random(8)
    pairs = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(30):
            a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
            cut = int(400 * 2 * share / (1 + share))
            pairs.append((share, " ".join(a), " ".join(a[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(400 - cut)])))
    df = spark.createDataFrame(pairs, "share double, a string, b string")
    got = df.select("share", fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("x")).groupBy("share").agg(F.avg("x").alias("x")).collect()
    assert all(abs(r["x"] - r["share"]) < 0.04 for r in got)


# --- op8 ---


def test_mix(spark, odd, none):
    rows = odd.drop("score", "ids").unionByName(odd.drop("score", "ids").withColumns({"source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") - 50}))
    out = mixing.op8_mix(rows).collect()
    assert len(out) == rows.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = collections.defaultdict(int)
    for r in out:
        by[r["source_size"], round(r["target"], 3)] += r["taken"]
    assert all(abs(taken - round(target)) <= 1 for (_, target), taken in by.items() if sum(1 for k in by if k[1] == target) == 1)
    mixed = mixing.mixed_documents(rows)
    assert mixed.columns == rows.columns
    total = mixed.select(F.sum(common.word_count(F.col("text")))).first()[0]
    assert total == sum(r["taken"] for r in out)
    assert mixing.op8_mix(none).count() == 0


def test_mix_with_clashing_names(odd):
    names = {"target": F.lit("t"), "source_size": F.lit("s"), "taken": F.lit(-1), "m_size": F.lit("m"), "m_key": F.lit("k"), "m_row": F.lit(2), "m_copy": F.lit(3), "m_source": F.lit("x"), "size": F.lit(9)}
    rows = odd.withColumns(names)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["taken"])
    plain, clash = (sorted(mixing.op8_mix(x).collect(), key=key) for x in (odd, rows))
    assert plain == clash
    mixed = mixing.mixed_documents(rows)
    assert mixed.columns == rows.columns and mixed.where("taken <> -1 OR target <> 't' OR source_size <> 's' OR m_size <> 'm' OR m_row <> 2").count() == 0
    added = mixing.mix(rows)
    assert set(added.columns) == set(rows.columns) and added.where("m_key <> 'k' OR size <> 9").count() == 0 and added.where("taken < 0").count() == 0


def test_mix_makes_the_words_it_plans(spark):
    """Texts with leading and trailing blanks: the cut document gives as many words as the plan says, with the blanks before them."""
    rows = spark.createDataFrame([(i, " \t" * (i % 3) + "a b  c\nd e f g" + " " * (i % 2), f"s{i % 4}") for i in range(44)], "doc_id long, text string, source string")
    plan = {r["doc_id"]: r["taken"] for r in mixing.op8_mix(rows).collect()}
    made = collections.Counter()
    for r in mixing.mixed_documents(rows).collect():
        made[r["doc_id"]] += len(r["text"].split())
        assert r["text"].startswith(" \t" * (r["doc_id"] % 3) + "a")
    assert made == +collections.Counter(plan) and any(0 < n % 7 for n in made.values())


def test_mix_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "m_source string, m_size long")
    got = {r["m_source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a is full at 20; the rest of 3015 goes to b and c as 2 to 1, where b is full at 2000
    assert got["a"] == 20 and got[None] == 0 and got["b"] == pytest.approx((3015 - 20) * 2 / 3) and got["c"] == pytest.approx((3015 - 20) / 3)


# --- op9, op10 ---


def planted(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        bad, low = i % 4 == 0, i % 5 == 0
        w = ["".join(rng.choice(("ta", "re", "mi", "no", "su")) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        if bad:
            w[rng.randrange(len(w))] = "vilewort"
        rows.append((i, " ".join(x + "###" if low else x for x in w), None))
        labels.append((i, int(not low), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd, none):
    docs_, labels = planted(spark)
    out = toxicity.op9_toxicity(docs_.unionByName(odd.select("doc_id", "text", "lang").where("doc_id < 0 OR doc_id IS NULL")), labels)
    got = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.9 * len(got)
    assert out.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS INT)").count() == 0
    assert toxicity.op9_toxicity(none, labels).count() == 0
    assert toxicity.op9_toxicity(docs_, labels.where("toxic = 0")).where("predicted = 1").count() == 0


def test_toxicity_reads_long_words_to_their_end(spark):
    for n in (39, 40, 41, 73, 74, 75, 300):
        word = bytes(97 + i * i % 23 for i in range(n))
        whole, parts = b"\x02" + word + b"\x03", toxicity.cores(toxicity.units(b"..." + word + b"#" * 90))
        for k in toxicity.GRAMS:
            grams = lambda x: {x[i : i + k] for i in range(len(x) - k + 1)}
            assert set().union(*map(grams, parts)) == grams(whole)
        assert max(map(len, parts)) <= toxicity.LONGEST + 2
    docs_, labels = planted(spark)
    joined = docs_.withColumn("text", F.concat(F.lit("x" * 45), F.translate("text", " ", "_")))
    got = toxicity.op9_toxicity(joined, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.9 * len(got)


def test_toxicity_matches_brute_force(spark):
    """Scores of whole texts by plain loops over windows, units and gates."""
    rng = np.random.default_rng(5)
    net = toxicity.Windows(rng.normal(size=toxicity.BUCKETS + 1), np.append(rng.normal(size=toxicity.BUCKETS), 0))
    layer = np.array([0.4, 0.2, 0.3, 0.1, -0.5])
    texts = ["", "one", "One two, THREE! " * 9, " ".join(f"w{i}" for i in range(33)), " ".join(f"w{i}" for i in range(200)), "z" * 100 + " end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(rows, (net, layer), ["doc_id"]).collect()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    h, p = toxicity.HIDDEN, net.p

    def logit(some):
        x = net.inputs(*toxicity.hashed(toxicity.cores(some))) @ p["wx"] + p["bx"]
        states = np.zeros((len(some), 2 * h))
        for side, (u, order) in enumerate((("uf", range(len(some))), ("ub", range(len(some) - 1, -1, -1)))):
            s = np.zeros(h)
            for t in order:
                xi, su = x[t, side * 3 * h : (side + 1) * 3 * h], s @ p[u]
                new = np.zeros(h)
                for k in range(h):
                    z, r = sig(xi[k] + su[k]), sig(xi[h + k] + su[h + k])
                    n = math.tanh(xi[2 * h + k] + r * su[2 * h + k])
                    new[k] = (1 - z) * n + z * s[k]
                s = new
                states[t, side * h : (side + 1) * h] = s
        e = np.tanh(states @ p["wa"]) @ p["va"]
        w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        return w @ states @ p["wo"] + p["bo"][0]

    for i, text in enumerate(texts):
        own = toxicity.units(text.encode())
        z = sorted((logit(own[a : a + 32]) for a in range(0, max(1, len(own) - 8), 24)), reverse=True) if own else [-4.0]
        x = [z[0], z[1] if len(z) > 1 else z[0], sum(z) / len(z), math.log1p(len(own)), 1]
        assert got[i] == pytest.approx(sig(np.dot(x, layer)), abs=2e-4)


def test_toxicity_trains_on_all_windows_of_whole_texts():
    long = [f"u{i}" for i in range(100)]
    bags = toxicity.Bags([" ".join(long).encode(), b"", b"a b", ("y" * 90).encode()], [0, 1, 1, 0])
    assert bags.size.tolist() == [4, 1, 1] and bags.label.tolist() == [0, 1, 0]
    assert {bags.kinds[i] for i in bags.tokens[:4].ravel() if i < len(bags.kinds)} == {w.encode() for w in long}
    rng = np.random.default_rng(0)
    even = np.bincount(bags.draw(rng, bags.draws(None), np.array([0]), 4000), minlength=6)
    assert (even[:4] > 800).all() and even[4:].sum() == 0
    led = np.bincount(bags.draw(rng, bags.draws(np.array([0, 0, 9, 0, 0, 0.0])), np.array([0]), 4000), minlength=6)
    assert led[2] > 3500 and (led[:4] > 40).all()


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Windows(np.zeros(toxicity.BUCKETS + 1), np.zeros(toxicity.BUCKETS + 1))
    x, m, d = rng.normal(size=(6, 5, 6 * toxicity.HIDDEN)), np.ones((6, 5, 1)), rng.normal(size=5)
    m[4:, 1], m[2:, 3] = 0, 0
    tape = {}
    net.forward(x, m, tape)
    g, dx = net.backward(x, m, tape, d)
    for k in ("uf", "ub", "wa", "va", "wo"):
        i = tuple(rng.integers(0, s) for s in net.p[k].shape)
        net.p[k][i] += 1e-6
        up = net.forward(x, m) @ d
        net.p[k][i] -= 2e-6
        assert (up - net.forward(x, m) @ d) / 2e-6 == pytest.approx(g[k][i], abs=1e-6)
        net.p[k][i] += 1e-6


def test_quality(spark, odd, none):
    docs_, labels = planted(spark)
    out = quality.op10_quality(docs_.unionByName(odd.select("doc_id", "text", "lang").where("doc_id < 0")), labels)
    got = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    assert out.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.7 AS INT)").count() == 0
    assert quality.op10_quality(none, labels).count() == 0
    assert quality.op10_quality(docs_, labels.where("quality = 0")).where("predicted = 1").count() == 0


def test_quality_uses_no_negative_labels(spark):
    docs_, labels = planted(spark)
    every = {r["doc_id"]: r["score"] for r in quality.op10_quality(docs_, labels).collect()}
    good = {r["doc_id"]: r["score"] for r in quality.op10_quality(docs_, labels.where("quality = 1")).collect()}
    assert every == good


def test_quality_matches_brute_force(spark):
    """Scores from features and the network by plain loops."""
    docs_, labels = planted(spark)
    net = quality.fit_quality(docs_, labels)
    rows = docs_.limit(15).unionByName(spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "a \n\n B?", None)], docs_.schema))
    for r in quality.score_quality(rows.withColumn("t", F.col("text")), net, ["t"]).collect():
        x = (quality.features(r["t"].encode() if r["t"] else None).astype(float) - net.center) / net.scale
        hidden = [math.tanh(sum(min(8, max(-8, v)) * net.p[0][i, j] for i, v in enumerate(x)) + net.p[1][j]) for j in range(quality.HIDDEN)]
        z = sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) + net.p[3][0]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


def test_prior_is_estimated_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.6, 0.9):
        draw = lambda n, up: rng.normal(1.2 if up else -1.2, 1, (n, 4))
        n = int(3000 * prior)
        unl = np.vstack([draw(n, True), draw(3000 - n, False)])
        got = quality.estimate_prior(draw(1500, True), rng.permutation(unl))
        assert got == pytest.approx(prior, abs=0.07)


def test_risk_gradients():
    """Both cases of the negatives' part: above zero the risk's slope, below zero that of the part turned round."""
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(size=(20, 6)), rng.normal(size=(30, 6))
    seen = set()
    for prior in (0.5, 0.98):
        for far in (0, 3):
            net = quality.Network(np.zeros(6), np.ones(6), rng)
            net.p[3][0] = far
            shifted = unl - far * net.p[0][:, 0]
            negative = lambda: np.logaddexp(0, net.logits(shifted)).mean() - prior * np.logaddexp(0, net.logits(pos)).mean()  # noqa: B023, E731
            whole = lambda: prior * np.logaddexp(0, -net.logits(pos)).mean() + negative()  # noqa: B023, E731
            risk, g = quality.risk_gradients(net, pos, shifted, prior)
            below = negative() < 0
            seen.add(below)
            assert risk == pytest.approx(prior * np.logaddexp(0, -net.logits(pos)).mean() + max(0, negative()))
            of = (lambda: -negative()) if below else whole
            net.p[2][3] += 1e-6
            up = of()
            net.p[2][3] -= 2e-6
            assert (up - of()) / 2e-6 == pytest.approx(g[2][3], abs=1e-6)
    assert seen == {True, False}


def test_toxicity_sample_is_bounded_by_bytes(spark, docs, monkeypatch):
    """A giant text in the sample doesn't reach the driver, though it counts and is scored."""
    assert toxicity.longest_within({3: 10, 5: 40, 9: 1000}, 60) == 256 and toxicity.longest_within({3: 10}, 60) == 1 << 62 and toxicity.longest_within({3: 100}, 60) == 4
    rows = spark.createDataFrame([(i, f"word{i % 7} bad{i % 2} text") for i in range(40)] + [(99, "bad1 " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "doc_id long, toxic int")
    seen = []
    bags = toxicity.Bags
    monkeypatch.setattr(toxicity, "Bags", lambda texts, y: seen.append(max(map(len, texts))) or bags(texts, y))
    model = toxicity.fit_toxicity(rows, labels, steps=20, most_bytes=4000)
    assert seen and seen[0] < 100
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(rows, model, ["doc_id"]).collect()}.keys() == {*range(40), 99}


# --- pipeline ---


CLASHES = {"row": "r", "taken": -1, "m_size": 7, "t_key": "k", "label": 1, "lang_pred": "zz", "predicted": 0, "n": 0, "target": 2.5}


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def messy(spark, docs):
    """Documents with nulls in any column, empty texts, repeated rows, and columns named like the operators' own."""
    few = docs.where("doc_id < 120")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "no id here at all the of and", None, None, 3), (-7, "one two", "en", None, 7), (-7, "one two", "en", None, 7), (-9, "x" * 40_000, None, "s", 40_000)], few.schema)
    return common.written(spark, few.unionByName(few.where("doc_id < 20")).unionByName(odd).withColumns({k: F.lit(x) for k, x in CLASHES.items()}), "messy")


@pytest.mark.parametrize("name", ["quality", "language", "dedup", "mix"])
def test_stages_keep_columns_and_bear_odd_rows(spark, messy, name):
    got = stage(name)(spark, messy, SMALL)
    assert got.columns == messy.columns and got.dtypes == messy.dtypes
    for r in got.collect():
        assert (r["row"], r["taken"], r["m_size"], r["t_key"], r["label"], r["lang_pred"], r["predicted"], r["n"], r["target"]) == ("r", -1, 7, "k", 1, "zz", 0, 0, 2.5)
    assert stage(name)(spark, messy.limit(0), SMALL).count() == 0


def test_encode_stage_bears_odd_rows(spark, messy):
    v = lattice.vocabulary(common.PIECE_MODEL)
    got = stage("encode")(spark, messy, SMALL).collect()
    assert len(got) == messy.count()
    for r in got:
        assert r["ids"] is None if r["text"] is None else len(r["text"]) > 2000 or r["ids"] == brute_encoding(v, r["text"])
        assert (r["row"], r["t_key"]) == ("r", "k")
    assert stage("encode")(spark, messy.limit(0), SMALL).count() == 0


def test_dedup_and_mix_stages_match_brute_force(spark, messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    comps = {d: c for d, _, c in brute_components(rows) if d is not None}
    got = stage("dedup")(spark, messy, SMALL)
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted({d for d, c in comps.items() if d == c})
    assert got.where("doc_id IS NULL").count() == sum(d is None for d, _ in rows)
    plan = collections.Counter()
    for r in mixing.mix(messy).collect():
        plan[r["doc_id"]] += r["taken"]
    mixed = collections.Counter()
    for r in stage("mix")(spark, messy, SMALL).collect():
        mixed[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert +plan == mixed


def test_quality_and_language_stages_follow_their_operators(spark, messy):
    net = quality.fit_quality(messy.select("doc_id", "text"), common.table(spark, SMALL, "labels"))
    good = {r["doc_id"] for r in quality.score_quality(messy, net, ["doc_id"]).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in stage("quality")(spark, messy, SMALL).collect()} == good
    models = langid.fit_languages(messy.select("doc_id", "text", "lang"))
    least = langid.least_gains(messy.select("doc_id", "text", "lang"), models)
    rows = langid.predict_languages(messy.select("doc_id", "text"), models).where("lang_pred <> 'und' AND score >= 0.5").collect()
    found = {r["doc_id"] for r in rows if r["gain"] >= least[r["lang_pred"]]}
    texts = {r["doc_id"]: r["text"] for r in messy.select("doc_id", "text").collect()}
    # what goes has a word or two, or isn't in a language
    assert all(d in (-9, None) or len(texts[d]) < 40 for d in {r["doc_id"] for r in rows} - found)
    kept = {r["doc_id"] for r in stage("language")(spark, messy, SMALL).collect()}
    assert kept == found and not kept & {-1, -2}


@pytest.mark.parametrize("name", ["quality", "language", "dedup", "mix", "encode"])
def test_stages_bear_columns_with_dots_and_quotes(spark, docs, name):
    rows = docs.where("doc_id < 60").withColumns({"a.b": F.lit(1), "c`d": F.struct(F.lit(2).alias("e.f"))})
    got = stage(name)(spark, common.written(spark, rows, "dots"), SMALL)
    assert got.columns == rows.columns + ["ids"] * (name == "encode")
    kept = common.written(spark, got, "dots").collect()
    assert kept and all(r["a.b"] == 1 and r["c`d"]["e.f"] == 2 for r in kept)


def test_language_stage_rejects_noise_and_other_languages(spark, docs):
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 90))) for _ in range(50)]
    greek = [" ".join("".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 90))) for _ in range(20)]
    finnish = ["suomen kieli on uralilainen kieli jota puhutaan pääasiassa suomessa ja ruotsissa sekä virossa"]
    more = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(noise + greek + finnish)], docs.schema)
    kept = {r["doc_id"] for r in stage("language")(spark, common.written(spark, docs.unionAll(more), "noisy"), SMALL).collect()}
    mine = {r["doc_id"] for r in docs.where("text RLIKE '[A-Za-z]'").collect()}
    assert not any(d >= 10**6 for d in kept) and len(mine - kept) <= 0.01 * len(mine)


@pytest.mark.parametrize("text, letters", [("½ ² ①", False), ("١٢٣", False), ("_ 12 %", False), ("é", True), ("日", True), ("ʰ", True), ("12a", True), ("Ⅷ", False)])
def test_letters_are_letter_categories(text, letters):
    assert langid.has_letter(text.encode()) == letters


def test_pipeline(spark, docs):
    import corpus_pipeline

    kept = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, common.written(spark, stage(spark, kept, SMALL), "test")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert sorted(kept.columns) == sorted(docs.columns)
        if i < 3:
            assert kept.join(before, "doc_id", "left_anti").count() == 0
    assert kept.where("size(ids) = 0").count() == 0 and kept.count() > 0
    stays = {r["doc_id"] for r in kept.select("doc_id").collect()}
    comps = {r["doc_id"]: r["component_id"] for r in dedup.op1_near_dedup(docs).collect()}
    assert len({comps[d] for d in stays}) == len(stays)
