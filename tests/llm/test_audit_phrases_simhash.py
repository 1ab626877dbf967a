"""The filter audit, collocations and SimHash near-dedup against plain Python, and their edge cases."""

import collections
import itertools
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import audit, common, phrases, simhash

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def frame(spark, rows, kind):
    common.ready(spark)
    return spark.createDataFrame(rows, kind)


# --- op11 ---


def brute_audit(rows, labels):
    """Every order and step by going through all documents."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    docs = collections.defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t.encode())
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs[s or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, own in docs.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = list(own), []
            for i, f in enumerate(order):
                now, left = [x for x in left if x[0][f]], [x for x in left if not x[0][f]]
                total[f] += len(now)
                unique = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                out[part, "".join(order), i + 1] = [len(left), len(now), sum(x[0][f] for x in gone), unique, sum(x[1] for x in now), sum(x[2] for x in now)]
                gone += now
        for (p, order, i), x in out.items():
            if p == part:
                x.append(total[order[i - 1]])
    return out


def audited(docs, labels):
    rows = audit.op11_audit(docs, labels).collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_matches_brute_force(spark):
    rng = random.Random(2)
    long = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    texts = [None, "", " \n ", "one two", "AB cd", "a|b " * 300, "x " * 300, "É" * 30 + "A", long(200, 5000), long(199, 5000), long(400, 150), "A" + long(250, 9000) + " %", "\U0001f600" * 49 + "A" + " b"]
    rows = [(i if rng.random() < 0.9 else rng.choice([None, 3, 4]), rng.choice(texts), rng.choice(["a", "b", "c", "", None])) for i in range(300)]
    rows += [(500, texts[5], "a")] * 40 + [(501, texts[5], "a")] * 3 + [(-9, texts[5], "z")]
    labels = [(rng.choice([*range(300), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(250)] + [(500, 1, 1), (500, 0, 0)]
    docs = frame(spark, rows, "doc_id long, text string, source string").withColumns({"part": F.lit("p"), "fail_a": F.lit(True), "th": F.lit("t"), "docs": F.lit(7), "good": F.lit(1)})
    marks = frame(spark, labels, "doc_id long, quality int, toxic int").withColumns({"q": F.lit(5), "text": F.lit("x")})
    want = brute_audit(rows, labels)
    assert audited(docs, marks) == want and len(want) == 600 * 5
    # no document is lost or counted twice on the way
    for part, n in collections.Counter(s or "" for _, _, s in rows).items():
        assert want[part, "ABCDE", 1][0] + want[part, "ABCDE", 1][1] == n
    assert audited(docs, marks.limit(0)) == brute_audit(rows, [])
    assert audit.op11_audit(docs.limit(0), marks).count() == 0


# --- op12 ---


def brute_phrases(rows, least, most=4, top=2000):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or b"").lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, own in f.items():
        rows = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if any(q[i : i + len(p)] == p for q, c in own.items() if len(q) > len(p) and 100 * c >= 80 * a and c >= least for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, b" ".join(p), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p, -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(docs, **how):
    rows = phrases.collocations(docs, **how).withColumn("phrase", F.col("phrase").cast("binary")).collect()
    return sorted((r["lang"], r["rank"], bytes(r["phrase"]), r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows)


def sentences(rng, n, kinds):
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b", "\x1c", "\xa0"]
    return "".join(rng.choice(kinds) + rng.choice(ends) for _ in range(n))


@pytest.mark.parametrize("least, top, marks", [(3, 2000, phrases.MARKS), (5, 7, phrases.MARKS), (2, 50, 64)])
def test_phrases_match_brute_force(spark, monkeypatch, least, top, marks):
    """Also with a bitmap so small that nearly all bits are set, and with stretches cut after a few words."""
    monkeypatch.setattr(phrases, "STRETCH", 64)
    rng = random.Random(least)
    kinds = ["a", "B", "new", "york", "City", "é", "日本", "x" * 90, "of", "the", "the", "a'b", "--"]
    rows = [(rng.choice(["en", "fr", None, "und"]), sentences(rng, rng.randrange(60), kinds)) for _ in range(60)]
    rows += [("en", None), (None, ""), ("en", "new york city " * 40), ("fr", "a a a a a a a"), ("fr", "a a a a a a a"), ("de", " . ,\n"), ("en", "x" * 5000 + " new york")]
    docs = frame(spark, rows, "lang string, text string").withColumns({"phrase": F.lit("p"), "n": F.lit(1), "part": F.lit("x"), "f": F.lit(2)})
    odd = spark.sql("SELECT 'en' AS lang, cast(X'FF2061FE' AS string) AS text, 'p' AS phrase, 1 AS n, 'x' AS part, 2 AS f FROM range(6)")
    want = brute_phrases([(lang, None if t is None else t.encode()) for lang, t in rows] + [("en", b"\xff a\xfe")] * 6, least, top=top)
    got = mined(docs.unionAll(odd), least=least, top=top, marks=marks)
    assert got == want and len(got) > 10
    assert phrases.op12_phrases(docs.limit(0)).count() == 0


def test_phrases_cut_texts_anywhere(monkeypatch):
    """Whatever the stretches, each run of words is seen once."""
    rng = random.Random(1)
    text = sentences(rng, 300, ["ab", "c", "defg" * 9, "é"]).lower().encode()
    for size in (1, 7, 50, 1 << 18):
        monkeypatch.setattr(phrases, "STRETCH", size)
        for n in (1, 2, 4):
            seen = []
            for start, stop, h, piece, new in phrases.stretches(text):
                at = phrases.frequent_runs(h, piece, n, n, phrases.np.full(1, 2**64 - 1, phrases.np.uint64), phrases.np.uint64(5), new)
                seen += phrases.strings(text, start, stop, at, n)
            want = [b" ".join(w[i : i + n]) for p in re.split(rb"[.,;:!?\x0A-\x0D]", text) for w in [re.findall(rb"[^\x20\x09]+", p)] for i in range(len(w) - n + 1)]
            assert sorted(seen) == sorted(want)


# --- op13 ---


def brute_simhash(text):
    import xxhash

    w = WORD.findall((text or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)] or ([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_links(rows):
    """Least doc_id reachable, over (doc_id, fingerprint) rows."""
    label = {d: d for d, _ in rows if d is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    known = [(d, f) for d, f in rows if d is not None]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if (x ^ y).bit_count() <= 4:
                lo, hi = sorted((find(a), find(b)))
                label[hi] = lo
    return {d: find(d) for d in label}


def test_simhash_of_texts(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = [None, "", " \t ", "one", "One  two\nthree", "a b c d", "a b c d e", "É é ß", "x" * 3000, " ".join(base)]
    for _ in range(30):
        near = list(base)
        near[rng.randrange(150)] = "zz"
        texts.append(" ".join(near))
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "one"), (4, "other words than before"), (None, "one"), (None, None), (7, "É é ß"), (-5, "One two three")]
    docs = frame(spark, rows, "doc_id long, text string").withColumns({"node": F.lit(3), "label": F.lit("l"), "key": F.lit(1), "fingerprint": F.lit("f")})
    for size in (1 << 18, 40):
        monkeypatch.setattr(simhash, "STRETCH", size)
        assert all(simhash.simhash(None if t is None else t.encode()) % 2**64 == brute_simhash(t) for t in texts)
    got = simhash.op13_simhash(docs).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted((d is None, d or 0, f"{brute_simhash(t):016x}") for d, t in rows)
    want = brute_links([(d, brute_simhash(t)) for d, t in rows])
    assert {(r["doc_id"], r["component_id"]) for r in got} == {*want.items(), (None, None)}
    assert simhash.op13_simhash(docs.limit(0)).count() == 0
    assert simhash.simhash(b"a \xff b c d") is not None


def test_pigeonring_misses_no_link():
    """Of two values at most 4 bits apart, some segment begins runs within budget, and they share an index key; by column
    functions and by loops."""
    rng = random.Random(8)
    spans = [range(s, s + n) for s, n in simhash.RING]
    assert sorted(b for s in spans for b in s) == list(range(64))
    for _ in range(3000):
        flips = {rng.randrange(64) for _ in range(rng.randrange(5))}
        steps = [[sum(b in flips for b in spans[(i + j) % 5]) for j in range(5)] for i in range(5)]
        starts = [i for i, s in enumerate(steps) if all(sum(s[: n + 1]) <= 4 * (n + 1) // 5 for n in range(5))]
        assert starts and all(steps[i][0] == 0 and steps[i][1] <= 1 for i in starts)


@pytest.mark.parametrize("small, minor", [(24, 64), (2, 64), (2, 0)])
def test_simhash_links_match_brute_force(spark, monkeypatch, small, minor):
    """Chains, dense groups and lone values, through small buckets, minorities and midpoints."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "MINOR", minor)
    rng = random.Random(small + minor)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    values = [rng.getrandbits(64) for _ in range(60)] + [0, 1, 2**64 - 1]
    for _ in range(6):
        x = rng.getrandbits(64)
        values += [flip(x, rng.randrange(1, 6)) for _ in range(25)]
        for _ in range(8):
            x = flip(x, 4)
            values.append(x)
        values += [flip(x, 5), flip(x, 9)]
    rows = [(i, v) for i, v in enumerate(values)] + [(1000 + i, v) for i, v in enumerate(values[::7])] + [(5, values[40])]
    rng.shuffle(rows)
    made = frame(spark, [(d, simhash.signed(v)) for d, v in rows], "doc_id long, node long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "node"))
    got = simhash.near_simhash(made.withColumn("text", F.lit("")))
    want = brute_links(rows)
    # rows of one doc_id are one document
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want and len(set(want.values())) > 40


# --- SQL ---


@pytest.mark.parametrize("name", ["op11_audit", "op12_phrases"])
def test_sql_gives_the_same_rows(spark, name):
    from ledgerlens.llm import queries

    got = queries.queries()[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    assert sorted(map(tuple, got[sorted(got)].astype(str).values)) == sorted(map(tuple, want[sorted(want)].astype(str).values))
