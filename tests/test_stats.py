import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import encodings, graph, metrics, profiles, stats, validate


def scored(spark, n=400, seed=2):
    rng = random.Random(seed)
    data = [(i, int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, label int, score double")


def test_auc_and_average_precision(spark):
    data, df = scored(spark)
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(auc)
    assert metrics.roc_auc(df.withColumn("score", -F.col("score"))).first()["auc"] == pytest.approx(1 - auc)
    ap, best = 0.0, (0.0, 0.0)
    for t in sorted({s for *_, s in data}, reverse=True):
        k, tp = sum(s >= t for *_, s in data), sum(s >= t and y for _, y, s in data)
        ap += sum(s == t and y for _, y, s in data) * tp / k / len(pos)
        if tp / len(pos) >= 0.5:
            best = max(best, (tp / k, -t))
    assert metrics.average_precision(df).first()["auprc"] == pytest.approx(ap)
    got = metrics.precision_at_recall(df, 0.5).first()
    assert (got["precision"], got["threshold"]) == pytest.approx((best[0], -best[1]))
    low, high = metrics.bootstrap_ci(df, n=40).first()
    assert low < ap < high


def test_degenerate_metrics(spark):
    _, df = scored(spark)
    one = df.withColumn("label", F.lit(0))
    assert metrics.average_precision(one).first()["auprc"] is None
    assert metrics.precision_at_recall(one, 0.5).first()["threshold"] == 0.5
    same = df.withColumn("score", F.lit(0.5))
    assert metrics.roc_auc(same).first()["auc"] == 0.5


def test_psi_and_iv(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.randrange(2), 1.0) for _ in range(500)], "x double, y int, c double")
    assert {r["column"]: r["psi"] for r in stats.psi(df, df, ["x", "c"]).collect()} == {"x": pytest.approx(0, abs=1e-12), "c": 0}
    assert stats.psi(df, df.withColumn("x", F.col("x") + 2), ["x"]).first()["psi"] > 1
    iv = {r["column"]: r["iv"] for r in stats.information_value(df.withColumn("z", F.col("y").cast("double")), "y", ["x", "c", "z"]).collect()}
    assert iv["c"] == 0 and 0 <= iv["x"] < 0.2 and iv["z"] > 5
    assert stats.information_value(df.limit(20), "y", ["x"], least=50).first()["iv"] == 0
    assert stats.information_value(df.withColumn("y", F.lit(1)), "y", ["x"]).first()["iv"] == 0


def test_composite(spark):
    assert metrics.composite_score(0.5, 0.4, 0.3) == (0.0, True)
    score, rejected = metrics.composite_score(0.5, 0.4, 0.1, gap=0.09)
    assert not rejected and score == pytest.approx(0.5 * 0.5 + 0.25 * 0.4 - 0.05 * 0.5)


def test_encodings(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), (None, 1)], "c string, y int")
    te = {r["c"]: r["te"] for r in encodings.target(df, "c", "y", "te").collect()}
    assert te == {"a": pytest.approx((1 + 20 * 0.5) / 22), "b": pytest.approx((0 + 20 * 0.5) / 21)}
    assert encodings.target(df, "c", "y", "te", nulls="level").count() == 3
    assert {r["c"]: r["f"] for r in encodings.frequency(df, ["c"], "f").collect()} == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
    woe = {r["c"]: r["w"] for r in encodings.weight_of_evidence(df, "c", "y", "w").collect()}
    assert woe["a"] == pytest.approx(math.log(1 / 0.5))


def test_out_of_fold_never_sees_its_own_fold(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)], "id long, c int, y int")
    out = {r["id"]: r["te"] for r in encodings.out_of_fold(df, "id", "c", "y", "te").collect()}
    flipped = df.withColumn("y", F.when(F.col("id") == 7, 1 - F.col("y")).otherwise(F.col("y")))
    new = {r["id"]: r["te"] for r in encodings.out_of_fold(flipped, "id", "c", "y", "te").collect()}
    g = abs(sum(r["y"] for r in df.collect()) - sum(r["y"] for r in flipped.collect())) / 60
    assert out[7] == pytest.approx(new[7], abs=20 * g)


def test_profiles_edge_cases(spark):
    df = spark.createDataFrame([(None, 1.0, 1), ("a", 5.0, 2), ("b", None, 3)], "k string, v double, t long")
    p = {r["k"]: r for r in profiles.entity_profile(df, "k", "v").collect()}
    assert set(p) == {"a", "b"} and p["a"]["std"] == 0.0 and p["b"]["count"] == 0
    out = profiles.lookup(df, profiles.entity_profile(df, "k", "v"), "k", {"mean": -1.0})
    assert out.count() == 3 and out.where("k IS NULL").first()["mean"] == -1.0
    assert profiles.mode_profile(df, "k", "v", "m", 0.0).where("k = 'b'").first()["m"] == 0.0
    assert profiles.gap_stats(df, "k", "t", "t").where("k = 'a'").first()["burst"] == 0


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert graph.components(links.limit(0)).count() == 0
    hops = {r["node"]: r["hops"] for r in graph.distance_to(links, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert hops == {1: 0, 2: 1, 3: 2}


def test_ranks_and_distances_over_shared_values(spark, monkeypatch):
    import numpy as np

    from ledgerlens.plans import metric_queries, queries  # noqa: F401 - registers queries

    # four holders of one value, then a chain of eight more values; 90 and 91 share a value apart, 95 shares none
    pairs = [(k, 100) for k in (1, 2, 3, 4)] + [(k + j, 100 + k) for k in range(4, 12) for j in (0, 1)] + [(90, 500), (91, 500), (95, 600), (2, None), (None, 100), (1, 100)]
    monkeypatch.setattr(queries, "order_prices", lambda s, d: spark.createDataFrame(pairs, "o_custkey long, price long"))
    edges = sorted({p for p in pairs if None not in p})
    nodes = sorted({("e", e) for e, _ in edges} | {("x", x) for _, x in edges})
    m = np.zeros((len(nodes), len(nodes)))
    for e, x in edges:
        i, j = nodes.index(("e", e)), nodes.index(("x", x))
        m[i, j] = m[j, i] = 1
    rank = np.linalg.solve(np.eye(len(nodes)) - 0.85 * m / m.sum(0), np.full(len(nodes), 0.15))
    got = {r["node"]: r["rank"] for r in queries.QUERIES["f43_pagerank"](spark, "").collect()}
    assert got == pytest.approx({k: r for (kind, k), r in zip(nodes, rank, strict=True) if kind == "e"}, abs=1e-4)
    hops = sorted((r["node"], r["hops"]) for r in queries.QUERIES["f43_distance"](spark, "").collect())
    assert hops == [(1, 0), (2, 1), (3, 1), (4, 1)] + [(4 + i, 1 + i) for i in range(1, 9)]
    assert graph.shared_pagerank(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    links = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    assert graph.distance_to(links, spark.createDataFrame([(0,)], "node long")).count() == 7


def test_validation(spark):
    good = spark.createDataFrame([(1.0, 0), (2.0, 1)], "x double, label int")
    assert validate.validate({"train": good, "val": good}, "label") == (True, [])
    bad = spark.createDataFrame([(None, 2, "s")], "x double, label int, z string")
    ok, messages = validate.validate({"train": good, "val": bad}, "label")
    assert not ok and len(messages) == 4
    leaky = good.withColumn("y2", F.col("label") * 3.0)
    assert [r["column"] for r in validate.leaks(leaky.union(leaky), "label", ["x", "y2"]).collect()] == ["x", "y2"]


@pytest.mark.parametrize("most, error", [(10**6, 1e-4), (50, 1e-4), (50, 1e-3), (3, 1e-2)])
def test_quantiles_by_brackets(spark, most, error):
    """Exact at any number of distinct values, with ties, few values and a group of one."""
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randrange(5))) for _ in range(500)] + [("c", 2.0)] + [("a", None)] * 5
    df = spark.createDataFrame(rows, "g string, v double")
    qs = (0.0, 0.1, 0.5, 0.77, 1.0)
    for by in (["g"], []):
        got = {r["g"] if by else None: r for r in stats.quantiles(df, "v", qs, by, most, error).collect()}
        for g, r in got.items():
            own = [v for k, v in rows if v is not None and (k == g or not by)]
            assert r["n_known"] == len(own) and r["quantiles"] == pytest.approx(list(np.quantile(own, qs)), abs=1e-12)
            assert r["n_unique"] == pytest.approx(len(set(own)), rel=0 if len(set(own)) < 1000 else 0.1)
        assert len(got) == (3 if by else 1)
    assert stats.quantiles(df.limit(0), "v", qs).first()["n_known"] == 0


def test_correlation_of_many_columns(spark):
    """500 columns in one plan, against numpy over the rows where both are known; constant columns have none."""
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (60, 500))
    x[:, 1] = -2 * x[:, 0] + 5
    x[:, 2] = 7.0
    x[rng.random((60, 500)) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"c{i} double" for i in range(500)))
    assert [tuple(r) for r in stats.correlation_flags(df, least=0.98).collect()] == [("c0", "c1", 1.0)]
    few = [f"c{i}" for i in (0, 1, 2, 3, 4)]
    got = {(r["a"], r["b"]): r["corr"] for r in stats.correlation_flags(df, few, least=0.0).collect()}
    for i, a in enumerate(few):
        for b in few[i + 1 :]:
            u, v = (x[:, int(c[1:])] for c in (a, b))
            both = ~np.isnan(u) & ~np.isnan(v)
            if "c2" in (a, b):
                assert (a, b) not in got
            else:
                assert got[a, b] == pytest.approx(abs(np.corrcoef(u[both], v[both])[0, 1]), abs=1e-4)


def test_column_profile_counts(spark):
    from ledgerlens.operators import splits

    df = spark.createDataFrame([(1, "a", None), (1, None, None), (2, "a", None)], "x int, `y.z` string, w double")
    got = {r["column"]: (r["n_unique"], r["null_rate"]) for r in splits.column_profile(df).collect()}
    assert got == {"x": (2, 0.0), "y.z": (1, pytest.approx(1 / 3)), "w": (0, 1.0)}
    assert {r["column"]: r["n_unique"] for r in splits.column_profile(df, ["x", "w"], exact=False).collect()} == {"x": 2, "w": 0}
    assert [tuple(r) for r in splits.column_profile(df.limit(0), ["x"]).collect()] == [("x", 0, None)]


def test_embedding_is_a_matrix_product(spark):
    from ledgerlens.operators import embedding

    rng = random.Random(9)
    rows = [(rng.randrange(30), rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, 4, None])) for _ in range(90)] + [(None, "a", 1), (77, None, None), (50, "a", 2), (51, "a", 2), (51, "a", 2)]
    df = spark.createDataFrame(rows, "who long, p string, q int")
    got = {r["who"]: list(r)[1:] for r in embedding.embedding(df, "who", ["p", "q"], dims=6, weights=(0.5, 1.0, 2.0)).collect()}
    held = {(w, n, str(v)) for w, p, q in rows if w is not None for n, v in (("p", p), ("q", q)) if v is not None}
    people, values = sorted({w for w, *_ in held}), sorted({(n, v) for _, n, v in held})
    b = np.array([[(w, *v) in held for v in values] for w in people], float)
    start = spark.createDataFrame([(w,) for w in people], "w long").select("w", *(embedding.starting(F.col("w"), i, 3) for i in range(6))).orderBy("w").collect()
    x = np.array([list(r)[1:] for r in start])
    step = (b / b.sum(1, keepdims=True)) @ (b / b.sum(0)).T
    want = 0.5 * x + step @ x + 2 * step @ step @ x
    assert sorted(got) == people and np.allclose([got[w] for w in people], want) and 77 not in got
    # who holds the same values has the same rounds
    alone = {r["who"]: list(r)[1:] for r in embedding.embedding(df, "who", ["p", "q"], dims=6, weights=(0.0, 1.0)).collect()}
    assert alone[50] == pytest.approx(alone[51]) and len(np.unique(np.round(x, 6))) <= 3
    assert embedding.embedding(df.limit(0), "who", ["p"]).count() == 0
