"""More registered queries: statistics by column, metrics, the experiment log, graphs, streams, whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, embedding, experiments, forest, graph, metrics, sequence, splits, stacking, stats, validate
from ..operators.experiments import TECHNIQUES
from ..sources.scratch import scratch_path
from . import queries as base
from .queries import _LOG, _SC, _TH, EVENTS, LINES, SPLIT, events, lines, log, query, r, read, rounded, scored, split_events

# --- statistics by column ---

# of one numeric column {c} of {t}: values are bins up to ten of them, else quantile bins closed on the left
_BINS = """(SELECT label, {c} AS x, CASE WHEN (SELECT count(DISTINCT {c}) FROM {t}) <= 10 THEN CAST({c} AS DOUBLE) ELSE len(list_filter(b, lambda z: z <= {c})) END AS bin
  FROM {t}, (SELECT list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS b FROM {t}) WHERE {c} IS NOT NULL)"""
_IV = """(SELECT coalesce(sum((q - p) * ln(q / p)), 0) FROM (SELECT greatest(sum(1 - label) / any_value(tq), 1e-6) AS q, greatest(sum(label) / any_value(tp), 1e-6) AS p
  FROM (SELECT *, sum(label) OVER () AS tp, sum(1 - label) OVER () AS tq FROM {bins}) GROUP BY bin))"""
_AUC = """(SELECT sum(p * (cq - q / 2)) / (sum(p) * sum(q)) FROM (SELECT *, sum(q) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS cq FROM (SELECT {x} AS x, sum(label) AS p, sum(1 - label) AS q FROM {t} GROUP BY 1)))"""
_GRADE = "CASE WHEN {iv} > .5 AND {n} > 50 THEN 'high_card' WHEN {iv} > .5 THEN 'LEAK?' WHEN {iv} > .3 THEN 'strong' WHEN {iv} > .1 THEN 'medium' WHEN {iv} > .02 THEN 'weak' ELSE 'none' END"


def _analysis(table: str, numbers: list[str], texts: list[str]) -> str:
    """DuckDB form of `stats.analyze`, one row a column."""
    out = []
    for c in numbers + texts:
        bins = _BINS.format(c=c, t=table) if c in numbers else f"(SELECT label, {c} AS bin FROM {table} WHERE {c} IS NOT NULL)"
        auc = _AUC.format(x=f"coalesce({c}, (SELECT median(CAST({c} AS DOUBLE)) FROM {table}))", t=table) if c in numbers else "0.5"
        out.append(f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {table}) AS n_unique, (SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) FROM {table}) AS null_rate,
  CASE WHEN (SELECT count({c}) FROM {table}) < 50 THEN 0 ELSE {_IV.format(bins=bins)} END AS iv, {auc} AS a,
  (SELECT (1 + sum(CASE WHEN {c} IS NULL THEN label ELSE 0 END) / sum(label) - sum(CASE WHEN {c} IS NULL THEN 1 - label ELSE 0 END) / sum(1 - label)) / 2 FROM {table}) AS na""")
    return f"""SELECT "column", n_unique, round(null_rate, 4) AS null_rate, round(iv, 4) AS iv, {_GRADE.format(iv='iv', n='n_unique')} AS grade, round(greatest(a, 1 - a), 4) AS auc,
  round(CASE WHEN null_rate > 0.001 AND null_rate < 0.999 THEN greatest(na, 1 - na) ELSE 0.5 END, 4) AS null_auc FROM ({' UNION ALL '.join(out)})"""


@query("m12_analyze", f"WITH {LINES} " + _analysis("l", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "t_us"], ["l_linestatus"]))
def _m12(s: SparkSession, d: str) -> DataFrame:
    return stats.analyze(lines(s, d), "label", without=("l_orderkey",))


_NULLS = "x AS (SELECT label, user_id, CASE WHEN k % 7 > 0 THEN value END AS v, CASE WHEN k % 3 = 0 THEN k END AS w, CASE WHEN event_id % 60 = 0 THEN value END AS u, CASE WHEN k % 2 = 0 THEN 'a' || k % 5 END AS t FROM e)"


@query("m2_m9_m10_m11_nulls", f"WITH {EVENTS}, {_NULLS} " + _analysis("x", ["user_id", "v", "w", "u"], ["t"]))
def _m2(s: SparkSession, d: str) -> DataFrame:
    k, v = F.col("k"), F.col("value")
    df = events(s, d).select("label", "user_id", F.when(k % 7 > 0, v).alias("v"), F.when(k % 3 == 0, k).alias("w"), F.when(F.col("event_id") % 60 == 0, v).alias("u"), F.when(k % 2 == 0, F.concat(F.lit("a"), (k % 5).cast("string"))).alias("t"))
    return stats.analyze(df, "label")


@query("x17_lost_and_dead", f"WITH {EVENTS}, {_NULLS}, a AS ({_analysis('x', ['user_id', 'v', 'w', 'u'], ['t'])}) SELECT \"column\", CASE WHEN null_rate > 0.5 AND (iv > 0.05 OR null_auc > 0.55) THEN 1 ELSE 0 END AS lost, CASE WHEN iv < 0.005 AND null_rate < 0.5 THEN 1 ELSE 0 END AS dead FROM a")
def _x17(s: SparkSession, d: str) -> DataFrame:
    a = _m2(s, d)
    lost, dead = (f(a).select("column", F.lit(1).alias(n)) for f, n in ((experiments.lost_signal, "lost"), (experiments.dead_features, "dead")))
    return a.select("column").join(lost, "column", "left").join(dead, "column", "left").na.fill(0)


_PSI = """(SELECT coalesce(sum((a - e) * ln(a / e)), 0) FROM (SELECT greatest(count(*) FILTER (split = 'train') / any_value(te), 1e-6) AS e, greatest(count(*) FILTER (split = '{other}') / any_value(ta), 1e-6) AS a FROM (
    SELECT split, count(*) FILTER (split = 'train') OVER () AS te, count(*) FILTER (split = '{other}') OVER () AS ta, len(list_filter(b, lambda z: z <= {c})) AS bin
    FROM s, (SELECT list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS b FROM s WHERE split = 'train') WHERE split IN ('train', '{other}')) GROUP BY bin))"""
_PG = "CASE WHEN psi > 0.25 THEN 'SHIFT!' WHEN psi > 0.1 THEN 'moderate' ELSE 'stable' END"


@query("m14_t3_analyze_features", f"WITH {SPLIT}, tr AS (SELECT * FROM s WHERE split = 'train'), a AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_IV.format(bins=_BINS.format(c=c, t='tr'))} AS iv, {_PSI.format(c=c, other='oot')} AS psi" for c in ("value", "k", "user_id")) + f") SELECT \"column\", round(iv, 4) AS iv, {_GRADE.format(iv='iv', n=0)} AS iv_grade, round(psi, 4) AS psi, {_PG} AS psi_grade FROM a")
def _m14(s: SparkSession, d: str) -> DataFrame:
    df = split_events(s, d)
    return rounded(stats.analyze_features(df.where("split = 'train'"), df.where("split = 'oot'"), "label", ["value", "k", "user_id"]))


@query("m7_score_psi", f"WITH {SPLIT} SELECT round({_PSI.format(c='value', other='val')}, 4) AS psi")
def _m7(s: SparkSession, d: str) -> DataFrame:
    df = split_events(s, d)
    return rounded(metrics.score_psi(df.where("split = 'train'"), df.where("split = 'val'"), "value"))


@query("m18_leaks", f"WITH {EVENTS}, x AS (SELECT label, value, label * 10 + k % 2 AS leaky, -label * 3.0 + CASE WHEN k % 50 = 0 THEN 4 ELSE 0 END AS back, CASE WHEN k % 3 = 0 THEN value END AS partly FROM e), a AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_AUC.format(x=f'coalesce({c}, 0)', t='x')} AS auc" for c in ("value", "leaky", "back", "partly")) + ") SELECT \"column\", round(auc, 6) AS auc FROM a WHERE auc > 0.9 OR auc < 0.1")
def _m18(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    df = events(s, d).select("label", "value", (F.col("label") * 10 + k % 2).alias("leaky"), (F.col("label") * -3.0 + F.when(k % 50 == 0, 4).otherwise(0)).alias("back"), F.when(k % 3 == 0, F.col("value")).alias("partly"), F.lit(1).alias("constant"))
    return rounded(validate.leaks(df, "label", ["value", "leaky", "back", "partly", "constant"]), 6)


_TE = "x AS (SELECT label, split, CASE WHEN split = 'train' THEN label + value / 1000 ELSE value END AS a_te, value AS b_te FROM s)"


@query("m19_encoding_overfit", f"WITH {SPLIT}, {_TE}, t AS (SELECT * FROM x WHERE split = 'train'), v AS (SELECT * FROM x WHERE split = 'val'), g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", abs({_AUC.format(x=c, t='t')} - 0.5) - abs({_AUC.format(x=c, t='v')} - 0.5) AS gap" for c in ("a_te", "b_te")) + ") SELECT \"column\", round(gap, 6) AS gap FROM g WHERE gap > 0.15")
def _m19(s: SparkSession, d: str) -> DataFrame:
    df = split_events(s, d).select("label", "split", F.when(F.col("split") == "train", F.col("label") + F.col("value") / 1000).otherwise(F.col("value")).alias("a_te"), F.col("value").alias("b_te"))
    return rounded(validate.encoding_overfit(df.where("split = 'train'"), df.where("split = 'val'"), "label"), 6)


@query("m22_overfit_report", f"WITH {SPLIT}, t AS (SELECT * FROM s WHERE split = 'train'), v AS (SELECT * FROM s WHERE split = 'val'), a AS (SELECT {_AUC.format(x='value', t='t')} AS a1, {_AUC.format(x='value', t='v')} AS a2), f AS (" + " UNION ALL ".join(f"SELECT 'psi:{c}' AS metric, {_PSI.format(c=c, other='val')} AS value" for c in ("k", "user_id", "t_us")) + f") SELECT metric, round(value, 4) AS value FROM (SELECT 'auroc_train' AS metric, a1 AS value FROM a UNION ALL SELECT 'auroc_val', a2 FROM a UNION ALL SELECT 'auroc_gap', a1 - a2 FROM a UNION ALL SELECT 'score_psi', {_PSI.format(c='value', other='val')} UNION ALL SELECT * FROM f WHERE value > 0.1)")
def _m22(s: SparkSession, d: str) -> DataFrame:
    df = split_events(s, d).withColumn("score", F.col("value"))
    return rounded(metrics.overfit_report(df.where("split = 'train'"), df.where("split = 'val'"), ["k", "user_id", "t_us"]))


@query("m24_lift", f"WITH {_TH} SELECT round((SELECT tp / tk FROM t WHERE tk >= 0.1 * (SELECT sum(k) FROM c) ORDER BY tk LIMIT 1) / ((SELECT sum(p) FROM c) / (SELECT sum(k) FROM c)), 6) AS lift")
def _m24l(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.lift(scored(s, d), 0.1), 6)


@query("m24_gini_by", f"WITH {_SC}, g AS (SELECT l_suppkey % 5 AS grp, score AS x, sum(label) AS p, sum(1 - label) AS q FROM x GROUP BY ALL), c AS (SELECT *, sum(q) OVER (PARTITION BY grp ORDER BY x ROWS UNBOUNDED PRECEDING) AS cq FROM g) SELECT grp, round(2 * sum(p * (cq - q / 2)) / (sum(p) * sum(q)) - 1, 6) AS gini FROM c GROUP BY grp")
def _m24g(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.gini_by(scored(s, d).withColumn("grp", F.col("l_suppkey") % 5), "grp"), 6)


# --- the experiment log ---

@query("x4_decisions", "WITH RECURSIVE " + _LOG + ", f AS (SELECT dataset, seq, score, status = 'crash' AS bad FROM lg), r AS (SELECT dataset, seq, CASE WHEN NOT bad THEN score END AS best, CASE WHEN bad THEN 'reject_psi' ELSE 'keep' END AS decided FROM f WHERE seq = 1 UNION ALL SELECT f.dataset, f.seq, CASE WHEN NOT f.bad AND (best IS NULL OR f.score > best + 0.001) THEN f.score ELSE best END, CASE WHEN f.bad THEN 'reject_psi' WHEN best IS NULL OR f.score > best + 0.001 THEN 'keep' ELSE 'discard' END FROM r JOIN f ON f.dataset = r.dataset AND f.seq = r.seq + 1) SELECT dataset, 'exp_' || lpad(CAST(seq AS VARCHAR), 3, '0') AS id, decided FROM r")
def _x4(s: SparkSession, d: str) -> DataFrame:
    return experiments.decisions(log(s, d), "score", F.col("status") == "crash")


@query("v20_new_best", "WITH RECURSIVE " + _LOG + ", r AS (SELECT dataset, seq, score AS best, 1 AS is_best FROM lg WHERE seq = 1 UNION ALL SELECT n.dataset, n.seq, CASE WHEN n.score > best + 0.0005 THEN n.score ELSE best END, CASE WHEN n.score > best + 0.0005 THEN 1 ELSE 0 END FROM r JOIN lg n ON n.dataset = r.dataset AND n.seq = r.seq + 1) SELECT dataset, seq, is_best FROM r")
def _v20(s: SparkSession, d: str) -> DataFrame:
    ordered = log(s, d).groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("seq", "score"))).alias("a"))
    flags = ordered.select("dataset", "a", sequence.new_best(F.transform("a", lambda x: x["score"])).alias("f"))
    return flags.select("dataset", F.explode(F.arrays_zip("a", "f")).alias("z")).select("dataset", F.col("z.a.seq").alias("seq"), F.col("z.f").cast("int").alias("is_best"))


@query("x6_compare", f"WITH {_LOG}, a AS (SELECT * FROM lg WHERE dataset = 'click' AND seq = 2), b AS (SELECT * FROM lg WHERE dataset = 'click' AND seq = 3) SELECT 'score' AS metric, a.score AS a, b.score AS b, round(b.score - a.score, 6) AS change FROM a, b UNION ALL SELECT 'n_features', a.n_features, b.n_features, b.n_features - a.n_features FROM a, b")
def _x6(s: SparkSession, d: str) -> DataFrame:
    one = log(s, d).where("dataset = 'click'")
    return rounded(experiments.compare(one, "exp_002", "exp_003", ["score", "n_features"]), 6)


_RECIPE = {"15": r"recipe\s*15|construct_uid|\buid_\b|card1_addr1", "16": r"recipe\s*16|window_velocity|vel_(1h|24h|7d|60s|600s)", "17": r"recipe\s*17|rolling_term|term_fraud_28d|term_compromise", "18": r"recipe\s*18|fingerprint", "19": r"recipe\s*19|von[\s_]?mises"}


@query("x8_ambition_report", f"WITH {base._AMBITION.replace('{recent}', 'rc AS (SELECT * FROM b WHERE back <= 30),')}, c AS (SELECT *, lower(nullif(regexp_extract(coalesce(hypothesis, ''), '([\\w-]+)\\s*(?i:campaign\\s+step)\\s*(\\d+)\\s*(?:/|of)\\s*(\\d+)', 1), '')) AS camp FROM y) SELECT dataset, count(*) AS records, round(coalesce(avg(delta) FILTER (prev IS NOT NULL AND n0 > 0), 0), 6) AS mean_delta, CAST(coalesce(max(delta) FILTER (prev IS NOT NULL AND n0 > 0), 0) AS BIGINT) AS max_delta, count(camp) AS tagged, count(DISTINCT camp) AS campaigns, " + ", ".join(f"count(*) FILTER (regexp_matches(coalesce(hypothesis, ''), '(?i){x}')) AS recipe_{n}" for n, x in _RECIPE.items()) + ", " + ", ".join(f"round(avg(CASE WHEN tier = '{t}' THEN 1.0 ELSE 0 END) * 100, 6) AS {t}_pct" for t in ("ambitious", "moderate", "standard")) + " FROM c GROUP BY dataset")
def _x8(s: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.ambition_report(base.ambition_log(s, d)), 6)



_FIRST = [words[0] for words in TECHNIQUES.values()]
_TAGGED = f"""tg AS (SELECT dataset, seq, status, 'Try ' || upper(({_FIRST!r})[seq % {len(_FIRST)} + 1]) AS hypothesis, CASE WHEN seq % 4 = 0 THEN 'merchant_risk_rate amt_cents' ELSE 'x' END AS names FROM lg WHERE status <> 'crash'),
tn AS (SELECT *, lower(hypothesis || ' ' || names) AS s FROM tg),
tt AS ({' UNION ALL '.join(f"SELECT status, '{k}' AS technique FROM tn WHERE " + ' OR '.join(f"contains(s, '{w}')" for w in words) for k, words in TECHNIQUES.items())}
  UNION ALL SELECT status, 'other' FROM tn WHERE NOT ({' OR '.join(f"contains(s, '{w}')" for words in TECHNIQUES.values() for w in words)}))"""


def tagged_log(s: SparkSession, d: str) -> DataFrame:
    """The log with hypotheses that take all families' words in turn, and feature names that tell more."""
    word = F.element_at(F.array(*map(F.lit, _FIRST)), (F.col("seq") % len(_FIRST) + 1).cast("int"))
    names = F.when(F.col("seq") % 4 == 0, F.create_map(F.lit("merchant_risk_rate"), F.lit(0.5), F.lit("amt_cents"), F.lit(0.1))).otherwise(F.create_map(F.lit("x"), F.lit(1.0)))
    return log(s, d).withColumn("hypothesis", F.concat(F.lit("Try "), F.upper(word))).withColumn("top_features", names)


@query("f37_x9_technique_rates_all", f"WITH {_LOG}, {_TAGGED} SELECT technique, count(*) FILTER (status = 'keep') AS keeps, count(*) FILTER (status <> 'keep') AS discards, round(count(*) FILTER (status = 'keep') / count(*), 6) AS rate FROM tt GROUP BY technique")
def _x9(s: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.technique_rates(tagged_log(s, d)), 6)


@query("u4_x10_untried", f"WITH {_LOG}, {_TAGGED} SELECT k.technique FROM (SELECT unnest({list(TECHNIQUES)!r}) AS technique) k WHERE technique <> 'geo_distance' AND technique NOT IN (SELECT technique FROM tt JOIN (SELECT 1) ON status = 'keep')")
def _x10(s: SparkSession, d: str) -> DataFrame:
    return experiments.untried(tagged_log(s, d).where("status = 'keep'"), s, ("geo_distance",))


@query("t10_x11_importance_trend", f"WITH {_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY seq DESC) AS back FROM lg WHERE status = 'keep'), f AS (SELECT dataset, seq, unnest([{{'n': 'f' || seq % 3, 'g': score}}, {{'n': 'steady', 'g': 1.0}}, {{'n': 'count', 'g': n_features * 1.0}}]) AS u FROM k WHERE back <= 5), ends AS (SELECT dataset, min(seq) AS s0, max(seq) AS s1 FROM k WHERE back <= 5 GROUP BY 1), grid AS (SELECT dataset, u.n AS feature, coalesce(max(CASE WHEN seq = s0 THEN u.g END), 0) AS first, coalesce(max(CASE WHEN seq = s1 THEN u.g END), 0) AS last FROM f JOIN ends USING (dataset) GROUP BY ALL) SELECT dataset, feature, first, last, CASE WHEN first = 0 AND last > 0 THEN 'new' WHEN first = 0 THEN 'absent' WHEN last > 1.1 * first THEN 'growing' WHEN last < 0.9 * first THEN 'declining' ELSE 'stable' END AS trend FROM grid")
def _x11(s: SparkSession, d: str) -> DataFrame:
    features = F.create_map(F.concat(F.lit("f"), (F.col("seq") % 3).cast("string")), F.col("score"), F.lit("steady"), F.lit(1.0), F.lit("count"), F.col("n_features").cast("double"))
    return experiments.importance_trend(log(s, d).withColumn("top_features", features))


# --- graphs ---

_PAIRS = "p AS (SELECT DISTINCT o_custkey AS node, CAST(floor(o_totalprice) AS BIGINT) % 500000 AS x FROM orders)"
_STAR = _PAIRS + ", m AS (SELECT x, min(node) AS a FROM p GROUP BY x), l AS (SELECT DISTINCT a, node AS b FROM p JOIN m USING (x) WHERE a <> node), b AS (SELECT a AS s, b AS d FROM l UNION SELECT b, a FROM l)"


@query("f43_distance", f"WITH RECURSIVE {_STAR}, r AS (SELECT min(a) AS node, 0 AS hops FROM l UNION SELECT q.node, r.hops + 1 FROM r JOIN p ON p.node = r.node JOIN p q ON q.x = p.x WHERE r.hops < 40) SELECT node, min(hops) AS hops FROM r WHERE node IS NOT NULL GROUP BY node")
def _f43d(s: SparkSession, d: str) -> DataFrame:
    prices = base.order_prices(s, d)
    return graph.distance_by_shared(prices, "o_custkey", "price", graph.shared_links(prices, "o_custkey", "price").agg(F.min("a").alias("node")))


@query("f43_pagerank_rounds", f"WITH {_STAR}, g AS (SELECT s, d, count(*) OVER (PARTITION BY s) AS deg FROM b), r0 AS (SELECT DISTINCT s AS node, 1.0 AS rank FROM b)" + "".join(f", r{i} AS (SELECT d AS node, 0.15 + 0.85 * sum(rank / deg) AS rank FROM g JOIN r{i - 1} ON s = node GROUP BY d)" for i in range(1, 11)) + " SELECT node, round(rank, 4) AS rank FROM r10")
def _f43p(s: SparkSession, d: str) -> DataFrame:
    return rounded(graph.pagerank(graph.shared_links(base.order_prices(s, d), "o_custkey", "price")))


@query("f43_community_rate", f"WITH RECURSIVE {_STAR}, r AS (SELECT DISTINCT s AS node, s AS other FROM b UNION SELECT r.node, b.d FROM r JOIN b ON r.other = b.s), c AS (SELECT node, min(other) AS component FROM r GROUP BY node) SELECT component, count(DISTINCT o_custkey) AS members, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS rate FROM orders JOIN c ON o_custkey = node GROUP BY component")
def _f43c(s: SparkSession, d: str) -> DataFrame:
    prices = base.order_prices(s, d).withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(graph.community_rate(prices, graph.components(graph.shared_links(prices, "o_custkey", "price")), "o_custkey", "label"), 6)


@query("j11_degree", f"WITH {_PAIRS}, h AS (SELECT x, count(*) - 1 AS others FROM p GROUP BY x) SELECT node AS o_custkey, CAST(sum(others) AS BIGINT) AS links FROM p JOIN h USING (x) GROUP BY node")
def _j11(s: SparkSession, d: str) -> DataFrame:
    return graph.degree_neighbours(base.order_prices(s, d), "o_custkey", "price")


# --- streams: the events as a stream that ends, its rows appended to a table ---


def streamed(s: SparkSession, d: str, name: str, make) -> DataFrame:
    """The rows that a streaming query appends until its input ends."""
    schema = read(s, d, "events").schema
    rows = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")  # a file or a folder of files
    out, state = scratch_path(s, name), scratch_path(s, f"{name}-state")
    timed = rows.select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    made = make(timed)
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(made.schema).parquet(out)


_SEEN = "q AS (SELECT max(ts) AS top FROM events)"


@query("st1_st4_windowed", f"WITH {_SEEN}, w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS f, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL) SELECT user_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS from_ts, n, total FROM w, q WHERE f + INTERVAL 1 HOUR <= top - INTERVAL 10 MINUTE")
def _st1(s: SparkSession, d: str) -> DataFrame:
    from ..streaming.velocity import windowed_velocity

    out = streamed(s, d, "windowed", lambda e: windowed_velocity(e, "user_id", "ts", "value"))
    return out.select("user_id", F.date_format("from_ts", "yyyy-MM-dd HH:mm:ss").alias("from_ts"), "n", r("total", 2).alias("total"))


@query("st2_sessions", f"WITH {_SEEN}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM g), t AS (SELECT user_id, i, min(ts) AS f, max(ts) AS l, count(*) AS n, round(sum(value), 2) AS total FROM i GROUP BY ALL) SELECT user_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS from_ts, n, total FROM t, q WHERE l + INTERVAL 2 HOUR <= top - INTERVAL 10 MINUTE")
def _st2(s: SparkSession, d: str) -> DataFrame:
    from ..streaming.velocity import burst_sessions

    out = streamed(s, d, "sessions", lambda e: burst_sessions(e, "user_id", "ts", "value", "2 hours"))
    return out.select("user_id", F.date_format("from_ts", "yyyy-MM-dd HH:mm:ss").alias("from_ts"), "n", r("total", 2).alias("total"))


@query("st3_prior_velocity", "WITH n AS (SELECT event_id, count(*) OVER w AS n, coalesce(sum(value) OVER w, 0) AS total FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)) SELECT event_id AS row_id, n, round(total, 2) + 0.0 AS total FROM n")
def _st3(s: SparkSession, d: str) -> DataFrame:
    from ..streaming.velocity import prior_velocity

    out = streamed(s, d, "prior", lambda e: prior_velocity(e.withColumn("t", F.unix_micros("ts")), "user_id", "event_id", "t", "value", 86_400_000_000))
    return out.select("row_id", "n", (r("total", 2) + 0.0).alias("total"))


@query("st3_st4_ordered_velocity", f"WITH n AS (SELECT event_id, t, count(*) OVER w AS n, coalesce(sum(value) OVER w, 0) AS total FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)), a AS (SELECT event_id, count(*) OVER v AS n, sum(value) OVER v AS total FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW v AS (PARTITION BY user_id, t ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id AS row_id, n.n - a.n AS n, round(n.total - a.total, 2) + 0.0 AS total FROM n JOIN a USING (event_id) WHERE t < (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 600000000")
def _st3_ordered(s: SparkSession, d: str) -> DataFrame:
    """Events that the watermark has passed, in their own order whatever that of their files."""
    from ..streaming.ordered import ordered_velocity

    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name)
    try:
        out = streamed(s, d, "ordered", lambda e: ordered_velocity(e.withColumn("t", F.unix_micros("ts")), "user_id", "event_id", "t", "value", 86_400_000_000))
    finally:
        s.conf.set(name, before)
    return out.select("row_id", "n", (r("total", 2) + 0.0).alias("total"))


_START = "(CAST('0x' || substr(md5('3|' || d || '|' || user_id), 1, 12) AS BIGINT) / 281474976710656.0)"


@query("f46_embedding", f"""WITH {EVENTS}, m AS (SELECT DISTINCT user_id, 'k' AS a, CAST(k AS VARCHAR) AS v FROM e WHERE k IS NOT NULL UNION SELECT DISTINCT user_id, 'event_type', event_type FROM e WHERE event_type IS NOT NULL),
s0 AS (SELECT user_id, d, CASE WHEN {_START} < 1 / 6.0 THEN sqrt(3) WHEN {_START} >= 5 / 6.0 THEN -sqrt(3) ELSE 0.0 END AS x FROM (SELECT DISTINCT user_id FROM m), range(0, 8) r(d)),
v1 AS (SELECT a, v, d, avg(x) AS x FROM m JOIN s0 USING (user_id) GROUP BY ALL), s1 AS (SELECT user_id, d, avg(x) AS x FROM m JOIN v1 USING (a, v) GROUP BY ALL),
v2 AS (SELECT a, v, d, avg(x) AS x FROM m JOIN s1 USING (user_id) GROUP BY ALL), s2 AS (SELECT user_id, d, avg(x) AS x FROM m JOIN v2 USING (a, v) GROUP BY ALL),
t AS (SELECT s1.user_id, s1.d, s1.x + 0.5 * s2.x AS x FROM s1 JOIN s2 USING (user_id, d))
SELECT user_id, {', '.join(f"round(max(x) FILTER (d = {i}), 6) + 0.0 AS e{i}" for i in range(8))} FROM t GROUP BY user_id""")
def _f46(s: SparkSession, d: str) -> DataFrame:
    out = embedding.embedding(events(s, d), "user_id", ["k", "event_type"], dims=8)
    return out.select("user_id", *((r(f"e{i}", 6) + 0.0).alias(f"e{i}") for i in range(8)))


# --- models ---


@query("d2_boosted_trees")
def _d2(s: SparkSession, d: str) -> DataFrame:
    """Chances that a line is returned, by log loss with class weight and by focal loss, from columns with nulls."""
    df = splits.quantile_split(lines(s, d).withColumns({"l_quantity": F.when(F.col("l_suppkey") % 5 > 0, F.col("l_quantity")), "l_tax": F.when(F.col("l_partkey") % 3 > 0, F.col("l_tax"))}))
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    how = {"rounds": 8, "depth": 3, "rate": 0.3, "every": 4, "patience": 8}
    plain, focal = boosting.fit_booster(df, columns, class_weight=2.0, **how), boosting.fit_booster(df, columns, loss=boosting.focal(), **how)
    both = boosting.score_booster(boosting.score_booster(df, plain, "chance"), focal, "focal_chance")
    return both.select("l_orderkey", "l_linenumber", "split", r("chance", 6).alias("chance"), r("focal_chance", 6).alias("focal_chance"))


@query("d7_isolation_forest")
def _d7(s: SparkSession, d: str) -> DataFrame:
    """How easily random cuts set each line apart."""
    df = lines(s, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    model = forest.fit_forest(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "id", trees=50)
    return forest.score_forest(df, model).select("l_orderkey", "l_linenumber", r("isolation", 6).alias("isolation"))


@query("d7_stacked_models")
def _d7_stack(s: SparkSession, d: str) -> DataFrame:
    """Chances of a second level over out-of-fold scores of two sets of columns."""
    df = splits.quantile_split(lines(s, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")))
    sets = {"by_amount": ["l_quantity", "l_extendedprice"], "by_rate": ["l_discount", "l_tax"]}
    out, _, _ = stacking.stack(df, "id", sets, folds=3, first={"rounds": 3, "depth": 2, "rate": 0.5}, second={"rounds": 4, "depth": 2, "rate": 0.5})
    return out.select("l_orderkey", "l_linenumber", "split", r("by_amount", 6).alias("by_amount"), r("by_rate", 6).alias("by_rate"), r("score", 6).alias("score"))
