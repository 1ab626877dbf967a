"""More registered queries: sources and sinks, columns, scalar features, profiles and windows with all their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars, signals, text
from ..operators import anomaly, dominance, encodings, profiles, sequence, splits, stats, velocity
from ..schema import DAY, EventSchema, feature_columns, text_columns
from ..sources import cache, readers, sinks
from ..sources.scratch import scratch_path
from .queries import EVENTS, LINES, ORDERS, SPLIT, events, lines, orders, query, r, read, rounded, split_events

#: Added before rounding where a quotient may lie halfway between two digits, which engines round by its last bit.
OFF = 1.37e-7

# --- sources and sinks: written, read again ---


@query("s1_s8_split_files", f"WITH {SPLIT} SELECT event_id, value, split FROM s")
def _s1(s: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(s, "split-files")
    sinks.write_splits(split_events(s, d), folder, "events")
    return readers.read_splits(s, folder, "events").select("event_id", "value", "split")


@query("s2_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _s2(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "csv")
    read(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.csv(path, header=True)
    return readers.read_csv(s, path, "s_suppkey long, s_name string, s_acctbal double")


@query("s3_s10_tsv", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation")
def _s3(s: SparkSession, d: str) -> DataFrame:
    """A table of 25 rows by definition, appended to a log one record at a time, in parts."""
    path, fields = scratch_path(s, "tsv"), ["n_nationkey", "n_name", "n_regionkey"]
    for row in read(s, d, "nation").select(*fields).collect():
        sinks.append_tsv(s, path, fields, row.asDict())
    return readers.read_tsv(s, f"{path}/records", "n_nationkey int, n_name string, n_regionkey int")



@query("s4_s9_x19_json_lines", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 5 > 1 THEN round(value / 3, 6) END AS x FROM e")
def _s4(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "json-lines")
    odd = F.when(F.col("k") % 5 == 0, float("nan")).when(F.col("k") % 5 == 1, float("inf")).otherwise(F.col("value") / 3)
    sinks.write_json_lines(events(s, d).select("event_id", odd.alias("x")), path)
    return readers.read_log(s, path, "event_id long, x double")


@query("s6_s7_t7_cache", "SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def _s6(s: SparkSession, d: str) -> DataFrame:
    """The second call gets the first one's rows; after the third made the key anew, its first 100 rows are there."""
    folder, key = scratch_path(s, "cache"), cache.cache_key("SELECT", "all", "train", "2024-01-01", "2024-12-31")
    rows = read(s, d, "events").select("event_id")
    cache.cached(s, folder, key, lambda: rows.where("event_id < 0"))
    if cache.cached(s, folder, key, lambda: rows).isEmpty():
        cache.invalidate(s, folder, key)
    return cache.cached(s, folder, key, lambda: rows, 100, ["event_id"])


# --- columns ---


@query("p1_p2_p3_columns", "SELECT l_orderkey AS order_id, l_quantity AS quantity, l_tax, 1 AS V1x FROM lineitem")
def _p1(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax", F.lit(1).alias("V1x"), F.lit(2).alias("V12"), F.lit(3).alias("D1"), F.lit(4).alias("M003"), F.lit(5).alias("gone"))
    return splits.without_derived(df).drop("gone", "absent").withColumnsRenamed({"l_orderkey": "order_id", "l_quantity": "quantity"})


_P9 = """x AS (SELECT user_id, 1 AS one, CASE WHEN event_id % 500 = 0 THEN k % 3 END AS rare, CASE WHEN event_id % 3 = 0 THEN value END AS third FROM e)"""


@query("p9_p10_drops", f"WITH {EVENTS}, {_P9}, p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS u, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM x" for c in ("user_id", "one", "rare", "third")) + ") SELECT \"column\", CASE WHEN u <= 1 OR (r > 0.99 AND u <= 5) THEN 1 ELSE 0 END AS uninformative, CASE WHEN r > 0.5 THEN 1 ELSE 0 END AS mostly_null FROM p")
def _p9(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d).select("user_id", F.lit(1).alias("one"), F.when(F.col("event_id") % 500 == 0, F.col("k") % 3).alias("rare"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("third"))
    profile = splits.column_profile(df)
    few, null = splits.uninformative(profile), splits.mostly_null(profile)
    return s.createDataFrame([(c, int(c in few), int(c in null)) for c in df.columns], "`column` string, uninformative int, mostly_null int")


@query("p11_p12_features", f"WITH {SPLIT} SELECT event_id, user_id AS feature_user_id, event_type AS feature_event_type, value AS feature_value, k AS feature_k, event_type AS texts FROM s")
def _p11(s: SparkSession, d: str) -> DataFrame:
    """The rows by the columns that are features (all but the reserved ones), and by those that are texts."""
    df = split_events(s, d)
    names = feature_columns(df, EventSchema("event_id", "t_us", "value", "label"))
    return df.select("event_id", *(F.col(c).alias(f"feature_{c}") for c in names), F.concat_ws("|", *text_columns(df, without=("split",))).alias("texts"))



@query("p13_p15_fill_clip", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 7 = 0 THEN -1.0 ELSE value END AS filled, CASE WHEN k % 7 <> 0 THEN least(greatest(value, 20.0), 80.0) END AS clipped FROM e")
def _p13(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d).select("event_id", F.when(F.col("k") % 7 != 0, F.col("value")).alias("v"))
    out = df.select("event_id", F.col("v").alias("filled"), splits.clip(F.col("v"), 20.0, 80.0).alias("clipped"))
    return splits.fill_numeric(out.select("event_id", "filled")).join(out.select("event_id", "clipped"), "event_id")


@query("p17_keep_rule", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 10 = 0 THEN 'reject_psi' WHEN k % 4 = 0 OR value / 1000 > 0.05 + 0.001 THEN 'keep' ELSE 'discard' END AS status FROM e")
def _p17(s: SparkSession, d: str) -> DataFrame:
    from ..operators.metrics import keep_rule

    best = F.when(F.col("k") % 4 != 0, F.lit(0.05))
    return events(s, d).select("event_id", keep_rule(F.col("value") / 1000, best, F.col("k") % 10 == 0).alias("status"))


@query("u1_union_by_name", "SELECT c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier")
def _u1(s: SparkSession, d: str) -> DataFrame:
    a = read(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(read(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("t5_worst_nulls", f"WITH {EVENTS}, n AS (SELECT 'a' AS \"column\", avg(CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0 END) AS null_rate FROM e UNION ALL SELECT 'b', avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0 END) FROM e UNION ALL SELECT 'c', avg(CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0 END) FROM e UNION ALL SELECT 'd', avg(CASE WHEN k % 7 = 0 THEN 1.0 ELSE 0 END) FROM e UNION ALL SELECT 'e', avg(CASE WHEN k % 11 = 0 THEN 1.0 ELSE 0 END) FROM e UNION ALL SELECT 'f', avg(CASE WHEN k % 13 = 0 THEN 1.0 ELSE 0 END) FROM e) SELECT \"column\", round(null_rate, 6) AS null_rate FROM n ORDER BY null_rate DESC, \"column\" LIMIT 5")
def _t5(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d).select(*(F.when(F.col("k") % m != 0, F.col("value")).alias(c) for c, m in zip("abcdef", (2, 3, 5, 7, 11, 13), strict=True)))
    worst = splits.last_n(splits.column_profile(df), 5, [F.desc("null_rate"), F.asc("column")])
    return worst.select("column", r("null_rate", 6).alias("null_rate"))


@query("j5_null_safe_lookup", "WITH x AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS st, o_orderpriority AS pr, o_totalprice FROM orders), p AS (SELECT st, pr, avg(o_totalprice) AS m FROM x GROUP BY ALL HAVING count(*) > 100) SELECT o_orderkey, round(coalesce(m, -1), 4) AS m FROM x LEFT JOIN p ON x.st IS NOT DISTINCT FROM p.st AND x.pr IS NOT DISTINCT FROM p.pr")
def _j5(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("st"), F.col("o_orderpriority").alias("pr"), "o_totalprice")
    p = df.groupBy("st", "pr").agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 100").drop("n")
    return profiles.lookup(df, p, ["st", "pr"], {"m": -1.0}, null_safe=True).select("o_orderkey", r("m").alias("m"))


_CENTERS = ((5.0, 10.0), (20.0, 30.0), (45.0, 60.0))


@query("j12_nearest_centroid", "WITH c AS (SELECT l_orderkey, l_linenumber, [" + ", ".join(f"sqrt(pow(l_quantity - {a}, 2) + pow(l_extendedprice / 1000 - {b}, 2))" for a, b in _CENTERS) + "] AS g FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(list_position(g, list_min(g)) - 1 AS INT) AS cluster, round(list_min(g), 6) AS distance FROM c")
def _j12(s: SparkSession, d: str) -> DataFrame:
    near = anomaly.nearest_centroid([F.col("l_quantity"), F.col("l_extendedprice") / 1000], _CENTERS)
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", near["cluster"].alias("cluster"), r(near["distance"], 6).alias("distance"))


# --- scalar features with all outputs ---


@query("f7_f8_amounts", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice / 2) / 100 WHEN o_orderkey % 4 = 1 THEN floor(o_totalprice / 20) ELSE floor(o_totalprice / 10) / 10 END AS a FROM orders) SELECT o_orderkey, " + ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS {n}" for n, c in (("is_round_10", "round(a % 10, 6) < 0.01"), ("is_round_100", "round(a % 100, 6) < 0.01"), ("is_whole", "round(a % 1, 6) = 0"), ("has_cents", "round((a * 100) % 100, 4) > 0.5"), ("below_100", "a >= 95 AND a < 100"), ("below_1000", "a >= 990 AND a < 1000"), ("is_small", "a < 50"), ("is_micro", "a < 1"), ("corridor_90", "a >= 90 AND a < 100"), ("corridor_450", "a >= 450 AND a < 500"), ("corridor_900", "a >= 900 AND a < 1000"))) + ", round((a * 100) % 100, 4) AS cents FROM x")
def _f7(s: SparkSession, d: str) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey") % 4
    df = read(s, d, "orders").select("o_orderkey", F.when(key == 0, F.floor(price / 2) / 100).when(key == 1, F.floor(price / 20)).otherwise(F.floor(price / 10) / 10).alias("a"))
    return df.select("o_orderkey", *(c.alias(n) for n, c in scalars.amount_pattern(F.col("a")).items()))


@query("f10_f22_f23_geo", f"WITH {ORDERS}, x AS (SELECT o_orderkey, o_totalprice AS a, (o_orderkey % 500) * 1.0 AS km, o_orderkey % 7 AS c, (o_orderkey % 3) * 1000 AS pop FROM o) SELECT o_orderkey, round(ln(1 + km), 6) AS log_distance, CASE WHEN km > 200 THEN 1 ELSE 0 END AS is_far, round(ln(1 + a) * ln(1 + km), 6) AS log_amount_x_log_km, round(c * ln(1 + km), 6) AS velocity_x_log_km, round(a / greatest(pop, 1), 6) AS amount_per_head FROM x")
def _f10(s: SparkSession, d: str) -> DataFrame:
    km, key = (F.col("o_orderkey") % 500).cast("double"), F.col("o_orderkey")
    made = scalars.geo_flags(km) | scalars.interactions(F.col("o_totalprice"), km, key % 7, (key % 3) * 1000)
    return rounded(orders(s, d).select("o_orderkey", *(c.alias(n) for n, c in made.items())), 6)


@query("f12_f13_f14_habits", f"WITH {EVENTS}, h AS (SELECT *, (t_us // 3600000000) % 24 AS h FROM e), m AS (SELECT user_id, avg(h) AS mh, coalesce(stddev_samp(h), 0) AS sh, max(value) AS top, median(value) AS med, avg(sin(h * 2 * pi() / 24)) AS ms, avg(cos(h * 2 * pi() / 24)) AS mc FROM h GROUP BY user_id), a AS (SELECT *, 1 - (sin(h * 2 * pi() / 24) * ms + cos(h * 2 * pi() / 24) * mc) / nullif(sqrt(ms * ms + mc * mc), 0) AS ang FROM h JOIN m USING (user_id)) SELECT event_id, round(abs(h - mh) / greatest(sh, 1.0), 6) AS hour_deviation_sigma, CASE WHEN abs(h - mh) / greatest(sh, 1.0) > 2 THEN 1 ELSE 0 END AS is_odd_hour, round(value / greatest(top, 0.01), 6) AS ratio_to_max, round(value / greatest(med, 0.01), 6) AS ratio_to_median, CASE WHEN value > med THEN 1 ELSE 0 END AS above_median, CASE WHEN value > top THEN 1 ELSE 0 END AS is_over_max, CASE WHEN ang > 0.5 AND sqrt(ms * ms + mc * mc) > 0.5 THEN 1 ELSE 0 END AS unusual_hour FROM a")
def _f13(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d).withColumn("hour", F.floor(F.col("t_us") / 3_600_000_000) % 24)
    out = profiles.lookup(df, profiles.entity_profile(df, "user_id", "hour", ("mean", "std"), "h_"), "user_id")
    out = profiles.lookup(out, profiles.entity_profile(df, "user_id", "value", ("max", "median"), "v_"), "user_id")
    out = profiles.lookup(out, profiles.circular_profile(df, "user_id", F.col("hour")), "user_id")
    made = scalars.hour_sigma(F.col("hour"), F.col("h_mean"), F.col("h_std")) | scalars.amount_extremes(F.col("value"), F.col("v_max"), F.col("v_median"))
    made["unusual_hour"] = scalars.is_unusual_hour(scalars.angular_distance(F.col("hour"), F.col("mean_sin"), F.col("mean_cos")), F.col("concentration"))
    return rounded(out.select("event_id", *(c.alias(n) for n, c in made.items())), 6)


@query("f16_f17_f18_f19_money", "WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS a, l_extendedprice AS o, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE l_quantity END AS n, CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE l_tax END AS o2, l_extendedprice AS n2, ['CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER', 'OTHER'][l_linenumber % 6 + 1] AS k, CAST(l_orderkey AS BIGINT) AS step FROM lineitem) SELECT l_orderkey, l_linenumber, round(abs(o - n - a), 4) AS orig_balance_error, round(abs(n2 - o2 - a), 4) AS dest_balance_error, round(ln(1 + abs(o - n - a)), 6) AS log_orig_balance_error, round(ln(1 + abs(n2 - o2 - a)), 6) AS log_dest_balance_error, CAST(n = 0 AS INT) AS orig_after_zero, CAST(o = 0 AS INT) AS orig_was_zero, CAST(o2 = 0 AS INT) AS dest_was_zero, CAST(a > o + 1 AS INT) AS amount_exceeds, round(a / (o + 1), 6) AS amount_to_balance, CASE k WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3 WHEN 'TRANSFER' THEN 4 ELSE -1 END AS type_enc, CAST(k = 'TRANSFER' AS INT) AS is_transfer, CAST(k = 'CASH_OUT' AS INT) AS is_cash_out, CAST(k IN ('TRANSFER', 'CASH_OUT') AS INT) AS is_fraud_type, step % 24 AS step_mod_24, step % 168 AS step_mod_168, step // 24 AS step_bin_day FROM x")
def _f16(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, (*scalars.TYPE_ORDER, "OTHER"))), (n % 6 + 1).cast("int"))
    old, amount = F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount")
    b = scalars.balance_features(amount, old, F.when(n % 3 == 0, 0.0).otherwise(F.col("l_quantity")), F.when(n % 2 == 0, 0.0).otherwise(F.col("l_tax")), old)
    b = {k: F.round(c, 4 if k.endswith("error") and not k.startswith("log") else 6) if k not in ("orig_after_zero", "orig_was_zero", "dest_was_zero", "amount_exceeds") else c for k, c in b.items()}
    made = b | scalars.type_features(kind) | scalars.step_features(F.col("l_orderkey").cast("long"))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in made.items()))


@query("f20_f21_presence", f"WITH {ORDERS}, x AS (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS p FROM o), c AS (SELECT o_custkey, p, count(*) AS n FROM x WHERE p IS NOT NULL GROUP BY ALL), m AS (SELECT o_custkey, p AS usual FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS rn FROM c) WHERE rn = 1) SELECT o_orderkey, CAST(p IS NOT NULL AS INT) AS present, CASE WHEN p = usual THEN 1 ELSE 0 END AS is_usual FROM x LEFT JOIN m USING (o_custkey)")
def _f20(s: SparkSession, d: str) -> DataFrame:
    df = orders(s, d).withColumn("p", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")))
    out = profiles.lookup(df, profiles.mode_profile(df, "o_custkey", "p", "usual", missing=None), "o_custkey")
    return out.select("o_orderkey", F.col("p").isNotNull().cast("int").alias("present"), scalars.matches(F.col("p"), F.col("usual")).alias("is_usual"))


@query("f24_f26_flags", f"WITH {LINES}, g AS (SELECT avg(label) AS g FROM l), p AS (SELECT l_suppkey, count(*) AS n, avg(label) AS rate FROM l WHERE l_suppkey % 3 > 0 GROUP BY 1), c AS (SELECT l_linestatus, median(l_extendedprice) AS med, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM l GROUP BY 1) SELECT l_orderkey, l_linenumber, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS is_new_entity, round(ln(1 + coalesce(n, 0)), 6) AS log_volume, CASE WHEN rate > 1.1 * g THEN 1 ELSE 0 END AS is_high_risk, CASE WHEN l_extendedprice < q1 - 0.25 * (q3 - q1) OR l_extendedprice > q3 + 0.25 * (q3 - q1) THEN 1 ELSE 0 END AS outside_band, round(l_extendedprice / greatest(med, 0.01), 6) AS ratio_to_category_median FROM l LEFT JOIN p USING (l_suppkey) JOIN c USING (l_linestatus), g")
def _f24(s: SparkSession, d: str) -> DataFrame:
    df = lines(s, d)
    known = df.where("l_suppkey % 3 > 0").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"))
    out = profiles.lookup(df, known, "l_suppkey").crossJoin(F.broadcast(encodings.global_rate(df, "label", "g")))
    # few categories with very many amounts: no aggregate holds them all
    marks = stats.quantiles(df.where("l_linestatus IS NOT NULL"), "l_extendedprice", (0.25, 0.5, 0.75), ["l_linestatus"])
    marks = marks.select("l_linestatus", *(F.col("quantiles")[i].alias(n) for i, n in enumerate(("c_q25", "c_median", "c_q75"))))
    out = profiles.lookup(out, marks, "l_linestatus")
    wide = 0.25 * (F.col("c_q75") - F.col("c_q25"))
    made = scalars.entity_flags(F.col("n"), F.col("rate"), F.col("g"), 1.1) | scalars.band_flags(F.col("l_extendedprice"), F.col("c_q25") - wide, F.col("c_median"), F.col("c_q75") + wide)
    return rounded(out.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in made.items())), 6)


@query("f25_high_velocity", f"WITH {SPLIT}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS c FROM s), h AS (SELECT quantile_cont(c, 0.95) AS cut FROM n WHERE split = 'train') SELECT event_id, CASE WHEN c > cut THEN 1 ELSE 0 END AS is_high_velocity FROM n, h")
def _f25(s: SparkSession, d: str) -> DataFrame:
    df = velocity.velocity(split_events(s, d), "user_id", "t_us", "value", "event_id", {"1d": DAY}, ("count",), ties="strict", prefix="u")
    return profiles.high_rate_flag(df, df.where("split = 'train'"), "u_1d_count").select("event_id", "is_high_velocity")


@query("f28_strings", r"WITH x AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN md5(url) WHEN 2 THEN CAST(page_id + 12345 AS VARCHAR) WHEN 3 THEN left(md5(url), 8) || '-' || left(md5(url), 9) WHEN 4 THEN '' WHEN 5 THEN 'É٣xYz' || page_id ELSE 'aB' || page_id || '-+C' END AS u FROM pages) SELECT page_id, length(u) AS length, round(len(regexp_extract_all(u, '\p{Nd}')) / greatest(length(u), 1), 6) AS digit_ratio, round(len(regexp_extract_all(u, '\p{Lu}')) / greatest(length(u), 1), 6) AS upper_ratio, round(len(regexp_extract_all(u, '[^\p{L}\p{N}]')) / greatest(length(u), 1), 6) AS special_ratio, CAST(contains(u, '+') AS INT) AS has_plus, CAST(regexp_matches(u, '^\p{Nd}') AS INT) AS starts_digit, CAST(regexp_matches(u, '^\p{Nd}+$') AS INT) AS all_digits, CAST(regexp_matches(u, '^[0-9a-fA-F]{8,}$') AS INT) AS hex_like, CAST(regexp_matches(u, '^[0-9a-f]{8}-?[0-9a-f]{4}') AS INT) AS uuid_like, CAST(contains(lower(u), 'abc') OR contains(lower(u), '123') OR contains(lower(u), 'xyz') AS INT) AS sequential FROM x")
def _f28(s: SparkSession, d: str) -> DataFrame:
    k, page = F.col("page_id") % 7, F.col("page_id").cast("string")
    u = F.when(k == 0, F.col("url")).when(k == 1, F.md5("url")).when(k == 2, (F.col("page_id") + 12345).cast("string")).when(k == 3, F.concat(F.left(F.md5("url"), F.lit(8)), F.lit("-"), F.left(F.md5("url"), F.lit(9))))
    u = u.when(k == 4, "").when(k == 5, F.concat(F.lit("É٣xYz"), page)).otherwise(F.concat(F.lit("aB"), page, F.lit("-+C")))
    df = read(s, d, "pages").select("page_id", u.alias("u"))
    return rounded(df.select("page_id", *(c.alias(n) for n, c in text.composition(F.col("u")).items())), 6)


# every member of every list in turn, in several positions
_FREE = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "protonmail.com", "mail.com"]
_THROWN = ["mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email", "yopmail.com", "10minutemail.com"]
_ENDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".click", ".link", ".download", ".loan", ".work"]
_BAD = ["temp", "burner", "trash", "spam", "fake", "anon", "test", "noreply", "dummy", "void", "null", "drop"]
_DOMAINS = [*_FREE, *_THROWN, *(f"shop{i}.a{x}" for i, x in enumerate(_ENDS)), "x.mail.com", "a.b.example", "9to5.com", "mailtk", "", "top.top"]
_LOCALS = [*_BAD, *(f"a{w.upper()}9" for w in _BAD), "person", "p.q-r", "", "ann+shop"]
_MAIL = f"m AS (SELECT c_custkey, ({_DOMAINS!r})[c_custkey % {len(_DOMAINS)} + 1] AS dom, ({_LOCALS!r})[c_custkey % {len(_LOCALS)} + 1] AS loc FROM customer), k AS (SELECT *, len(list_filter({_ENDS!r}, lambda x: suffix(dom, x))) > 0 AS risky, len(list_filter({_BAD!r}, lambda x: contains(lower(loc), x))) > 0 AS bad FROM m)"


@query("f29_email_all", rf"WITH {_MAIL} SELECT c_custkey, loc AS email_local, dom AS email_domain, CAST(list_contains({_FREE!r}, dom) AS INT) AS is_freemail, CAST(list_contains({_THROWN!r}, dom) OR risky AS INT) AS is_disposable, CAST(NOT list_contains({_FREE!r}, dom) AND NOT (list_contains({_THROWN!r}, dom) OR risky) AS INT) AS is_custom_domain, CAST(risky AS INT) AS risky_tld, CAST(regexp_matches(string_split(dom, '.')[1], '\d') AS INT) AS domain_has_digits, len(regexp_extract_all(dom, '\.')) AS domain_depth, CAST(bad AS INT) AS suspicious FROM k")
def _f29(s: SparkSession, d: str) -> DataFrame:
    pick = lambda of: F.get(F.array(*map(F.lit, of)), F.col("c_custkey") % len(of))
    email = F.when(pick(_DOMAINS) == "", pick(_LOCALS)).otherwise(F.concat(pick(_LOCALS), F.lit("@"), pick(_DOMAINS)))
    return read(s, d, "customer").select("c_custkey", *(c.alias(n) for n, c in text.email_features(email).items()))


@query("f31_f32_f33_signals_all", f"""WITH {EVENTS}, x AS (SELECT *, CASE k % 6 WHEN 0 THEN 100 WHEN 1 THEN -1 WHEN 2 THEN NULL ELSE k END AS bat, CASE WHEN k % 7 <> 0 THEN k % 3 = 0 END AS chg, event_type = 'error' AS dbg, k % 5 = 0 AS hl, k * 25.0 - 100 AS diff, k % 60 AS age, k % 2 = 0 AS n1, k % 3 = 0 AS n2, k % 4 = 0 AS n3 FROM e),
y AS (SELECT *, bat IS NULL OR bat = -1 AS missing, coalesce(bat = 100 AND chg, false) AS full_, abs(diff) AS skew, (3 - CAST(n1 AS INT) - CAST(n2 AS INT) - CAST(n3 AS INT)) / 3.0 AS known FROM x)
SELECT event_id, CAST(missing AS INT) AS battery_missing, CAST(coalesce(bat, -1) % 10 = 0 AS INT) AS battery_round, CAST(full_ AS INT) AS battery_full, CAST(missing OR full_ AS INT) AS emulator_score, CAST(missing OR full_ OR hl AS INT) AS emulator_detected, skew AS clock_skew,
  CASE WHEN skew <= 30 THEN 0 WHEN skew <= 120 THEN 1 WHEN skew <= 300 THEN 2 WHEN skew <= 900 THEN 3 ELSE 4 END AS skew_bucket, round(0.3 * CAST(missing OR full_ AS INT) + 0.3 * CAST(dbg AS INT) + 0.2 * CAST(hl AS INT) + 0.2 * CAST(skew > 300 AS INT), 6) AS device_risk,
  CAST(value < 3 AS INT) AS fill_fast, CAST(value > 600 AS INT) AS fill_slow, round((k % 4) / nullif(k % 7, 0), 6) AS paste_ratio, round(k / greatest(k % 9 * 30 / 60.0, 1), 6) AS actions_per_minute, k % 11 - 1 AS pages_before,
  round(known, 6) AS known_ratio, CAST(n1 AND n2 AND n3 AS INT) AS all_new, round((1 - known) * value / 100, 6) AS stability_x_deviation, round((CAST(n1 AS INT) + CAST(n2 AS INT) + CAST(n3 AS INT)) / 3.0, 6) AS triple_novelty, round(CASE WHEN age < 30 THEN value ELSE 0 END, 6) AS new_account_x_amount, CAST(age < 30 AND hl AS INT) AS new_account_x_shared_device FROM y""")
def _f31(s: SparkSession, d: str) -> DataFrame:
    k, v = F.col("k"), F.col("value")
    battery, charging = F.when(k % 6 == 0, 100).when(k % 6 == 1, -1).when(k % 6 > 2, k), F.when(k % 7 != 0, k % 3 == 0)
    made = signals.device_risk(battery, charging, F.col("event_type") == "error", k % 5 == 0, k * 25.0, F.lit(100.0))
    made |= signals.session_features(v, k % 4, k % 7, k, (k % 9) * 30 / 60, k % 11)
    new = (k % 2 == 0, k % 3 == 0, k % 4 == 0)
    known = signals.familiarity(*new)
    made |= known | signals.cross_layer(known["known_ratio"], v / 100, *new, k % 60, v, k % 5 == 0)
    return rounded(events(s, d).select("event_id", *(c.alias(n) for n, c in made.items())), 6)


@query("a30_mean_of_flags", f"WITH {EVENTS} SELECT event_id, round((CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 0 ELSE CAST(value > 50 AS INT) END) / CASE WHEN k % 3 = 0 THEN 1.0 ELSE 2.0 END, 6) AS stability FROM e")
def _a30(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return events(s, d).select("event_id", r(signals.mean_of_flags(k % 2 != 0, F.when(k % 3 != 0, F.col("value") > 50)), 6).alias("stability"))


_PERIODS = (("hour", 3600), ("day", 86400), ("week", 604800))


@query("f42_f45_time", f"WITH {EVENTS} SELECT event_id, " + ", ".join(f"round({f}((t_us // 1000000) * 2 * pi() / {p}), 4) + 0.0 AS {n}_{f}" for n, p in _PERIODS for f in ("sin", "cos")) + ", t_us // 86400000000 - k AS first_day FROM e")
def _f42(s: SparkSession, d: str) -> DataFrame:
    made = scalars.fourier(F.floor(F.col("t_us") / 1_000_000))
    return events(s, d).select("event_id", *((F.round(c, 4) + 0.0).alias(n) for n, c in made.items()), scalars.first_used_day(F.col("t_us"), F.col("k")).alias("first_day"))


@query("f44_account_age", f"WITH {ORDERS}, a AS (SELECT o_custkey, min(t_us) AS t0, min(CASE WHEN o_totalprice > 100000 THEN t_us END) AS t1, count(DISTINCT t_us // 86400000000) AS days FROM o GROUP BY 1) SELECT o_orderkey, round((t_us - t0) / 86400e6, 4) AS age_days, round((t1 - t0) / 86400e6, 4) AS signup_to_first_buy, CASE WHEN (t_us - t0) / 86400e6 < 30 THEN 1 ELSE 0 END AS is_new, round(days / CASE WHEN t_us > t0 THEN (t_us - t0) / 86400e6 END, 6) AS active_share, round(o_totalprice / nullif(o_custkey % 5 * 1000, 0) + 1.37e-7, 6) AS utilisation FROM o JOIN a USING (o_custkey)")
def _f44(s: SparkSession, d: str) -> DataFrame:
    df = orders(s, d)
    first = df.groupBy("o_custkey").agg(F.min("t_us").alias("t0"), F.min(F.when(F.col("o_totalprice") > 100000, F.col("t_us"))).alias("t1"), F.count_distinct(F.floor(F.col("t_us") / DAY)).alias("days"))
    out = profiles.lookup(df, first, "o_custkey")
    made = scalars.account_age(F.col("t_us"), F.col("t0"), F.col("t1"), F.col("days"), F.col("o_custkey") % 5 * 1000, F.col("o_totalprice"))
    made["utilisation"] = made["utilisation"] + OFF
    return out.select("o_orderkey", *(F.round(c, 4 if n in ("age_days", "signup_to_first_buy") else 6).alias(n) if n != "is_new" else c.alias(n) for n, c in made.items()))


# --- profiles ---


@query("a13_out_of_fold_te", f"WITH {EVENTS}, f AS (SELECT user_id, event_id % 5 AS fold, sum(label) AS s, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT user_id, sum(s) AS s, sum(n) AS n FROM f GROUP BY 1), g AS (SELECT avg(label) AS g FROM e) SELECT event_id, round((w.s - f.s + 20 * g) / (w.n - f.n + 20) + 1.37e-7, 6) AS te_oof FROM e JOIN f ON e.user_id = f.user_id AND e.event_id % 5 = f.fold JOIN w ON w.user_id = e.user_id, g")
def _a13(s: SparkSession, d: str) -> DataFrame:
    out = encodings.out_of_fold(events(s, d), "event_id", "user_id", "label", "te_oof", fold=F.pmod(F.col("event_id"), F.lit(5)))
    return out.select("event_id", r(F.col("te_oof") + OFF, 6).alias("te_oof"))


@query("a21_a22_type_stats", f"WITH {EVENTS}, w AS (SELECT avg(value) AS m, avg(label) AS g FROM e), t AS (SELECT event_type, avg(value) AS m, coalesce(stddev_samp(value), 1) AS sd FROM e WHERE event_type <> 'view' GROUP BY 1) SELECT event_id, round((value - coalesce(t.m, w.m)) / greatest(coalesce(sd, 1.0), 0.01), 4) AS type_z, round(g, 6) AS base_rate FROM e LEFT JOIN t USING (event_type), w")
def _a22(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d)
    whole = df.agg(F.avg("value").alias("m"))
    p = profiles.entity_profile(df.where("event_type <> 'view'"), "event_type", "value", ("mean", "std"), "t_", std_default=1.0)
    out = profiles.lookup(df.crossJoin(F.broadcast(whole)), p, "event_type", {"t_mean": F.col("m"), "t_std": 1.0}).crossJoin(F.broadcast(encodings.global_rate(df, "label", "g")))
    return out.select("event_id", r(scalars.zscore(F.col("value"), F.col("t_mean"), F.col("t_std"))).alias("type_z"), r("g", 6).alias("base_rate"))


@query("a29_disputes", f"WITH {LINES} SELECT l_suppkey, round(avg(label), 6) AS dispute_rate, round(coalesce(sum(CASE WHEN label = 1 THEN l_extendedprice END), 0) / sum(l_extendedprice), 6) AS dispute_amount_ratio, round((max(t_us) - max(CASE WHEN label = 1 THEN t_us END)) / 86400e6, 4) AS days_since_dispute FROM l GROUP BY l_suppkey")
def _a29(s: SparkSession, d: str) -> DataFrame:
    out = profiles.dispute_ratios(lines(s, d), "l_suppkey", "t_us", "l_extendedprice", F.col("label") == 1)
    return out.select("l_suppkey", r("dispute_rate", 6).alias("dispute_rate"), r("dispute_amount_ratio", 6).alias("dispute_amount_ratio"), r("days_since_dispute").alias("days_since_dispute"))


@query("a36_span", f"WITH {EVENTS} SELECT user_id || '_' || k % 3 AS uid, max(t_us) - min(t_us) AS span FROM e GROUP BY 1")
def _a36(s: SparkSession, d: str) -> DataFrame:
    from ..schema import uid

    df = events(s, d).withColumn("k3", F.col("k") % 3).withColumn("uid", uid("user_id", "k3"))
    return profiles.entity_profile(df, "uid", "t_us", ("span",))


@query("a37_centroid", f"WITH {EVENTS} SELECT user_id, median(k) AS centroid_lat, round(median(value), 6) AS centroid_lon FROM e GROUP BY user_id")
def _a37(s: SparkSession, d: str) -> DataFrame:
    out = profiles.centroid_profile(events(s, d), "user_id", "k", "value")
    return out.select("user_id", F.col("centroid_lat").cast("double").alias("centroid_lat"), r("centroid_lon", 6).alias("centroid_lon"))


# --- windows ---

_HOURS = {"1h": 3_600_000_000, "1d": 86_400_000_000}


@query("a27_matrix", f"WITH {EVENTS} SELECT event_id, " + ", ".join(x for key in ("user_id", "k") for n in _HOURS for x in (f"count(*) OVER {key}_{n} AS {key}_{n}_count", f"round(coalesce(sum(value) OVER {key}_{n}, 0), 2) + 0.0 AS {key}_{n}_sum", f"round(avg(value) OVER {key}_{n} + 1.37e-7, 4) AS {key}_{n}_avg", f"round(stddev_samp(value) OVER {key}_{n}, 3) AS {key}_{n}_std", f"count(DISTINCT value) OVER {key}_{n} AS {key}_{n}_distinct")) + " FROM e WINDOW " + ", ".join(f"{key}_{n} AS (PARTITION BY {key} ORDER BY t_us RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)" for key in ("user_id", "k") for n, w in _HOURS.items()))
def _a27(s: SparkSession, d: str) -> DataFrame:
    out = velocity.velocity_matrix(events(s, d), ["user_id", "k"], "t_us", "value", "event_id", _HOURS, spread=True)
    digits = {"sum": 2, "avg": 4, "std": 3}
    names = [f"{key}_{n}_{a}" for key in ("user_id", "k") for n in _HOURS for a in ("count", "sum", "avg", "std", "distinct")]
    return out.select("event_id", *(r(F.col(c) + (OFF if a == "avg" else 0.0), digits[a]).alias(c) if (a := c.rsplit("_", 1)[1]) in digits else F.col(c) for c in names))


@query("a32_recipient_all", f"WITH {LINES}, x AS (SELECT *, l_orderkey * 10 + l_linenumber AS id, min(t_us) OVER (PARTITION BY l_suppkey) AS t0 FROM l), y AS (SELECT *, count(DISTINCT l_partkey) OVER w AS senders, sum(l_extendedprice) OVER d AS day, sum(l_extendedprice) OVER a AS total, avg(l_extendedprice) OVER a AS mean FROM x WINDOW w AS (PARTITION BY l_suppkey ORDER BY t_us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW), d AS (PARTITION BY l_suppkey ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), a AS (PARTITION BY l_suppkey ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT id, senders AS senders_7d, round(day, 2) AS received_1d, round((t_us - t0) / 86400e6, 4) AS recipient_age_days, CAST((t_us - t0) / 86400e6 < 7 AS INT) AS recipient_new, CAST(senders > 5 AS INT) AS many_senders, round(mean + 0.0000137, 3) AS received_mean, CAST(day > 10 * total / greatest((t_us - t0) / 86400e6, 1.0) AS INT) AS received_spike FROM y")
def _a32(s: SparkSession, d: str) -> DataFrame:
    df = lines(s, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = velocity.recipient_profile(df, "l_suppkey", "l_partkey", "t_us", "l_extendedprice")
    return out.select("id", "senders_7d", r("received_1d", 2).alias("received_1d"), r("recipient_age_days").alias("recipient_age_days"), "recipient_new", "many_senders", r(F.col("received_mean") + 0.0000137, 3).alias("received_mean"), "received_spike")


@query("a35_v26_diversity", f"WITH {EVENTS}, d AS (SELECT event_id, count(DISTINCT user_id) OVER (PARTITION BY k ORDER BY t_us RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS n FROM e) SELECT event_id, n AS users_3d, CAST(n > 3 AS INT) AS users_3d_high FROM d")
def _a35(s: SparkSession, d: str) -> DataFrame:
    return velocity.diversity(events(s, d), "k", "user_id", "t_us", 3 * DAY, "users_3d", 3).select("event_id", "users_3d", "users_3d_high")


_STACK = ", ".join(x for n, w in velocity.STACK.items() for x in (f"count(v) OVER w{n} AS user_id_{n}_count", f"round(coalesce(sum(v) OVER w{n}, 0), 2) AS user_id_{n}_sum", f"coalesce(max(v) OVER w{n}, 0) AS user_id_{n}_max"))


@query("v2_stack_all", f"WITH {SPLIT}, x AS (SELECT *, CASE WHEN split = 'train' THEN value END AS v FROM s) SELECT event_id, {_STACK} FROM x WINDOW " + ", ".join(f"w{n} AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)" for n, w in velocity.STACK.items()))
def _v2(s: SparkSession, d: str) -> DataFrame:
    df = split_events(s, d).withColumn("is_hist", F.col("split") == "train")
    out = velocity.velocity(df, "user_id", "t_us", "value", "event_id", velocity.STACK, ("count", "sum", "max"), ties="inclusive", history="is_hist", spread=True)
    return rounded(out, 2, "event_id", *(f"user_id_{n}_{a}" for n in velocity.STACK for a in ("count", "sum", "max")))


@query("v4_recent_history", f"WITH {SPLIT}, n AS (SELECT event_id, split, count(*) OVER w AS c, sum(value) OVER w AS v FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)) SELECT event_id, c AS u_7d_count, round(coalesce(v, 0), 2) + 0.0 AS u_7d_sum FROM n WHERE split = 'oot'")
def _v4(s: SparkSession, d: str) -> DataFrame:
    """Features of the last split from its own rows and the week before it: what came earlier is cut before the shuffle."""
    df = split_events(s, d)
    start = df.where("split = 'oot'").agg(F.min("t_us").alias("start"))
    near = velocity.recent_history(df.crossJoin(F.broadcast(start)), "t_us", F.col("start"), 7 * DAY)
    out = velocity.velocity(near, "user_id", "t_us", "value", "event_id", {"7d": 7 * DAY}, ties="strict", prefix="u")
    return rounded(out.where("split = 'oot'"), 2, "event_id", "u_7d_count", "u_7d_sum")


@query("v10_velocity_zscore", f"WITH {EVENTS}, n AS (SELECT user_id, t_us // 86400000000 AS day, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT user_id, avg(n) AS m, coalesce(stddev_samp(n), 0) AS sd FROM n GROUP BY 1), c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS c FROM e) SELECT event_id, round((c - m) / greatest(sd, 1.0), 6) AS velocity_z FROM c JOIN p USING (user_id)")
def _v10(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d)
    out = velocity.velocity(df, "user_id", "t_us", "value", "event_id", {"1d": DAY}, ("count",), ties="strict", prefix="u")
    out = profiles.lookup(out, profiles.daily_counts(df, "user_id", "t_us"), "user_id")
    return out.select("event_id", r(velocity.velocity_zscore("u_1d_count", "mean_daily", "std_daily"), 6).alias("velocity_z"))


@query("v17_cusum_all", f"WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e), b AS (SELECT user_id, avg(value) AS mu, greatest(CASE WHEN count(value) > 1 THEN coalesce(stddev_samp(value), 0) ELSE 1 END, 0.01 * abs(avg(value)) + 1) AS sigma FROM n WHERE rn <= greatest(2, n // 2) GROUP BY user_id), p AS (SELECT event_id, user_id, t_us, sum((value - mu) / sigma - 0.1) OVER w AS p FROM e JOIN b USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)), c AS (SELECT *, p - least(0.0, min(p) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)) AS s FROM p), l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS b FROM c) SELECT event_id, round(s, 4) AS cusum, round(coalesce(s - b, 0), 4) + 0.0 AS cusum_slope, CAST(s > 1 AS INT) AS cusum_triggered, CAST(sum(CASE WHEN b > 1 AND s <= 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cusum_resets FROM l")
def _v17(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d)
    out = sequence.cusum(df, sequence.cusum_baseline(df, "user_id", "t_us", "event_id", "value"), "user_id", "t_us", "event_id", "value", k=0.1, h=1.0)
    return out.select("event_id", r("cusum").alias("cusum"), (r("cusum_slope") + 0.0).alias("cusum_slope"), "cusum_triggered", "cusum_resets")


@query("v23_ewma", f"WITH {EVENTS} SELECT user_id, round(list_reduce(list(value ORDER BY t_us, event_id), lambda a, x: 0.3 * x + 0.7 * a), 6) AS risk FROM e GROUP BY user_id")
def _v23(s: SparkSession, d: str) -> DataFrame:
    return rounded(sequence.ewma(events(s, d), "user_id", "t_us", "event_id", "value", name="risk"), 6)


@query("v22_percentile_90d", f"""WITH {ORDERS}, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY t_us, o_orderkey) AS rn FROM o),
w AS (SELECT o_orderkey, o_totalprice, list((t_us, rn, o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY t_us RANGE BETWEEN {90 * DAY} PRECEDING AND CURRENT ROW) AS x, rn FROM n),
p AS (SELECT o_orderkey, o_totalprice, list_filter(x, lambda y: y[2] < rn) AS x FROM w)
SELECT o_orderkey, round(CASE WHEN len(x) > 0 THEN len(list_filter(x, lambda y: y[3] <= o_totalprice)) / len(x) END, 6) AS amount_rank_90d FROM p""")
def _v22(s: SparkSession, d: str) -> DataFrame:
    return rounded(dominance.window_rank(orders(s, d), "o_custkey", "t_us", "o_orderkey", "o_totalprice", 90 * DAY, "amount_rank_90d"), 6, "o_orderkey", "amount_rank_90d")


@query("t1_time_order", f"WITH {EVENTS} SELECT event_id, row_number() OVER (ORDER BY t_us, event_id) AS place FROM e ORDER BY t_us, event_id LIMIT 50")
def _t1(s: SparkSession, d: str) -> DataFrame:
    first = splits.last_n(events(s, d), 50, [F.asc("t_us"), F.asc("event_id")])
    return first.select("event_id", F.row_number().over(W.orderBy("t_us", "event_id")).alias("place"))
