"""The registered queries over the driver's tables, one an inventory item, and their DuckDB forms.

Every query runs over whole tables. Floats are rounded in both forms, since the order of a sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars, signals, text
from ..operators import anomaly, encodings, experiments, graph, metrics, profiles, risk, sequence, splits, stats, velocity
from ..schema import DAY, HOUR, EventSchema, micros, normalise
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS = """e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
  CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)"""
SPLIT = EVENTS + """, q AS (SELECT quantile_cont(t_us, 0.7) AS q1, quantile_cont(t_us, 0.85) AS q2 FROM e),
s AS (SELECT e.*, CASE WHEN t_us <= q1 THEN 'train' WHEN t_us <= q2 THEN 'val' ELSE 'oot' END AS split FROM e, q)"""
ORDERS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS t_us, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)"""
LINES = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, epoch_us(l_shipdate) AS t_us, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"""


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    df = normalise(read(spark, d, "events"), EventSchema("event_id", "ts", "value", entities=("user_id",)))
    return df.select("event_id", "user_id", "event_type", "value", "t_us", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def split_events(spark: SparkSession, d: str) -> DataFrame:
    return splits.quantile_split(events(spark, d))


def orders(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", micros(df, "o_orderdate").alias("t_us"), "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("label"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", micros(df, "l_shipdate").alias("t_us"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 4, *keep: str) -> DataFrame:
    """All double columns rounded; `keep` selects columns."""
    df = df.select(*keep) if keep else df
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- splits, filters, sources ---


@query("p6_quantile_split", f"WITH {SPLIT} SELECT event_id, split FROM s")
def _p6(s: SparkSession, d: str) -> DataFrame:
    return split_events(s, d).select("event_id", "split")


@query("s12_class_balance", f"WITH {SPLIT} SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate, CAST(sum(1 - label) AS BIGINT) AS negatives FROM s GROUP BY split")
def _s12(s: SparkSession, d: str) -> DataFrame:
    return rounded(splits.class_balance(split_events(s, d)), 6)


@query("s13_column_profile", "SELECT 'user_id' AS \"column\", count(DISTINCT user_id) AS n_unique, round(avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0 END), 6) AS null_rate FROM events UNION ALL SELECT 'event_type', count(DISTINCT event_type), round(avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0 END), 6) FROM events UNION ALL SELECT 'value', count(DISTINCT value), round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) FROM events")
def _s13(s: SparkSession, d: str) -> DataFrame:
    return rounded(splits.column_profile(read(s, d, "events"), ["user_id", "event_type", "value"]), 6)


@query("s5_template", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' AND o_orderstatus = 'F' GROUP BY c_mktsegment")
def _s5(s: SparkSession, d: str) -> DataFrame:
    for t in ("orders", "customer"):
        read(s, d, t).createOrReplaceTempView(f"tpl_{t}")
    sql = "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} LEFT JOIN {profiles} ON o_custkey = c_custkey WHERE o_orderdate >= CAST(:start AS TIMESTAMP_NTZ) AND o_orderdate <= CAST(:end AS TIMESTAMP_NTZ) AND {segment} GROUP BY c_mktsegment"
    return readers.from_template(s, sql, {"orders": "tpl_orders", "profiles": "tpl_customer"}, {"start": "1995-01-01", "end": "1996-12-31"}, "o_orderstatus = 'F'")


@query("p4_p8_calendar_split", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'val' ELSE 'oot' END AS split FROM orders")
def _p8(s: SparkSession, d: str) -> DataFrame:
    return splits.calendar_split(read(s, d, "orders"), "o_orderdate", "1996-01-01", "1998-01-01").select("o_orderkey", "split")


@query("p7_step_split", f"WITH {EVENTS} SELECT event_id, CASE WHEN t_us // 3600000000 - 473352 <= 500 THEN 'train' WHEN t_us // 3600000000 - 473352 <= 600 THEN 'val' ELSE 'oot' END AS split FROM e")
def _p7(s: SparkSession, d: str) -> DataFrame:
    return splits.step_split(events(s, d).withColumn("step", F.floor(F.col("t_us") / HOUR) - 473352), "step").select("event_id", "split")


@query("p18_skew_buckets", f"WITH {EVENTS} SELECT event_id, CASE WHEN value > 900 THEN 4 WHEN value > -1 AND value <= 30 THEN 0 WHEN value > 30 AND value <= 120 THEN 1 WHEN value > 120 AND value <= 300 THEN 2 WHEN value > 300 AND value <= 900 THEN 3 END AS bucket FROM e")
def _p18(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("event_id", scalars.clock_skew_bucket(F.col("value")).alias("bucket"))


@query("u2_first_by", f"WITH {EVENTS} SELECT user_id, event_type, min(event_id) AS event_id FROM e GROUP BY ALL")
def _u2(s: SparkSession, d: str) -> DataFrame:
    return splits.first_by(events(s, d), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("t6_last_n", f"WITH {EVENTS} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) AS n FROM e) WHERE n <= 5")
def _t6(s: SparkSession, d: str) -> DataFrame:
    return splits.last_n(events(s, d), 5, [F.desc("t_us"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id")


@query("u3_row_difference", "SELECT n_nationkey AS k, 'left' AS side FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) UNION ALL SELECT DISTINCT c_nationkey, 'right' FROM customer WHERE c_acctbal > 9900 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def _u3(s: SparkSession, d: str) -> DataFrame:
    a = read(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    b = read(s, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").cast("int").alias("k")).distinct()
    return splits.row_difference(a, b)


# --- scalar functions ---


@query("f2_f4_clock", f"WITH {EVENTS}, h AS (SELECT event_id, (t_us // 3600000000) % 24 AS h, (t_us // 86400000000 + 3) % 7 AS w FROM e) SELECT event_id, CAST(h AS BIGINT) AS hour, CAST(w AS BIGINT) AS dow, round(sin(h * 2 * pi() / 24), 6) AS hour_sin, round(cos(h * 2 * pi() / 24), 6) AS hour_cos, round(sin(w * 2 * pi() / 7), 6) AS dow_sin, round(cos(w * 2 * pi() / 7), 6) AS dow_cos, CASE WHEN h >= 22 OR h <= 6 THEN 1 ELSE 0 END AS is_night, CASE WHEN w >= 5 THEN 1 ELSE 0 END AS is_weekend FROM h")
def _f2(s: SparkSession, d: str) -> DataFrame:
    from .common import clock

    return rounded(clock(events(s, d)), 6, "event_id", "hour", "dow", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_night", "is_weekend")


@query("f7_f8_amount_pattern", "SELECT o_orderkey, CASE WHEN round(o_totalprice % 10, 6) < 0.01 THEN 1 ELSE 0 END AS is_round_10, CASE WHEN round(o_totalprice % 1, 6) = 0 THEN 1 ELSE 0 END AS is_whole, CASE WHEN round((o_totalprice * 100) % 100, 4) > 0.5 THEN 1 ELSE 0 END AS has_cents, CASE WHEN o_totalprice < 50 THEN 1 ELSE 0 END AS is_small FROM orders")
def _f7(s: SparkSession, d: str) -> DataFrame:
    p = scalars.amount_pattern(F.col("o_totalprice"))
    return read(s, d, "orders").select("o_orderkey", *(p[c].alias(c) for c in ("is_round_10", "is_whole", "has_cents", "is_small")))


@query("f9_haversine", "WITH p AS (SELECT s_suppkey, c_custkey, s_suppkey % 60 - 30 AS a1, s_suppkey % 90 - 45 AS o1, c_custkey % 70 - 35 AS a2, c_custkey % 80 - 40 AS o2 FROM supplier JOIN customer ON c_custkey % 100 = s_suppkey % 100), h AS (SELECT *, pow(sin((radians(a2) - radians(a1)) / 2), 2) + cos(radians(a1)) * cos(radians(a2)) * pow(sin((radians(o2) - radians(o1)) / 2), 2) AS a FROM p) SELECT s_suppkey, c_custkey, round(2 * 6371 * asin(sqrt(least(1.0, greatest(0.0, a)))), 4) AS km FROM h")
def _f9(s: SparkSession, d: str) -> DataFrame:
    a, b = read(s, d, "supplier"), read(s, d, "customer")
    both = a.join(b, F.col("c_custkey") % 100 == F.col("s_suppkey") % 100)
    return both.select("s_suppkey", "c_custkey", r(scalars.haversine_km(F.col("s_suppkey") % 60 - 30, F.col("s_suppkey") % 90 - 45, F.col("c_custkey") % 70 - 35, F.col("c_custkey") % 80 - 40)).alias("km"))


@query("f11_f12_hour_distance", f"WITH {EVENTS}, h AS (SELECT *, (t_us // 3600000000) % 24 AS h FROM e), m AS (SELECT user_id, avg(h) AS mh, avg(sin(h * 2 * pi() / 24)) AS ms, avg(cos(h * 2 * pi() / 24)) AS mc FROM h GROUP BY user_id) SELECT event_id, round(least(abs(h - mh), 24 - abs(h - mh)), 4) AS hour_deviation, round(1 - (sin(h * 2 * pi() / 24) * ms + cos(h * 2 * pi() / 24) * mc) / sqrt(ms * ms + mc * mc), 4) + 0.0 AS angular FROM h JOIN m USING (user_id)")
def _f11(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d).withColumn("hour", F.floor(F.col("t_us") / HOUR) % 24)
    out = profiles.lookup(df, profiles.circular_profile(df, "user_id", F.col("hour")), "user_id")
    out = profiles.lookup(out, profiles.entity_profile(df, "user_id", "hour", ("mean",), "h_"), "user_id")
    return out.select("event_id", r(scalars.hour_gap(F.col("hour"), F.col("h_mean"))).alias("hour_deviation"), r(scalars.angular_distance(F.col("hour"), F.col("mean_sin"), F.col("mean_cos"))).__add__(0.0).alias("angular"))


@query("f16_f19_balances", "SELECT l_orderkey, l_linenumber, round(abs((l_extendedprice - l_quantity) - l_extendedprice * l_discount), 4) AS sent, CASE WHEN l_extendedprice * l_discount > l_extendedprice + 1 THEN 1 ELSE 0 END AS exceeds, round(l_extendedprice * l_discount / (l_extendedprice + 1), 6) AS to_balance, l_linenumber % 24 AS step_mod_24 FROM lineitem")
def _f16(s: SparkSession, d: str) -> DataFrame:
    amount = F.col("l_extendedprice") * F.col("l_discount")
    b = scalars.balance_features(amount, F.col("l_extendedprice"), F.col("l_quantity"), F.lit(0.0), amount)
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", r(b["orig_balance_error"]).alias("sent"), b["amount_exceeds"].alias("exceeds"), r(b["amount_to_balance"], 6).alias("to_balance"), scalars.step_features(F.col("l_linenumber"))["step_mod_24"].alias("step_mod_24"))


@query("f27_entropy", "WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, length(p_name) AS n FROM part), k AS (SELECT p_partkey, c, count(*) / max(n) AS p FROM c WHERE c <> '' GROUP BY ALL) SELECT p_partkey, round(-sum(p * log2(p)), 4) AS entropy FROM k GROUP BY p_partkey")
def _f27(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").select("p_partkey", r(text.entropy(F.col("p_name"))).alias("entropy"))


@query("f28_composition", r"SELECT page_id, length(url) AS length, round(len(regexp_extract_all(url, '\p{Nd}')) / greatest(length(url), 1), 6) AS digit_ratio, round(len(regexp_extract_all(url, '\p{Lu}')) / greatest(length(url), 1), 6) AS upper_ratio, CASE WHEN contains(url, '+') THEN 1 ELSE 0 END AS has_plus, CASE WHEN regexp_matches(url, '^\p{Nd}') THEN 1 ELSE 0 END AS starts_digit FROM pages")
def _f28(s: SparkSession, d: str) -> DataFrame:
    c = text.composition(F.col("url"))
    return rounded(read(s, d, "pages").select("page_id", *(c[n].alias(n) for n in ("length", "digit_ratio", "upper_ratio", "has_plus", "starts_digit"))), 6)



# names with blanks, dashes and no parts; local parts with and without a part of the name
@query("f29_f30_email", """WITH m AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Ann-Marie  Customer' WHEN 1 THEN c_name WHEN 2 THEN '' WHEN 3 THEN '  -  ' WHEN 4 THEN 'JO ' || c_mktsegment END AS name,
  CASE c_custkey % 5 WHEN 0 THEN 'ann.marie' || c_custkey WHEN 1 THEN lower(c_mktsegment) || '.jo' WHEN 2 THEN c_name WHEN 3 THEN '' ELSE 'Customer' || c_custkey END AS loc FROM customer),
n AS (SELECT *, list_filter(regexp_split_to_array(replace(lower(name), '-', ' '), '\\s+'), lambda x: x <> '') AS parts, list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x <> '') AS words FROM m)
SELECT c_custkey, loc AS email_local, round(coalesce(list_min(list_transform(parts, lambda x: levenshtein(lower(loc), x))), CASE WHEN name IS NOT NULL THEN 999 END) / greatest(length(loc), 1), 6) AS coherence,
  CAST(coalesce(len(list_filter(words, lambda x: contains(lower(loc), x))) > 0, false) AS INT) AS name_in_email FROM n""")
def _f29(s: SparkSession, d: str) -> DataFrame:
    k, local = F.col("c_custkey"), F.col("email_local")
    name = F.when(k % 6 == 0, "Ann-Marie  Customer").when(k % 6 == 1, F.col("c_name")).when(k % 6 == 2, "").when(k % 6 == 3, "  -  ").when(k % 6 == 4, F.concat(F.lit("JO "), "c_mktsegment"))
    loc = F.when(k % 5 == 0, F.concat(F.lit("ann.marie"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lower("c_mktsegment"), F.lit(".jo"))).when(k % 5 == 2, F.col("c_name")).when(k % 5 == 3, "").otherwise(F.concat(F.lit("Customer"), k.cast("string")))
    df = read(s, d, "customer").select("c_custkey", name.alias("name"), text.email_features(F.concat(loc, F.lit("@mail.example")))["email_local"].alias("email_local"))
    return df.select("c_custkey", "email_local", r(text.name_coherence(F.col("name"), local), 6).alias("coherence"), text.name_in_email(F.col("name"), local).alias("name_in_email"))



@query("f35_f38_names", r"WITH x AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '  Try: ' || url || ' (again)! ' WHEN 2 THEN 'é ' || repeat('ab _', page_id % 12) || '__' ELSE '!?' END AS s FROM pages) SELECT page_id, lower(rtrim(left(replace(trim(regexp_replace(s, '[^\p{L}\p{N}_ -]', '', 'g')), ' ', '_'), 40), '_')) AS name, substr(sha256(url), 1, 16) AS hash FROM x")
def _f35(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    some = F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.concat(F.lit("  Try: "), "url", F.lit(" (again)! "))).when(k % 4 == 2, F.concat(F.lit("é "), F.expr("repeat('ab _', cast(page_id % 12 as int))"), F.lit("__"))).otherwise("!?")
    return read(s, d, "pages").select("page_id", text.sanitized(some).alias("name"), text.content_hash(F.col("url")).alias("hash"))



@query("f31_f33_signals", "SELECT event_id, round(0.3 * CASE WHEN value = 100 THEN 1 ELSE 0 END + 0.3 * CASE WHEN event_type = 'error' THEN 1 ELSE 0 END + 0.2 * CASE WHEN value > 100 THEN 1 ELSE 0 END + 0.2 * CASE WHEN abs(value - 50) > 300 THEN 1 ELSE 0 END, 6) AS device_risk, CASE WHEN value < 3 THEN 1 ELSE 0 END AS fill_fast FROM events")
def _f31(s: SparkSession, d: str) -> DataFrame:
    risk_ = signals.device_risk(F.col("value"), F.lit(True), F.col("event_type") == "error", F.col("value") > 100, F.col("value"), F.lit(50.0))
    return read(s, d, "events").select("event_id", r(risk_["device_risk"], 6).alias("device_risk"), signals.session_features(F.col("value"), F.lit(0), F.lit(1), F.lit(1), F.lit(1))["fill_fast"].alias("fill_fast"))



# --- profiles ---


@query("a1_a2_entity_profile", f"WITH {SPLIT} SELECT user_id, round(avg(value), 7) AS mean, round(coalesce(stddev_samp(value), 0), 7) AS std, min(value) AS min, max(value) AS max, round(median(value), 7) AS median, round(quantile_cont(value, 0.9), 7) AS p90, count(value) AS count FROM s WHERE split = 'train' GROUP BY user_id")
def _a1(s: SparkSession, d: str) -> DataFrame:
    return rounded(profiles.entity_profile(split_events(s, d).where("split = 'train'"), "user_id", "value", ("mean", "std", "min", "max", "median", "p90", "count")), 7)


@query("a3_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_linestatus) AS n_status FROM lineitem GROUP BY l_suppkey")
def _a3(s: SparkSession, d: str) -> DataFrame:
    return profiles.distinct_profile(lines(s, d), "l_suppkey", {"n_parts": "l_partkey", "n_status": "l_linestatus"})


@query("a4_sharing", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_partkey")
def _a4(s: SparkSession, d: str) -> DataFrame:
    return profiles.sharing(lines(s, d), "l_partkey", "l_suppkey", "n_suppliers")


@query("a5_mode", "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority AS mode FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM c) WHERE rn = 1")
def _a5(s: SparkSession, d: str) -> DataFrame:
    return profiles.mode_profile(read(s, d, "orders"), "o_custkey", "o_orderpriority", "mode")


@query("a6_a34_first_last", f"WITH {EVENTS} SELECT user_id, arg_min(value, t_us) AS home_value, arg_max(value, t_us) AS last FROM e GROUP BY user_id")
def _a6(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d)
    return profiles.lookup(profiles.first_profile(df, "user_id", ["value"], ["t_us", "event_id"]), profiles.last_profile(df, "user_id", "value", ["t_us", "event_id"]), "user_id")


@query("j3_lookup_zscore", f"WITH {SPLIT}, p AS (SELECT user_id, avg(value) AS m, coalesce(stddev_samp(value), 0) AS sd, quantile_cont(value, 0.9) AS p90 FROM s WHERE split = 'train' GROUP BY user_id) SELECT event_id, round((value - coalesce(m, 0)) / greatest(coalesce(sd, 1), 0.01), 4) AS z, round(value / greatest(coalesce(p90, 1), 1.0), 4) AS vs_p90 FROM s LEFT JOIN p USING (user_id)")
def _j3(s: SparkSession, d: str) -> DataFrame:
    df = split_events(s, d)
    p = profiles.entity_profile(df.where("split = 'train'"), "user_id", "value", ("mean", "std", "p90"))
    out = profiles.lookup(df, p, "user_id", {"mean": 0.0, "std": 1.0, "p90": 1.0})
    return out.select("event_id", r(scalars.zscore(F.col("value"), F.col("mean"), F.col("std"))).alias("z"), r(scalars.ratio(F.col("value"), F.col("p90"), 1.0)).alias("vs_p90"))


@query("j10_star", "SELECT l_orderkey, l_linenumber, p_brand, n_name, s_acctbal FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey")
def _j10(s: SparkSession, d: str) -> DataFrame:
    supp = profiles.lookup(read(s, d, "supplier"), read(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    sides = [(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"), (supp.select(F.col("s_suppkey").alias("l_suppkey"), "n_name", "s_acctbal"), "l_suppkey")]
    return profiles.star(read(s, d, "lineitem"), sides).select("l_orderkey", "l_linenumber", "p_brand", "n_name", "s_acctbal")


@query("j6_p14_novelty", f"WITH {SPLIT}, k AS (SELECT DISTINCT user_id, k FROM s WHERE split = 'train' AND k IS NOT NULL) SELECT event_id, CASE WHEN k.user_id IS NULL THEN 1 ELSE 0 END AS is_new FROM s LEFT JOIN k ON s.user_id = k.user_id AND s.k = k.k")
def _j6(s: SparkSession, d: str) -> DataFrame:
    df = split_events(s, d)
    return profiles.novelty_flag(df, df.where("split = 'train'"), ["user_id", "k"], "is_new").select("event_id", "is_new")


@query("a18_gap_stats", f"WITH {EVENTS}, g AS (SELECT user_id, t_us, (t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id)) / 1e6 AS gap FROM e) SELECT user_id, round(coalesce(median(gap), 0), 3) AS median_gap, round(coalesce(stddev_samp(gap), 0), 3) AS std_gap, round(coalesce(min(gap), 0), 3) AS min_gap, count(*) FILTER (gap < 60) AS burst, round(count(gap) / greatest((max(t_us) - min(t_us)) / 86400e6, 1.0), 4) AS daily_rate FROM g GROUP BY user_id")
def _a18(s: SparkSession, d: str) -> DataFrame:
    g = profiles.gap_stats(events(s, d), "user_id", "t_us", "event_id")
    return g.select("user_id", *(r(c, 3).alias(c) for c in ("median_gap", "std_gap", "min_gap")), "burst", r("daily_rate").alias("daily_rate"))


@query("a19_daily_counts", f"WITH {EVENTS}, n AS (SELECT user_id, t_us // 86400000000 AS day, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, round(avg(n), 4) AS mean_daily, round(coalesce(stddev_samp(n), 0), 4) AS std_daily FROM n GROUP BY user_id")
def _a19(s: SparkSession, d: str) -> DataFrame:
    return rounded(profiles.daily_counts(events(s, d), "user_id", "t_us"))


@query("a20_rfm", f"WITH {EVENTS} SELECT user_id, round(((SELECT max(t_us) FROM e) - max(t_us)) / 86400e6, 4) AS recency, count(*) AS frequency, round(avg(value), 4) AS monetary FROM e GROUP BY user_id")
def _a20(s: SparkSession, d: str) -> DataFrame:
    return rounded(profiles.rfm(events(s, d), "user_id", "t_us", "value"))


@query("a24_circular", f"WITH {EVENTS}, h AS (SELECT user_id, ((t_us // 3600000000) % 24) * 2 * pi() / 24 AS a FROM e), m AS (SELECT user_id, avg(sin(a)) AS s, avg(cos(a)) AS c FROM h GROUP BY user_id) SELECT user_id, round(s, 4) AS mean_sin, round(c, 4) AS mean_cos, round(sqrt(s * s + c * c), 4) AS concentration, round(atan2(s, c), 4) AS mean_angle FROM m")
def _a24(s: SparkSession, d: str) -> DataFrame:
    return rounded(profiles.circular_profile(events(s, d), "user_id", F.floor(F.col("t_us") / HOUR) % 24))


@query("a25_failure_rate", "SELECT user_id, round(count(*) FILTER (event_type = 'error') / greatest(count(*), 1), 6) AS failure_rate FROM events GROUP BY user_id")
def _a25(s: SparkSession, d: str) -> DataFrame:
    return rounded(profiles.failure_rate(events(s, d), "user_id", F.col("event_type") == "error"), 6)


@query("a26_corridor", f"WITH {LINES} SELECT l_suppkey, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(median(l_extendedprice), 6) AS median, round(avg(label), 4) AS rate, round(quantile_cont(l_extendedprice, 0.25) - 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)), 6) AS low, round(quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)), 6) AS high FROM l GROUP BY ALL")
def _a26(s: SparkSession, d: str) -> DataFrame:
    c = profiles.corridor(lines(s, d), ["l_suppkey", "l_linestatus"], "l_extendedprice", "label")
    return c.select("l_suppkey", "l_linestatus", "n", *(r(x, 6).alias(x) for x in ("mean", "median", "low", "high")), r("rate").alias("rate"))


@query("a28_trajectory", f"WITH {EVENTS}, x AS (SELECT user_id, ln(1 + value) AS x, row_number() OVER w AS rn, row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) AS back, ln(1 + value) - lag(ln(1 + value)) OVER w AS jump FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)) SELECT user_id, round(coalesce(regr_slope(x, rn), 0), 6) AS slope, round(coalesce(var_samp(x), 0), 4) AS variance, round(coalesce(max(jump), 0), 4) AS max_jump, round(max(x) FILTER (back <= 5) - coalesce(avg(x) FILTER (back > 5), max(x) FILTER (back <= 5)), 4) AS bust_score FROM x GROUP BY user_id")
def _a28(s: SparkSession, d: str) -> DataFrame:
    t = profiles.trajectory(events(s, d), "user_id", "t_us", "event_id", "value")
    return t.select("user_id", r("slope", 6).alias("slope"), r("variance").alias("variance"), r("max_jump").alias("max_jump"), r("bust_score").alias("bust_score"))


@query("a33_client_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 4) AS client_score FROM events")
def _a33(s: SparkSession, d: str) -> DataFrame:
    return rounded(profiles.client_average(events(s, d), "user_id", "value"), 4, "event_id", "client_score")


@query("a38_min_support", "SELECT o_custkey, round(avg(o_totalprice), 6) AS mean, count(o_totalprice) AS count FROM orders GROUP BY o_custkey HAVING count(*) >= 5")
def _a38(s: SparkSession, d: str) -> DataFrame:
    return rounded(profiles.entity_profile(orders(s, d), "o_custkey", "o_totalprice", ("mean", "count"), min_support=5), 6)


# --- encodings ---


@query("a7_frequency", "SELECT event_type, round(count(*) / (SELECT count(*) FROM events WHERE event_type IS NOT NULL), 6) AS freq FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def _a7(s: SparkSession, d: str) -> DataFrame:
    return rounded(encodings.frequency(events(s, d), ["event_type"], "freq"), 6)


@query("a8_counts", "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey")
def _a8(s: SparkSession, d: str) -> DataFrame:
    return encodings.counts(read(s, d, "orders"), "o_custkey", "n_orders")


@query("a9_interaction", "SELECT o_orderstatus, o_orderpriority, round(count(*) / (SELECT count(*) FROM orders), 6) AS freq FROM orders GROUP BY ALL")
def _a9(s: SparkSession, d: str) -> DataFrame:
    return rounded(encodings.frequency(read(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], "freq", nulls="level"), 6)


for _kind, _formula in (("additive", "(s + 20 * g) / (n + 20)"), ("sigmoid", "s / n / (1 + exp(-(n - 20) / 10.0)) + g * (1 - 1 / (1 + exp(-(n - 20) / 10.0)))"), ("raw", "s / n")):

    @query({"additive": "a10_a14_additive_te", "sigmoid": "a11_sigmoid_te", "raw": "a15_static_rate"}[_kind], f"WITH {LINES}, g AS (SELECT avg(label) AS g FROM l), c AS (SELECT l_suppkey, CAST(sum(label) AS DOUBLE) AS s, count(*) AS n FROM l GROUP BY l_suppkey) SELECT l_suppkey, round({_formula}, 6) AS te FROM c, g")
    def _te(s: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        return rounded(encodings.target(lines(s, d), "l_suppkey", "label", "te", kind), 6)


@query("a12_conditional_te", f"WITH {LINES}, x AS (SELECT * FROM l WHERE l_linestatus = 'F'), g AS (SELECT avg(label) AS g FROM x), c AS (SELECT l_suppkey, CAST(sum(label) AS DOUBLE) AS s, count(*) AS n FROM x GROUP BY l_suppkey) SELECT l_suppkey, round(s / n / (1 + exp(-(n - 20) / 10.0)) + g * (1 - 1 / (1 + exp(-(n - 20) / 10.0))), 6) AS te FROM c, g")
def _a12(s: SparkSession, d: str) -> DataFrame:
    return rounded(encodings.target(lines(s, d), "l_suppkey", "label", "te", "sigmoid", where=F.col("l_linestatus") == "F"), 6)


@query("a16_daily_labels", f"WITH {LINES} SELECT l_suppkey, t_us // 86400000000 AS day, CAST(sum(label) AS BIGINT) AS frauds, count(*) AS n FROM l GROUP BY ALL")
def _a16(s: SparkSession, d: str) -> DataFrame:
    return risk.daily_labels(lines(s, d), "l_suppkey", "t_us", "label")


@query("a17_woe", f"WITH {LINES}, c AS (SELECT l_suppkey, sum(label) AS p, sum(1 - label) AS q FROM l GROUP BY l_suppkey) SELECT l_suppkey, round(ln(greatest(p / (SELECT sum(p) FROM c), 1e-6) / greatest(q / (SELECT sum(q) FROM c), 1e-6)), 6) AS woe FROM c")
def _a17(s: SparkSession, d: str) -> DataFrame:
    return rounded(encodings.weight_of_evidence(lines(s, d), "l_suppkey", "label", "woe"), 6)


# --- velocity and risk ---

_V = ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, t_us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS user_id_{n}_count, round(sum(value) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) - sum(value) OVER (PARTITION BY user_id, t_us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) + 0.0 AS user_id_{n}_sum" for n, w in velocity.DAILY.items())
_VC = [f"user_id_{n}_{a}" for n in velocity.DAILY for a in ("count", "sum")]


@query("v1_velocity", f"WITH {EVENTS} SELECT event_id, {_V} FROM e")
def _v1(s: SparkSession, d: str) -> DataFrame:
    return rounded(velocity.velocity(events(s, d), "user_id", "t_us", "value", "event_id"), 2, "event_id", *_VC)


@query("v1_velocity_spread", f"WITH {EVENTS} SELECT event_id, {_V} FROM e")
def _v1s(s: SparkSession, d: str) -> DataFrame:
    return rounded(velocity.velocity(events(s, d), "user_id", "t_us", "value", "event_id", spread=True), 2, "event_id", *_VC)


@query("v1_tie_exact", f"WITH {ORDERS} SELECT a.o_orderkey, (SELECT count(*) FROM o b WHERE b.o_custkey = a.o_custkey AND b.t_us >= a.t_us - 31536000000000 AND (b.t_us < a.t_us OR (b.t_us = a.t_us AND b.o_orderkey < a.o_orderkey))) AS o_custkey_1y_count FROM o a")
def _v1t(s: SparkSession, d: str) -> DataFrame:
    return velocity.velocity(orders(s, d), "o_custkey", "t_us", "o_totalprice", "o_orderkey", {"1y": 365 * DAY}, ("count",)).select("o_orderkey", "o_custkey_1y_count")


# counts are of rows, sums of known values; a null user has zeros and NaN is null, as `velocity` and `normalise` have it
@query("v2_velocity_stack", f"WITH {SPLIT}, x AS (SELECT *, split = 'train' AND user_id IS NOT NULL AS hist, CASE WHEN hist AND NOT isnan(value) THEN value END AS v FROM s) SELECT event_id, count(CASE WHEN hist THEN 1 END) OVER h AS user_id_1h_count, round(coalesce(sum(v) OVER d, 0), 2) AS user_id_1d_sum, round(coalesce(max(v) OVER d, 0), 2) AS user_id_1d_max FROM x WINDOW h AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)")
def _v2(s: SparkSession, d: str) -> DataFrame:
    df = split_events(s, d).withColumn("is_hist", F.col("split") == "train")
    out = velocity.velocity(df, "user_id", "t_us", "value", "event_id", velocity.STACK, ("count", "sum", "max"), ties="inclusive", history="is_hist")
    return rounded(out, 2, "event_id", "user_id_1h_count", "user_id_1d_sum", "user_id_1d_max")


@query("v3_window_stats", f"WITH {EVENTS} SELECT event_id, round(avg(value) OVER w, 4) AS user_id_1d_avg, round(stddev_samp(value) OVER w, 4) AS user_id_1d_std, count(DISTINCT value) OVER w AS user_id_1d_distinct FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)")
def _v3(s: SparkSession, d: str) -> DataFrame:
    out = velocity.velocity(events(s, d), "user_id", "t_us", "value", "event_id", {"1d": DAY}, ("avg", "std", "distinct"), ties="strict")
    return rounded(out, 4, "event_id", "user_id_1d_avg", "user_id_1d_std", "user_id_1d_distinct")


@query("v6_v10_ratios", f"WITH {EVENTS}, x AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS h, count(*) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS d, count(*) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING) AS m FROM e) SELECT event_id, round((h + 1) / (d + 1), 6) AS burst_1h_1d, round(d / greatest(m / 30, 0.1), 6) AS velocity_ratio FROM x")
def _v6(s: SparkSession, d: str) -> DataFrame:
    out = velocity.velocity(events(s, d), "user_id", "t_us", "value", "event_id", {"1h": HOUR, "1d": DAY, "30d": 30 * DAY}, ("count",), ties="strict", prefix="u")
    return out.select("event_id", r(velocity.burst_ratio("u_1h_count", "u_1d_count"), 6).alias("burst_1h_1d"), r(velocity.velocity_ratio("u_1d_count", "u_30d_count"), 6).alias("velocity_ratio"))


_RR = "d AS (SELECT l_suppkey, t_us // 86400000000 AS day, sum(label) AS f, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT avg(label) AS g FROM l), w AS (SELECT l_suppkey, day, coalesce(sum(f) OVER x, 0) AS f, coalesce(sum(n) OVER x, 0) AS n FROM d WINDOW x AS (PARTITION BY l_suppkey ORDER BY day RANGE BETWEEN {a} PRECEDING AND {b} PRECEDING))"


@query("v7_rolling_rate", f"WITH {LINES}, {_RR.format(a=28, b=1)} SELECT l_orderkey, l_linenumber, round((w.f + 10 * g) / (w.n + 10), 6) AS rate_28d FROM l JOIN w ON l.l_suppkey = w.l_suppkey AND l.t_us // 86400000000 = w.day, g")
def _v7(s: SparkSession, d: str) -> DataFrame:
    df = lines(s, d)
    return rounded(risk.rolling_rate(df, df, "l_suppkey", "t_us", "label"), 6, "l_orderkey", "l_linenumber", "rate_28d")


@query("v8_v9_delayed_rate", f"WITH {LINES}, {_RR.format(a=35, b=8)} SELECT l_orderkey, l_linenumber, round((w.f + 10 * g) / (w.n + 10), 6) AS rate, CAST(w.n AS BIGINT) AS volume, CASE WHEN (w.f + 10 * g) / (w.n + 10) > 5 * g THEN 1 ELSE 0 END AS rate_high FROM l JOIN w ON l.l_suppkey = w.l_suppkey AND l.t_us // 86400000000 = w.day, g")
def _v8(s: SparkSession, d: str) -> DataFrame:
    df = lines(s, d)
    return rounded(risk.rolling_rate(df, df, "l_suppkey", "t_us", "label", days=35, delay=8, name="rate", volume="volume"), 6, "l_orderkey", "l_linenumber", "rate", "volume", "rate_high")


@query("v15_escalation", f"WITH {EVENTS} SELECT event_id, round(max(value) OVER d / greatest(coalesce(avg(value) OVER m, 1.0), 1.0), 4) AS escalation, round(value / max(value) OVER w, 4) AS vs_week_max FROM e WINDOW d AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), m AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)")
def _v15(s: SparkSession, d: str) -> DataFrame:
    out = velocity.escalation(events(s, d), "user_id", "t_us", "value")
    # quotients of cents often lie halfway between two digits: rounded as the SQL's engine does, by whole ten thousandths
    return out.select("event_id", *((F.round(F.col(c) * 1e4) / 1e4).alias(c) for c in ("escalation", "vs_week_max")))


@query("a31_share_shift", f"WITH {EVENTS} SELECT event_id, round(avg(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) - avg(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS share_shift FROM e")
def _a31(s: SparkSession, d: str) -> DataFrame:
    return rounded(velocity.share_shift(events(s, d), "user_id", "t_us", "event_id", F.col("event_type") == "purchase"), 6, "event_id", "share_shift")


@query("v24_drift", f"WITH {ORDERS} SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY t_us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING) - avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY t_us RANGE BETWEEN 7776000000000 PRECEDING AND 5184000000000 PRECEDING), 2) AS drift FROM o")
def _v24(s: SparkSession, d: str) -> DataFrame:
    return rounded(velocity.drift(orders(s, d), "o_custkey", "t_us", "o_totalprice"), 2, "o_orderkey", "drift")


@query("a32_recipient", f"WITH {LINES}, x AS (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM l) SELECT id, round(sum(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 2) AS received_1d, round((t_us - min(t_us) OVER (PARTITION BY l_suppkey)) / 86400e6, 4) AS recipient_age_days FROM x")
def _a32(s: SparkSession, d: str) -> DataFrame:
    df = lines(s, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = velocity.recipient_profile(df, "l_suppkey", "l_partkey", "t_us", "l_extendedprice")
    return out.select("id", r("received_1d", 2).alias("received_1d"), r("recipient_age_days").alias("recipient_age_days"))


# --- sequences ---


@query("v5_v13_gap", f"WITH {EVENTS} SELECT event_id, round((t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id)) / 1e6, 3) AS gap_s, round((t_us - min(t_us) OVER (PARTITION BY user_id)) / 86400e6, 4) AS age_days FROM e")
def _v5(s: SparkSession, d: str) -> DataFrame:
    g = sequence.gap(events(s, d), "user_id", "t_us", "event_id")
    return g.select("event_id", r("gap_s", 3).alias("gap_s"), r("age_days").alias("age_days"))


@query("v11_amount_rank", f"WITH {EVENTS}, x AS (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS last, max(value) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT event_id, round(len(list_filter(last, lambda v: v <= value)) / nullif(len(last), 0), 6) AS amount_rank, CASE WHEN top IS NULL OR value > top THEN 1 ELSE 0 END AS is_max_ever FROM x")
def _v11(s: SparkSession, d: str) -> DataFrame:
    return rounded(sequence.amount_rank(events(s, d), "user_id", "t_us", "event_id", "value"), 6, "event_id", "amount_rank", "is_max_ever")


@query("v12_first_seen", f"WITH {EVENTS} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, k ORDER BY t_us, event_id) = 1 THEN 1 ELSE 0 END AS is_new_k FROM e")
def _v12(s: SparkSession, d: str) -> DataFrame:
    return sequence.first_seen(events(s, d), "user_id", "k", "t_us", "event_id", "is_new_k").select("event_id", "is_new_k")


@query("v16_cusum", f"WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e), b AS (SELECT user_id, avg(value) AS mu, greatest(CASE WHEN count(value) > 1 THEN coalesce(stddev_samp(value), 0) ELSE 1 END, 0.01 * abs(avg(value)) + 1) AS sigma FROM n WHERE rn <= greatest(2, n // 2) GROUP BY user_id), p AS (SELECT event_id, user_id, t_us, sum((value - mu) / sigma - 0.5) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS p FROM e JOIN b USING (user_id)) SELECT event_id, round(p - least(0.0, min(p) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)), 4) AS cusum FROM p")
def _v16(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d)
    return rounded(sequence.cusum(df, sequence.cusum_baseline(df, "user_id", "t_us", "event_id", "value"), "user_id", "t_us", "event_id", "value"), 4, "event_id", "cusum")


@query("v18_peer_zscore", "WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS m, coalesce(stddev_samp(c_acctbal), 0) AS sd FROM customer GROUP BY 1) SELECT c_custkey, round((c_acctbal - m) / greatest(sd, 0.01), 4) AS peer_z FROM customer JOIN m USING (c_mktsegment)")
def _v18(s: SparkSession, d: str) -> DataFrame:
    return rounded(sequence.peer_zscore(read(s, d, "customer"), "c_mktsegment", "c_acctbal", "peer_z"), 4, "c_custkey", "peer_z")


@query("v25_since_event", f"WITH {EVENTS} SELECT event_id, round((t_us - max(CASE WHEN event_type = 'error' THEN t_us END) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6, 3) AS since_error_s, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS errors_1d FROM e")
def _v25(s: SparkSession, d: str) -> DataFrame:
    df, bad = events(s, d), F.col("event_type") == "error"
    out = sequence.events_before(sequence.since_event(df, "user_id", "t_us", "event_id", bad, "since_error_s"), "user_id", "t_us", bad, DAY, "errors_1d")
    return out.select("event_id", r("since_error_s", 3).alias("since_error_s"), "errors_1d")


@query("v14_geo_speed", f"WITH {ORDERS}, x AS (SELECT o_orderkey, t_us, o_custkey, radians(o_orderkey % 60 - 30) AS a, radians(o_orderkey % 90 - 45) AS o FROM o), y AS (SELECT *, lag(a) OVER w AS pa, lag(o) OVER w AS po, (t_us - lag(t_us) OVER w) / 3600e6 AS h FROM x WINDOW w AS (PARTITION BY o_custkey ORDER BY t_us, o_orderkey)), z AS (SELECT *, 2 * 6371 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((a - pa) / 2), 2) + cos(pa) * cos(a) * pow(sin((o - po) / 2), 2))))) AS km FROM y) SELECT o_orderkey, CASE WHEN pa IS NOT NULL THEN round(km, 3) END AS km_from_last, CASE WHEN pa IS NOT NULL THEN round(km / CASE WHEN h > 0 THEN h END, 4) END AS km_per_hour FROM z")
def _v14(s: SparkSession, d: str) -> DataFrame:
    df = orders(s, d).withColumns({"lat": F.col("o_orderkey") % 60 - 30, "lon": F.col("o_orderkey") % 90 - 45})
    g = sequence.geo_speed(df, "o_custkey", "t_us", "o_orderkey", "lat", "lon")
    return g.select("o_orderkey", r("km_from_last", 3).alias("km_from_last"), r("km_per_hour").alias("km_per_hour"))


@query("v19_running_best", f"WITH {EVENTS}, d AS (SELECT t_us // 86400000000 AS day, max(value) AS v FROM e GROUP BY 1) SELECT day, v, max(v) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS best_so_far FROM d")
def _v19(s: SparkSession, d: str) -> DataFrame:
    return sequence.running_best(events(s, d).groupBy(F.floor(F.col("t_us") / DAY).alias("day")).agg(F.max("value").alias("v")), "day", "v")


# --- statistics ---

_NUM = ["o_totalprice", "o_custkey"]
_IV = """SELECT '{c}' AS "column", round(coalesce(sum((q - p) * ln(q / p)), 0), 4) AS iv FROM (
  SELECT greatest(sum(1 - label) / any_value(tq), 1e-6) AS q, greatest(sum(label) / any_value(tp), 1e-6) AS p FROM (
    SELECT label, {c} AS x, sum(label) OVER () AS tp, sum(1 - label) OVER () AS tq, len(list_filter(b, lambda z: z <= {c})) AS bin
    FROM o, (SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS b FROM o)) GROUP BY bin)"""


@query("m1_information_value", f"WITH {ORDERS} " + " UNION ALL ".join(_IV.format(c=c) for c in _NUM))
def _m1(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.information_value(orders(s, d), "label", _NUM))


@query("m3_m4_categorical_iv", f"WITH {ORDERS}, c AS (SELECT o_orderpriority, sum(label) AS p, sum(1 - label) AS q FROM o GROUP BY 1), x AS (SELECT greatest(p / (SELECT sum(p) FROM c), 1e-6) AS p, greatest(q / (SELECT sum(q) FROM c), 1e-6) AS q FROM c), i AS (SELECT sum((q - p) * ln(q / p)) AS iv FROM x) SELECT 'o_orderpriority' AS \"column\", round(iv, 6) AS iv, CASE WHEN iv > .5 THEN 'LEAK?' WHEN iv > .3 THEN 'strong' WHEN iv > .1 THEN 'medium' WHEN iv > .02 THEN 'weak' ELSE 'none' END AS grade FROM i")
def _m3(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.categorical_iv(orders(s, d), "label", ["o_orderpriority"]).withColumn("grade", stats.iv_grade(F.col("iv"))), 6)


_PSI = """SELECT '{c}' AS "column", round(sum((a - e) * ln(a / e)), 4) AS psi FROM (
  SELECT greatest(count(*) FILTER (split = 'train') / any_value(te), 1e-6) AS e, greatest(count(*) FILTER (split = 'oot') / any_value(ta), 1e-6) AS a FROM (
    SELECT split, count(*) FILTER (split = 'train') OVER () AS te, count(*) FILTER (split = 'oot') OVER () AS ta, len(list_filter(b, lambda z: z <= {c})) AS bin
    FROM s, (SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS b FROM s WHERE split = 'train') WHERE split IN ('train', 'oot')) GROUP BY bin)"""


@query("m5_m6_psi", f"WITH {SPLIT} SELECT *, CASE WHEN psi > 0.25 THEN 'SHIFT!' WHEN psi > 0.1 THEN 'moderate' ELSE 'stable' END AS grade FROM (" + " UNION ALL ".join(_PSI.format(c=c) for c in ("value", "user_id")) + ")")
def _m5(s: SparkSession, d: str) -> DataFrame:
    df = split_events(s, d)
    return rounded(stats.psi(df.where("split = 'train'"), df.where("split = 'oot'"), ["value", "user_id"])).withColumn("grade", stats.psi_grade(F.col("psi")))


_AUC = """SELECT '{c}' AS "column", round(sum(p * (cq - q / 2)) / (sum(p) * sum(q)), 6) AS auc FROM (SELECT *, sum(q) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS cq FROM (SELECT {c} AS x, sum(label) AS p, sum(1 - label) AS q FROM l GROUP BY 1))"""


@query("m8_auc", f"WITH {LINES} " + " UNION ALL ".join(_AUC.format(c=c) for c in ("l_quantity", "l_extendedprice", "t_us")))
def _m8(s: SparkSession, d: str) -> DataFrame:
    return rounded(stats.auc(stats.unpivot(lines(s, d), ["l_quantity", "l_extendedprice", "t_us"], "label")), 6)


@query("m10_null_flag_auc", f"WITH {EVENTS}, x AS (SELECT label, CASE WHEN k % 7 = 0 THEN NULL ELSE value END AS v FROM e), n AS (SELECT avg(CAST(v IS NULL AS INT)) AS r, sum(CASE WHEN v IS NULL THEN label END) / sum(label) AS pn, sum(CASE WHEN v IS NULL THEN 1 - label END) / sum(1 - label) AS qn FROM x) SELECT 'v' AS \"column\", round(r, 6) AS null_rate, round(greatest((1 + pn - qn) / 2, 1 - (1 + pn - qn) / 2), 6) AS null_auc FROM n")
def _m10(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d).select("label", F.when(F.col("k") % 7 != 0, F.col("value")).alias("v"))
    return rounded(stats.null_flag_auc(df, "label", ["v"]), 6)


@query("m13_correlation", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(abs(corr(l_quantity, l_extendedprice)), 4) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(abs(corr(l_quantity, l_discount)), 4) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(abs(corr(l_extendedprice, l_discount)), 4) FROM lineitem")
def _m13(s: SparkSession, d: str) -> DataFrame:
    return stats.correlation_flags(read(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], least=0.0)


# --- metrics ---


def scored(s: SparkSession, d: str) -> DataFrame:
    """Line items with a score that follows the ship date, rounded so that there are ties."""
    return lines(s, d).select("l_orderkey", "l_linenumber", "l_suppkey", "label", F.round(F.col("l_quantity") / 50 - F.col("l_discount"), 2).alias("score"))


_SC = LINES + ", x AS (SELECT l_suppkey, label, round(l_quantity / 50 - l_discount, 2) AS score FROM l)"
_TH = _SC + ", c AS (SELECT score, sum(label) AS p, count(*) AS k FROM x GROUP BY score), t AS (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS tk, (SELECT sum(p) FROM c) AS np FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query("m15_average_precision", f"WITH {_TH} SELECT round(sum(p * tp / tk) / any_value(np), 6) AS auprc FROM t")
def _m15(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(scored(s, d)), 6)


@query("m16_precision_at_recall", f"WITH {_TH}, b AS (SELECT tp / tk AS precision, score, tp / np AS recall FROM t WHERE tp / np >= 0.5 ORDER BY precision DESC, score LIMIT 1) SELECT round(precision, 6) AS precision, score AS threshold, round(recall, 6) AS recall FROM b")
def _m16(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.precision_at_recall(scored(s, d), 0.5), 6)


@query("m20_confusion", f"WITH {_SC} SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn, round(count(*) FILTER (score >= 0.5 AND label = 0) / count(*) FILTER (label = 0), 6) AS fpr, round(count(*) FILTER (score >= 0.5) / count(*) FILTER (label = 1), 6) AS review_burden FROM x")
def _m20(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.confusion(scored(s, d), 0.5), 6)


@query("m24_recall_at_fpr", f"WITH {_TH} SELECT round(max(tp / np), 6) AS recall FROM t WHERE tk - tp <= 0.1 * (SELECT sum(k - p) FROM c)")
def _m24(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.recall_at_fpr(scored(s, d), 0.1), 6)


@query("m24_brier", f"WITH {_SC} SELECT round(avg(pow(score - label, 2)), 6) AS brier FROM x")
def _m24b(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.brier(scored(s, d)), 6)


@query("m21_composite", f"WITH {EVENTS} SELECT event_id, CASE WHEN value / 1000 >= 0.25 THEN 0 ELSE round(0.5 * (k / 100.0) + 0.25 * 0.4 - 0.10 * least(1.0, greatest(0.0, (value / 1000 - 0.10) / 0.15)) - 0.05 * least(1.0, greatest(0.0, (0.2 - 0.10) / 0.15)) - 0.05 * least(1.0, greatest(0.0, (0.05 - 0.02) / 0.08)) - 0.05 * least(1.0, greatest(0.0, (0.02 - 0.03) / 0.12)), 6) END AS composite FROM e")
def _m21(s: SparkSession, d: str) -> DataFrame:
    c = metrics.composite_column(F.col("k") / 100.0, F.lit(0.4), F.col("value") / 1000, F.lit(0.2), F.lit(0.05), F.lit(0.02))
    return events(s, d).select("event_id", r(c, 6).alias("composite"))



def _poisson(mean: str, name: str) -> str:
    """DuckDB form of `metrics.poisson`."""
    u, v = (f"(CAST('0x' || substr(md5('{x}|42|{name}|' || place || '|' || rep), 1, 12) AS BIGINT) / 281474976710656.0)" for x in "uv")
    below = f"list_sum(list_transform(range(0, j + 1), lambda i: exp(-{mean} + i * ln({mean}) - lgamma(i + 1))))"
    return f"""CASE WHEN {mean} <= 0 THEN 0 WHEN {mean} <= 30 THEN len(list_filter(range(0, CAST(floor({mean} + 8 * sqrt({mean}) + 12) AS BIGINT)), lambda j: {below} <= {u}))
  ELSE greatest(floor(round({mean} + sqrt({mean}) * sqrt(-2 * ln(1 - {v})) * cos(2 * pi() * {u}) + 0.5, 6)), 0) END"""


@query("m17_bootstrap_ci", f"""WITH {_SC}, c AS (SELECT score, CAST(sum(label) AS BIGINT) AS p, count(*) AS k FROM x GROUP BY score), o AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS place FROM c),
d AS (SELECT place, rep, CAST({_poisson('p', 'p')} AS BIGINT) AS wp, CAST({_poisson('(k - p)', 'n')} AS BIGINT) AS wn FROM o, range(0, 200) r(rep)),
w AS (SELECT rep, wp, sum(wp) OVER y AS rp, sum(wp + wn) OVER y AS rk FROM d WINDOW y AS (PARTITION BY rep ORDER BY place ROWS UNBOUNDED PRECEDING)),
a AS (SELECT rep, sum(CASE WHEN rk > 0 THEN wp * rp / rk END) / sum(wp) AS ap FROM w GROUP BY rep)
SELECT round(quantile_cont(ap, 0.025), 4) AS low, round(quantile_cont(ap, 0.975), 4) AS high FROM a""")
def _m17(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bootstrap_ci(scored(s, d)))


@query("v21_rank_average", f"WITH {EVENTS}, x AS (SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS a, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS b, count(*) OVER () AS n FROM e) SELECT event_id, round((a + b) / 2 / n, 6) AS ensemble FROM x")
def _v21(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.rank_average(events(s, d), "event_id", ["value", "k"]), 6, "event_id", "ensemble")


# --- anomaly, graph ---


@query("f15_mahalanobis", "WITH m AS (SELECT avg(l_quantity) AS m0, stddev_samp(l_quantity) AS s0, avg(l_extendedprice) AS m1, stddev_samp(l_extendedprice) AS s1, avg(l_discount) AS m2, stddev_samp(l_discount) AS s2 FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, pow((l_quantity - m0) / s0, 2) AS a, pow((l_extendedprice - m1) / s1, 2) AS b, pow((l_discount - m2) / s2, 2) AS c FROM lineitem, m) SELECT l_orderkey, l_linenumber, round(sqrt(a + b + c), 4) AS anomaly_mahalanobis, round(greatest(a, b, c), 4) AS anomaly_max_zscore FROM z")
def _f15(s: SparkSession, d: str) -> DataFrame:
    df, cols = read(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(anomaly.mahalanobis_like(df, anomaly.standardisation(df, cols), cols), 4, "l_orderkey", "l_linenumber", "anomaly_mahalanobis", "anomaly_max_zscore")


@query("f39_hmm")
def _f39(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d)
    return rounded(anomaly.hmm_features(df, anomaly.fit_hmm(df, "user_id", "t_us", "event_id", "value"), "user_id", "t_us", "event_id", "value"), 4)


@query("f40_autoencoder")
def _f40(s: SparkSession, d: str) -> DataFrame:
    df, cols = lines(s, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    model = anomaly.fit_autoencoder(df, df.where("label = 0"), cols, "l_orderkey")
    return rounded(anomaly.reconstruction_error(df, model, cols), 4, "l_orderkey", "l_linenumber", "ae_error", "ae_log_error", "ae_max_error")


@query("f41_rfm_distance")
def _f41(s: SparkSession, d: str) -> DataFrame:
    df = events(s, d)
    profile, _ = anomaly.rfm_clusters(df, "user_id", "t_us", "value")
    return rounded(anomaly.rfm_distance(df, profile, "user_id"), 4, "event_id", "rfm_cluster", "rfm_distance", "rfm_log_distance")


@query("j11_shared_links", "WITH p AS (SELECT DISTINCT o_custkey, CAST(floor(o_totalprice) AS BIGINT) % 500000 AS x FROM orders), m AS (SELECT x, min(o_custkey) AS a FROM p GROUP BY x) SELECT DISTINCT a, o_custkey AS b FROM p JOIN m USING (x) WHERE a <> o_custkey")
def _j11(s: SparkSession, d: str) -> DataFrame:
    return graph.shared_links(order_prices(s, d), "o_custkey", "price")


def order_prices(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").withColumn("price", F.floor("o_totalprice") % 500000)


@query("f43_components", "WITH RECURSIVE p AS (SELECT DISTINCT o_custkey, CAST(floor(o_totalprice) AS BIGINT) % 500000 AS x FROM orders), m AS (SELECT x, min(o_custkey) AS a FROM p GROUP BY x), l AS (SELECT DISTINCT a, o_custkey AS b FROM p JOIN m USING (x) WHERE a <> o_custkey), b AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT a AS node, a AS other FROM b UNION SELECT r.node, b.b FROM r JOIN b ON r.other = b.a) SELECT node, min(other) AS component FROM r GROUP BY node")
def _f43(s: SparkSession, d: str) -> DataFrame:
    return graph.components(graph.shared_links(order_prices(s, d), "o_custkey", "price"))


@query("f43_pagerank")
def _f43p(s: SparkSession, d: str) -> DataFrame:
    return rounded(graph.shared_pagerank(order_prices(s, d), "o_custkey", "price"))


@query("u5_jaccard", "WITH s AS (SELECT user_id, list_distinct(list(event_type || CAST(CAST(regexp_extract(props, '[0-9]+') AS INT) % 10 AS VARCHAR))) AS a FROM events GROUP BY user_id), b AS (SELECT a AS b FROM s WHERE user_id = (SELECT min(user_id) FROM s)) SELECT user_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM s, b")
def _u5(s: SparkSession, d: str) -> DataFrame:
    sets = events(s, d).groupBy("user_id").agg(F.collect_set(F.concat("event_type", (F.col("k") % 10).cast("string"))).alias("a"))
    first = sets.orderBy("user_id").limit(1).select(F.col("a").alias("b"))
    return sets.crossJoin(F.broadcast(first)).select("user_id", r(signals.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


# --- the log, from the events: a day of a user type is an experiment ---

_LOG = EVENTS + """, g AS (SELECT event_type AS dataset, t_us // 86400000000 AS day, max(value) AS score, count(*) AS n_features FROM e GROUP BY ALL),
lg AS (SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY day) AS INT) AS seq, score, n_features, CASE WHEN day % 3 = 0 THEN 'keep' WHEN day % 7 = 0 THEN 'crash' ELSE 'discard' END AS status,
  CASE WHEN day % 2 = 0 THEN 'Velocity campaign step ' || (day % 5) || '/5' ELSE 'target encoding overhaul, recipe 17' END AS hypothesis FROM g)"""


def log(s: SparkSession, d: str) -> DataFrame:
    g = events(s, d).groupBy(F.col("event_type").alias("dataset"), F.floor(F.col("t_us") / DAY).alias("day")).agg(F.max("value").alias("score"), F.count(F.lit(1)).alias("n_features"))
    status = F.when(F.col("day") % 3 == 0, "keep").when(F.col("day") % 7 == 0, "crash").otherwise("discard")
    hypothesis = F.when(F.col("day") % 2 == 0, F.concat(F.lit("Velocity campaign step "), (F.col("day") % 5).cast("string"), F.lit("/5"))).otherwise("target encoding overhaul, recipe 17")
    return g.select("dataset", F.row_number().over(W.partitionBy("dataset").orderBy("day")).alias("seq"), "score", "n_features", status.alias("status"), hypothesis.alias("hypothesis")).withColumn("id", F.format_string("exp_%03d", "seq"))


@query("x3_best_kept", f"WITH {_LOG} SELECT dataset, max(seq) AS seq, arg_max(score, seq) AS score FROM lg WHERE status = 'keep' GROUP BY dataset")
def _x3(s: SparkSession, d: str) -> DataFrame:
    return experiments.best_kept(log(s, d)).select("dataset", "seq", "score")


@query("x1_next_id", f"WITH {_LOG} SELECT max(seq) + 1 AS next_id FROM lg")
def _x1(s: SparkSession, d: str) -> DataFrame:
    return experiments.next_id(log(s, d))


@query("x5_dataset_summary", f"WITH {_LOG} SELECT dataset, count(*) AS total, count(*) FILTER (status = 'keep') AS kept, count(*) FILTER (status = 'discard') AS discarded, count(*) FILTER (status = 'crash') AS crashed, max(score) FILTER (status = 'keep') AS best, arg_min(score, seq) FILTER (status = 'keep') AS baseline, round((max(score) FILTER (status = 'keep') - arg_min(score, seq) FILTER (status = 'keep')) / abs(arg_min(score, seq) FILTER (status = 'keep')) * 100, 1) AS improvement_pct FROM lg GROUP BY dataset")
def _x5(s: SparkSession, d: str) -> DataFrame:
    return experiments.dataset_summary(log(s, d), "score")


# every keyword in turn in a hypothesis or a feature's name, recipes in several spellings, growth up and down, unknown counts
_WORDS = ["uid", "construct_uid", "card1_addr1", "window_velocity", "vel_1h", "vel_24h", "vel_7d", "vel_60s", "vel_600s", "rolling_term", "term_fraud_28d", "rolling_fraud_rate", "term_compromise", "fingerprint", "von_mises", "Von Mises", "recipe 15", "recipe16", "RECIPE  17", "recipe 18 and recipe 19", "recipe18", "recipe 14", "hour of day", "Term campaign step 2/5", "big-one campaign step 1 of 3, uid_ x"]
_AMBITION = _LOG + f""", a AS (SELECT dataset, seq, CASE WHEN seq % 9 <> 0 THEN 'try ' || ({_WORDS!r})[(seq * 7) % {len(_WORDS)} + 1] END AS hypothesis, [({_WORDS!r})[(seq * 11) % {len(_WORDS)} + 1], 'plain'] AS names, CASE WHEN seq % 8 = 3 THEN 0 WHEN seq % 8 <> 5 THEN n_features END AS n FROM lg),
b AS (SELECT *, coalesce(n, 0) AS n0, row_number() OVER (PARTITION BY dataset ORDER BY seq DESC) AS back FROM a),
{{recent}}
p AS (SELECT *, last_value(nullif(n0, 0) IGNORE NULLS) OVER (PARTITION BY dataset ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, lower(coalesce(hypothesis, '')) AS h FROM rc),
q AS (SELECT *, CASE WHEN prev IS NULL THEN 0 ELSE n0 - prev END AS delta, h || ' ' || lower(names[1] || ' ' || names[2]) AS txt FROM p),
z AS (SELECT *, CAST({' OR '.join(f"contains(txt, '{w}')" for w in ('uid', 'card1_addr1', 'window_velocity', 'vel_1h', 'vel_24h', 'vel_7d', 'vel_60s', 'vel_600s', 'rolling_term', 'term_fraud_28d', 'rolling_fraud_rate', 'term_compromise', 'fingerprint', 'von_mises', 'von mises', 'recipe 15', 'recipe 16', 'recipe 17', 'recipe 18', 'recipe 19', 'recipe15', 'recipe16', 'recipe17', 'recipe18', 'recipe19'))} AS INT)
  + CAST(delta >= 8 AS INT) + CAST(regexp_matches(h, 'recipe\\s*1[5-9]') AS INT) AS signs FROM q),
y AS (SELECT *, CASE WHEN signs >= 2 THEN 'ambitious' WHEN signs = 1 OR (delta >= 4 AND delta < 8) THEN 'moderate' ELSE 'standard' END AS tier FROM z)"""


def ambition_log(s: SparkSession, d: str) -> DataFrame:
    seq, words = F.col("seq"), F.array(*map(F.lit, _WORDS))
    one = lambda by: F.get(words, (seq * by) % len(_WORDS))
    n = F.when(seq % 8 == 3, 0).when(seq % 8 != 5, F.col("n_features"))
    return log(s, d).select("dataset", "seq", F.when(seq % 9 != 0, F.concat(F.lit("try "), one(7))).alias("hypothesis"), F.map_from_arrays(F.array(one(11), F.lit("plain")), F.array(F.lit(0.5), F.lit(0.1))).alias("top_features"), n.alias("n_features"))


@query("x7_ambition", f"WITH {_AMBITION.replace('{recent}', 'rc AS (SELECT * FROM b),')} SELECT dataset, seq, delta AS feature_delta, tier AS ambition FROM y")
def _x7(s: SparkSession, d: str) -> DataFrame:
    return experiments.ambition(ambition_log(s, d)).select("dataset", "seq", "feature_delta", "ambition")



@query("x9_technique_rates", f"WITH {_LOG}, t AS (SELECT status, CASE WHEN contains(lower(hypothesis), 'velocity') THEN 'velocity' ELSE 'other' END AS technique FROM lg WHERE status <> 'crash') SELECT technique, count(*) FILTER (status = 'keep') AS keeps, count(*) FILTER (status <> 'keep') AS discards, round(count(*) FILTER (status = 'keep') / count(*), 6) AS rate FROM t GROUP BY technique")
def _x9(s: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.technique_rates(log(s, d)), 6)


@query("x12_streak", f"WITH {_LOG}, b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY seq DESC) AS back FROM lg), n AS (SELECT dataset, back, status, first_value(status) OVER (PARTITION BY dataset ORDER BY back) AS now FROM b WHERE back <= 10), c AS (SELECT *, sum(CASE WHEN status <> now THEN 1 ELSE 0 END) OVER (PARTITION BY dataset ORDER BY back) AS broken FROM n) SELECT dataset, now AS status, count(*) AS length FROM c WHERE broken = 0 GROUP BY ALL")
def _x12(s: SparkSession, d: str) -> DataFrame:
    return experiments.streak(log(s, d))


@query("x13_campaigns", f"WITH {_LOG}, b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY seq DESC) AS back, regexp_extract(hypothesis, '([A-Za-z0-9_-]+) campaign step ([0-9]+)/([0-9]+)', 1) AS name, regexp_extract(hypothesis, 'step ([0-9]+)/', 1) AS step FROM lg) SELECT dataset, name, 5 AS steps, count(DISTINCT step) AS done, count(*) FILTER (status = 'keep') AS kept, min(back) - 1 AS ago, min(back) - 1 >= 3 AND count(DISTINCT step) < 5 AS is_stalled FROM b WHERE back <= 15 AND name <> '' GROUP BY ALL")
def _x13(s: SparkSession, d: str) -> DataFrame:
    return experiments.campaigns(log(s, d))


@query("x18_index_totals", f"WITH {_LOG} SELECT dataset, count(*) AS experiments, max(score) FILTER (status = 'keep') AS best_kept FROM lg GROUP BY dataset")
def _x18(s: SparkSession, d: str) -> DataFrame:
    return experiments.index_totals(log(s, d), "score")
