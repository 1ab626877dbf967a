"""The feature plans over the driver's tables, with their whole DuckDB forms: fitted on the training split, all rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import splits
from ..operators.pipeline import run_plan
from ..operators.velocity import DAILY, FAST
from ..schema import DAY
from . import card_geo, card_terminal, identity, mobile_money
from .feature_queries import OFF
from .queries import LINES, SPLIT, events, lines, query, split_events


def finished(df: DataFrame) -> DataFrame:
    """Doubles rounded to four digits, a little off the halves; by whole ten thousandths, which is far cheaper than `round`."""
    return df.select(*((F.rint((F.col(c) + OFF) * 1e4) / 1e4 + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def digits(**columns: str) -> str:
    return ", ".join(f"round({e} + {OFF}, 4) AS {n}" for n, e in columns.items())


def windows(key: str, name: str, spans: dict[str, int], t: str = "t_us", row: str = "event_id", value: str = "value") -> str:
    """Counts and sums over the rows before each row, exact on ties."""
    out = []
    for n, w in spans.items():
        frame, ties = f"(PARTITION BY {key} ORDER BY {t} RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)", f"(PARTITION BY {key}, {t} ORDER BY {row} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        out.append(f"count(*) OVER {frame} - count(*) OVER {ties} AS {name}_{n}_count, round(sum({value}) OVER {frame} - sum({value}) OVER {ties} + {OFF}, 4) AS {name}_{n}_sum")
    return ", ".join(out)


_CLOCK = {f"{n}_{f}": f"{f}({e} * 2 * pi() / {p})" for n, e, p in (("hour", "((t_us // 3600000000) % 24)", 24), ("dow", "((t_us // 86400000000 + 3) % 7)", 7)) for f in ("sin", "cos")}
_NIGHT = "CASE WHEN (t_us // 3600000000) % 24 >= 22 OR (t_us // 3600000000) % 24 <= 6 THEN 1 ELSE 0 END AS is_night, CASE WHEN (t_us // 86400000000 + 3) % 7 >= 5 THEN 1 ELSE 0 END AS is_weekend"
_Z = lambda x, m, sd, floor=0.01: f"(({x}) - {m}) / greatest({sd}, {floor})"
_SUMMED = lambda name, spans: ", ".join(f"{name}_{n}_count, {name}_{n}_sum" for n in spans)

_CARD_TERMINAL = f"""WITH {SPLIT}, tr AS (SELECT * FROM s WHERE split = 'train'),
w AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, avg(label) AS g FROM tr),
cu AS (SELECT user_id, avg(value) AS cm, coalesce(stddev_samp(value), 1) AS cs, quantile_cont(value, 0.9) AS cp, count(DISTINCT k) AS cn FROM tr GROUP BY 1),
te AS (SELECT k, avg(value) AS tm, coalesce(stddev_samp(value), 1) AS ts, count(value) AS tn, avg(label) AS tf FROM tr GROUP BY 1),
dd AS (SELECT k, t_us // 86400000000 AS day, sum(label) AS f, count(*) AS n FROM tr GROUP BY ALL),
sp AS (SELECT k, day, sum(f) AS f, sum(n) AS n FROM (SELECT * FROM dd UNION ALL SELECT DISTINCT k, t_us // 86400000000, 0, 0 FROM s) GROUP BY ALL),
rr AS (SELECT k, day, coalesce(sum(f) OVER x, 0) AS f, coalesce(sum(n) OVER x, 0) AS n FROM sp WINDOW x AS (PARTITION BY k ORDER BY day RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, {windows('user_id', 'customer', DAILY)}, {windows('k', 'terminal', DAILY)} FROM s)
SELECT event_id AS row_id, v.user_id AS customer, v.k AS terminal, t_us, split, label, {digits(amount='value', **_CLOCK)}, {_NIGHT}, coalesce(cn, 1) AS cust_n_term_train, coalesce(tn, 0) AS term_tx_count,
  {digits(term_mean_amt='coalesce(tm, 0)', term_std_amt='coalesce(ts, 0)', term_static_fraud_rate='coalesce(tf, w.g)', amt_zscore_cust=_Z('value', 'coalesce(cm, w.m)', 'coalesce(cs, w.sd)'), amt_vs_p90='value / greatest(coalesce(cp, w.m), 1.0)', amt_zscore_term=_Z('value', 'coalesce(tm, 0)', 'coalesce(ts, 0)'))},
  CASE WHEN value < 50 THEN 1 ELSE 0 END AS amt_is_small, CASE WHEN round(value % 10, 6) < 0.01 THEN 1 ELSE 0 END AS amt_is_round, {_SUMMED('customer', DAILY)}, {_SUMMED('terminal', DAILY)},
  {digits(cust_burst_1h_1d='(customer_1h_count + 1) / (customer_1d_count + 1)', term_burst_1h_1d='(terminal_1h_count + 1) / (terminal_1d_count + 1)', term_fraud_rate_28d='(coalesce(rr.f, 0) + 10 * w.g) / (coalesce(rr.n, 0) + 10)')}
FROM v LEFT JOIN cu ON cu.user_id = v.user_id LEFT JOIN te ON te.k = v.k LEFT JOIN rr ON rr.k = v.k AND rr.day = v.t_us // 86400000000, w"""


@query("plan_card_terminal", _CARD_TERMINAL)
def _plan1(s: SparkSession, d: str) -> DataFrame:
    df = splits.quantile_split(events(s, d).select(F.col("event_id").alias("row_id"), F.col("user_id").alias("customer"), F.col("k").alias("terminal"), F.col("value").alias("amount"), "t_us", "label"))
    return finished(run_plan(card_terminal, df, "row_id", "label")[0])


_BLEND = lambda a, prior: f"{a}.sm / {a}.n / (1 + exp(-({a}.n - 20) / 10.0)) + {prior} * (1 - 1 / (1 + exp(-({a}.n - 20) / 10.0)))"
_RATE = lambda a, prior: f"CASE WHEN {a}.n IS NULL THEN {prior} ELSE {_BLEND(a, prior)} END"
_SUMS = lambda key, where="true": f"(SELECT {key}, CAST(sum(label) AS DOUBLE) AS sm, count(*) AS n FROM tr WHERE {where} GROUP BY 1)"

_MOBILE = f"""WITH {LINES}, b AS (SELECT (l_orderkey * 10 + l_linenumber) * 64 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, t_us) AS row_id, ['CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER'][l_linenumber % 5 + 1] AS kind, l_extendedprice AS amount, l_partkey AS snd, l_suppkey AS rcv, t_us // 86400000000 AS step, t_us, label FROM l),
q AS (SELECT quantile_cont(t_us, 0.7) AS q1, quantile_cont(t_us, 0.85) AS q2 FROM b), s AS (SELECT b.*, CASE WHEN t_us <= q1 THEN 'train' WHEN t_us <= q2 THEN 'val' ELSE 'oot' END AS split FROM b, q), tr AS (SELECT * FROM s WHERE split = 'train'),
w AS (SELECT avg(label) AS g, avg(CASE WHEN kind = 'TRANSFER' THEN label END) AS gt, avg(CASE WHEN kind = 'CASH_OUT' THEN label END) AS gc, avg(amount) AS m, stddev_samp(amount) AS sd FROM tr),
ty AS (SELECT kind, avg(amount) AS tm, coalesce(stddev_samp(amount), 1) AS ts FROM tr GROUP BY 1)
SELECT row_id, s.snd AS nameOrig, s.rcv AS nameDest, step, t_us, split, label, coalesce(fs.n, 0) AS sender_freq, coalesce(fr.n, 0) AS receiver_freq,
  {digits(amount='amount', oldbalanceOrg='amount * 2', newbalanceOrig='amount', oldbalanceDest='0.0', newbalanceDest='amount', sender_fraud_rate=_RATE('fs', 'w.g'), receiver_fraud_rate=_RATE('fr', 'w.g'), receiver_transfer_fraud_rate=_RATE('ft', 'w.gt'), sender_cashout_fraud_rate=_RATE('fc', 'w.gc'))},
  CASE s.kind WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3 ELSE 4 END AS type_enc, CAST(s.kind = 'TRANSFER' AS INT) AS is_transfer, CAST(s.kind = 'CASH_OUT' AS INT) AS is_cash_out, CAST(s.kind IN ('TRANSFER', 'CASH_OUT') AS INT) AS is_fraud_type,
  {digits(orig_balance_error='abs(amount * 2 - amount - amount)', dest_balance_error='abs(amount - 0.0 - amount)', log_orig_balance_error='ln(1 + abs(amount * 2 - amount - amount))', log_dest_balance_error='ln(1 + abs(amount - amount))', amount_to_balance='amount / (amount * 2 + 1)')},
  CAST(amount = 0 AS INT) AS orig_after_zero, CAST(amount * 2 = 0 AS INT) AS orig_was_zero, 1 AS dest_was_zero, CAST(amount > amount * 2 + 1 AS INT) AS amount_exceeds, step % 24 AS step_mod_24, step % 168 AS step_mod_168, step // 24 AS step_bin_day,
  {digits(log_amount='ln(1 + amount)', amount_zscore=_Z('amount', 'w.m', 'w.sd'), amount_type_zscore=_Z('amount', 'coalesce(tm, w.m)', 'coalesce(ts, 1.0)'), log_sender_freq='ln(1 + coalesce(fs.n, 0))', log_receiver_freq='ln(1 + coalesce(fr.n, 0))', log_old_from='ln(1 + amount * 2)', log_old_to='0.0')}
FROM s LEFT JOIN ty ON ty.kind = s.kind LEFT JOIN {_SUMS('snd')} fs ON fs.snd = s.snd LEFT JOIN {_SUMS('rcv')} fr ON fr.rcv = s.rcv
  LEFT JOIN {_SUMS('rcv', "kind = 'TRANSFER'")} ft ON ft.rcv = s.rcv LEFT JOIN {_SUMS('snd', "kind = 'CASH_OUT'")} fc ON fc.snd = s.snd, w"""


@query("plan_mobile_money", _MOBILE)
def _plan4(s: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, scalars.TYPE_ORDER)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    # an order's line numbers repeat: the place among equals makes the row id
    place = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "t_us"))
    df = lines(s, d).select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 64 + place).alias("row_id"), kinds.alias("type"), F.col("l_extendedprice").alias("amount"), F.col("l_partkey").alias("nameOrig"), F.col("l_suppkey").alias("nameDest"), F.floor(F.col("t_us") / DAY).alias("step"), (F.col("l_extendedprice") * 2).alias("oldbalanceOrg"), F.col("l_extendedprice").alias("newbalanceOrig"), F.lit(0.0).alias("oldbalanceDest"), F.col("l_extendedprice").alias("newbalanceDest"), "t_us", "label")
    return finished(run_plan(mobile_money, splits.quantile_split(df), "row_id", "label")[0])


# the events as card transactions with places: all of them come from the row's numbers
_PLACES = "(k % 50) - 20.0 AS lat, (user_id % 60) - 10.0 AS long, (k % 40) - 15.0 AS merch_lat, (event_id % 70) - 20.0 AS merch_long, CAST(k % 5 AS BIGINT) * 1000 AS city_pop, 'c' || k % 7 AS category, 'm' || k AS merchant, CASE WHEN k % 11 > 0 THEN 'g' || k % 2 END AS gender"
_KM = lambda a, o, b, p: f"2 * 6371 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin((radians({p}) - radians({o})) / 2), 2)))))"
_ADD = lambda key, name: f"(SELECT {key}, (sum(label) + 20 * any_value(g)) / (count(*) + 20) AS {name} FROM tr, w WHERE {key} IS NOT NULL GROUP BY 1)"
_FRQ = lambda key, name: f"(SELECT {key}, count(*) / (SELECT count({key}) FROM tr) AS {name} FROM tr WHERE {key} IS NOT NULL GROUP BY 1)"

_GEO = f"""WITH {SPLIT}, p AS (SELECT *, {_PLACES}, (t_us // 3600000000) % 24 AS hour FROM s), tr AS (SELECT * FROM p WHERE split = 'train'), w AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, avg(label) AS g FROM tr),
hm AS (SELECT user_id, arg_min(lat, (t_us, event_id)) AS hlat, arg_min(long, (t_us, event_id)) AS hlong FROM tr GROUP BY 1),
aw AS (SELECT user_id, avg(km) AS dm, coalesce(stddev_samp(km), 1) AS ds, quantile_cont(km, 0.9) AS dp FROM (SELECT user_id, {_KM('hlat', 'hlong', 'merch_lat', 'merch_long')} AS km FROM tr JOIN hm USING (user_id)) GROUP BY 1),
cu AS (SELECT user_id, avg(value) AS cm, coalesce(stddev_samp(value), 1) AS cs, quantile_cont(value, 0.9) AS cp, avg(hour) AS ch, count(DISTINCT merchant) AS nm, count(DISTINCT category) AS nc FROM tr GROUP BY 1),
sp AS (SELECT avg(nm) AS n, (SELECT avg(dm) FROM aw) AS d FROM cu), v AS (SELECT *, {windows('user_id', 'card_id', FAST)} FROM p),
x AS (SELECT v.*, w.*, sp.*, cu.* EXCLUDE (user_id), aw.* EXCLUDE (user_id), tc, tm, fc, fg, {_KM('coalesce(hlat, lat)', 'coalesce(hlong, long)', 'merch_lat', 'merch_long')} AS km
  FROM v LEFT JOIN hm ON hm.user_id = v.user_id LEFT JOIN aw ON aw.user_id = v.user_id LEFT JOIN cu ON cu.user_id = v.user_id LEFT JOIN {_ADD('category', 'tc')} a ON a.category = v.category LEFT JOIN {_ADD('merchant', 'tm')} b ON b.merchant = v.merchant
  LEFT JOIN {_FRQ('category', 'fc')} fcat ON fcat.category = v.category LEFT JOIN {_FRQ('gender', 'fg')} fgen ON fgen.gender = v.gender, w, sp)
SELECT event_id AS row_id, user_id AS card_id, t_us, split, label, city_pop, {_NIGHT}, coalesce(nc, 5) AS cust_n_categories_train, {_SUMMED('card_id', FAST)},
  {digits(amount='value', lat='lat', long='long', merch_lat='merch_lat', merch_long='merch_long', **_CLOCK, cust_n_merchants_train='coalesce(nm, n)', category_te='coalesce(tc, g)', merchant_te='coalesce(tm, g)', category_freq_enc='coalesce(fc, 0)', gender_freq_enc='coalesce(fg, 0)', haversine_km='km', log_haversine_km='ln(1 + km)', amt_zscore_cust=_Z('value', 'coalesce(cm, m)', 'coalesce(cs, sd)'), amt_vs_p90='value / greatest(coalesce(cp, m), 1.0)', hour_deviation='least(abs(hour - coalesce(ch, 12)), 24 - abs(hour - coalesce(ch, 12)))', burst_10m_1h='(card_id_10m_count + 1) / (card_id_1h_count + 1)', burst_1h_1d='(card_id_1h_count + 1) / (card_id_1d_count + 1)', dist_zscore_cust=_Z('km', 'coalesce(dm, d)', 'coalesce(ds, 1)', 0.1), dist_vs_p90='km / greatest(coalesce(dp, d), 1.0)', log_amt_x_log_dist='ln(1 + value) * ln(1 + km)', vel_1h_x_dist='card_id_1h_count * ln(1 + km)', log_city_pop='ln(1 + city_pop)', amt_per_city_pop='value / greatest(city_pop, 1)')}
FROM x"""


@query("plan_card_geo", _GEO)
def _plan2(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    df = split_events(s, d).select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("card_id"), F.col("value").alias("amount"), "t_us", "label", "split", ((k % 50) - 20.0).alias("lat"), ((F.col("user_id") % 60) - 10.0).alias("long"), ((k % 40) - 15.0).alias("merch_lat"), ((F.col("event_id") % 70) - 20.0).alias("merch_long"),
        ((k % 5).cast("long") * 1000).alias("city_pop"), F.concat(F.lit("c"), (k % 7).cast("string")).alias("category"), F.concat(F.lit("m"), k.cast("string")).alias("merchant"), F.when(k % 11 > 0, F.concat(F.lit("g"), (k % 2).cast("string"))).alias("gender"),
    )
    return finished(run_plan(card_geo, df, "row_id", "label", {"categoricals": ("category", "gender")})[0])


# the events as transactions with a sparse identity table
_IDS = "CASE WHEN user_id % 9 > 0 THEN 'e' || user_id % 20 || '.org' END AS email, event_type AS product, CASE WHEN event_id % 5 > 0 THEN 'd' || user_id % 7 END AS device, CAST(user_id % 30 AS BIGINT) AS address, 'n' || k % 3 AS network, CASE WHEN k % 4 = 0 THEN 'x' || k % 8 END AS id_a, CASE WHEN k % 6 = 0 THEN CAST(k AS DOUBLE) END AS id_b"
_PHASE = {f"txn_{n}_{f}": f"{f}(({e}) * 2 * pi() / {p})" for n, e, p in (("hour", "(t_us / 3600000000.0) % 24", 24), ("dow", "(t_us / 86400000000.0) % 7", 7)) for f in ("sin", "cos")}
_FILLED_PHASE = {n: f"coalesce({e}, -1)" for n, e in _PHASE.items()}
_NUMBERS = ("value", "card", "address", "id_b")
_SQUARE = {c: f"pow((coalesce(u.{c}, 0) - {c}_m) / greatest({c}_s, 0.001), 2)" for c in _NUMBERS}
_ROUND = ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS {n}" for n, c in (("amt_is_round_10", "round(value % 10, 6) < 0.01"), ("amt_is_round_100", "round(value % 100, 6) < 0.01"), ("amt_has_cents", "round((value * 100) % 100, 4) > 0.5"), ("amt_below_100", "value >= 95 AND value < 100"), ("amt_below_1000", "value >= 990 AND value < 1000")))
_PRESENT = "CASE WHEN id_a IS NOT NULL OR id_b IS NOT NULL THEN 1 ELSE 0 END AS id_cluster_present"

# NaN is null, as `normalise` has it
_CLEAN = "* REPLACE (CASE WHEN NOT isnan(value) THEN value END AS value)"
# `uid` takes a null as the text nan; `numeric_only` fills nulls of numbers that go out
_FILLED = "coalesce(u.card, -1) AS card, coalesce(u.address, -1) AS address, coalesce(t_us, -1) AS t_us"

_IDENTITY = f"""WITH {SPLIT}, p AS (SELECT {_CLEAN}, CAST(k AS BIGINT) AS card, {_IDS} FROM s), u AS (SELECT *, coalesce(CAST(card AS VARCHAR), 'nan') || '_' || coalesce(CAST(address AS VARCHAR), 'nan') AS uid FROM p), tr AS (SELECT * FROM u WHERE split = 'train'), w AS (SELECT avg(label) AS g FROM tr),
te AS (SELECT coalesce(device, '~') AS key, (sum(label) + 20 * any_value(g)) / (count(*) + 20) AS te FROM tr, w GROUP BY 1),
us AS (SELECT uid, avg(value) AS um, coalesce(stddev_samp(value), 0) AS us, min(value) AS ulo, max(value) AS uhi, count(value) AS un, count(DISTINCT email) AS ue, count(DISTINCT product) AS up FROM tr GROUP BY 1),
g0 AS (SELECT card, t_us, (t_us - lag(t_us) OVER (PARTITION BY card ORDER BY t_us, event_id)) / 1e6 AS gap FROM tr),
gp AS (SELECT card, coalesce(median(gap), 0) AS g1, coalesce(stddev_samp(gap), 0) AS g2, coalesce(min(gap), 0) AS g3, count(*) FILTER (gap < 60) AS g4, count(gap) / greatest((max(t_us) - min(t_us)) / 86400e6, 1.0) AS g5 FROM g0 GROUP BY 1),
z AS (SELECT {', '.join(f"avg(coalesce({c}, 0)) AS {c}_m, coalesce(stddev_samp(coalesce({c}, 0)), 0) AS {c}_s" for c in _NUMBERS)} FROM tr)
SELECT event_id AS row_id, {_FILLED}, split, label, {_PRESENT}, coalesce(un, 1) AS uid_count, coalesce(ue, -1) AS uid_email_distinct, coalesce(up, -1) AS uid_prod_distinct, coalesce(g4, 0) AS v_burst, {_ROUND},
  {digits(amount='coalesce(value, -1)', id_b='coalesce(id_b, -1)', device_te='coalesce(te, w.g)', product_freq_enc='coalesce(fp, 0)', email_freq_enc='coalesce(fe, 0)', uid_amt_mean='coalesce(um, -1)', uid_amt_std='coalesce(us, -1)', uid_amt_min='coalesce(ulo, -1)', uid_amt_max='coalesce(uhi, -1)', v_median_gap='coalesce(g1, 0)', v_std_gap='coalesce(g2, 0)', v_min_gap='coalesce(g3, 0)', v_daily_rate='coalesce(g5, 0)', anomaly_mahalanobis='sqrt(' + ' + '.join(_SQUARE.values()) + ')', anomaly_max_zscore='greatest(' + ', '.join(_SQUARE.values()) + ')', log_amount='coalesce(ln(1 + value), -1)', amt_cents='coalesce(round((value * 100) % 100, 4), -1)', **_FILLED_PHASE)}
FROM u LEFT JOIN te ON te.key = coalesce(u.device, '~') LEFT JOIN us ON us.uid = u.uid LEFT JOIN gp ON gp.card = u.card LEFT JOIN {_FRQ('product', 'fp')} a ON a.product = u.product LEFT JOIN {_FRQ('email', 'fe')} b ON b.email = u.email, w, z"""

_IDENTITY_CONFIG = {"categoricals": ("product", "email"), "target_encoded": ("device",), "uid": ("card", "address"), "identity": ("id_a", "id_b"), "interactions": (("device", "network"),)}


def identities(s: SparkSession, d: str) -> DataFrame:
    user, k = F.col("user_id"), F.col("k")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return split_events(s, d).select(
        F.col("event_id").alias("row_id"), F.col("value").alias("amount"), "t_us", "label", "split", k.cast("long").alias("card"), F.when(user % 9 > 0, F.concat(text("e", user % 20), F.lit(".org"))).alias("email"), F.col("event_type").alias("product"),
        F.when(F.col("event_id") % 5 > 0, text("d", user % 7)).alias("device"), (user % 30).alias("address"), text("n", k % 3).alias("network"), F.when(k % 4 == 0, text("x", k % 8)).alias("id_a"), F.when(k % 6 == 0, k.cast("double")).alias("id_b"),
    )


@query("plan_identity", _IDENTITY)
def _plan3(s: SparkSession, d: str) -> DataFrame:
    return finished(run_plan(identity, identities(s, d), "row_id", "label", _IDENTITY_CONFIG)[0])


_BY = lambda key, name: f"(SELECT {key}, avg(value) AS {name}m, coalesce(stddev_samp(value), 0) AS {name}_sd, count(value) AS {name}n FROM tr WHERE {key} IS NOT NULL GROUP BY 1)"

_MODAL = f"""WITH {SPLIT}, u AS (SELECT {_CLEAN}, CAST(k AS BIGINT) AS card, {_IDS} FROM s), tr AS (SELECT * FROM u WHERE split = 'train'),
cd AS (SELECT card, count(DISTINCT email) AS ne, count(DISTINCT device) AS nd, count(DISTINCT address) AS na FROM tr GROUP BY 1),
md AS (SELECT card, device AS usual FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY n DESC, device) AS rn FROM (SELECT card, device, count(*) AS n FROM tr WHERE device IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
pr AS (SELECT DISTINCT card, email FROM tr WHERE email IS NOT NULL), ia AS (SELECT coalesce(device, '~') AS a, coalesce(network, '~') AS b, count(*) / (SELECT count(*) FROM tr) AS f FROM tr GROUP BY ALL)
SELECT event_id AS row_id, {_FILLED}, split, label, {_PRESENT}, coalesce(ne, 0) AS card_n_email, coalesce(nd, 0) AS card_n_device, coalesce(na, 0) AS card_n_addr, coalesce(cn, 0) AS card_amt_count, coalesce(an, 0) AS addr_amt_count,
  CASE WHEN pr.card IS NULL THEN 1 ELSE 0 END AS card_email_is_new, CASE WHEN u.device = usual THEN 1 ELSE 0 END AS is_modal_device, CASE WHEN round(value % 1, 6) = 0 THEN 1 ELSE 0 END AS amt_is_round,
  {digits(amount='coalesce(value, -1)', id_b='coalesce(id_b, -1)', card_amt_mean='coalesce(cm, -1)', card_amt_std='coalesce(c_sd, -1)', net_amt_mean='coalesce(nm, -1)', net_amt_std='coalesce(n_sd, -1)', addr_amt_mean='coalesce(am, -1)', addr_amt_std='coalesce(a_sd, -1)', email_amt_mean='coalesce(em, -1)', card_amt_zscore='coalesce((value - cm) / greatest(c_sd, 0.01), -1)', card_amt_ratio='coalesce(value / greatest(cm, 0.01), -1)', net_amt_zscore='coalesce((value - nm) / greatest(n_sd, 0.01), -1)', addr_amt_zscore='coalesce((value - am) / greatest(a_sd, 0.01), -1)', email_amt_ratio='coalesce(value / greatest(em, 0.01), -1)', amt_log='coalesce(ln(1 + value), -1)', amt_cents='coalesce(round(value % 1, 6), -1)', device_network_freq='coalesce(ia.f, 0)', product_freq_enc='coalesce(fp, 0)', email_freq_enc='coalesce(fe, 0)', **_FILLED_PHASE).replace('greatest(cm, 0.01), -1', 'CASE WHEN cm IS NOT NULL THEN greatest(cm, 0.01) END, -1').replace('greatest(em, 0.01), -1', 'CASE WHEN em IS NOT NULL THEN greatest(em, 0.01) END, -1')}
FROM u LEFT JOIN cd ON cd.card = u.card LEFT JOIN md ON md.card = u.card LEFT JOIN pr ON pr.card = u.card AND pr.email = u.email LEFT JOIN {_BY('card', 'c')} c ON c.card = u.card LEFT JOIN {_BY('network', 'n')} n ON n.network = u.network
  LEFT JOIN {_BY('address', 'a')} a ON a.address = u.address LEFT JOIN {_BY('email', 'e')} e ON e.email = u.email LEFT JOIN ia ON ia.a = coalesce(u.device, '~') AND ia.b = coalesce(u.network, '~')
  LEFT JOIN {_FRQ('product', 'fp')} f1 ON f1.product = u.product LEFT JOIN {_FRQ('email', 'fe')} f2 ON f2.email = u.email"""


class Modal:
    """The second identity plan behind the same contract."""

    fit, transform = staticmethod(identity.fit_modal), staticmethod(identity.transform_modal)


@query("plan_identity_modal", _MODAL)
def _plan3m(s: SparkSession, d: str) -> DataFrame:
    return finished(run_plan(Modal, identities(s, d), "row_id", "label", _IDENTITY_CONFIG)[0])
