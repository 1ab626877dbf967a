"""Sources, sinks, models, plans, logs, reports and streams."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars
from ledgerlens.operators import anomaly, experiments, model, pipeline, report
from ledgerlens.plans import card_geo, identity
from ledgerlens.schema import DAY, HOUR, EventSchema, normalise
from ledgerlens.sources import cache, readers, sinks
from ledgerlens.streaming import velocity as stream


def test_split_round_trip_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", 0.5), (2, "val", float("nan")), (3, "oot", float("inf"))], "id int, split string, x double")
    sinks.write_splits(df, str(tmp_path), "t")
    assert {tuple(r) for r in readers.read_splits(spark, str(tmp_path), "t").select("id", "split").collect()} == {(1, "train"), (2, "val"), (3, "oot")}
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(str(r["x"]) for r in spark.read.schema("x double").json(str(tmp_path / "j")).collect()) == ["0.5", "None", "None"]
    assert [sinks.append_record(spark, str(tmp_path / "log"), {"a": float("nan"), "b": [1.23456789 + i]}) for i in range(2)] == [1, 2]
    assert json.loads((tmp_path / "log/records/000001.json").read_text()) == {"a": None, "b": [1.234568]}
    assert readers.read_log(spark, str(tmp_path / "log/records"), "a double, b array<double>").count() == 2
    sinks.append_tsv(spark, str(tmp_path / "r"), ["a", "b"], {"a": 1})
    sinks.append_tsv(spark, str(tmp_path / "r"), ["a", "b"], {"a": 2, "b": "x"})
    assert sorted(tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "r/records"), "a int, b string").collect()) == [(1, None), (2, "x")]


def test_writers_of_one_log_at_once(spark, tmp_path):
    """Eight writers, five records each, and one that dies after its claim: no record is lost, no number given twice."""
    from concurrent.futures import ThreadPoolExecutor

    from ledgerlens.sources.shared_log import SharedLog

    root = str(tmp_path / "log")
    write = lambda who: [SharedLog(spark, root).append(lambda n, i=i: json.dumps({"n": n, "who": who, "i": i})) for i in range(5)]
    dead = SharedLog(spark, root).claim()
    with ThreadPoolExecutor(8) as pool:
        numbers = [n for got in pool.map(write, range(8)) for n in got]
    assert len(set(numbers)) == 40 and dead not in numbers
    rows = [json.loads(t) for t in SharedLog(spark, root).texts()]
    assert [r["n"] for r in rows] == sorted(numbers) and {(r["who"], r["i"]) for r in rows} == {(w, i) for w in range(8) for i in range(5)}


def test_names_and_addresses_by_hand(spark):
    from ledgerlens.functions import signals, text
    from ledgerlens.operators import snapshots

    rows = spark.createDataFrame([("Ann-Lee Ray", "ray.ann"), ("", "x"), (None, "x"), ("Bo", "")], "name string, local string")
    got = rows.select(text.name_coherence(F.col("name"), F.col("local")).alias("c"), text.name_in_email(F.col("name"), F.col("local")).alias("n")).collect()
    # ray to ray.ann: four letters more, of seven; no parts: 999; the empty local part is two letters from bo
    assert [(r["c"], r["n"]) for r in got] == [(4 / 7, 1), (999.0, 0), (None, 0), (2.0, 0)]
    names = [" a/b: C d ", "x" * 39 + " y", "é-1_", "//", "a  b"]
    made = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(text.sanitized(F.col("s"))).collect()]
    assert made == ["ab_c_d", "x" * 39, "é-1", "", "a__b"] and [snapshots.folder_name(7, n) for n in names] == [f"exp_007_{n}" for n in made]
    risk = spark.range(1).select(*(c.alias(n) for n, c in signals.device_risk(F.lit(100), F.lit(True), F.lit(True), F.lit(False), F.lit(0), F.lit(301)).items())).first()
    assert (risk["emulator_score"], risk["battery_round"], risk["device_risk"]) == (1, 1, pytest.approx(0.8))


def test_cache_and_template(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(10)
    key = cache.cache_key("SELECT 1", "all", "train", "2020", "2021")
    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), key, make, 5, ["id"]).count() == 5
    assert len(calls) == 1 and cache.invalidate(spark, str(tmp_path), key)
    with pytest.raises(ValueError):
        readers.from_template(spark, "SELECT * FROM {t}", {"t": "a; DROP TABLE b"}, {})


def test_normalise(spark):
    df = spark.createDataFrame([(1, 2.0, float("nan"))], "id int, s double, v double")
    r = normalise(df, EventSchema("id", "s", "v")).first()
    assert r["t_us"] == 2_000_000 and r["v"] is None


def events(spark, n=200):
    return spark.createDataFrame([(i, i % 7, i % 5, float(i % 50), i * HOUR // 3, int(i % 9 == 0), ("train", "val", "oot")[min(2, i * 3 // n)]) for i in range(n)], "row_id long, card int, b int, amount double, t_us long, label int, split string")


def test_model_and_timeout(spark):
    df = events(spark).withColumn("x", F.col("label") + F.rand(1) * 0.5)
    scored, fitted = model.train_and_evaluate(df, {"trees": 3, "max_depth": 2}, ["x", "amount"])
    assert scored.where("score > 0.5 AND label = 1").count() > 0
    assert model.importances(spark, fitted, ["x", "amount"]).first()["feature"] == "x"
    assert pipeline.with_timeout(spark, 60, lambda: spark.range(3).count()) == 3


def test_label_never_reaches_transform(spark):
    seen = []

    class Plan:
        @staticmethod
        def fit(history, labels, config):
            return pipeline.FittedState({"t": history.select("card").distinct()}, {"n": 1})

        @staticmethod
        def transform(df, state, config):
            seen.extend(df.columns)
            return df

    out, _ = pipeline.run_plan(Plan, events(spark), "row_id", "label")
    assert "label" not in seen and "label" in out.columns and out.count() == 200


def test_state_round_trip(spark, tmp_path):
    state = pipeline.FittedState({"a": spark.range(3)}, {"g": 0.5})
    state.save(spark, str(tmp_path))
    back = pipeline.FittedState.load(spark, str(tmp_path))
    assert back.scalars == {"g": 0.5} and back.tables["a"].count() == 3


def test_geo_and_identity_plans(spark):
    df = events(spark).withColumns({"card_id": F.col("card").cast("long"), "merchant": F.concat(F.lit("m"), F.col("b")), "category": F.concat(F.lit("c"), F.col("b") % 2), "gender": F.lit("x"), "state": F.lit(None).cast("string"), "lat": F.lit(10.0), "long": F.lit(20.0), "merch_lat": F.col("b") + 10.0, "merch_long": F.lit(20.0), "city_pop": F.lit(1000)})
    out, _ = pipeline.run_plan(card_geo, df, "row_id", "label")
    assert out.count() == 200 and out.where("haversine_km IS NULL").count() == 0 and "card_id_1h_count" in out.columns
    ident = events(spark).withColumns({"email": F.when(F.col("b") > 0, F.concat(F.lit("e"), F.col("b"))), "product": F.lit("W"), "device": F.concat(F.lit("d"), F.col("b")), "address": F.col("b"), "network": F.lit("visa"), "id_01": F.when(F.col("b") == 1, 1.0)})
    config = {"uid": ("card", "address"), "identity": ("id_01",), "categoricals": ("email",), "target_encoded": ("email",), "interactions": (("product", "network"),)}
    out, _ = pipeline.run_plan(identity, ident, "row_id", "label", config)
    assert out.count() == 200 and {"uid_amt_mean", "v_burst", "anomaly_mahalanobis", "email_te"} <= set(out.columns)

    class Modal:
        fit, transform = staticmethod(identity.fit_modal), staticmethod(identity.transform_modal)

    out, _ = pipeline.run_plan(Modal, ident, "row_id", "label", config)
    assert out.where("address = 0").first()["card_email_is_new"] == 1 and out.count() == 200


def test_hmm_and_autoencoder(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = anomaly.GaussianHmm(2, 1).fit([np.concatenate([rng.normal(0, 0.1, (20, 1)), rng.normal(5, 0.1, (20, 1))]) for _ in range(5)])
    assert sorted(m.mean.ravel().round()) == [0, 5]
    ae = anomaly.Autoencoder(3).fit(rng.normal(0, 1, (300, 3)))
    assert ae.errors(np.full((1, 3), 50.0)).mean() > ae.errors(np.zeros((1, 3))).mean()


def test_hmm_of_long_entities(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = {1: 1100, 2: 513, 3: 1, 4: 40, None: 1030}
    rows = [(100_000 * (e or 9) + i, e, i * HOUR // 7, float(rng.gamma(1 + (i // 37) % 3 * 4))) for e, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, card long, t_us long, amount double")
    model = anomaly.GaussianHmm(3, 3)
    model.mean, model.var, model.start = np.array([[0.5, 0.5, 0.5], [1.5, 0.5, 0.5], [2.2, 0.5, 0.5]]), np.full((3, 3), 0.4), np.array([0.7, 0.2, 0.1])
    got = {r["row_id"]: [r["hmm_p0"], r["hmm_p1"], r["hmm_p2"]] for r in anomaly.hmm_features(df, model, "card", "t_us", "row_id", "amount", most=300, chunk=64, fan=3).collect()}
    assert len(got) == len(rows)
    for e, n in sizes.items():
        own = [r for r in rows if r[1] == e]
        x = np.array([[np.log1p(v), t // 3_600_000_000 % 24 / 24, (t // 86_400_000_000 + 3) % 7 / 7] for _, _, t, v in own])
        expected = model.posteriors(x)[0] if n > 1 else model.start[None]
        assert np.allclose([got[r[0]] for r in own], expected, atol=1e-9)


def test_log_decisions_and_report(spark, tmp_path):
    log = spark.createDataFrame([("d", i, f"exp_{i}", s, "Velocity campaign step 1/2", st, 10 + i, {"f": 1.0 * i}) for i, s, st in ((1, 0.5, "keep"), (2, 0.5005, "discard"), (3, 0.6, "keep"), (4, None, "crash"))], "dataset string, seq int, id string, score double, hypothesis string, status string, n_features int, top_features map<string,double>")
    got = {r["id"]: r["decided"] for r in experiments.decisions(log, "score", F.lit(False)).collect()}
    assert got == {"exp_1": "keep", "exp_2": "discard", "exp_3": "keep", "exp_4": "crash"}
    trend = experiments.importance_trend(log).first()
    assert trend["trend"] == "growing" and "target_encoding" in {r["technique"] for r in experiments.untried(log, spark).collect()}
    assert "velocity" in experiments.context_text(log, "score", spark)
    report.write_dashboard(str(tmp_path / "d.html"), "t", [("a", report.html_table(log.drop("top_features"))), ("b", report.svg_line([0.1, None, 0.3], [0.1, 0.1, 0.3], "x"))])
    assert "<svg" in (tmp_path / "d.html").read_text()
    assert "# Journal\nold notes" in experiments.context_text(log, "score", spark, journal="old notes")
    metrics = spark.createDataFrame([("keep", 1, {"composite_score": 0.4, "psi": 0.2}), ("discard", 2, {"composite_score": 0.3, "psi": 0.1}), ("keep", 3, {"composite_score": 0.5, "psi": 0.05})], "status string, seq int, metrics_summary map<string,double>")
    shown = report.panels(metrics)
    assert len(shown) == 5 and all(p.startswith("<svg") for _, p in shown)


def test_scalar_nulls(spark):
    r = spark.range(1).select(scalars.zscore(F.lit(1.0), F.lit(0.0), F.lit(None).cast("double")).alias("z"), scalars.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("km")).first()
    assert r["z"] is None and r["km"] == pytest.approx(20015.09, abs=0.1)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(i, 1 + i % 2, DAY + i * HOUR // 4, 1.0) for i in range(20)]
    spark.createDataFrame(rows, "row_id long, card int, t_us long, amount double").withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.parquet(str(src))
    events = spark.readStream.schema("row_id long, card int, t_us long, amount double, ts timestamp").parquet(str(src))
    for name, df, mode in (("w", stream.windowed_velocity(events, "card", "ts", "amount"), "complete"), ("s", stream.burst_sessions(events, "card", "ts", "amount", "40 minutes"), "complete"), ("p", stream.prior_velocity(events, "card", "row_id", "t_us", "amount", HOUR), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(f"q_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert spark.table("q_w").agg(F.sum("n")).first()[0] == 20
    prior = {r["row_id"]: r["n"] for r in spark.table("q_p").collect()}
    assert prior == {i: sum(1 for j in range(i) if j % 2 == i % 2 and i * HOUR // 4 - HOUR <= j * HOUR // 4) for i in range(20)}
    assert spark.table("q_s").count() == 2 and DAY == 24 * HOUR


def test_snapshots(spark, tmp_path):
    from ledgerlens.operators import snapshots

    code = tmp_path / "features.py"
    code.write_text("x = 1\n")
    root = str(tmp_path / "runs")
    a = snapshots.save(spark, root, "d", "First: try/it", "keep", {"auprc": float("nan")}, [str(code)], {"a": 1.0, "b": 2.0}, top=1)
    b = snapshots.save(spark, root, "d", "Second", "discard", {"auprc": 0.5})
    assert (a["id"], a["dir"], a["top_features"], a["metrics_summary"]) == ("exp_001", "exp_001_first_tryit", {"b": 2.0}, {"auprc": None})
    assert b["parent_exp"] == "exp_001" == snapshots.best_kept(spark, root) and len(snapshots.history(spark, root)) == 2
    snapshots.save(spark, root, "d", "Third", "keep", {"composite_score": 0.4})
    snapshots.save(spark, root, "d", "Fourth", "keep", {"composite_score": 0.5})
    assert json.loads((tmp_path / "runs" / "summary.json").read_text()) == {"d": {"total": 4, "kept": 3, "best": 0.5, "baseline": 0.4, "discarded": 1, "improvement_pct": 25.0}}
    (tmp_path / "out").mkdir()
    assert snapshots.restore(spark, root, "exp_001", str(tmp_path / "out")) == ["features.py"]
    assert readers.read_log(spark, f"{root}/index/records", experiments.LOG).where("status = 'keep'").first()["id"] == "exp_001"
