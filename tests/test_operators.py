"""Small tables with known results."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import rules
from tidewatch.functions.rules import ThresholdRule, apply_threshold
from tidewatch.operators import detectors, graph, scoring, supervised, survival, windows
from tidewatch.operators.ordering import quantiles, running
from tidewatch.sources import io
from tidewatch.streaming import maintenance


def column(df, name, by):
    return [r[name] for r in df.orderBy(by).collect()]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 6, "flag int, label int")
    r = scoring.detection_metrics(df).first()
    assert r.precision == pytest.approx(3 / 4) and r.recall == pytest.approx(3 / 5) and r.f1 == pytest.approx(2 / 3)
    none = spark.createDataFrame([(0, 0)], "flag int, label int")
    assert (scoring.detection_metrics(none).first().precision, scoring.detection_metrics(none).first().f1) == (0, 0)
    six = spark.createDataFrame(list(zip([1, 1, 1, 0, 1, 0], [1, 0, 1, 0, 0, 1], strict=True)), "flag int, label int")
    r = scoring.detection_metrics(six).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 2, 1, 1)


def test_thresholds(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(10, float("nan")), (11, None)], "pos int, score double")
    assert column(apply_threshold(df, ThresholdRule("quantile", quantile=0.9)), "flag", "pos") == [0] * 9 + [1, 0, 0]
    assert column(apply_threshold(df, ThresholdRule("absolute", 7.0)), "flag", "pos") == [0] * 7 + [1] * 3 + [0, 0]
    for bad in ({"method": "x"}, {"method": "quantile"}, {"method": "quantile", "quantile": 1.5}, {"method": "absolute"}):
        with pytest.raises(ValueError):
            ThresholdRule(**bad)


@pytest.mark.parametrize("values", [[1.0, 2, 3, 4, 5], [5.0] * 5, [], [42.0], [1.0, 1, 1, 2, 2, 2]])
def test_robust_z(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "pos int, value double")
    got = column(scoring.robust_z(df, "value"), "score", "pos")
    mad = np.median(np.abs(np.array(values) - np.median(values))) if values else 0
    assert got == pytest.approx([abs(v - np.median(values)) / (mad + 1e-8) for v in values])


def test_runs_and_leads(spark):
    runs = lambda x: windows.run_lengths(spark.createDataFrame(list(enumerate(x)), "pos int, flag int"), "flag", [], ["pos"]).first()[0]
    assert runs([0, 0, 1, 1, 1, 0, 1, 0, 0]) == 2.0 and runs([0, 0]) == 0.0
    rows = [(i, int(i in (2, 17, 31)), int(i in (9, 18, 40))) for i in range(45)]
    r = windows.lead_times(spark.createDataFrame(rows, "ts int, pred int, truth int"), "pred", "truth", "ts", []).first()
    assert (r.mean_lead, r.median_lead, r.min_lead, r.max_lead, r.early, r.late) == (pytest.approx(17 / 3), 7, 1, 9, 3, 0)


def test_life_and_policy(spark):
    df = spark.createDataFrame([(a, c) for a in "AB" for c in (1, 2, 3)], "asset string, cycle int")
    assert [r.RUL for r in windows.remaining_life(df, "asset", "cycle").orderBy("asset", "cycle").collect()] == [2, 1, 0, 2, 1, 0]
    ruls = spark.createDataFrame([(50,), (25,), (10,), (0,), (-1,)], "RUL int").withColumns(rules.rul_labels(F.col("RUL")))
    assert [r.health_label for r in ruls.orderBy(F.desc("RUL")).collect()] == ["healthy", "warning", "critical", "failed", "unknown"]
    states = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 1, 1), (4, 0, 0)], "i int, health_state int, before int")
    assert column(rules.apply_policy(states, previous="before"), "action", "i") == [2, 1, 0, 0]
    assert column(rules.apply_policy(states), "action", "i") == [2, 0, 0, 0]
    assert column(rules.apply_policy(states, previous="before"), "risk", "i") == pytest.approx([0.15, 0.075, 0.1, 0.01])
    with pytest.raises(ValueError):
        rules.health_from_distance(F.lit(1.0), 3, 2)
    with pytest.raises(ValueError):
        rules.fused_risk(F.lit(1.0), F.lit(1.0), 0.5, 0.6)


def test_alerts(spark):
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate((75.0, 85.0, 95.0, 105.0))], "t int, asset string, temperature double")
    found = maintenance.alerts(df, "asset", "t", {"temperature": {"warning": 80, "critical": 90, "failure": 100}})
    assert column(found, "level", "t") == ["warning", "critical", "failure"]
    assert found.orderBy("t").first().message == "temperature = 85.00 exceeds warning threshold (80.00)"
    assert column(maintenance.escalated(found, "asset", "t"), "escalated_level", "t") == ["warning", "critical", "failure"]


def test_rates_from_zero(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate((0.0, 0.0, 2.0, None, 4.0, -1.0))], "i int, x double")
    got = column(windows.degradation_rates(df, ["x"], [], ["i"], (1,)), "x_rate_1", "i")
    assert got[:2] == [None, None] and got[2] == math.inf and got[3:] == [0.0, 1.0, -1.25]


def test_graph(spark):
    edges = graph.undirected_edges(spark.createDataFrame([(1, 2), (2, 1), (1, 2), (1, 2), (1, 1), (3, None)], "sender_id long, receiver_id long"))
    assert [tuple(r) for r in edges.collect()] == [(1, 2, 4)]
    with pytest.raises(ValueError):
        graph.undirected_edges(edges)
    star = graph.undirected_edges(spark.createDataFrame([p for i in (10, 20, 40, 50) for p in ((i, 30), (30, i))], "sender_id long, receiver_id long"))
    nodes = spark.createDataFrame([(i,) for i in (10, 20, 30, 40, 50, 60)], "node long")
    rows = {r.node: r for r in graph.node_features(star, nodes).collect()}
    assert max(rows.values(), key=lambda r: r.weighted_degree).node == 30 and rows[10].neighbor_count == 1 and rows[60].weighted_degree == 0
    assert sum(r.pagerank for r in rows.values()) == pytest.approx(1)
    central = {r.node: r for r in graph.centralities(star, nodes).collect()}
    assert max(central.values(), key=lambda r: r.betweenness).node == 30
    assert central[30].betweenness == pytest.approx(6 / 10) and central[60].closeness == 0
    ring = spark.createDataFrame([(i, (i + 1) % 6, 1) for i in range(6)], "u long, v long, weight long")
    assert [r.pagerank for r in graph.pagerank(ring, spark.range(6).withColumnRenamed("id", "node")).collect()] == pytest.approx([1 / 6] * 6)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=80))
def test_edges_do_not_depend_on_direction(spark, rows):
    made = lambda x: sorted(map(tuple, graph.undirected_edges(spark.createDataFrame(x, "sender_id long, receiver_id long")).collect()))
    edges = made(rows)
    assert edges == made([(b, a) for a, b in reversed(rows)])
    assert sum(w for _, _, w in edges) == sum(a != b for a, b in rows) and all(u < v for u, v, _ in edges)


def test_touches(spark):
    day = lambda n: dt.datetime(2024, 6, n)
    comms = spark.createDataFrame([(1, 2, day(1)), (1, 2, day(1)), (1, 2, day(2)), (2, 3, day(2))], "sender_id long, receiver_id long, timestamp timestamp")
    touches = graph.touch_counts(comms, spark.createDataFrame([(1,), (2,), (3,)], "node long"))
    assert touches.count() == 6 and touches.where("node = 1").agg(F.sum("touches")).first()[0] == 3
    assert len(graph.touch_matrix(touches).columns) == 3


def test_survival(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 1), (4.0, 0)], "duration double, event int")
    curve = survival.kaplan_meier(df)
    assert column(curve, "survival", "t") == pytest.approx([0.8, 0.6, 0.3, 0.3])
    assert survival.quantile_time(curve, 0.65).first().time == 2 and survival.quantile_time(curve, 0.5, strict=True).first().time == 3
    assert survival.quantile_time(curve, 0.1, last=False).first().time == math.inf
    rng = np.random.default_rng(0)
    x = rng.standard_normal(1500)
    t = rng.exponential(np.exp(-0.8 * x))
    rows = pd.DataFrame({"id": range(1500), "x": x, "duration": np.minimum(t, 3.0), "event": (t < 3).astype(int)})
    df = spark.createDataFrame(rows)
    cox = survival.CoxModel(["x"], penalty=0.0).fit(df)
    assert cox.fitted["beta"][0] / cox.fitted["std"][0] == pytest.approx(0.8, abs=0.08)
    r = survival.concordance(cox.risk(df)).first()
    assert 0.65 < r.concordance_index < 0.85
    plain = survival.ParametricSurvival("exponential").fit(df)
    want = rows.duration.sum() / rows.event.sum()
    assert math.exp(plain.theta[0]) == pytest.approx(want, rel=0.01)
    for kind in ("weibull", "lognormal", "loglogistic", "generalized_gamma", "spline"):
        s = survival.ParametricSurvival(kind, (0.05, 0.3, 0.9, 2.5)).fit(df).survival_at(np.array([0.1, 0.5, 1.0, 2.0]))
        truth = survival.kaplan_meier(df)
        for q, v in zip((0.1, 0.5, 1.0, 2.0), s, strict=True):
            near = truth.where(F.col("t") <= q).agg(F.min("survival")).first()[0]
            assert abs(near - v) < 0.08, kind
    few = df.limit(300)
    assert survival.compare_models(["cox", "logistic_hazard", "nothing"], few, few, "id", ["x"]).count() == 3


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3))
    x[:8] += 9
    return spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(i=range(300), label=(np.arange(300) < 8).astype(int)))


@pytest.mark.parametrize("made", [
    lambda f: detectors.IsolationForest(f, n_estimators=40), lambda f: detectors.LocalOutlierFactor(f), lambda f: detectors.RobustCovariance(f),
    lambda f: detectors.PCADetector(f, 2, "mahalanobis"), lambda f: detectors.Ensemble([scoring.ZScore(f), scoring.InterquartileRange(f)], "vote"),
])
def test_detectors_find_outliers(points, made):
    detector = made(("a", "b", "c"))
    with pytest.raises(ValueError):
        detector.transform(points)
    out = detector.fit(points).transform(points)
    assert scoring.detection_metrics(out).first().recall >= 0.9
    assert out.agg(F.sum("flag")).first()[0] <= 30


def test_models(points):
    risk = supervised.FailureRisk(["a", "b", "c"], n_estimators=10).fit(points).transform(points)
    assert risk.where("label = failure_prediction").count() >= 295
    states = points.withColumn("health_state", F.when(F.col("a") > 1, 2).when(F.col("a") > 0, 1).otherwise(0))
    models = [supervised.OrdinalClassifier(["a"]).fit(states), supervised.BoostedOrdinal(["a"], iterations=5).fit(states)]
    for out in (models[0].transform(states), models[1].transform(states), supervised.averaged(states, models), supervised.StackedOrdinal(models).fit(states).transform(states)):
        assert out.where("prediction = health_state").count() >= 240
    with pytest.raises(ValueError):
        supervised.OrdinalClassifier(["a"]).fit(points.withColumn("health_state", F.lit(3)))
    top = supervised.assess_assets(points, "i", ["a", "b", "c"], "label").limit(8).collect()
    assert {r.i for r in top} == set(range(8))


def test_models_are_stored(points, tmp_path):
    model = scoring.ZScore(("a", "b")).fit(points)
    io.save_model(model, str(tmp_path / "m"), {"note": "x"})
    again = io.load_model(str(tmp_path / "m"))
    assert again.transform(points).agg(F.sum("score")).first() == model.transform(points).agg(F.sum("score")).first()
    assert io.model_metadata(str(tmp_path / "m"))["note"] == "x"
    with pytest.raises(FileNotFoundError):
        io.load_model(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        io.save_model(scoring.ZScore(), str(tmp_path / "n"))
    compile(open(tmp_path / "m" / "metadata.json").read() and (io.export_bundle(model, str(tmp_path / "b"), "s3://x/y") and open(tmp_path / "b" / "inference.py").read()), "inference", "exec")


def test_files(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("v\n" + "\n".join(map(str, range(k, 20 + k))))
    out = io.score_files(spark, [str(tmp_path / "0.csv"), str(tmp_path / "1.csv"), str(tmp_path / "no.csv")], lambda df, by: scoring.robust_z(df, "value", by))
    assert out.count() == 40 and out.select("file").distinct().count() == 2
    with pytest.raises(ValueError):
        io.score_files(spark, [], lambda df, by: df)


def test_series_and_checks(spark):
    s = io.series(spark, [1.0, 2.0, 3.0])
    scoring.assert_monotonic(s, "ts", [], ["ts"])
    with pytest.raises(ValueError):
        scoring.assert_aligned(s, s.limit(2), ["ts"])
    wide = spark.createDataFrame([(1, 2.0)], "k int, t1 double")
    assert [tuple(r) for r in io.panel(wide, "k", ["t1", "t2"]).orderBy("ts").collect()] == [(1, "t1", 2.0), (1, "t2", None)]
    assert windows.expanding_folds(60) == [(10 + 10 * i, 10 + 10 * i) for i in range(5)]
    with pytest.raises(ValueError):
        windows.expanding_folds(12)
    with pytest.raises(ValueError):
        windows.Frame(0)


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(a, start + dt.timedelta(minutes=i), float(i)) for i in range(10) for a in ("x", "y")]
    schema = "asset string, ts timestamp, value double"
    table = spark.createDataFrame(rows, schema)
    table.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = maintenance.buffered_features(stream, "asset", "ts", "value", 5).writeStream.format("memory").queryName("buffered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.asset, r["at"], r.status, r.rows, r["mean"], r["change"]) for r in df.collect())
    got, want = key(spark.table("buffered")), key(maintenance.buffered_features_batch(table, "asset", "ts", "value", 5))
    assert [g[:4] for g in got] == [w[:4] for w in want] and sum(g[2] == "ready" for g in got) == 12
    assert [g[4:] for g in got if g[2] == "ready"] == [pytest.approx(w[4:]) for w in want if w[2] == "ready"]
    found = maintenance.alerts(stream, "asset", "ts", {"value": {"warning": 5}})
    q = maintenance.escalated_stream(found, "asset", "ts").writeStream.format("memory").queryName("escalated").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.asset, r["count"], r.escalated_level) for r in spark.table("escalated").collect()} == {(a, n, "critical" if n >= 3 else "warning") for a in "xy" for n in range(1, 6)}


def test_local_outlier_factor_learns_from_all_rows(spark):
    """A dense group of 21 rows among 6,000 is no outlier, and radii are those of an exact search over all rows."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 2))
    x[:21] = 30 + rng.random((21, 2)) / 100
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    model = detectors.LocalOutlierFactor(("a", "b")).fit(df)
    rows = np.array(model.fitted["x"])
    assert len(rows) == 6000
    for i in range(0, 6000, 500):
        want = np.sort(np.sqrt(((rows - rows[i]) ** 2).sum(axis=1)))[20]
        assert model.fitted["radius"][i] == pytest.approx(want, rel=1e-5)
    assert model.transform(df).where("a > 20").agg(F.sum("flag")).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_running_sums_and_quantiles(spark, n):
    """Over the order of the whole table, with ties, missing values and more ranges than values."""
    rng = np.random.default_rng(n)
    rows = [(int(k), float(x)) for k, x in zip(rng.integers(0, 40, n), rng.integers(0, 9, n), strict=True)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = sorted((r.k, r.upto) for r in running(df.groupBy("k").agg(F.sum("x").alias("x")), [F.col("k")], {"upto": F.col("x")}).collect())
    want, total = [], 0.0
    for k in sorted({k for k, _ in rows}):
        total += sum(x for j, x in rows if j == k)
        want.append((k, total))
    assert got == want
    holes = df.unionByName(spark.createDataFrame([(1, None), (2, float("nan"))], "k int, x double"))
    found = quantiles(holes, {"x": (rules.no_nan("x"), [0.0, 0.25, 0.5, 0.9, 1.0]), "none": (F.lit(None), [0.5])})
    assert found["none"] == [None]
    assert found["x"] == ([None] * 5 if not n else pytest.approx(np.quantile([x for _, x in rows], [0, 0.25, 0.5, 0.9, 1.0])))


def test_concordance_counts_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(float(t), float(r), int(e)) for t, r, e in zip(rng.integers(0, 25, 200), rng.integers(0, 30, 200), rng.integers(0, 2, 200), strict=True)]
    won = pairs = 0
    for t, r, e in rows:
        for u, q, _ in rows:
            if e and t < u:
                pairs += 1
                won += 1.0 if r > q else 0.5 if r == q else 0.0
    got = survival.concordance(spark.createDataFrame(rows, "duration double, risk_score double, event int")).first()
    assert (got.concordance_index, got.pairs) == (pytest.approx(won / pairs), pairs)
    none = survival.concordance(spark.createDataFrame([], "duration double, risk_score double, event int")).first()
    assert (none.concordance_index, none.pairs) == (0.5, 0)


@pytest.mark.parametrize("name", ["haar", "db2", "db4", "bior2.2"])
@pytest.mark.parametrize("n", [8, 37, 500, 6000])
def test_wavelets_give_the_series_back(name, n):
    x = np.random.default_rng(n).standard_normal(n)
    rest, details = detectors.wavelet_levels(x, 4, name)
    assert details and np.allclose(detectors.wavelet_inverse(rest, details, name)[:n], x)
    with pytest.raises(ValueError):
        detectors.wavelet_filters("none")


def test_long_series_are_denoised(spark):
    rng = np.random.default_rng(2)
    clean = np.sin(np.arange(5000) / 60)
    df = spark.createDataFrame(pd.DataFrame({"i": range(5000), "x": clean + 0.3 * rng.standard_normal(5000), "k": 1}))
    got = np.array(column(detectors.wavelet_denoise(df, "x", ["k"], ["i"]), "denoised", "i"))
    assert np.abs(got - clean).mean() < 0.1


def test_arima_is_fitted_apart(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.standard_normal(200))
    y = x.copy()
    y[150:] += 40
    frame = lambda v: spark.createDataFrame(pd.DataFrame({"i": range(200), "x": v, "k": "a"}))
    models = detectors.arima_fit(frame(x), "x", ["k"], ["i"])
    flags = column(detectors.arima_drift(frame(y), "x", ["k"], ["i"], fitted=models), "flag", "i")
    assert flags[150] == 1 and sum(flags) < 25
    other = frame(y).withColumn("k", F.lit("b"))
    assert sum(column(detectors.arima_drift(other, "x", ["k"], ["i"], fitted=models), "flag", "i")) == 0
    plain = detectors.arima_fit(frame(x), "x", ["k"], ["i"], exact=False)
    assert column(detectors.arima_drift(frame(y), "x", ["k"], ["i"], fitted=plain, exact=False), "flag", "i")[150] == 1


def test_a_detector_keeps_its_flag(points):
    model = detectors.IsolationForest(("a", "b", "c"), n_estimators=20).fit(points)
    own = column(model.transform(points), "flag", "i")
    assert column(scoring.detect_anomalies(points, model, ThresholdRule("absolute", -9.0)), "flag", "i") == own
    assert column(next(io.batch_predict([points], model)), "flag", "i") == own
    scorer = scoring.ZScore(("a",)).fit(points)
    assert sum(column(scoring.detect_anomalies(points, scorer, ThresholdRule("absolute", -9.0)), "flag", "i")) == 300
    with pytest.raises(ValueError):
        scoring.detect_anomalies(points, scorer)
    assert model.tags()["detector"] and not scorer.tags()["detector"]
    row = scoring.evaluate_detector(points, model, at="i").first()
    assert row.recall > 0.9 and row.roc_auc > 0.95 and row.early >= 0
    both = scoring.compare_detectors(points, {"forest": model, "z": scorer}, ThresholdRule("quantile", quantile=0.97))
    assert {r.metric for r in scoring.comparison_metrics(both).collect()} == {"precision", "recall", "f1"}
    for bad in (lambda: scoring.compare_detectors(points, {}), lambda: scoring.comparison_metrics(both, ("x",))):
        with pytest.raises(ValueError):
            bad()


def test_all_models_are_stored(points, tmp_path):
    states = points.withColumn("health_state", F.when(F.col("a") > 1, 2).when(F.col("a") > 0, 1).otherwise(0))
    made = {
        "forest": detectors.IsolationForest(("a", "b"), n_estimators=5), "pair": detectors.Ensemble([scoring.ZScore(("a",)), detectors.PCADetector(("a", "b"))], "mean"),
        "risk": supervised.FailureRisk(["a", "b"], n_estimators=5), "ordinal": supervised.OrdinalClassifier(["a"]), "cox": survival.CoxModel(["a"]),
    }
    for name, model in made.items():
        rows = states.withColumn("duration", F.col("i") + 1.0).withColumn("event", F.lit(1))
        model.fit(rows)
        io.save_model(model, str(tmp_path / name))
        again = io.load_model(str(tmp_path / name))
        out = lambda m: sorted(map(str, (m.risk(rows) if name == "cox" else m.transform(rows)).limit(20).collect()))  # noqa: B023, E731
        assert type(again) is type(model) and out(again) == out(model), name


def test_handler(points, tmp_path):
    import runpy

    io.export_bundle(scoring.ZScore(("a", "b")).fit(points), str(tmp_path / "b"), "s3://x/y")
    made = runpy.run_path(str(tmp_path / "b" / "inference.py"))
    model = made["model_fn"](str(tmp_path / "b"))
    scores = made["predict_fn"](made["input_fn"]("1,2\n3,4\n", "text/csv"), model)
    assert made["output_fn"](scores, "text/csv") == f"{scores[0]}\n{scores[1]}"


def test_views_and_tables(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.1, 0)], "k int, score double, label int")
    assert scoring.score_view(df, ["k"]).columns == ["k", "score"] and scoring.label_view(df, ["k"]).columns == ["k", "label"]
    for bad in (lambda: scoring.score_view(df.unionByName(df), ["k"]), lambda: scoring.label_view(df.withColumn("label", F.lit(2)), ["k"]), lambda: scoring.score_view(df, ["no"])):
        with pytest.raises(ValueError):
            bad()
    for data in (pd.Series([1.0, 2.0]), pd.DataFrame({"value": [1.0, 2.0]}), [1.0, 2.0], np.array([[1.0], [2.0]])):
        table, names = io.table_of(spark, data)
        assert names == ("value",) and [r.value for r in table.collect()] == [1.0, 2.0]
    before, after = scoring.DetectTask(order=("k",), cutoff=2).split(df)
    assert [r.k for r in before.collect()] == [1] and [r.k for r in after.collect()] == [2]


def test_network_anomalies(spark):
    day = lambda n: dt.datetime(2024, 6, 1 + n % 20)
    rows = [p for i in range(1, 20) for k in range(3) for p in ((0, i, day(i + k)), (i, 0, day(i)))] + [(a, b, day(a)) for a in range(1, 6) for b in range(1, 6) if a != b]
    comms = spark.createDataFrame(rows, "sender_id long, receiver_id long, timestamp timestamp")
    nodes = spark.range(20).withColumnRenamed("id", "node")
    edges = graph.undirected_edges(comms)
    assert graph.node_anomalies(edges, nodes).orderBy(F.desc("score")).first().node == 0
    assert graph.temporal_anomalies(comms, nodes).orderBy(F.desc("score")).first().node == 0
    assert graph.edge_anomalies(edges).agg(F.sum("flag")).first()[0] >= 1
    for bad in (lambda: graph.node_anomalies(edges, nodes.limit(1)), lambda: graph.edge_features(edges.where("false")), lambda: graph.edge_anomalies(edges.limit(1)), lambda: graph.temporal_anomalies(comms.where("false"), nodes)):
        with pytest.raises(ValueError):
            bad()
