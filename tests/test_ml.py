import datetime as dt
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import day
from panelforge.functions.normal import with_inverse_normal
from panelforge.ml import fit as fitting
from panelforge.ml import boosting, isotonic, score
from panelforge.ml.transformers import MedianImputer, MedianImputerModel, QuantileNormalizer, Winsorizer, WinsorizerModel
from panelforge.operators import metrics, splits

FEW = {"n_estimators": 4, "max_depth": 3}


def winsor(spark, data, **options):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in data], "v double")
    model = Winsorizer(inputCols=["v"], outputCols=["w"], **options).fit(df)
    return [r["w"] for r in model.transform(df).collect()], model


def test_winsorizer(spark):
    got, _ = winsor(spark, [1.0, None, 3.0])
    assert got[1] is None
    rng = np.random.default_rng(0)
    data = rng.normal(size=200)
    data[:2] = [100.0, -100.0]
    got, model = winsor(spark, data)
    low, high = np.quantile(data, [0.01, 0.99])
    assert got == pytest.approx(np.clip(data, low, high).tolist())
    same, _ = winsor(spark, data, lower=0.0, upper=1.0)
    assert same == pytest.approx(data.tolist())


def test_stages_save_and_load(spark, tmp_path):
    _, model = winsor(spark, [1.0, 2.0, 3.0])
    model.write().overwrite().save(str(tmp_path / "w"))
    assert WinsorizerModel.load(str(tmp_path / "w")).getOrDefault("lows") == model.getOrDefault("lows")


def test_median_imputer(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None), (9.0, None)], "a double, b double")
    model = MedianImputer(inputCols=["a", "b"], outputCols=["x", "y"], indicators=True).fit(df)
    assert isinstance(model, MedianImputerModel)
    out = model.transform(df).collect()
    assert [r["x"] for r in out] == [1.0, 4.0, 4.0, 9.0] and {r["y"] for r in out} == {0.0}
    assert [r["a__missing"] for r in out] == [0.0, 1.0, 0.0, 0.0]


def test_inverse_normal(spark):
    probs = [1e-9, 1e-5, 0.01, 0.02425, 0.3, 0.5, 0.8, 0.99, 0.99999, 1.0]
    df = spark.createDataFrame([(p,) for p in probs] + [(None,)], "p double")
    got = [r["p"] for r in with_inverse_normal(df, ["p"]).collect()]
    expected = [NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in probs]
    assert got[:-1] == pytest.approx(expected, rel=1e-7, abs=1e-8) and got[-1] is None


def brute_normalize(train, x, n):
    refs = np.linspace(0, 1, n)
    knots = np.quantile(train, refs)
    share = 0.5 * (np.interp(x, knots, refs) - np.interp(-x, -knots[::-1], -refs[::-1]))
    share[x > knots[-1] - 1e-7] = 1.0
    share[x < knots[0] + 1e-7] = 0.0
    return [NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in share]


def test_quantile_normalizer_against_brute_force(spark):
    rng = np.random.default_rng(1)
    train = np.concatenate([rng.exponential(size=500), np.full(250, 0.7)])
    test = np.concatenate([rng.exponential(size=50), [0.7, -5.0, 50.0, train.min(), train.max()]])
    df = spark.createDataFrame([(float(v),) for v in train], "v double")
    model = QuantileNormalizer(inputCols=["v"], outputCols=["z"], quantiles=40).fit(df)
    out = model.transform(spark.createDataFrame([(float(v),) for v in test], "v double"))
    assert [r["z"] for r in out.collect()] == pytest.approx(brute_normalize(train, test, 40), rel=1e-6, abs=1e-6)


def brute_isotonic(x, y):
    """Pool adjacent violators on sorted distinct x."""
    blocks = []
    for v in sorted(set(x)):
        ys = [b for a, b in zip(x, y) if a == v]
        blocks.append([sum(ys), len(ys), [v]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, vs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + vs]
    return {v: s / n for s, n, vs in blocks for v in vs}


def test_calibrator_against_pooling(spark):
    rng = random.Random(2)
    x = [round(rng.random(), 2) for _ in range(600)]
    y = [int(rng.random() < v * v) for v in x]
    df = spark.createDataFrame(list(zip(y, x)), "y_true int, y_prob double")
    calibrator = isotonic.fit_calibrator(df)
    expected = brute_isotonic(x, y)
    for way in (calibrator, isotonic.Calibrator(calibrator.blocks)):  # looked up and joined
        got = {r["y_prob"]: r["y_prob_calibrated"] for r in way.apply(df).collect()}
        assert {k: pytest.approx(v) for k, v in expected.items()} == got
        outside = spark.createDataFrame([(-1.0,), (2.0,)], "y_prob double")
        ends = sorted(r["y_prob_calibrated"] for r in way.apply(outside).collect())
        assert ends == [pytest.approx(min(expected.values())), pytest.approx(max(expected.values()))]


@pytest.mark.parametrize("shape", ["rising", "flat", "falling", "one"])
def test_isotonic_blocks_by_group(spark, shape):
    """Hulls in many partitions: blocks equal pooled ones, and both ways to apply them agree with straight lines between."""
    rng = random.Random(shape)
    chance = {"rising": lambda v: v, "flat": lambda v: 0.3, "falling": lambda v: 1 - v, "one": lambda v: 1.0}[shape]
    data = []
    for g in ("a", "b"):
        for _ in range(1500 if shape != "one" else 1):
            v = round(rng.random(), 3)
            data.append((g, int(rng.random() < chance(v)), v if g == "a" else 1 - v))
    data += [("a", 1, None), ("a", None, 0.5), ("a", 0, float("nan"))]
    df = spark.createDataFrame(data, "model string, y_true int, y_prob double")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        blocks = isotonic.staged(isotonic.isotonic_blocks(df.repartition(9), group="model"), "test")
    finally:
        spark.conf.set(key, "true")
    every = [i / 700 for i in range(-5, 710)]
    asked = spark.createDataFrame([(g, v) for g in "abc" for v in every] + [("a", None)], "model string, y_prob double")
    got = {(r["model"], r["y_prob"]): r["y_prob_calibrated"] for r in isotonic.calibrated(asked, blocks, group="model").collect()}
    assert got["a", None] is None and all(got["c", v] is None for v in every)
    for g in "ab":
        mine = [r for r in data if r[0] == g and r[1] is not None and r[2] is not None and r[2] == r[2]]
        expected = brute_isotonic([r[2] for r in mine], [r[1] for r in mine])
        xs = sorted(expected)
        line = np.interp(every, xs, [expected[v] for v in xs])
        assert [got[g, v] for v in every] == pytest.approx(line.tolist())
        values = [r["value"] for r in blocks.filter(F.col("model") == g).orderBy("low").collect()]
        assert values == sorted(values) and sum(r["rows"] for r in blocks.filter(F.col("model") == g).collect()) == len(mine)


def test_no_scores_no_blocks(spark):
    none = spark.createDataFrame([], "y_true int, y_prob double")
    assert isotonic.isotonic_blocks(none).count() == 0


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(7)
    data = []
    for i in range(900):
        a = rng.gauss(0, 1)
        fire = int(a + rng.gauss(0, 0.7) > 0.4)
        severity = max(0.0, 0.4 + 0.3 * a + rng.gauss(0, 0.05)) if fire else None
        cls = None if severity is None else (0 if severity < 0.5 else 1 if severity < 0.8 else 2)
        data.append(
            (f"p_{i % 10}_{i % 7}", day("2021-01-01") + dt.timedelta(i // 3), a if i % 11 else None, rng.random(), fire, fire, severity, cls, 100.0, -1.0)
        )
    df = spark.createDataFrame(
        data,
        "patch_id string, reference_date date, optical_a double, weather_b double, y_occ_30d int, y_sev_available int, y_sev_reg double, y_sev_cls int, centroid_lon double, centroid_lat double",
    )
    return splits.temporal_split(df, train_end="2021-06-30", val_end="2021-08-31", test_end="2021-12-31").cache()


@pytest.mark.parametrize("name,params", [("logreg", {}), ("random_forest", FEW), ("boosted", FEW)])
def test_occurrence_run(spark, panel, name, params, tmp_path):
    fit = fitting.fit_occurrence(panel, name, params)
    report = fit.report.first()
    assert report["roc_auc"] > 0.75 and report["n_train"] + report["n_val"] + report["n_test"] == 900
    assert report["n_features"] == 2 and 0 < report["train_nan_rate"] < 0.1
    test = panel.filter("split = 'test'").count()
    out = fit.predictions.agg(
        F.count("*"), F.min("y_prob"), F.max("y_prob"), F.min("y_prob_calibrated"), F.max("y_prob_calibrated"),
        F.count_if((F.col("y_prob_calibrated") >= fit.threshold).cast("int") != F.col("y_pred_calibrated_tuned")),
    ).first()
    assert out[0] == test and 0 <= out[1] <= out[2] <= 1 and 0 <= out[3] <= out[4] <= 1 and out[5] == 0
    importances = {r["feature"]: r["importance"] for r in score.top_features(score.feature_importances(fit)).collect()}
    assert importances["optical_a"] > importances["weather_b"] >= 0
    if name == "logreg":
        shares = {r["feature"]: r["mean_abs_attribution"] for r in score.linear_attribution(panel, fit).collect()}
        assert shares["optical_a"] > shares["weather_b"]
    else:
        with pytest.raises(TypeError):
            score.linear_attribution(panel, fit)


def test_scoring_with_saved_models(spark, panel, tmp_path):
    fire = fitting.fit_occurrence(panel, "logreg")
    severity = fitting.fit_severity_reg(panel, FEW)
    assert severity.report.first()["correlation"] > 0.5
    fire.save(str(tmp_path / "fire"))
    severity.save(str(tmp_path / "severity"))
    again = fitting.Fit.load(str(tmp_path / "fire")), fitting.Fit.load(str(tmp_path / "severity"))
    wider = panel.withColumn("optical_new", F.lit(1.0))
    out = score.score_panel(wider, *again)
    for r in out.collect():
        assert 0 <= r["p_fire"] <= 1 and r["severity_conditional"] >= 0
        assert r["expected_risk"] == pytest.approx(r["p_fire"] * r["severity_conditional"])
        assert r["fire_alert"] == int(r["p_fire"] >= fire.threshold) and r["centroid_lon"] == 100.0
    first = {(r["patch_id"], r["reference_date"]): r["p_fire_raw"] for r in score.score_panel(panel, fire, severity).collect()}
    second = {(r["patch_id"], r["reference_date"]): r["p_fire_raw"] for r in out.collect()}
    assert first == pytest.approx(second)
    summary = metrics.inference_summary(out).first()
    assert summary["n"] == 900 and 0 <= summary["alert_share"] <= 1
    plan = score.score_panel(spark.read.parquet(_written(panel, tmp_path)), *again)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError, match="optical_a"):
        score.score_panel(panel.drop("optical_a"), fire, severity)


def _written(panel, tmp_path):
    panel.write.parquet(str(tmp_path / "panel"))
    return str(tmp_path / "panel")


def test_severity_classes_run(spark, panel):
    fit = fitting.fit_severity_cls(panel, FEW)
    assert fit.report.first()["sev_macro_f1"] > 0.4
    assert {r["y_sev_cls"] for r in fit.class_counts.collect()} == {0.0, 1.0, 2.0}
    assert score.feature_importances(fit).count() == 2
    with pytest.raises(ValueError, match="val"):
        fitting.fit_severity_cls(panel.filter("split <> 'val'"), FEW)


def test_rounds_stop_where_validation_loss_turns(spark):
    """Labels that are noise on the validation rows: rounds stop after so many without a better loss, and only the best prefix stays."""
    rng = np.random.default_rng(11)
    data = [(Vectors.dense(rng.normal(size=3).tolist()), float(rng.random() < 0.5), bool(i % 3 == 0)) for i in range(600)]
    rows = spark.createDataFrame(data, ["features", "y", "is_val"])
    params = fitting.DEFAULTS["boosted"] | {"n_estimators": 40, "max_depth": 3, "early_stopping_rounds": 3}
    made = boosting.boost(rows, features="features", label="y", loss=boosting.LOGISTIC, params=params)
    best = int(np.argmin(made.losses))
    assert len(made.rounds) == best + 1 < 40 and made.stopped_after == len(made.losses) == best + 4
    free = boosting.boost(rows.withColumn("is_val", F.lit(False)), features="features", label="y", loss=boosting.LOGISTIC, params=params | {"n_estimators": 5})
    assert len(free.rounds) == 5


def test_softmax_shares_sum_to_one(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 2))
    y = np.where(x[:, 0] > 0.6, 2, np.where(x[:, 0] > -0.4, 1, 0))
    rows = spark.createDataFrame([(Vectors.dense(a.tolist()), float(b), i % 4 == 0) for i, (a, b) in enumerate(zip(x, y))], ["features", "y", "is_val"])
    params = fitting.DEFAULTS["boosted"] | {"n_estimators": 6, "max_depth": 2}
    made = boosting.boost(rows, features="features", label="y", loss=boosting.SOFTMAX, params=params, classes=3)
    assert made.losses == sorted(made.losses, reverse=True) and len(made.start) == 3
    out = PipelineModel(made.stages("features", "m_")).transform(rows).collect()
    assert all(sum(r["m_probability"]) == pytest.approx(1) and len(r["m_probability"]) == 3 for r in out)
    assert np.mean([r["m_prediction"] == r["y"] for r in out]) > 0.95
    margins = [[b + 0.1 * sum(t[k].predict(r["features"]) for t in made.rounds) for k, b in enumerate(made.start)] for r in out[:20]]
    powers = np.exp(margins)
    assert np.allclose([r["m_probability"] for r in out[:20]], powers / powers.sum(1, keepdims=True))


def test_attribution_over_several_outputs(spark, panel):
    fit = fitting.fit_severity_cls(panel, model_name="logreg")
    shares = {r["feature"]: r["mean_abs_attribution"] for r in score.linear_attribution(panel, fit).collect()}
    assert shares["optical_a"] > shares["weather_b"] > 0
    assert all(sum(r["y_probs"]) == pytest.approx(1) for r in fit.predictions.collect())


def test_sample_is_repeatable(spark, panel):
    one = score.capped_sample(panel, 50).collect()
    two = score.capped_sample(panel.repartition(7), 50).collect()
    assert len(one) == 50 and {(r["patch_id"], r["reference_date"]) for r in one} == {(r["patch_id"], r["reference_date"]) for r in two}
    assert score.capped_sample(panel, 5000).count() == 900
