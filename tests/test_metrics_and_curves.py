import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from panelforge.functions.bins import edges_at_or_below, uniform_bin, uniform_edges
from panelforge.operators import curves, metrics, ordered

PRED = "patch_id string, reference_date date, y_true int, y_prob double"


def frame(spark, y, p, **more):
    data = [(f"p_{i % 20}_{i}", day("2021-01-01"), int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(data, PRED).withColumn("model", F.lit("m"))
    return df.withColumns(more) if more else df


def random_predictions(n=400, seed=3, digits=2):
    rng = random.Random(seed)
    y = [int(rng.random() < 0.3) for _ in range(n)]
    p = [round(min(1.0, max(0.0, rng.gauss(0.35 + 0.2 * t, 0.25))), digits) for t in y]
    return np.array(y), np.array(p)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def brute_pr(y, p):
    points = [(1.0, 0.0)]
    for t in sorted(set(p), reverse=True):
        alert = p >= t
        points.append((y[alert].mean(), y[alert].sum() / y.sum()))
    step = sum((r - r0) * q for (_, r0), (q, r) in zip(points, points[1:]))
    area = sum((r - r0) * (q + q0) / 2 for (q0, r0), (q, r) in zip(points, points[1:]))
    return step, area


def brute_ece(y, p, bins=10):
    edges = np.linspace(0.0, 1.0, bins + 1)
    total = 0.0
    for left, right in zip(edges, edges[1:]):
        inside = (p >= left) & (p < right)
        if inside.any():
            total += abs(y[inside].mean() - p[inside].mean()) * inside.sum() / len(y)
    return total


def brute_f1(y, alert):
    tp = (y * alert).sum()
    return 2 * tp / (alert.sum() + y.sum()) if alert.sum() + y.sum() else 0.0


def test_edges_equal_numpy(spark):
    assert uniform_edges(10) == np.linspace(0.0, 1.0, 11).tolist()
    assert curves.tradeoff_thresholds() == np.linspace(0.01, 0.99, 99).tolist()
    values = [0.0, 0.1, 0.3, 0.30000000000000004, 0.7, 0.9999, 1.0, -0.1, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(uniform_bin(F.col("v"), 10)).collect()]
    assert got == [0, 1, 2, 3, 6, 9, None, None, None]
    got = [r[0] for r in df.filter("v >= 0").select(edges_at_or_below(F.col("v"), [0.1, 0.3])).collect()]
    assert got == [0, 1, 2, 2, 2, 2, 2]


def test_small_exact(spark):
    df = frame(spark, [0, 1, 0, 1, 1], [0.1, 0.8, 0.4, 0.7, 0.9])
    row = metrics.evaluate_occurrence(df).first()
    assert row["roc_auc"] == 1.0 and row["f1"] == 1.0 and row["pr_auc"] == 1.0
    assert row["n_samples"] == 5 and row["prevalence"] == 0.6
    assert row["topk_recall_100"] is None
    assert row["optimal_threshold"] == 0.7 and row["optimal_f1"] == 1.0


@pytest.mark.parametrize("digits", [2, 6])
def test_ranked_metrics_against_brute_force(spark, digits):
    y, p = random_predictions(digits=digits)
    p[:5] = 1.0
    row = metrics.ladder_metrics(metrics.score_ladder(metrics.unpivot_scores(frame(spark, y, p)), slices=7)).first()
    step, area = brute_pr(y, p)
    assert row["roc_auc"] == pytest.approx(brute_auc(y, p))
    assert row["pr_auc"] == pytest.approx(step) and row["pr_trapezoid"] == pytest.approx(area)
    assert row["ece"] == pytest.approx(brute_ece(y, p))
    best = max((brute_f1(y, p >= t), -t) for t in set(p))
    assert (row["best_f1"], row["best_threshold"]) == (pytest.approx(best[0]), pytest.approx(-best[1]))
    assert row["f1_half"] == pytest.approx(brute_f1(y, p >= 0.5))


def test_one_class(spark):
    row = metrics.evaluate_occurrence(frame(spark, [0, 0, 0], [0.2, 0.6, 0.4])).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["f1"] == 0.0
    assert (row["optimal_threshold"], row["optimal_f1"]) == (0.5, 0.0)
    assert curves.roc_curve(frame(spark, [0, 0], [0.2, 0.6])).isEmpty()
    assert curves.cumulative_gain(frame(spark, [0, 0], [0.2, 0.6])).isEmpty()


def test_deployment_threshold_and_default_labels(spark):
    y, p = random_predictions(80)
    cal = F.col("y_prob") * 0.9
    df = frame(spark, y, p).withColumns({"y_prob_calibrated": cal, "occurrence_decision_threshold": F.lit(0.35)})
    row = metrics.evaluate_occurrence(df, topk=[10]).first()
    assert row["f1_calibrated_deployment"] == pytest.approx(brute_f1(y, p * 0.9 >= 0.35))
    assert row["f1"] == pytest.approx(brute_f1(y, p >= 0.5)) and row["f1_calibrated"] == pytest.approx(brute_f1(y, p * 0.9 >= 0.5))
    assert row["deployment_threshold"] == 0.35 and row["topk_recall_10"] is not None


def test_models_with_and_without_calibration_share_a_table(spark):
    y, p = random_predictions(80)
    plain = frame(spark, y, p).withColumn("model", F.lit("plain"))
    tuned = frame(spark, y, p).withColumns(
        {
            "model": F.lit("tuned"),
            "y_pred": F.lit(1),
            "y_prob_calibrated": F.col("y_prob") * 0.5,
            "occurrence_decision_threshold": F.lit(0.2),
        }
    )
    table = plain.unionByName(tuned, allowMissingColumns=True)
    got = {r["model"]: r for r in metrics.evaluate_occurrence(table).collect()}
    for name in ("roc_auc_calibrated", "ece_calibrated", "deployment_threshold", "f1_calibrated_deployment"):
        assert got["plain"][name] is None and got["tuned"][name] is not None
    assert got["plain"]["f1"] == pytest.approx(brute_f1(y, p >= 0.5)) and got["tuned"]["f1"] == pytest.approx(brute_f1(y, p >= 0))
    assert got["tuned"]["ece_calibrated"] == pytest.approx(brute_ece(y, p * 0.5))
    sev = plain.select("patch_id", "reference_date", F.lit(2.0).alias("y_pred"))
    risk = {r["occ_model"]: r["expected_risk_mean"] for r in metrics.evaluate_combined_risk(table, sev).collect()}
    assert risk == {"plain": pytest.approx(2 * p.mean()), "tuned": pytest.approx(p.mean())}


@pytest.mark.parametrize("distinct", [1, 3, 1000])
def test_topk_of_any_k_with_ties(spark, distinct):
    """One score for all rows, a few scores, and many: every k from one to beyond the rows."""
    rng = random.Random(distinct)
    data = [(m, f"p{i % 37}", day("2020-01-01") + dt.timedelta(i), int(rng.random() < 0.3), rng.randrange(distinct) / distinct) for m in "ab" for i in range(700)]
    data += [("a", "none", day("2020-01-01"), 1, None), ("a", "none", day("2020-01-02"), 1, float("nan"))]
    df = spark.createDataFrame(data, "model string, patch_id string, reference_date date, y_true int, y_prob double")
    ks = [1, 2, 5, 99, 350, 699, 700, 701, 1_000_000]
    got = {r["model"]: r for r in metrics.topk_recall(df, ks).collect()}
    for m in "ab":
        mine = [r for r in data if r[0] == m]
        fine = [r for r in mine if r[4] is not None and r[4] == r[4]]
        order = sorted(fine, key=lambda r: (-r[4], hashlib.md5(f"{r[1]}|{r[2]}".encode()).hexdigest()))
        for k in ks:
            assert got[m][f"topk_recall_{k}"] == pytest.approx(sum(r[3] for r in order[:k]) / sum(r[3] for r in mine))


def test_topk(spark):
    df = frame(spark, [1, 0, 1, 0], [0.9, 0.8, 0.1, 0.05])
    assert rows(metrics.topk_recall(df, [1, 3, 10])) == [("m", 4, 0.5, 1.0, 1.0)]
    assert metrics.topk_recall(frame(spark, [0], [0.5]), [1]).first()["topk_recall_1"] == 0.0
    with pytest.raises(ValueError):
        metrics.topk_recall(df, [0])


def test_severity_classes(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (1, 1)], "y_true int, y_pred int")
    row = metrics.severity_cls_summary(df).first()
    assert row["sev_macro_f1"] == pytest.approx(0.6) and row["n_samples"] == 4
    assert row["class_2_recall"] == 0.0 and row["class_1_precision"] == pytest.approx(2 / 3) and row["class_1_support"] == 2
    only_predicted = spark.createDataFrame([(0, 3)], "y_true int, y_pred int")
    assert {r["class"]: r["support"] for r in metrics.evaluate_severity_cls(only_predicted).collect()} == {0: 1, 3: 0}


def test_severity_regression(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.3, 0.4), (0.8, 0.7)], "y_true double, y_pred double")
    row = metrics.evaluate_severity_reg(df).first()
    t, p = np.array([0.1, 0.3, 0.8]), np.array([0.2, 0.4, 0.7])
    assert row["sev_mae"] == pytest.approx(0.1) and row["sev_rmse"] == pytest.approx(0.1)
    assert row["y_true_std"] == pytest.approx(t.std()) and row["correlation"] == pytest.approx(np.corrcoef(t, p)[0, 1])
    flat = metrics.evaluate_severity_reg(df.withColumn("y_pred", F.lit(0.5))).first()
    assert flat["correlation"] == 0.0
    assert metrics.evaluate_severity_reg(df.limit(1)).first()["correlation"] == 0.0


def test_combined_risk(spark):
    occ = spark.createDataFrame([("a", day("2021-01-01"), 1, 0.99, 0.2)], PRED + ", y_prob_calibrated double")
    sev = spark.createDataFrame([("a", day("2021-01-01"), 0.4, 0.5)], "patch_id string, reference_date date, y_true double, y_pred double")
    row = metrics.evaluate_combined_risk(occ, sev, topk=[1]).first()
    assert row["combined_risk_n"] == 1 and row["expected_risk_mean"] == pytest.approx(0.1) and row["combined_topk_recall_1"] == 1.0
    apart = sev.withColumn("patch_id", F.lit("b"))
    row = metrics.evaluate_combined_risk(occ, apart).first()
    assert row["combined_risk_n"] == 0 and row["expected_risk_mean"] is None
    assert metrics.evaluate_combined_risk(occ, sev.drop("patch_id")).first()["combined_risk_n"] == 0


def test_spatial_subset(spark):
    y, p = random_predictions(100)
    df = frame(spark, y, p)
    row = metrics.spatial_subset_metrics(df, ["p_1_", "p_2_"], "occurrence").first()
    assert row["spatial_holdout_n"] == row["spatial_n_samples"] == 10
    for task in ("occurrence", "severity_reg", "severity_cls"):
        made = df.withColumn("y_pred", F.lit(1))
        assert metrics.spatial_subset_metrics(made, ["nowhere_"], task).first()["spatial_holdout_n"] == 0


def test_task_inference(spark):
    whole = spark.createDataFrame([("m", 0.0), ("m", 2.0), ("x_sev_reg", 1.0), ("r", 0.5), ("x_severity_cls", 0.5)], "model string, y_pred double")
    got = dict(rows(metrics.infer_task(whole)))
    assert got == {"m": "severity_cls", "x_sev_reg": "severity_reg", "r": "severity_reg", "x_severity_cls": "severity_cls"}
    many = spark.range(11).select(F.lit("m").alias("model"), F.col("id").cast("double").alias("y_pred"))
    assert metrics.infer_task(many).first()["task"] == "severity_reg"
    with pytest.raises(ValueError):
        metrics.infer_task(spark.range(1))


def test_multitask_loss(spark):
    data = [(2.0, 0.5, 1, 0.3, 1), (-800.0, 0.1, 1, 0.0, 0), (800.0, 0.2, 0, 0.4, 1)]
    df = spark.createDataFrame(data, "logit double, sev_pred double, y_occ int, y_sev double, mask int")
    row = metrics.multitask_loss(df, pos_weight=3.0).first()
    occ = (3 * math.log1p(math.exp(-2.0)) + 3 * 800.0 + 800.0) / 3
    sev = (0.04 + 0.04) / (2 + 1e-8)
    assert row["occurrence_loss"] == pytest.approx(occ) and row["severity_loss"] == pytest.approx(sev)
    assert row["loss"] == pytest.approx(occ + 0.5 * sev)


def test_roc_points(spark):
    y, p = random_predictions(200, digits=1)
    full = curves.roc_curve(frame(spark, y, p), drop_collinear=False).orderBy(F.col("threshold").desc()).collect()
    for r in full[1:]:
        alert = p >= r["threshold"]
        assert (r["x"], r["y"]) == (pytest.approx((alert & (y == 0)).sum() / (y == 0).sum()), pytest.approx((alert & (y == 1)).sum() / y.sum()))
    assert (full[0]["x"], full[0]["y"], full[0]["threshold"]) == (0.0, 0.0, float("inf"))
    # rungs that add the same counts as the next lower one are left out, ends stay
    line = frame(spark, [1, 0] * 5, [0.9, 0.9, 0.7, 0.7, 0.5, 0.5, 0.3, 0.3, 0.1, 0.1])
    kept = sorted(r["threshold"] for r in curves.roc_curve(line).collect())
    assert kept == [0.1, 0.9, float("inf")]


def test_pr_points(spark):
    y, p = random_predictions(120, digits=1)
    got = curves.pr_curve(frame(spark, y, p))
    last = got.filter("threshold is null").collect()
    assert [(r["x"], r["y"]) for r in last] == [(0.0, 1.0)]
    assert got.count() == len(set(p)) + 1 and got.first()["metric"] == pytest.approx(brute_pr(y, p)[1])


def test_threshold_tradeoff(spark):
    y, p = random_predictions(150)
    got = curves.threshold_tradeoff(frame(spark, y, p)).orderBy("threshold").collect()
    assert len(got) == 99
    for r in got:
        alert = p >= r["threshold"]
        assert r["alerts"] == alert.sum() and r["f1"] == pytest.approx(brute_f1(y, alert))


def test_reliability_has_all_bins(spark):
    got = curves.reliability_histogram(frame(spark, [1, 0], [0.15, 1.0])).orderBy("bin").collect()
    assert len(got) == 10 and [r["count"] for r in got] == [0, 1] + [0] * 8
    assert got[0]["bin_center"] == 0.05 and got[0]["bin_rate"] == 0.0 and got[1]["bin_center"] == 0.15
    assert curves.calibration_bins(frame(spark, [1, 0], [0.15, 1.0])).count() == 1


def test_gain_ends_at_one(spark):
    y, p = random_predictions(300)
    got = curves.cumulative_gain(frame(spark, y, p)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 301))
    assert got[-1]["fire_capture_rate"] == 1.0 and got[-1]["fraction_reviewed"] == 1.0
    captured = [r["fire_capture_rate"] for r in got]
    assert captured == sorted(captured)


@pytest.mark.parametrize("slices", [1, 2, 16, 64])
@pytest.mark.parametrize("descending", [True, False])
def test_running_sums_do_not_depend_on_slices(spark, slices, descending):
    # a third of all rows share one value
    rng = random.Random(1)
    data = [(rng.choice("ab"), 0.5 if rng.random() < 0.34 else round(rng.random(), 3), i) for i in range(900)]
    df = spark.createDataFrame(data, "g string, v double, n long").withColumn("d", F.md5(F.col("n").cast("string")))
    out = ordered.running_sums(df, by=["g"], value="v", sums=["n"], descending=descending, digest="d", slices=slices)
    for g in "ab":
        got = [r for r in out.filter(F.col("g") == g).collect()]
        got.sort(key=lambda r: (-r["v"] if descending else r["v"], r["d"]))
        total, expect = sum(r["n"] for r in got), 0
        for r in got:
            expect += r["n"]
            assert (r["cum_n"], r["total_n"]) == (expect, total)


def test_hot_value_is_cut_by_its_ties(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("v"), F.md5(F.col("id").cast("string")).alias("d"))
    cuts = ordered.cut_points(df, "v", 16)
    assert 0.5 in cuts[1]
    sliced = ordered.with_slice(df, "v", descending=True, cuts=cuts, digest="d").groupBy("_slice").count()
    assert sliced.agg(F.max("count")).first()[0] < 4000 / 8


def test_lead_crosses_slices(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"), F.col("id").alias("n"))
    out = ordered.running_sums(df, by=["g"], value="v", sums=["n"], lead=["n"], slices=9).orderBy(F.col("v").desc()).collect()
    assert [r["next_n"] for r in out] == [*range(98, -1, -1), None]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=501).round(2), rng.exponential(size=501)
    data = [(float(x), float(z) if i % 5 else None) for i, (x, z) in enumerate(zip(a, b))]
    df = spark.createDataFrame(data, "a double, b double")
    kept = b[[i for i in range(501) if i % 5]]
    for probs in ([0.0, 0.01, 0.5, 0.99, 1.0], [i / 99 for i in range(100)]):
        got = {(r["feature"], r["prob"]): r["quantile"] for r in ordered.exact_quantiles(df, ["a", "b"], probs, slices=7).collect()}
        assert len(got) == 2 * len(probs)
        for p in probs:
            assert got["a", p] == pytest.approx(np.quantile(a, p)) and got["b", p] == pytest.approx(np.quantile(kept, p))
    one = ordered.exact_quantiles(df.limit(1), ["a"], [i / 99 for i in range(100)])
    assert one.count() == 100 and one.select("quantile").distinct().count() == 1


@pytest.mark.parametrize("n", [3, 900, 20000])
def test_few_quantiles_near_brackets(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.integers(0, 5, size=n).astype(float)
    data = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    df = data.withColumn("none", F.lit(None).cast("double"))
    got = {(r["feature"], r["prob"]): r["quantile"] for r in ordered.exact_quantiles(df, ["a", "b", "none"], probs).collect()}
    assert got == {(f, p): pytest.approx(np.quantile(v, p), abs=1e-12) for f, v in (("a", a), ("b", b)) for p in probs}


def test_dependence_bins(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("f"), (F.col("id") >= 50).cast("int").alias("t"))
    got = curves.dependence_bins(df, "f", "t", bins=4).orderBy("bin").collect()
    assert [(r["n"], r["target_mean"]) for r in got] == [(25, 0.0), (25, 0.0), (25, 1.0), (25, 1.0)]


def test_evaluate_all_routes_models(spark):
    from panelforge.plans.evaluate import evaluate_all, research_curves

    y, p = random_predictions(120)
    occ = frame(spark, y, p).withColumn("model", F.lit("logreg"))
    keys = occ.select("patch_id", "reference_date")
    reg = keys.withColumns({"y_true": F.lit(1), "y_pred": F.lit(0.25), "model": F.lit("x_sev_reg")})
    cls = keys.withColumns({"y_true": F.lit(1), "y_pred": F.lit(1.0), "model": F.lit("net")})
    table = evaluate_all(
        occ.unionByName(reg, allowMissingColumns=True).unionByName(cls, allowMissingColumns=True), prefixes=["p_3_"], topk=[5]
    )
    got = {r["model"]: r for r in table.collect()}
    assert set(got) == {"logreg", "x_sev_reg", "net", "risk__logreg+x_sev_reg"}
    assert got["logreg"]["roc_auc"] == pytest.approx(brute_auc(y, p)) and got["logreg"]["f1"] == pytest.approx(brute_f1(y, p >= 0.5))
    assert got["logreg"]["spatial_holdout_n"] == 6 and got["net"]["spatial_n_samples"] == 6
    assert got["net"]["sev_macro_f1"] == 1.0 and got["x_sev_reg"]["sev_mae"] == 0.75
    assert got["risk__logreg+x_sev_reg"]["combined_risk_n"] == 120 and got["risk__logreg+x_sev_reg"]["sev_mae"] is None
    assert set(research_curves(occ, reg)) == {"roc_pr_curve_points", "calibration_bins", "threshold_tradeoffs", "cumulative_gain", "severity_regression_diagnostics"}
