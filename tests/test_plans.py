"""What the plans must not contain, and what must reach the scans."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from panelforge.operators import composites, curves, keys, metrics
from panelforge.operators.windows import within_period
from panelforge.plans import ml_catalog
from panelforge.plans.bindings import Tables

QUERIES = ml_catalog.QUERIES  # the panel queries; text queries have plan tests of their own
TRAINS = {n for n in QUERIES if n.startswith("fit_") or n in ("score_panel", "feature_importances", "linear_attribution", "linear_attribution_classes", "evaluate_all")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# sliding statistics of pixels have the one Python worker among the panel operators (operators/pixels.py)
PIXELS = {
    "median_composite", "median_composite_hot_pixels", "mean_composite", "cloud_probability", "cloud_score", "merge_sources",
    "pre_post_dnbr", "severity_labels", "spectral_indices", "rolling_stats", "panel_build", "evaluate_panel",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINS))
def test_no_cross_joins_and_no_python_workers(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|InPandas", text)
    assert name in PIXELS or "MapInArrow" not in text


def test_spine_and_scoring_expressions_do_not_shuffle(spark):
    t = Tables(spark, DATA)
    assert "Exchange" not in plan(t.spine)
    assert "Exchange" not in plan(keys.patch_grid(spark))


def test_fire_filter_and_columns_reach_the_scan(spark, tmp_path):
    t = Tables(spark, DATA)
    path = str(tmp_path / "obs")
    t.observations.write.parquet(path)
    text = plan(composites.past_future_event_counts(t.keys, spark.read.parquet(path), lookback_days=30))
    assert "GreaterThanOrEqual(fire_mask,7)" in text
    scan = next(line for line in text.splitlines() if "fire_mask" in line and "ReadSchema" in line)
    assert "b8" not in scan.split("ReadSchema")[1]


def test_period_reaches_the_scan(spark):
    t = Tables(spark, DATA)
    df = within_period(t.observations, "1996-01-01", "1996-12-31", first=-60, last=60)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(l_shipdate,1995-11-02" in text and "LessThan(l_shipdate,1997-03-02" in text


def test_event_counts_use_one_window_pass(spark):
    t = Tables(spark, DATA)
    text = plan(composites.past_future_event_counts(t.keys, t.sources["viirs_active_fire"], lookback_days=30))
    assert text.count("Window [") == 1 and "Join [patch_id" not in text


def test_order_metrics_never_window_a_whole_model(spark):
    # every window over rows is partitioned by a slice; only windows over slice totals are not
    t = Tables(spark, DATA)
    for df in (metrics.roc_auc(t.occurrence), curves.cumulative_gain(t.occurrence), curves.pr_curve(t.occurrence)):
        for line in plan(df).splitlines():
            if "Window [" in line and "y_score" in line:
                assert "_slice" in line


def test_ladder_is_shared_between_its_uses(spark):
    # a report and curves read the written ladder, which is made once
    for df in (curves.pr_curve(Tables(spark, DATA).occurrence), curves.roc_curve(Tables(spark, DATA).occurrence)):
        text = plan(df)
        assert "ladder-" in text and "lineitem" not in text and "orders.parquet" not in text


def test_top_k_never_orders_the_rows_of_a_model(spark):
    text = plan(metrics.topk_recall(Tables(spark, DATA).occurrence, [100, 1_000_000]))
    windows = [line for line in text.splitlines() if re.search(r"Window \[", line)]
    assert windows and "WindowGroupLimit" not in text
    for line in windows:  # over slices of scores, totals per digits of the digest, or rows that share six digits
        assert any(c in line for c in ("_slice", "_d#"))


def test_queries_follow_the_data(spark):
    # every scan is of a given table
    for name in ("patch_grid", "panel_spine", "auto_holdout_prefixes"):
        assert "FileScan parquet" in plan(QUERIES[name](spark, DATA))


def test_hot_score_and_hot_model_stay_exact(spark):
    # a third of all rows in one score of one model
    n = 6000
    df = spark.range(n).select(
        F.concat(F.lit("p_1_"), "id").alias("patch_id"),
        F.lit("2021-01-01").cast("date").alias("reference_date"),
        F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("model"),
        (F.col("id") % 7 == 0).cast("int").alias("y_true"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") % 1000) / 1000).alias("y_prob"),
    )
    got = {r["model"]: r["roc_auc"] for r in metrics.roc_auc(df).collect()}
    pdf = df.toPandas()
    for model, part in pdf.groupby("model"):
        ranks = part["y_prob"].rank()
        pos = part["y_true"].sum()
        auc = (ranks[part["y_true"] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(part) - pos))
        assert got[model] == pytest.approx(auc)
    gain = curves.cumulative_gain(df).groupBy("model").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("rank").alias("d"))
    assert all(r["n"] == r["last"] == r["d"] for r in gain.collect())
