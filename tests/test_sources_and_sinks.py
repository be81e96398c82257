import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from panelforge.operators import checks, curves, keys, metrics
from panelforge.sources import panel_io as io
from panelforge.session import shared_folder
from panelforge.sources.registry import band_list, observation_sources

PANEL = (
    "patch_id string, reference_date date, y_occ_7d int, y_occ_30d int, y_occ_60d int, y_sev_reg double, y_sev_cls int, "
    "y_sev_available int, label_window_start date, label_window_end date, feature_max_timestamp date, reference_year int"
)


def panel(spark, seen="2020-01-01"):
    row = ("a", day("2020-01-01"), 0, 1, 1, None, None, 0, day("2020-01-02"), day("2020-03-01"), day(seen), 2020)
    return spark.createDataFrame([row, ("b", *row[1:])], PANEL)


def test_panel_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    made = panel(spark).withColumn("optical_x", F.when(F.col("patch_id") == "a", float("nan")).otherwise(1.0))
    io.write_panel(made, path, ["reference_year"])
    assert os.path.isdir(f"{path}/reference_year=2020")
    back = io.read_panel(spark, path)
    assert dict(rows(back.select("patch_id", "optical_x"))) == {"a": None, "b": 1.0}
    with pytest.raises(ValueError, match="nope"):
        io.write_panel(made, path, ["nope"])


def test_validate_and_write(spark, tmp_path):
    path = str(tmp_path / "p")
    io.validate_and_write(panel(spark), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(checks.ContractError, match="duplicate"):
        io.validate_and_write(panel(spark).union(panel(spark)), path)
    with pytest.raises(checks.ContractError, match="after the reference date"):
        io.validate_and_write(panel(spark, seen="2020-01-05"), path)
    with pytest.raises(checks.ContractError, match="lacks"):
        io.validate_and_write(panel(spark).drop("y_occ_7d"), path)
    assert spark.read.parquet(path).count() == 2
    io.validate_and_write(panel(spark, seen="2020-01-05"), path, leakage=False)
    assert not [f for f in os.listdir(shared_folder(spark)) if f.startswith("stage-")]


def test_grid_round_trip_reads_five_columns(spark, tmp_path):
    path = str(tmp_path / "g")
    io.write_grid(keys.patch_grid(spark, (0.0, 0.0, 1.0, 1.0), grid_km=55.5), path)
    back = io.read_patches(spark, path)
    assert back.columns == keys.PATCH_COLUMNS and back.count() == 4
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "centroid" not in plan.split("ReadSchema")[1]


def test_predictions_of_all_models(spark, tmp_path):
    one = spark.createDataFrame([("a", 0.5)], "patch_id string, y_prob double")
    two = spark.createDataFrame([("a", 0.25)], "patch_id string, y_pred double")
    one.write.parquet(str(tmp_path / "exp_logreg_predictions.parquet"))
    two.write.parquet(str(tmp_path / "exp_sev_reg_predictions.parquet"))
    two.toPandas().to_parquet(tmp_path / "other_x_predictions.parquet")
    got = io.read_predictions(spark, str(tmp_path), "exp")
    assert rows(got.select("model", "y_prob", "y_pred"), "model") == [("logreg", 0.5, None), ("sev_reg", None, 0.25)]
    assert {r["model"] for r in io.read_predictions(spark, str(tmp_path)).collect()} == {"exp_logreg", "exp_sev_reg", "other_x"}
    assert dict(rows(metrics.infer_task(got))) == {"logreg": "occurrence", "sev_reg": "severity_reg"}


def test_metrics_json_nulls(spark, tmp_path):
    df = spark.createDataFrame([("m", float("nan"), float("inf"), 1.5)], "model string, a double, b double, c double")
    io.write_metrics(df, str(tmp_path / "m"))
    (part,) = [f for f in os.listdir(tmp_path / "m") if f.endswith(".json")]
    assert json.loads((tmp_path / "m" / part).read_text()) == {"model": "m", "a": None, "b": None, "c": 1.5}


def test_report_append_unions_columns(spark, tmp_path):
    path = str(tmp_path / "r")
    io.append_report(spark.createDataFrame([("x", 1)], "run string, f1 int"), path)
    io.append_report(spark.createDataFrame([("y", 2.5)], "run string, auc double"), path)
    got = {r["run"]: (r["f1"], r["auc"]) for r in io.read_report(spark, path).collect()}
    assert got == {"x": (1, None), "y": (None, 2.5)}
    io.append_report(spark.createDataFrame([("z", None)], "run string, auc double"), path)
    assert dict(io.read_report(spark, path).dtypes) == {"run": "string", "f1": "bigint", "auc": "double"}
    with pytest.raises(FileNotFoundError):
        io.read_report(spark, str(tmp_path / "none"))


def test_map_curve_and_comparison_sinks(spark, tmp_path):
    pred = spark.createDataFrame(
        [("a", day("2020-01-01"), 1, 0.9), ("b", day("2020-01-02"), 0, 0.2)], "patch_id string, reference_date date, y_true int, y_prob double"
    )
    io.write_map_table(pred, str(tmp_path / "map"))
    assert os.path.isdir(tmp_path / "map" / "reference_date=2020-01-02")
    io.write_curves({"roc_pr_curve_points": curves.roc_pr_points(pred), "calibration_bins": curves.calibration_bins(pred)}, str(tmp_path), "run")
    back = spark.read.option("header", True).csv(str(tmp_path / "run_roc_pr_curve_points"))
    assert {r["curve"] for r in back.collect()} == {"roc", "precision_recall"}
    io.write_comparison(metrics.evaluate_occurrence(pred), str(tmp_path))
    assert spark.read.json(str(tmp_path / "comparison_json")).first()["roc_auc"] == 1.0
    assert spark.read.option("header", True).csv(str(tmp_path / "comparison_csv")).count() == 1


def test_source_registry(spark, tmp_path):
    assert band_list([], ["a"]) == ["a"] and band_list(["TODO_x"], ["a"]) == ["a"] and band_list(["B8"], ["a"]) == ["b8"]
    path = str(tmp_path / "obs")
    spark.createDataFrame([("a", 1, 1, day("2020-01-01"), float("nan"), 2.0, 9)], "patch_id string, pixel_id int, image_id int, obs_date date, b8 double, b12 double, junk int").write.parquet(path)
    found = observation_sources(
        spark,
        {
            "sentinel2_sr": {"enabled": True, "path": path, "required_bands": ["B8"]},
            "srtm": {"enabled": False, "path": path},
            "era5_land_daily": {"enabled": True, "path": path, "variables": ["TODO_v"], "dataset_id": "mine"},
        },
    )
    assert set(found) == {"sentinel2_sr", "era5_land_daily"}
    optical = found["sentinel2_sr"]
    assert optical.frame.columns == ["patch_id", "pixel_id", "image_id", "obs_date", "b8"]
    assert optical.frame.first()["b8"] is None
    assert found["era5_land_daily"].dataset_id == "mine" and found["era5_land_daily"].bands == ["temperature_2m", "total_precipitation_sum"]
