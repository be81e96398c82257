import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from panelforge.operators import features, holdout, splits


def test_index_values_and_missing(spark):
    df = spark.createDataFrame(
        [(1000.0, 3000.0, 5.0), (None, 4000.0, 0.0), (0.0, 0.0, None)],
        "optical_b4_mean_l60d double, optical_b8_mean_l60d double, optical_s2_observation_count double",
    )
    out = features.spectral_indices(df)
    assert [r["optical_ndvi"] for r in out.collect()] == [0.5, None, None]
    assert [r["optical_s2_signal_available"] for r in out.collect()] == [1, 0, 0]
    assert "optical_ndmi" not in out.columns and "optical_evi" not in out.columns


def test_no_bands_no_columns(spark):
    df = spark.createDataFrame([("a", 1)], "patch_id string, other int")
    assert features.spectral_indices(df).columns == ["patch_id", "other"]
    assert features.rolling_stats(df).columns == ["patch_id", "other"]


def test_rolling(spark):
    data = [("a", day("2023-08-01") + dt.timedelta(i), v) for i, v in enumerate([0.3, 0.5, 0.4, 0.6])] + [("b", day("2023-08-01"), None)]
    df = spark.createDataFrame(data, "patch_id string, reference_date date, optical_ndvi double")
    out = features.rolling_stats(df).orderBy("patch_id", "reference_date").collect()
    assert [r["temporal_optical_ndvi_rmean_3"] for r in out] == [pytest.approx(v) if v else None for v in (0.3, 0.4, 0.4, 0.5, None)]
    assert [r["temporal_optical_ndvi_rstd_3"] for r in out] == pytest.approx([0.0, 0.02**0.5, 0.1, 0.1, 0.0])


def test_feature_names(spark):
    names = ["static_min_lon", "centroid_lat", "optical_ndvi", "weather_temp", "temporal_row_index", "temporal_recent_count_30d_placeholder", "y_occ_30d"]
    df = spark.range(1).select(*[F.lit(1.0).alias(n) for n in names])
    assert features.feature_columns(df) == ["optical_ndvi", "weather_temp"]
    variants = features.ablate_family(df)
    assert "optical_ndvi" not in variants["optical"].columns and "weather_temp" in variants["optical"].columns


def test_sequences(spark):
    data = [(f"p{p}", day("2021-01-01") + dt.timedelta(7 * i), None if i == 1 else float(i), 1.0, i % 2, None, 0) for p in range(4) for i in range(10)]
    df = spark.createDataFrame(data, "patch_id string, reference_date date, optical_a double, weather_b double, y_occ_30d int, y_sev_reg double, y_sev_available int")
    out = features.build_sequences(df, ["optical_a", "weather_b"], seq_len=8).orderBy("patch_id", "reference_date").collect()
    assert len(out) == 40
    first, second, last = out[0], out[1], out[9]
    assert first["pad_mask"] == [True] * 7 + [False] and first["x"][:7] == [[0.0, 0.0]] * 7 and first["x"][7] == [0.0, 1.0]
    assert second["x"][7] == [5.0, 1.0]  # the median of 0, 2..9
    assert last["pad_mask"] == [False] * 8 and [s[0] for s in last["x"]] == [float(i) for i in range(2, 10)]
    assert all(r["y_sev"] == 0.0 for r in out)


def test_sequences_stay_inside_a_split(spark):
    df = spark.createDataFrame(
        [("a", day("2021-01-01"), "train", 1.0), ("a", day("2021-01-02"), "val", 2.0)],
        "patch_id string, reference_date date, split string, optical_a double",
    ).withColumns({"y_occ_30d": F.lit(0), "y_sev_reg": F.lit(None).cast("double"), "y_sev_available": F.lit(0)})
    out = features.build_sequences(df, ["optical_a"], seq_len=2, medians={"optical_a": 0.0}, split_col="split")
    assert [r["x"] for r in out.orderBy("reference_date").collect()] == [[[0.0], [1.0]], [[0.0], [2.0]]]


def test_temporal_split(spark):
    df = spark.createDataFrame([(day(d),) for d in ("2020-01-01", "2020-01-02", "2020-02-01", "2020-03-01", "2020-03-02")], "reference_date date")
    out = splits.temporal_split(df, train_end="2020-01-01", val_end="2020-02-01", test_end="2020-03-01")
    assert [r["split"] for r in out.orderBy("reference_date").collect()] == ["train", "val", "val", "test"]
    assert [f.count() for f in splits.split_frames(out)] == [1, 2, 1]


def test_prefixes_end_with_underscore(spark):
    df = spark.createDataFrame([("pilot_1_3",), ("pilot_15_1",)], "patch_id string")
    got = dict(rows(splits.spatial_split(df, ["pilot_1_"])))
    assert got == {"pilot_1_3": "test", "pilot_15_1": "train"}
    assert {r[1] for r in rows(splits.spatial_split(df, []))} == {"train"}


def test_date_range_prunes_years(spark, tmp_path):
    df = spark.createDataFrame([(day(f"{y}-06-01"), y) for y in (2019, 2020, 2021)], "reference_date date, reference_year int")
    df.write.partitionBy("reference_year").parquet(str(tmp_path / "p"))
    out = splits.date_range(spark.read.parquet(str(tmp_path / "p")), "2020-01-01", "2020-12-31")
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reference_year" in plan and "PushedFilters: [IsNotNull(reference_date)" in plan
    assert splits.date_range(df).count() == 3


def _grid_panel(spark):
    data = []
    for r in range(8):
        for c in range(4):
            for t in range(5):
                positive = int(r in (2, 3) and c in (1, 2) and t in (1, 3))
                data.append((f"pilot_{r}_{c}", day("2021-01-01") + dt.timedelta(7 * t), positive, int((r, c, t) == (3, 2, 3))))
    return spark.createDataFrame(data, "patch_id string, reference_date date, y_occ_30d int, y_sev_available int")


def test_band_scan(spark):
    options = dict(min_rows=20, min_positive=4, min_prevalence=0.05, max_band_width=3)
    scan = holdout.scan_bands(_grid_panel(spark), **options).orderBy("rank").collect()
    assert len(scan) == 8 + 7 + 6
    best = scan[0]
    assert best["meets_criteria"] and ("pilot_2_" in best["prefixes"] or "pilot_3_" in best["prefixes"])
    assert all(r["n_rows"] == 20 * r["width"] and r["n_patches"] == 4 * r["width"] for r in scan)
    narrow = holdout.best_band(_grid_panel(spark), min_rows=20, min_positive=4, min_prevalence=0.05, max_band_width=2).first()
    assert "pilot_7_" not in narrow["prefixes"]
    assert narrow["prefixes"] == "pilot_2_ pilot_3_" and narrow["n_positive"] == 8 and narrow["n_severity_available"] == 1


def test_band_scan_by_hand(spark):
    got = holdout.scan_bands(_grid_panel(spark), min_rows=20, min_positive=4, max_band_width=1).filter("row_start = 3").first()
    expected = 3 * 1.0 + 1.0 + 1 / 20 + 1.0 - abs(20 / 160 - 0.25)
    assert got["score"] == pytest.approx(expected) and got["prevalence"] == 0.2


def test_band_scan_refuses_two_areas(spark):
    two = _grid_panel(spark).union(_grid_panel(spark).withColumn("patch_id", F.lit("other_1_1")))
    with pytest.raises(Exception, match="one grid prefix"):
        holdout.scan_bands(two).collect()
    with pytest.raises(ValueError, match="target"):
        holdout.scan_bands(two, "nope")


def test_bands_use_present_rows_as_neighbours(spark):
    panel = _grid_panel(spark).filter("patch_id not like 'pilot_4%'")
    bands = holdout.scan_bands(panel, max_band_width=2).filter("width = 2").select("row_start", "row_end")
    assert (3, 5) in rows(bands)


def test_auto_prefixes_and_fallback(spark):
    panel = _grid_panel(spark)
    assert {r["prefix"] for r in splits.auto_holdout_prefixes(panel).collect()} == {"pilot_6_", "pilot_7_"}
    ends = dict(train_end="2021-01-10", val_end="2021-01-17", test_end="2021-12-31")
    found = holdout.auto_holdout(panel, **ends, min_rows=8, min_positive=2)
    assert found == ["pilot_2_", "pilot_3_"]
    empty_test = dict(train_end="2021-12-01", val_end="2021-12-02", test_end="2021-12-31")
    assert holdout.auto_holdout(panel, **empty_test) == ["pilot_6_", "pilot_7_"]
    assert splits.auto_holdout_prefixes(panel.withColumn("patch_id", F.lit("x"))).count() == 0


def test_severity_gate(spark):
    df = spark.createDataFrame(
        [("train", 1, 0), ("train", 1, 2), ("train", 0, None), ("val", 0, None), ("test", 1, 1)],
        "split string, y_sev_available int, y_sev_cls int",
    )
    got = {r["split"]: (r["n_rows"], r["n_severity"], r["n_classes"], r["verdict"]) for r in splits.severity_gate(df).collect()}
    assert got == {"train": (3, 2, 2, "ok"), "val": (1, 0, 0, "skip"), "test": (1, 1, 1, "warn")}
    with pytest.raises(ValueError, match="val"):
        splits.enforce_severity_rows(df)


def test_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    assert rows(splits.class_weights(df, "y")) == [(1, 3, 3.0)]
    assert rows(splits.class_weights(df.filter("y = 0"), "y")) == [(0, 3, 1.0)]
    assert set(rows(splits.with_balanced_weight(df, "y"))) == {(1, 2.0), (0, 4 / 6)}
