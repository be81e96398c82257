import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from panelforge.functions.missing import nulls_for_nans, safe_float, safe_ratio
from panelforge.operators import checks, keys, lookups
from panelforge.streaming.incremental import append_pending, pending_keys


def test_grid_ids_bounds_and_clipping(spark):
    grid = keys.patch_grid(spark, (0.0, 0.0, 1.0, 0.6), grid_km=55.5, prefix="a")
    got = rows(grid.select("patch_id", "min_lon", "min_lat", "max_lon", "max_lat"), "patch_id")
    assert got == [
        ("a_0_0", 0.0, 0.0, 0.5, 0.5),
        ("a_0_1", 0.5, 0.0, 1.0, 0.5),
        ("a_1_0", 0.0, 0.5, 0.5, 0.6),
        ("a_1_1", 0.5, 0.5, 1.0, 0.6),
    ]


def test_preset_grid_size(spark):
    assert keys.grid_shape(keys.PRESET_BOUNDS, 5)[:2] == (389, 1044)
    assert keys.patch_grid(spark).count() == 389 * 1044


def test_reference_dates(spark):
    got = [r[0] for r in keys.reference_dates(spark, "2020-01-01", "2020-01-15", "7D").collect()]
    assert got == [day("2020-01-01"), day("2020-01-08"), day("2020-01-15")]
    assert keys.step_days("2W") == 14


def test_spine_has_each_patch_and_date_once(spark):
    spine = keys.panel_spine(keys.patch_grid(spark, (0.0, 0.0, 1.0, 1.0), grid_km=55.5), "2020-01-01", "2020-02-01", "7D")
    assert spine.count() == 4 * 5
    assert checks.duplicate_keys(spine).isEmpty()


def test_windows(spark):
    one = spark.createDataFrame([(day("2020-08-01"),)], "d date")
    a, b = keys.lookback_window(F.col("d"), 60)
    c, d = keys.future_window(F.col("d"), 30)
    assert rows(one.select(a, b, c, d)) == [(day("2020-06-02"), day("2020-08-01"), day("2020-08-02"), day("2020-08-31"))]


def test_grid_ids(spark):
    df = spark.createDataFrame([("pilot_12_4",), ("central_kalimantan_3_10",), ("bad-id",)], "patch_id string")
    got = {r[0]: r[1:] for r in rows(keys.grid_coordinates(df))}
    assert got == {
        "pilot_12_4": ("pilot", 12, 4),
        "central_kalimantan_3_10": ("central_kalimantan", 3, 10),
        "bad-id": (None, None, None),
    }
    assert rows(keys.bad_grid_ids(df)) == [("bad-id",)]
    with pytest.raises(Exception, match="bad-id"):
        keys.grid_coordinates(df, strict=True).collect()


def test_finish_keys(spark):
    df = spark.createDataFrame([(day("2021-05-01"), day("2021-05-01"))], "reference_date date, feature_max_timestamp date")
    out = keys.finish_keys(df)
    assert dict(out.dtypes) == {"reference_date": "date", "feature_max_timestamp": "timestamp", "reference_year": "int"}
    assert out.first()["reference_year"] == 2021


def test_missing_rules(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (2.0, "3.5"), (None, "NaN")], "v double, s string")
    got = [r[0] for r in nulls_for_nans(df).orderBy("s").select("v").collect()]
    assert got == [2.0, None, None]
    assert [r[0] for r in df.orderBy("s").select(safe_float(F.col("s"))).collect()] == [3.5, None, None]
    assert spark.range(1).select(safe_ratio(F.lit(1.0), F.lit(0.0))).first()[0] is None


def test_duplicates_raise(spark):
    df = spark.createDataFrame([("a", day("2021-01-01"))] * 2, "patch_id string, reference_date date")
    assert rows(checks.duplicate_keys(df)) == [("a", day("2021-01-01"), 1)]
    with pytest.raises(checks.ContractError, match="1 duplicate"):
        checks.enforce_unique(df)


def test_leakage_raises(spark):
    df = spark.createDataFrame(
        [("a", day("2021-01-01"), day("2021-01-02")), ("b", day("2021-01-01"), day("2021-01-01"))],
        "patch_id string, reference_date date, feature_max_timestamp date",
    )
    assert [r["patch_id"] for r in checks.leakage_violations(df).collect()] == ["a"]
    with pytest.raises(checks.ContractError):
        checks.enforce_no_leakage(df)


def test_required_columns(spark):
    assert len(checks.REQUIRED_COLUMNS) == 11
    with pytest.raises(checks.ContractError, match="y_sev_cls"):
        checks.ensure_required_columns(spark.range(1))


def test_severity_mask_and_label_order(spark):
    df = spark.createDataFrame(
        [(0, 0.5, None), (0, None, None), (1, 0.5, 2), (0, None, 1)], "y_sev_available int, y_sev_reg double, y_sev_cls int"
    )
    assert checks.severity_mask_violations(df).count() == 2
    with pytest.raises(checks.ContractError):
        checks.enforce_severity_mask(df)
    with pytest.raises(checks.ContractError):
        checks.severity_mask_violations(spark.range(1))
    order = spark.createDataFrame(
        [(day("2020-01-01"), day("2020-01-01")), (day("2020-01-01"), day("2020-01-02"))],
        "reference_date date, label_window_start date",
    )
    assert checks.label_order_violations(order).count() == 1
    with pytest.raises(checks.ContractError):
        checks.enforce_label_order(order)


def test_dataset_summary(spark):
    df = spark.createDataFrame(
        [("p1", day("2020-08-01"), 0), ("p2", day("2020-08-15"), 1)], "patch_id string, reference_date date, y_occ_30d int"
    )
    assert rows(checks.dataset_summary(df)) == [(2, 2, day("2020-08-01"), day("2020-08-15"), 0.5)]
    empty = checks.dataset_summary(df.filter("false")).first()
    assert tuple(empty) == (0, 0, None, None, None)


def test_missing_rates_count_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 1), (None, 2), (2.0, 3)], "a double, b int")
    assert rows(checks.missing_rates(df)) == [("a", 0.5), ("b", 0.25)]
    assert rows(checks.top_missing(df, 1)) == [("a", 0.5)]


def test_merge_sources_later_wins(spark):
    spine = spark.createDataFrame([("a", 1), ("b", 1)], "patch_id string, reference_date int")
    one = spark.createDataFrame([("a", 1, 10.0)], "patch_id string, reference_date int, x double")
    two = spark.createDataFrame([("b", 1, 20.0, 5)], "patch_id string, reference_date int, x double, y int")
    assert rows(lookups.merge_sources(spine, [one, two])) == [("a", 1, None, None), ("b", 1, 20.0, 5)]


def test_points_to_patches(spark):
    points = spark.createDataFrame([(0.1, 0.1), (0.5, 0.49), (0.99, 0.7), (1.0, 0.2), (-0.1, 0.2)], "lon double, lat double")
    got = [r["patch_id"] for r in lookups.assign_patch(points, (0.0, 0.0, 1.0, 1.0), grid_km=55.5, prefix="a").collect()]
    assert got == ["a_0_0", "a_0_1", "a_1_1", None, None]
    grid = keys.patch_grid(spark, (0.0, 0.0, 1.0, 1.0), grid_km=55.5, prefix="a")
    placed = lookups.assign_rectangles(points, grid, cell=0.3)
    assert sorted(r["patch_id"] for r in placed.collect()) == ["a_0_0", "a_0_1", "a_1_1"]


def test_incremental_append(spark, tmp_path):
    path = str(tmp_path / "panel")
    first = spark.createDataFrame([("a", day("2020-01-01"))], "patch_id string, reference_date date")
    both = first.union(spark.createDataFrame([("b", day("2021-01-01"))], first.schema))

    def build(spine):
        return spine.withColumn("reference_year", F.year("reference_date"))

    append_pending(first, build, path)
    assert rows(pending_keys(both, spark.read.parquet(path))) == [("b", day("2021-01-01"))]
    append_pending(both, build, path)
    append_pending(both, build, path)
    assert spark.read.parquet(path).count() == 2
