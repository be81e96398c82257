"""Resumed builds equal whole ones; errors that were silent are raised."""

import datetime as dt

import pytest
from conftest import day
from pyspark.sql import functions as F

from panelforge.ml import fit
from panelforge.operators import metrics
from panelforge.operators.features import rolling_stats
from panelforge.streaming import incremental
from panelforge.streaming.incremental import append_pending


def roll(df):
    return rolling_stats(df, ["optical_ndvi"], [3])


def test_resume_equals_rebuild(spark, tmp_path):
    rows = [(p, day(f"2020-01-0{d}"), float(d * d + k)) for k, p in enumerate("ab") for d in range(1, 7)]
    source = spark.createDataFrame(rows, "patch_id string, reference_date date, optical_ndvi double")

    def build(spine):
        return spine.join(source, ["patch_id", "reference_date"]).withColumn("reference_year", F.year("reference_date"))

    spine = source.select("patch_id", "reference_date")
    path = str(tmp_path / "panel")
    append_pending(spine.filter("reference_date <= '2020-01-03'"), build, path, roll=roll, history=2)
    append_pending(spine, build, path, roll=roll, history=2)
    whole = sorted(map(tuple, roll(build(spine)).select("patch_id", "reference_date", "temporal_optical_ndvi_rmean_3", "temporal_optical_ndvi_rstd_3").collect()))
    stored = spark.read.parquet(path).select("patch_id", "reference_date", "temporal_optical_ndvi_rmean_3", "temporal_optical_ndvi_rstd_3")
    assert sorted(map(tuple, stored.collect())) == whole


@pytest.mark.parametrize("first", ["reference_date >= '2020-12-29'", "patch_id = 'a'", "dayofyear(reference_date) % 3 = 0", "reference_date = '2021-01-03'"])
def test_resume_with_earlier_dates_equals_rebuild(spark, tmp_path, first):
    """Missing rows before, between and after stored ones, across a partition boundary, of some patches only."""
    dates = [day("2020-12-25") + dt.timedelta(d) for d in range(14)]
    rows = [(p, d, float(n * n + 7 * k)) for k, p in enumerate("abc") for n, d in enumerate(dates) if (n + k) % 5]
    source = spark.createDataFrame(rows, "patch_id string, reference_date date, optical_ndvi double")

    def build(spine):
        return spine.join(source, ["patch_id", "reference_date"]).withColumn("reference_year", F.year("reference_date"))

    def content(df):
        return sorted(map(tuple, df.select("patch_id", "reference_date", "reference_year", "temporal_optical_ndvi_rmean_3", "temporal_optical_ndvi_rstd_3").collect()))

    spine = source.select("patch_id", "reference_date")
    path = str(tmp_path / "panel")
    append_pending(spine.filter(first), build, path, roll=roll, history=2)
    assert spark.read.parquet(path).count() == spine.filter(first).count()
    append_pending(spine, build, path, roll=roll, history=2)
    whole = content(roll(build(spine)))
    assert content(spark.read.parquet(path)) == whole
    append_pending(spine, build, path, roll=roll, history=2)  # nothing is missing
    assert content(spark.read.parquet(path)) == whole


def test_resume_goes_on_after_a_stop_between_partitions(spark, tmp_path, monkeypatch):
    rows = [("a", day(d), float(n * n)) for n, d in enumerate(["2019-12-30", "2019-12-31", "2020-01-01", "2020-01-02", "2021-01-01"])]
    source = spark.createDataFrame(rows, "patch_id string, reference_date date, optical_ndvi double")

    def build(spine):
        return spine.join(source, ["patch_id", "reference_date"]).withColumn("reference_year", F.year("reference_date"))

    spine, path = source.select("patch_id", "reference_date"), str(tmp_path / "panel")
    append_pending(spine.filter("reference_date not in ('2019-12-30', '2020-01-01')"), build, path, roll=roll, history=2)
    write, calls = incremental.validate_and_write, []

    def stops(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        write(*args, **kwargs)

    monkeypatch.setattr(incremental, "validate_and_write", stops)
    with pytest.raises(RuntimeError, match="lost"):
        append_pending(spine, build, path, roll=roll, history=2)
    monkeypatch.undo()
    append_pending(spine, build, path, roll=roll, history=2)
    keep = ["reference_date", "temporal_optical_ndvi_rmean_3"]
    assert sorted(map(tuple, spark.read.parquet(path).select(*keep).collect())) == sorted(map(tuple, roll(build(spine)).select(*keep).collect()))


def test_damaged_folder_is_an_error(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_bytes(b"no parquet")
    spine = spark.createDataFrame([("a", day("2020-01-01"))], "patch_id string, reference_date date")
    with pytest.raises(Exception):
        append_pending(spine, lambda s: s.withColumn("reference_year", F.lit(2020)), str(tmp_path))


def test_unlisted_class_is_an_error(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 3, 3)], "model string, y_true int, y_pred int")
    with pytest.raises(Exception, match="outside the list"):
        metrics.severity_cls_summary(df).collect()
    assert metrics.severity_cls_summary(df, classes=(0, 3)).first()["class_3_support"] == 1


def test_nan_scores_are_missing(spark):
    df = spark.createDataFrame([("a", day("2020-01-01"), 1, 0.9), ("b", day("2020-01-01"), 0, float("nan"))], "patch_id string, reference_date date, y_true int, y_prob double")
    assert metrics.unpivot_scores(df).count() == 1


def test_unknown_parameters_are_errors():
    with pytest.raises(ValueError, match="nonsense"):
        fit._settings(fit.BOOSTED, {"nonsense": 1})
    with pytest.raises(ValueError, match="30"):
        fit._settings(fit.FOREST, {"max_depth": 31})
