import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from panelforge.operators import composites, labels, windows
from panelforge.plans.build_panel import build_panel

SPINE = "patch_id string, reference_date date"
FIRES = "patch_id string, obs_date date, fire_mask int"
OBS = "patch_id string, pixel_id int, image_id int, obs_date date, b8 double, b12 double"


def test_event_counts_by_window(spark):
    spine = spark.createDataFrame([("a", day("2020-08-01")), ("b", day("2020-08-01"))], SPINE)
    dates = ["2020-06-01", "2020-06-02", "2020-08-01", "2020-08-02", "2020-08-08", "2020-08-09", "2020-08-31", "2020-09-01", "2020-09-30", "2020-10-01"]
    fires = spark.createDataFrame([("a", day(d), 9) for d in dates] + [("a", day("2020-08-02"), 6)], FIRES)
    out = composites.past_future_event_counts(spine, fires, lookback_days=60, last_seen="seen")
    assert rows(out, "patch_id") == [
        ("a", day("2020-08-01"), 2.0, 2.0, 4.0, 6.0, day("2020-08-01")),
        ("b", day("2020-08-01"), 0.0, 0.0, 0.0, 0.0, None),
    ]


def test_image_counts_are_distinct_within_the_window(spark):
    spine = spark.createDataFrame([("a", day("2020-03-01")), ("a", day("2020-03-20")), ("b", day("2020-03-01"))], SPINE)
    obs = [("a", 1, day("2020-02-25")), ("a", 1, day("2020-02-28")), ("a", 2, day("2020-02-28")), ("a", 1, day("2020-03-12"))]
    made = spark.createDataFrame(obs, "patch_id string, image_id int, obs_date date")
    out = windows.image_counts(spine, made, lookback_days=10, out="n")
    assert [r["n"] for r in out.orderBy("patch_id", "reference_date").collect()] == [2.0, 1.0, 0.0]


def _random_observations(seed=5):
    rng = random.Random(seed)
    start = day("2020-01-01")
    return [
        (f"p{rng.randint(0, 2)}", rng.randint(0, 2), rng.randint(0, 20), start + dt.timedelta(rng.randint(0, 120)),
         float(rng.randint(0, 50)) if rng.random() > 0.1 else None, float(rng.randint(0, 50)))
        for _ in range(600)
    ]


@pytest.mark.parametrize("chunk_rows", [10_000, 1, 2, 7])
def test_median_composite_against_brute_force(spark, chunk_rows):
    data = _random_observations()
    refs = [day("2020-02-01"), day("2020-03-15"), day("2020-12-01")]
    spine = spark.createDataFrame([(f"p{p}", r) for p in range(4) for r in refs], SPINE)
    out = composites.median_composite(
        spine, spark.createDataFrame(data, OBS), ["b8", "b12"], lookback_days=30, chunk_rows=chunk_rows
    )
    got = {(r["patch_id"], r["reference_date"]): r for r in out.collect()}
    assert len(got) == 12
    for (p, r), row in got.items():
        inside = [o for o in data if o[0] == p and r - dt.timedelta(30) <= o[3] <= r]
        assert row["optical_s2_observation_count"] == float(len({o[2] for o in inside}))
        for band, at in (("b8", 4), ("b12", 5)):
            medians = []
            for px in {o[1] for o in inside}:
                values = [o[at] for o in inside if o[1] == px and o[at] is not None]
                if values:
                    medians.append(statistics.median(values))
            found = row[f"optical_{band}_mean_l30d"]
            assert found == (pytest.approx(sum(medians) / len(medians)) if medians else None)


def test_mean_composite_weighs_pixels_equally(spark):
    spine = spark.createDataFrame([("a", day("2020-01-10")), ("a", day("2021-01-10"))], SPINE)
    obs = [("a", 1, 1, day("2020-01-09"), 1.0), ("a", 1, 2, day("2020-01-10"), 3.0), ("a", 1, 2, day("2020-01-10"), 5.0), ("a", 2, 2, day("2020-01-10"), 10.0), ("a", 2, 3, day("2020-01-01"), 99.0), ("a", 3, 3, day("2020-01-08"), None)]
    made = spark.createDataFrame(obs, "patch_id string, pixel_id int, image_id int, obs_date date, t double")
    out = composites.mean_composite(spine, made, ["t"], lookback_days=3)
    assert rows(out, "reference_date") == [("a", day("2020-01-10"), 3.0, 6.5), ("a", day("2021-01-10"), 0.0, None)]


def test_clear_score_tolerates_absent_fields(spark):
    spine = spark.createDataFrame([("a", day("2020-01-10"))], SPINE)
    obs = spark.createDataFrame([("a", 1, 1, day("2020-01-09"), 0.4)], "patch_id string, pixel_id int, image_id int, obs_date date, cs double")
    row = composites.cloud_score(spine, obs, lookback_days=3).first()
    assert row["optical_cloudscore_cs_mean_l3d"] == 0.4 and row["optical_cloudscore_cs_cdf_mean_l3d"] is None


def test_burn_date_year_rule(spark):
    spine = spark.createDataFrame([("a", day("2020-12-01")), ("b", day("2020-06-01")), ("c", day("2020-06-01")), ("d", day("2020-06-01"))], SPINE)
    burns = [("a", day("2021-01-01"), 10), ("b", day("2020-08-30"), 200), ("b", day("2020-08-31"), 300), ("b", day("2020-06-01"), 301), ("c", day("2020-07-01"), 0)]
    out = composites.burn_date(spine, spark.createDataFrame(burns, "patch_id string, image_date date, burn_doy int"))
    got = {r["patch_id"]: r["burn_date"] for r in out.collect()}
    # across New Year the day lands in the year of the window start
    assert got == {"a": day("2020-01-10"), "b": day("2020-07-18"), "c": None, "d": None}


def test_pre_post(spark):
    burned = spark.createDataFrame([("a", day("2020-06-01"), day("2020-07-01")), ("b", day("2020-06-01"), None)], SPINE + ", burn_date date")
    obs = [("a", 1, 1, day("2020-06-30"), 3000.0, 1000.0), ("a", 1, 1, day("2020-07-01"), 9.0, 9.0), ("a", 1, 1, day("2020-07-31"), 1500.0, 2000.0), ("a", 1, 1, day("2020-10-30"), 7.0, 7.0)]
    out = composites.pre_post_composites(burned, spark.createDataFrame(obs, OBS))
    got = {r["patch_id"]: r for r in out.collect()}
    assert got["a"]["prefire_nbr"] == 0.5 and got["a"]["dnbr"] == pytest.approx(0.5 + 500 / 3500)
    assert got["b"]["dnbr"] is None and got["b"]["prefire_nir_mean"] is None


def test_occurrence_labels(spark):
    df = spark.createDataFrame(
        [(day("2020-08-01"), 0.0, 2.0, 3.0), (day("2020-08-01"), None, float("nan"), -1.0)],
        "reference_date date, viirs_future_fire_count_7d double, viirs_future_fire_count_30d double, viirs_future_fire_count_60d double",
    )
    out = labels.occurrence_labels(df).select("y_occ_7d", "y_occ_30d", "y_occ_60d", "label_window_start", "label_window_end")
    assert [tuple(r) for r in out.collect()] == [
        (0, 1, 1, day("2020-08-02"), day("2020-09-30")),
        (0, 0, 0, day("2020-08-02"), day("2020-09-30")),
    ]
    assert labels.occurrence_labels(df.select("reference_date")).first()["y_occ_60d"] == 0


def severity(spark, **context):
    names = ", ".join(f"{k} {'int' if k.startswith('y_') else 'double'}" for k in context)
    row = labels.severity_labels(spark.createDataFrame([tuple(context.values())], names)).first()
    return row["y_sev_available"], row["y_sev_reg"], row["y_sev_cls"]


@pytest.mark.parametrize(
    ("context", "expected"),
    [
        (dict(y_occ_30d=1, dnbr=0.15), (1, 0.15, 0)),
        (dict(y_occ_30d=1, dnbr=0.27), (1, 0.27, 0)),
        (dict(y_occ_30d=1, dnbr=0.35), (1, 0.35, 1)),
        (dict(y_occ_30d=1, dnbr=0.60), (1, 0.60, 2)),
        (dict(y_occ_30d=1, prefire_nbr=0.6, postfire_nbr=0.1), (1, 0.5, 2)),
        (dict(y_occ_60d=1, prefire_nir_mean=3000.0, prefire_swir2_mean=1000.0, postfire_nir_mean=1500.0, postfire_swir2_mean=2000.0), (1, 0.5 + 500 / 3500, 2)),
        (dict(y_occ_60d=1, prefire_nir_mean=0.0, prefire_swir2_mean=0.0, postfire_nir_mean=1500.0, postfire_swir2_mean=2000.0), (1, 500 / 3500, 0)),
        (dict(y_occ_30d=1, dnbr=0.10, prefire_nbr=0.6, postfire_nbr=0.1), (1, 0.10, 0)),
        (dict(y_occ_30d=1, dnbr=5.0), (1, 1.3, 2)),
        (dict(y_occ_30d=1, dnbr=-2.0), (1, -0.1, 0)),
        (dict(y_occ_30d=0, dnbr=0.5), (0, None, None)),
        (dict(y_occ_30d=1), (0, None, None)),
        (dict(y_occ_30d=1, prefire_nbr=float("nan"), postfire_nbr=0.1), (0, None, None)),
        (dict(y_occ_30d=None, y_occ_7d=1, dnbr=0.5), (1, 0.5, 2)),
        (dict(dnbr=0.5), (0, None, None)),
    ],
)
def test_severity_labels(spark, context, expected):
    got = severity(spark, **context)
    assert got[0] == expected[0] and got[2] == expected[2]
    assert got[1] == (pytest.approx(expected[1]) if expected[1] is not None else None)


def test_panel_build_keeps_the_contract(spark):
    from panelforge.operators import checks

    spine = spark.createDataFrame([(f"p{p}", day(r)) for p in range(3) for r in ("2020-02-01", "2020-03-01", "2020-04-01")], SPINE)
    obs = spark.createDataFrame(_random_observations(), OBS)
    fires = obs.select("patch_id", "obs_date", F.when(F.col("pixel_id") == 1, 8).otherwise(2).alias("fire_mask"))
    burns = fires.filter("fire_mask >= 7").select("patch_id", F.trunc("obs_date", "month").alias("image_date"), F.dayofyear("obs_date").alias("burn_doy"))
    panel = build_panel(
        spine, {"viirs_active_fire": fires, "sentinel2_sr": obs, "burn_severity": burns}, lookback_days=30, bands=["b8", "b12"]
    )
    assert panel.count() == 9
    checks.ensure_required_columns(panel)
    for enforce in (checks.enforce_unique, checks.enforce_no_leakage, checks.enforce_severity_mask, checks.enforce_label_order):
        enforce(panel)
    assert "temporal_optical_nbr_prefire_rmean_3" in panel.columns


def test_panel_build_has_both_weather_variables_by_default(spark):
    spine = spark.createDataFrame([("p", day("2020-02-01"))], SPINE)
    rows = [("p", k, k, day("2020-01-20"), 280.0 + k, 0.5 * k) for k in range(3)]
    weather = spark.createDataFrame(rows, "patch_id string, pixel_id long, image_id long, obs_date date, temperature_2m double, total_precipitation_sum double")
    got = build_panel(spine, {"era5_land_daily": weather}, lookback_days=30).first()
    assert (got["weather_temperature_2m_mean_l30d"], got["weather_total_precipitation_sum_mean_l30d"]) == (281.0, 0.5)


def test_known_period_changes_nothing(spark):
    dates = [day("2020-02-01"), day("2020-03-01"), day("2020-04-01")]
    spine = spark.createDataFrame([(f"p{p}", r) for p in range(3) for r in dates], SPINE)
    obs = spark.createDataFrame(_random_observations(), OBS)
    fires = obs.select("patch_id", "obs_date", F.lit(8).alias("fire_mask"))
    burns = fires.select("patch_id", F.trunc("obs_date", "month").alias("image_date"), F.dayofyear("obs_date").alias("burn_doy"))
    sources = {"viirs_active_fire": fires, "sentinel2_sr": obs, "burn_severity": burns}
    free, cut = (
        build_panel(spine, sources, lookback_days=30, bands=["b8", "b12"], period=p) for p in (None, ("2020-02-01", "2020-04-01"))
    )
    assert rows(free, "patch_id", "reference_date") == rows(cut, "patch_id", "reference_date")


def test_future_rows_do_not_change_past_features(spark):
    data = _random_observations()
    spine = spark.createDataFrame([("p0", day("2020-02-01")), ("p0", day("2020-02-15"))], SPINE)
    late = [(*o[:3], day("2020-02-16"), 1e6, 1e6) for o in data]

    def features(observations):
        panel = build_panel(spine, {"sentinel2_sr": spark.createDataFrame(observations, OBS)}, lookback_days=30, bands=["b8", "b12"])
        keep = [c for c in panel.columns if c.startswith(("optical_", "temporal_"))]
        return rows(panel.select("reference_date", *keep), "reference_date")

    assert features(data) == features(data + late)


def test_median_of_crowded_and_sparse_pixels_ignores_nan(spark):
    from panelforge.operators.composites import median_over_spans

    spine = spark.sql("SELECT 'p' AS patch_id, DATE'2020-01-10' AS reference_date")
    values = [1.0, 2.0, 3.0, float("nan")]
    seen = spark.createDataFrame([("p", 1, n, v) for n, v in enumerate(values)], "patch_id string, pixel_id int, n int, b4 double")
    seen = seen.selectExpr("patch_id", "pixel_id", "date_add(DATE'2020-01-05', n) AS obs_date", "b4")
    for chunk_rows in (10_000, 2):
        (row,) = median_over_spans(spine, seen, ["b4"], {"past": (-10, 0)}, chunk_rows=chunk_rows).collect()
        assert row["past_b4"] == 2.0


@pytest.mark.parametrize("source", [None, "viirs_active_fire", "sentinel2_sr", "sentinel2_cloud_probability", "cloud_score_plus", "era5_land_daily"])
def test_a_window_that_looks_ahead_is_found(spark, source):
    """Widening one source's look-back by a day past the reference date is a leak that the check reports."""
    from panelforge.operators import checks

    spine = spark.createDataFrame([("p", day("2020-02-01"))], SPINE)
    rows = [("p", 1, k, day(d), 0.5, 0.4, 0.3, 0.2, 0.1, 9) for k, d in enumerate(["2020-01-20", "2020-02-01", "2020-02-02"])]
    obs = spark.createDataFrame(rows, "patch_id string, pixel_id int, image_id int, obs_date date, b8 double, b12 double, probability double, cs double, t double, fire_mask int")
    sources = {
        "viirs_active_fire": obs.select("patch_id", "obs_date", "fire_mask"), "sentinel2_sr": obs.select("patch_id", "pixel_id", "image_id", "obs_date", "b8", "b12"),
        "sentinel2_cloud_probability": obs, "cloud_score_plus": obs, "era5_land_daily": obs,
    }
    panel = build_panel(spine, sources, lookback_days=30, bands=["b8", "b12"], weather=["t"], ends={source: 1} if source else None)
    if source is None:
        assert str(panel.first()["feature_max_timestamp"])[:10] == "2020-02-01"
        checks.enforce_no_leakage(panel)
    else:
        with pytest.raises(checks.ContractError, match="after the reference date"):
            checks.enforce_no_leakage(panel)
