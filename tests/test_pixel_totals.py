"""Pixels added up in the worker, and predictions written once."""

import datetime as dt
import math
import random
import statistics

from pyspark.sql import functions as F

from panelforge.operators import pixels

from conftest import day, rows


def _observed(spark, n=900):
    rng = random.Random(5)
    start = day("2020-01-01")
    data = [
        (f"p{rng.randrange(3)}", rng.randrange(4), start + dt.timedelta(rng.randrange(-400, 400)), rng.choice([None, rng.random()])) for _ in range(n)
    ]
    return data, spark.createDataFrame(data, "patch_id string, pixel_id int, obs_date date, v double")


def test_totals_are_medians_added_up_over_pixels(spark):
    data, obs = _observed(spark)
    anchors = [(f"p{i}", day("2020-01-01") + dt.timedelta(k)) for i in range(3) for k in range(-380, 380, 17)]
    got = pixels.pixel_totals(
        spark.createDataFrame(anchors, "patch_id string, reference_date date"), obs, ["v"], {"past": (-30, 0), "next": (1, 9)}, statistic=pixels.MEDIAN
    )
    got = got.groupBy("patch_id", "reference_date").agg(*[F.sum(c).alias(c) for c in ("past_v", "past_v_pixels", "next_v", "next_v_pixels")], F.max("seen"))
    found = {(r[0], r[1]): tuple(r)[2:] for r in got.collect()}
    for patch, at in anchors:
        want, seen = [], []
        for a, z in ((-30, 0), (1, 9)):
            within = [x for x in data if x[0] == patch and x[3] is not None and a <= (x[2] - at).days <= z]
            medians = [statistics.median(x[3] for x in within if x[1] == p) for p in {x[1] for x in within}]
            want += [sum(medians), len(medians)]
            seen += [x[2] for x in within]
        if not any(x[0] == patch and -30 <= (x[2] - at).days <= 9 for x in data):
            assert (patch, at) not in found
            continue
        have = found[patch, at]
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(have[:4], want)), (patch, at, have, want)
        assert have[4] == max(seen, default=None)


def test_pixels_come_back_as_one_row_per_anchor(spark):
    many = [("p", k, day("2020-01-05"), float(k)) for k in range(50)]
    obs = spark.createDataFrame(many, "patch_id string, pixel_id int, obs_date date, v double")
    anchors = spark.createDataFrame([("p", day("2020-01-10"))], "patch_id string, reference_date date")
    got = pixels.pixel_totals(anchors, obs, ["v"], {"past": (-30, 0)}, statistic=pixels.MEDIAN)
    assert rows(got.select("past_v", "past_v_pixels")) == [(1225.0, 50)]


def test_all_reports_read_predictions_once(spark, tmp_path):
    from panelforge.plans.evaluate import evaluate_all

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    made = spark.range(200).select(
        F.lit("occ").alias("model"), F.concat(F.lit("p"), F.col("id")).alias("patch_id"), F.lit("2020-01-01").cast("date").alias("reference_date"),
        (F.col("id") % 2).cast("double").alias("y_true"), (F.col("id") / 200).alias("y_prob"), (F.col("id") / 200).alias("y_prob_calibrated"),
        F.lit(0.5).alias("occurrence_decision_threshold"), (F.col("id") >= 100).cast("double").alias("y_pred"),
    )
    evaluate_all(made.mapInArrow(counted, made.schema)).collect()
    assert read.value == 200
