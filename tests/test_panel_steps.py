"""The panel build in steps: what lies on disk together, and image counts from one row per date."""

import random
import time

from conftest import DATA, day
from panelforge.operators.windows import image_counts, image_spans
from panelforge.plans import ml_catalog
from panelforge.session import settled
from test_plans import plan

OBS = "patch_id string, image_id int, obs_date date"


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.splitlines() if "/shuffle_" in f}


def test_a_settled_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = settled(spark.range(1000).groupBy("id").count(), "test")
    for _ in range(50):  # they are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert df.count() == 1000


def test_panel_build_ends_in_joins_of_written_summaries(spark):
    text = plan(ml_catalog.QUERIES["panel_build"](spark, DATA))
    assert "lineitem" not in text and "orders.parquet" not in text and "MapInArrow" not in text


def test_a_dated_image_is_one_row(spark):
    seen = spark.createDataFrame([("p", k, day(f"2020-01-{k:02d}")) for k in range(1, 21)], OBS)
    part, _ = image_spans(seen, window=(-10, 0), out="n", last_seen="at")
    assert part.events.count() == 20


def test_image_counts_are_distinct(spark):
    rng = random.Random(3)
    seen = [(f"p{rng.randrange(2)}", rng.randrange(12), day(f"2020-0{rng.randrange(1, 4)}-{rng.randrange(1, 29):02d}")) for _ in range(150)]
    spine = [(f"p{p}", day(f"2020-0{m}-{d:02d}")) for p in range(3) for m in (1, 2, 3) for d in (1, 9, 17, 25)]
    df, keys = spark.createDataFrame(seen + seen[:20], OBS), spark.createDataFrame(spine, "patch_id string, reference_date date")
    for lookback, ends in ((0, 0), (1, 0), (30, 0), (20, 3), (20, -5)):
        got = image_counts(keys, df, lookback_days=lookback, out="n", ends=ends, last_seen="at").collect()
        assert len(got) == len(spine)
        for r in got:
            near = [(i, d) for p, i, d in seen if p == r["patch_id"] and -lookback <= (d - r["reference_date"]).days <= ends]
            assert r["n"] == float(len({i for i, _ in near}))
            assert r["at"] == max((d for _, d in near), default=None)
