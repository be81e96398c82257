"""Resumable panel builds: make only the keys that are not stored yet."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.keys import KEYS
from ..session import staged
from ..sources.panel_io import validate_and_write


def pending_keys(spine: DataFrame, existing: DataFrame | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spine rows whose key is not in the existing table."""
    if existing is None:
        return spine
    return spine.join(existing.select(*keys), list(keys), "left_anti")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table; None where there is no folder or no Parquet file in it. Other errors pass through."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    found = files.listFiles(where, True)
    while found.hasNext():
        if found.next().getPath().getName().endswith(".parquet"):
            return spark.read.parquet(path)
    return None


def extend_rolling(
    stored: DataFrame | None, fresh: DataFrame, roll: Callable[[DataFrame], DataFrame], history: int
) -> DataFrame:
    """``roll`` over fresh rows and all stored rows they change, whatever their dates; ``_changed`` marks the latter.

    A fresh row changes the stored rows of its patch from its date on; these come back recomputed. The last
    ``history`` stored rows before the first fresh date of a patch go in front and leave again, so a resumed panel
    equals one built at once. ``history`` is the longest window less one.
    """
    if stored is None:
        return roll(fresh).withColumn("_changed", F.lit(False))
    since = fresh.groupBy("patch_id").agg(F.min("reference_date").alias("_since"))
    mine = stored.select(*fresh.columns).join(since, "patch_id")
    later = F.col("reference_date") >= F.col("_since")
    newest_first = Window.partitionBy("patch_id").orderBy(F.col("reference_date").desc())
    before = mine.filter(~later).withColumn("_back", F.row_number().over(newest_first)).filter(F.col("_back") <= history)
    marked = [
        fresh.withColumn("_role", F.lit("fresh")),
        mine.filter(later).select(*fresh.columns, F.lit("changed").alias("_role")),
        before.select(*fresh.columns, F.lit("before").alias("_role")),
    ]
    rolled = roll(marked[0].unionByName(marked[1]).unionByName(marked[2])).filter("_role <> 'before'")
    return rolled.withColumn("_changed", F.col("_role") == "changed").drop("_role")


def append_pending(
    spine: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    path: str,
    partition_cols: Sequence[str] = ("reference_year",),
    *,
    roll: Callable[[DataFrame], DataFrame] | None = None,
    history: int = 0,
) -> None:
    """Build the missing rows and add them; running it again after a failure goes on
    from what was committed. An empty or absent folder means all rows are missing.

    ``build`` makes rows from their keys alone; features over a patch's earlier rows belong in ``roll``
    (see ``extend_rolling``). Missing rows may lie before stored ones: the partitions (values of ``partition_cols``, which
    must grow with the reference date) that hold a recomputed row are replaced, the latest first, so that a
    run that stops in between leaves its earliest missing rows missing and the next run recomputes what follows
    them. The table is written once beside the target and checked as a written panel is: unique keys, and no leakage
    where the column for it is there.
    """
    spark = spine.sparkSession
    existing = _stored(spark, path)
    rows = build(pending_keys(spine, existing))
    if roll is None:
        _write_checked(rows, path, partition_cols)
        return
    made = staged(extend_rolling(existing, rows, roll, history), "pending")
    fresh, changed = made.filter("not _changed").drop("_changed"), made.filter("_changed").drop("_changed")
    touched = changed.select(*partition_cols).distinct()
    parts = sorted((tuple(r) for r in touched.collect()), reverse=True)  # partition values, not rows
    for values in parts:
        here = F.lit(True)
        for c, v in zip(partition_cols, values):
            here = here & F.col(c).eqNullSafe(F.lit(v))
        kept = spark.read.parquet(path).filter(here).join(changed.select(*KEYS), list(KEYS), "left_anti")
        whole = kept.unionByName(changed.filter(here)).unionByName(fresh.filter(here))
        _write_checked(whole, path, partition_cols, mode="overwrite")
    alone = fresh.join(touched, list(partition_cols), "left_anti")
    _write_checked(alone, path, partition_cols)


def _write_checked(rows: DataFrame, path: str, partition_cols: Sequence[str], mode: str = "append") -> None:
    leakage = "feature_max_timestamp" in rows.columns
    validate_and_write(rows, path, partition_cols, required=False, leakage=leakage, mode=mode, partitions_only=mode == "overwrite")
