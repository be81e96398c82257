"""Panel, prediction, metric and curve tables at rest."""

from collections.abc import Mapping, Sequence
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import finite_or_null, nulls_for_nans
from ..operators.checks import ensure_required_columns, enforce_no_leakage, enforce_unique
from ..operators.keys import PATCH_COLUMNS


def read_panel(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Panel from a Parquet file or partitioned folder, NaN as NULL."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nulls_for_nans(reader.parquet(path))


def write_panel(
    df: DataFrame,
    path: str,
    partition_cols: Sequence[str] | None = None,
    mode: str = "overwrite",
    *,
    partitions_only: bool = False,
) -> None:
    """Parquet, partitioned on request. Rebalancing gives each partition folder few,
    even files: large ones are split, small ones merged, at run time. With ``partitions_only``
    overwriting replaces the partitions that ``df`` has rows of and leaves the others."""
    if not partition_cols:
        df.write.mode(mode).parquet(path)
        return
    missing = [c for c in partition_cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing partition columns: {missing}")
    writer = df.hint("rebalance", *partition_cols).write.mode(mode).partitionBy(*partition_cols)
    writer.option("partitionOverwriteMode", "dynamic" if partitions_only else "static").parquet(path)


def validate_and_write(
    df: DataFrame,
    path: str,
    partition_cols: Sequence[str] | None = ("reference_year",),
    *,
    unique: bool = True,
    leakage: bool = True,
    required: bool = True,
    mode: str = "overwrite",
    partitions_only: bool = False,
) -> None:
    """Check the contract, then write; a broken panel leaves ``path`` as it was.

    The panel is computed once, into a table beside the target, on the same file system. The checks
    read only their few columns of it, and losing executors on the way never means building it again.
    """
    if required:
        ensure_required_columns(df)
    spark = df.sparkSession
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    df.write.parquet(stage)
    try:
        staged = spark.read.parquet(stage)
        if unique:
            enforce_unique(staged)
        if leakage:
            enforce_no_leakage(staged)
        write_panel(staged, path, partition_cols, mode, partitions_only=partitions_only)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(stage)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """The five patch columns of a grid table; the scan reads no others."""
    return spark.read.parquet(path).select(*PATCH_COLUMNS)


def write_grid(grid: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, folder: str, experiment: str | None = None) -> DataFrame:
    """All ``<experiment>_<model>_predictions.parquet`` tables of a folder as one long table.

    Columns differ between tasks; absent ones are NULL. ``model`` comes from the file name.
    """
    stem = f"{experiment}_*" if experiment else "*"
    df = spark.read.option("mergeSchema", True).parquet(f"{folder}/{stem}_predictions.parquet")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_predictions\.parquet", 1)
    if experiment:
        prefix = f"{experiment}_"
        name = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)
    return nulls_for_nans(df.withColumn("model", name))


def finite_doubles(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            finite_or_null(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_metrics(df: DataFrame, path: str, *, format: str = "json", mode: str = "overwrite") -> None:
    """Metric rows (a few per model) as JSON or CSV; NaN and infinities become null."""
    clean = finite_doubles(df).coalesce(1)
    if format == "json":
        clean.write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        clean.write.mode(mode).option("header", True).csv(path)


def append_report(row: DataFrame, path: str) -> None:
    """Add report rows as a new part of a JSON report; earlier parts stay untouched."""
    row.coalesce(1).write.mode("error").option("ignoreNullFields", False).json(f"{path}/part={uuid.uuid4().hex}")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a report, types inferred over all at once; columns a part lacks are NULL."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part=*")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        raise FileNotFoundError(path)
    return spark.read.json(f"{path}/part=*")


def write_map_table(df: DataFrame, path: str) -> None:
    """Prediction table for maps, one folder per reference date."""
    write_panel(df, path, ["reference_date"])


def write_comparison(df: DataFrame, folder: str) -> None:
    write_metrics(df, f"{folder}/comparison_csv", format="csv")
    write_metrics(df, f"{folder}/comparison_json", format="json")


def write_curves(tables: Mapping[str, DataFrame], folder: str, prefix: str) -> None:
    """Each curve table as a CSV folder ``<prefix>_<name>``."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{folder}/{prefix}_{name}")
