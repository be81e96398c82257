"""Temporal and spatial splits, and the gates on what a split holds."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import feature_columns

SPLITS = ("train", "val", "test")


def temporal_split(df: DataFrame, *, train_end: str, val_end: str, test_end: str) -> DataFrame:
    """Add ``split`` (train / val / test by reference date); later rows are dropped."""
    day = F.col("reference_date").cast("date")

    def upto(end: str) -> Column:
        return day <= F.lit(end).cast("date")

    split = F.when(upto(train_end), "train").when(upto(val_end), "val").when(upto(test_end), "test")
    return df.filter(upto(test_end)).withColumn("split", split)


def split_frames(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, val, test = (df.filter(F.col("split") == s) for s in SPLITS)
    return train, val, test


def has_prefix(prefixes: Sequence[str], column: str = "patch_id") -> Column:
    """True when the id starts with one of the prefixes; none given means false.

    Keep the closing ``_`` in a prefix: ``a_1_`` must not match ``a_15_1``.
    """
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(column).startswith(p)
    return hit


def spatial_split(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Add ``spatial_split``: ``test`` for held-out prefixes, else ``train``."""
    return df.withColumn("spatial_split", F.when(has_prefix(prefixes), "test").otherwise("train"))


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive date filter; also bounds ``reference_year``, so its partitions are pruned."""
    day = F.col("reference_date")
    with_year = "reference_year" in df.columns
    if start is not None:
        df = df.filter(day >= F.lit(start).cast("date"))
        df = df.filter(F.col("reference_year") >= int(start[:4])) if with_year else df
    if end is not None:
        df = df.filter(day <= F.lit(end).cast("date"))
        df = df.filter(F.col("reference_year") <= int(end[:4])) if with_year else df
    return df


def severity_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("y_sev_available") == 1)


def severity_gate(df: DataFrame, target: str = "y_sev_cls") -> DataFrame:
    """Per split: rows, severity rows, distinct classes, and the verdict.

    ``skip`` without severity rows (or, in train, with fewer than two classes),
    ``warn`` when test has fewer than two classes, else ``ok``.
    """
    per_class = df.groupBy("split", F.when(F.col("y_sev_available") == 1, F.col(target)).alias("_cls")).agg(
        F.count("*").alias("n"), F.count_if(F.col("y_sev_available") == 1).alias("n_sev")
    )
    out = per_class.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.sum("n_sev").alias("n_severity"), F.count("_cls").alias("n_classes")
    )
    verdict = (
        F.when((F.col("n_severity") == 0) & (F.col("split") != "test"), "skip")
        .when((F.col("n_classes") < 2) & (F.col("split") == "train"), "skip")
        .when((F.col("n_classes") < 2) & (F.col("split") == "test"), "warn")
        .otherwise("ok")
    )
    return out.withColumn("verdict", verdict)


def enforce_severity_rows(df: DataFrame) -> None:
    """Raise when a split has no severity rows."""
    found = {r["split"]: r["n_severity"] for r in severity_gate(df).collect()}
    empty = [s for s in SPLITS if not found.get(s)]
    if empty:
        raise ValueError(f"no severity rows in split(s): {empty}")


def class_weights(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Negatives, positives and their ratio (1.0 without positives)."""
    out = df.groupBy(*by).agg(
        F.count_if(F.col(target) == 1).alias("n_pos"),
        (F.count("*") - F.count_if(F.col(target) == 1)).alias("n_neg"),
    )
    return out.withColumn("pos_weight", F.coalesce(F.try_divide("n_neg", "n_pos"), F.lit(1.0)))


def with_balanced_weight(df: DataFrame, target: str, *, out: str = "weight") -> DataFrame:
    """Weight rows by n / (classes x rows of the class); class counts are one small aggregate."""
    counts = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for label, count in counts.items():
        weight = F.when(F.col(target) == label, F.lit(n / (len(counts) * count))).otherwise(weight)
    return df.withColumn(out, weight)


def split_diagnostics(df: DataFrame, target: str = "y_occ_30d") -> DataFrame:
    """Per split: rows, positive rate, mean missing rate over the features."""
    features = feature_columns(df)
    missing = [F.avg(F.col(c).isNull().cast("double")) for c in features]
    total = F.lit(0.0)
    for m in missing:
        total = total + m
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.lit(len(features)).alias("n_features"),
        F.avg(F.col(target).cast("double")).alias("positive_rate"),
        (total / F.lit(max(len(features), 1))).alias("feature_nan_rate"),
    )


NAIVE_ROW_ID = r"^[^_]+_(\d+)_\d+$"


def auto_holdout_prefixes(df: DataFrame, *, fraction: float = 0.25) -> DataFrame:
    """Prefixes of the highest ``max(1, int(n * fraction))`` grid rows: ``(prefix, grid_row)``.

    Only ids whose area prefix has no ``_`` count. The window runs over distinct
    grid rows, of which a grid has at most its height divided by its step.
    """
    pid = F.col("patch_id")
    rows = (
        df.filter(pid.rlike(NAIVE_ROW_ID))
        .select(
            F.regexp_extract(pid, NAIVE_ROW_ID, 1).try_cast("int").alias("grid_row"),
            F.regexp_extract(pid, r"^([^_]+)_", 1).alias("area"),
        )
        .groupBy("grid_row")
        .agg(F.max("area").alias("area"))
    )
    every = Window.partitionBy(F.lit(0))
    ranked = rows.select(
        "grid_row",
        F.max("area").over(every).alias("area"),
        F.row_number().over(every.orderBy(F.col("grid_row").desc())).alias("rn"),
        F.count("*").over(every).alias("n"),
    )
    keep = F.greatest(F.lit(1), F.floor(F.col("n") * fraction))
    return ranked.filter(F.col("rn") <= keep).select(
        F.concat_ws("_", "area", "grid_row", F.lit("")).alias("prefix"), "grid_row"
    )
