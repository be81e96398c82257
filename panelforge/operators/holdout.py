"""Choosing a spatial holdout: contiguous bands of grid rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import grid_coordinates
from .splits import auto_holdout_prefixes, temporal_split

SCAN_DEFAULTS = dict(min_rows=100, min_positive=10, min_prevalence=0.01, min_band_width=1, target_fraction=0.25)


def candidate_score(
    n_rows: Column,
    n_positive: Column,
    prevalence: Column,
    n_severity: Column,
    total_rows: Column,
    *,
    min_rows: int,
    min_positive: int,
    target_fraction: float,
) -> Column:
    """Evaluability first (positives, rows, severity, prevalence), then closeness to the wanted size."""
    off_target = F.abs(F.coalesce(F.try_divide(n_rows, total_rows), F.lit(0.0)) - target_fraction)
    return (
        3.0 * F.least(n_positive / F.lit(max(min_positive, 1)), F.lit(3.0))
        + F.least(n_rows / F.lit(max(min_rows, 1)), F.lit(2.0))
        + F.least(n_severity / F.lit(20.0), F.lit(1.0))
        + F.least(prevalence / F.lit(0.10), F.lit(1.0))
        - off_target
    )


def grid_row_totals(df: DataFrame, target: str, severity_col: str = "y_sev_available") -> DataFrame:
    """Per grid row: rows, positives, patches, severity rows.

    Rows meet per patch first and per grid row after; both steps combine before
    their shuffle, so a grid row with a third of the data is no bottleneck.
    """
    severity = F.coalesce(F.col(severity_col).cast("int"), F.lit(0)) if severity_col in df.columns else F.lit(0)
    placed = grid_coordinates(df.withColumn("_sev", severity), strict=True)
    per_patch = placed.groupBy("grid_prefix", "grid_row", "patch_id").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce(F.col(target).cast("int"), F.lit(0))).alias("pos"),
        F.sum("_sev").alias("sev"),
    )
    return per_patch.groupBy("grid_prefix", "grid_row").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("sev").alias("sev"), F.count("*").alias("patches")
    )


def scan_bands(
    df: DataFrame,
    target: str = "y_occ_30d",
    *,
    min_rows: int = 100,
    min_positive: int = 10,
    min_prevalence: float = 0.01,
    min_band_width: int = 1,
    max_band_width: int | None = None,
    target_fraction: float = 0.25,
    severity_col: str = "y_sev_available",
) -> DataFrame:
    """Every contiguous band of present grid rows, ranked (``rank`` 1 is best).

    All measures add up over rows, so a band is the difference of two running
    sums: an equi join of each start with its ends replaces a scan per candidate.
    The running sums cover one row per grid row, a number fixed by the grid.
    More than one area prefix raises.
    """
    if target not in df.columns:
        raise ValueError(f"missing target column: {target}")
    measures = ["n", "pos", "sev", "patches"]
    every = Window.partitionBy(F.lit(0))
    by_row = every.orderBy("grid_row")
    upto = by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one_prefix = F.when(
        F.min("grid_prefix").over(every) == F.max("grid_prefix").over(every), F.col("grid_prefix")
    ).otherwise(F.raise_error(F.lit("expected one grid prefix")))
    rows = grid_row_totals(df, target, severity_col).select(
        one_prefix.alias("prefix"),
        "grid_row",
        F.row_number().over(by_row).alias("idx"),
        F.count("*").over(every).alias("n_grid_rows"),
        F.sum("n").over(every).alias("total_rows"),
        *[F.sum(m).over(upto).alias(f"cum_{m}") for m in measures],
        *[(F.sum(m).over(upto) - F.col(m)).alias(f"before_{m}") for m in measures],
        F.collect_list("grid_row").over(upto).alias("rows_upto"),
    )
    default_width = F.greatest(F.lit(1), F.floor(F.col("n_grid_rows") * target_fraction)).cast("int")
    wanted = F.lit(max_band_width) if max_band_width else default_width
    widest = F.greatest(F.least(wanted, F.col("n_grid_rows").cast("int")), F.lit(min_band_width))
    starts = rows.select(
        "prefix",
        F.col("idx").alias("start_idx"),
        F.col("grid_row").alias("row_start"),
        "total_rows",
        *[f"before_{m}" for m in measures],
        F.explode(F.sequence(F.lit(min_band_width), widest)).alias("width"),
    ).withColumn("idx", F.col("start_idx") + F.col("width") - 1)
    ends = rows.select("idx", F.col("grid_row").alias("row_end"), "rows_upto", *[f"cum_{m}" for m in measures])
    bands = starts.join(ends, "idx").select(
        "*", *[(F.col(f"cum_{m}") - F.col(f"before_{m}")).alias(f"band_{m}") for m in measures]
    )
    n, pos, sev = F.col("band_n"), F.col("band_pos"), F.col("band_sev")
    prevalence = F.coalesce(F.try_divide(pos, n), F.lit(0.0))
    band_rows = F.slice("rows_upto", F.col("start_idx"), F.col("width"))
    scored = bands.select(
        F.array_join(F.transform(band_rows, lambda r: F.concat_ws("_", "prefix", r, F.lit(""))), " ").alias("prefixes"),
        "width",
        "row_start",
        "row_end",
        n.alias("n_rows"),
        F.col("band_patches").alias("n_patches"),
        pos.alias("n_positive"),
        prevalence.alias("prevalence"),
        sev.alias("n_severity_available"),
        F.coalesce(F.try_divide(sev, n), F.lit(0.0)).alias("severity_available_rate"),
        ((n >= min_rows) & (pos >= min_positive) & (prevalence >= min_prevalence)).alias("meets_criteria"),
        candidate_score(
            n,
            pos,
            prevalence,
            sev,
            F.col("total_rows"),
            min_rows=min_rows,
            min_positive=min_positive,
            target_fraction=target_fraction,
        ).alias("score"),
    )
    best = [F.col(c).desc() for c in ("meets_criteria", "score", "n_positive", "n_rows")] + [
        F.col("width").asc(),
        F.col("row_start").asc(),
    ]
    return scored.withColumn("rank", F.row_number().over(every.orderBy(*best)))


def best_band(df: DataFrame, target: str = "y_occ_30d", **options) -> DataFrame:
    """The best candidate, or no row when there is none."""
    return scan_bands(df, target, **options).filter("rank = 1")


def auto_holdout(
    df: DataFrame,
    *,
    train_end: str,
    val_end: str,
    test_end: str,
    target: str = "y_occ_30d",
    fraction: float = 0.25,
    **options,
) -> list[str]:
    """Holdout prefixes from the best band of the test split, else the top grid rows."""
    test = temporal_split(df, train_end=train_end, val_end=val_end, test_end=test_end).filter("split = 'test'")
    found = best_band(test, target, target_fraction=fraction, **options).select("prefixes").first()
    if found:
        return found["prefixes"].split(" ")
    return [r["prefix"] for r in auto_holdout_prefixes(df, fraction=fraction).orderBy("grid_row").collect()]
