"""Curve tables of prediction tables: the numbers behind diagnostic plots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import edges_at_or_below, uniform_edges
from .keys import KEYS
from .metrics import GROUP, bin_stats, ladder_metrics, score_ladder, unpivot_scores, with_model
from .ordered import running_sums, tie_digest

TRADEOFF_STEPS = 99
TRADEOFF_FIRST, TRADEOFF_LAST = 0.01, 0.99


def tradeoff_thresholds() -> list[float]:
    """99 evenly spaced doubles from 0.01 to 0.99, the last one exact."""
    step = (TRADEOFF_LAST - TRADEOFF_FIRST) / (TRADEOFF_STEPS - 1)
    return [TRADEOFF_FIRST + i * step for i in range(TRADEOFF_STEPS - 1)] + [TRADEOFF_LAST]


def _both_classes():
    return (F.col("n_pos") > 0) & (F.col("n_neg") > 0)


def roc_curve(df: DataFrame, *, drop_collinear: bool = True) -> DataFrame:
    """False/true positive rates per distinct score, from (0, 0) at threshold +infinity.

    ``drop_collinear`` leaves out rungs that continue the line of their neighbours:
    those whose next rung adds the same positives and negatives. The first and last
    rung always stay. Models with one class give no rows.
    """
    ladder = score_ladder(unpivot_scores(df), lead=True).filter(_both_classes())
    area = ladder_metrics(ladder).select(*GROUP, F.col("roc_auc").alias("metric"))
    if drop_collinear:
        is_first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        is_last = F.col("next_pos").isNull()
        bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        ladder = ladder.filter(is_first | is_last | bends)
    points = ladder.select(
        *GROUP,
        (F.col("fp") / F.col("n_neg")).alias("x"),
        (F.col("tp") / F.col("n_pos")).alias("y"),
        F.col("y_score").alias("threshold"),
    )
    start = area.select(*GROUP, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(float("inf")).alias("threshold"))
    return points.unionByName(start).join(area, GROUP).withColumn("curve", F.lit("roc"))


def pr_curve(df: DataFrame) -> DataFrame:
    """Recall/precision per distinct score, ending at (0, 1) with a NULL threshold."""
    ladder = score_ladder(unpivot_scores(df)).filter(_both_classes())
    area = ladder_metrics(ladder).select(*GROUP, F.col("pr_trapezoid").alias("metric"))
    points = ladder.select(
        *GROUP,
        (F.col("tp") / F.col("n_pos")).alias("x"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("y"),
        F.col("y_score").alias("threshold"),
    )
    end = area.select(*GROUP, F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end).join(area, GROUP).withColumn("curve", F.lit("precision_recall"))


def roc_pr_points(df: DataFrame) -> DataFrame:
    return roc_curve(df).unionByName(pr_curve(df))


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Non-empty bins with their edges, mean score, observed rate and count."""
    edges = F.array(*[F.lit(e) for e in uniform_edges(bins)])
    return (
        bin_stats(df, bins)
        .filter("bin is not null")
        .select(
            *GROUP,
            F.lit("calibration").alias("curve"),
            F.get(edges, F.col("bin")).alias("bin_left"),
            F.get(edges, F.col("bin") + 1).alias("bin_right"),
            "mean_prediction",
            "observed_frequency",
            "count",
        )
    )


def reliability_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """All bins; an empty one shows its centre, rate 0.0 and count 0."""
    stats = bin_stats(df, bins)
    edges = F.array(*[F.lit(e) for e in uniform_edges(bins)])
    every = stats.select(*GROUP).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    centre = (F.get(edges, F.col("bin")) + F.get(edges, F.col("bin") + 1)) / 2
    return every.join(stats, [*GROUP, "bin"], "left").select(
        *GROUP,
        "bin",
        F.coalesce("mean_prediction", centre).alias("bin_center"),
        F.coalesce("observed_frequency", F.lit(0.0)).alias("bin_rate"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def threshold_tradeoff(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and alerts at 99 thresholds.

    One pass: each score is placed between thresholds, counts are kept per place
    (at most 100 rows per model), and the alerts of a threshold are the counts
    from its place upwards.
    """
    thresholds = tradeoff_thresholds()
    place = edges_at_or_below(F.col("y_score"), thresholds)
    placed = (
        unpivot_scores(df)
        .groupBy(*GROUP, place.alias("place"))
        .agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    )
    # each place counts for thresholds 1..place; explode the (bounded) 100-row histogram
    totals = placed.groupBy(*GROUP).agg(
        F.sum("pos").alias("n_pos"),
        F.collect_list(F.struct("place", "pos", "neg")).alias("histogram"),
    )
    per = totals.withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(thresholds))))
    )

    def from_step(field: str):
        return F.aggregate(
            F.filter("histogram", lambda h: h["place"] >= F.col("step")),
            F.lit(0).cast("long"),
            lambda total, h: total + h[field],
        )

    counted = per.select(*GROUP, "step", "n_pos", from_step("pos").alias("tp"), from_step("neg").alias("fp"))
    tp, fp = F.col("tp"), F.col("fp")
    out = counted.select(
        *GROUP,
        F.get(F.array(*[F.lit(t) for t in thresholds]), F.col("step") - 1).alias("threshold"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("n_pos")), F.lit(0.0)).alias("recall"),
        (tp + fp).alias("alerts"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def cumulative_gain(df: DataFrame) -> DataFrame:
    """Per row in descending score order: share of rows reviewed and of positives caught.

    Ties go by a digest of the keys, which is as good as any order and lets one
    very common score be spread over tasks. Models without positives give no rows.
    """
    long = unpivot_scores(df).select(
        *GROUP,
        "y_score",
        tie_digest(KEYS).alias("digest"),
        F.lit(1).cast("long").alias("one"),
        (F.col("y_true") == 1).cast("long").alias("hit"),
    )
    ranked = running_sums(long, by=GROUP, value="y_score", sums=["one", "hit"], digest="digest")
    return ranked.filter("total_hit > 0").select(
        *GROUP,
        F.lit("cumulative_gain").alias("curve"),
        F.col("cum_one").alias("rank"),
        (F.col("cum_one") / F.col("total_one")).alias("fraction_reviewed"),
        (F.col("cum_hit") / F.col("total_hit")).alias("fire_capture_rate"),
    )


def residuals(df: DataFrame) -> DataFrame:
    df = with_model(df)
    t, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    return df.select("model", *[k for k in KEYS if k in df.columns], t.alias("y_true"), p.alias("y_pred"), (p - t).alias("residual"))


def dependence_table(df: DataFrame, feature: str, target: str) -> DataFrame:
    return df.select(F.col(feature).alias("feature_value"), F.col(target).alias("target_value"))


def dependence_bins(df: DataFrame, feature: str, target: str, bins: int = 20) -> DataFrame:
    """Mean target per equal-count bin of the feature; equal values share a bin."""
    pairs = dependence_table(df, feature, target).filter("feature_value is not null").select(
        F.col("feature_value").cast("double").alias("feature_value"), F.col("target_value").cast("double").alias("target_value")
    )
    counted = pairs.groupBy("feature_value").agg(
        F.count("*").alias("n"), F.sum("target_value").alias("target_sum"), F.count("target_value").alias("target_n")
    )
    ladder = running_sums(counted, by=[], value="feature_value", sums=["n"], descending=False, cuts_from=pairs)
    place = F.floor((F.col("cum_n") - F.col("n")) * bins / F.col("total_n")).cast("int")
    return ladder.groupBy(place.alias("bin")).agg(
        F.sum("n").alias("n"),
        F.min("feature_value").alias("feature_min"),
        F.max("feature_value").alias("feature_max"),
        F.try_divide(F.sum("target_sum"), F.sum("target_n")).alias("target_mean"),
    )
