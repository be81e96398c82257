"""Scoring a panel, and what drives the scores."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import clip
from ..operators.keys import KEYS
from ..operators.metrics import expected_risk, with_alert
from .fit import Fit, positive_probability
from .isotonic import apply_calibrator

SAMPLE_ROWS = 500  # fixed value: rows that attributions are averaged over


def _check_features(df: DataFrame, fit: Fit) -> None:
    missing = [c for c in fit.features if c not in df.columns]
    if missing:
        raise ValueError(f"the panel lacks features the model was trained on: {missing[:8]}")


def score_panel(panel: DataFrame, occurrence: Fit, severity: Fit) -> DataFrame:
    """Fire probability, severity, alert and expected risk per row; no shuffle.

    Uses the features saved with the models, whatever else the panel carries. With a
    calibrator ``p_fire`` is calibrated and the raw score is kept as ``p_fire_raw``.
    """
    for fit in (occurrence, severity):
        _check_features(panel, fit)
    meta = [*KEYS, *[c for c in ("centroid_lat", "centroid_lon") if c in panel.columns]]
    scored = positive_probability(occurrence.model.transform(panel), occurrence.prefix)
    scored = severity.model.transform(scored.select(*panel.columns, "y_prob"))
    raw = []
    if occurrence.calibrator is not None:
        scored = apply_calibrator(occurrence.calibrator, scored)
        scored = scored.withColumnsRenamed({"y_prob": "p_fire_raw", "y_prob_calibrated": "p_fire"})
        raw = ["p_fire_raw"]
    else:
        scored = scored.withColumnRenamed("y_prob", "p_fire")
    harm = clip(F.col(f"{severity.prefix}prediction").cast("double"), low=0.0)
    out = scored.select(*meta, "p_fire", *raw, harm.alias("severity_conditional"))
    return with_alert(out, occurrence.threshold).withColumn(
        "expected_risk", expected_risk(F.col("p_fire"), F.col("severity_conditional"))
    )


def _weights(model: PipelineModel) -> list[float]:
    boosted = [s.featureImportances.toArray() for s in model.stages if isinstance(s, GBTRegressionModel)]
    if boosted:
        return [float(sum(p[i] for p in boosted) / len(boosted)) for i in range(len(boosted[0]))]
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        return [float(v) for v in last.featureImportances.toArray()]
    if hasattr(last, "coefficients"):
        return [abs(float(v)) for v in last.coefficients.toArray()]
    raise TypeError(f"{type(last).__name__} has neither importances nor coefficients")


def feature_importances(fit: Fit) -> DataFrame:
    """Tree importances or absolute coefficients by feature; a missing flag counts
    towards its feature."""
    weights = _weights(fit.model)
    n = len(fit.features)
    spark = Fit._session()
    rows = [(fit.features[i % n], w) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(
        F.sum("importance").alias("importance")
    )


def top_features(importances: DataFrame, n: int = 30) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


def capped_sample(df: DataFrame, n: int = SAMPLE_ROWS, *, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """At most n rows, the same for the same seed however the data is laid out.

    The sampling operator itself: rows are taken in the order of a digest of key and seed.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.withColumn("_digest", digest).orderBy("_digest").limit(n).drop("_digest")


def linear_attribution(df: DataFrame, fit: Fit, *, n: int | None = None, seed: int = 42) -> DataFrame:
    """Mean absolute share of each feature in a linear model's scores on all rows (or ``n`` of them):
    ``|coefficient x (value - mean)|`` in the space the model sees, averaged over rows and, for
    models of several classes, over their outputs."""
    last = fit.model.stages[-1]
    if hasattr(last, "coefficientMatrix"):
        outputs = last.coefficientMatrix.toArray().tolist()
    elif hasattr(last, "coefficients"):
        outputs = [last.coefficients.toArray().tolist()]
    else:
        raise TypeError(f"no linear attribution for {type(last).__name__}")
    _check_features(df, fit)
    prepared = PipelineModel(fit.model.stages[:-1]).transform(df if n is None else capped_sample(df, n, seed=seed))
    rows = prepared.select(vector_to_array(F.col(f"{fit.prefix}features")).alias("x"))
    sample = rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(len(fit.features))])
    means = sample.agg(*[F.avg(c).alias(c) for c in sample.columns]).first()

    def share(i: int):
        # |c x (v - m)| summed over outputs is |v - m| times the sum of |c|
        size = sum(abs(c[i]) for c in outputs) / len(outputs)
        return F.avg(F.lit(size) * F.abs(F.col(f"x{i}") - F.lit(means[f"x{i}"]))).alias(f"x{i}")

    shares = sample.agg(*[share(i) for i in range(len(fit.features))])
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"x{i}").alias("mean_abs_attribution")) for i, f in enumerate(fit.features)]
    )
    return shares.select(F.inline(pairs))
