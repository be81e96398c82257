"""Training runs: occurrence, severity class, severity regression.

The panel comes in with a ``split`` column. It is kept in memory or on disk while a
run passes over it; a lost executor only costs the recomputation of its part.
"""

from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
import json
from typing import Any

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.checks import class_distribution
from ..operators.features import feature_columns
from ..operators.keys import KEYS
from ..operators.splits import (
    class_weights,
    enforce_severity_rows,
    severity_rows,
    split_diagnostics,
    with_balanced_weight,
)
from .boosting import LOGISTIC, SOFTMAX, SQUARED, boost
from .isotonic import Calibrator, apply_calibrator, fit_calibrator
from .transformers import INDICATOR, MedianImputer, QuantileNormalizer, Winsorizer

LOGREG, FOREST, BOOSTED = "logreg", "random_forest", "boosted"

# Parameter defaults by model.
DEFAULTS: dict[str, dict[str, Any]] = {
    LOGREG: {"C": 1.0, "max_iter": 2000},
    FOREST: {"n_estimators": 200, "max_depth": 20, "min_samples_leaf": 1},
    BOOSTED: {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "subsample": 1.0, "early_stopping_rounds": 20},
}

TREE_MEMORY_MB = 1024  # of statistics of the nodes a forest splits at once


def _preparation(name: str, features: list[str], prefix: str) -> list:
    """Stages from raw features to one vector. Trees get medians (boosted ones also
    missing flags); the linear model gets clipped, normalised columns."""
    filled = [f"{prefix}fill_{c}" for c in features]
    stages: list = [MedianImputer(inputCols=features, outputCols=filled, indicators=name == BOOSTED)]
    inputs = filled
    if name == LOGREG:
        clipped, normal = [f"{prefix}clip_{c}" for c in features], [f"{prefix}norm_{c}" for c in features]
        stages += [
            Winsorizer(inputCols=filled, outputCols=clipped),
            QuantileNormalizer(inputCols=clipped, outputCols=normal),
        ]
        inputs = normal
    if name == BOOSTED:
        inputs = filled + [c + INDICATOR for c in features]
    return stages + [VectorAssembler(inputCols=inputs, outputCol=f"{prefix}features")]


def _shared(prefix: str, target: str) -> dict[str, str]:
    return {"featuresCol": f"{prefix}features", "labelCol": target, "predictionCol": f"{prefix}prediction"}


def _settings(name: str, params: Mapping[str, Any]) -> dict[str, Any]:
    """Defaults with the caller's values; what no learner here would use is an error."""
    unknown = sorted(set(params) - set(DEFAULTS[name]))
    if unknown:
        raise ValueError(f"unknown parameters of {name}: {unknown}")
    p = DEFAULTS[name] | dict(params)
    if p.get("max_depth", 0) > 30:
        raise ValueError("trees are at most 30 levels deep")
    return p


def _settled(report: DataFrame) -> DataFrame:
    """A report (one row per model) computed now, while its input is still kept."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def _classifier(name: str, prefix: str, target: str, params: Mapping[str, Any], seed: int, n_train: int):
    p = _settings(name, params)
    common = _shared(prefix, target) | {"weightCol": "weight"}
    if name == LOGREG:
        # the penalty is on the weighted mean loss here, not on its sum
        learner = LogisticRegression(
            **common, maxIter=p["max_iter"], regParam=1.0 / (p["C"] * n_train), standardization=False
        )
    else:
        learner = RandomForestClassifier(
            **common,
            numTrees=p["n_estimators"],
            maxDepth=p["max_depth"],
            minInstancesPerNode=p["min_samples_leaf"],
            maxMemoryInMB=TREE_MEMORY_MB,
            seed=seed,
        )
    return learner.setRawPredictionCol(f"{prefix}raw").setProbabilityCol(f"{prefix}probability")


@contextmanager
def _kept(df: DataFrame):
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


@dataclass
class Fit:
    """A trained model and what scoring needs besides it."""

    task: str
    model: PipelineModel
    features: list[str]
    prefix: str
    calibrator: Calibrator | None = None
    threshold: float = 0.5
    predictions: DataFrame | None = field(default=None, repr=False)
    report: DataFrame | None = field(default=None, repr=False)
    class_counts: DataFrame | None = field(default=None, repr=False)
    rounds: int | None = None

    def save(self, path: str) -> None:
        """Spark ML writers for models; features and threshold as one JSON row."""
        self.model.write().overwrite().save(f"{path}/model")
        if self.calibrator is not None:
            self.calibrator.blocks.write.mode("overwrite").parquet(f"{path}/calibrator")
        about = {
            "task": self.task,
            "features": self.features,
            "prefix": self.prefix,
            "threshold": self.threshold,
            "calibrated": self.calibrator is not None,
        }
        self._session().createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def _session() -> SparkSession:
        return SparkSession.active()

    @classmethod
    def load(cls, path: str) -> "Fit":
        about = json.loads(cls._session().read.text(f"{path}/about").first()["value"])
        calibrated = about.pop("calibrated")
        return cls(
            model=PipelineModel.load(f"{path}/model"),
            calibrator=Calibrator.of(cls._session().read.parquet(f"{path}/calibrator")) if calibrated else None,
            **about,
        )


def positive_probability(df: DataFrame, prefix: str) -> DataFrame:
    both = F.col(f"{prefix}probability")
    return df.withColumn("y_prob", (both if dict(df.dtypes)[f"{prefix}probability"].startswith("array") else vector_to_array(both))[1])


def fit_occurrence(
    panel: DataFrame,
    model_name: str = LOGREG,
    params: Mapping[str, Any] | None = None,
    *,
    target: str = "y_occ_30d",
    seed: int = 42,
) -> Fit:
    """Train, calibrate and tune on train/val, predict and report on test.

    The calibrator and the decision threshold (best F1 on calibrated scores) come
    from the validation split only.
    """
    features = feature_columns(panel)
    prefix = "occ_"
    narrow = panel.select(*KEYS, "split", target, *features).withColumn("is_val", F.col("split") == "val")
    with _kept(narrow) as data:
        train = data.filter("split = 'train'")
        n_train = train.count()
        weighted = _weighted(data, train, model_name, target)
        stages = _preparation(model_name, features, prefix)
        prepared = Pipeline(stages=stages).fit(train)
        ready = prepared.transform(weighted)
        if model_name == BOOSTED:
            p = _settings(BOOSTED, params or {})
            made = boost(ready, features=f"{prefix}features", label=target, loss=LOGISTIC, params=p, weight="weight", seed=seed)
            fitted = made.stages(f"{prefix}features", prefix)
        else:
            fitted = [_classifier(model_name, prefix, target, params or {}, seed, n_train).fit(ready)]
        model = PipelineModel([*prepared.stages, *fitted])

        scored = positive_probability(model.transform(data.filter("split <> 'train'")), prefix).select(
            *KEYS, "split", F.col(target).cast("int").alias("y_true"), "y_prob"
        )
        diagnostics = {r["split"]: r for r in split_diagnostics(data, target).collect()}
        with _kept(scored) as scored:
            val = scored.filter("split = 'val'")
            calibrator = fit_calibrator(val)
            best = metrics.best_f1_threshold(
                apply_calibrator(calibrator, val).select(*KEYS, "y_true", "y_prob", "y_prob_calibrated")
            )
            tuned = best.filter("score = 'calibrated'").first()
            threshold, val_f1 = (tuned["best_threshold"], tuned["best_f1"]) if tuned else (0.5, 0.0)
            predictions = apply_calibrator(calibrator, scored.filter("split = 'test'")).select(
                *KEYS,
                "y_true",
                "y_prob",
                "y_prob_calibrated",
                (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"),
                F.lit(float(threshold)).alias("occurrence_decision_threshold"),
                (F.col("y_prob_calibrated") >= threshold).cast("int").alias("y_pred_calibrated_tuned"),
            )
            report = _settled(metrics.evaluate_occurrence(metrics.with_model(predictions, model_name)))

    def about(split: str, figure: str):
        row = diagnostics.get(split)
        return F.lit(row[figure] if row else None)

    report = report.select(
        "model",
        *("f1", "roc_auc", "pr_auc", "ece_raw", "ece_calibrated", "f1_calibrated", "roc_auc_calibrated"),
        F.lit(float(threshold)).alias("optimal_threshold"),
        F.lit(float(val_f1)).alias("optimal_val_f1"),
        F.col("f1_calibrated_deployment").alias("f1_at_optimal_threshold"),
        F.lit(len(features)).alias("n_features"),
        *[about(s, "n_rows").cast("long").alias(f"n_{s}") for s in ("train", "val", "test")],
        about("train", "positive_rate").cast("double").alias("train_positive_rate"),
        about("test", "positive_rate").cast("double").alias("test_positive_rate"),
        about("train", "feature_nan_rate").cast("double").alias("train_nan_rate"),
    )
    rounds = len(made.rounds) if model_name == BOOSTED else None
    return Fit("occurrence", model, features, prefix, calibrator, float(threshold), predictions, report, rounds=rounds)


def _weighted(data: DataFrame, train: DataFrame, model_name: str, target: str) -> DataFrame:
    """Training rows with class weights: balanced for linear and forest models, positives
    times n_neg / n_pos for boosting, which also gets the validation rows, marked."""
    if model_name != BOOSTED:
        return with_balanced_weight(train, target)
    ratio = class_weights(train, target).first()["pos_weight"]
    rows = data.filter("split in ('train', 'val')")
    return rows.withColumn("weight", F.when(F.col(target) == 1, F.lit(float(ratio))).otherwise(1.0))


def _severity_data(panel: DataFrame, target: str, features: list[str]) -> DataFrame:
    enforce_severity_rows(panel)
    rows = severity_rows(panel).select(*KEYS, "split", F.col(target).cast("double").alias(target), *features)
    return rows.withColumn("is_val", F.col("split") == "val").withColumn("weight", F.lit(1.0))


def _predicted(model: Model, data: DataFrame, prefix: str, target: str, kind: str, *more: Column) -> DataFrame:
    return model.transform(data.filter("split = 'test'")).select(
        *KEYS, F.col(target).cast(kind).alias("y_true"), F.col(f"{prefix}prediction").cast(kind).alias("y_pred"), *more
    )


def _with_sizes(report: DataFrame, sizes: Mapping[str, int], n_features: int) -> DataFrame:
    return report.select(
        "*",
        *[F.lit(sizes.get(s, 0)).cast("long").alias(f"n_{s}") for s in ("train", "val", "test")],
        F.lit(n_features).alias("n_features"),
    )


def _fit_severity(
    panel: DataFrame, target: str, prefix: str, loss: str, params: Mapping[str, Any] | None, seed: int, finish, model_name: str = BOOSTED
) -> Fit:
    """A model on severity-available rows. Boosted trees are stopped early on the validation split. ``finish`` gives
    predictions, report and class counts from the model and the kept rows."""
    features = feature_columns(panel)
    p = _settings(model_name, params or {})
    with _kept(_severity_data(panel, target, features)) as data:
        train = data.filter("split = 'train'")
        prepared = Pipeline(stages=_preparation(model_name, features, prefix)).fit(train)
        if model_name == BOOSTED:
            rows = prepared.transform(data.filter("split in ('train', 'val')"))
            classes = int(rows.agg(F.max(target)).first()[0]) + 1 if loss == SOFTMAX else 1
            made = boost(rows, features=f"{prefix}features", label=target, loss=loss, params=p, classes=classes, seed=seed)
            last = made.stages(f"{prefix}features", prefix)
        else:
            last = [_classifier(model_name, prefix, target, params or {}, seed, train.count()).fit(prepared.transform(train))]
        model = PipelineModel([*prepared.stages, *last])
        sizes = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
        fit = finish(model, data)
    fit.features, fit.rounds = features, len(made.rounds) if model_name == BOOSTED else None
    fit.report = _with_sizes(fit.report, sizes, len(features))
    return fit


def fit_severity_cls(
    panel: DataFrame,
    params: Mapping[str, Any] | None = None,
    *,
    model_name: str = BOOSTED,
    target: str = "y_sev_cls",
    seed: int = 42,
) -> Fit:
    """Classes on severity-available rows: boosted with shared softmax gradients, the validation split's loss deciding
    the number of rounds, or a linear or forest model. Predictions carry ``y_probs``, one probability per class."""
    prefix, name = "cls_", f"{model_name}_severity_cls"

    def finish(model: PipelineModel, data: DataFrame) -> Fit:
        probability = F.col(f"{prefix}probability")
        shares = (probability if model_name == BOOSTED else vector_to_array(probability)).alias("y_probs")
        predictions = _predicted(model, data, prefix, target, "int", shares)
        report = _settled(metrics.severity_cls_summary(metrics.with_model(predictions, name)))
        counts = class_distribution(data, target, by=["split"])
        return Fit("severity_cls", model, [], prefix, predictions=predictions, report=report, class_counts=counts)

    return _fit_severity(panel, target, prefix, SOFTMAX, params, seed, finish, model_name)


def fit_severity_reg(
    panel: DataFrame, params: Mapping[str, Any] | None = None, *, target: str = "y_sev_reg", seed: int = 42
) -> Fit:
    """Boosted regression on severity-available rows, stopped early on the validation split."""
    prefix, name = "reg_", "boosted_severity_reg"

    def finish(model: PipelineModel, data: DataFrame) -> Fit:
        predictions = _predicted(model, data, prefix, target, "double")
        report = _settled(metrics.evaluate_severity_reg(metrics.with_model(predictions, name)))
        return Fit("severity_reg", model, [], prefix, predictions=predictions, report=report)

    return _fit_severity(panel, target, prefix, SQUARED, params, seed, finish)
