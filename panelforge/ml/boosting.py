"""Gradient boosting over Spark's regression trees, stopped by rounds on validation rows.

Each round fits one tree per margin to Newton steps: the step is the weighted mean of -gradient / curvature with
the curvature as weight, which is what a regression tree's leaf holds. One margin serves probabilities and values, K
margins share the softmax of K classes. Margins are kept per row, so a round costs one pass of tree
fitting and one aggregate that also gives the validation loss. Rounds stop when that has not improved for
``early_stopping_rounds``, and the ensemble is cut to its best prefix.

The result is made of Spark's own models: a tree ensemble per margin, whose predictions an SQL stage turns
into probabilities or values. So it is saved, loaded and applied like any pipeline.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from math import log
from typing import Any
import uuid

from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

LOGISTIC, SOFTMAX, SQUARED = "logistic", "softmax", "squared"
CUT_ROUNDS = 10  # rounds between written tables that end the lineage of margins
LEAST_CURVATURE = 1e-6
MAX_BINS = 64
TASK_ROWS = 20_000  # rows a task has at least, where there are so many


@dataclass
class Boosted:
    """Trees by round and margin up to the best round, the starting margins, and the losses of every round."""

    loss: str
    rate: float
    start: list[float]
    rounds: list[list[DecisionTreeRegressionModel]]
    losses: list[float] = field(default_factory=list)
    stopped_after: int = 0

    def stages(self, features: str, prefix: str) -> list[Transformer]:
        """Pipeline stages that add ``<prefix>prediction`` and, for classes, the array ``<prefix>probability``."""
        margins = [f"{prefix}margin_{k}" for k in range(len(self.start))]
        ensembles = [_ensemble([r[k] for r in self.rounds], self.rate).setFeaturesCol(features).setPredictionCol(m) for k, m in enumerate(margins)]
        sums = [f"({m} + {b!r}D)" for m, b in zip(margins, self.start)]
        if self.loss == SQUARED:
            text = f"SELECT *, {sums[0]} AS {prefix}prediction FROM __THIS__"
        elif self.loss == LOGISTIC:
            p = f"1 / (1 + exp(-{sums[0]}))"
            text = f"SELECT *, array(1 - {p}, {p}) AS {prefix}probability, CAST({p} >= 0.5 AS DOUBLE) AS {prefix}prediction FROM __THIS__"
        else:
            top = f"greatest({', '.join(sums)})"
            powers = [f"exp({s} - {top})" for s in sums]
            shares = f"transform(array({', '.join(powers)}), x -> x / ({' + '.join(powers)}))"
            first = f"CAST(array_position(array({', '.join(sums)}), {top}) - 1 AS DOUBLE)"
            text = f"SELECT *, {shares} AS {prefix}probability, {first} AS {prefix}prediction FROM __THIS__"
        return [*ensembles, SQLTransformer(statement=text)]


def _ensemble(trees: list[DecisionTreeRegressionModel], rate: float) -> GBTRegressionModel:
    """Spark's own ensemble model over the given trees."""
    spark = SparkSession.active()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    models = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, t in enumerate(trees):
        models[i], weights[i] = t._java_obj, rate
    name = f"GBTRegressor_{uuid.uuid4().hex[:12]}"
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(name, models, weights, trees[0].numFeatures))


def _margin(k: int) -> Column:
    return F.col("_m")[k]


def _probabilities(loss: str, n: int) -> list[Column]:
    if loss == LOGISTIC:
        return [1 / (1 + F.exp(-_margin(0)))]
    top = F.array_max("_m")
    powers = [F.exp(_margin(k) - top) for k in range(n)]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def _steps(loss: str, n: int) -> list[tuple[Column, Column]]:
    """(target, curvature) of each margin's tree."""
    y = F.col("_y")
    if loss == SQUARED:
        return [(y - _margin(0), F.lit(1.0))]
    out = []
    for k, p in enumerate(_probabilities(loss, n)):
        hit = y if loss == LOGISTIC else (y == k).cast("double")
        h = F.greatest(p * (1 - p), F.lit(LEAST_CURVATURE))
        out.append(((hit - p) / h, h))
    return out


def _row_loss(loss: str, n: int) -> Column:
    y = F.col("_y")
    if loss == SQUARED:
        return (y - _margin(0)) * (y - _margin(0))
    if loss == LOGISTIC:  # log(1 + e^z) without overflow
        z = F.when(y == 1, -_margin(0)).otherwise(_margin(0))
        return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    top = F.array_max("_m")
    total = sum((F.exp(_margin(k) - top) for k in range(1, n)), F.exp(_margin(0) - top))
    return F.log(total) + top - F.element_at("_m", (y + 1).cast("int"))


def _start(train: DataFrame, loss: str, n: int) -> list[float]:
    w = F.col("_w")
    if loss == SQUARED:
        return [train.agg(F.sum(F.col("_y") * w) / F.sum(w)).first()[0]]
    shares = train.agg(*[F.sum(F.when(F.col("_y") == k, w).otherwise(0.0)) / F.sum(w) for k in range(n if n > 1 else 2)]).first()
    safe = [log(max(min(s, 1 - 1e-9), 1e-9)) for s in shares]
    return [safe[1] - safe[0]] if loss == LOGISTIC else safe


def boost(
    rows: DataFrame,
    *,
    features: str,
    label: str,
    loss: str,
    params: Mapping[str, Any],
    classes: int = 1,
    weight: str | None = None,
    is_val: str = "is_val",
    seed: int = 42,
) -> Boosted:
    """Boosted trees for ``label`` over the vector column ``features``.

    ``params``: n_estimators, learning_rate, max_depth, subsample, early_stopping_rounds. Rows marked by ``is_val``
    only decide when to stop, unweighted; without any, all rounds are kept. Labels of ``softmax`` are 0 to ``classes`` - 1.
    """
    n = classes if loss == SOFTMAX else 1
    rate, wait = float(params["learning_rate"]), int(params["early_stopping_rounds"])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = rows.select(F.col(features).alias("_x"), F.col(label).cast("double").alias("_y"), w.alias("_w"), F.coalesce(F.col(is_val), F.lit(False)).alias("_val"))
    start = _start(base.filter("not _val"), loss, n)
    # a round is many short jobs, so small data go to few tasks
    base = base.coalesce(max(1, min(base.rdd.getNumPartitions(), base.count() // TASK_ROWS)))
    state = base.withColumn("_m", F.array(*[F.lit(float(b)) for b in start])).persist()
    figures = [F.avg(F.when(F.col("_val"), _row_loss(loss, n))), F.count_if(~F.col("_val"))]
    figures += [F.sum(F.when(~F.col("_val"), F.col("_w") * h)) for _, h in _steps(loss, n)]
    found = state.agg(*figures).first()
    made, losses, best = [], [], 0
    try:
        for t in range(int(params["n_estimators"])):
            train = state.filter("not _val")
            if params["subsample"] < 1:
                train = train.sample(float(params["subsample"]), seed + t)
            trees = []
            for k, (target, h) in enumerate(_steps(loss, n)):
                least = min(0.49, 1.0 / found[2 + k]) if found[2 + k] else 0.0  # a child's curvature sums to 1 at least
                learner = DecisionTreeRegressor(
                    featuresCol="_x", labelCol="_t", weightCol="_h", predictionCol=f"_p{k}", maxDepth=int(params["max_depth"]),
                    maxBins=MAX_BINS, minWeightFractionPerNode=least, seed=seed + t,
                )
                trees.append(learner.fit(train.select("_x", target.alias("_t"), (F.col("_w") * h).alias("_h"))))
            made.append(trees)
            moved = state
            for tree in trees:
                moved = tree.transform(moved)
            moved = moved.select("_x", "_y", "_w", "_val", F.array(*[_margin(k) + F.lit(rate) * F.col(f"_p{k}") for k in range(n)]).alias("_m"))
            after = staged(moved, "margins").persist() if t % CUT_ROUNDS == CUT_ROUNDS - 1 else moved.persist()
            found = after.agg(*figures).first()
            state.unpersist()
            state = after
            losses.append(found[0])
            if found[0] is None:
                best = t
            elif found[0] < losses[best]:
                best = t
            elif t - best >= wait:
                break
    finally:
        state.unpersist()
    return Boosted(loss, rate, start, made[: best + 1], losses, len(made))
