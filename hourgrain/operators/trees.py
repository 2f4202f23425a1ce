"""Tree ensembles and wide logistic models by pyspark.ml: one distributed fit per model.

Boosted trees here are Spark's, so their predictions are not those of other boosting libraries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

# Model settings.
BOOSTED_REGRESSION = {"maxIter": 160, "stepSize": 0.03, "minInstancesPerNode": 40, "maxDepth": 4, "seed": 20261002}
BOOSTED_CLASSIFICATION = {"maxIter": 300, "stepSize": 0.03, "minInstancesPerNode": 20, "maxDepth": 4, "seed": 270927}
FOREST = {"numTrees": 300, "minInstancesPerNode": 10, "featureSubsetStrategy": "sqrt", "maxDepth": 10, "seed": 270927}
PATIENCE = 25


def with_vector(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("__x", array_to_vector(F.col(features)))


def boosted_regression(train: DataFrame, score: DataFrame, features: str, y: str, out: str = "p", **settings) -> DataFrame:
    model = GBTRegressor(featuresCol="__x", labelCol=y, predictionCol=out, **{**BOOSTED_REGRESSION, **settings}).fit(with_vector(train, features))
    return model.transform(with_vector(score, features)).drop("__x")


def best_iteration(losses: Sequence[float], patience: int = PATIENCE) -> int:
    """Number of rounds kept when training stops after ``patience`` rounds without improvement."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def boosted_classification(train: DataFrame, validation: DataFrame, score: DataFrame, features: str, label: str, out: str = "p",
                           refit: DataFrame | None = None, patience: int = PATIENCE, **settings) -> tuple[DataFrame, int]:
    """Boosting stopped on a chronological validation part.

    The validation loss of every round comes from one pass. The kept rounds are refitted, on the
    training rows (same seed, so the same first rounds) or on ``refit`` rows when given.
    """
    s = {**BOOSTED_CLASSIFICATION, **settings}
    t = with_vector(train, features).withColumn(label, F.col(label).cast("double"))
    v = with_vector(validation, features).withColumn(label, F.col(label).cast("double"))
    first = GBTClassifier(featuresCol="__x", labelCol=label, **s).fit(t)
    best = best_iteration(first.evaluateEachIteration(v), patience)
    rows = t if refit is None else with_vector(refit, features).withColumn(label, F.col(label).cast("double"))
    final = first if best == s["maxIter"] and refit is None else GBTClassifier(featuresCol="__x", labelCol=label, **{**s, "maxIter": best}).fit(rows)
    return _probability(final, with_vector(score, features), out), best


def forest_classification(train: DataFrame, score: DataFrame, features: str, label: str, out: str = "p", **settings) -> DataFrame:
    t = with_vector(train, features).withColumn(label, F.col(label).cast("double"))
    model = RandomForestClassifier(featuresCol="__x", labelCol=label, **{**FOREST, **settings}).fit(t)
    return _probability(model, with_vector(score, features), out)


def wide_logistic(train: DataFrame, score: DataFrame, features: str, label: str, out: str = "p", c: float = 1.0) -> DataFrame:
    """One logistic model with many features (already scaled): penalty 1/(C*n) on the mean loss. NULL without training rows."""
    t = with_vector(train, features).withColumn(label, F.col(label).cast("double"))
    n = t.count()
    if n == 0:
        return score.withColumn(out, F.lit(None).cast("double"))
    model = LogisticRegression(featuresCol="__x", labelCol=label, regParam=1.0 / (c * n), standardization=False, tol=1e-10, maxIter=500).fit(t)
    return _probability(model, with_vector(score, features), out)


def _probability(model, rows: DataFrame, out: str) -> DataFrame:
    p = model.transform(rows)
    return p.withColumn(out, vector_to_array("probability")[1]).drop("__x", "probability", "rawPrediction", "prediction")
