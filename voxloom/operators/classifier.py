"""Supervised classifier and conditioning features with Spark ML."""

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.operators.labels import canonical_route, class_weights
from voxloom.operators.metrics import classification_metrics


def one_hot(route: Column, vocabulary: Sequence[str]) -> Column:
    """Indicator array over a closed vocabulary plus ``unknown``."""
    return F.transform(
        F.array(*[F.lit(v) for v in [*vocabulary, "unknown"]]),
        lambda v: F.when(v == route, 1.0).otherwise(0.0),
    )


def conditioned_features(
    df: DataFrame, vector: str, routes: dict[str, Sequence[str]], routed: bool = False,
) -> DataFrame:
    """Vector plus one-hot routes (conditioning), or one vector slot per route (routing)."""
    blocks = []
    for name, vocabulary in routes.items():
        hot = one_hot(canonical_route(F.col(name), list(vocabulary)), list(vocabulary))
        blocks.append(
            F.flatten(F.transform(hot, lambda h: F.transform(F.col(vector), lambda x: x * h))) if routed else hot
        )
    return df.withColumn("features", array_to_vector(F.concat(F.col(vector), *blocks)))


def train_classifier(
    examples: DataFrame, features: str, label: str, classes: Sequence[int],
    regularisation: Sequence[float] = (0.0, 0.01, 0.1), max_iter: int = 30,
):
    """Class-weighted logistic regression; the candidate with the best validation UAR wins."""
    train = examples.where("split = 'train'")
    weights = class_weights(train, label, list(classes))
    # One row per class: the size is the vocabulary's.
    weighted = train.join(F.broadcast(weights), label).persist()
    validation = examples.where("split = 'validation'").persist()
    scaler = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True)
    try:
        best, best_uar, tried = None, -1.0, []
        for reg in regularisation:
            estimator = LogisticRegression(
                featuresCol="_scaled", labelCol=label, weightCol="weight", regParam=reg, maxIter=max_iter,
                predictionCol="prediction", family="multinomial",
            )
            model = Pipeline(stages=[scaler, estimator]).fit(weighted)
            uar = classification_metrics(model.transform(validation), label, "prediction", len(classes)).first()["uar"]
            tried.append((reg, float(uar)))
            if uar > best_uar:
                best, best_uar = model, uar
    finally:
        weighted.unpersist()
        validation.unpersist()
    return best, tried
