"""Models for the registered scoring queries.

The two linear models stand for fitted ones with given coefficients, one row per action in the
order of ``ACTIONS`` and one weight per feature in the order of ``FEATURE_NAMES``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from touchflow.operators.scoring import LinearModel

VERSIONS = {"recommendation_model_v1": "1", "recommendation_model_v2": "2"}

LINEAR_MODELS = {
    "recommendation_model_v1": LinearModel(
        intercepts=(0.5, 0.25, 0.0, 0.125, 0.0),
        weights=(
            (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
            (0.03125, 0.0, -0.25, 0.25, 0.0, 0.0, 0.0, 0.0),
            (0.0, 0.125, 0.5, 0.0, 0.0625, 0.0, 0.0, 0.0),
            (0.0, 0.0, 0.0, 0.0, 0.125, 0.03125, 0.0, 0.0),
            (0.0, 0.0, 0.25, 0.0, 0.0, 0.0, 0.0001220703125, 0.03125),
        ),
    ),
    "recommendation_model_v2": LinearModel(
        intercepts=(0.25, 0.0, 0.5, 0.0, 0.125),
        weights=(
            (0.015625, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
            (0.0, 0.0625, 0.0, 0.125, 0.0, 0.03125, 0.0, 0.0),
            (-0.03125, 0.0, 0.75, 0.0, 0.0, 0.0, 0.0, 0.0),
            (0.0, 0.0, 0.0, 0.25, 0.0625, 0.0, 0.0, 0.015625),
            (0.0, 0.125, 0.0, 0.0, 0.0, 0.015625, 0.00006103515625, 0.0),
        ),
    ),
}


SMOOTHING = {"recommendation_model_v1": 1.0, "recommendation_model_v2": 2.0}


def fit_models(table: DataFrame, label: str) -> dict[str, PipelineModel]:
    """Two naive Bayes models on a ``features`` array, whose fit is a sum per class and feature."""
    training = table.select(array_to_vector("features").alias("input"),
                            F.col(label).cast("double").alias("label"))
    return {name: Pipeline(stages=[NaiveBayes(
        featuresCol="input", labelCol="label", smoothing=smoothing)]).fit(training)
        for name, smoothing in SMOOTHING.items()}


def load_foreign(name: str):
    """Loader of a predictor outside Spark: a linear model's coefficients in numpy."""
    model = LINEAR_MODELS[name]

    def load():
        import numpy as np

        weights, intercepts = np.array(model.weights), np.array(model.intercepts)

        def predict(inputs):
            scores = inputs @ weights.T + intercepts
            powers = np.exp(scores - scores.max(axis=1, keepdims=True))
            return powers / powers.sum(axis=1, keepdims=True)

        return predict

    return load
