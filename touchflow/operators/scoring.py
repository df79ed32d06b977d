"""Scoring with fitted models.

Three kinds of model give the same columns: coefficients evaluated as column arithmetic, fitted
``pyspark.ml`` pipelines, and any Python predictor applied to Arrow batches on the executors.  The
columns are ``prediction``, ``probability``, ``confidence`` and ``scored``, which is false where no
model gave a prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain

from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from touchflow.functions.scalars import one_hot
from touchflow.schemas import ACTIONS

# Which model serves which group, and the name of the test.
TEST_NAME = "model_version_test"
SCORE_COLUMNS = {"prediction": "int", "probability": "array<double>", "confidence": "double",
                 "scored": "boolean"}
MODEL_BY_GROUP = {"A": "recommendation_model_v1", "B": "recommendation_model_v2"}


@dataclass(frozen=True)
class LinearModel:
    """Multinomial logistic regression: one intercept and one weight per feature and class."""
    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]

    def scores(self, features: str) -> Column:
        """Array with the score of each class.  One SQL text builds faster than its columns."""
        sums = (" + ".join([f"{intercept!r}D", *[f"{features}[{i}] * {weight!r}D"
                                                 for i, weight in enumerate(row)]])
                for intercept, row in zip(self.intercepts, self.weights))
        return F.expr(f"array({', '.join(sums)})")


def _lookup(pairs: Mapping[str, str], key: Column) -> Column:
    entries = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items())
    return F.try_element_at(F.create_map(*entries), key)


def route_models(requests: DataFrame, versions: Mapping[str, str],
                 group_col: str = "ab_test_group") -> DataFrame:
    """Adds ``model_name`` by group and ``model_version`` by model.

    The routing table has one row per group, so it is a literal in the plan and needs no join.  A
    model without a version shows ``unknown``.
    """
    version_by_group = {group: versions.get(name, "unknown")
                        for group, name in MODEL_BY_GROUP.items()}
    group = F.col(group_col)
    return (requests.withColumn("model_name", _lookup(MODEL_BY_GROUP, group))
            .withColumn("model_version", _lookup(version_by_group, group)))


def _first_largest(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def score_linear(table: DataFrame, models: Mapping[str, LinearModel],
                 features: str = "features") -> DataFrame:
    """Scores each row with the model in its ``model_name``; nulls if that is not loaded.

    One column per step, so each value is computed once.  The class comes from the scores and the
    confidence from their sum: where the probabilities are not asked for, they are not computed.
    """
    classes = {len(model.intercepts) for model in models.values()}
    if len(classes) != 1:
        raise ValueError("models must have the same number of classes")
    each = range(classes.pop())
    scores = F.lit(None).cast("array<double>")
    for name, model in models.items():
        scores = F.when(F.col("model_name") == name,
                        model.scores(features)).otherwise(scores)
    # Shifted by the largest score: exp stays in range and the ratios do not change.
    powers = [F.exp(F.col("_scores")[i] - F.col("_top")) for i in each]
    return (table.withColumn("_scores", scores)
            .withColumn("_top", F.array_max("_scores"))
            .withColumn("_total", reduce(lambda a, b: a + b, powers))
            .withColumns({
                "probability": F.when(F.col("_total").isNotNull(),
                                      F.array(*[power / F.col("_total") for power in powers])),
                "prediction": _first_largest(F.col("_scores")),
                "confidence": 1 / F.col("_total"),
                "scored": F.col("model_name").isin(*models) & F.col(features).isNotNull(),
            })
            .drop("_scores", "_top", "_total"))


def score_routed(table: DataFrame, scorers: Mapping[str, Callable[[DataFrame], DataFrame]]
                 ) -> DataFrame:
    """Scores each row once, with the function of its ``model_name``.

    Each function adds ``prediction``, ``probability``, ``confidence`` and ``scored`` to the rows
    routed to it; models of any kind go side by side.  Every model reads its own rows of the
    table, so that should be a stored one, best with the model's name among what is filtered at
    the scan.  Rows of a model that is not loaded keep nulls.
    """
    outputs = [F.lit(None).cast(kind).alias(name) for name, kind in SCORE_COLUMNS.items()
               if name != "scored"]
    name = F.col("model_name")
    unrouted = table.filter(name.isNull() | ~name.isin(*scorers)).select(
        "*", *outputs, F.lit(False).alias("scored"))
    branches = [scorer(table.filter(name == model)) for model, scorer in scorers.items()]
    columns = [*table.columns, *SCORE_COLUMNS]
    return reduce(DataFrame.unionByName, [b.select(*columns) for b in branches],
                  unrouted.select(*columns))


def with_pipeline(model: PipelineModel, n_classes: int = len(ACTIONS)
                  ) -> Callable[[DataFrame], DataFrame]:
    """Scorer of one fitted pipeline; without a ``probability`` output it gives a one-hot one."""
    def score(table: DataFrame) -> DataFrame:
        output = model.transform(table)
        predicted = F.col("prediction").cast("int")
        shares = (vector_to_array("probability") if "probability" in output.columns
                  else one_hot(predicted, n_classes))
        return (output.select(*table.columns, shares.alias("probability"),
                              predicted.alias("prediction"))
                .withColumn("confidence", F.array_max("probability"))
                .withColumn("scored", F.col("prediction").isNotNull()))
    return score


def score_pipelines(table: DataFrame, models: Mapping[str, PipelineModel],
                    n_classes: int = len(ACTIONS)) -> DataFrame:
    """Scores each row with the fitted pipeline in its ``model_name``, and with no other."""
    return score_routed(table, {name: with_pipeline(model, n_classes)
                                for name, model in models.items()})


def score_batches(table: DataFrame, load: Callable[[], Callable], n_features: int,
                  features: str = "features", batch_size: int = 4096) -> DataFrame:
    """Scores with a foreign model, for ``score_routed`` one that is routed to.

    ``load`` runs once per Python worker and returns a function from a float array
    (rows, features) to class probabilities (rows, classes).
    """
    predict = predict_batch_udf(load, return_type=ArrayType(DoubleType()),
                                batch_size=batch_size, input_tensor_shapes=[[n_features]])
    return (table.withColumn("probability", predict(F.col(features)))
            .withColumn("prediction", _first_largest(F.col("probability")))
            .withColumn("confidence", F.array_max("probability"))
            .withColumn("scored", F.col("prediction").isNotNull()))


def with_one_hot(table: DataFrame, n_classes: int = len(ACTIONS),
                 prediction: str = "prediction") -> DataFrame:
    """Probability column for models that only predict a class."""
    return table.withColumn("probability", one_hot(F.col(prediction), n_classes))


def feature_columns(names: Sequence[str], features: str = "features") -> list[Column]:
    """The entries of a feature array as named columns."""
    return [F.col(features)[i].alias(name) for i, name in enumerate(names)]
