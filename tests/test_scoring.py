import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from touchflow.functions.scalars import action_label
from touchflow.operators import recommend as rec
from touchflow.operators import scoring

MODEL = scoring.LinearModel((0.0, 1.0, -1.0), ((1.0, 0.0), (0.0, 0.5), (2.0, 2.0)))


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [(1, "m", [0.0, 0.0]), (2, "m", [3.0, 0.0]), (3, "m", [800.0, 800.0]),
         (4, "absent", [1.0, 1.0]), (5, None, [1.0, 1.0])],
        "id long, model_name string, features array<double>")


def softmax(values):
    powers = [math.exp(v - max(values)) for v in values]
    return [p / sum(powers) for p in powers]


def test_linear_model(table):
    got = {r["id"]: r for r in scoring.score_linear(table, {"m": MODEL}).collect()}
    for number, x in ((1, (0, 0)), (2, (3, 0)), (3, (800, 800))):  # large scores stay finite
        scores = [b + w[0] * x[0] + w[1] * x[1]
                  for b, w in zip(MODEL.intercepts, MODEL.weights)]
        expected = softmax(scores)
        assert got[number]["probability"] == pytest.approx(expected)
        assert got[number]["prediction"] == expected.index(max(expected))
        assert got[number]["confidence"] == pytest.approx(max(expected))
        assert got[number]["scored"] is True
    for number in (4, 5):
        assert got[number]["prediction"] is None and got[number]["probability"] is None
        assert not got[number]["scored"]


def test_first_class_wins_ties(table):
    flat = scoring.LinearModel((1.0, 1.0), ((0.0, 0.0), (0.0, 0.0)))
    row = scoring.score_linear(table, {"m": flat}).filter("id = 1").first()
    assert (row["prediction"], row["confidence"]) == (0, 0.5)


def test_models_must_agree_on_classes(table):
    other = scoring.LinearModel((0.0,), ((0.0, 0.0),))
    with pytest.raises(ValueError):
        scoring.score_linear(table, {"m": MODEL, "n": other})


@pytest.fixture(scope="module")
def fitted(spark):
    data = spark.createDataFrame(
        [(float(i % 2), [float(i % 2) * 4 + i * 0.01, 1.0]) for i in range(60)],
        "label double, features array<double>").withColumn("input",
                                                           array_to_vector("features"))
    common = {"featuresCol": "input", "labelCol": "label"}
    models = {"with": LogisticRegression(**common), "without": LinearSVC(**common)}
    return data, {n: Pipeline(stages=[m]).fit(data) for n, m in models.items()}


def test_pipelines_are_routed_in_one_pass(fitted):
    data, models = fitted
    names = F.array(F.lit("with"), F.lit("without"), F.lit("absent"))
    table = data.withColumn("id", F.monotonically_increasing_id()).withColumn(
        "model_name", F.get(names, (F.hash("features") % 3 + 3).cast("int") % 3))
    scored = scoring.score_pipelines(table, models, n_classes=2)
    assert scored.columns == [*table.columns, "prediction", "probability", "confidence",
                              "scored"]
    rows = scored.collect()
    assert len(rows) == 60
    for row in rows:
        if row["model_name"] == "absent":
            assert row["prediction"] is None and row["scored"] is False
            continue
        assert row["prediction"] == int(row["label"])
        assert sum(row["probability"]) == pytest.approx(1.0)
        if row["model_name"] == "without":  # one-hot, as the model has no probabilities
            assert row["confidence"] == 1.0
            assert row["probability"][row["prediction"]] == 1.0


def test_foreign_model_scores_batches(table):
    def load():
        weights = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])

        def predict(inputs):
            scores = inputs @ weights.T
            powers = np.exp(scores - scores.max(axis=1, keepdims=True))
            return powers / powers.sum(axis=1, keepdims=True)

        return predict

    got = {r["id"]: r for r in scoring.score_batches(table, load, 2).collect()}
    assert got[2]["prediction"] == 0
    assert got[2]["probability"] == pytest.approx(softmax([3.0, 0.0, 1.5]))
    assert got[2]["scored"] and got[2]["confidence"] == max(got[2]["probability"])


def test_kinds_of_models_side_by_side_and_each_row_once(table):
    seen = []

    def remembered(rows):
        seen.append(sorted(r["id"] for r in rows.collect()))
        return scoring.score_linear(rows, {"m": MODEL})

    def load():
        return lambda inputs: np.tile([0.25, 0.75], (len(inputs), 1))

    got = {r["id"]: r for r in scoring.score_routed(table, {
        "m": remembered, "absent": lambda rows: scoring.score_batches(rows, load, 2)}).collect()}
    assert seen == [[1, 2, 3]] and sorted(got) == [1, 2, 3, 4, 5]
    assert got[4]["prediction"] == 1 and got[4]["confidence"] == 0.75
    assert got[5]["prediction"] is None and got[5]["scored"] is False


def test_one_hot(spark):
    got = scoring.with_one_hot(spark.createDataFrame([(3,), (0,)], "prediction int"))
    assert [r["probability"] for r in got.collect()] == [
        [0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0]]


def test_action_labels(spark):
    codes = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (9,), (-1,), (None,)], "c int")
    assert [r[0] for r in codes.select(action_label(F.col("c"))).collect()] == [
        "no_action", "email_campaign", "push_notification", "discount_offer",
        "product_recommendation", "no_action", "no_action", "no_action"]


def test_routing(spark, rows):
    table = spark.createDataFrame([("c1", "A"), ("c2", "B"), ("c3", "?")],
                                  "customer_id string, ab_test_group string")
    routed = scoring.route_models(table, {"recommendation_model_v2": "7"})
    assert rows(routed, "customer_id", "model_name", "model_version") == [
        ("c1", "recommendation_model_v1", "unknown"), ("c2", "recommendation_model_v2", "7"),
        ("c3", None, None)]


def test_responses_and_fallback(spark, rows, at):
    scored = spark.createDataFrame(
        [("c1", "web", 3, 0.75, at("10:00:00"), "1", "A", True),
         ("c2", "web", None, None, at("10:00:00"), "2", "B", False),
         ("c3", "web", 9, 0.5, at("10:00:00"), "2", "B", True),
         ("c4", "web", None, None, at("10:00:00"), "1", "A", True)],
        "customer_id string, channel string, prediction int, confidence double, "
        "timestamp timestamp, model_version string, ab_test_group string, scored boolean")
    answered = rec.respond(scored)
    assert rows(answered.drop("timestamp")) == [
        ("c1", "discount_offer", "web", 0.75, "1", "A"),
        ("c2", "no_action", "unknown", 0.0, "error", "error"),
        ("c3", "no_action", "web", 0.5, "2", "B"),
        ("c4", "no_action", "unknown", 0.0, "error", "error")]
    logged = rec.experiment_log(answered)
    assert rows(logged, "customer_id", "test_name", "group", "outcome") == [
        ("c1", "model_version_test", "A", "discount_offer"),
        ("c3", "model_version_test", "B", "no_action")]
    assert logged.first()["metrics"] == {"confidence": 0.75}
    timed = rec.request_log(answered.withColumn("latency_ms", F.lit(12.5)))
    assert timed.columns[-1] == "latency_ms" and "channel" not in timed.columns


@pytest.mark.parametrize("limit", [1, 7, 1500])
def test_latest_results(spark, limit):
    log = spark.range(4000).select(
        F.col("id").cast("string").alias("customer_id"),
        F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("test_name"),
        F.timestamp_seconds((F.col("id") * 7919) % 4001).alias("timestamp")).repartition(9)
    everything = [tuple(r) for r in log.collect()]
    got = rec.latest_results(log, limit).collect()
    for test in ("small", "large"):
        newest = sorted((r for r in everything if r[1] == test),
                        key=lambda r: (r[2], r[0]), reverse=True)[:limit]
        assert sorted(tuple(r) for r in got if r[1] == test) == sorted(newest)
        one = [tuple(r) for r in rec.latest_results(log, limit, test).collect()]
        assert one == newest


@pytest.mark.parametrize("limit", [1000, 5000])
def test_the_newest_results_are_cut_before_the_shuffle(spark, limit):
    log = spark.range(20_000).selectExpr(
        "CAST(id AS string) AS customer_id", "'t' AS test_name",
        "timestamp_seconds(id) AS timestamp")
    got = rec.latest_results(log, limit)
    assert got.count() == limit
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "spark_partition_id" not in plan
    # the filter on the cut is below the ranking window
    assert plan.index("Window [row_number()") < plan.index("_from")


def test_results_without_a_time_come_last(spark):
    log = spark.createDataFrame([("a", "t", None), ("b", "t", 5), ("c", None, 6), ("d", "u", None)],
                                "customer_id string, test_name string, s long").selectExpr(
        "customer_id", "test_name", "timestamp_seconds(s) AS timestamp")
    assert sorted(r["customer_id"] for r in rec.latest_results(log, 1).collect()) == ["b", "c", "d"]
    assert rec.latest_results(log, 2).count() == 4
