import pytest
from pyspark.sql import functions as F

from touchflow.operators import journey


@pytest.fixture
def interactions(spark):
    return spark.createDataFrame([
        ("c1", "web", "2024-01-01 10:00:00", True), ("c1", "web", "2024-01-10 23:59:59", False),
        ("c1", "email", "2024-01-05 00:00:00", None), ("c2", "web", "2024-02-01 08:00:00", None),
        ("c9", "web", "2024-01-01 00:00:00", True), (None, "web", "2024-01-01 00:00:00", True),
    ], "customer_id string, channel string, ts string, converted boolean").withColumn(
        "interaction_ts", F.col("ts").cast("timestamp")).drop("ts")


@pytest.fixture
def customers(spark):
    return spark.createDataFrame(
        [("c1", None, "EUROPE", "b", 500.01), ("c2", 40, None, "b", 1000.01),
         ("c3", 50, "ASIA", None, None)],
        "customer_id string, age int, region string, brand_preference string, "
        "lifetime_value double")


def test_features(interactions, customers, rows):
    got = journey.journey_features(interactions, customers, "2024-02-01")
    assert rows(got, "customer_id", "age", "total_interactions", "channel_diversity",
                "recency_days", "interaction_frequency", "avg_conversion_rate",
                "has_interactions") == [
        ("c1", 0, 3, 2, 22, 0.3, 0.5, True),
        ("c2", 40, 1, 1, 0, 1.0, 0.0, True),
        ("c3", 50, 0, 0, 0, 0.0, 0.0, False)]
    untouched = got.filter("customer_id = 'c3'").first()
    assert untouched["last_interaction_date"] is None  # only numbers are filled
    assert untouched["brand_preference"] is None
    assert untouched["lifetime_value"] == 0.0


def test_any_label_or_the_known_channels(spark, interactions, rows):
    other = interactions.withColumn("channel", F.lit("fax"))
    free = journey.journey_by_customer(other, "2024-02-01", channels=None)
    assert {n for (n,) in rows(free, "channel_diversity")} == {1}
    with pytest.raises(Exception, match="unknown channel fax"):
        journey.journey_by_customer(other, "2024-02-01").collect()
    nameless = interactions.withColumn("channel", F.lit(None).cast("string"))
    assert {n for (n,) in rows(journey.journey_by_customer(nameless, "2024-02-01"),
                               "channel_diversity")} == {0}


def test_known_channels_count_like_a_distinct(interactions, rows):
    both = [rows(journey.journey_by_customer(interactions, "2024-02-01", channels))
            for channels in (journey.CHANNELS, None)]
    assert both[0] == both[1]


def test_a_journey_is_one_partial_aggregation(interactions):
    plan = journey.journey_by_customer(interactions, "2024-02-01")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_bit_or" in text


@pytest.mark.parametrize("value,expected", [
    (500.0, "Low"), (500.01, "Medium"), (1000.0, "Medium"), (1000.01, "High"), (None, "Low"),
    (-1.0, "Low")])
def test_priority_thresholds_are_strict(spark, value, expected):
    one = spark.createDataFrame([("b", "r", value)], "brand_preference string, region string, "
                                                     "lifetime_value double")
    assert journey.segment_customers(one).first()["segment_priority"] == expected


def test_segment_is_null_if_a_part_is(customers, rows):
    assert rows(journey.segment_customers(customers), "customer_id",
                "brand_region_segment") == [("c1", "b_EUROPE"), ("c2", None), ("c3", None)]


def test_training_rows(interactions, customers, rows):
    features = journey.journey_features(interactions, customers.withColumn(
        "average_order_value", F.lit(1.0)), "2024-02-01").withColumn("goal", F.lit(3))
    got = journey.training_data(features, "goal")
    assert got.columns == [
        "customer_id", "total_interactions", "channel_diversity", "recency_days",
        "interaction_frequency", "lifetime_value", "average_order_value", "goal",
        "interaction_window"]
    assert rows(got, "customer_id", "interaction_window") == [("c1", 3), ("c2", 0), ("c3", 0)]
    with pytest.raises(ValueError, match="next_best_action"):
        journey.training_data(features, "next_best_action")
