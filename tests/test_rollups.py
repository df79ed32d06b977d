"""Metrics of roll-ups against those of the log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from touchflow.operators.monitoring import rolling_metrics
from touchflow.operators.rollups import roll_up, rolling_metrics_of_rollups
from touchflow.session import shared_folder

LOG = "timestamp timestamp, latency_ms double, recommended_action string"
CALLS = ("2024-01-10 09:15:30", "2024-01-10 10:00:00", "2024-01-11 23:59:59.5", "2024-01-13 00:00:00",
         "2024-01-15 12:00:30")


@pytest.fixture(scope="module")
def log(spark):
    draw, start = random.Random(4), datetime(2024, 1, 10)
    rows = [(start + timedelta(seconds=draw.randrange(6 * 86400)), draw.choice([None, 10.0, 250.0]),
             draw.choice(["a", "b", None])) for _ in range(6000)]
    rows += [(datetime.fromisoformat(call), 1.0, "edge") for call in CALLS]
    rows += [(datetime(2024, 1, 14, 11, 59, s), 5.0, "early") for s in (1, 30, 31)]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def rolled(spark, log):
    path, since = shared_folder(spark, "rollups"), None
    for call in CALLS:
        for _ in range(2):  # a repeated call adds nothing
            roll_up(log, path, call, since)
        since = call
    return path


def shown(metrics):
    [row] = metrics.collect()
    return (row["request_count"], round(row["average_latency"], 9), row["action_distribution"],
            row["timestamp"])


@pytest.mark.parametrize("minutes", [1, 5, 60, 61, 121, 1440, 1441, 3000, 7200, 100_000])
@pytest.mark.parametrize("retention", [60, 3600, 86_400, 1_000_000])
def test_equal_to_the_log(spark, log, rolled, minutes, retention):
    now = CALLS[-1]
    assert shown(rolling_metrics_of_rollups(spark, rolled, now, minutes, retention)) == shown(
        rolling_metrics(log.filter(F.col("timestamp") <= now), now, minutes,
                        retention_seconds=retention))


def test_only_roll_ups_are_read_and_few_rows_of_them(spark, rolled):
    metrics = rolling_metrics_of_rollups(spark, rolled, CALLS[-1], 7200, 1_000_000)
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 3 and "Scan ExistingRDD" not in plan
    assert plan.count("PartitionFilters: [isnotnull(log_date") == 3
    read = {unit: spark.read.parquet(f"{rolled}/{unit}").groupBy("start").count().count()
            for unit in ("minute", "hour", "day")}
    assert read["day"] == 5 and read["hour"] > 24 * 4 and read["minute"] > 2000


def test_a_log_of_minutes_has_no_hours_yet(spark):
    path, now = shared_folder(spark, "rollups"), "2024-01-10 00:03:00"
    log = spark.createDataFrame([(datetime(2024, 1, 10, 0, m), 2.0, "a") for m in range(5)], LOG)
    roll_up(log, path, now)
    assert shown(rolling_metrics_of_rollups(spark, path, now)) == shown(
        rolling_metrics(log.filter(F.col("timestamp") <= now), now))
    empty = shared_folder(spark, "rollups")
    roll_up(log.limit(0), empty, now)
    assert shown(rolling_metrics_of_rollups(spark, empty, now))[:3] == (0, 0.0, {})
