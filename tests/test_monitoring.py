from datetime import timedelta

import pytest

from touchflow.operators import monitoring as mon

LOG = "recommended_action string, latency_ms double, timestamp timestamp"


def log(spark, records):
    return spark.createDataFrame(records, LOG)


def test_minutes(spark, rows, at):
    table = log(spark, [("a", 10.0, at("10:00:00")), ("a", None, at("10:00:59")),
                        ("b", 30.0, at("10:01:00"))])
    assert rows(mon.requests_per_minute(table)) == [
        (at("10:00:00"), 2, 10.0, 1), (at("10:01:00"), 1, 30.0, 1)]
    assert rows(mon.action_distribution(table)) == [
        (at("10:00:00"), "a", 2), (at("10:01:00"), "b", 1)]


def test_range_holds_the_partial_minute_and_n_minus_one_before(spark, at):
    table = log(spark, [("a", 100.0, at("09:55:59")), ("a", 200.0, at("09:56:00")),
                        ("b", 400.0, at("10:00:30")), ("b", 800.0, at("10:00:31"))])
    row = mon.rolling_metrics(table, "2024-01-15 10:00:30", 5).first()
    assert (row["request_count"], row["average_latency"]) == (2, 300.0)
    assert row["action_distribution"] == {"a": 1, "b": 1}
    assert row["timestamp"] == at("10:00:30")


def test_empty_range(spark, at):
    row = mon.rolling_metrics(log(spark, []), "2024-01-15 10:00:30").first()
    assert (row["request_count"], row["average_latency"]) == (0, 0.0)
    assert row["action_distribution"] == {}


def test_minutes_expire_an_hour_after_their_last_request(spark, at):
    now = at("10:00:30")
    table = log(spark, [("a", 1.0, at("08:59:00")), ("a", 1.0, at("09:00:10")),
                        ("a", 1.0, at("09:00:31")), ("a", 1.0, at("09:30:00"))])
    # the minute 09:00 lives through its second request, the one before is gone
    assert mon.rolling_metrics(table, str(now), 120).first()["request_count"] == 3
    assert mon.rolling_metrics(table, str(now + timedelta(seconds=1)), 120).first()[
        "request_count"] == 1
    assert mon.rolling_metrics(table, str(now), 120, retention_seconds=7200).first()[
        "request_count"] == 4


@pytest.mark.parametrize("count,latency,expected", [
    (10, 1000.0, []),
    (10, 1000.01, ["high_latency"]),
    (9, 5.0, ["low_volume"]),
    (0, 0.0, ["low_volume"]),
    (2, 5000.0, ["high_latency", "low_volume"]),
])
def test_alert_thresholds(spark, count, latency, expected):
    table = spark.createDataFrame([(count, latency)],
                                  "request_count long, average_latency double")
    assert [r["type"] for r in mon.alerts(table).collect()] == expected


def test_alert_text(spark, at):
    table = log(spark, [("a", 1006.925, at("10:00:00"))])
    got = mon.check_alerts(table, "2024-01-15 10:00:30").collect()
    assert [(r["message"], r["severity"]) for r in got] == [
        ("High latency detected: 1006.92ms", "warning"),
        ("Low request volume: 1 requests", "info")]


def test_alert_windows(spark, at):
    table = log(spark, [("a", 1.0, at("10:00:30"))] * 10)
    assert mon.alert_windows(table).count() == 0
    few = mon.alert_windows(table.limit(9)).collect()
    assert sorted(r["timestamp"] for r in few) == [
        at("10:01:00") + timedelta(minutes=i) for i in range(5)]


def test_silent_ranges_raise_alerts(spark, at):
    table = log(spark, [("a", 1.0, at("10:00:30"))] * 10 + [("a", 1.0, at("10:20:30"))] * 10)
    got = {r["timestamp"]: r["message"] for r in mon.alert_windows(table).collect()}
    assert sorted(got) == [at("10:00:00") + timedelta(minutes=i) for i in range(6, 21)]
    assert set(got.values()) == {"Low request volume: 0 requests"}
    plan = mon.alert_windows(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # minutes are multiplied, requests are not
    assert mon.alert_windows(table.limit(0)).collect() == []


def test_a_missing_action_counts_as_unknown(spark, at):
    table = log(spark, [(None, 1.0, at("10:00:00")), ("unknown", 1.0, at("10:00:01"))])
    row = mon.rolling_metrics(table, "2024-01-15 10:00:30").first()
    assert row["action_distribution"] == {"unknown": 2}
