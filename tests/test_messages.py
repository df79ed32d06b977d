import json

import pytest

from touchflow.functions.messages import (
    encode_responses, parse_events, parse_requests, split_requests,
)


@pytest.fixture
def raw(spark, at):
    def frame(*values, binary=True):
        table = spark.createDataFrame(
            [(f"k{i}", v, at("10:00:00")) for i, v in enumerate(values)],
            "key string, value string, timestamp timestamp")
        if binary:
            table = table.selectExpr("CAST(key AS binary) AS key", "CAST(value AS binary) AS "
                                     "value", "timestamp")
        return table
    return frame


def test_events(raw, rows, at):
    good = json.dumps({"customer_id": "c1", "event_type": "view", "channel": "web",
                       "timestamp": "2024-01-15T10:00:00.123456",
                       "properties": {"a": "1", "b": 2}, "other": [1]})
    for binary in (True, False):
        got = parse_events(raw(good, "{broken", "{}", None, binary=binary)).collect()
        assert len(got) == 4
        assert got[0]["customer_id"] == "c1" and got[0]["properties"] == {"a": "1", "b": "2"}
        assert got[0]["timestamp"].microsecond == 123456
        assert all(value is None for row in got[1:] for value in row)


def test_requests_get_defaults_and_rejects_their_reason(raw, rows, at):
    table = raw(json.dumps({"customer_id": "c1"}),
                json.dumps({"customer_id": "c2", "channel_context": {"channel": "web"},
                            "region": "EU", "brand": "b", "session_id": "s"}),
                json.dumps({"region": "EU"}), "not json", "[1]", None)
    requests, rejects = split_requests(table)
    assert rows(requests) == [
        ("c1", {}, at("10:00:00"), "unknown", "unknown", ""),
        ("c2", {"channel": "web"}, at("10:00:00"), "EU", "b", "s")]
    assert rows(parse_requests(table)) == rows(requests)
    assert rows(rejects, "value", "reason") == [
        ("[1]", "no customer_id"), ("not json", "not JSON"),
        ('{"region": "EU"}', "no customer_id"), (None, "not JSON")]


def test_responses(spark, at):
    table = spark.createDataFrame(
        [("c1", "no_action", "web", 0.5, at("10:00:00"), "1", "A", "extra")],
        "customer_id string, recommended_action string, channel string, confidence_score double,"
        " timestamp timestamp, model_version string, ab_test_group string, more string")
    row = encode_responses(table).first()
    assert row["key"] == "c1"
    assert json.loads(row["value"]) == {
        "customer_id": "c1", "recommended_action": "no_action", "channel": "web",
        "confidence_score": 0.5, "timestamp": "2024-01-15T10:00:00.000000",
        "model_version": "1", "ab_test_group": "A"}
