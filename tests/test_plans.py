"""Shapes of the physical plans, with automatic broadcasts off as between large tables."""

import re

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
# Queries whose functions run no sink or stream, so that looking at the plan is cheap.
LAZY = ["segmentation", "combined_interactions", "journey_features", "training_data",
        "time_features", "context_features", "parse_events", "parse_requests",
        "experiment_plan", "stratified_assignment", "hash_assignment", "retail_metrics",
        "sample_size_by_segment", "significance", "backtest_windows", "backtest_overall",
        "sliding_activity", "sliding_channel_counts", "feature_lookup", "session_features",
        "merged_features", "feature_vector", "model_routing", "score_linear",
        "recommendations", "latest_results", "requests_per_minute", "action_distribution",
        "rolling_metrics", "alerts", "alert_windows"]


@pytest.fixture(scope="module")
def plan(spark):
    known = {}

    def text(name):
        if name not in known:
            before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            try:
                query = contract.queries()[name](spark, SF_DIR)
                known[name] = query._jdf.queryExecution().executedPlan().toString()
            finally:
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        return known[name]

    return text


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_or_nested_loop_join(plan, name):
    assert "Cartesian" not in plan(name) and "NestedLoop" not in plan(name)


@pytest.mark.parametrize("name", LAZY)
def test_broadcasts_are_the_assignment_boundaries_only(plan, name):
    assigned = ("stratified_assignment", "retail_metrics", "significance")
    assert ("BroadcastExchange" in plan(name)) == (name in assigned)


@pytest.mark.parametrize("name", [n for n in LAZY if n != "significance"])
def test_no_python_workers(plan, name):
    assert "ArrowEvalPython" not in plan(name) and "BatchEvalPython" not in plan(name)


@pytest.mark.parametrize("name,columns", [
    ("time_features", {"event_id", "ts"}),
    ("requests_per_minute", {"ts", "value"}),
    ("backtest_overall", {"o_orderdate", "o_orderstatus", "o_totalprice"}),
    ("hash_assignment", {"c_custkey"}),
    ("sliding_activity", {"ts", "user_id", "event_type"}),
])
def test_scans_read_the_needed_columns(plan, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(name))
    widest = max(({c.split(":")[0] for c in s.split(",")} for s in schemas), key=len)
    assert widest == columns


def test_channel_filters_reach_the_scan(plan):
    for kind in ("click", "signup", "view", "purchase", "error"):
        assert f"EqualTo(event_type,{kind})" in plan("combined_interactions")


@pytest.mark.parametrize("name,shuffles", [
    ("time_features", 0), ("hash_assignment", 0), ("requests_per_minute", 1),
    ("action_distribution", 1), ("backtest_windows", 1), ("sliding_activity", 2),
])
def test_number_of_shuffles(plan, name, shuffles):
    assert len(re.findall(r"Exchange hashpartitioning", plan(name))) == shuffles


def test_group_metrics_are_aggregated_before_the_shuffle(plan):
    assert "partial_count(1)" in plan("retail_metrics")
    last = plan("retail_metrics").index("Exchange hashpartitioning(test_group")
    assert "HashAggregate(keys=[test_group" in plan("retail_metrics")[last:]
