import hashlib
from collections import Counter
from math import ceil, sqrt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from touchflow.operators import experiments as ex
from touchflow.operators import metrics


def units(spark, sizes):
    records = [(f"{segment}{i}", segment) for segment, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(records, "customer_id string, customer_segment string")


def expected_groups(sizes, listed, seed=42, groups=ex.GROUPS):
    """Brute force: sort each listed segment, then cut it."""
    result = {}
    for segment, n in sizes.items():
        if segment not in listed:
            continue
        ids = sorted((hashlib.md5(f"{seed}:{segment}{i}".encode()).hexdigest(), f"{segment}{i}")
                     for i in range(n))
        start = 0
        for group in groups:
            size = n * group.percent // 100
            result |= {name: group.name for _, name in ids[start:start + size]}
            start += size
    return result


def assigned(table, design, **options):
    got = ex.assign_stratified(table, design, **options)
    return {r["customer_id"]: r["test_group"] for r in got.collect()}


def test_assignment_equals_brute_force(spark):
    sizes = {"High": 1, "Medium": 4, "Low": 5, "Big": 1003, "Other": 50, "Six": 6}
    listed = ["High", "Medium", "Low", "Big", "Six", "Absent"]
    design = ex.design_experiment(listed)
    table = units(spark, sizes)
    for digits in (0, 1, 3):
        got = assigned(table, design, prefix_digits=digits)
        assert got == expected_groups(sizes, listed)
    assert Counter(got.values())["ml_ensemble"] == sum(
        n * 60 // 100 for s, n in sizes.items() if s in listed)


def test_assignment_does_not_depend_on_partitions(spark):
    table = units(spark, {"a": 500, "b": 77})
    design = ex.design_experiment(["a", "b"])
    first = assigned(table.repartition(1), design)
    assert first == assigned(table.repartition(13, F.rand(1)), design)
    assert first != assigned(table, design, seed=7)


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 300), percents=st.lists(st.integers(0, 40), min_size=1, max_size=2))
def test_group_sizes(spark, n, percents):
    groups = tuple(ex.Group(f"g{i}", "t", "d", p) for i, p in enumerate(percents))
    design = ex.design_experiment(["s"], groups=groups)
    got = Counter(assigned(units(spark, {"s": n, "x": 1}), design).values())
    assert got == Counter({g.name: n * g.percent // 100 for g in groups
                           if n * g.percent // 100})


def test_large_pass_of_the_assignment_is_not_shuffled(spark):
    design = ex.design_experiment(["a"])
    path_free = ex.assign_stratified(units(spark, {"a": 20}), design)
    plan = path_free._jdf.queryExecution().executedPlan().toString()
    streamed = plan[:plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in streamed
    assert "BroadcastHashJoin" in streamed and "Window" not in streamed


def test_design_by_vertical():
    retail, other = (ex.design_experiment(["a"], v) for v in ("retail", "non_retail"))
    assert retail.primary_metric == "conversion_rate"
    assert other.primary_metric == "engagement_rate"
    assert other.secondary_metrics == ("conversion_rate", "time_to_conversion",
                                       "customer_satisfaction")
    assert retail.duration_days == 28
    with pytest.raises(ValueError):
        ex.design_experiment(["a"], groups=(ex.Group("a", "t", "d", 101),))


def test_plan_tables(spark, rows):
    design = ex.design_experiment(["a"])
    assert [r[0] for r in rows(ex.plan_table(spark, design), "test_group")] == [
        "control", "ml_ensemble", "simple_rules"]
    sizes = ex.plan_sizes(units(spark, {"a": 9, "b": 5}), design)
    assert rows(sizes, "customer_segment", "test_group", "group_size") == [
        ("a", "control", 1), ("a", "ml_ensemble", 5), ("a", "simple_rules", 1)]


def test_hash_assignment_is_sticky_and_even(spark):
    table = spark.range(4000).select(F.col("id").cast("string").alias("customer_id"))
    groups = {r[0]: r[1] for r in ex.assign_by_hash(table, "t").collect()}
    again = {r[0]: r[1] for r in ex.assign_by_hash(table.repartition(7), "t").collect()}
    assert groups == again
    for name, group in list(groups.items())[:50]:
        bucket = int(hashlib.md5(f"{name}:t".encode()).hexdigest()[:8], 16) % 100
        assert group == ("A" if bucket < 50 else "B")
    assert abs(Counter(groups.values())["A"] - 2000) < 150
    other = {r[0]: r[1] for r in ex.assign_by_hash(table, "u").collect()}
    assert other != groups


@pytest.mark.parametrize("p1,effect,alpha,power,expected", [
    # n = 2 (z_a + z_b)^2 p(1-p) / effect^2 with p the mean rate
    (0.12, 0.02, 0.05, 0.8, ceil(2 * (1.959963984540054 + 0.8416212335729143) ** 2
                                 * 0.13 * 0.87 / 0.02 ** 2)),
    (0.5, -0.1, 0.01, 0.9, ceil(2 * (2.5758293035489004 + 1.2815515655446004) ** 2
                                * 0.45 * 0.55 / 0.1 ** 2)),
])
def test_sample_size(spark, p1, effect, alpha, power, expected):
    got = spark.range(1).select(ex.sample_size(F.lit(p1), F.lit(effect), alpha, power)).first()
    assert got[0] == expected


def test_sample_size_is_null_without_an_effect_or_spread(spark):
    got = spark.createDataFrame([(0.1, 0.0), (0.0, 0.0), (1.0, 0.5)], "p double, e double")
    assert [r[0] for r in got.select(ex.sample_size(F.col("p"), F.col("e"))).collect()] == [
        None, None, None]


def test_rates_count_nulls_and_means_do_not(spark, rows):
    table = spark.createDataFrame(
        [("a", 1, 10.0, 2.0), ("a", None, None, None), ("a", 0, 5.0, 4.0), ("a", 1, 0.0, None),
         ("b", None, None, None)],
        "test_group string, converted int, revenue double, time_to_conversion double")
    assert rows(metrics.retail_metrics(table)) == [
        ("a", 4, 0.5, 3.75, 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0, 0.0)]
    # engaged and satisfaction_score are not in the table: their metrics are 0
    assert rows(metrics.non_retail_metrics(table)) == [
        ("a", 4, 0.0, 0.5, 3.0, 0.0), ("b", 1, 0.0, 0.0, None, 0.0)]


def test_moments(spark):
    table = spark.createDataFrame(
        [("a", 1, 2.0), ("a", 0, None), ("a", None, 5.0)],
        "test_group string, converted int, time_to_conversion double")
    got = {r["metric"]: r for r in metrics.metric_moments(
        table, ("conversion_rate", "time_to_conversion", "revenue_per_customer")).collect()}
    rate, time, revenue = (got[m] for m in ("conversion_rate", "time_to_conversion",
                                            "revenue_per_customer"))
    assert (rate["n"], rate["total"], rate["metric_value"]) == (3, 1.0, 1 / 3)
    assert (time["n"], time["total"], time["metric_value"]) == (2, 7.0, 3.5)
    assert time["variance"] == pytest.approx(4.5) and time["sample_size"] == 3
    assert (revenue["total"], revenue["variance"]) == (0.0, 0.0)
    assert sqrt(rate["variance"]) == pytest.approx(sqrt(1 / 3))


def test_segments_of_a_table_and_all_segments(spark):
    sizes = {"a": 40, "b": 77, "c": 5}
    table = units(spark, sizes).unionByName(
        spark.createDataFrame([("nobody", None)], "customer_id string, customer_segment string"))
    chosen = spark.createDataFrame([("a",), ("c",), ("c",), ("absent",)], "name string")
    assert assigned(table, ex.design_experiment(chosen)) == expected_groups(sizes, ["a", "c"])
    assert assigned(table, ex.design_experiment(None)) == expected_groups(sizes, list(sizes))
    planned = ex.plan_sizes(table, ex.design_experiment(chosen))
    assert {r["customer_segment"] for r in planned.collect()} == {"a", "c"}
