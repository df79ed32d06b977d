import math
from decimal import Decimal, localcontext

import pytest

from touchflow.functions import distributions as dist
from touchflow.operators import experiments, metrics, significance as sig

# Published quantiles.
NORMAL = [(0.05, 1.959963984540054), (0.01, 2.5758293035489004), (0.1, 1.6448536269514722)]
STUDENT = [(1, 0.05, 12.706204736432095), (2, 0.05, 4.302652729911275),
           (10, 0.05, 2.2281388519649385), (30, 0.01, 2.7499956535672254),
           (120, 0.05, 1.9799304050824413)]


@pytest.mark.parametrize("alpha,z", NORMAL)
def test_normal(alpha, z):
    assert dist.normal_critical(alpha) == pytest.approx(z, abs=1e-12)
    assert dist.normal_two_sided(z) == pytest.approx(alpha, abs=1e-12)
    assert dist.normal_two_sided(-z) == dist.normal_two_sided(z)


@pytest.mark.parametrize("df,alpha,t", STUDENT)
def test_student(df, alpha, t):
    assert dist.t_critical(alpha, df) == pytest.approx(t, rel=1e-9)
    assert dist.t_two_sided(t, df) == pytest.approx(alpha, abs=1e-9)
    assert dist.t_two_sided(-t, df) == dist.t_two_sided(t, df)


def test_limits():
    assert dist.normal_two_sided(0) == 1.0 and dist.t_two_sided(0.0, 7) == 1.0
    # one degree of freedom is the Cauchy distribution
    for t in (0.1, 1.0, 25.0):
        assert dist.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
    for t in (0.5, 2.0, 4.0):
        assert dist.t_two_sided(t, 1e9) == pytest.approx(dist.normal_two_sided(t), abs=1e-8)
    assert dist.t_two_sided(60.0, 500) < 1e-200
    assert 0 < dist.t_two_sided(12.0, 40) < 1e-13


def closed_form(t, df):
    """Two-sided probability for even degrees of freedom, a finite sum in 250 digits."""
    with localcontext() as context:
        context.prec = 250
        square = Decimal(t) ** 2
        cosine = Decimal(df) / (df + square)
        term = total = Decimal(1)
        for k in range(1, df // 2):
            term *= cosine * (2 * k - 1) / (2 * k)
            total += term
        return float(1 - (1 - cosine).sqrt() * total)


@pytest.mark.parametrize("df", [2, 10, 1000, 99_998, 100_002])
def test_student_equals_the_closed_form(df):
    for t in (0.25, 2.0, 8.0, 12.0, 30.0):
        assert dist.t_two_sided(t, df) == pytest.approx(closed_form(t, df), rel=2e-12)


@pytest.mark.parametrize("df", [10 ** 6, 10 ** 7, 10 ** 9])
def test_student_with_many_degrees_of_freedom(df):
    # Fisher's expansion about the normal tail; its next term is of order t^8 / df^2.
    for t in (0.5, 2.0, 5.0):
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        expected = dist.normal_two_sided(t) + 2 * density * (t ** 3 + t) / (4 * df)
        assert dist.t_two_sided(t, df) == pytest.approx(expected, rel=10 * t ** 8 / df ** 2 + 1e-12)
    assert dist.t_two_sided(30.0, df) == pytest.approx(
        dist.t_two_sided(30.0, df * (1 + 1e-9)), rel=1e-3)
    assert dist.t_two_sided(dist.t_critical(1e-6, df), df) == pytest.approx(1e-6, rel=1e-10)


MOMENTS = ("metric string, test_group string, sample_size long, metric_value double, n long, "
           "total double, variance double")


def verdicts(spark, records, **options):
    table = spark.createDataFrame(records, MOMENTS)
    return {(r["metric"], r["test_group"]): r
            for r in sig.significance(table, **options).collect()}


def test_proportions(spark):
    # 57 of 100 against 70 of 100; the counts are exact, not int(0.57 * 100) = 56
    got = verdicts(spark, [("conversion_rate", "control", 100, 0.57, 100, 57.0, 0.2),
                           ("conversion_rate", "new", 100, 0.70, 100, 70.0, 0.2)])
    row = got["conversion_rate", "new"]
    z = 0.13 / math.sqrt(0.635 * 0.365 * 0.02)
    margin = 1.959963984540054 * math.sqrt(0.57 * 0.43 / 100 + 0.7 * 0.3 / 100)
    assert row["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-12)
    assert row["ci_lower"] == pytest.approx(0.13 - margin)
    assert row["ci_upper"] == pytest.approx(0.13 + margin)
    assert row["lift_percentage"] == pytest.approx(13 / 57 * 100)
    assert row["effect_size"] == pytest.approx(0.13)
    assert row["test"] == "proportion" and not row["is_significant"]


def test_means_with_observed_and_assumed_spread(spark):
    records = [("revenue_per_customer", "control", 5, 10.0, 5, 50.0, 4.0),
               ("revenue_per_customer", "new", 8, 13.0, 8, 104.0, 9.0)]
    row = verdicts(spark, records)["revenue_per_customer", "new"]
    error = math.sqrt((4 * 4 + 7 * 9) / 11) * math.sqrt(1 / 5 + 1 / 8)
    assert row["test"] == "t"
    assert row["p_value"] == pytest.approx(dist.t_two_sided(3 / error, 11), abs=1e-12)
    assert row["ci_upper"] - 3 == pytest.approx(dist.t_critical(0.05, 11) * error)
    row = verdicts(spark, records, assumed_cv=0.2)["revenue_per_customer", "new"]
    error = math.sqrt((4 * 2 ** 2 + 7 * 2.6 ** 2) / 11) * math.sqrt(1 / 5 + 1 / 8)
    assert row["p_value"] == pytest.approx(dist.t_two_sided(3 / error, 11), abs=1e-12)


def test_no_spread_no_difference(spark):
    got = verdicts(spark, [("conversion_rate", "control", 10, 0.0, 10, 0.0, 0.0),
                           ("conversion_rate", "new", 10, 0.0, 10, 0.0, 0.0),
                           ("revenue_per_customer", "control", 10, 0.0, 10, 0.0, 0.0),
                           ("revenue_per_customer", "new", 10, 5.0, 10, 50.0, 0.0)])
    for row in got.values():
        assert row["p_value"] == 1.0 and row["is_significant"] is False
        assert row["lift_percentage"] == 0.0  # the control is 0


@pytest.mark.parametrize("control", [[], [("conversion_rate", "control", 0, 0.0, 0, 0.0, None)]])
def test_missing_or_empty_control(spark, control):
    row = verdicts(spark, control + [("conversion_rate", "new", 10, 0.5, 10, 5.0, 0.2)])[
        "conversion_rate", "new"]
    assert row["p_value"] is None and row["is_significant"] is None
    assert row["ci_lower"] is None and row["treatment_metric"] == 0.5


def test_single_observations_have_no_test(spark):
    row = verdicts(spark, [("revenue_per_customer", "control", 1, 1.0, 1, 1.0, None),
                           ("revenue_per_customer", "new", 1, 2.0, 1, 2.0, None)])[
        "revenue_per_customer", "new"]
    assert row["p_value"] is None


def units(spark, converted_by_group, size=1000):
    records = [(g, int(i < n)) for g, n in converted_by_group.items() for i in range(size)]
    return spark.createDataFrame(records, "test_group string, converted int")


def test_winner_and_summary(spark, rows):
    moments = metrics.metric_moments(
        units(spark, {"control": 100, "simple_rules": 180, "ml_ensemble": 160}),
        ("conversion_rate",))
    verdict = sig.significance(moments)
    best = sig.winner(verdict, "conversion_rate").first()
    assert best["test_group"] == "simple_rules"
    assert best["result"] == "Simple_Rules group with 80.00% lift"
    assert best["recommendation"] == "Deploy simple_rules treatment to all customers"
    design = experiments.design_experiment(["s"], start_date="2024-01-01")
    report = sig.summary(moments, design)
    lines = rows(report)
    assert (("overview", None, "Start Date", "2024-01-01") in lines
            and ("overview", None, "Test Duration", "28 days") in lines)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [test_group") == 1  # the moments are computed once
    assert ("sample_size", "control", "Customers", "1000") in lines
    assert ("result", "ml_ensemble", "Conversion Rate", "0.1600") in lines
    assert ("significance", "Simple_Rules vs Control", "Lift", "80.00%") in lines
    assert ("significance", "Ml_Ensemble vs Control", "Statistically Significant",
            "Yes") in lines
    assert ("recommendation", "simple_rules", "Winner", best["result"]) in lines


def test_no_winner_and_ties_go_to_the_first_name(spark):
    moments = metrics.metric_moments(units(spark, {"control": 10, "b": 11, "a": 11}),
                                     ("conversion_rate",))
    best = sig.winner(sig.significance(moments), "conversion_rate").first()
    assert best["test_group"] == "a"
    assert best["result"] == "No statistically significant difference found"
    assert best["recommendation"].startswith("Continue testing")
