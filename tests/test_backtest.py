from datetime import datetime, timedelta

import pytest

from touchflow.operators.backtest import backtest_overall, backtest_windows

START = datetime(2024, 1, 1)


def history(spark, days, schema="date timestamp, converted int, revenue double"):
    return spark.createDataFrame([(START + timedelta(days=d), c, r) for d, c, r in days], schema)


def brute_force(days, length):
    first, last = min(d for d, *_ in days), max(d for d, *_ in days)
    found, start = [], first
    while start < last:
        inside = [x for x in days if start <= x[0] < start + length]
        if inside:
            flags = [c for _, c, _ in inside if c is not None]
            found.append((round((start - first) / length), len(inside),
                          sum(flags) / len(flags) if flags else None,
                          sum(r for *_, r in inside if r is not None)))
        start += length
    return found


def test_windows_equal_brute_force_with_gaps_and_nulls(spark, rows):
    days = [(0, 1, 10.0), (1.5, 0, 5.0), (6.999, None, None), (7, 1, 1.0), (30, None, 2.0),
            (36, 0, 3.0), (41.9, 1, 4.0)]
    got = rows(backtest_windows(history(spark, days), days=7), "window_id", "row_count",
               "actual_conversion_rate", "actual_revenue")
    assert got == brute_force(days, 7)


def test_last_row_on_a_window_edge_is_in_no_window(spark, rows):
    days = [(0, 1, 1.0), (3, 0, 1.0), (14, 1, 1.0)]
    got = rows(backtest_windows(history(spark, days), days=7), "window_id", "row_count")
    assert got == [(0, 2)]
    days[-1] = (14.001, 1, 1.0)
    got = rows(backtest_windows(history(spark, days), days=7), "window_id", "row_count")
    assert got == [(0, 2), (2, 1)]


def test_single_timestamp_has_no_window(spark):
    windows = backtest_windows(history(spark, [(0, 1, 1.0), (0, 0, 2.0)]))
    assert windows.count() == 0
    assert backtest_overall(windows).count() == 0


def test_metrics_of_a_window(spark):
    row = backtest_windows(history(spark, [(0, 1, 10.0), (1, 0, 20.0)])).first()
    assert row["window_start"] == START and row["window_end"] == START + timedelta(days=30)
    assert row["predicted_conversion_rate"] == 0.12
    assert row["predicted_revenue"] == pytest.approx(2 * 0.12 * 50)
    assert row["prediction_accuracy"] == pytest.approx(1 - abs(0.5 - 0.12))


def test_optional_columns_and_predictions(spark):
    table = spark.createDataFrame([("2024-01-01", 0.2), ("2024-01-03", 0.4)],
                                  "date string, likely double")
    row = backtest_windows(table, prediction_col="likely", value=100.0).first()
    assert (row["actual_conversion_rate"], row["actual_revenue"]) == (0.0, 0.0)
    assert row["predicted_conversion_rate"] == pytest.approx(0.3)
    assert row["predicted_revenue"] == pytest.approx(60.0)


def test_overall_is_unweighted(spark):
    days = [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (30, 0, 1.0), (31, None, None)]
    row = backtest_overall(backtest_windows(history(spark, days))).first()
    assert row["avg_conversion_rate"] == 0.5 and row["num_windows"] == 2
    assert row["total_revenue"] == 4.0
    assert row["avg_prediction_accuracy"] == pytest.approx((0.12 + 0.88) / 2)


def test_windows_need_no_join_or_sort(spark):
    plan = backtest_windows(history(spark, [(0, 1, 1.0)]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Sort " not in text
