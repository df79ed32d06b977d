"""Backtest of conversion history in windows of N days from the first row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Window length and the simulated prediction.
WINDOW_DAYS = 30
PREDICTED_RATE = 0.12
VALUE_PER_CONVERSION = 50.0

_MICROS_PER_DAY = 86_400_000_000


def _optional(history: DataFrame, name: str, aggregate) -> Column:
    return aggregate(F.col(name).cast("double")) if name in history.columns else F.lit(0.0)


def backtest_windows(history: DataFrame, days: int = WINDOW_DAYS,
                     rate: float = PREDICTED_RATE, value: float = VALUE_PER_CONVERSION,
                     prediction_col: str | None = None, date_col: str = "date") -> DataFrame:
    """Actual against predicted performance per non-empty window.

    Windows start at the first timestamp and go on while a window starts before the last one, so
    a row at exactly ``first + k * days`` that is also the last is in no window.  Rows find their
    window by arithmetic; first and last come from one scalar subquery each, so there is neither
    a sort nor a join.  ``prediction_col`` gives a predicted probability per row in place of the
    constant ``rate``.
    """
    at = F.col("_at")
    dated = history.withColumn("_at", F.to_timestamp(date_col)).filter(at.isNotNull())
    first = F.unix_micros(dated.agg(F.min("_at")).scalar())
    last = F.unix_micros(dated.agg(F.max("_at")).scalar())
    length = days * _MICROS_PER_DAY

    number = F.call_function("div", F.unix_micros(at) - first, F.lit(length))
    start = first + F.col("window_id") * F.lit(length)
    predicted = F.lit(rate) if prediction_col is None else F.avg(prediction_col)
    return (
        dated.withColumn("window_id", number)
        .withColumn("_start", start)
        .filter(F.col("_start") < last)
        .groupBy("window_id", "_start")
        .agg(
            F.count("*").alias("row_count"),
            _optional(history, "converted", F.avg).alias("actual_conversion_rate"),
            predicted.alias("predicted_conversion_rate"),
            F.coalesce(_optional(history, "revenue", F.sum), F.lit(0.0)).alias("actual_revenue"),
        )
        .select(
            "window_id",
            F.timestamp_micros("_start").alias("window_start"),
            F.timestamp_micros(F.col("_start") + F.lit(length)).alias("window_end"),
            "row_count", "actual_conversion_rate", "predicted_conversion_rate",
            "actual_revenue",
            (F.col("row_count") * F.col("predicted_conversion_rate") * value)
            .alias("predicted_revenue"),
            (1 - F.abs(F.col("actual_conversion_rate") - F.col("predicted_conversion_rate")))
            .alias("prediction_accuracy"),
        )
    )


def backtest_overall(windows: DataFrame) -> DataFrame:
    """Unweighted means over the windows; no row if there is no window."""
    return windows.agg(
        F.avg("actual_conversion_rate").alias("avg_conversion_rate"),
        F.avg("prediction_accuracy").alias("avg_prediction_accuracy"),
        F.sum("actual_revenue").alias("total_revenue"),
        F.count("*").alias("num_windows"),
    ).filter(F.col("num_windows") > 0)
