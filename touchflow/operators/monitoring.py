"""Service metrics and alerts from the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchflow.functions.scalars import fixed

# Alert thresholds, ranges in minutes, lifetime of a minute, alert texts.
HIGH_LATENCY_MS = 1000
LOW_VOLUME_REQUESTS = 10
METRICS_MINUTES = 60
ALERT_MINUTES = 5
RETENTION_SECONDS = 3600
HIGH_LATENCY_TEXT = "High latency detected: %sms"
LOW_VOLUME_TEXT = "Low request volume: %d requests"


def moment(now: Column | str) -> Column:
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def requests_per_minute(log: DataFrame, at: str = "timestamp") -> DataFrame:
    """Requests and latency sums per minute; batch or stream (with a watermark on ``at``).

    Sums and counts stand in for lists of samples: minutes merge by addition.
    """
    return (
        log.groupBy(F.window(at, "1 minute"))
        .agg(F.count("*").alias("request_count"),
             F.sum("latency_ms").alias("latency_sum"),
             F.count("latency_ms").alias("latency_count"))
        .select(F.col("window.start").alias("minute"), "request_count", "latency_sum",
                "latency_count")
    )


def action_distribution(log: DataFrame, at: str = "timestamp") -> DataFrame:
    """Count of each recommended action per minute."""
    return (
        log.groupBy(F.window(at, "1 minute"), "recommended_action")
        .agg(F.count("*").alias("action_count"))
        .select(F.col("window.start").alias("minute"), "recommended_action", "action_count")
    )


def recent(log: DataFrame, now: Column | str, minutes: int, at: str = "timestamp") -> DataFrame:
    """Rows of the last N clock minutes, the current partial one included.

    The filter is a plain range on the time column (and on ``log_date`` if the log is
    partitioned by it), so it reaches the scan.
    """
    end = moment(now)
    start = F.date_trunc("minute", end) - F.make_dt_interval(
        mins=F.lit(minutes - 1))
    rows = log.filter((F.col(at) >= start) & (F.col(at) <= end))
    if "log_date" in log.columns:
        rows = rows.filter(F.col("log_date").between(F.to_date(start), F.to_date(end)))
    return rows


def rolling_metrics(log: DataFrame, now: Column | str, minutes: int = METRICS_MINUTES,
                    at: str = "timestamp", retention_seconds: int = RETENTION_SECONDS
                    ) -> DataFrame:
    """One row: requests, average latency and action counts of the last N minutes.

    A minute counts until ``retention_seconds`` after its last request, which only shows when N
    reaches back further.  Rows are aggregated per minute and action first; all later steps see
    at most one row per minute and action.
    """
    end = moment(now)
    per_minute = (
        recent(log, end, minutes, at)
        .withColumn("recommended_action", F.coalesce("recommended_action", F.lit("unknown")))
        .groupBy(F.date_trunc("minute", at).alias("_minute"), "recommended_action")
        .agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency"),
             F.max(at).alias("_last"))
        .withColumn("_last", F.max("_last").over(Window.partitionBy("_minute")))
        .filter(F.unix_micros(end) < F.unix_micros("_last") + retention_seconds * 1_000_000))
    return totals_of_actions(per_minute, end)


def totals_of_actions(rows: DataFrame, end: Column) -> DataFrame:
    """One row of metrics from rows with an action, its requests ``n`` and their ``latency``."""
    per_action = rows.groupBy("recommended_action").agg(
        F.sum("n").alias("n"), F.sum("latency").alias("latency"))
    totals = per_action.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("request_count"),
        F.coalesce(F.sum("latency"), F.lit(0.0)).alias("_latency"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("recommended_action", "n"))))
        .alias("action_distribution"))
    average = F.coalesce(F.try_divide("_latency", F.col("request_count").cast("double")),
                         F.lit(0.0))
    return totals.select("request_count", average.alias("average_latency"),
                         "action_distribution", end.alias("timestamp"))


def _rule(kind: str, message: Column, severity: str, raised: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), message.alias("message"),
                    F.lit(severity).alias("severity"), raised.alias("raised"))


def alerts(metrics: DataFrame) -> DataFrame:
    """Alerts raised by rows with ``request_count`` and ``average_latency``."""
    latency, requests = F.col("average_latency"), F.col("request_count")
    others = [name for name in metrics.columns
              if name not in ("request_count", "average_latency", "action_distribution")]
    rules = F.array(
        _rule("high_latency", F.format_string(HIGH_LATENCY_TEXT, fixed(latency, 2)),
              "warning", latency > HIGH_LATENCY_MS),
        _rule("low_volume", F.format_string(LOW_VOLUME_TEXT, requests),
              "info", requests < LOW_VOLUME_REQUESTS),
    )
    return (metrics.select(*others, F.explode(F.filter(rules, lambda r: r["raised"])).alias("a"))
            .select(*others, "a.type", "a.message", "a.severity"))


def check_alerts(log: DataFrame, now: Column | str, minutes: int = ALERT_MINUTES,
                 at: str = "timestamp") -> DataFrame:
    return alerts(rolling_metrics(log, now, minutes, at))


def alert_windows(log: DataFrame, minutes: int = ALERT_MINUTES, at: str = "timestamp"
                  ) -> DataFrame:
    """Alerts of every N-minute range ending on a full minute, silent ranges included.

    Requests are added up per minute first; only minutes are multiplied.
    """
    return alert_windows_of_minutes(requests_per_minute(log, at), minutes)


def alert_windows_of_minutes(per_minute: DataFrame, minutes: int = ALERT_MINUTES) -> DataFrame:
    """Alerts from the minute table, for ranges that cover any minute from the first to the last."""
    return alerts(range_metrics(per_minute, minutes))


def _each_minute(per_minute: DataFrame, first: Column, last: Column) -> DataFrame:
    """An empty row for every minute from first to last: days first, which several tasks fill."""
    begin, end = F.date_trunc("day", first), F.date_trunc("day", last)
    days = per_minute.sparkSession.range(1).select(
        F.explode(F.sequence(begin, end, F.expr("INTERVAL 1 DAY"))).alias("_day"),
        first.alias("_first"), last.alias("_last"))
    day, step = F.col("_day"), F.make_dt_interval(mins=F.lit(1))
    inside = F.sequence(F.greatest(day, "_first"),
                        F.least(day + F.expr("INTERVAL 1439 MINUTES"), "_last"), step)
    return (days.repartition("_day").select(F.explode(inside).alias("minute"))
            .select("minute", F.lit(0).cast("long").alias("request_count"),
                    F.lit(0.0).alias("latency_sum")))


def range_metrics(per_minute: DataFrame, minutes: int = ALERT_MINUTES,
                  first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Requests and average latency of every N-minute range, by its end on a full minute.

    Ranges cover any minute from ``first`` to ``last``, or from the first row to the last, so the
    last N - 1 reach past it.  Minutes without a row count as minutes without requests.
    """
    first, last = (given if given is not None else per_minute.agg(bound("minute")).scalar()
                   for given, bound in ((first, F.min), (last, F.max)))
    filled = per_minute.select("minute", "request_count", "latency_sum").unionByName(
        _each_minute(per_minute, first, last))
    # A minute counts in the ranges that end 1 to N minutes after its start.
    ends = F.transform(F.sequence(F.lit(1), F.lit(minutes)),
                       lambda i: F.col("minute") + F.make_dt_interval(mins=i))
    metrics = (filled.select(F.explode(ends).alias("timestamp"), "request_count", "latency_sum")
               .groupBy("timestamp")
               .agg(F.sum("request_count").alias("request_count"),
                    F.sum("latency_sum").alias("_latency")))
    # Minutes are added up in any order, which shows in the last digits.
    average = F.round(F.coalesce(F.try_divide("_latency", F.col("request_count").cast("double")),
                                 F.lit(0.0)), 9)
    return metrics.select("timestamp", "request_count", average.alias("average_latency"))
