"""Minute metrics of a live log that lose no late request, and alerts that need no later one."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from touchflow.operators.monitoring import ALERT_MINUTES, alerts, range_metrics
from touchflow.sources.streams import batch_folder
from touchflow.streaming.panes import MINUTE, Panes, Progress, newest, read_panes, start_panes

#: Sums of a minute and action; with them come both minute tables.
REQUESTS = Panes(["recommended_action"], {
    "request_count": ("count(*)", "sum"), "latency_sum": ("sum(latency_ms)", "sum"),
    "latency_count": ("count(latency_ms)", "sum"), "last_request": ("max(timestamp)", "max")})


def minute_metrics(panes: DataFrame) -> DataFrame:
    """Requests and latency sums per minute, from panes per minute and action."""
    return panes.groupBy(F.col("pane").alias("minute")).agg(
        *[F.sum(name).alias(name) for name in ("request_count", "latency_sum", "latency_count")])


def minute_actions(panes: DataFrame) -> DataFrame:
    return panes.select(F.col("pane").alias("minute"), "recommended_action",
                        F.col("request_count").alias("action_count"))


def start_minutes(log: DataFrame, path: str, delay_minutes: int, checkpoint: str,
                  trigger: Mapping | None = None, heartbeat: DataFrame | None = None
                  ) -> StreamingQuery:
    """Keeps the minutes of a live log in ``path``; ``read_minutes`` gives them."""
    return start_panes(log, REQUESTS, path, delay_minutes, checkpoint, trigger, heartbeat)


def read_minutes(spark: SparkSession, path: str, **bounds) -> DataFrame:
    return read_panes(spark, path, REQUESTS, **bounds)


def _instant(micros: int) -> Column:
    return F.timestamp_micros(F.lit(micros))


def start_alerts(log: DataFrame, path: str, delay_minutes: int, checkpoint: str,
                 trigger: Mapping | None = None, heartbeat: DataFrame | None = None,
                 minutes: int = ALERT_MINUTES) -> StreamingQuery:
    """Keeps the minutes of a live log and evaluates each N-minute range once it is closed.

    With a ``heartbeat`` time goes on while the service is silent, so that its silence raises alerts
    without any later request.  A range that a late request belongs to is evaluated again.  Each
    micro-batch reads the minutes of the ranges in question, N - 1 before the first, and no others.
    ``path`` gets the minutes, in ``ranges`` the metrics of every range evaluated and in ``raised``
    the alerts of each micro-batch; ``read_alerts`` gives those of the last evaluations.
    """
    span = (minutes - 1) * MINUTE
    end = F.col("timestamp")

    def known(progress: Progress, since: int, until: int) -> DataFrame:
        return minute_metrics(read_minutes(progress.spark, path, since=since, until=until))

    def all_between(progress: Progress, begin: int, until: int) -> DataFrame:
        """Every range that ends after ``begin`` and not after ``until``."""
        return range_metrics(known(progress, begin - span, until), minutes, _instant(begin),
                             _instant(until - MINUTE)).filter(
            (end > _instant(begin)) & (end <= _instant(until)))

    def evaluated(progress: Progress) -> None:
        first, closed = progress.first, progress.closed
        if first is None or closed <= first:
            return
        # Ranges that end in (begin, before] have been evaluated.
        begin = closed if progress.first_before is None else progress.first_before
        before = begin if progress.before is None else max(begin, progress.before)
        parts = [all_between(progress, *between)
                 for between in ((first, min(begin, closed)), (before, closed))
                 if between[0] < between[1]]
        late_from, late_to = progress.late_from, progress.late_to
        if late_from is not None and begin < before:
            later = F.transform(F.sequence(F.lit(1), F.lit(minutes)),
                                lambda i: F.col("pane") + F.make_dt_interval(mins=i))
            again = progress.late.select(F.explode(later).alias("timestamp")).distinct().filter(
                (end > _instant(begin)) & (end <= _instant(before)))
            parts.append(range_metrics(
                known(progress, late_from - span, late_to + span + MINUTE), minutes,
                _instant(late_from), _instant(late_to)).join(again, "timestamp", "left_semi"))
        if not parts:
            return
        ranges = reduce(DataFrame.unionByName, parts)
        folder = batch_folder(progress.batch, f"{path}/ranges", progress.batch_id)
        ranges.write.mode("overwrite").parquet(folder)
        alerts(progress.spark.read.parquet(folder)).write.mode("overwrite").parquet(
            batch_folder(progress.batch, f"{path}/raised", progress.batch_id))

    return start_panes(log, REQUESTS, path, delay_minutes, checkpoint, trigger, heartbeat, evaluated)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of all closed ranges, each as it was evaluated last."""
    return alerts(newest(spark.read.parquet(f"{path}/ranges"), ["timestamp"]))
