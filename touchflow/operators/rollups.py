"""Service metrics kept as tables per minute, hour and day.

Every level is filled from the level below, for closed hours and days only, and sums merge by addition.
A question about the last N minutes reads whole days and hours where it can and minutes at both ends,
so at most about 120 minutes and 48 hours, and never the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from touchflow.operators.monitoring import (
    METRICS_MINUTES, RETENTION_SECONDS, moment, totals_of_actions,
)
from touchflow.sources.tables import append_log

SCHEMA = ("start timestamp, recommended_action string, n bigint, latency double, last timestamp, "
          "log_date date, batch_id string")


def read_level(spark: SparkSession, path: str, unit: str) -> DataFrame:
    """The rows of a level; a minute has one per action and call, an hour or day one per action."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/{unit}")


def _merged(rows: DataFrame, unit: str) -> DataFrame:
    return rows.groupBy(F.date_trunc(unit, "start").alias("start"), "recommended_action").agg(
        F.sum("n").alias("n"), F.sum("latency").alias("latency"), F.max("last").alias("last"))


def _between(table: DataFrame, column: str, first: Column | None, last: Column) -> DataFrame:
    """Rows after ``first`` and up to ``last``, of these days only where there are folders."""
    rows = table.filter(F.col(column) <= last)
    if first is not None:
        rows = rows.filter(F.col(column) > first)
    if "log_date" in table.columns:
        rows = rows.filter(F.col("log_date") <= F.to_date(last))
        if first is not None:
            rows = rows.filter(F.col("log_date") >= F.to_date(first))
    return rows


def roll_up(log: DataFrame, path: str, until: str, since: str | None = None,
            at: str = "timestamp") -> None:
    """Adds the rows of a log after ``since`` and up to ``until`` to the tables in ``path``.

    Calls follow each other, each from where the one before ended; rows that are logged later than
    that are not seen (``streaming.alerts`` keeps those).  A repeated call replaces what it wrote.
    """
    spark = log.sparkSession
    last, first = moment(until), None if since is None else moment(since)
    unknown = F.coalesce("recommended_action", F.lit("unknown")).alias("recommended_action")
    minutes = _between(log, at, first, last).groupBy(
        F.date_trunc("minute", at).alias("start"), unknown).agg(
        F.count("*").alias("n"), F.sum("latency_ms").alias("latency"), F.max(at).alias("last"))
    batch = until.replace(" ", "T").replace(":", "")
    append_log(minutes, f"{path}/minute", "start", batch)
    for below, unit in (("minute", "hour"), ("hour", "day")):
        rows = read_level(spark, path, below)
        # Closed by this call: what ends after ``since`` and not after ``until``.
        end, begin = F.date_trunc(unit, last), None if first is None else F.date_trunc(unit, first)
        closed = rows.filter((F.col("start") < end) & (F.col("log_date") <= F.to_date(end)))
        if begin is not None:
            closed = closed.filter((F.col("start") >= begin)
                                   & (F.col("log_date") >= F.to_date(begin)))
        append_log(_merged(closed, unit), f"{path}/{unit}", "start", batch)


def _up(instant: Column, unit: str) -> Column:
    """The start of the next hour or day, unless it is one."""
    floor = F.date_trunc(unit, instant)
    return F.when(floor == instant, instant).otherwise(floor + F.expr(f"INTERVAL 1 {unit}"))


def rolling_metrics_of_rollups(spark: SparkSession, path: str, now: Column | str,
                               minutes: int = METRICS_MINUTES,
                               retention_seconds: int = RETENTION_SECONDS) -> DataFrame:
    """``rolling_metrics`` from the tables that ``roll_up`` has filled up to ``now``."""
    end = moment(now)
    start = F.date_trunc("minute", end) - F.make_dt_interval(mins=F.lit(minutes - 1))
    expired = F.timestamp_micros(F.unix_micros(end) - F.lit(retention_seconds * 1_000_000))
    # The minute in which the retention begins counts if its last request is young enough.
    edge = F.date_trunc("minute", expired)
    first = F.greatest(start, edge)
    whole = F.when(edge >= start, first + F.expr("INTERVAL 1 MINUTE")).otherwise(first)
    hours = _up(whole, "hour"), F.greatest(F.date_trunc("hour", end), _up(whole, "hour"))
    days = _up(hours[0], "day"), F.greatest(F.date_trunc("day", hours[1]), _up(hours[0], "day"))

    def level(unit: str, begin: Column, stop: Column, inner: tuple[Column, Column] | None):
        """Rows from ``begin`` on and before ``stop`` that no higher level has."""
        at, day = F.col("start"), F.col("log_date")
        rows = read_level(spark, path, unit).filter(
            (at >= begin) & (at < stop) & day.between(F.to_date(begin), F.to_date(stop)))
        return rows if inner is None else rows.filter((at < inner[0]) | (at >= inner[1]))

    of_minutes = _merged(level("minute", first, end + F.expr("INTERVAL 1 MINUTE"), hours), "minute") \
        .withColumn("last", F.max("last").over(Window.partitionBy("start"))) \
        .filter(F.col("last") > expired)
    parts = of_minutes.select("recommended_action", "n", "latency")
    for more in (level("hour", *hours, days), level("day", *days, None)):
        parts = parts.unionByName(more.select("recommended_action", "n", "latency"))
    return totals_of_actions(parts, end)
