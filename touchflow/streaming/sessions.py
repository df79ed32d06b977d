"""Sessions of an event stream, kept as a table with one folder per micro-batch."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from touchflow.sources.streams import run_folder
from touchflow.streaming.panes import (
    MINUTE, Panes, Progress, newest, read_panes, start_panes, write_batch,
)

DAY = 1440 * MINUTE


def session_panes(session_col: str = "session_id", at: str = "timestamp",
                  view_type: str = "view", pane_minutes: int = 60) -> Panes:
    """Start and page views of a session within a stretch of time."""
    return Panes([session_col], {
        "start_time": (f"min(`{at}`)", "min"),
        "page_views": (f"count_if(event_type = '{view_type}')", "sum")}, pane_minutes, at)


def _sessions(panes: DataFrame, session_col: str) -> DataFrame:
    """As ``build_sessions`` has them, from panes."""
    return panes.groupBy(session_col).agg(
        F.min("start_time").alias("start_time"), F.sum("page_views").alias("page_views")).filter(
        F.col("page_views") > 0)


def start_sessions(events: DataFrame, path: str, delay_minutes: int, checkpoint: str,
                   trigger: Mapping | None = None, heartbeat: DataFrame | None = None,
                   session_col: str = "session_id", view_type: str = "view",
                   pane_minutes: int = 60, max_session_days: int = 1) -> StreamingQuery:
    """Appends to the session table in ``path`` what the closed panes of a stream add to it.

    A session that went on in a closed pane, or that a late event belongs to, is written (again);
    ``read_sessions`` gives its last state.  Only sessions touched since the micro-batch before are
    computed, from the panes of ``max_session_days`` before, the longest time that a session lasts.
    """
    panes = session_panes(session_col, view_type=view_type, pane_minutes=pane_minutes)

    def written(progress: Progress) -> None:
        closed, before = progress.closed, progress.before
        if closed is None:
            return
        touched = read_panes(progress.spark, path, panes, before, closed).select(session_col)
        since = before
        if progress.late_from is not None:
            touched = touched.unionByName(progress.late.select(session_col))
            since = min(before, progress.late_from)
        if since is not None:
            since -= max_session_days * DAY
        # A session that began late in the micro-batch before is not closed yet.
        near = read_panes(progress.spark, path, panes, since, closed).join(
            touched.distinct(), session_col, "left_semi")
        write_batch(_sessions(near, session_col), run_folder(progress.batch, f"{path}/sessions"),
                    progress.batch_id, "start_time")

    rows = events.filter(F.col(session_col).isNotNull())
    return start_panes(rows, panes, path, delay_minutes, checkpoint, trigger, heartbeat, written)


def read_sessions(spark: SparkSession, path: str, session_col: str = "session_id") -> DataFrame:
    """The sessions of closed panes, each as it was written last, with ``log_date``, its day."""
    rows = newest(spark.read.parquet(f"{path}/sessions").drop("log_date"), [session_col])
    return rows.withColumn("log_date", F.to_date("start_time"))
