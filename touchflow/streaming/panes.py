"""Windowed sums of a stream that keep rows however late they come.

A windowed aggregate in append mode drops what the watermark has passed.  Here each micro-batch
appends partial sums per pane of time to a table with day folders, and partial sums merge by
addition: a late row is one more partial sum.  The frontier, the latest instant seen before the
micro-batch less a delay, only says which panes are closed; rows behind it are also kept in full, with
the pane they missed.  Whoever evaluates closed panes is told which closed panes were touched again.

A pane's state is its rows in the table, at most one per key and micro-batch: nothing is held in
memory between micro-batches, and a repeated micro-batch replaces its own folders.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from touchflow.sources.streams import run_folder

MINUTE = 60_000_000
#: Merges of partial aggregates.
MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Panes:
    """What is kept per pane: the keys beside time, and named partial aggregates.

    ``sums`` maps a name to an SQL aggregate over rows and the merge of its partial values (``sum``,
    ``max`` or ``min``).
    """

    keys: Sequence[str]
    sums: Mapping[str, tuple[str, str]]
    minutes: int = 1
    at: str = "timestamp"

    @property
    def micros(self) -> int:
        return self.minutes * MINUTE

    def start(self) -> Column:
        """The start of the pane of a row, in microseconds."""
        moment = F.unix_micros(self.at)
        return moment - F.pmod(moment, F.lit(self.micros))

    def partial(self, rows: DataFrame, *more: Column) -> DataFrame:
        """One row per pane and key; rows without a time are in no pane."""
        return rows.filter(F.col(self.at).isNotNull()).groupBy(
            F.timestamp_micros(self.start()).alias("pane"), *self.keys, *more).agg(
            *[F.expr(sql).alias(name) for name, (sql, _) in self.sums.items()])

    def merged(self, partial: DataFrame) -> DataFrame:
        """One row per pane and key."""
        return partial.groupBy("pane", *self.keys).agg(
            *[MERGE[how](name).alias(name) for name, (_, how) in self.sums.items()])


@dataclass(frozen=True)
class Progress:
    """Where a micro-batch found and left the panes.

    Panes that end by ``closed`` are closed, ``first`` is the start of the first pane of all;
    ``before`` and ``first_before`` are the same ahead of the micro-batch.  All are in microseconds
    and null until a row has come.  ``late`` has the closed panes it added to (``pane`` and keys),
    which start from ``late_from`` to ``late_to``.
    """

    spark: SparkSession
    batch: DataFrame
    batch_id: int
    first: int | None
    first_before: int | None
    before: int | None
    closed: int | None
    late_from: int | None
    late_to: int | None
    late: DataFrame = field(repr=False)

def read_panes(spark: SparkSession, path: str, panes: Panes, since: int | None = None,
               until: int | None = None, on_time_only: bool = False) -> DataFrame:
    """Panes that start from ``since`` on and before ``until``, with all that came late.

    Reads the days in question only.  ``on_time_only`` leaves out what came after its pane was
    closed: what a stream that drops late rows would hold.
    """
    partial = spark.read.parquet(f"{path}/panes")
    if since is not None:
        begin = F.timestamp_micros(F.lit(since))
        partial = partial.filter((F.col("pane") >= begin) & (F.col("log_date") >= F.to_date(begin)))
    if until is not None:
        end = F.timestamp_micros(F.lit(until))
        partial = partial.filter((F.col("pane") < end) & (F.col("log_date") <= F.to_date(end)))
    if on_time_only:
        partial = partial.filter(~F.col("late"))
    return panes.merged(partial)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came after their pane was closed, in full, with ``missed``, its start."""
    return spark.read.parquet(f"{path}/late")


def write_batch(rows: DataFrame, path: str, batch_id: int, by_day: str | None = None) -> None:
    """Replaces the folders of a micro-batch below ``path``, a folder of its query."""
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
    folders = ["batch_id"]
    if by_day is not None:
        rows = rows.withColumn("log_date", F.to_date(by_day)).hint("rebalance", "log_date")
        folders = ["log_date", "batch_id"]
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*folders).parquet(path))


def start_panes(stream: DataFrame, panes: Panes, path: str, delay_minutes: int, checkpoint: str,
                trigger: Mapping | None = None, heartbeat: DataFrame | None = None,
                then: Callable[[Progress], None] | None = None) -> StreamingQuery:
    """Keeps the panes of a stream below ``path`` and calls ``then`` after each micro-batch.

    ``delay_minutes`` is how far behind the latest instant a pane stays open.  ``heartbeat`` is a stream of
    instants in the time column of the rows (a ``rate`` source, say): they add to no pane, but time
    goes on with them while no row comes.
    """
    rows = stream.withColumn("_beat", F.lit(False))
    if heartbeat is not None:
        rows = rows.unionByName(heartbeat.select(
            F.col(panes.at), F.lit(True).alias("_beat")), allowMissingColumns=True)

    def closed(latest: int | None) -> int | None:
        if latest is None:
            return None
        limit = latest - delay_minutes * MINUTE
        return limit - limit % panes.micros

    def kept(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        frontier = run_folder(batch, f"{path}/frontier")
        first_before, latest = (None, None) if batch_id == 0 else spark.read.parquet(
            f"{frontier}/batch_id={batch_id - 1}").first()
        before = closed(latest)
        held = batch.persist()
        try:
            behind = F.lit(False) if before is None else panes.start() < before
            rows = held.filter(~F.col("_beat")).drop("_beat").withColumn("late", behind)
            partial = panes.partial(rows, F.col("late")).persist()
            start = F.unix_micros("pane")
            behind = F.when(F.col("late"), start)
            seen, late_from, late_to = partial.agg(
                F.min(start), F.min(behind), F.max(behind)).first()
            newest = held.agg(F.unix_micros(F.max(panes.at))).first()[0]
            if seen is not None:
                write_batch(partial, run_folder(batch, f"{path}/panes"), batch_id, "pane")
            if late_from is not None:
                write_batch(rows.filter("late").drop("late").withColumn(
                    "missed", F.timestamp_micros(panes.start())),
                    run_folder(batch, f"{path}/late"), batch_id)
            first = min((m for m in (first_before, seen) if m is not None), default=None)
            latest = max((m for m in (latest, newest) if m is not None), default=None)
            if then is not None:
                then(Progress(spark, batch, batch_id, first, first_before, before, closed(latest),
                              late_from, late_to,
                              partial.filter("late").select("pane", *panes.keys)))
            spark.createDataFrame([(first, latest)], "first long, latest long").coalesce(1) \
                .write.mode("overwrite").parquet(f"{frontier}/batch_id={batch_id}")
            partial.unpersist()
        finally:
            held.unpersist()

    writer = rows.writeStream.foreachBatch(kept).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows that micro-batches evaluated again the last ones, by ``batch_id``."""
    others = [name for name in rows.columns if name not in (*keys, "run_id", "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_last")).select(
        *keys, *[F.col(f"_last.{name}").alias(name) for name in others])
