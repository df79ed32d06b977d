"""Customer activity over sliding event-time windows, for tables and streams alike."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from touchflow.sources.streams import batch_folder
from touchflow.streaming.panes import MINUTE, Panes, Progress, newest, read_panes, start_panes

# Window length and slide in minutes.
WINDOW_MINUTES = 5
SLIDE_MINUTES = 1

# Window lengths per block of the timeline, see sliding_activity.
_LENGTHS_PER_BLOCK = 12


def _windows_in_place(panes: DataFrame, window_minutes: int, slide_minutes: int) -> DataFrame:
    """The panes of each window, hashed by customer and block of time.

    A block holds the windows that start in it; a pane is sent to each block (one or two) that
    has windows covering it.  A customer's panes of a block are one list, ordered by channel.
    Successive windows with the same panes share a row: those that start from ``_first`` on and
    before ``_until``.
    """
    slide = F.lit(slide_minutes * MINUTE)
    span = F.lit(slide_minutes * -(-window_minutes // slide_minutes) * MINUTE * _LENGTHS_PER_BLOCK)
    earliest = F.unix_micros("pane.end") - F.lit(window_minutes * MINUTE)
    start = F.unix_micros("pane.start")
    first, last, block = F.col("_first"), F.col("_last"), F.col("_block")
    entry = F.struct(
        "channel", "n", "last_activity", F.greatest(first, block).alias("first"),
        F.least(last, block + span - slide).alias("last"))
    blocks = (
        panes.withColumn("_first", earliest + F.pmod(-earliest, slide))
        .withColumn("_last", start - F.pmod(start, slide))
        .filter(first <= last)
        .withColumn("_block", F.explode(F.array_distinct(F.array(
            first - F.pmod(first, span), last - F.pmod(last, span)))))
        .repartition("customer_id", "_block")
        .groupBy("customer_id", "_block")
        .agg(F.array_sort(F.collect_list(entry)).alias("_panes"))
    )
    # Where windows begin or cease to cover a pane.
    cuts = F.array_sort(F.array_distinct(F.concat(
        F.col("_panes.first"), F.transform("_panes", lambda p: p["last"] + slide))))
    pairs = F.transform(F.slice("_cuts", 2, F.size("_cuts")), lambda until, i: F.struct(
        F.get("_cuts", i).alias("_first"), until.alias("_until")))
    covering = F.filter("_panes", lambda p: (p["first"] <= first) & (p["last"] >= first))
    return blocks.withColumn("_cuts", cuts).select(
        "customer_id", "_panes", F.inline(pairs)).withColumn("_panes", covering)


def activity_panes(window_minutes: int = WINDOW_MINUTES, slide_minutes: int = SLIDE_MINUTES,
                   at: str = "timestamp") -> Panes:
    """Events of a customer and channel in the longest pane that all windows are made of."""
    return Panes(["customer_id", "channel"], {
        "n": ("count(*)", "sum"), "last_activity": (f"max(`{at}`)", "max")},
        gcd(window_minutes, slide_minutes), at)


def _sums() -> tuple[Column, ...]:
    # collect_list ignores null entries: events without a channel count but are not listed.
    used = F.when(F.col("channel").isNotNull(), F.struct("channel", "n"))
    return (F.sum("n").alias("event_count"), F.collect_list(used).alias("_used"),
            F.max("last_activity").alias("last_activity"))


def _shaped(windows: DataFrame, spell_out: bool, *at: str) -> DataFrame:
    channels = _spelled() if spell_out else _counted()
    return windows.select(*at, "customer_id", "event_count", channels, "last_activity")


def windows_of_panes(panes: DataFrame, window_minutes: int = WINDOW_MINUTES,
                     slide_minutes: int = SLIDE_MINUTES, spell_out: bool = False) -> DataFrame:
    """The windows that a table of panes (``pane`` is a struct of start and end) adds up to."""
    slide = F.lit(slide_minutes * MINUTE)
    starts = F.sequence("_first", F.col("_until") - slide, slide)
    sums = _windows_in_place(panes, window_minutes, slide_minutes).select(
        "customer_id", F.when(F.size("_panes") > 0, starts).alias("_starts"),
        F.aggregate("_panes", F.lit(0).cast("long"), lambda total, p: total + p["n"])
        .alias("event_count"),
        F.filter("_panes", lambda p: p["channel"].isNotNull()).alias("_used"),
        F.array_max(F.col("_panes.last_activity")).alias("last_activity"))
    # The windows of a row are spelled out last.
    shaped = _shaped(sums, spell_out, "_starts")
    end = F.col("_start") + window_minutes * MINUTE
    window = F.struct(F.timestamp_micros("_start").alias("start"),
                      F.timestamp_micros(end).alias("end"))
    return shaped.withColumn("_start", F.explode("_starts")).select(
        window.alias("window"), *shaped.columns[1:])


def sliding_activity(events: DataFrame, window_minutes: int = WINDOW_MINUTES,
                     slide_minutes: int = SLIDE_MINUTES, watermark: str | None = None,
                     at: str = "timestamp", spell_out: bool = False) -> DataFrame:
    """Per window and customer: event count, count of each channel and last activity.

    Events are first counted in panes (minutes, customer, channel), and the panes are then added
    up into the windows that cover them.  Busy customers so shrink before rows multiply, and
    neither step holds a list of events: the state is one count per pane and channel.  On a table
    the panes are hashed by customer and block of time, so that the ``window / slide`` windows of a
    pane are added up in place, without another shuffle: from a list of the block's panes, at most
    one per channel and pane of time.

    ``channel_counts`` maps each channel to its events; its size is that of the channel set.  With
    ``spell_out``, ``channels_used`` lists the channel of every event in its place, sorted, repeats
    kept: for windows known to be small, as the list is as long as the window has events.

    A stream needs ``watermark``, the longest delay of an event; later events are dropped and
    windows are final once the watermark passes them.  ``start_sliding_activity`` keeps late events.
    """
    if watermark is not None:
        events = events.withWatermark(at, watermark)
    pane = f"{gcd(window_minutes, slide_minutes)} minutes"
    panes = (
        events.groupBy(F.window(at, pane).alias("pane"), "customer_id", "channel")
        .agg(F.count("*").alias("n"), F.max(at).alias("last_activity"))
    )
    if not events.isStreaming:
        return windows_of_panes(panes, window_minutes, slide_minutes, spell_out)
    covering = F.window("pane", f"{window_minutes} minutes", f"{slide_minutes} minutes")
    windows = panes.groupBy(covering.alias("window"), "customer_id").agg(*_sums())
    return _shaped(windows, spell_out, "window")


def start_sliding_activity(events: DataFrame, path: str, delay_minutes: int, checkpoint: str,
                           trigger: Mapping | None = None, heartbeat: DataFrame | None = None,
                           window_minutes: int = WINDOW_MINUTES,
                           slide_minutes: int = SLIDE_MINUTES, at: str = "timestamp",
                           spell_out: bool = False) -> StreamingQuery:
    """Keeps panes and closed windows of an event stream in ``path``; no event is too late.

    A window is written once its last pane is closed, and again, for the customers concerned, when
    a late event falls into it; these are kept in folders of their own (``again``).  ``read_windows``
    gives a window's last state.  A micro-batch reads the panes of the windows that it closes, and of
    the late customers those around their late panes.
    """
    panes = activity_panes(window_minutes, slide_minutes, at)
    length = window_minutes * MINUTE

    def windows(found: DataFrame) -> DataFrame:
        span = F.col("pane") + F.make_dt_interval(mins=F.lit(panes.minutes))
        return windows_of_panes(found.withColumn("pane", F.struct(
            F.col("pane").alias("start"), span.alias("end"))), window_minutes, slide_minutes,
            spell_out)

    def written(progress: Progress) -> None:
        closed, before = progress.closed, progress.before
        if closed is None:
            return
        end = F.unix_micros("window.end")

        def write(found: DataFrame, again: bool) -> None:
            folder = batch_folder(progress.batch, f"{path}/windows", progress.batch_id)
            found.write.mode("overwrite").parquet(f"{folder}/again={str(again).lower()}")

        if before is None or closed > before:
            since = None if before is None else before - length
            fresh = windows(read_panes(progress.spark, path, panes, since, closed))
            write(fresh.filter((end <= closed) & (F.lit(True) if before is None
                                                  else end > before)), False)
        late_from, late_to = progress.late_from, progress.late_to
        if late_from is not None:
            late = progress.late.select("customer_id", F.unix_micros("pane").alias("_pane"))
            near = read_panes(progress.spark, path, panes, late_from - length, late_to + length) \
                .join(late.select("customer_id").distinct(), "customer_id", "left_semi")
            step, size = F.lit(slide_minutes * MINUTE), F.lit(panes.micros)
            last = F.col("_pane") - F.pmod("_pane", step)
            least = F.col("_pane") + size - F.lit(length)
            least = least + F.pmod(-least, step)
            touched = late.filter(least <= last).select("customer_id", F.explode(
                F.sequence(least, last, step)).alias("_start")).distinct()
            again = windows(near).filter(end <= before).withColumn(
                "_start", F.unix_micros("window.start"))
            write(again.join(touched, ["customer_id", "_start"], "left_semi").drop("_start"), True)

    return start_panes(events, panes, path, delay_minutes, checkpoint, trigger, heartbeat, written)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The closed windows, each as it was written last.

    A query writes a window once but for those in the folders ``again``: where there are none, and one
    query has written to ``path``, no window is compared.
    """
    rows = spark.read.parquet(f"{path}/windows").withColumn("again", F.col("again").cast("boolean"))
    parts = rows.select("run_id", "again").distinct().collect()
    if len(parts) == 1 and not parts[0]["again"]:
        return rows.drop("run_id", "batch_id", "again")
    return newest(rows.drop("again"), ["window", "customer_id"])


def _spelled() -> Column:
    names = F.transform("_used", lambda u: F.array_repeat(u["channel"], u["n"].cast("int")))
    return F.array_sort(F.flatten(names)).alias("channels_used")


def _counted() -> Column:
    names = F.array_sort(F.array_distinct(F.transform("_used", lambda u: u["channel"])))
    totals = F.transform(names, lambda name: F.aggregate(
        "_used", F.lit(0).cast("long"),
        lambda total, u: total + F.when(u["channel"] == name, u["n"]).otherwise(0)))
    return F.map_from_arrays(names, totals).alias("channel_counts")
