"""Features of requests: stored values with expiry, sessions, request time and context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from touchflow.functions.scalars import elapsed_seconds, is_weekend
from touchflow.schemas import FEATURE_NAMES
from touchflow.sources.tables import append_log

# Fixed value: lifetime of a stored feature.
FEATURE_TTL_SECONDS = 3600


# -- stored features ----------------------------------------------------------------------------

def feature_writes(table: DataFrame, features: Sequence[str], *, written_at: str = "written_at",
                   ttl_seconds: int = FEATURE_TTL_SECONDS,
                   key: str = "customer_id") -> DataFrame:
    """Wide rows to one write per feature, ready to append to the store table."""
    values = [F.col(name).cast("string").alias(name) for name in features]
    return (table.select(key, F.col(written_at).alias("written_at"), *values)
            .unpivot([key, "written_at"], list(features), "feature", "value")
            .withColumn("ttl_s", F.lit(ttl_seconds).cast("long")))


def _expiry(written_at: Column, ttl_s: Column) -> Column:
    return F.unix_micros(written_at) + ttl_s * 1_000_000


def latest_features(writes: DataFrame, as_of: Column | str | None = None,
                    key: str = "customer_id") -> DataFrame:
    """Current value per (key, feature): the last write, if ``as_of`` is before its expiry.

    An expired last write hides older ones.  Writes at one instant are ordered by value.
    """
    seen = writes
    moment = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    if moment is not None:
        seen = writes.filter(F.col("written_at") <= moment)
    last = seen.groupBy(key, "feature").agg(
        F.max(F.struct("written_at", "value", "ttl_s")).alias("w"))
    rows = last.select(key, "feature", "w.value", "w.written_at", "w.ttl_s")
    if moment is None:
        return rows
    return rows.filter(F.unix_micros(moment) < _expiry(F.col("written_at"), F.col("ttl_s")))


def in_days(table: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows of the days from first to last; prunes folders if the table has a ``log_date``."""
    if "log_date" not in table.columns:
        return table
    return table.filter(F.col("log_date").between(F.to_date(first), F.to_date(last)))


def _at_most(ttl: Column, seconds: int) -> Column:
    """True; an error where a lifetime is longer."""
    return F.when(ttl > seconds, F.raise_error(F.concat(
        F.lit(f"ttl_s above max_ttl_seconds={seconds}: "), ttl.cast("string"))).cast("boolean")
    ).otherwise(F.lit(True))


def append_features(writes: DataFrame, path: str, max_ttl_seconds: int,
                    compacted_before: str | None = None) -> None:
    """Appends writes to a store with day folders.

    A lifetime above the store's bound is refused, and so is a write of a day that is compacted
    already (``compact_features``).
    """
    allowed = _at_most(F.col("ttl_s"), max_ttl_seconds)
    if compacted_before is not None:
        allowed = allowed & F.when(
            F.to_date("written_at") < F.lit(compacted_before).cast("date"),
            F.raise_error(F.lit(f"a write before {compacted_before}")).cast("boolean")
        ).otherwise(F.lit(True))
    append_log(writes.filter(allowed), path, "written_at")


def compact_features(spark: SparkSession, path: str, base: str, before: str,
                     previous: str | None = None, key: str = "customer_id") -> None:
    """Writes the base of day ``before``: of all earlier writes the last of each key and feature, if
    it is still alive at the beginning of that day.

    The base of the day ``previous`` stands for all before it, so that each day is compacted once.
    A repeated call replaces its base; older bases and day folders are left to answer older requests.
    """
    start = F.lit(before).cast("timestamp")
    closed = latest_features(
        read_features(spark, path, base, previous).filter(F.col("log_date") < F.to_date(start)),
        key=key)
    alive = closed.filter(F.unix_micros(start) < _expiry(F.col("written_at"), F.col("ttl_s")))
    alive.write.mode("overwrite").parquet(f"{base}/before={before}")


def read_features(spark: SparkSession, path: str, base: str, before: str | None = None
                  ) -> DataFrame:
    """The writes of a store that count from the beginning of the day ``before`` on: its base and the
    day folders from there on.  Lookups of that time give the same as from all writes."""
    days = spark.read.parquet(path)
    if before is None:
        return days
    kept = spark.read.parquet(f"{base}/before={before}").withColumn(
        "log_date", F.to_date("written_at"))
    return days.filter(F.col("log_date") >= F.lit(before).cast("date")).unionByName(
        kept.select(*days.columns))


def lookup_features(requests: DataFrame, writes: DataFrame, features: Sequence[str], *,
                    key: str = "customer_id", at: str = "timestamp",
                    slice_seconds: int = 900, max_ttl_seconds: int | None = None,
                    requested_keys_only: bool = False) -> DataFrame:
    """Requests with the value of each stored feature as of the request, in ``stored_<name>``.

    A write counts from its own instant on and has expired at ``written_at + ttl_s``.  Requests
    and writes are merged in time order and the last write is carried forward: linear, no range
    join.  As one key may hold a large part of all rows, a key's timeline is cut into slices.
    Each slice is scanned on its own; what it inherits is the last write of any earlier slice,
    found on a table with one row per key and slice.  The merged rows are shuffled once, by
    (key, slice), for both the join with the inherited values and the scan.

    For few requests against a large store (a micro-batch), two options read less of it with the
    same result: ``max_ttl_seconds``, the longest lifetime in the store, limits the scan to writes
    that can still be alive, of a store with day folders (``log_date``) to those of the days in
    question, and ``requested_keys_only`` drops the other keys of these writes.  A longer lifetime
    in a row that is read is an error; ``append_features`` keeps such rows out of the store.
    """
    if max_ttl_seconds is not None:
        first, last = (requests.agg(bound(at)).scalar() for bound in (F.min, F.max))
        oldest = F.timestamp_micros(F.unix_micros(first) - F.lit(max_ttl_seconds * 1_000_000))
        writes = in_days(writes, oldest, last).filter(
            _at_most(F.col("ttl_s"), max_ttl_seconds)
            & (F.col("written_at") > oldest) & (F.col("written_at") <= last))
    if requested_keys_only:
        writes = writes.join(requests.select(key).distinct(), key, "left_semi")
    slots = {name: f"_f{i}" for i, name in enumerate(features)}

    def slice_of(moment: str) -> Column:
        return F.floor(F.unix_seconds(F.col(moment)) / slice_seconds)

    write = F.struct("written_at", "value", "ttl_s")
    entries = [F.when(F.col("feature") == name, write).alias(slot)
               for name, slot in slots.items()]
    stored = writes.filter(F.col("feature").isin(*features)).select(
        F.col(key).alias("_key"), slice_of("written_at").alias("_slice"),
        F.col("written_at").alias("_at"), F.lit(0).alias("_order"), *entries)
    asked = requests.select(
        F.col(key).alias("_key"), slice_of(at).alias("_slice"), F.col(at).alias("_at"),
        F.lit(1).alias("_order"), F.struct(*requests.columns).alias("_request"))
    timeline = stored.unionByName(asked, allowMissingColumns=True)

    # From keys and times alone: what the requests carry is not read a second time.
    slices = stored.drop("_at", "_order").unionByName(
        requests.select(F.col(key).alias("_key"), slice_of(at).alias("_slice")).distinct(),
        allowMissingColumns=True)
    tails = slices.groupBy("_key", "_slice").agg(
        *[F.max(slot).alias(slot) for slot in slots.values()])
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    inherited = tails.select("_key", "_slice", *[
        F.last(slot, ignorenulls=True).over(earlier).alias(f"{slot}_before")
        for slot in slots.values()])

    so_far = (Window.partitionBy("_key", "_slice")
              .orderBy("_at", "_order", *[f"{slot}.{part}" for slot in slots.values()
                                          for part in ("value", "ttl_s")])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    scanned = timeline.join(inherited, ["_key", "_slice"], "left").select(
        "_at", "_request", *[
            F.coalesce(F.last(slot, ignorenulls=True).over(so_far),
                       F.col(f"{slot}_before")).alias(slot)
            for slot in slots.values()])
    live = [F.when(F.unix_micros("_at") < _expiry(F.col(f"{slot}.written_at"),
                                                  F.col(f"{slot}.ttl_s")),
                   F.col(f"{slot}.value")).alias(f"stored_{name}")
            for name, slot in slots.items()]
    return scanned.filter(F.col("_request").isNotNull()).select("_request.*", *live)


# -- sessions -----------------------------------------------------------------------------------

def build_sessions(events: DataFrame, session_col: str = "session_id",
                   at: str = "timestamp", view_type: str = "view") -> DataFrame:
    """Start and page views of each session that viewed a page."""
    views = F.count_if(F.col("event_type") == view_type)
    return (events.filter(F.col(session_col).isNotNull()).groupBy(session_col)
            .agg(F.min(at).alias("start_time"), views.alias("page_views"))
            .filter(F.col("page_views") > 0))


def session_features(requests: DataFrame, sessions: DataFrame, at: str = "timestamp",
                     max_session_days: int | None = None) -> DataFrame:
    """Adds ``session_duration`` in seconds and ``page_views``.

    Both are 0 for an unknown session and null if the request names none, which leaves the place
    to stored values.  ``sessions`` has one row per id, so a hot session skews the request side
    only, and adaptive execution splits that side of the join.  Requests without a session match
    nothing; a second key spreads them over the tasks.

    For a micro-batch against a session table with day folders, ``max_session_days``, the longest
    time from a session's start to a request that names it, limits the scan to the days in question.
    """
    if max_session_days is not None:
        first, last = (requests.agg(bound(at)).scalar() for bound in (F.min, F.max))
        sessions = in_days(sessions, F.date_sub(first, max_session_days), last)
    session = F.nullif(F.col("session_id"), F.lit(""))
    named = session.isNotNull()
    known = sessions.select(
        F.col("session_id").alias("_session"), F.lit(0).cast("long").alias("_spread"),
        F.col("start_time").alias("_start"), F.col("page_views").cast("long").alias("_views"))
    keyed = requests.withColumn("_session", session).withColumn(
        "_spread", F.when(named, F.lit(0).cast("long")).otherwise(
            F.pmod(F.xxhash64(at), F.lit(1024))))
    zero = F.lit(0).cast("long")
    duration = elapsed_seconds(F.col("_start"), F.col(at))
    return (keyed.join(known, ["_session", "_spread"], "left")
            .withColumn("session_duration", F.when(named, F.coalesce(duration, zero)))
            .withColumn("page_views", F.when(named, F.coalesce("_views", zero)))
            .drop("_session", "_spread", "_start", "_views"))


# -- request time and context -------------------------------------------------------------------

def time_features(events: DataFrame, at: str = "timestamp") -> DataFrame:
    """Event-side encoding: day_of_week 1..7 from Sunday."""
    moment = F.col(at)
    return (events.withColumn("hour_of_day", F.hour(moment))
            .withColumn("day_of_week", F.dayofweek(moment))
            .withColumn("is_weekend", is_weekend(moment)))


def request_time_features(requests: DataFrame, at: str = "timestamp") -> DataFrame:
    """Request-side encoding: day_of_week 0..6 from Monday."""
    moment = F.col(at)
    return (requests.withColumn("hour_of_day", F.hour(moment))
            .withColumn("day_of_week", F.weekday(moment))
            .withColumn("is_weekend", F.when(F.weekday(moment) >= 5, 1).otherwise(0)))


def context_features(requests: DataFrame) -> DataFrame:
    """``channel``, ``region``, ``brand`` and ``session_id`` of the request.

    The context map wins over the request's own fields; what neither names is ``unknown`` (an
    absent session stays null).
    """
    def from_context(name):
        return F.try_element_at(F.col("channel_context"), F.lit(name))

    unknown = F.lit("unknown")
    return (requests
            .withColumn("channel", F.coalesce(from_context("channel"), unknown))
            .withColumn("region", F.coalesce(from_context("region"), "region", unknown))
            .withColumn("brand", F.coalesce(from_context("brand"), "brand", unknown))
            .withColumn("session_id",
                        F.nullif(F.coalesce(from_context("session_id"), "session_id"),
                                 F.lit(""))))


def merge_features(table: DataFrame, features: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Per feature: the request's own value if there is one, else ``stored_<name>``.

    Stored values are text.  Where the request's value is a number, so is the merged one, and
    stored text that is no number counts as missing.
    """
    kinds = dict(table.dtypes)
    merged = {}
    for name in features:
        own, stored = F.col(name), F.col(f"stored_{name}")
        if f"stored_{name}" not in kinds:
            merged[name] = own if name in kinds else F.lit(None).cast("string")
        elif name not in kinds:
            merged[name] = stored
        elif kinds[name] == "string":
            merged[name] = F.coalesce(own, stored)
        else:
            merged[name] = F.coalesce(own.cast("double"), stored.try_cast("double"))
    return table.withColumns(merged).drop(*[f"stored_{name}" for name in features])


# -- model input --------------------------------------------------------------------------------

def feature_vector(table: DataFrame, labels: Mapping[str, DataFrame | Sequence[str]],
                   features: Sequence[str] = FEATURE_NAMES,
                   output: str = "features") -> DataFrame:
    """Array of doubles in the configured order.

    A text feature becomes its 1-based position among its labels, 0 for any other text.  Labels
    taken from data are a stored table (see ``labels``), joined however Catalyst sees fit; a fixed
    code list may be given as a sequence.  Missing values are 0.
    """
    entries, joined = [], table
    for name in features:
        known = labels.get(name)
        if known is None:
            value = F.col(name)
        elif isinstance(known, DataFrame):
            number = f"_position_{name}"
            joined = joined.join(known.select(F.col("label").alias(f"_label_{name}"),
                                              F.col("position").alias(number)),
                                 F.col(name) == F.col(f"_label_{name}"), "left")
            value = F.col(number)
        else:
            codes = F.array(*[F.lit(label) for label in known]).cast("array<string>")
            value = F.array_position(codes, F.col(name))
        entries.append(F.coalesce(value.cast("double"), F.lit(0.0)))
    return joined.withColumn(output, F.array(*entries)).select(*table.columns, output)
