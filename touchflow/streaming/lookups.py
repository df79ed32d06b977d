"""Stored features as state of the stream that writes and asks for them."""

from __future__ import annotations

import pickle
import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, ListState, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)
from pyspark.sql.types import MapType, StringType, StructField, StructType

# The processor first runs in a Python process that the driver's JVM starts, which sees neither the
# driver's module path nor files added to the session.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Entries of a key in one element of its state.
_PACK = 1000


def _rank(write: Sequence) -> tuple:
    """Order of writes at one instant: by value, null first, then by lifetime."""
    value, ttl = write
    return value is not None, value or "", ttl


class _Lookup(StatefulProcessor):
    """Of one key the writes that a request may still need, and the requests not yet answered."""

    def __init__(self, features: Sequence[str], request: StructType) -> None:
        self.features, self.request = list(features), request
        self.row = Row(*request.names, *[f"stored_{name}" for name in features])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The JVM takes each element of a list by itself, so an element holds many entries.
        self.writes = handle.getListState("writes", "pack binary")
        self.pending = handle.getListState("pending", "pack binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues
                        ) -> Iterator[Row]:
        fresh, asked = [], []
        for row in rows:
            if row["_feature"] is not None:
                fresh.append((row["_feature"], row["_micros"], row["_value"], row["_ttl"]))
            elif row["_request"] is not None:
                asked.append((row["_micros"], self._columns(row["_request"])))
        if fresh:  # a key that nobody asks for is forgotten as well
            self.handle.registerTimer(max(
                at // 1000 + ttl * 1000 for _, at, _, ttl in fresh) + 1)
        return self._answers(timerValues.getCurrentWatermarkInMs(), fresh, asked)

    def _columns(self, request: dict | Row) -> list:
        """A request's values in order; it comes as a dictionary, and its maps as lists of pairs."""
        values = (request[name] for name in self.request.names)
        return [dict(value) if isinstance(field.dataType, MapType) and value is not None else value
                for field, value in zip(self.request.fields, values)]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        return self._answers(timerValues.getCurrentWatermarkInMs())

    def _answers(self, watermark: int, fresh: Sequence[tuple] = (), asked: Sequence[tuple] = ()
                 ) -> Iterator[Row]:
        """Answers the requests that the watermark has passed and forgets what no other one needs.

        ``fresh`` writes and ``asked`` requests are not in the state yet.
        """
        passed = watermark * 1000
        due, later = [], []
        held = self._entries(self.pending)
        for entry in (*held, *asked):
            (due if entry[0] < passed else later).append(entry)
        stored = self._entries(self.writes)
        best: dict[tuple[str, int], tuple[str | None, int]] = {}
        for feature, at, *write in (*stored, *fresh):
            if (feature, at) not in best or _rank(write) > _rank(best[feature, at]):
                best[feature, at] = tuple(write)
        known: dict[str, list[tuple[int, str | None, int]]] = {f: [] for f in self.features}
        for (feature, at), (value, ttl) in best.items():
            known[feature].append((at, value, ttl))
        kept = []
        for feature, writes in known.items():
            writes.sort(key=lambda w: w[0])
            # Up to the watermark only the last write counts, until it has expired.
            last = bisect_right(writes, passed, key=lambda w: w[0]) - 1
            kept += [(feature, at, value, ttl) for i, (at, value, ttl) in enumerate(writes)
                     if i > last or i == last and at + ttl * 1_000_000 > passed]
        self._keep(self.writes, stored, fresh, kept)
        self._keep(self.pending, held, asked, later)
        if later:
            self.handle.registerTimer(min(at for at, _ in later) // 1000 + 1)
        for at, request in due:
            values = []
            for feature in self.features:
                writes = known[feature]
                i = bisect_right(writes, at, key=lambda w: w[0]) - 1
                live = i >= 0 and at < writes[i][0] + writes[i][2] * 1_000_000
                values.append(writes[i][1] if live else None)
            yield self.row(*request, *values)

    @staticmethod
    def _entries(state: ListState) -> list[tuple]:
        return [entry for (pack,) in state.get() for entry in pickle.loads(pack)]

    @staticmethod
    def _keep(state: ListState, held: Sequence[tuple], more: Sequence[tuple], kept: list[tuple]
              ) -> None:
        """Leaves ``kept`` in a list that holds ``held``, which is part of it and ``more``."""
        grown = len(kept) == len(held) + len(more)
        entries = list(more) if grown else kept
        packs = [(pickle.dumps(entries[i:i + _PACK]),) for i in range(0, len(entries), _PACK)]
        if packs:
            (state.appendList if grown else state.put)(packs)
        elif not grown and held:
            state.clear()


def lookup_features_stream(requests: DataFrame, writes: DataFrame, features: Sequence[str],
                           delay: str, heartbeat: DataFrame | None = None,
                           key: str = "customer_id", at: str = "timestamp") -> DataFrame:
    """``lookup_features`` for a stream of requests and a stream of writes, without a store table.

    The state of a key are its writes and its open requests.  A request is answered once the
    watermark, ``delay`` behind the latest instant of either stream, has passed it, so with every
    write up to then in whatever order; one that comes later still is answered at once, from the
    writes still known.  Of the writes that the watermark has passed only the last of each feature
    is kept, until its lifetime ends.  ``heartbeat`` is a stream of instants (column ``at``) that
    move the time on while neither requests nor writes come.

    A key's rows are one task's work in a micro-batch; its state is in the state store, and what it
    holds within the delay and its lifetimes is read together.  Rows without a time are in neither
    stream, and a request without a key finds nothing.
    """
    request = requests.schema
    entry = F.struct(*requests.columns)

    def rows(table: DataFrame, moment: str, **columns) -> DataFrame:
        given = {"_feature": F.lit(None).cast("string"), "_value": F.lit(None).cast("string"),
                 "_ttl": F.lit(None).cast("long"), "_request": F.lit(None).cast(request),
                 "_key": F.lit(None).cast("string")} | columns
        return table.filter(F.col(moment).isNotNull()).select(
            F.col(moment).alias("_at"), F.unix_micros(moment).alias("_micros"),
            *[column.alias(name) for name, column in given.items()])

    both = rows(requests, at, _key=F.col(key).cast("string"), _request=entry).unionByName(rows(
        writes.filter(F.col("feature").isin(*features) & F.col(key).isNotNull()), "written_at",
        _key=F.col(key).cast("string"), _feature=F.col("feature"),
        _value=F.col("value").cast("string"), _ttl=F.col("ttl_s").cast("long")))
    if heartbeat is not None:
        both = both.unionByName(rows(heartbeat, at))
    output = StructType([*request.fields,
                         *[StructField(f"stored_{name}", StringType()) for name in features]])
    # Without the column of the watermark, as rows behind it would be dropped.
    return both.withWatermark("_at", delay).drop("_at").groupBy("_key").transformWithState(
        _Lookup(features, request), output, "append", "eventTime")
