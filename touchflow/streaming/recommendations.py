"""Requests from a stream to responses, and the metrics of a live log."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from touchflow.functions.messages import encode_responses, split_requests
from touchflow.operators.monitoring import action_distribution, requests_per_minute
from touchflow.operators.recommend import experiment_log
from touchflow.sources.streams import Sink, write_batches, write_stream


def start_recommendations(raw: DataFrame, recommend: Callable[[DataFrame], DataFrame],
                          sink: str | Sink, checkpoint: str, trigger: Mapping | None = None,
                          log_path: str | None = None) -> StreamingQuery:
    """Answers the requests of a raw message stream; the answers go to the sink as messages.

    ``recommend`` maps a table of requests to responses and may look up other tables: it runs on
    each micro-batch as it would on a backfill.  ``log_path`` gets the rows of the experiment log,
    without the fallback responses.
    """
    requests, _ = split_requests(raw)
    also = [(experiment_log, log_path)] if log_path else []
    return write_batches(requests, recommend, sink, checkpoint, trigger, also,
                         finish=encode_responses)


def start_reject_log(raw: DataFrame, path: str, checkpoint: str,
                     trigger: Mapping | None = None) -> StreamingQuery:
    """Keeps the messages that are no requests, with the reason."""
    _, rejects = split_requests(raw)
    return write_stream(rejects, path, checkpoint, trigger=trigger)


def stream_minute_metrics(log: DataFrame, watermark: str, at: str = "timestamp") -> DataFrame:
    return requests_per_minute(log.withWatermark(at, watermark), at)


def stream_action_distribution(log: DataFrame, watermark: str, at: str = "timestamp"
                               ) -> DataFrame:
    return action_distribution(log.withWatermark(at, watermark), at)
