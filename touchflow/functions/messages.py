"""JSON messages to columns and back; the same code serves batch frames and streams.

A raw frame has the columns of a message queue: ``key``, ``value`` (binary or string) and the
broker's ``timestamp``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from touchflow.schemas import EVENT_COLUMNS, REQUEST_COLUMNS, RESPONSE_COLUMNS, ddl

# Fixed value: ISO form of timestamps in messages.
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _parsed(columns: dict[str, str]) -> Column:
    return F.from_json(F.col("value").cast("string"), ddl(columns))


def parse_events(raw: DataFrame) -> DataFrame:
    """Event columns of each message; a message that is not JSON gives a row of nulls."""
    return raw.select(_parsed(EVENT_COLUMNS).alias("data")).select("data.*")


def split_requests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects).

    Absent fields get their defaults and the request's time is the message's time.  A message
    that is not JSON or names no customer is a reject, kept with its reason.
    """
    parsed = raw.withColumn("_data", _parsed(REQUEST_COLUMNS))
    valid = F.col("_data.customer_id").isNotNull()
    empty = F.create_map().cast("map<string,string>")
    requests = parsed.filter(valid).select(
        F.col("_data.customer_id").alias("customer_id"),
        F.coalesce("_data.channel_context", empty).alias("channel_context"),
        "timestamp",
        F.coalesce("_data.region", F.lit("unknown")).alias("region"),
        F.coalesce("_data.brand", F.lit("unknown")).alias("brand"),
        F.coalesce("_data.session_id", F.lit("")).alias("session_id"),
    )
    is_json = F.try_parse_json(F.col("value").cast("string")).isNotNull()
    rejects = parsed.filter(~F.coalesce(valid, F.lit(False))).select(
        F.col("value").cast("string").alias("value"), "timestamp",
        F.when(is_json, "no customer_id").otherwise("not JSON").alias("reason"),
    )
    return requests, rejects


def parse_requests(raw: DataFrame) -> DataFrame:
    return split_requests(raw)[0]


def encode_responses(responses: DataFrame) -> DataFrame:
    """Messages keyed by customer with the response as JSON."""
    body = F.struct(*RESPONSE_COLUMNS)
    return responses.select(
        F.col("customer_id").alias("key"),
        F.to_json(body, {"timestampFormat": ISO_MICROS}).alias("value"),
    )
