"""Interactions of all channels, customer segments, journey features, training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from touchflow.functions.scalars import brand_region_segment, segment_priority
from touchflow.schemas import CHANNELS, INTERACTION_COLUMNS, INTERACTION_MAPPING


def to_interactions(table: DataFrame, channel: str) -> DataFrame:
    """One channel's rows in the common interaction layout."""
    source = {"customer_id": "customer_id", "channel": f"'{channel}'",
              **INTERACTION_MAPPING[channel]}
    return table.selectExpr(*[f"CAST({source[name]} AS {kind}) AS {name}"
                              for name, kind in INTERACTION_COLUMNS.items()])


def combine_interactions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Union all of the channels, by name, after each is mapped to one layout."""
    if not tables:
        raise ValueError("no channel to combine")
    parts = [to_interactions(table, channel) for channel, table in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def channel_counts(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("channel").agg(F.count("*").alias("record_count"))


def segment_customers(customers: DataFrame) -> DataFrame:
    return (customers
            .withColumn("brand_region_segment", brand_region_segment())
            .withColumn("segment_priority", segment_priority()))


def _channel_diversity(channels: Sequence[str] | None) -> Column:
    if channels is None:
        return F.countDistinct("channel")
    # The channel set is closed, so one bit per channel gives the exact distinct count from a
    # fixed-size state: a single partial aggregation, no second shuffle for the distinct.
    bit = F.when(F.col("channel").isNull(), F.lit(0))
    for position, name in enumerate(channels):
        bit = bit.when(F.col("channel") == name, F.lit(1 << position))
    bit = bit.otherwise(F.raise_error(F.concat(F.lit("unknown channel "), F.col("channel"))))
    return F.bit_count(F.bit_or(bit.cast("long"))).cast("long")


def journey_by_customer(interactions: DataFrame, as_of: str,
                        channels: Sequence[str] | None = CHANNELS) -> DataFrame:
    """Per-customer activity.  ``channels=None`` allows any label at the price of a shuffle."""
    span_days = F.datediff("last_interaction_date", "first_interaction_date") + 1
    return (
        interactions.groupBy("customer_id")
        .agg(
            F.count("*").alias("total_interactions"),
            _channel_diversity(channels).alias("channel_diversity"),
            F.max("interaction_ts").alias("last_interaction_date"),
            F.min("interaction_ts").alias("first_interaction_date"),
            F.avg(F.col("converted").cast("double")).alias("avg_conversion_rate"),
        )
        .withColumn("recency_days",
                    F.datediff(F.lit(as_of).cast("date"), "last_interaction_date"))
        .withColumn("interaction_frequency", F.col("total_interactions") / span_days)
    )


def journey_features(interactions: DataFrame, customers: DataFrame, as_of: str,
                     channels: Sequence[str] | None = CHANNELS) -> DataFrame:
    """All customers with their journey; null numbers become 0.

    ``has_interactions`` tells a customer without any activity from one active on ``as_of``, as
    both show ``recency_days`` 0 after the fill.  The aggregate leaves its rows hashed by
    ``customer_id``, so the join moves the customer table only.
    """
    journey = journey_by_customer(interactions, as_of, channels)
    joined = customers.join(journey, "customer_id", "left")
    flagged = joined.withColumn("has_interactions", F.col("total_interactions").isNotNull())
    return flagged.fillna(0)


def training_data(features: DataFrame, target: str) -> DataFrame:
    """Model inputs, the named target and the week of the last interaction."""
    if target not in features.columns:
        raise ValueError(f"target column {target!r} is not in the feature table")
    return features.select(
        "customer_id", "total_interactions", "channel_diversity", "recency_days",
        "interaction_frequency", "lifetime_value", "average_order_value", target,
        F.floor(F.col("recency_days") / 7).alias("interaction_window"),
    )
