"""From requests to recommended actions, and the logs written about them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from touchflow.functions.scalars import action_label
from touchflow.operators.experiments import assign_by_hash
from touchflow.operators.features import (
    context_features, feature_vector, lookup_features, merge_features, request_time_features,
    session_features,
)
from touchflow.operators.scoring import TEST_NAME, route_models
from touchflow.schemas import FEATURE_NAMES, RESPONSE_COLUMNS
from touchflow.sources.tables import append_log

Scorer = Callable[[DataFrame], DataFrame]


def request_features(requests: DataFrame, writes: DataFrame, sessions: DataFrame,
                     stored: Sequence[str], features: Sequence[str] = FEATURE_NAMES,
                     max_session_days: int | None = None, **lookup_options) -> DataFrame:
    """Requests with every model feature: stored ones overridden by those of the request."""
    looked_up = lookup_features(requests, writes, stored, **lookup_options)
    contextual = request_time_features(context_features(looked_up))
    return merge_features(session_features(contextual, sessions,
                                           max_session_days=max_session_days), features)


def prepare_scoring(requests: DataFrame, writes: DataFrame, sessions: DataFrame,
                    labels: Mapping[str, Sequence[str]], versions: Mapping[str, str],
                    stored: Sequence[str], features: Sequence[str] = FEATURE_NAMES,
                    **lookup_options) -> DataFrame:
    """Requests with group, routed model and feature vector."""
    described = request_features(requests, writes, sessions, stored, features, **lookup_options)
    assigned = assign_by_hash(described, TEST_NAME, group_col="ab_test_group")
    routed = route_models(assigned, versions)
    return feature_vector(routed, labels, features)


def respond(scored: DataFrame, extra: Sequence[str] = (), at: str = "timestamp") -> DataFrame:
    """Response rows; a row without a prediction gets the fallback response."""
    failed = ~F.coalesce("scored", F.lit(False)) | F.col("prediction").isNull()
    return scored.select(
        *extra,
        "customer_id",
        F.when(failed, "no_action").otherwise(action_label(F.col("prediction")))
        .alias("recommended_action"),
        F.when(failed, "unknown").otherwise(F.col("channel")).alias("channel"),
        F.when(failed, 0.0).otherwise(F.col("confidence")).alias("confidence_score"),
        F.col(at).alias("timestamp"),
        F.when(failed, "error").otherwise(F.col("model_version")).alias("model_version"),
        F.when(failed, "error").otherwise(F.col("ab_test_group")).alias("ab_test_group"),
    )


def recommend(requests: DataFrame, writes: DataFrame, sessions: DataFrame,
              labels: Mapping[str, Sequence[str]], versions: Mapping[str, str],
              scorer: Scorer, stored: Sequence[str], extra: Sequence[str] = (),
              features: Sequence[str] = FEATURE_NAMES, **lookup_options) -> DataFrame:
    """One response per request.  The same function scores a table and a micro-batch.

    ``lookup_options`` go to ``lookup_features``.
    """
    ready = prepare_scoring(requests, writes, sessions, labels, versions, stored, features,
                            **lookup_options)
    return respond(scorer(ready), extra)


def _ids(responses: DataFrame) -> list[str]:
    """The request's id, where the responses carry it: readers tell repeats by it."""
    return [name for name in ("request_id",) if name in responses.columns]


def experiment_log(responses: DataFrame, test_name: str = TEST_NAME) -> DataFrame:
    """Log rows of an experiment; fallback responses belong to no group and are not logged."""
    return responses.filter(F.col("ab_test_group") != "error").select(
        *_ids(responses),
        "customer_id",
        F.lit(test_name).alias("test_name"),
        F.col("ab_test_group").alias("group"),
        F.col("recommended_action").alias("outcome"),
        F.create_map(F.lit("confidence"), F.col("confidence_score")).alias("metrics"),
        "timestamp",
    )


def request_log(responses: DataFrame, latency_col: str = "latency_ms") -> DataFrame:
    """Log rows of the service: the response without its channel, with the latency."""
    kept = [name for name in RESPONSE_COLUMNS if name != "channel"]
    return responses.select(*_ids(responses), *kept, F.col(latency_col).alias("latency_ms"))


def latest_results(log: DataFrame, limit: int = 1000, test_name: str | None = None,
                   tie_break: Sequence[str] = ("customer_id",)) -> DataFrame:
    """The newest ``limit`` results of each test, or of one test.

    A test may hold most of the log.  Counts per test and second, added up before the shuffle, show
    from which second on a test has ``limit`` results; only rows from there on are ranked: the
    limit and less than one second's rows more per test, whatever the limit is.
    """
    newest = [F.desc("timestamp"), *[F.desc(name) for name in tie_break]]
    if test_name is not None:
        return log.filter(F.col("test_name") == test_name).orderBy(*newest).limit(limit)
    second = F.unix_seconds("timestamp")
    newer = Window.partitionBy("test_name").orderBy(F.desc("_second")).rowsBetween(
        Window.unboundedPreceding, -1)
    cuts = (log.filter(F.col("timestamp").isNotNull())
            .groupBy("test_name", second.alias("_second")).agg(F.count("*").alias("_n"))
            .withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
            .filter(F.col("_newer") < limit)
            .groupBy("test_name").agg(F.min("_second").alias("_from"),
                                      F.sum("_n").alias("_rows"))
            .select(F.col("test_name").alias("_test"), "_rows", "_from"))
    # Rows without a time come last; they are ranked only if a test has too few others.
    wanted = F.when(second.isNull(), F.coalesce("_rows", F.lit(0)) < limit).otherwise(
        second >= F.col("_from"))
    ranked = Window.partitionBy("test_name").orderBy(*newest)
    return (log.join(cuts, F.col("test_name").eqNullSafe(F.col("_test")), "left")
            .filter(wanted).drop("_test", "_rows", "_from")
            .withColumn("_rank", F.row_number().over(ranked))
            .filter(F.col("_rank") <= limit).drop("_rank"))


def append_results(log: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Appends experiment log rows to day folders, and their number per test and day beside them."""
    append_log(log, f"{path}/rows", "timestamp", batch_id)
    days = log.groupBy("test_name", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"))
    append_log(days, f"{path}/days", "day", batch_id)


def newest_days(spark: SparkSession, path: str, limit: int, test_name: str | None = None
                ) -> DataFrame:
    """(test_name, day): the youngest days that hold ``limit`` results of a test, or all its days.

    Only the numbers per test and day are read; rows without a time are the oldest.
    """
    days = spark.read.parquet(f"{path}/days")
    if test_name is not None:
        days = days.filter(F.col("test_name") == test_name)
    newer = Window.partitionBy("test_name").orderBy(F.desc_nulls_last("day")).rowsBetween(
        Window.unboundedPreceding, -1)
    return (days.groupBy("test_name", "day").agg(F.sum("n").alias("n"))
            .withColumn("_newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
            .filter(F.col("_newer") < limit).select("test_name", "day"))


def newest_results(spark: SparkSession, path: str, limit: int = 1000,
                   test_name: str | None = None,
                   tie_break: Sequence[str] = ("customer_id",)) -> DataFrame:
    """``latest_results`` of a log that ``append_results`` has written.

    The numbers per day tell which day folders hold the newest ``limit`` results of each test; no
    other folder is read.  The driver gets the dates of these folders.
    """
    needed = newest_days(spark, path, limit, test_name)
    dates = [row["day"] for row in needed.select("day").distinct().collect()]
    day = F.col("log_date")
    wanted = day.isin([d for d in dates if d is not None])
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.filter(wanted | day.isNull() if None in dates else wanted)
    if test_name is None:  # days of one test are no days of another
        keys = needed.select(F.col("test_name").alias("_test"), F.col("day").alias("_day"))
        rows = rows.join(keys, F.col("test_name").eqNullSafe(F.col("_test"))
                         & day.eqNullSafe(F.col("_day")), "left_semi")
    kept = [name for name in rows.columns if name not in ("log_date", "batch_id")]
    return latest_results(rows.select(*kept), limit, test_name, tie_break)
