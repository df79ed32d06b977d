"""The registered queries: library operations applied to the given tables.

Each takes (spark, sf_dir) and returns a DataFrame.  Doubles that depend on the order of addition
are rounded, timestamps are printed and lists are joined, so that results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchflow.functions.messages import (
    encode_responses, parse_events, parse_requests, split_requests,
)
from touchflow.functions.scalars import action_label
from touchflow.operators import (
    backtest, experiments, features, journey, labels, metrics, monitoring,
)
from touchflow.operators import recommend as rec
from touchflow.operators import rollups, scoring, significance as sig
from touchflow.plans import models, tables as t
from touchflow.schemas import CHANNEL_COLUMNS, CHANNELS, FEATURE_NAMES
from touchflow.session import shared_folder, stored
from touchflow.sources import tables as sources
from touchflow.sources.streams import file_stream, write_batches, write_stream
from touchflow.streaming import alerts as live
from touchflow.streaming.activity import read_windows, sliding_activity, start_sliding_activity
from touchflow.streaming.lookups import lookup_features_stream
from touchflow.streaming.recommendations import start_recommendations, start_reject_log
from touchflow.streaming.sessions import read_sessions, start_sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2024-01-15 12:00:30"
# Days up to which the feature store is compacted.
FIRST_BASE, BASE = "2024-01-08", "2024-01-15"
# Up to when the first of two roll-ups goes, within an hour.
FIRST_ROLL = "2024-01-14 17:20:45"
# Width of the whole-day ranges, which hold enough of the thin test log to raise no alert.
DAY_MINUTES = 1440


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return register


# -- presentation -------------------------------------------------------------------------------

def _printed(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def present(table: DataFrame, digits: int = 6, exact: Sequence[str] = ()) -> DataFrame:
    """Timestamps as text, doubles rounded, counts as bigint."""
    shown = []
    for name, kind in table.dtypes:
        column = F.col(name)
        if kind == "timestamp":
            column = _printed(column)
        elif kind == "double" and name not in exact:
            column = F.round(column, digits)
        elif kind == "int":
            column = column.cast("long")
        shown.append(column.alias(name))
    return table.select(shown)


def _map_text(name: str) -> Column:
    entries = F.transform(F.map_entries(name),
                          lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.array_join(entries, ",").alias(name)


# -- sources and sinks --------------------------------------------------------------------------

def _scan_channel(spark: SparkSession, sf_dir: str, channel: str) -> DataFrame:
    """Writes the channel's events as CSV and scans them with the library."""
    path = shared_folder(spark, f"csv-{channel}")
    sources.save_table(t.channel_table(spark, sf_dir, channel), path, "csv")
    return present(sources.read_channel(spark, channel, path))


@query("scan_email")
def scan_email(spark, sf_dir):
    return _scan_channel(spark, sf_dir, "email")


@query("scan_mobile")
def scan_mobile(spark, sf_dir):
    return _scan_channel(spark, sf_dir, "mobile")


@query("scan_web")
def scan_web(spark, sf_dir):
    return _scan_channel(spark, sf_dir, "web")


@query("scan_instore")
def scan_instore(spark, sf_dir):
    return _scan_channel(spark, sf_dir, "instore")


@query("scan_directmail")
def scan_directmail(spark, sf_dir):
    return _scan_channel(spark, sf_dir, "directmail")


@query("scan_customers")
def scan_customers(spark, sf_dir):
    path = shared_folder(spark, "csv-customers")
    sources.save_table(t.customers(spark, sf_dir), path, "csv")
    return present(sources.read_customers(spark, path))


def _written_with_faults(spark, sf_dir) -> str:
    """The web channel as CSV in which some page views and visit dates do not parse."""
    path = shared_folder(spark, "csv-faults")
    rows = t.channel_table(spark, sf_dir, "web")
    number = F.expr("substring(session_id, 2)").cast("long")
    sources.save_table(rows.withColumn("page_views", F.when(
        number % 7 == 0, F.lit("many")).otherwise(F.col("page_views").cast("string"))).withColumn(
        "visit_date", F.when(number % 11 == 0, F.lit("someday")).otherwise(F.date_format(
            "visit_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))), path, "csv")
    return path


@query("scan_checked")
def scan_checked(spark, sf_dir):
    fit, _ = sources.read_csv_checked(spark, _written_with_faults(spark, sf_dir),
                                      CHANNEL_COLUMNS["web"])
    return present(sources.tag_channel(fit, "web"))


@query("scan_rejects")
def scan_rejects(spark, sf_dir):
    _, rejects = sources.read_csv_checked(spark, _written_with_faults(spark, sf_dir),
                                          CHANNEL_COLUMNS["web"])
    return rejects.select(F.split("record", ",")[1].alias("session_id"), "reason")


@query("channel_counts")
def channel_counts(spark, sf_dir):
    configs = {}
    for channel, table in t.channel_tables(spark, sf_dir).items():
        path = shared_folder(spark, f"parquet-{channel}")
        sources.save_table(table, path)
        configs[channel] = {"path": path, "format": "parquet"}
    collected = sources.collect_channels(spark, configs)
    return journey.channel_counts(journey.combine_interactions(collected))


@query("sink_roundtrip")
def sink_roundtrip(spark, sf_dir):
    path = shared_folder(spark, "sink")
    interactions = journey.combine_interactions(t.channel_tables(spark, sf_dir))
    sources.save_table(interactions, path, partition_by=["channel"])
    return present(spark.read.parquet(path))


# -- projections --------------------------------------------------------------------------------

@query("tag_channel")
def tag_channel(spark, sf_dir):
    rows = t.events(spark, sf_dir).select("event_id", "customer_id", "value")
    return sources.tag_channel(rows, "web")


@query("segmentation")
def segmentation(spark, sf_dir):
    return journey.segment_customers(t.customers(spark, sf_dir)).select(
        "customer_id", "brand_region_segment", "segment_priority")


@query("combined_interactions")
def combined_interactions(spark, sf_dir):
    return present(journey.combine_interactions(t.channel_tables(spark, sf_dir)))


def _journey(spark, sf_dir) -> DataFrame:
    interactions = journey.combine_interactions(t.channel_tables(spark, sf_dir))
    profiles = journey.segment_customers(t.customers(spark, sf_dir))
    return journey.journey_features(interactions, profiles, t.AS_OF)


@query("journey_features")
def journey_features(spark, sf_dir):
    return present(_journey(spark, sf_dir))


@query("training_data")
def training_data(spark, sf_dir):
    target = F.col("customer_id").cast("long") % 5
    labelled = _journey(spark, sf_dir).withColumn("next_best_action", target)
    return present(journey.training_data(labelled, "next_best_action"))


@query("time_features")
def time_features(spark, sf_dir):
    rows = t.events(spark, sf_dir).select("event_id", "timestamp")
    return present(features.time_features(rows))


@query("request_time_features")
def request_time_features(spark, sf_dir):
    rows = t.requests(spark, sf_dir).select("request_id", "timestamp")
    return present(features.request_time_features(rows))


@query("context_features")
def context_features(spark, sf_dir):
    return features.context_features(t.requests(spark, sf_dir)).select(
        "request_id", "channel", "region", "brand", "session_id")


@query("action_mapping")
def action_mapping(spark, sf_dir):
    code = (F.col("event_id") % 7).cast("int")
    return t.events(spark, sf_dir).select("event_id", action_label(code).alias("action"))


# -- messages -----------------------------------------------------------------------------------

def _events_parsed(parsed: DataFrame) -> DataFrame:
    return present(parsed.select("customer_id", "event_type", "channel", "timestamp",
                                 F.col("properties")["k"].alias("k")))


@query("parse_events")
def parse_events_batch(spark, sf_dir):
    return _events_parsed(parse_events(t.event_messages(t.events(spark, sf_dir))))


def _messages(spark, sf_dir) -> DataFrame:
    return t.request_messages(t.requests(spark, sf_dir), t.events(spark, sf_dir))


@query("parse_requests")
def parse_requests_batch(spark, sf_dir):
    parsed = parse_requests(_messages(spark, sf_dir))
    return present(parsed.select(
        "customer_id", F.array_join(F.array_sort(F.map_values("channel_context")), ",")
        .alias("context_values"), "timestamp", "region", "brand", "session_id"))


@query("rejected_requests")
def rejected_requests(spark, sf_dir):
    return present(split_requests(_messages(spark, sf_dir))[1])


# -- experiments --------------------------------------------------------------------------------

def _design(spark, sf_dir, vertical="retail") -> experiments.Design:
    return experiments.design_experiment(None, vertical)  # all segments


def _assigned(spark, sf_dir, vertical="retail") -> DataFrame:
    return experiments.assign_stratified(t.experiment_customers(spark, sf_dir),
                                         _design(spark, sf_dir, vertical))


def _units(spark, sf_dir, vertical="retail") -> DataFrame:
    return _assigned(spark, sf_dir, vertical).join(t.outcomes(spark, sf_dir), "customer_id")


@query("experiment_plan")
def experiment_plan(spark, sf_dir):
    return present(experiments.plan_sizes(t.experiment_customers(spark, sf_dir),
                                          _design(spark, sf_dir)))


@query("stratified_assignment")
def stratified_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query("hash_assignment")
def hash_assignment(spark, sf_dir):
    customers = t.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"))
    return experiments.assign_by_hash(customers, scoring.TEST_NAME)


@query("sample_size_by_segment")
def sample_size_by_segment(spark, sf_dir):
    units = t.experiment_customers(spark, sf_dir).join(t.outcomes(spark, sf_dir), "customer_id")
    return present(experiments.sample_size_by_segment(units, 0.02))


@query("retail_metrics")
def retail_metrics(spark, sf_dir):
    return present(metrics.retail_metrics(_units(spark, sf_dir)))


@query("non_retail_metrics")
def non_retail_metrics(spark, sf_dir):
    return present(metrics.non_retail_metrics(_units(spark, sf_dir)))


@query("retail_metrics_without_revenue")
def retail_metrics_without_revenue(spark, sf_dir):
    """Inputs without the optional columns: their metrics are 0."""
    return present(metrics.retail_metrics(_units(spark, sf_dir).drop("revenue", "retained")))


@query("distinct_groups")
def distinct_groups(spark, sf_dir):
    return metrics.distinct_groups(_assigned(spark, sf_dir))


def _moments(spark, sf_dir, names=metrics.RETAIL, vertical="retail") -> DataFrame:
    return metrics.metric_moments(_units(spark, sf_dir, vertical), names)


ALL_METRICS = (*metrics.RETAIL, *metrics.MEANS)


@query("proportion_test")
def proportion_test(spark, sf_dir):
    pairs = sig.pair_with_control(_moments(spark, sf_dir, tuple(metrics.RATES)))
    return present(sig.with_proportion_test(pairs).select(
        "metric", "test_group", "statistic", "p_value", "ci_lower", "ci_upper"))


@query("t_test")
def t_test(spark, sf_dir):
    names = ("revenue_per_customer", *metrics.MEANS)
    pairs = sig.pair_with_control(_moments(spark, sf_dir, names))
    return present(sig.with_t_test(pairs).select(
        "metric", "test_group", "statistic", "p_value", "ci_lower", "ci_upper"))


@query("t_test_assumed_cv")
def t_test_assumed_cv(spark, sf_dir):
    pairs = sig.pair_with_control(_moments(spark, sf_dir, ("revenue_per_customer",)))
    return present(sig.with_t_test(pairs, assumed_cv=0.2).select(
        "metric", "test_group", "statistic", "p_value", "ci_lower", "ci_upper"))


@query("significance")
def significance(spark, sf_dir):
    return present(sig.significance(_moments(spark, sf_dir, ALL_METRICS)))


@query("experiment_winner")
def experiment_winner(spark, sf_dir):
    return present(sig.winner(sig.significance(_moments(spark, sf_dir)), "conversion_rate"))


@query("experiment_summary")
def experiment_summary(spark, sf_dir):
    return sig.summary(_moments(spark, sf_dir), _design(spark, sf_dir))


@query("non_retail_summary")
def non_retail_summary(spark, sf_dir):
    return sig.summary(_moments(spark, sf_dir, metrics.NON_RETAIL, "non_retail"),
                       _design(spark, sf_dir, "non_retail"))


@query("backtest_windows")
def backtest_windows(spark, sf_dir):
    return present(backtest.backtest_windows(t.order_history(spark, sf_dir)), digits=4)


@query("backtest_predicted")
def backtest_predicted(spark, sf_dir):
    windows = backtest.backtest_windows(t.order_history_predicted(spark, sf_dir),
                                        prediction_col="predicted_conversion")
    return present(windows.withColumn("actual_revenue", F.round("actual_revenue", 4)), digits=8)


@query("backtest_overall")
def backtest_overall(spark, sf_dir):
    windows = backtest.backtest_windows(t.order_history(spark, sf_dir))
    return present(backtest.backtest_overall(windows), digits=4)


# -- activity windows ---------------------------------------------------------------------------

def _activity_events(spark, sf_dir) -> DataFrame:
    return t.events(spark, sf_dir).select("customer_id", "channel", "timestamp")


def _activity_shown(activity: DataFrame) -> DataFrame:
    return present(activity.select(
        F.col("window.start").alias("window_start"), "customer_id", "event_count",
        F.array_join("channels_used", ",").alias("channels_used"), "last_activity"))


@query("sliding_activity")
def sliding_activity_batch(spark, sf_dir):
    return _activity_shown(sliding_activity(_activity_events(spark, sf_dir), spell_out=True))


@query("sliding_channel_counts")
def sliding_channel_counts(spark, sf_dir):
    activity = sliding_activity(_activity_events(spark, sf_dir))
    return present(activity.select(
        F.col("window.start").alias("window_start"), "customer_id", "event_count",
        _map_text("channel_counts"), "last_activity"))


# -- features -----------------------------------------------------------------------------------

@query("feature_upsert")
def feature_upsert(spark, sf_dir):
    path = shared_folder(spark, "features")
    features.append_features(t.stored_writes(spark, sf_dir), path, t.STORE_TTL_SECONDS)
    return present(features.latest_features(spark.read.parquet(path)))


@query("feature_lookup")
def feature_lookup(spark, sf_dir):
    found = features.lookup_features(t.request_keys(spark, sf_dir),
                                     t.stored_writes(spark, sf_dir), t.STORED_FEATURES)
    return _lookup_shown(found)


def _lookup_shown(found: DataFrame) -> DataFrame:
    values = [F.col(f"stored_{n}").cast("double").alias(f"stored_{n}")
              for n in t.STORED_FEATURES]
    return found.select("request_id", "customer_id", *values)


@query("feature_lookup_compacted")
def feature_lookup_compacted(spark, sf_dir):
    """Requests from a day on, with all writes before it compacted in two steps."""
    path = shared_folder(spark, "features")
    base = f"{path}-base"
    features.append_features(t.stored_writes(spark, sf_dir), path, t.STORE_TTL_SECONDS)
    features.compact_features(spark, path, base, FIRST_BASE)
    features.compact_features(spark, path, base, BASE, FIRST_BASE)
    asked = t.request_keys(spark, sf_dir).filter(F.col("timestamp") >= F.lit(BASE).cast("timestamp"))
    return _lookup_shown(features.lookup_features(
        asked, features.read_features(spark, path, base, BASE), t.STORED_FEATURES))


@query("session_features")
def session_features(spark, sf_dir):
    asked = features.context_features(t.requests(spark, sf_dir)).select(
        "request_id", "session_id", "timestamp")
    found = features.session_features(asked, t.sessions(spark, sf_dir))
    return found.select("request_id", "session_id",
                        F.col("session_duration").cast("double").alias("session_duration"),
                        F.col("page_views").cast("double").alias("page_views"))


def _request_features(spark, sf_dir, extra=()) -> DataFrame:
    return rec.request_features(t.requests(spark, sf_dir), t.stored_writes(spark, sf_dir),
                                t.sessions(spark, sf_dir), t.STORED_FEATURES)


@query("merged_features")
def merged_features(spark, sf_dir):
    merged = _request_features(spark, sf_dir).select("request_id", *FEATURE_NAMES)
    nullable = {n: F.col(n).cast("double") for n in t.STORED_FEATURES}
    return present(merged.withColumns(nullable))


def _labels(spark, sf_dir) -> dict:
    """Labels of the text features: the channels are a fixed list, the others come from data."""
    return {
        "channel": list(CHANNELS),
        "region": labels.category_labels(t.table(spark, sf_dir, "region"), "r_name"),
        "brand": labels.category_labels(t.table(spark, sf_dir, "part"), "p_brand"),
    }


@query("feature_vector")
def feature_vector(spark, sf_dir):
    vectors = features.feature_vector(_request_features(spark, sf_dir), _labels(spark, sf_dir))
    return vectors.select("request_id", *scoring.feature_columns(FEATURE_NAMES))


# -- scoring ------------------------------------------------------------------------------------

@query("model_routing")
def model_routing(spark, sf_dir):
    customers = hash_assignment(spark, sf_dir).withColumnRenamed("test_group", "ab_test_group")
    return scoring.route_models(customers, {"recommendation_model_v1": "1"})


def _ready(spark, sf_dir, asked: DataFrame) -> DataFrame:
    return rec.prepare_scoring(asked, t.stored_writes(spark, sf_dir), t.sessions(spark, sf_dir),
                               _labels(spark, sf_dir), models.VERSIONS, t.STORED_FEATURES)


def _linear(table: DataFrame) -> DataFrame:
    return scoring.score_linear(table, models.LINEAR_MODELS)


@query("score_linear")
def score_linear(spark, sf_dir):
    scored = _linear(_ready(spark, sf_dir, t.requests(spark, sf_dir)))
    each = [F.round(F.col("probability")[i], 6).alias(f"p{i}") for i in range(5)]
    return present(scored.select("request_id", "model_name", "prediction", "confidence", *each))


@query("score_batch")
def score_batch(spark, sf_dir):
    """Two models fitted on all requests, then applied to them by group."""
    ready = _ready(spark, sf_dir, t.requests(spark, sf_dir))
    label = F.pmod(F.col("customer_id").cast("long"), F.lit(5))
    labelled = stored(ready.withColumn("next_best_action", label), "scoring-input")
    fitted = models.fit_models(labelled, "next_best_action")
    scored = scoring.score_pipelines(
        labelled.withColumn("input", array_to_vector("features")), fitted)
    each = [F.round(F.col("probability")[i], 6).alias(f"p{i}") for i in range(5)]
    return present(scored.select("request_id", "model_name", "prediction", "confidence", *each))


@query("score_mixed")
def score_mixed(spark, sf_dir):
    """A linear and a foreign model side by side, each row scored by its own."""
    ready = stored(_ready(spark, sf_dir, t.requests(spark, sf_dir)), "scoring-input")
    names = list(models.LINEAR_MODELS)
    scored = scoring.score_routed(ready, {
        names[0]: _linear,
        names[1]: lambda rows: scoring.score_batches(
            rows, models.load_foreign(names[1]), len(FEATURE_NAMES))})
    return present(scored.select("request_id", "model_name", "prediction", "confidence"))


@query("fallback_responses")
def fallback_responses(spark, sf_dir):
    """One group's model is not loaded: its rows get the fallback, and no log entry."""
    name = next(iter(models.LINEAR_MODELS))
    loaded = {name: models.LINEAR_MODELS[name]}
    answered = rec.recommend(
        t.requests(spark, sf_dir), t.stored_writes(spark, sf_dir), t.sessions(spark, sf_dir),
        _labels(spark, sf_dir), models.VERSIONS,
        lambda table: scoring.score_linear(table, loaded), t.STORED_FEATURES, ("request_id",))
    logged = rec.experiment_log(answered).select("request_id", F.lit(True).alias("_logged"))
    shown = answered.join(logged, "request_id", "left").withColumn(
        "logged", F.coalesce("_logged", F.lit(False))).drop("_logged")
    return present(shown)


@query("onehot_proba")
def onehot_proba(spark, sf_dir):
    codes = t.events(spark, sf_dir).select(
        "event_id", (F.col("event_id") % 5).cast("int").alias("prediction"))
    shown = scoring.with_one_hot(codes)
    return shown.select("event_id", *[F.col("probability")[i].alias(f"p{i}") for i in range(5)])


def _recommend(spark, sf_dir, asked: DataFrame, extra=("request_id",)) -> DataFrame:
    return rec.recommend(asked, t.stored_writes(spark, sf_dir), t.sessions(spark, sf_dir),
                         _labels(spark, sf_dir), models.VERSIONS, _linear, t.STORED_FEATURES,
                         extra)


@query("recommendations")
def recommendations(spark, sf_dir):
    return present(_recommend(spark, sf_dir, t.requests(spark, sf_dir)))


@query("encode_responses")
def encode_responses_batch(spark, sf_dir):
    responses = _recommend(spark, sf_dir, t.requests(spark, sf_dir))
    rounded = responses.withColumn("confidence_score", F.round("confidence_score", 4))
    return encode_responses(rounded)


@query("experiment_log")
def experiment_log(spark, sf_dir):
    path = shared_folder(spark, "experiment-log")
    responses = _recommend(spark, sf_dir, t.requests(spark, sf_dir))
    sources.append_log(rec.experiment_log(responses), path, batch_id="requests")
    return _experiment_log_shown(spark.read.parquet(path))


def _experiment_log_shown(log: DataFrame) -> DataFrame:
    return present(log.select("request_id", "customer_id", "test_name", "group", "outcome",
                              F.col("metrics")["confidence"].alias("confidence"), "timestamp"))


@query("session_table")
def session_table(spark, sf_dir):
    """Sessions kept as a table with a folder per day of their start."""
    return present(spark.read.parquet(_session_table(spark, sf_dir)))


def _session_table(spark, sf_dir) -> str:
    path = shared_folder(spark, "sessions")
    sources.append_log(t.sessions(spark, sf_dir), path, "start_time")
    return path


@query("latest_results")
def latest_results(spark, sf_dir):
    newest = rec.latest_results(t.result_log(spark, sf_dir))
    return present(newest.select("customer_id", "test_name", "group", "outcome", "timestamp"))


@query("latest_results_folders")
def latest_results_folders(spark, sf_dir):
    """From a log with day folders, of which only the newest are read."""
    path = shared_folder(spark, "results")
    rec.append_results(t.result_log(spark, sf_dir), path, "events")
    newest = rec.newest_results(spark, path)
    return present(newest.select("customer_id", "test_name", "group", "outcome", "timestamp"))


# -- monitoring ---------------------------------------------------------------------------------

@query("request_log")
def request_log(spark, sf_dir):
    path = shared_folder(spark, "request-log")
    sources.append_log(rec.request_log(t.service_log(spark, sf_dir)), path, batch_id="events")
    return present(spark.read.parquet(path).drop("log_date", "batch_id"))


@query("requests_per_minute")
def requests_per_minute(spark, sf_dir):
    return present(monitoring.requests_per_minute(t.service_log(spark, sf_dir)))


@query("action_distribution")
def action_distribution(spark, sf_dir):
    return present(monitoring.action_distribution(t.service_log(spark, sf_dir)))


def _rolling_shown(rolled: DataFrame) -> DataFrame:
    return present(rolled.withColumn("action_distribution", _map_text("action_distribution")))


@query("rolling_metrics")
def rolling_metrics(spark, sf_dir):
    return _rolling_shown(monitoring.rolling_metrics(t.service_log(spark, sf_dir), NOW))


@query("rolling_metrics_day")
def rolling_metrics_day(spark, sf_dir):
    return _rolling_shown(monitoring.rolling_metrics(
        t.service_log(spark, sf_dir), NOW, DAY_MINUTES, retention_seconds=DAY_MINUTES * 60))


def _rolled_up(spark, sf_dir) -> str:
    """Minutes, hours and days of the request log up to now, added in two calls."""
    path = shared_folder(spark, "rollups")
    log = t.service_log(spark, sf_dir)
    rollups.roll_up(log, path, FIRST_ROLL)
    rollups.roll_up(log, path, NOW, FIRST_ROLL)
    return path


@query("rolling_metrics_rollup")
def rolling_metrics_rollup(spark, sf_dir):
    return _rolling_shown(rollups.rolling_metrics_of_rollups(spark, _rolled_up(spark, sf_dir), NOW))


@query("rolling_metrics_day_rollup")
def rolling_metrics_day_rollup(spark, sf_dir):
    return _rolling_shown(rollups.rolling_metrics_of_rollups(
        spark, _rolled_up(spark, sf_dir), NOW, DAY_MINUTES, DAY_MINUTES * 60))


@query("alerts_rollup")
def alerts_rollup(spark, sf_dir):
    rolled = rollups.rolling_metrics_of_rollups(spark, _rolled_up(spark, sf_dir), NOW,
                                                monitoring.ALERT_MINUTES)
    return present(monitoring.alerts(rolled))


@query("alerts")
def alerts(spark, sf_dir):
    return present(monitoring.check_alerts(t.service_log(spark, sf_dir), NOW))


@query("alert_windows")
def alert_windows(spark, sf_dir):
    return present(monitoring.alert_windows(t.service_log(spark, sf_dir)))


# -- the same on streams ------------------------------------------------------------------------
# Each reads the given events as a file stream, to the end, and returns what the sink holds.

EVENT_TABLE = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
               "value double, props string")
DELAY_MINUTES = 10
# A micro-batch takes so many bytes of files, one file at least.  Small in tests.
STREAM_BYTES = None


def _event_stream(spark, sf_dir) -> DataFrame:
    bound = {} if STREAM_BYTES is None else {"maxBytesPerTrigger": str(STREAM_BYTES)}
    raw = file_stream(spark, f"{sf_dir}/events.parquet", EVENT_TABLE, **bound)
    return t.event_rows(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def _closed(spark, sf_dir, start: Callable, label: str, minutes: int = 1440) -> str:
    """Runs a query to the end of the table, then once more with a heartbeat some minutes after the
    last event, by which time all panes are closed; gives its folder."""
    path, beats = shared_folder(spark, label), shared_folder(spark, "heartbeat")
    spark.createDataFrame([], "timestamp timestamp").write.parquet(beats)

    def run():
        running = start(path, f"{path}-checkpoint", {"availableNow": True},
                        file_stream(spark, beats, "timestamp timestamp"))
        running.awaitTermination()
        return _read(running)

    if not run():
        raise RuntimeError(f"{label}: the stream read nothing")
    last = F.max("timestamp") + F.make_dt_interval(mins=F.lit(minutes))
    t.events(spark, sf_dir).agg(last.alias("timestamp")).write.mode("append").parquet(beats)
    run()
    return path


def _read(query) -> int:
    """Rows that a finished query took in; an error if it dropped any as late."""
    for progress in query.recentProgress:
        for state in progress.stateOperators:
            if state.numRowsDroppedByWatermark:
                raise RuntimeError(f"{state.numRowsDroppedByWatermark} rows dropped as late")
    return sum(source.numInputRows for progress in query.recentProgress
               for source in progress.sources)


def _drained(start: Callable, spark: SparkSession, label: str) -> str:
    """Starts a query with sink and checkpoint folders, waits for its end, gives the sink."""
    path = shared_folder(spark, label)
    running = start(path, f"{path}-checkpoint", {"availableNow": True})
    running.awaitTermination()
    if not _read(running):
        raise RuntimeError(f"{label}: the stream read nothing")
    return path


def _sunk(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    def start(path, checkpoint, trigger):
        return write_stream(stream, path, checkpoint, trigger=trigger)

    return spark.read.parquet(_drained(start, spark, label))


@query("parse_events_stream")
def parse_events_stream(spark, sf_dir):
    parsed = parse_events(t.event_messages(_event_stream(spark, sf_dir)))
    return _events_parsed(_sunk(spark, parsed, "events-stream"))


@query("sliding_activity_stream")
def sliding_activity_stream(spark, sf_dir):
    parsed = features.time_features(parse_events(t.event_messages(_event_stream(spark, sf_dir))))

    def start(path, checkpoint, trigger, heartbeat):
        return start_sliding_activity(parsed, path, DELAY_MINUTES, checkpoint, trigger, heartbeat,
                                      spell_out=True)

    return _activity_shown(read_windows(spark, _closed(spark, sf_dir, start, "activity-stream")))


def _minutes_kept(spark, sf_dir) -> str:
    log = t.service_log_rows(_event_stream(spark, sf_dir))

    def start(path, checkpoint, trigger, heartbeat):
        return live.start_minutes(log, path, DELAY_MINUTES, checkpoint, trigger, heartbeat)

    return _closed(spark, sf_dir, start, "minutes-stream")


@query("requests_per_minute_stream")
def requests_per_minute_stream(spark, sf_dir):
    kept = live.read_minutes(spark, _minutes_kept(spark, sf_dir))
    return present(live.minute_metrics(kept))


@query("action_distribution_stream")
def action_distribution_stream(spark, sf_dir):
    kept = live.read_minutes(spark, _minutes_kept(spark, sf_dir))
    return present(live.minute_actions(kept))


@query("alert_windows_stream")
def alert_windows_stream(spark, sf_dir):
    """Ranges of the silence after the last event follow as far as the batch query has them."""
    log = t.service_log_rows(_event_stream(spark, sf_dir))

    def start(path, checkpoint, trigger, heartbeat):
        return live.start_alerts(log, path, DELAY_MINUTES, checkpoint, trigger, heartbeat)

    path = _closed(spark, sf_dir, start, "alerts-stream")
    last = live.read_minutes(spark, path).agg(F.max("pane")).scalar()
    reach = F.make_dt_interval(mins=F.lit(monitoring.ALERT_MINUTES))
    return present(live.read_alerts(spark, path).filter(F.col("timestamp") <= last + reach))


@query("session_table_stream")
def session_table_stream(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select("session_id", "event_type", "timestamp")

    def start(path, checkpoint, trigger, heartbeat):
        return start_sessions(rows, path, DELAY_MINUTES, checkpoint, trigger, heartbeat)

    return present(read_sessions(spark, _closed(spark, sf_dir, start, "sessions-stream")))


@query("feature_lookup_stream")
def feature_lookup_stream(spark, sf_dir):
    """Writes and requests of one stream.  The files of a table may be in any order of time, so an
    answer waits for all of them: the delay is the time they span."""
    rows = _event_stream(spark, sf_dir)
    span = t.events(spark, sf_dir).agg(F.ceil((F.max(F.unix_micros("timestamp")) - F.min(
        F.unix_micros("timestamp"))) / 60_000_000).alias("minutes")).first()["minutes"] or 0
    writes, requests = t.view_writes(rows), t.keys_of_requests(rows)

    def start(path, checkpoint, trigger, heartbeat):
        answers = lookup_features_stream(requests, writes, t.STORED_FEATURES,
                                         f"{span + 1} minutes", heartbeat)
        return write_stream(answers, f"{path}/answers", checkpoint, trigger=trigger)

    path = _closed(spark, sf_dir, start, "lookup-stream", minutes=span + 2)
    return _lookup_shown(spark.read.parquet(f"{path}/answers"))


def _message_stream(spark, sf_dir) -> DataFrame:
    rows = _event_stream(spark, sf_dir)
    return t.request_messages(t.request_rows(rows, t.customer_places(spark, sf_dir)), rows)


def _start_answers(spark, sf_dir, log_path=None):
    """The recommendation stream over a feature store and a session table with day folders."""
    labels = _labels(spark, sf_dir)
    store, sessions = shared_folder(spark, "features"), _session_table(spark, sf_dir)
    features.append_features(t.stored_writes(spark, sf_dir), store, t.STORE_TTL_SECONDS)

    def answer(batch: DataFrame) -> DataFrame:
        responses = rec.recommend(
            batch, spark.read.parquet(store), spark.read.parquet(sessions), labels,
            models.VERSIONS, _linear, t.STORED_FEATURES, max_session_days=1,
            max_ttl_seconds=t.STORE_TTL_SECONDS, requested_keys_only=True)
        return responses.withColumn("confidence_score", F.round("confidence_score", 4))

    def start(path, checkpoint, trigger):
        return start_recommendations(_message_stream(spark, sf_dir), answer, path, checkpoint,
                                     trigger, log_path)

    return start


@query("recommendations_stream")
def recommendations_stream(spark, sf_dir):
    answers = _drained(_start_answers(spark, sf_dir), spark, "responses-stream")
    return spark.read.parquet(answers).select("key", "value")


@query("experiment_log_stream")
def experiment_log_stream(spark, sf_dir):
    log = shared_folder(spark, "experiment-log-stream")
    _drained(_start_answers(spark, sf_dir, log), spark, "responses-stream")
    return present(spark.read.parquet(log).select(
        "customer_id", "test_name", "group", "outcome",
        F.col("metrics")["confidence"].alias("confidence"), "timestamp"), digits=4)


@query("rejected_requests_stream")
def rejected_requests_stream(spark, sf_dir):
    def start(path, checkpoint, trigger):
        return start_reject_log(_message_stream(spark, sf_dir), path, checkpoint, trigger)

    return present(spark.read.parquet(_drained(start, spark, "rejects-stream")))


@query("request_log_stream")
def request_log_stream(spark, sf_dir):
    log = t.service_log_rows(_event_stream(spark, sf_dir))

    def start(path, checkpoint, trigger):
        return write_batches(log, rec.request_log, path, checkpoint, trigger)

    return present(spark.read.parquet(_drained(start, spark, "log-stream"))
                   .drop("run_id", "batch_id"))
