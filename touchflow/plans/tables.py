"""The library's inputs, derived from the given star-schema tables.

``FIXTURES.md`` explains the mapping.  Everything here is a projection, join or aggregation of
those tables, so the work of every query grows with them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchflow.functions.scalars import action_label, hash_bucket
from touchflow.operators.features import build_sessions, feature_writes
from touchflow.schemas import CHANNEL_COLUMNS, CHANNELS, CUSTOMER_COLUMNS

AS_OF = "2024-02-01"
CHANNEL_BY_EVENT = {"click": "email", "signup": "mobile", "view": "web",
                    "purchase": "instore", "error": "directmail"}
STORED_FEATURES = ("session_duration", "page_views")
STORE_TTL_SECONDS = 86_400


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zone-less times become timestamps of the session zone.

    The given tables never change, so the schema of each is read once per session.
    """
    data = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in data.dtypes if kind == "timestamp_ntz"]
    return data.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def event_rows(data: DataFrame) -> DataFrame:
    """Events with customer, channel, ``k`` from the properties and a session per day."""
    channel = " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in CHANNEL_BY_EVENT.items())
    return data.selectExpr(
        "event_id", "CAST(user_id AS string) AS customer_id", "event_type",
        f"CASE event_type {channel} END AS channel", "ts AS timestamp", "value", "props",
        "CAST(get_json_object(props, '$.k') AS int) AS k",
        "user_id || '-' || date_format(ts, 'yyyy-MM-dd') AS session_id",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(table(spark, sf_dir, "events"))


# Columns of the channel layouts, as expressions over event rows.
CHANNEL_SOURCES = {
    "email": {
        "email_id": "'e' || event_id", "campaign_id": "'c' || k % 7", "sent_date": "timestamp",
        "opened": "value >= 20", "clicked": "value >= 50", "converted": "value >= 100",
    },
    "mobile": {
        "session_id": "'s' || event_id", "app_version": "'v' || k % 4",
        "interaction_date": "timestamp", "screen_views": "k", "time_spent": "value",
        "push_notification_clicked": "k >= 50", "in_app_purchase": "value >= 100",
    },
    "web": {
        "session_id": "'s' || event_id", "page_views": "k", "session_duration": "value",
        "bounce_rate": "k / 100", "conversion_event": "value >= 100",
        "referrer_source": "'r' || k % 3", "visit_date": "timestamp",
    },
    "instore": {
        "store_id": "'store' || k % 10", "transaction_id": "'t' || event_id",
        "transaction_date": "timestamp", "purchase_amount": "value",
        "product_category": "'cat' || k % 5", "loyalty_points_used": "k",
        "staff_interaction": "k >= 50",
    },
    "directmail": {
        "campaign_id": "'c' || k % 7", "mail_type": "'m' || k % 2", "sent_date": "timestamp",
        "response_date": "CASE WHEN k >= 50 THEN timestamp + INTERVAL 1 DAY END",
        "responded": "k >= 50", "offer_redeemed": "value >= 100",
    },
}


def channel_table(spark: SparkSession, sf_dir: str, channel: str) -> DataFrame:
    """The events of one channel, in that channel's own layout."""
    sources = CHANNEL_SOURCES[channel] | {"customer_id": "customer_id",
                                          "channel": f"'{channel}'"}
    layout = CHANNEL_COLUMNS[channel] | {"channel": "string"}
    event = next(e for e, c in CHANNEL_BY_EVENT.items() if c == channel)
    rows = events(spark, sf_dir).filter(f"event_type = '{event}'")
    return rows.selectExpr(*[f"CAST({sources[name]} AS {kind}) AS {name}"
                             for name, kind in layout.items()])


def channel_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {channel: channel_table(spark, sf_dir, channel) for channel in CHANNELS}


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with region and preferred brand (a brandless one in 23)."""
    customer, nation, region, part = (table(spark, sf_dir, name) for name in
                                      ("customer", "nation", "region", "part"))
    places = (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
              .select("n_nationkey", F.col("r_name").alias("region")))
    parts = part.agg(F.count("*")).scalar()
    brands = part.select("p_partkey", F.col("p_brand").alias("_brand"))
    return (
        customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .withColumn("_part", F.col("c_custkey") % parts)
        .join(brands, F.col("_part") == F.col("p_partkey"), "left")
        .withColumn("brand_preference", F.when(F.col("c_custkey") % 23 != 0, F.col("_brand")))
        .withColumn("customer_id", F.col("c_custkey").cast("string"))
        .drop("_part", "p_partkey", "_brand", "n_nationkey")
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer profiles."""
    purchases = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("last_purchase_date"),
        F.count("*").cast("int").alias("total_purchases"),
        F.avg("o_totalprice").alias("average_order_value"))
    sources = {
        "customer_id": "customer_id",
        "age": "CASE WHEN c_custkey % 17 <> 0 THEN 18 + c_custkey % 60 END",
        "gender": "CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END",
        "region": "region", "brand_preference": "brand_preference",
        "customer_segment": "c_mktsegment", "lifetime_value": "c_acctbal",
        "acquisition_channel": f"get(array({', '.join(map(repr, CHANNELS))}), "
                               "CAST(c_custkey % 6 AS int))",
        "registration_date": "TIMESTAMP '2020-01-01' + make_dt_interval(c_custkey % 1000)",
        "last_purchase_date": "last_purchase_date", "total_purchases": "total_purchases",
        "average_order_value": "average_order_value",
    }
    joined = customer_places(spark, sf_dir).join(
        purchases, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.selectExpr(*[f"CAST({sources[name]} AS {kind}) AS {name}"
                               for name, kind in CUSTOMER_COLUMNS.items()])


def experiment_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("customer_segment"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment outcomes of every customer."""
    at, is_buy = F.col("ts"), F.col("event_type") == "purchase"
    activity = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.sum(F.when(is_buy, F.col("value"))).alias("_revenue"),
        F.min(at).alias("_first"), F.min(F.when(is_buy, at)).alias("_bought"),
        F.avg(F.when(F.col("event_type") == "view", F.col("value")))
        .alias("satisfaction_score"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("_orders"))
    return (
        table(spark, sf_dir, "customer")
        .join(activity, F.col("c_custkey") == F.col("user_id"), "left")
        .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("_bought").isNotNull().cast("int").alias("converted"),
            F.coalesce("_revenue", F.lit(0.0)).alias("revenue"),
            (F.col("c_acctbal") >= 5000).cast("int").alias("engaged"),
            (F.coalesce("_orders", F.lit(0)) >= 10).cast("int").alias("retained"),
            F.datediff("_bought", "_first").cast("double").alias("time_to_conversion"),
            "satisfaction_score",
        )
    )


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("converted"),
        F.col("o_totalprice").alias("revenue"))


def event_messages(rows: DataFrame) -> DataFrame:
    """Raw messages of the event topic."""
    body = F.struct("customer_id", "event_type", "channel", "timestamp",
                    F.create_map(F.lit("k"), F.col("k").cast("string")).alias("properties"))
    iso = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return rows.select(F.col("customer_id").cast("binary").alias("key"),
                       F.to_json(body, iso).cast("binary").alias("value"), "timestamp")


def request_rows(rows: DataFrame, places: DataFrame) -> DataFrame:
    """A request per event that is no page view.

    App requests name their own region in the context; requests after an error have no context,
    and half of them no session.
    """
    kind = F.col("event_type")
    named = F.create_map(F.lit("channel"), F.col("channel"),
                         F.lit("session_id"), F.col("session_id"))
    app = F.map_concat(named, F.create_map(F.lit("region"), F.lit("APP")))
    context = F.when(kind == "signup", app).when(kind != "error", named)
    session = F.when((kind == "error") & (F.col("k") >= 50), F.col("session_id"))
    asked = rows.filter(kind != "view").select(
        F.col("event_id").alias("request_id"), "customer_id", "timestamp",
        context.alias("channel_context"), session.alias("session_id"))
    return asked.join(places.select("customer_id", "region",
                                    F.col("brand_preference").alias("brand")),
                      "customer_id", "left")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_rows(events(spark, sf_dir), customer_places(spark, sf_dir))


def request_messages(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Raw messages of the request topic: the requests, and what page views leave there, which
    is JSON without a customer or no JSON at all."""
    body = F.struct("customer_id", "channel_context", "region", "brand", "session_id")
    good = asked.select(F.col("customer_id").alias("key"), F.to_json(body).alias("value"),
                        "timestamp")
    noise = F.when(F.col("k") >= 50, F.col("props")).otherwise(F.substring("props", 1, 4))
    bad = rows.filter(F.col("event_type") == "view").select(
        F.col("customer_id").alias("key"), noise.alias("value"), "timestamp")
    return good.unionByName(bad).select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
        "timestamp")


def stored_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views write two features to the store."""
    return view_writes(events(spark, sf_dir))


def view_writes(rows: DataFrame) -> DataFrame:
    views = (rows.filter(F.col("event_type") == "view")
             .select("customer_id", F.col("timestamp").alias("written_at"),
                     F.col("value").alias("session_duration"), F.col("k").alias("page_views")))
    return feature_writes(views, STORED_FEATURES, ttl_seconds=STORE_TTL_SECONDS)


def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, customer and time of the requests, without the joins for what else they carry."""
    return keys_of_requests(events(spark, sf_dir))


def keys_of_requests(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("event_type") != "view").select(
        F.col("event_id").alias("request_id"), "customer_id", "timestamp")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicted probability per order, from its priority."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") / 10)
        .alias("predicted_conversion"))


def order_history_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(predictions(spark, sf_dir), "o_orderkey")
    return joined.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("converted"),
        F.col("o_totalprice").alias("revenue"), "predicted_conversion")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_sessions(events(spark, sf_dir))


def service_log_rows(rows: DataFrame) -> DataFrame:
    """Request log entries: every event is a request that was answered."""
    bucket = hash_bucket(F.col("customer_id"), F.lit("model_version_test"))
    group = F.when(bucket < 50, "A").otherwise("B")
    return rows.select(
        F.col("event_id").alias("request_id"),
        "customer_id", action_label(F.col("event_id") % 5).alias("recommended_action"),
        (F.col("k") / 100).alias("confidence_score"),
        (F.col("value") * 10).alias("latency_ms"), "timestamp",
        F.when(group == "A", "1").otherwise("2").alias("model_version"),
        group.alias("ab_test_group"))


def service_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_log_rows(events(spark, sf_dir))


def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment log entries of one test per event type."""
    group = F.when(hash_bucket(F.col("customer_id"), F.col("event_type")) < 50, "A")
    return events(spark, sf_dir).select(
        "customer_id", F.col("event_type").alias("test_name"),
        group.otherwise("B").alias("group"),
        action_label(F.col("event_id") % 5).alias("outcome"),
        F.create_map(F.lit("confidence"), F.col("k") / 100).alias("metrics"), "timestamp")
