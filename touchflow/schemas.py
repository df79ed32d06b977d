"""Record layouts, as ``{column: Spark SQL type}``.  All columns are nullable."""

# Input formats ------------------------------------------------------------------

CHANNELS = ("email", "mobile", "web", "instore", "directmail")

CHANNEL_COLUMNS = {
    "email": {
        "customer_id": "string", "email_id": "string", "campaign_id": "string",
        "sent_date": "timestamp", "opened": "boolean", "clicked": "boolean",
        "converted": "boolean", "channel": "string",
    },
    "mobile": {
        "customer_id": "string", "session_id": "string", "app_version": "string",
        "interaction_date": "timestamp", "screen_views": "int", "time_spent": "double",
        "push_notification_clicked": "boolean", "in_app_purchase": "boolean",
    },
    "web": {
        "customer_id": "string", "session_id": "string", "page_views": "int",
        "session_duration": "double", "bounce_rate": "double", "conversion_event": "boolean",
        "referrer_source": "string", "visit_date": "timestamp",
    },
    "instore": {
        "customer_id": "string", "store_id": "string", "transaction_id": "string",
        "transaction_date": "timestamp", "purchase_amount": "double",
        "product_category": "string", "loyalty_points_used": "int",
        "staff_interaction": "boolean",
    },
    "directmail": {
        "customer_id": "string", "campaign_id": "string", "mail_type": "string",
        "sent_date": "timestamp", "response_date": "timestamp", "responded": "boolean",
        "offer_redeemed": "boolean",
    },
}

CUSTOMER_COLUMNS = {
    "customer_id": "string", "age": "int", "gender": "string", "region": "string",
    "brand_preference": "string", "customer_segment": "string", "lifetime_value": "double",
    "acquisition_channel": "string", "registration_date": "timestamp",
    "last_purchase_date": "timestamp", "total_purchases": "int",
    "average_order_value": "double",
}

EVENT_COLUMNS = {
    "customer_id": "string", "event_type": "string", "channel": "string",
    "timestamp": "timestamp", "properties": "map<string,string>",
}

REQUEST_COLUMNS = {
    "customer_id": "string", "channel_context": "map<string,string>", "region": "string",
    "brand": "string", "session_id": "string",
}

RESPONSE_COLUMNS = (
    "customer_id", "recommended_action", "channel", "confidence_score", "timestamp",
    "model_version", "ab_test_group",
)

FEATURE_NAMES = (
    "hour_of_day", "day_of_week", "is_weekend", "channel", "region", "brand",
    "session_duration", "page_views",
)

# Class code -> action, by position.
ACTIONS = (
    "no_action", "email_campaign", "push_notification", "discount_offer",
    "product_recommendation",
)

# ----------------------------------------------------------------------------------------------

# How each channel maps to the common interaction record.  Expressions are Spark SQL.
INTERACTION_MAPPING = {
    "email": {"interaction_ts": "sent_date", "converted": "converted",
              "amount": "NULL", "source_key": "email_id"},
    "mobile": {"interaction_ts": "interaction_date", "converted": "in_app_purchase",
               "amount": "NULL", "source_key": "session_id"},
    "web": {"interaction_ts": "visit_date", "converted": "conversion_event",
            "amount": "NULL", "source_key": "session_id"},
    "instore": {"interaction_ts": "transaction_date", "converted": "true",
                "amount": "purchase_amount", "source_key": "transaction_id"},
    "directmail": {"interaction_ts": "coalesce(response_date, sent_date)",
                   "converted": "offer_redeemed", "amount": "NULL",
                   "source_key": "campaign_id"},
}

INTERACTION_COLUMNS = {
    "customer_id": "string", "channel": "string", "interaction_ts": "timestamp",
    "converted": "boolean", "amount": "double", "source_key": "string",
}


def ddl(columns: dict[str, str]) -> str:
    """Spark DDL text of a ``{column: type}`` layout."""
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
