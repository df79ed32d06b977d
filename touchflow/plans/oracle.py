"""SQL counterparts of the registered queries, for DuckDB on the same tables.

``_SHARED`` holds the derived inputs as common table expressions; ``_with`` puts those a query
needs, with what they need in turn, in front of it.
"""

from __future__ import annotations

import re

_SHARED = {
    "ev": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS customer_id, event_type,
               CASE event_type WHEN 'click' THEN 'email' WHEN 'signup' THEN 'mobile'
                    WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'instore'
                    WHEN 'error' THEN 'directmail' END AS channel,
               ts, value, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id
        FROM events""",
    "places": """
        SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS customer_id, c_acctbal, c_mktsegment,
               r_name AS region,
               CASE WHEN c_custkey % 23 <> 0 THEN p_brand END AS brand_preference
        FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part)""",
    "profile": """
        SELECT customer_id,
               CASE WHEN c_custkey % 17 <> 0 THEN 18 + c_custkey % 60 END AS age,
               CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender,
               region, brand_preference, c_mktsegment AS customer_segment,
               c_acctbal AS lifetime_value,
               CASE c_custkey % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'mobile' WHEN 2 THEN 'web'
                    WHEN 3 THEN 'instore' WHEN 4 THEN 'directmail' END AS acquisition_channel,
               TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER))
                   AS registration_date,
               last_purchase_date, total_purchases, average_order_value
        FROM places
        LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_purchase_date,
                          count(*) AS total_purchases, avg(o_totalprice) AS average_order_value
                   FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "inter": """
        SELECT customer_id, channel,
               CASE WHEN channel = 'directmail' AND k >= 50 THEN ts + INTERVAL 1 DAY ELSE ts END
                   AS interaction_ts,
               channel = 'instore' OR value >= 100 AS converted,
               CASE WHEN channel = 'instore' THEN value END AS amount,
               CASE channel WHEN 'email' THEN 'e' || event_id WHEN 'instore' THEN 't' || event_id
                    WHEN 'directmail' THEN 'c' || (k % 7) ELSE 's' || event_id END AS source_key
        FROM ev""",
    "journey": """
        SELECT p.*, brand_preference || '_' || region AS brand_region_segment,
               CASE WHEN lifetime_value > 1000 THEN 'High' WHEN lifetime_value > 500
                    THEN 'Medium' ELSE 'Low' END AS segment_priority,
               coalesce(total_interactions, 0) AS total_interactions,
               coalesce(channel_diversity, 0) AS channel_diversity,
               last_interaction_date, first_interaction_date,
               coalesce(avg_conversion_rate, 0) AS avg_conversion_rate,
               coalesce(date_diff('day', CAST(last_interaction_date AS DATE),
                                  DATE '2024-02-01'), 0) AS recency_days,
               coalesce(total_interactions / (date_diff('day',
                   CAST(first_interaction_date AS DATE), CAST(last_interaction_date AS DATE))
                   + 1), 0) AS interaction_frequency,
               total_interactions IS NOT NULL AS has_interactions
        FROM profile p
        LEFT JOIN (SELECT customer_id, count(*) AS total_interactions,
                          count(DISTINCT channel) AS channel_diversity,
                          max(interaction_ts) AS last_interaction_date,
                          min(interaction_ts) AS first_interaction_date,
                          avg(CASE WHEN converted THEN 1.0 ELSE 0.0 END) AS avg_conversion_rate
                   FROM inter GROUP BY customer_id) USING (customer_id)""",
    "req": """
        SELECT event_id AS request_id, ev.customer_id, ts,
               CASE WHEN event_type <> 'error' THEN channel END AS ctx_channel,
               CASE WHEN event_type <> 'error' THEN session_id END AS ctx_session,
               CASE WHEN event_type = 'signup' THEN 'APP' END AS ctx_region,
               CASE WHEN event_type = 'error' AND k >= 50 THEN session_id END AS top_session,
               region AS top_region, brand_preference AS top_brand
        FROM ev LEFT JOIN places ON places.customer_id = ev.customer_id
        WHERE event_type <> 'view'""",
    "ctx": """
        SELECT request_id, customer_id, ts, coalesce(ctx_channel, 'unknown') AS channel,
               coalesce(ctx_region, top_region, 'unknown') AS region,
               coalesce(top_brand, 'unknown') AS brand,
               coalesce(ctx_session, top_session) AS session_id
        FROM req""",
    "writes": """
        SELECT customer_id, ts AS written_at, value AS session_duration, k AS page_views
        FROM ev WHERE event_type = 'view'""",
    "looked": """
        SELECT r.request_id, r.customer_id,
               CASE WHEN r.ts < w.written_at + INTERVAL 1 DAY THEN w.session_duration END
                   AS stored_session_duration,
               CASE WHEN r.ts < w.written_at + INTERVAL 1 DAY
                    THEN CAST(w.page_views AS DOUBLE) END AS stored_page_views
        FROM req r ASOF LEFT JOIN writes w
          ON r.customer_id = w.customer_id AND r.ts >= w.written_at""",
    "sess": """
        SELECT session_id, min(ts) AS start_time,
               count(*) FILTER (event_type = 'view') AS page_views
        FROM ev GROUP BY session_id HAVING count(*) FILTER (event_type = 'view') > 0""",
    "sessioned": """
        SELECT c.request_id, c.session_id,
               CASE WHEN c.session_id IS NOT NULL THEN CAST(coalesce(
                   (epoch_us(c.ts) - epoch_us(s.start_time)) // 1000000, 0) AS DOUBLE) END
                   AS session_duration,
               CASE WHEN c.session_id IS NOT NULL
                    THEN CAST(coalesce(s.page_views, 0) AS DOUBLE) END AS page_views
        FROM ctx c LEFT JOIN sess s ON s.session_id = c.session_id""",
    "merged": """
        SELECT c.request_id, c.customer_id, c.ts, hour(c.ts) AS hour_of_day,
               isodow(c.ts) - 1 AS day_of_week,
               CASE WHEN isodow(c.ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
               c.channel, c.region, c.brand,
               coalesce(s.session_duration, l.stored_session_duration)
                   AS session_duration,
               coalesce(s.page_views, l.stored_page_views) AS page_views
        FROM ctx c JOIN sessioned s USING (request_id) JOIN looked l USING (request_id)""",
    "brands": """
        SELECT p_brand AS brand, row_number() OVER (ORDER BY p_brand) AS pos
        FROM (SELECT DISTINCT p_brand FROM part)""",
    "regions": """
        SELECT r_name AS region, row_number() OVER (ORDER BY r_name) AS pos FROM region""",
    "vec": """
        SELECT m.request_id, m.customer_id, m.ts, m.channel AS channel_name,
               CAST(hour_of_day AS DOUBLE) AS hour_of_day,
               CAST(day_of_week AS DOUBLE) AS day_of_week,
               CAST(is_weekend AS DOUBLE) AS is_weekend,
               CAST(coalesce(list_position(['email', 'mobile', 'web', 'instore', 'directmail'],
                    m.channel), 0) AS DOUBLE) AS channel,
               CAST(coalesce(r.pos, 0) AS DOUBLE) AS region,
               CAST(coalesce(b.pos, 0) AS DOUBLE) AS brand,
               coalesce(session_duration, 0) AS session_duration,
               coalesce(page_views, 0) AS page_views
        FROM merged m LEFT JOIN regions r ON r.region = m.region
        LEFT JOIN brands b ON b.brand = m.brand""",
    "grouped": """
        SELECT *, CASE WHEN CAST('0x' || substr(md5(customer_id || ':model_version_test'), 1, 8)
                             AS BIGINT) % 100 < 50 THEN 'A' ELSE 'B' END AS ab_test_group
        FROM vec""",
    "logits": """
        SELECT *, CASE ab_test_group WHEN 'A' THEN [
                 0.5e0,
                 0.25e0 + 0.03125e0 * hour_of_day - 0.25e0 * is_weekend + 0.25e0 * channel,
                 0.125e0 * day_of_week + 0.5e0 * is_weekend + 0.0625e0 * region,
                 0.125e0 + 0.125e0 * region + 0.03125e0 * brand,
                 0.25e0 * is_weekend + 0.0001220703125e0 * session_duration
                     + 0.03125e0 * page_views]
               ELSE [
                 0.25e0 + 0.015625e0 * hour_of_day,
                 0.0625e0 * day_of_week + 0.125e0 * channel + 0.03125e0 * brand,
                 0.5e0 - 0.03125e0 * hour_of_day + 0.75e0 * is_weekend,
                 0.25e0 * channel + 0.0625e0 * region + 0.015625e0 * page_views,
                 0.125e0 + 0.125e0 * day_of_week + 0.015625e0 * brand
                     + 0.00006103515625e0 * session_duration] END AS l
        FROM grouped""",
    "scored": """
        SELECT *, list_position(l, list_max(l)) - 1 AS prediction,
               list_transform(l, lambda x: exp(x - list_max(l))
                   / list_sum(list_transform(l, lambda y: exp(y - list_max(l))))) AS p
        FROM logits""",
    "responses": """
        SELECT request_id, customer_id,
               ['no_action', 'email_campaign', 'push_notification', 'discount_offer',
                'product_recommendation'][CAST(prediction + 1 AS INTEGER)]
                   AS recommended_action,
               channel_name AS channel, list_max(p) AS confidence_score, ts AS timestamp,
               CASE ab_test_group WHEN 'A' THEN '1' ELSE '2' END AS model_version,
               ab_test_group
        FROM scored""",
    "nbrow": """
        SELECT request_id, ab_test_group, CAST(customer_id AS BIGINT) % 5 AS y,
               CASE ab_test_group WHEN 'A' THEN 1.0e0 ELSE 2.0e0 END AS lam,
               [hour_of_day, day_of_week, is_weekend, channel, region, brand, session_duration,
                page_views] AS f
        FROM grouped""",
    # Sums per class and feature; smoothed logarithms of their shares.
    "nbsum": """
        SELECT y, i, sum(f[i]) AS s, count(*) AS n
        FROM nbrow, (SELECT unnest(range(1, 9)) AS i) GROUP BY y, i""",
    "nbmodel": """
        SELECT lam, y, ln(any_value(n) + lam) - ln((SELECT count(*) FROM nbrow) + lam
                   * (SELECT count(DISTINCT y) FROM nbrow)) AS prior,
               list(ln(s + lam) - ln(total + 8 * lam) ORDER BY i) AS theta
        FROM (SELECT *, sum(s) OVER (PARTITION BY y) AS total FROM nbsum),
             (SELECT unnest([1.0e0, 2.0e0]) AS lam)
        GROUP BY lam, y""",
    "nbscored": """
        SELECT request_id, ab_test_group, list_position(l, list_max(l)) - 1 AS prediction,
               list_transform(l, lambda x: exp(x - list_max(l))
                   / list_sum(list_transform(l, lambda z: exp(z - list_max(l))))) AS p
        FROM (SELECT r.request_id, any_value(r.ab_test_group) AS ab_test_group,
                     list(m.prior + list_sum(list_transform(list_zip(r.f, m.theta),
                          lambda q: q[1] * q[2])) ORDER BY m.y) AS l
              FROM nbrow r JOIN nbmodel m ON m.lam = r.lam GROUP BY r.request_id)""",
    "assigned": """
        SELECT customer_id, customer_segment,
               CASE WHEN rn <= n * 20 // 100 THEN 'control'
                    WHEN rn <= 2 * (n * 20 // 100) THEN 'simple_rules'
                    WHEN rn <= 2 * (n * 20 // 100) + n * 60 // 100 THEN 'ml_ensemble'
                    END AS test_group
        FROM (SELECT c_custkey AS customer_id, c_mktsegment AS customer_segment,
                     count(*) OVER (PARTITION BY c_mktsegment) AS n,
                     row_number() OVER (PARTITION BY c_mktsegment
                         ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS rn
              FROM customer)
        WHERE rn <= 2 * (n * 20 // 100) + n * 60 // 100""",
    "outcome": """
        SELECT c_custkey AS customer_id,
               CASE WHEN bought IS NOT NULL THEN 1 ELSE 0 END AS converted,
               coalesce(revenue, 0) AS revenue,
               CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END AS engaged,
               CASE WHEN coalesce(orders_n, 0) >= 10 THEN 1 ELSE 0 END AS retained,
               CAST(date_diff('day', CAST(first_at AS DATE), CAST(bought AS DATE)) AS DOUBLE)
                   AS time_to_conversion,
               satisfaction AS satisfaction_score
        FROM customer
        LEFT JOIN (SELECT user_id, sum(value) FILTER (event_type = 'purchase') AS revenue,
                          min(ts) AS first_at,
                          min(ts) FILTER (event_type = 'purchase') AS bought,
                          avg(value) FILTER (event_type = 'view') AS satisfaction
                   FROM events GROUP BY user_id) e ON e.user_id = c_custkey
        LEFT JOIN (SELECT o_custkey, count(*) AS orders_n FROM orders GROUP BY o_custkey) o
          ON o.o_custkey = c_custkey""",
    "units": """
        SELECT a.customer_segment, a.test_group, o.*
        FROM assigned a JOIN outcome o USING (customer_id)""",
    "moments": " UNION ALL ".join(
        [f"""
        SELECT '{metric}' AS metric, test_group, count(*) AS sample_size,
               sum({column}) / count(*) AS metric_value, count(*) AS n,
               sum({column}) AS total, var_samp({column}) AS variance
        FROM units GROUP BY test_group""" for metric, column in (
            ("conversion_rate", "converted"), ("revenue_per_customer", "revenue"),
            ("engagement_rate", "engaged"), ("retention_rate", "retained"))]
        + [f"""
        SELECT '{metric}' AS metric, test_group, count(*) AS sample_size,
               avg({column}) AS metric_value, count({column}) AS n,
               sum({column}) AS total, var_samp({column}) AS variance
        FROM units GROUP BY test_group""" for metric, column in (
            ("time_to_conversion", "time_to_conversion"),
            ("customer_satisfaction", "satisfaction_score"))]),
    "pairs": """
        SELECT t.metric, t.test_group, c.sample_size AS ssize1, t.sample_size AS ssize2,
               c.n AS n1, t.n AS n2, c.metric_value AS m1, t.metric_value AS m2,
               c.total AS x1, t.total AS x2, c.variance AS v1, t.variance AS v2
        FROM moments t JOIN moments c ON c.metric = t.metric AND c.test_group = 'control'
        WHERE t.test_group <> 'control'""",
    # Two-sided normal probability by Simpson's rule on [0, |z|].
    "ztest": """
        SELECT *, 1 - 2 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4
                                      ELSE 2 END
                                      * exp(-0.5 * (abs(z) * i / 2000) * (abs(z) * i / 2000)))
                                  * abs(z) / 6000 / sqrt(2 * pi())
                           FROM generate_series(0, 2000) AS g(i)) AS p_value,
               m2 - m1 - 1.959963984540054
                   * sqrt(m1 * (1 - m1) / n1 + m2 * (1 - m2) / n2) AS ci_lower,
               m2 - m1 + 1.959963984540054
                   * sqrt(m1 * (1 - m1) / n1 + m2 * (1 - m2) / n2) AS ci_upper
        FROM (SELECT *, (m2 - m1) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2))
                                         * (1 / n1 + 1 / n2)) AS z
              FROM pairs
              WHERE metric IN ('conversion_rate', 'engagement_rate', 'retention_rate'))""",
}


def _t_test(source: str) -> str:
    """t-test over rows (n1, n2, m1, m2, v1, v2): the density integrated by Simpson's rule; the
    critical value by Newton's method on that integral."""
    density = ("exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) "
               "* pow(1 + ({x}) * ({x}) / df, -(df + 1) / 2)")

    def central(bound: str) -> str:
        return f"""(SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                    * {density.format(x=f'{bound} * i / 2000')}) * {bound} / 6000
                    FROM generate_series(0, 2000) AS g(i))"""

    steps = "SELECT *, 1.959963984540054 AS q0 FROM stat"
    for i in range(6):
        steps = (f"SELECT *, q{i} - ({central(f'q{i}')} - 0.475) / ({density.format(x=f'q{i}')})"
                 f" AS q{i + 1} FROM ({steps})")
    return f"""
        SELECT *, 1 - 2 * {central('abs(t)')} AS p_value,
               m2 - m1 - q6 * se AS ci_lower, m2 - m1 + q6 * se AS ci_upper
        FROM (WITH stat AS (
                SELECT *, (m2 - m1) / se AS t
                FROM (SELECT *, CAST(n1 + n2 - 2 AS DOUBLE) AS df,
                             sqrt((coalesce((n1 - 1) * v1, 0) + coalesce((n2 - 1) * v2, 0))
                                  / (n1 + n2 - 2))
                                 * sqrt(1 / n1 + 1 / n2) AS se
                      FROM {source}))
              {steps})"""


_SHARED["ttest"] = _t_test("""(SELECT * FROM pairs WHERE metric NOT IN
    ('conversion_rate', 'engagement_rate', 'retention_rate'))""")
_SHARED["verdict"] = " UNION ALL ".join(
    f"""
        SELECT metric, test_group, '{name}' AS test, ssize1 AS control_size,
               ssize2 AS treatment_size, m1 AS control_metric, m2 AS treatment_metric,
               CASE WHEN m1 > 0 THEN (m2 - m1) / m1 * 100 ELSE 0 END AS lift_percentage,
               p_value, p_value < 0.05 AS is_significant, ci_lower, ci_upper,
               abs(m2 - m1) AS effect_size
        FROM {source}""" for name, source in (("proportion", "ztest"), ("t", "ttest")))
_SHARED["titled"] = """
        SELECT *, array_to_string(list_transform(string_split(test_group, '_'),
                   lambda w: upper(w[1]) || w[2:]), '_') AS title
        FROM verdict WHERE metric = 'conversion_rate'"""
_SHARED["best"] = """
        SELECT metric, test_group, lift_percentage, p_value, is_significant,
               CASE WHEN is_significant THEN title || printf(' group with %.2f%% lift',
                    lift_percentage) ELSE 'No statistically significant difference found' END
                   AS result,
               CASE WHEN is_significant THEN 'Deploy ' || test_group
                    || ' treatment to all customers' ELSE
                    'Continue testing with larger sample size or longer duration' END
                   AS recommendation
        FROM titled ORDER BY lift_percentage DESC, test_group LIMIT 1"""
_SHARED["windows"] = """
        SELECT window_id, row_count, rate, revenue, predicted,
               lo + to_days(CAST(30 * window_id AS INTEGER)) AS window_start,
               lo + to_days(CAST(30 * (window_id + 1) AS INTEGER)) AS window_end
        FROM (SELECT date_diff('day', lo, o_orderdate) // 30 AS window_id, any_value(lo) AS lo,
                     any_value(hi) AS hi, count(*) AS row_count,
                     avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate,
                     sum(o_totalprice) AS revenue,
                     avg(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) / 10) AS predicted
              FROM orders, (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)
              GROUP BY 1)
        WHERE lo + to_days(CAST(30 * window_id AS INTEGER)) < hi"""
_SHARED["slog"] = """
        SELECT event_id AS request_id, customer_id,
               ['no_action', 'email_campaign', 'push_notification', 'discount_offer',
                'product_recommendation'][CAST(event_id % 5 + 1 AS INTEGER)]
                   AS recommended_action,
               k / 100 AS confidence_score, value * 10 AS latency_ms, ts AS timestamp,
               CASE WHEN bucket < 50 THEN '1' ELSE '2' END AS model_version,
               CASE WHEN bucket < 50 THEN 'A' ELSE 'B' END AS ab_test_group
        FROM (SELECT *, CAST('0x' || substr(md5(customer_id || ':model_version_test'), 1, 8)
                             AS BIGINT) % 100 AS bucket FROM ev)"""


def _with(sql: str) -> str:
    """Prefixes the shared expressions the text names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _SHARED:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(_SHARED[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({_SHARED[n]})" for n in needed) + "\n" + sql


def _ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {name or column}"


_SCANS = {
    "email": f"""'e' || event_id AS email_id, 'c' || (k % 7) AS campaign_id,
        {_ts('ts', 'sent_date')}, value >= 20 AS opened, value >= 50 AS clicked,
        value >= 100 AS converted""",
    "mobile": f"""'s' || event_id AS session_id, 'v' || (k % 4) AS app_version,
        {_ts('ts', 'interaction_date')}, CAST(k AS BIGINT) AS screen_views,
        round(value, 6) AS time_spent, k >= 50 AS push_notification_clicked,
        value >= 100 AS in_app_purchase""",
    "web": f"""'s' || event_id AS session_id, CAST(k AS BIGINT) AS page_views,
        round(value, 6) AS session_duration, round(k / 100, 6) AS bounce_rate,
        value >= 100 AS conversion_event, 'r' || (k % 3) AS referrer_source,
        {_ts('ts', 'visit_date')}""",
    "instore": f"""'store' || (k % 10) AS store_id, 't' || event_id AS transaction_id,
        {_ts('ts', 'transaction_date')}, round(value, 6) AS purchase_amount,
        'cat' || (k % 5) AS product_category, CAST(k AS BIGINT) AS loyalty_points_used,
        k >= 50 AS staff_interaction""",
    "directmail": f"""'c' || (k % 7) AS campaign_id, 'm' || (k % 2) AS mail_type,
        {_ts('ts', 'sent_date')},
        {_ts('CASE WHEN k >= 50 THEN ts + INTERVAL 1 DAY END', 'response_date')},
        k >= 50 AS responded, value >= 100 AS offer_redeemed""",
}

_PROFILE = f"""customer_id, {{age}} AS age, gender, region, brand_preference, customer_segment,
    round({{ltv}}, 6) AS lifetime_value, acquisition_channel, {_ts('registration_date')},
    {_ts('last_purchase_date')}, {{purchases}} AS total_purchases,
    round({{order_value}}, 6) AS average_order_value"""

_INTERACTIONS = f"""SELECT customer_id, channel, {_ts('interaction_ts')}, converted,
    round(amount, 6) AS amount, source_key FROM inter"""

_ACTIVITY = f"""
    SELECT {_ts('w', 'window_start')}, customer_id, count(*) AS event_count,
           string_agg(channel, ',' ORDER BY channel) AS channels_used,
           {_ts('max(ts)', 'last_activity')}
    FROM (SELECT *, unnest(list_transform([0, 1, 2, 3, 4],
                 lambda i: date_trunc('minute', ts) - to_minutes(i))) AS w FROM ev)
    GROUP BY w, customer_id"""

_CHANNEL_COUNTS = f"""
    SELECT {_ts('w', 'window_start')}, customer_id, CAST(sum(n) AS BIGINT) AS event_count,
           string_agg(channel || '=' || n, ',' ORDER BY channel) AS channel_counts,
           {_ts('max(last)', 'last_activity')}
    FROM (SELECT w, customer_id, channel, count(*) AS n, max(ts) AS last
          FROM (SELECT *, unnest(list_transform([0, 1, 2, 3, 4],
                       lambda i: date_trunc('minute', ts) - to_minutes(i))) AS w FROM ev)
          GROUP BY w, customer_id, channel)
    GROUP BY w, customer_id"""

_RESPONSES = f"""customer_id, recommended_action, channel,
    round(confidence_score, 6) AS confidence_score, {_ts('timestamp')}, model_version,
    ab_test_group"""

_MINUTES = f"""SELECT {_ts("date_trunc('minute', timestamp)", 'minute')},
    count(*) AS request_count, round(sum(latency_ms), 6) AS latency_sum,
    count(latency_ms) AS latency_count FROM slog GROUP BY date_trunc('minute', timestamp)"""


def _rolling(minutes: int) -> str:
    return f"""
    SELECT coalesce(sum(n), 0)::BIGINT AS request_count,
           round(coalesce(sum(latency) / sum(n), 0), 6) AS average_latency,
           string_agg(recommended_action || '=' || n, ',' ORDER BY recommended_action)
               AS action_distribution,
           '2024-01-15 12:00:30.000000' AS timestamp
    FROM (SELECT recommended_action, count(*) AS n, sum(latency_ms) AS latency FROM slog
          WHERE timestamp >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL {minutes - 1} MINUTE
            AND timestamp <= TIMESTAMP '2024-01-15 12:00:30'
          GROUP BY recommended_action)"""


def _alerts(source: str, at: str) -> str:
    return f"""
    SELECT {at} AS timestamp, 'high_latency' AS type,
           printf('High latency detected: %.2fms', average_latency) AS message,
           'warning' AS severity
    FROM {source} WHERE average_latency > 1000
    UNION ALL
    SELECT {at}, 'low_volume', 'Low request volume: ' || request_count || ' requests', 'info'
    FROM {source} WHERE request_count < 10"""


_ALERT_RANGES = """
    SELECT e AS range_end, sum(n) AS request_count,
           round(CASE WHEN sum(n) > 0 THEN sum(latency) / sum(n) ELSE 0 END, 9) AS average_latency
    FROM (SELECT unnest([m + to_minutes(1), m + to_minutes(2), m + to_minutes(3),
                         m + to_minutes(4), m + to_minutes(5)]) AS e, n, latency
          FROM (SELECT date_trunc('minute', timestamp) AS m, count(*) AS n,
                       sum(latency_ms) AS latency FROM slog GROUP BY 1
                UNION ALL
                SELECT unnest(generate_series(min(date_trunc('minute', timestamp)),
                       max(date_trunc('minute', timestamp)), INTERVAL 1 MINUTE)), 0, 0
                FROM slog))
    GROUP BY e"""


def _alert_windows(where: str = "true") -> str:
    return f"""(
    SELECT strftime(range_end, '%Y-%m-%d %H:%M:%S.%f') AS range_end,
           CAST(request_count AS BIGINT) AS request_count, average_latency
    FROM ({_ALERT_RANGES}) WHERE {where})"""


_TEST_COLUMNS = """round({z}, 6) AS statistic, round(p_value, 6) AS p_value,
    round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper"""



def _summary(vertical: str, primary: str, metrics: str) -> str:
    titled = f"""(SELECT *, array_to_string(list_transform(string_split(test_group, '_'),
        lambda w: upper(w[1]) || w[2:]), '_') AS title FROM verdict WHERE metric = '{primary}')"""
    best = f"(SELECT * FROM {titled} ORDER BY lift_percentage DESC, test_group LIMIT 1)"
    return f"""
        SELECT 'overview' AS section, CAST(NULL AS VARCHAR) AS test_group,
               'Vertical Type' AS label, '{vertical}' AS value
        UNION ALL SELECT 'overview', NULL, 'Primary Metric', '{primary}'
        UNION ALL SELECT 'overview', NULL, 'Test Duration', '28 days'
        UNION ALL
        SELECT 'sample_size', test_group, 'Customers', CAST(count(*) AS VARCHAR)
        FROM units GROUP BY test_group
        UNION ALL
        SELECT 'result', test_group, array_to_string(list_transform(string_split(metric, '_'),
               lambda w: upper(w[1]) || w[2:]), ' '), printf('%.4f', metric_value) FROM moments
        WHERE metric IN ({metrics})
        UNION ALL
        SELECT 'significance', title || ' vs Control', 'Lift',
               printf('%.2f%%', lift_percentage) FROM {titled}
        UNION ALL
        SELECT 'significance', title || ' vs Control', 'P-value', printf('%.4f', p_value)
        FROM {titled}
        UNION ALL
        SELECT 'significance', title || ' vs Control', 'Statistically Significant',
               CASE WHEN is_significant THEN 'Yes' ELSE 'No' END FROM {titled}
        UNION ALL
        SELECT 'significance', title || ' vs Control', 'Confidence Interval',
               printf('[%.4f, %.4f]', ci_lower, ci_upper) FROM {titled}
        UNION ALL
        SELECT 'recommendation', test_group,
               CASE WHEN is_significant THEN 'Winner' ELSE 'Result' END,
               CASE WHEN is_significant THEN title || printf(' group with %.2f%% lift',
                    lift_percentage) ELSE 'No statistically significant difference found' END
        FROM {best}
        UNION ALL
        SELECT 'recommendation', test_group, 'Recommendation',
               CASE WHEN is_significant THEN 'Deploy ' || test_group
                    || ' treatment to all customers' ELSE
                    'Continue testing with larger sample size or longer duration' END
        FROM {best}"""


_QUERIES = {
    **{f"scan_{channel}": f"SELECT customer_id, '{channel}' AS channel, {columns} "
                          f"FROM ev WHERE channel = '{channel}'"
       for channel, columns in _SCANS.items()},
    "scan_customers": "SELECT " + _PROFILE.format(
        age="age", ltv="lifetime_value", purchases="total_purchases",
        order_value="average_order_value") + " FROM profile",
    "channel_counts": "SELECT channel, count(*) AS record_count FROM inter GROUP BY channel",
    "sink_roundtrip": _INTERACTIONS,
    "tag_channel": "SELECT event_id, customer_id, value, 'web' AS channel FROM ev",
    "segmentation": """SELECT customer_id, brand_preference || '_' || region
        AS brand_region_segment, CASE WHEN lifetime_value > 1000 THEN 'High'
        WHEN lifetime_value > 500 THEN 'Medium' ELSE 'Low' END AS segment_priority
        FROM profile""",
    "combined_interactions": _INTERACTIONS,
    "journey_features": "SELECT " + _PROFILE.format(
        age="coalesce(age, 0)", ltv="coalesce(lifetime_value, 0)",
        purchases="coalesce(total_purchases, 0)",
        order_value="coalesce(average_order_value, 0)") + f""",
        brand_region_segment, segment_priority, total_interactions, channel_diversity,
        {_ts('last_interaction_date')}, {_ts('first_interaction_date')},
        round(avg_conversion_rate, 6) AS avg_conversion_rate, recency_days,
        round(interaction_frequency, 6) AS interaction_frequency, has_interactions
        FROM journey""",
    "training_data": """SELECT customer_id, total_interactions, channel_diversity, recency_days,
        round(interaction_frequency, 6) AS interaction_frequency,
        round(coalesce(lifetime_value, 0), 6) AS lifetime_value,
        round(coalesce(average_order_value, 0), 6) AS average_order_value,
        CAST(customer_id AS BIGINT) % 5 AS next_best_action,
        recency_days // 7 AS interaction_window FROM journey""",
    "time_features": f"""SELECT event_id, {_ts('ts', 'timestamp')}, hour(ts) AS hour_of_day,
        dayofweek(ts) + 1 AS day_of_week,
        CAST(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS BIGINT) AS is_weekend
        FROM ev""",
    "request_time_features": f"""SELECT request_id, {_ts('ts', 'timestamp')},
        hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
        CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend FROM req""",
    "context_features": "SELECT request_id, channel, region, brand, session_id FROM ctx",
    "action_mapping": """SELECT event_id, coalesce(['no_action', 'email_campaign',
        'push_notification', 'discount_offer', 'product_recommendation']
        [CAST(event_id % 7 + 1 AS INTEGER)], 'no_action') AS action FROM ev""",
    "parse_events": f"""SELECT customer_id, event_type, channel, {_ts('ts', 'timestamp')},
        CAST(k AS VARCHAR) AS k FROM ev""",
    "parse_requests": f"""SELECT customer_id, coalesce(array_to_string(list_sort(list_filter(
        [ctx_channel, ctx_session, ctx_region], lambda x: x IS NOT NULL)), ','), '')
        AS context_values, {_ts('ts', 'timestamp')},
        coalesce(top_region, 'unknown') AS region, coalesce(top_brand, 'unknown') AS brand,
        coalesce(top_session, '') AS session_id FROM req""",
    "rejected_requests": f"""SELECT CASE WHEN k >= 50 THEN props ELSE substr(props, 1, 4) END
        AS value, {_ts('ts', 'timestamp')},
        CASE WHEN k >= 50 THEN 'no customer_id' ELSE 'not JSON' END AS reason
        FROM ev WHERE event_type = 'view'""",
    "experiment_plan": """SELECT customer_segment, n AS segment_size, test_group, treatment,
        description, CAST(allocation_percent AS BIGINT) AS allocation_percent,
        n * allocation_percent // 100 AS group_size, 'conversion_rate' AS primary_metric,
        CAST(28 AS BIGINT) AS duration_days
        FROM (SELECT c_mktsegment AS customer_segment, count(*) AS n FROM customer GROUP BY 1)
        CROSS JOIN (VALUES ('control', 'random_assignment', 'Random assignment baseline', 20),
            ('simple_rules', 'business_rules', 'Simple recommendation rules', 20),
            ('ml_ensemble', 'ensemble_model', 'ML ensemble recommendations', 60))
            AS g(test_group, treatment, description, allocation_percent)""",
    "stratified_assignment": "SELECT customer_id, customer_segment, test_group FROM assigned",
    "hash_assignment": """SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
        CASE WHEN CAST('0x' || substr(md5(c_custkey || ':model_version_test'), 1, 8) AS BIGINT)
             % 100 < 50 THEN 'A' ELSE 'B' END AS test_group FROM customer""",
    "sample_size_by_segment": """SELECT customer_segment, n AS segment_size,
        round(r, 6) AS baseline_rate,
        CAST(ceil(2 * pow((1.959963984540054 + 0.8416212335729143) / (0.02
             / sqrt((r + 0.01) * (1 - r - 0.01))), 2)) AS BIGINT) AS required_per_group
        FROM (SELECT c_mktsegment AS customer_segment, count(*) AS n,
                     sum(converted) / count(*) AS r
              FROM customer JOIN outcome ON customer_id = c_custkey GROUP BY c_mktsegment)""",
    "retail_metrics": """SELECT test_group, count(*) AS sample_size,
        round(sum(converted) / count(*), 6) AS conversion_rate,
        round(sum(revenue) / count(*), 6) AS revenue_per_customer,
        round(sum(engaged) / count(*), 6) AS engagement_rate,
        round(sum(retained) / count(*), 6) AS retention_rate
        FROM units GROUP BY test_group""",
    "retail_metrics_without_revenue": """SELECT test_group, count(*) AS sample_size,
        round(sum(converted) / count(*), 6) AS conversion_rate,
        CAST(0 AS DOUBLE) AS revenue_per_customer,
        round(sum(engaged) / count(*), 6) AS engagement_rate,
        CAST(0 AS DOUBLE) AS retention_rate FROM units GROUP BY test_group""",
    "non_retail_metrics": """SELECT test_group, count(*) AS sample_size,
        round(sum(engaged) / count(*), 6) AS engagement_rate,
        round(sum(converted) / count(*), 6) AS conversion_rate,
        round(avg(time_to_conversion), 6) AS time_to_conversion,
        round(avg(satisfaction_score), 6) AS customer_satisfaction
        FROM units GROUP BY test_group""",
    "distinct_groups": "SELECT DISTINCT test_group FROM assigned",
    "proportion_test": f"""SELECT metric, test_group, {_TEST_COLUMNS.format(z='z')}
        FROM ztest""",
    "t_test": f"""SELECT metric, test_group, {_TEST_COLUMNS.format(z='t')} FROM ttest""",
    "t_test_assumed_cv": f"""SELECT metric, test_group, {_TEST_COLUMNS.format(z='t')}
        FROM ({_t_test('''(SELECT metric, test_group, ssize1 AS n1, ssize2 AS n2, m1, m2,
            m1 * m1 * 0.04 AS v1, m2 * m2 * 0.04 AS v2 FROM pairs
            WHERE metric = 'revenue_per_customer')''')})""",
    "significance": """SELECT metric, test_group, test, control_size, treatment_size,
        round(control_metric, 6) AS control_metric,
        round(treatment_metric, 6) AS treatment_metric,
        round(lift_percentage, 6) AS lift_percentage, round(p_value, 6) AS p_value,
        is_significant, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper,
        round(effect_size, 6) AS effect_size FROM verdict""",
    "experiment_winner": """SELECT metric, test_group,
        round(lift_percentage, 6) AS lift_percentage, round(p_value, 6) AS p_value,
        is_significant, result, recommendation FROM best""",
    "experiment_summary": _summary("retail", "conversion_rate", """'conversion_rate',
        'revenue_per_customer', 'engagement_rate', 'retention_rate'"""),
    "non_retail_summary": _summary("non_retail", "engagement_rate", """'conversion_rate',
        'engagement_rate', 'time_to_conversion', 'customer_satisfaction'"""),
    "backtest_windows": f"""SELECT window_id, {_ts('window_start')}, {_ts('window_end')},
        row_count, round(rate, 4) AS actual_conversion_rate,
        round(CAST(0.12 AS DOUBLE), 4) AS predicted_conversion_rate,
        round(revenue, 4) AS actual_revenue,
        round(CAST(row_count * 0.12 * 50 AS DOUBLE), 4) AS predicted_revenue,
        round(1 - abs(rate - CAST(0.12 AS DOUBLE)), 4) AS prediction_accuracy FROM windows""",
    "backtest_predicted": f"""SELECT window_id, {_ts('window_start')}, {_ts('window_end')},
        row_count, round(rate, 8) AS actual_conversion_rate,
        round(predicted, 8) AS predicted_conversion_rate, round(revenue, 4) AS actual_revenue,
        round(row_count * predicted * 50, 8) AS predicted_revenue,
        round(1 - abs(rate - predicted), 8) AS prediction_accuracy FROM windows""",
    "backtest_overall": """SELECT round(avg(rate), 4) AS avg_conversion_rate,
        round(avg(1 - abs(rate - CAST(0.12 AS DOUBLE))), 4) AS avg_prediction_accuracy,
        round(sum(revenue), 4) AS total_revenue, count(*) AS num_windows FROM windows""",
    "sliding_activity": _ACTIVITY,
    "sliding_channel_counts": _CHANNEL_COUNTS,
    "feature_upsert": f"""
        SELECT customer_id, 'session_duration' AS feature,
               CAST(arg_max(session_duration, written_at) AS VARCHAR) AS value,
               {_ts('max(written_at)', 'written_at')}, CAST(86400 AS BIGINT) AS ttl_s
        FROM writes GROUP BY customer_id
        UNION ALL
        SELECT customer_id, 'page_views', CAST(arg_max(page_views, written_at) AS VARCHAR),
               {_ts('max(written_at)', 'written_at')}, 86400 FROM writes GROUP BY customer_id""",
    "feature_lookup": """SELECT request_id, customer_id, stored_session_duration,
        stored_page_views FROM looked""",
    "session_features": "SELECT request_id, session_id, session_duration, page_views "
                        "FROM sessioned",
    "merged_features": """SELECT request_id, hour_of_day, day_of_week,
        CAST(is_weekend AS BIGINT) AS is_weekend, channel, region, brand, session_duration,
        page_views FROM merged""",
    "feature_vector": """SELECT request_id, hour_of_day, day_of_week, is_weekend, channel,
        region, brand, session_duration, page_views FROM vec""",
    "model_routing": """SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
        CASE WHEN b < 50 THEN 'A' ELSE 'B' END AS ab_test_group,
        CASE WHEN b < 50 THEN 'recommendation_model_v1' ELSE 'recommendation_model_v2' END
            AS model_name,
        CASE WHEN b < 50 THEN '1' ELSE 'unknown' END AS model_version
        FROM (SELECT c_custkey, CAST('0x' || substr(md5(c_custkey || ':model_version_test'),
                     1, 8) AS BIGINT) % 100 AS b FROM customer)""",
    "score_linear": """SELECT request_id, CASE ab_test_group WHEN 'A'
        THEN 'recommendation_model_v1' ELSE 'recommendation_model_v2' END AS model_name,
        CAST(prediction AS BIGINT) AS prediction, round(list_max(p), 6) AS confidence,
        round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2,
        round(p[4], 6) AS p3, round(p[5], 6) AS p4 FROM scored""",
    "score_batch": """SELECT request_id, CASE ab_test_group WHEN 'A'
        THEN 'recommendation_model_v1' ELSE 'recommendation_model_v2' END AS model_name,
        CAST(prediction AS BIGINT) AS prediction, round(list_max(p), 6) AS confidence,
        round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2,
        round(p[4], 6) AS p3, round(p[5], 6) AS p4 FROM nbscored""",
    "score_mixed": """SELECT request_id, CASE ab_test_group WHEN 'A'
        THEN 'recommendation_model_v1' ELSE 'recommendation_model_v2' END AS model_name,
        CAST(prediction AS BIGINT) AS prediction, round(list_max(p), 6) AS confidence
        FROM scored""",
    "fallback_responses": f"""SELECT request_id, customer_id,
        CASE ab_test_group WHEN 'A' THEN recommended_action ELSE 'no_action' END
            AS recommended_action,
        CASE ab_test_group WHEN 'A' THEN channel ELSE 'unknown' END AS channel,
        CASE ab_test_group WHEN 'A' THEN round(confidence_score, 6) ELSE 0 END
            AS confidence_score, {_ts('timestamp')},
        CASE ab_test_group WHEN 'A' THEN model_version ELSE 'error' END AS model_version,
        CASE ab_test_group WHEN 'A' THEN 'A' ELSE 'error' END AS ab_test_group,
        ab_test_group = 'A' AS logged FROM responses""",
    "session_table": f"""SELECT session_id, {_ts('start_time')}, page_views,
        CAST(start_time AS DATE) AS log_date FROM sess""",
    "onehot_proba": "SELECT event_id, " + ", ".join(
        f"CAST(event_id % 5 = {i} AS DOUBLE) AS p{i}" for i in range(5)) + " FROM ev",
    "recommendations": f"SELECT request_id, {_RESPONSES} FROM responses",
    "encode_responses": """SELECT customer_id AS key, '{"customer_id":"' || customer_id
        || '","recommended_action":"' || recommended_action || '","channel":"' || channel
        || '","confidence_score":' || round(confidence_score, 4) || ',"timestamp":"'
        || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '","model_version":"'
        || model_version || '","ab_test_group":"' || ab_test_group || '"}' AS value
        FROM responses""",
    "experiment_log": f"""SELECT request_id, customer_id, 'model_version_test' AS test_name,
        ab_test_group AS "group", recommended_action AS outcome,
        round(confidence_score, 6) AS confidence, {_ts('timestamp')} FROM responses""",
    "latest_results": f"""SELECT customer_id, event_type AS test_name,
        CASE WHEN CAST('0x' || substr(md5(customer_id || ':' || event_type), 1, 8) AS BIGINT)
             % 100 < 50 THEN 'A' ELSE 'B' END AS "group",
        ['no_action', 'email_campaign', 'push_notification', 'discount_offer',
         'product_recommendation'][CAST(event_id % 5 + 1 AS INTEGER)] AS outcome,
        {_ts('ts', 'timestamp')} FROM ev
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, customer_id DESC)
                <= 1000""",
    "request_log": f"""SELECT request_id, customer_id, recommended_action,
        round(confidence_score, 6) AS confidence_score, round(latency_ms, 6) AS latency_ms,
        {_ts('timestamp')}, model_version, ab_test_group FROM slog""",
    "requests_per_minute": _MINUTES,
    "action_distribution": f"""SELECT {_ts("date_trunc('minute', timestamp)", 'minute')},
        recommended_action, count(*) AS action_count FROM slog
        GROUP BY date_trunc('minute', timestamp), recommended_action""",
    "rolling_metrics": _rolling(60),
    "rolling_metrics_day": _rolling(1440),
    "alerts": _alerts(f"({_rolling(5)})", "'2024-01-15 12:00:30.000000'"),
    "alert_windows": _alerts(_alert_windows(), "range_end"),
}

_QUERIES["scan_checked"] = f"""{_QUERIES["scan_web"]}
    AND event_id % 7 <> 0 AND event_id % 11 <> 0"""
_QUERIES["scan_rejects"] = """SELECT 's' || event_id AS session_id,
        concat_ws(', ', CASE WHEN event_id % 7 = 0 THEN 'page_views' END,
                  CASE WHEN event_id % 11 = 0 THEN 'visit_date' END) AS reason
    FROM ev WHERE channel = 'web' AND (event_id % 7 = 0 OR event_id % 11 = 0)"""
_QUERIES["latest_results_folders"] = _QUERIES["latest_results"]
_QUERIES["feature_lookup_compacted"] = """SELECT l.request_id, l.customer_id,
        l.stored_session_duration, l.stored_page_views
    FROM looked l JOIN req r USING (request_id) WHERE r.ts >= TIMESTAMP '2024-01-15'"""
# Streams drained to their end hold what the batch queries give.
for _name in ("parse_events", "sliding_activity", "requests_per_minute", "action_distribution",
              "alert_windows", "rejected_requests", "request_log", "session_table",
              "feature_lookup"):
    _QUERIES[f"{_name}_stream"] = _QUERIES[_name]
for _name in ("rolling_metrics", "rolling_metrics_day", "alerts"):
    _QUERIES[f"{_name}_rollup"] = _QUERIES[_name]
_QUERIES["recommendations_stream"] = _QUERIES["encode_responses"]
_QUERIES["experiment_log_stream"] = f"""SELECT customer_id, 'model_version_test' AS test_name,
    ab_test_group AS "group", recommended_action AS outcome,
    round(confidence_score, 4) AS confidence, {_ts('timestamp')} FROM responses"""

ORACLE = {name: _with(sql) for name, sql in _QUERIES.items()}
