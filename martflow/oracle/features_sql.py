"""DuckDB twin of ``operators.features`` for one cutoff expression."""

from __future__ import annotations

from martflow.oracle.sqlfn import cents, count_if, ddiff, gratio, isum

DEFAULT_CUTOFF = "(SELECT CAST(max(created_at) AS DATE) - 90 FROM orders_clean)"
MAX_DATE = "(SELECT max(created_at) FROM orders_clean)"

FEATURE_COLS = ["order_count", "lifetime_spend", "avg_order_value", "days_since_last_order",
                "first_to_second_order_days", "total_items_purchased", "return_rate",
                "total_sessions", "session_count_30d", "avg_session_depth", "browse_to_buy_ratio",
                "cart_abandonment_rate", "days_since_last_session",
                "distinct_products_purchased", "distinct_categories_purchased", "favorite_category",
                "price_sensitivity_score", "age", "gender", "country", "traffic_source",
                "account_age_days"]


def feature_ctes(p: str, cutoff: str = DEFAULT_CUTOFF) -> list[tuple[str, str]]:
    """CTEs ``{p}_txn, {p}_beh, {p}_prod, {p}_demo, {p}_labels, {p}_features, {p}_dataset``."""
    c = f"CAST({cutoff} AS DATE)"
    ex = "'Cancelled'"
    return [
        (f"{p}_cut", f"SELECT {c} AS cutoff"),
        (f"{p}_po", f"SELECT * FROM orders_clean WHERE status <> {ex} AND created_at < (SELECT cutoff FROM {p}_cut)"),
        (f"{p}_pi", f"SELECT * FROM order_items_clean WHERE status <> {ex} AND created_at < (SELECT cutoff FROM {p}_cut)"),
        (f"{p}_pe", f"SELECT * FROM events_clean WHERE NOT is_anonymous AND created_at < (SELECT cutoff FROM {p}_cut)"),
        (f"{p}_elig", f"SELECT DISTINCT user_id FROM {p}_po"),
        (f"{p}_txn", f"""
SELECT o.user_id, o.order_count, coalesce(i.spend_cents, 0) / 100.0 AS lifetime_spend,
       {gratio("coalesce(i.spend_cents, 0)", "o.order_count * 100", 2,
               guard="o.order_count > 0 AND coalesce(i.spend_cents, 0) > 0")} AS avg_order_value,
       {ddiff(f"(SELECT cutoff FROM {p}_cut)", "o.last_order_at")} AS days_since_last_order,
       g.first_to_second_order_days,
       coalesce(i.items, 0) AS total_items_purchased,
       {gratio("coalesce(i.returned, 0)", "coalesce(i.items, 0)", 4)} AS return_rate
FROM (SELECT user_id, count(order_id) AS order_count, max(created_at) AS last_order_at
      FROM {p}_po GROUP BY user_id) o
LEFT JOIN (SELECT user_id, {isum(cents("sale_price"))} AS spend_cents, count(order_item_id) AS items,
                  {count_if("is_returned")} AS returned
           FROM {p}_pi GROUP BY user_id) i ON o.user_id = i.user_id
LEFT JOIN (SELECT user_id, {ddiff("max(CASE WHEN rk = 2 THEN created_at END)", "min(created_at)")}
                  AS first_to_second_order_days
           FROM (SELECT user_id, created_at,
                        row_number() OVER (PARTITION BY user_id ORDER BY created_at) AS rk FROM {p}_po) t
           WHERE rk <= 2 GROUP BY user_id) g ON o.user_id = g.user_id"""),
        (f"{p}_beh", f"""
SELECT user_id, total_sessions, session_count_30d,
       {gratio("total_events", "total_sessions", 1)} AS avg_session_depth,
       {gratio("purchase_events", "product_view_events", 4)} AS browse_to_buy_ratio,
       {gratio("cart_events - purchase_events", "cart_events", 4)} AS cart_abandonment_rate,
       {ddiff(f"(SELECT cutoff FROM {p}_cut)", "last_event_at")} AS days_since_last_session
FROM (SELECT user_id, count(DISTINCT session_id) AS total_sessions, count(event_id) AS total_events,
             max(created_at) AS last_event_at,
             count(DISTINCT CASE WHEN created_at >= (SELECT cutoff FROM {p}_cut) - 30 THEN session_id END)
                 AS session_count_30d,
             {count_if("event_type = 'purchase'")} AS purchase_events,
             {count_if("event_type = 'cart'")} AS cart_events,
             {count_if("event_type = 'product'")} AS product_view_events
      FROM {p}_pe GROUP BY user_id) t"""),
        (f"{p}_pij", f"""
SELECT i.*, pr.category, pr.retail_price FROM {p}_pi i JOIN products_clean pr ON i.product_id = pr.product_id"""),
        (f"{p}_prod", f"""
SELECT a.user_id, a.distinct_products_purchased, a.distinct_categories_purchased, f.favorite_category,
       a.price_sensitivity_score
FROM (SELECT user_id, count(DISTINCT product_id) AS distinct_products_purchased,
             count(DISTINCT category) AS distinct_categories_purchased,
             round(avg(CASE WHEN retail_price > 0 THEN (retail_price - sale_price) / retail_price END), 4)
                 AS price_sensitivity_score
      FROM {p}_pij GROUP BY user_id) a
LEFT JOIN (SELECT user_id, category AS favorite_category FROM (
             SELECT user_id, category, row_number() OVER (PARTITION BY user_id
                    ORDER BY cat_cents DESC, category ASC NULLS FIRST) AS rn
             FROM (SELECT user_id, category, {isum(cents("sale_price"))} AS cat_cents
                   FROM {p}_pij GROUP BY user_id, category) x) y WHERE rn = 1) f
  ON a.user_id = f.user_id"""),
        (f"{p}_demo", f"""
SELECT user_id, age, gender, country, traffic_source,
       {ddiff(f"(SELECT cutoff FROM {p}_cut)", "created_at")} AS account_age_days
FROM customers_clean"""),
        (f"{p}_labels", f"""
SELECT user_id, CAST(CASE WHEN bool_or(created_at >= (SELECT cutoff FROM {p}_cut)) THEN 0 ELSE 1 END AS INTEGER)
           AS churned
FROM orders_clean WHERE status <> {ex} AND created_at <= {MAX_DATE}
GROUP BY user_id HAVING bool_or(created_at < (SELECT cutoff FROM {p}_cut))"""),
        (f"{p}_joined", f"""
SELECT e.user_id,
       t.order_count, t.lifetime_spend, t.avg_order_value, t.days_since_last_order,
       t.first_to_second_order_days, t.total_items_purchased, t.return_rate,
       coalesce(b.total_sessions, 0) AS total_sessions, coalesce(b.session_count_30d, 0) AS session_count_30d,
       coalesce(b.avg_session_depth, 0.0) AS avg_session_depth,
       coalesce(b.browse_to_buy_ratio, 0.0) AS browse_to_buy_ratio,
       coalesce(b.cart_abandonment_rate, 0.0) AS cart_abandonment_rate,
       coalesce(b.days_since_last_session, 360) AS days_since_last_session,
       pr.distinct_products_purchased, pr.distinct_categories_purchased, pr.favorite_category,
       pr.price_sensitivity_score,
       d.age, d.gender, d.country, d.traffic_source, d.account_age_days
FROM {p}_elig e
JOIN {p}_txn t ON e.user_id = t.user_id
LEFT JOIN {p}_beh b ON e.user_id = b.user_id
LEFT JOIN {p}_prod pr ON e.user_id = pr.user_id
JOIN {p}_demo d ON e.user_id = d.user_id"""),
        (f"{p}_dataset", f"""
SELECT j.user_id, l.churned, {", ".join("j." + f for f in FEATURE_COLS)},
       (SELECT cutoff FROM {p}_cut) AS feature_cutoff_date, 90 AS prediction_window_days,
       'v1' AS feature_version
FROM {p}_joined j JOIN {p}_labels l ON j.user_id = l.user_id"""),
        (f"{p}_snapshot", f"""
SELECT *, CAST((SELECT cutoff FROM {p}_cut) AS TIMESTAMP) AS event_timestamp FROM {p}_joined"""),
    ]
