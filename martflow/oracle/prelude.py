"""DuckDB twin of the fixture adapter, Silver and Gold, as named CTEs.

Every oracle query is ``WITH <all ctes> <select>``; DuckDB skips the CTEs a
query does not reference. The expressions mirror ``martflow.sources.fixtures``,
``martflow.operators.silver`` and ``martflow.operators.gold`` one to one.
"""

from __future__ import annotations

from martflow.oracle.sqlfn import add_days, cents, count_if, ddiff, gratio, isum, month

EX = "'Cancelled'"

ORDER_STATUS = """CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 THEN 'Cancelled'
       WHEN o_orderstatus = 'P' THEN 'Processing'
       WHEN o_orderstatus = 'O' THEN 'Shipped'
       WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'Returned'
       WHEN o_orderstatus = 'F' THEN 'Complete' END"""

RETAIL_C = "CAST(round(p_retailprice * 100) AS BIGINT)"
COST = f"((({RETAIL_C}) * (40 + 10 * (p_partkey % 5)) * 2 + 100) // 200) / 100.0"

CTES: list[tuple[str, str]] = []


def cte(name: str, sql: str) -> None:
    CTES.append((name, sql))


# ------------------------------------------------------------------ raw (adapter)
cte("b_users", f"""
SELECT c.c_custkey AS id, c.c_name AS first_name,
       'n' || CAST(c.c_custkey AS VARCHAR) AS last_name,
       lower(c.c_name) || '@example.com' AS email,
       CAST(12 + c.c_custkey % 59 AS BIGINT) AS age,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
       'S' || CAST(c.c_custkey % 7 AS VARCHAR) AS state,
       CAST(NULL AS VARCHAR) AS street_address, CAST(NULL AS VARCHAR) AS postal_code,
       CASE WHEN c.c_custkey % 100 = 0 THEN 'null' ELSE 'City' || CAST(c.c_custkey % 40 AS VARCHAR) END AS city,
       CASE WHEN c.c_nationkey = 2 THEN 'Brasil' ELSE n.n_name END AS country,
       CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
       c.c_mktsegment AS traffic_source,
       {add_days("TIMESTAMP '1994-06-01'", "c.c_custkey % 180")} AS created_at,
       CAST(NULL AS VARCHAR) AS user_geom
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")

cte("o_st", f"SELECT o_orderkey, o_custkey, o_orderdate, {ORDER_STATUS} AS order_status FROM orders")

cte("b_orders", f"""
SELECT o.o_orderkey AS order_id, o.o_custkey AS user_id, o.order_status AS status,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
       o.o_orderdate AS created_at,
       CASE WHEN o.order_status = 'Returned'
            THEN {add_days(add_days("o.o_orderdate", "o.o_orderkey % 3 + o.o_orderkey % 4 + 1"), "3")} END AS returned_at,
       CASE WHEN o.order_status NOT IN ('Processing', 'Cancelled')
            THEN {add_days("o.o_orderdate", "o.o_orderkey % 3")} END AS shipped_at,
       CASE WHEN o.order_status IN ('Complete', 'Returned')
            THEN {add_days("o.o_orderdate", "o.o_orderkey % 3 + o.o_orderkey % 4 + 1")} END AS delivered_at,
       CAST(coalesce(li.n, 0) AS BIGINT) AS num_of_item
FROM o_st o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) li
  ON o.o_orderkey = li.l_orderkey""")

cte("lines", f"""
SELECT e.*, o.o_custkey, o.o_orderdate, o.order_status, p.p_name, p.p_brand, p.p_type, p.p_retailprice,
       e.l_orderkey * 1000 + e.seq AS item_id,
       {add_days("o.o_orderdate", "e.l_orderkey % 5")} AS item_created
FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_orderkey, l_partkey,
             l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
             l_shipdate) AS seq
      FROM lineitem l) e
JOIN o_st o ON e.l_orderkey = o.o_orderkey
JOIN part p ON e.l_partkey = p.p_partkey""")

cte("b_order_items_1", f"""
SELECT item_id AS id, l_orderkey AS order_id, o_custkey AS user_id, l_partkey AS product_id,
       item_id AS inventory_item_id,
       CASE WHEN order_status = 'Cancelled' THEN 'Cancelled'
            WHEN l_returnflag = 'R' THEN 'Returned' ELSE order_status END AS status,
       item_created AS created_at,
       CASE WHEN order_status NOT IN ('Processing', 'Cancelled')
            THEN {add_days("item_created", "l_suppkey % 3")} END AS shipped_at,
       CASE WHEN order_status IN ('Complete', 'Returned') OR (order_status = 'Shipped' AND l_linestatus = 'F')
            THEN {add_days("item_created", "l_suppkey % 3 + l_partkey % 7")} END AS delivered_at,
       ((({RETAIL_C}) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * 2 + 100) // 200) / 100.0 AS sale_price
FROM lines""")

cte("b_order_items", f"""
SELECT id, order_id, user_id, product_id, inventory_item_id, status, created_at, shipped_at, delivered_at,
       CASE WHEN status = 'Returned' AND delivered_at IS NOT NULL THEN {add_days("delivered_at", "3")} END AS returned_at,
       sale_price
FROM b_order_items_1""")

cte("b_products", f"""
SELECT p_partkey AS id, {COST} AS cost, p_type AS category, p_name AS name, p_brand AS brand,
       p_retailprice AS retail_price,
       CASE WHEN p_partkey % 2 = 0 THEN 'Men' ELSE 'Women' END AS department,
       'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_partkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS distribution_center_id
FROM part""")

cte("b_inventory_items", f"""
SELECT item_id AS id, l_partkey AS product_id, o_orderdate AS created_at,
       CASE WHEN (l_orderkey + l_partkey) % 20 = 0 THEN CAST(NULL AS TIMESTAMP)
            ELSE {add_days("o_orderdate", "l_quantity")} END AS sold_at,
       {COST.replace("p_partkey", "l_partkey")} AS cost,
       p_type AS product_category, p_name AS product_name, p_brand AS product_brand,
       p_retailprice AS product_retail_price,
       CASE WHEN l_partkey % 2 = 0 THEN 'Men' ELSE 'Women' END AS product_department,
       'SKU-' || CAST(l_partkey AS VARCHAR) AS product_sku, l_partkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS product_distribution_center_id
FROM lines""")

cte("b_distribution_centers", """
SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude
FROM supplier""")

cte("b_events", f"""
SELECT event_id AS id, CASE WHEN user_id % 15 = 0 THEN NULL ELSE user_id END AS user_id,
       CAST(NULL AS BIGINT) AS sequence_number,
       CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
       {add_days("ts", "-8293")} AS created_at,
       '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS ip_address,
       CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS postal_code,
       CAST(NULL AS VARCHAR) AS browser, CAST(NULL AS VARCHAR) AS traffic_source, CAST(NULL AS VARCHAR) AS uri,
       CASE WHEN event_type = 'view' THEN 'product' WHEN event_type = 'purchase' THEN 'purchase'
            WHEN event_type = 'error' THEN 'cancel' WHEN event_type = 'click' THEN 'cart'
            WHEN event_type = 'signup' THEN
                 CASE WHEN event_id % 4 = 0 THEN 'home' WHEN event_id % 4 = 1 THEN 'department' ELSE 'cart' END
       END AS event_type
FROM events""")

# ------------------------------------------------------------------ silver
cte("customers_clean", """
SELECT id AS user_id, first_name, last_name, email, age, gender, state, street_address, postal_code,
       nullif(city, 'null') AS city, CASE WHEN country = 'Brasil' THEN 'Brazil' ELSE country END AS country,
       latitude, longitude, traffic_source, created_at
FROM b_users""")

cte("orders_clean", f"""
SELECT order_id, user_id, status, created_at, shipped_at, delivered_at, returned_at, num_of_item,
       {ddiff("shipped_at", "created_at")} AS days_to_ship, {ddiff("delivered_at", "created_at")} AS days_to_deliver
FROM b_orders""")

cte("order_items_clean", """
SELECT id AS order_item_id, order_id, user_id, product_id, inventory_item_id, status, created_at, shipped_at,
       delivered_at, returned_at, sale_price, status = 'Returned' AS is_returned
FROM b_order_items""")

cte("products_clean", """
SELECT id AS product_id, cost, category, name, brand, retail_price, department, sku, distribution_center_id,
       round(retail_price - cost, 2) AS base_margin
FROM b_products""")

cte("inventory_clean", f"""
SELECT id AS inventory_item_id, product_id, created_at, sold_at, cost, sold_at IS NOT NULL AS is_sold,
       {ddiff("sold_at", "created_at")} AS days_to_sell
FROM b_inventory_items""")

cte("events_clean", """
SELECT id AS event_id, user_id, sequence_number, session_id, created_at, city, state, postal_code, browser,
       traffic_source, uri, event_type, user_id IS NULL AS is_anonymous
FROM b_events""")

cte("distribution_centers_clean", """
SELECT id AS distribution_center_id, name, latitude, longitude FROM b_distribution_centers""")

# ------------------------------------------------------------------ gold: customer_360
cte("c360_oa", f"""
SELECT user_id, count(order_id) AS order_count, min(created_at) AS first_order_at, max(created_at) AS last_order_at
FROM orders_clean WHERE status <> {EX} GROUP BY user_id""")

cte("c360_ia", f"""
SELECT user_id, {isum(cents("sale_price"))} AS spend_cents,
       {isum(cents("sale_price"))} / count(sale_price) / 100.0 AS avg_item_sale_price,
       count(DISTINCT product_id) AS distinct_products_purchased,
       count(DISTINCT order_id) AS distinct_orders_with_items,
       {count_if("is_returned")} AS returned_item_count,
       count(order_item_id) AS total_items_purchased
FROM order_items_clean WHERE status <> {EX} GROUP BY user_id""")

cte("c360_fav", f"""
SELECT user_id, category AS favorite_category FROM (
  SELECT user_id, category,
         row_number() OVER (PARTITION BY user_id ORDER BY cat_cents DESC, category ASC NULLS FIRST) AS rn
  FROM (SELECT i.user_id, p.category, {isum(cents("i.sale_price"))} AS cat_cents
        FROM order_items_clean i JOIN products_clean p ON i.product_id = p.product_id
        WHERE i.status <> {EX} GROUP BY i.user_id, p.category) t) t2
WHERE rn = 1""")

cte("c360_gap", f"""
SELECT user_id, {ddiff("max(CASE WHEN rk = 2 THEN created_at END)", "min(created_at)")} AS first_to_second_order_days
FROM (SELECT user_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at) AS rk
      FROM orders_clean WHERE status <> {EX}) t
WHERE rk <= 2 GROUP BY user_id""")

cte("c360_ev", f"""
SELECT user_id, count(DISTINCT session_id) AS total_sessions, count(event_id) AS total_events,
       max(created_at) AS last_session_at,
       count(DISTINCT CASE WHEN {ddiff("(SELECT max(created_at) FROM events_clean)", "created_at")} <= 30
                           THEN session_id END) AS session_count_30d,
       {count_if("event_type = 'purchase'")} AS purchase_events,
       {count_if("event_type = 'cart'")} AS cart_events,
       {count_if("event_type = 'product'")} AS product_view_events
FROM events_clean WHERE NOT is_anonymous GROUP BY user_id""")

cte("customer_360", f"""
SELECT c.user_id, c.first_name, c.last_name, c.email, c.age, c.gender, c.country, c.state, c.city,
       c.traffic_source, c.created_at AS account_created_at,
       coalesce(oa.order_count, 0) AS order_count,
       coalesce(ia.spend_cents / 100.0, 0.0) AS lifetime_spend,
       {gratio("ia.spend_cents", "ia.distinct_orders_with_items * 100", 2)} AS avg_order_value,
       ia.avg_item_sale_price,
       coalesce(ia.total_items_purchased, 0) AS total_items_purchased,
       coalesce(ia.distinct_products_purchased, 0) AS distinct_products_purchased,
       {gratio("ia.returned_item_count", "ia.total_items_purchased", 4)} AS return_rate,
       fav.favorite_category, oa.first_order_at, oa.last_order_at,
       {ddiff("(SELECT max(created_at) FROM orders_clean)", "oa.last_order_at")} AS days_since_last_order,
       gap.first_to_second_order_days,
       coalesce(ev.total_sessions, 0) AS total_sessions,
       coalesce(ev.session_count_30d, 0) AS session_count_30d,
       {ddiff("(SELECT max(created_at) FROM events_clean)", "ev.last_session_at")} AS days_since_last_session,
       {gratio("ev.total_events", "ev.total_sessions", 1)} AS avg_session_depth,
       {gratio("ev.purchase_events", "ev.product_view_events", 4)} AS browse_to_buy_ratio,
       {gratio("ev.cart_events - ev.purchase_events", "ev.cart_events", 4)} AS cart_abandonment_rate
FROM customers_clean c
LEFT JOIN c360_oa oa ON c.user_id = oa.user_id
LEFT JOIN c360_ia ia ON c.user_id = ia.user_id
LEFT JOIN c360_fav fav ON c.user_id = fav.user_id
LEFT JOIN c360_gap gap ON c.user_id = gap.user_id
LEFT JOIN c360_ev ev ON c.user_id = ev.user_id""")

# ------------------------------------------------------------------ gold: product_performance
cte("pp_sales", f"""
SELECT product_id, count(order_item_id) AS units_sold, {isum(cents("sale_price"))} AS revenue_cents,
       {isum(cents("sale_price"))} / count(sale_price) / 100.0 AS avg_selling_price,
       count(DISTINCT user_id) AS unique_buyers, min(created_at) AS first_sold_at,
       max(created_at) AS last_sold_at, {count_if("is_returned")} AS units_returned
FROM order_items_clean WHERE status <> {EX} GROUP BY product_id""")

cte("pp_inv", f"""
SELECT product_id, count(inventory_item_id) AS total_units_received,
       {count_if("is_sold")} AS total_units_sold_inv, {count_if("NOT is_sold")} AS units_in_stock,
       avg(CASE WHEN is_sold THEN days_to_sell END) AS avg_days_to_sell
FROM inventory_clean GROUP BY product_id""")

_MARGIN = f"(s.revenue_cents - s.units_sold * {cents('p.cost')})"
cte("product_performance", f"""
SELECT p.product_id, p.name, p.brand, p.category, p.department, p.sku, p.cost, p.retail_price, p.base_margin,
       p.distribution_center_id, coalesce(s.units_sold, 0) AS units_sold,
       s.revenue_cents / 100.0 AS total_revenue, s.avg_selling_price,
       coalesce(s.unique_buyers, 0) AS unique_buyers, s.units_returned,
       {gratio("s.units_returned", "s.units_sold", 4)} AS return_rate,
       coalesce(v.total_units_received, 0) AS total_units_received,
       coalesce(v.units_in_stock, 0) AS units_in_stock,
       {gratio("v.total_units_sold_inv", "v.total_units_received", 4)} AS sell_through_rate,
       v.avg_days_to_sell,
       CASE WHEN s.revenue_cents IS NOT NULL THEN {_MARGIN} / 100.0 END AS total_margin,
       {gratio(_MARGIN, "s.revenue_cents", 4)} AS margin_pct,
       CAST(dense_rank() OVER (PARTITION BY p.category ORDER BY s.revenue_cents DESC NULLS LAST) AS INTEGER)
           AS category_revenue_rank,
       s.first_sold_at, s.last_sold_at
FROM products_clean p
LEFT JOIN pp_sales s ON p.product_id = s.product_id
LEFT JOIN pp_inv v ON p.product_id = v.product_id""")

# ------------------------------------------------------------------ gold: inventory_health
cte("ih_agg", f"""
SELECT product_id, count(inventory_item_id) AS total_units_received,
       {count_if("is_sold")} AS units_sold, {count_if("NOT is_sold")} AS units_in_stock,
       {isum("CASE WHEN is_sold THEN days_to_sell END")} AS sell_days,
       count(CASE WHEN is_sold THEN days_to_sell END) AS sell_n,
       max(CASE WHEN is_sold THEN sold_at END) AS last_sale_at,
       min(CASE WHEN NOT is_sold THEN created_at END) AS oldest_unsold_received_at,
       {isum(cents("cost"))} AS cost_cents, count(cost) AS cost_n
FROM inventory_clean GROUP BY product_id""")

cte("ih_1", f"""
SELECT a.*, p.category, p.name, p.brand, p.retail_price, p.distribution_center_id,
       d.name AS distribution_center_name,
       CASE WHEN a.last_sale_at IS NOT NULL
            THEN {ddiff("(SELECT max(created_at) FROM inventory_clean)", "a.last_sale_at")} END AS days_since_last_sale,
       {gratio("a.sell_n", "a.sell_days", 6)} AS daily_sell_rate
FROM ih_agg a JOIN products_clean p ON a.product_id = p.product_id
JOIN distribution_centers_clean d ON p.distribution_center_id = d.distribution_center_id""")

cte("ih_2", """
SELECT *, (units_in_stock > 0 AND (last_sale_at IS NULL OR days_since_last_sale > 365)) AS is_dead_stock,
       CASE WHEN daily_sell_rate > 0 THEN CAST(round(units_in_stock / daily_sell_rate, 0) AS BIGINT) END
           AS days_of_supply
FROM ih_1""")

cte("inventory_health", f"""
SELECT product_id, name, brand, category, distribution_center_id, distribution_center_name,
       total_units_received, units_sold, units_in_stock,
       CASE WHEN cost_n > 0 THEN cost_cents / cost_n / 100.0 END AS avg_unit_cost,
       {gratio("units_in_stock * cost_cents", "cost_n * 100", 2)} AS stock_value,
       {gratio("units_sold", "units_sold + units_in_stock", 4, guard="units_in_stock > 0")} AS turnover_rate,
       CASE WHEN sell_n > 0 THEN sell_days / sell_n END AS avg_days_to_sell,
       days_of_supply, daily_sell_rate, last_sale_at, days_since_last_sale, is_dead_stock,
       (days_of_supply IS NOT NULL AND days_of_supply < 14 AND NOT is_dead_stock) AS reorder_signal,
       oldest_unsold_received_at
FROM ih_2""")

# ------------------------------------------------------------------ gold: fulfillment_metrics
cte("fm_agg", f"""
SELECT p.distribution_center_id, {month("i.created_at")} AS order_month,
       count(i.order_item_id) AS items_fulfilled, count(DISTINCT i.order_id) AS orders_fulfilled,
       {isum("i.dd")} AS del_days, count(i.dd) AS del_n, quantile_disc(i.dd, 0.5) AS median_delivery_days,
       {isum("i.sd")} AS ship_days, count(i.sd) AS ship_n,
       {count_if("i.delivered_at IS NOT NULL AND i.dd <= 7")} AS on_time_deliveries,
       {count_if("i.delivered_at IS NOT NULL")} AS total_deliveries,
       {count_if("i.is_returned")} AS returned_items,
       {isum(cents("i.sale_price"))} AS rev_cents
FROM (SELECT *, CASE WHEN delivered_at IS NOT NULL THEN {ddiff("delivered_at", "created_at")} END AS dd,
             CASE WHEN shipped_at IS NOT NULL THEN {ddiff("shipped_at", "created_at")} END AS sd
      FROM order_items_clean) i
JOIN products_clean p ON i.product_id = p.product_id
GROUP BY 1, 2""")

cte("fulfillment_metrics", f"""
SELECT f.distribution_center_id, d.name AS distribution_center_name, f.order_month,
       f.orders_fulfilled, f.items_fulfilled,
       {gratio("f.del_days", "f.del_n", 1)} AS avg_delivery_days,
       f.median_delivery_days,
       {gratio("f.ship_days", "f.ship_n", 1)} AS avg_ship_days,
       f.on_time_deliveries, f.total_deliveries,
       {gratio("f.on_time_deliveries", "f.total_deliveries", 4)} AS on_time_rate,
       f.returned_items,
       {gratio("f.returned_items", "f.items_fulfilled", 4)} AS return_rate,
       f.rev_cents / 100.0 AS total_revenue
FROM fm_agg f JOIN distribution_centers_clean d ON f.distribution_center_id = d.distribution_center_id""")

# ------------------------------------------------------------------ gold: funnel_analytics
cte("fa_counts", f"""
SELECT user_id, {month("created_at")} AS event_month, count(DISTINCT session_id) AS sessions,
       count(event_id) AS total_events,
       {count_if("event_type = 'home'")} AS home_events,
       {count_if("event_type = 'department'")} AS department_events,
       {count_if("event_type = 'product'")} AS product_view_events,
       {count_if("event_type = 'cart'")} AS cart_events,
       {count_if("event_type = 'purchase'")} AS purchase_events,
       {count_if("event_type = 'cancel'")} AS cancel_events,
       min(created_at) AS first_event_at, max(created_at) AS last_event_at
FROM events_clean WHERE NOT is_anonymous GROUP BY 1, 2""")

cte("funnel_analytics", f"""
SELECT user_id, event_month, sessions, total_events,
       {gratio("total_events", "sessions", 1)} AS avg_session_depth,
       home_events, department_events, product_view_events, cart_events, purchase_events, cancel_events,
       {gratio("least(purchase_events, sessions)", "sessions", 4)} AS session_to_purchase_rate,
       {gratio("purchase_events", "cart_events", 4)} AS cart_to_purchase_rate,
       {gratio("product_view_events", "sessions", 1)} AS browse_depth,
       sessions - lag(sessions) OVER (PARTITION BY user_id ORDER BY event_month) AS sessions_mom_change,
       first_event_at, last_event_at
FROM fa_counts""")


def with_prelude(select_sql: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix a SELECT with every CTE (and optional extra ones)."""
    parts = CTES + (extra or [])
    body = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in parts)
    return f"WITH {body}\n{select_sql.strip()}"


# ------------------------------------------------------------------ features (default cutoff + snapshots)
from martflow.oracle.features_sql import feature_ctes  # noqa: E402

SNAPSHOT_CUTOFFS = ["2001-02-01", "2001-03-01", "2001-05-03"]
for _c in feature_ctes("fs"):
    cte(*_c)
for _i, _d in enumerate(SNAPSHOT_CUTOFFS):
    for _c in feature_ctes(f"snap{_i}", f"DATE '{_d}'"):
        cte(*_c)
cte("feature_snapshots", " UNION ALL ".join(f"SELECT * FROM snap{i}_snapshot"
                                             for i in range(len(SNAPSHOT_CUTOFFS))))
cte("entity_rows", f"""
SELECT user_id, {add_days("TIMESTAMP '2001-01-15'", "user_id % 150")} AS event_timestamp FROM customers_clean""")

# ------------------------------------------------------------------ model data, drift, signals, findings
from martflow.oracle.insight_sql import insight_ctes  # noqa: E402
from martflow.oracle.model_sql import model_ctes  # noqa: E402

for _c in model_ctes():
    cte(*_c)
for _c in insight_ctes():
    cte(*_c)
