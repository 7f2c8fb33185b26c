"""DuckDB twin of signals, drill-downs, findings and explorer queries.

The fixture pins the signal period to 2001-05 (prior: the latest earlier month).
"""

from __future__ import annotations

from martflow.oracle.sqlfn import cents, gratio, rnd

AS_OF = "TIMESTAMP '2001-05-01'"
PRIOR = f"(SELECT max(order_month) FROM fulfillment_metrics WHERE order_month < {AS_OF})"
CUR_MONTH = "(SELECT max(order_month) FROM fulfillment_metrics)"


def _avg_units(col: str, month: str, period: str, scale: int) -> str:
    u = f"CASE WHEN {month} = {period} THEN CAST(round({col} * {scale}) AS BIGINT) END"
    return f"CAST(sum({u}) AS BIGINT) / count({u}) / {float(scale)}"


def _mom(metric: str, domain: str, cur: str, prior: str, src: str) -> str:
    return (f"SELECT '{metric}' AS metric, '{domain}' AS domain, "
            f"coalesce(CAST({cur} AS DOUBLE), 0.0) AS current_value, "
            f"coalesce(CAST({prior} AS DOUBLE), 0.0) AS prior_value FROM {src}")


SIGNAL_ORDER = ["Total Revenue", "Orders Fulfilled", "Active Users", "Avg Conversion Rate",
                "Avg Delivery Days", "On-Time Delivery Rate", "Dead Stock Rate",
                "Churn Risk (Inference Batch)"]


def insight_ctes() -> list[tuple[str, str]]:
    m, e = "order_month", "event_month"
    rev_c = cents("total_revenue")
    mom = " UNION ALL ".join([
        _mom("Total Revenue", "revenue",
             f"CAST(sum(CASE WHEN {m} = {AS_OF} THEN {rev_c} END) AS BIGINT) / 100.0",
             f"CAST(sum(CASE WHEN {m} = {PRIOR} THEN {rev_c} END) AS BIGINT) / 100.0", "fulfillment_metrics"),
        _mom("Orders Fulfilled", "revenue",
             f"sum(CASE WHEN {m} = {AS_OF} THEN orders_fulfilled END)",
             f"sum(CASE WHEN {m} = {PRIOR} THEN orders_fulfilled END)", "fulfillment_metrics"),
        _mom("Avg Delivery Days", "fulfillment", _avg_units("avg_delivery_days", m, AS_OF, 10),
             _avg_units("avg_delivery_days", m, PRIOR, 10), "fulfillment_metrics"),
        _mom("On-Time Delivery Rate", "fulfillment", _avg_units("on_time_rate", m, AS_OF, 10000),
             _avg_units("on_time_rate", m, PRIOR, 10000), "fulfillment_metrics"),
        _mom("Active Users", "customers",
             f"count(DISTINCT CASE WHEN {e} = {AS_OF} THEN user_id END)",
             f"count(DISTINCT CASE WHEN {e} = {PRIOR} THEN user_id END)", "funnel_analytics"),
        _mom("Avg Conversion Rate", "conversion", _avg_units("session_to_purchase_rate", e, AS_OF, 10000),
             _avg_units("session_to_purchase_rate", e, PRIOR, 10000), "funnel_analytics"),
    ])
    order_list = "[" + ", ".join(f"'{s}'" for s in SIGNAL_ORDER) + "]"
    return [
        ("sig_mom", f"SELECT *, CASE WHEN prior_value = 0 THEN 0.0 "
                    f"ELSE (current_value - prior_value) / abs(prior_value) END AS delta_pct FROM ({mom}) t"),
        ("sig_mom2", """
SELECT *, CASE WHEN delta_pct > 0.005 THEN 'up' WHEN delta_pct < -0.005 THEN 'down' ELSE 'flat' END AS direction
FROM sig_mom"""),
        ("sig_dead", """
SELECT 'Dead Stock Rate' AS metric, 'inventory' AS domain,
       coalesce(CAST(sum(CAST(is_dead_stock AS BIGINT)) AS BIGINT) / count(*), 0.0) AS current_value,
       0.0 AS prior_value, 0.0 AS delta_pct, 'flat' AS direction,
       CASE WHEN coalesce(CAST(sum(CAST(is_dead_stock AS BIGINT)) AS BIGINT) / count(*), 0.0) < 0.1
            THEN 'info' ELSE 'warning' END AS severity
FROM inventory_health"""),
        ("sig_churn", """
SELECT 'Churn Risk (Inference Batch)' AS metric, 'churn' AS domain,
       CAST(coalesce(hi, 0) AS DOUBLE) AS current_value, CAST(n AS DOUBLE) AS prior_value,
       coalesce(hi, 0) / greatest(n, 1) AS delta_pct,
       CASE WHEN coalesce(hi, 0) / greatest(n, 1) > 0.5 THEN 'up' ELSE 'flat' END AS direction,
       CASE WHEN coalesce(hi, 0) / greatest(n, 1) > 0.5 THEN 'warning' ELSE 'normal' END AS severity
FROM (SELECT CAST(sum(CAST(churn_probability > 0.7 AS BIGINT)) AS BIGINT) AS hi, count(*) AS n FROM preds) t"""),
        ("kpi_signals", f"""
SELECT metric, domain, current_value, prior_value, delta_pct, direction, severity,
       CAST(list_position({order_list}, metric) AS INTEGER) AS signal_order
FROM (SELECT metric, domain, current_value, prior_value, delta_pct, direction,
             CASE WHEN abs(delta_pct) >= 0.1 THEN CASE WHEN direction = 'down' THEN 'critical' ELSE 'notable' END
                  WHEN abs(delta_pct) >= 0.05 THEN 'warning' ELSE 'normal' END AS severity
      FROM sig_mom2
      UNION ALL SELECT * FROM sig_dead
      UNION ALL SELECT * FROM sig_churn) t
WHERE {PRIOR} IS NOT NULL"""),
        # ---- drill-downs
        ("drills", f"""
SELECT 'revenue' AS domain, CAST(row_number() OVER (ORDER BY v1 DESC, label) AS INTEGER) AS rank, label, v1 AS value_1, v2 AS value_2
FROM (SELECT distribution_center_name AS label, {cents('total_revenue')} / 100.0 AS v1,
             CAST(orders_fulfilled AS DOUBLE) AS v2
      FROM fulfillment_metrics WHERE order_month = {AS_OF}) r
QUALIFY rank <= 5
UNION ALL
SELECT 'customers', CAST(row_number() OVER (ORDER BY v1 DESC, label) AS INTEGER), label, v1, v2
FROM (SELECT traffic_source AS label, CAST(count(*) AS DOUBLE) AS v1, avg(order_count) AS v2
      FROM customer_360 GROUP BY traffic_source) c
UNION ALL
SELECT 'conversion', CAST(row_number() OVER (ORDER BY label DESC) AS INTEGER) AS rk, label, v1, v2
FROM (SELECT strftime(event_month, '%Y-%m-%d %H:%M:%S') AS label,
             {_avg_units('session_to_purchase_rate', '1', '1', 10000)} AS v1,
             CAST(count(DISTINCT user_id) AS DOUBLE) AS v2
      FROM funnel_analytics GROUP BY event_month) v
QUALIFY rk <= 6
UNION ALL
SELECT 'fulfillment', CAST(row_number() OVER (ORDER BY v1 DESC, label) AS INTEGER) AS rk, label, v1, v2
FROM (SELECT distribution_center_name AS label,
             {_avg_units('avg_delivery_days', '1', '1', 10)} AS v1,
             {_avg_units('on_time_rate', '1', '1', 10000)} AS v2
      FROM fulfillment_metrics WHERE order_month = {AS_OF} GROUP BY distribution_center_name) f
QUALIFY rk <= 5"""),
        # ---- findings
        ("fi_sig", """
SELECT s.*, count(*) OVER (PARTITION BY domain) AS n_dom,
       sum(CAST(severity IN ('critical', 'notable', 'warning') AS INTEGER)) OVER (PARTITION BY domain) AS n_corr
FROM kpi_signals s"""),
        ("fi_act", """
SELECT s.metric, s.severity, s.signal_order, 1 + coalesce(d.n, 0) AS evidence_count,
       round(CASE WHEN 1 + coalesce(d.n, 0) > 2
                  THEN least(least(n_corr / greatest(n_dom, 1), 1.0) + 0.2, 1.0)
                  ELSE least(n_corr / greatest(n_dom, 1), 1.0) END, 2) AS confidence, 0 AS grp
FROM fi_sig s LEFT JOIN (SELECT domain, count(*) AS n FROM drills GROUP BY domain) d ON s.domain = d.domain
WHERE s.severity IN ('critical', 'notable')"""),
        ("fi_all", """
SELECT metric, severity, confidence, evidence_count, grp, signal_order FROM fi_act
UNION ALL
SELECT metric, severity, 0.6, 1, 1, signal_order FROM kpi_signals WHERE severity = 'warning'
UNION ALL
SELECT 'ML Model Monitoring Status', CASE WHEN prediction_drift_detected THEN 'warning' ELSE 'normal' END,
       round(0.7 + (CAST(data_drift_detected AS INTEGER) + CAST(prediction_drift_detected AS INTEGER)
                    + CAST(model_degraded AS INTEGER)) * 0.1, 2), 4, 2, 0
FROM monitoring_summary"""),
        ("findings", """
SELECT metric, severity, confidence, evidence_count, priority,
       CAST(row_number() OVER (ORDER BY priority, grp, signal_order) AS INTEGER) AS finding_order
FROM (SELECT *, CASE WHEN severity = 'critical' THEN 'P1'
                     WHEN severity = 'notable' AND confidence >= 0.8 THEN 'P1'
                     WHEN severity IN ('notable', 'warning') AND confidence >= 0.6 THEN 'P2'
                     ELSE 'P3' END AS priority FROM fi_all) t"""),
        ("inv_totals", """
SELECT count(*) AS total, CAST(sum(CAST(is_dead_stock AS BIGINT)) AS BIGINT) AS dead,
       CAST(sum(CAST(reorder_signal AS BIGINT)) AS BIGINT) AS reorder,
       CAST(sum(CAST(is_dead_stock AS BIGINT)) AS BIGINT) / greatest(count(*), 1) * 100 AS dead_pct
FROM inventory_health"""),
        ("bestsellers", f"""
SELECT category, units, avg_return_rate_pct,
       avg(avg_return_rate_pct) OVER () AS portfolio_avg_pct,
       max(avg_return_rate_pct) OVER () - min(avg_return_rate_pct) OVER () AS spread_pp
FROM (SELECT category, CAST(sum(units_sold) AS BIGINT) AS units,
             {rnd("CAST(sum(CAST(round(return_rate * 10000) AS BIGINT)) AS BIGINT)",
                  "count(CAST(round(return_rate * 10000) AS BIGINT)) * 100", 2)} AS avg_return_rate_pct
      FROM product_performance WHERE units_sold > 0 GROUP BY category
      ORDER BY units DESC, category LIMIT 10) t"""),
        ("churn_cnt", """
SELECT count(*) AS total, coalesce(CAST(sum(CAST(churn_probability > 0.7 AS BIGINT)) AS BIGINT), 0) AS high_risk,
       coalesce(CAST(sum(CAST(churn_probability > 0.7 AS BIGINT)) AS BIGINT), 0) / greatest(count(*), 1)
           AS high_risk_pct
FROM preds"""),
        ("outliers", """
SELECT category, avg_return_rate_pct, portfolio_avg_pct, avg_return_rate_pct - portfolio_avg_pct AS deviation_pp
FROM bestsellers ORDER BY avg_return_rate_pct DESC, category LIMIT 3"""),
        ("slowest", f"SELECT max(avg_delivery_days) AS max_days FROM fulfillment_metrics WHERE order_month = {CUR_MONTH}"),
    ]


def gratio_(p, q, d):
    return gratio(p, q, d)
