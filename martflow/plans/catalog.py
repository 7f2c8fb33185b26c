"""Every registered query with its oracle twin (see ``registry``).

Grouped by layer: Silver (B*), Gold (D*), quality (C*), features (E*),
model data (F*), drift (G*), signals and findings (H*), explorer (I*),
sources (A*). Names describe the result, not an id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from martflow.operators import facts, gold
from martflow.oracle.insight_sql import AS_OF, PRIOR
from martflow.oracle.sqlfn import ddiff, gratio as gratio_sql
from martflow.plans.registry import register
from martflow.session import scratch_path

# ====================================================================== Silver
for _name in ("customers_clean", "orders_clean", "order_items_clean", "products_clean",
              "inventory_clean", "events_clean", "distribution_centers_clean"):
    register(f"silver_{_name}", f"SELECT * FROM {_name}")(
        lambda p, _n=_name: p.s(_n))


@register("silver_sentinel_and_country_fixes", """
SELECT country, count(*) AS customers, count(city) AS with_city
FROM customers_clean GROUP BY country""")
def _silver_fixes(p):
    """B8 + B9 effect: nulls from the 'null' sentinel and Brasil -> Brazil, per country."""
    return (p.s("customers_clean").groupBy("country")
            .agg(F.count(F.lit(1)).alias("customers"), F.count("city").alias("with_city")))


# ====================================================================== Gold
for _name in gold.GOLD_TABLES:
    register(_name, f"SELECT * FROM {_name}")(lambda p, _n=_name: p.g(_n))


def _kept(p, name):
    return facts.kept(p.s(name), p.cfg)


@register("order_aggregate", "SELECT * FROM c360_oa")
def _d2(p):
    return gold.ordering(_kept(p, "orders_clean"))


@register("purchase_facts", """
SELECT user_id, product_id, count(order_item_id) AS units, count(sale_price) AS priced,
       CAST(sum(CAST(round(sale_price * 100) AS BIGINT)) AS BIGINT) AS cents,
       CAST(sum(CASE WHEN is_returned THEN 1 ELSE 0 END) AS BIGINT) AS returned,
       min(created_at) AS first_at, max(created_at) AS last_at
FROM order_items_clean WHERE status <> 'Cancelled' GROUP BY user_id, product_id""")
def _d3_facts(p):
    return p.facts["purchases"]


@register("session_facts", """
SELECT user_id, date_trunc('month', created_at)::TIMESTAMP AS event_month, session_id, count(event_id) AS events,
       min(created_at) AS first_at, max(created_at) AS last_at,
       count(CASE WHEN event_type = 'home' THEN 1 END) AS home_events,
       count(CASE WHEN event_type = 'department' THEN 1 END) AS department_events,
       count(CASE WHEN event_type = 'product' THEN 1 END) AS product_view_events,
       count(CASE WHEN event_type = 'cart' THEN 1 END) AS cart_events,
       count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase_events,
       count(CASE WHEN event_type = 'cancel' THEN 1 END) AS cancel_events
FROM events_clean WHERE NOT is_anonymous GROUP BY user_id, date_trunc('month', created_at), session_id""")
def _d6_facts(p):
    return p.facts["session_months"]


@register("item_aggregate", """
SELECT user_id, spend_cents AS cents, avg_item_sale_price AS average_price, distinct_products_purchased AS products,
       distinct_orders_with_items AS baskets, returned_item_count AS returned, total_items_purchased AS units FROM c360_ia""")
def _d3(p):
    baskets = (facts.baskets(_kept(p, "order_items_clean")).groupBy("user_id").agg(F.count("order_id").alias("baskets")))
    return (facts.buying(p.facts["purchases"]).join(baskets, "user_id")
            .withColumn("average_price", gold.average_price(F.col("cents"), F.col("priced"))).drop("priced"))


@register("favorite_category", "SELECT * FROM c360_fav")
def _d4(p):
    return facts.favourite(p.facts["purchases"], p.s("products_clean"))


@register("first_to_second_order_gap", "SELECT * FROM c360_gap")
def _d5(p):
    return gold.first_to_second_gap(_kept(p, "orders_clean"))


@register("event_aggregate", """
SELECT user_id, total_sessions AS sessions, total_events AS events, last_session_at AS last_at,
       session_count_30d AS recent_sessions, purchase_events, cart_events, product_view_events FROM c360_ev""")
def _d6(p):
    seen = facts.browsing(facts.whole_sessions(p.facts["session_months"]),
                          gold.last_days(gold.max_ts(p.s("events_clean")), p.cfg))
    return seen.drop("home_events", "department_events", "cancel_events")


@register("reference_dates", """
SELECT (SELECT max(created_at) FROM orders_clean) AS max_order_at,
       (SELECT max(created_at) FROM events_clean) AS max_event_at,
       (SELECT max(created_at) FROM inventory_clean) AS max_inventory_at""")
def _d7(p):
    return gold.reference_dates(p.s("orders_clean"), p.s("events_clean"), p.s("inventory_clean"))


@register("sales_aggregate", """
SELECT product_id, units_sold AS units, revenue_cents AS cents, avg_selling_price AS average_price, unique_buyers AS buyers,
       first_sold_at, last_sold_at, units_returned AS returned FROM pp_sales""")
def _d10(p):
    return (gold.selling(p.facts["purchases"])
            .withColumn("average_price", gold.average_price(F.col("cents"), F.col("priced"))).drop("priced"))


@register("inventory_aggregate", """
SELECT product_id, total_units_received AS received, total_units_sold_inv AS sold, units_in_stock AS "left", avg_days_to_sell
FROM pp_inv""")
def _d11(p):
    return p.facts["stock"].select("product_id", "received", "sold", "left", gold.sell_time().alias("avg_days_to_sell"))


@register("category_revenue_rank", """
SELECT product_id, category, total_revenue, category_revenue_rank FROM product_performance""")
def _d12(p):
    return p.g("product_performance").select("product_id", "category", "total_revenue",
                                             "category_revenue_rank")


@register("dead_stock_and_reorder", """
SELECT product_id, units_in_stock, days_since_last_sale, is_dead_stock, days_of_supply, reorder_signal
FROM inventory_health""")
def _d14(p):
    return p.g("inventory_health").select("product_id", "units_in_stock", "days_since_last_sale",
                                          "is_dead_stock", "days_of_supply", "reorder_signal")


@register("median_delivery_days", """
SELECT distribution_center_id, order_month, median_delivery_days, on_time_deliveries,
       total_deliveries, on_time_rate FROM fulfillment_metrics""")
def _d17(p):
    return p.g("fulfillment_metrics").select("distribution_center_id", "order_month",
                                             "median_delivery_days", "on_time_deliveries",
                                             "total_deliveries", "on_time_rate")


@register("funnel_counts", "SELECT * FROM fa_counts")
def _d20(p):
    return gold.funnel_counts(p.facts["session_months"])


def _two_loads(p):
    """Monthly Gold after a first load and a second one that brings the newest months, late rows of an
    earlier month and corrections of rows sent before."""
    from martflow.plans.incremental import STORED, MonthlyGold
    store = MonthlyGold(p.spark, scratch_path(p.spark, f"monthly-{uuid.uuid4().hex}"), p.cfg)
    newest, earlier = F.col("created_at") >= ntz("2001-04-15"), F.col("created_at") >= ntz("2001-03-01")
    for load in (0, 1):
        for name, (silver_name, key) in STORED.items():
            rows = p.s(silver_name)
            again = earlier & ~newest & (F.col(key) % 5 == 0)
            if load:
                rows = rows.where(newest | again)
            else:
                rows = rows.where(~newest & ~(again & (F.col(key) % 10 == 0)))
                wrong = {"delivered_at": F.lit(None).cast("timestamp_ntz")} if name == "lines" else {"event_type": F.lit("home")}
                rows = rows.withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in wrong.items()})
            store.append(name, rows, load)
        store.refresh(p.s("products_clean"), p.s("distribution_centers_clean"))
    return store


@register("fulfillment_refreshed", "SELECT * FROM fulfillment_metrics")
def _d16_refreshed(p):
    return _two_loads(p).table("fulfillment_metrics")


@register("funnel_refreshed", "SELECT * FROM funnel_analytics")
def _d19_refreshed(p):
    return _two_loads(p).table("funnel_analytics")


# ====================================================================== Features
from martflow.oracle.features_sql import FEATURE_COLS  # noqa: E402
from martflow.operators import asof, features  # noqa: E402
from martflow.functions.exprs import add_days, ntz, side_by_side  # noqa: E402

SNAPSHOT_CUTOFFS = ["2001-02-01", "2001-03-01", "2001-05-03"]


# Registered outputs carry dates as midnight timestamps so both engines hand
# the comparison the same value type (the library tables keep DATE).
@register("feature_boundaries", """
SELECT max(created_at) AS max_date, CAST(CAST(max(created_at) AS DATE) - 90 AS TIMESTAMP) AS feature_cutoff
FROM orders_clean""")
def _e1(p):
    return p.features.boundaries().withColumn("feature_cutoff", F.col("feature_cutoff").cast("timestamp_ntz"))


@register("eligible_customers", "SELECT * FROM fs_elig")
def _e2(p):
    return p.features.eligible()


@register("transactional_features", "SELECT * FROM fs_txn")
def _e3(p):
    return p.features.transactional()


@register("behavioral_features", "SELECT * FROM fs_beh")
def _e4(p):
    return p.features.behavioral()


@register("product_features", "SELECT * FROM fs_prod")
def _e5(p):
    return p.features.product()


@register("demographic_features", "SELECT * FROM fs_demo")
def _e6(p):
    return p.features.demographic()


@register("churn_labels", "SELECT * FROM fs_labels")
def _e7(p):
    return p.features.labels()


@register("class_balance", f"""
SELECT count(*) AS eligible, CAST(sum(churned) AS BIGINT) AS churned,
       count(*) - CAST(sum(churned) AS BIGINT) AS not_churned,
       {gratio_sql("CAST(sum(churned) AS BIGINT)", "count(*)", 4)} AS churn_rate
FROM fs_labels""")
def _e8(p):
    return p.features.class_balance()


@register("churn_feature_dataset", "SELECT * REPLACE (CAST(feature_cutoff_date AS TIMESTAMP) AS feature_cutoff_date)"
          " FROM fs_dataset")
def _e9(p):
    return (p.dataset.drop("pipeline_run_timestamp")
            .withColumn("feature_cutoff_date", F.col("feature_cutoff_date").cast("timestamp_ntz")))


def _snapshots(p):
    """The snapshot store, written once and read by every retrieval."""
    return p._table(features.multi_cutoff_snapshots(p.silver, SNAPSHOT_CUTOFFS, p.cfg), "feature_snapshots")


def _entity_rows(p):
    return p.s("customers_clean").select(
        "user_id", add_days(ntz("2001-01-15"), F.col("user_id") % 150).alias("event_timestamp"))


@register("feature_view_rows", "SELECT user_id, " + ", ".join(FEATURE_COLS)
          + ", event_timestamp FROM feature_snapshots")
def _e10(p):
    return features.FeatureView().apply(_snapshots(p))


def _asof_sql(ttl_days: int) -> str:
    cols = ", ".join(f"CASE WHEN s.event_timestamp >= e.event_timestamp - INTERVAL {ttl_days} DAY "
                     f"THEN s.{c} END AS {c}" for c in FEATURE_COLS)
    return (f"SELECT e.user_id, e.event_timestamp, {cols} FROM entity_rows e "
            "ASOF LEFT JOIN feature_snapshots s ON e.user_id = s.user_id "
            "AND e.event_timestamp >= s.event_timestamp")


@register("asof_historical_features", _asof_sql(365))
def _e11(p):
    return asof.asof_join(_entity_rows(p), _snapshots(p), ttl_days=p.cfg.feature_ttl_days)


@register("asof_historical_features_ttl30", _asof_sql(30))
def _e11_ttl30(p):
    return asof.asof_join(_entity_rows(p), _snapshots(p), ttl_days=30)


@register("materialized_latest_features", "SELECT user_id, " + ", ".join(FEATURE_COLS)
          + """, event_timestamp FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS rn
FROM feature_snapshots WHERE event_timestamp BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-04-01') t
WHERE rn = 1""")
def _e12(p):
    return asof.materialize_latest(_snapshots(p), "2001-01-01", "2001-04-01")


ONLINE_FEATURES = ["order_count", "lifetime_spend", "days_since_last_order", "favorite_category"]


@register("online_feature_lookup", "SELECT c.user_id, " + ", ".join(f"m.{f}" for f in ONLINE_FEATURES)
          + """ FROM customers_clean c LEFT JOIN (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS rn
               FROM feature_snapshots) t WHERE rn = 1) m ON c.user_id = m.user_id""")
def _e13(p):
    store = asof.materialize_latest(_snapshots(p), "1900-01-01", "2100-01-01")
    return asof.online_lookup(store, p.s("customers_clean"), ONLINE_FEATURES)


# ====================================================================== Model data
from martflow.operators import drift, profiles, modeldata as md  # noqa: E402
from martflow.oracle.model_sql import MODEL_FEATURES as _MF  # noqa: E402


@register("surrogate_predictions", "SELECT * FROM preds")
def _preds(p):
    return p.predictions.drop("prediction_timestamp")


@register("training_set", "SELECT * FROM md_train")
def _f1(p):
    return md.training_set(p.dataset)


@register("null_policy", "SELECT * FROM md_filled")
def _f2(p):
    return md.null_policy(md.training_set(p.dataset))


@register("encoder_table", 'SELECT col_name AS "column", value, idx AS "index" FROM md_enc')
def _f3(p):
    return p.encoders


@register("encoded_features", "SELECT * FROM md_encoded")
def _f3b(p):
    return p.model_frame


@register("train_test_split", "SELECT user_id, churned, split FROM md_split")
def _f4(p):
    return md.train_test_split(md.training_set(p.dataset), p.cfg).select("user_id", "churned", "split")


@register("class_weights", """
SELECT churned, count(*) AS n_class,
       (SELECT count(*) FROM md_split WHERE split = 'train')
         / ((SELECT count(DISTINCT churned) FROM md_split WHERE split = 'train') * count(*)) AS weight
FROM md_split WHERE split = 'train' GROUP BY churned""")
def _f5(p):
    mf = p.model_frame
    return md.class_weights(mf.filter(F.col("split") == "train"), "churned")


@register("model_metrics", """
SELECT population, n, positives, auc, precision, recall, f1, log_loss FROM mq_metrics""")
def _f8(p):
    return p.monitoring["metrics"]


@register("fixed_sample", """
SELECT user_id, churned FROM fs_dataset
ORDER BY ((user_id % 1000003) * 6007 + 17) % 999983, user_id LIMIT 1000""")
def _f11(p):
    return md.fixed_sample(p.dataset.select("user_id", "churned"), p.cfg.sample_size)


# ====================================================================== Drift
@register("monitoring_frame", "SELECT population, user_id, churned, score, " + ", ".join(_MF) + " FROM md_scored")
def _g1(p):
    """G1 + G2: train rows, test rows and the scored batch with its known outcomes."""
    return p.monitoring_frame


@register("inference_snapshot", "SELECT user_id, " + ", ".join(_MF) + " FROM md_scored WHERE population = 'batch'")
def _f12_snapshot(p):
    """the features that the batch was scored from."""
    return p.snapshot.drop("prediction_timestamp")


@register("baseline_profile", """
SELECT feature, value, n_ref AS n FROM dr_counts WHERE n_ref > 0
UNION ALL SELECT feature, value, n_ref FROM pd_counts WHERE n_ref > 0""")
def _g_baseline(p):
    """The reference side as stored at training."""
    return p.baseline


@register("drift_table", "SELECT * FROM drift_table")
def _g7(p):
    return p.monitoring["drift_table"]


@register("wasserstein_drift", """
SELECT feature, round(stat_value, 6) AS stat_value FROM dr_wd""")
def _g3(p):
    return p.monitoring["drift_table"].filter(F.col("method") == "wasserstein_distance_norm") \
        .select("feature", "stat_value")


@register("jensen_shannon_drift", """
SELECT feature, round(stat_value, 6) AS stat_value FROM dr_js""")
def _g4(p):
    return p.monitoring["drift_table"].filter(F.col("method") == "jensenshannon") \
        .select("feature", "stat_value")


@register("psi_drift", """
SELECT feature, round(sum((cp - rp) * ln(cp / rp)), 6) AS stat_value FROM (
  SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 0.0001) AS rp,
         greatest(c / sum(c) OVER (PARTITION BY feature), 0.0001) AS cp
  FROM (SELECT feature, bin, CAST(sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS BIGINT) AS r,
               CAST(sum(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS BIGINT) AS c
        FROM (SELECT l.feature, l.side, len(list_filter(e.edges, lambda x: x < l.value)) AS bin
              FROM dr_long l JOIN (
                SELECT feature, list_distinct(quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))
                       AS edges
                FROM dr_long WHERE side = 'ref' AND value IS NOT NULL GROUP BY feature) e
                ON l.feature = e.feature
              WHERE l.value IS NOT NULL) b
        GROUP BY feature, bin) c) x
GROUP BY feature""")
def _g5(p):
    return profiles.stability_index(p.counts(scores=False)).select(
        "feature", F.round("stat_value", 6).alias("stat_value"))


@register("prediction_drift", "SELECT * FROM prediction_drift")
def _g8(p):
    return p.monitoring["prediction_drift"]


@register("model_quality", "SELECT * FROM model_quality")
def _g9(p):
    return p.monitoring["model_quality"]


@register("monitoring_summary", "SELECT * FROM monitoring_summary")
def _g10(p):
    return p.monitoring["summary"].drop("timestamp")


# ====================================================================== Signals and findings
from martflow.operators import explorer as ex, findings as fi, signals as sg  # noqa: E402
from martflow.oracle.insight_sql import AS_OF, PRIOR  # noqa: E402


@register("signal_periods", f"SELECT {AS_OF} AS current_period, {PRIOR} AS prior_period")
def _h1(p):
    return sg.periods_table(p.g("fulfillment_metrics"), p.cfg)


@register("kpi_signals", """
SELECT metric, domain, current_value, prior_value, delta_pct, direction, severity, signal_order
FROM kpi_signals""")
def _h11(p):
    return p.signals.drop("context")


@register("signal_periods_newest", """
SELECT max(order_month) AS current_period,
       (SELECT max(order_month) FROM fulfillment_metrics
        WHERE order_month < (SELECT max(order_month) FROM fulfillment_metrics)) AS prior_period
FROM fulfillment_metrics""")
def _h1_newest(p):
    """H1 by its default rule: the newest two months."""
    return sg.periods_table(p.g("fulfillment_metrics"), p.cfg.with_(signal_as_of=None))


_CONTEXTS = """
SELECT metric, CASE
  WHEN metric = 'Dead Stock Rate' THEN 'Dead stock rate: ' || format('{:.1f}', current_value * 100) || '% across '
       || format('{:,}', (SELECT count(*) FROM inventory_health)) || ' products'
  WHEN metric = 'Churn Risk (Inference Batch)' THEN 'Churn risk: ' || CAST(CAST(current_value AS BIGINT) AS VARCHAR)
       || ' of ' || CAST(CAST(prior_value AS BIGINT) AS VARCHAR) || ' customers high-risk (prob > 0.7), avg prob '
       || format('{:.3f}', (SELECT avg(churn_probability) FROM preds))
  ELSE metric || ': ' || format('{:,.2f}', current_value) || ' (was ' || format('{:,.2f}', prior_value) || '), '
       || CASE WHEN delta_pct >= 0 THEN '+' ELSE '' END || format('{:.1f}', delta_pct * 100) || '% ' || direction
  END AS context
FROM kpi_signals"""


@register("signal_contexts", _CONTEXTS)
def _h2_text(p):
    """H2 context strings."""
    return p.signals.select("metric", "context")


@register("drilldowns", "SELECT * FROM drills")
def _h12(p):
    return fi.drilldowns(p.gold, p.cfg).drop("evidence")


def _findings(p):
    return fi.findings(p.signals, fi.drilldowns(p.gold, p.cfg), p.monitoring["summary"],
                       p.g("fulfillment_metrics"), p.cfg)


@register("findings", "SELECT * FROM findings")
def _h15(p):
    return _findings(p).select("metric", "severity", "confidence", "evidence_count", "priority",
                               "finding_order")


@register("finding_texts")
def _h15_text(p):
    """Finding titles, descriptions, evidence and actions as a finding reports them; the two
    queries below hold the same texts without a list, with twins."""
    return _findings(p).select("finding_order", "title", "description", "evidence", "recommended_action")


_MONITORING = "ML Model Monitoring Status"


@register("finding_descriptions", f"""
SELECT f.finding_order,
       CASE WHEN f.metric = '{_MONITORING}' THEN f.metric
            ELSE f.metric || ' — ' || upper(s.direction) || ' ' || format('{{:.1f}}', abs(s.delta_pct) * 100) || '%' END AS title,
       CASE WHEN f.metric = '{_MONITORING}' THEN
                 'Data drift: ' || m.features_drifted || '/' || m.features_tested || ' features. Prediction drift: '
                 || CASE WHEN m.prediction_drift_detected THEN 'YES' ELSE 'No' END || '. Model degradation: '
                 || CASE WHEN m.model_degraded THEN 'YES' ELSE 'No' END || '. Recommendation: ' || m.recommendation || '.'
            WHEN f.severity = 'warning' THEN c.context
            ELSE f.metric || ' moved ' || CASE WHEN s.delta_pct >= 0 THEN '+' ELSE '' END
                 || format('{{:.1f}}', s.delta_pct * 100) || '% from ' || strftime({PRIOR}, '%Y-%m-%d %H:%M:%S')
                 || ' to ' || strftime({AS_OF}, '%Y-%m-%d %H:%M:%S') || '.' END AS description,
       CASE WHEN f.metric = '{_MONITORING}' THEN 'Investigate prediction drift source before retraining.'
            WHEN f.severity = 'warning' THEN 'Monitor ' || lower(f.metric) || ' trend over the next period.'
            ELSE 'Investigate ' || lower(f.metric) || ' drivers in the ' || s.domain || ' domain.' END AS recommended_action
FROM findings f LEFT JOIN kpi_signals s ON f.metric = s.metric
     LEFT JOIN ({_CONTEXTS}) c ON f.metric = c.metric CROSS JOIN monitoring_summary m""")
def _h15_descriptions(p):
    """H15 titles, descriptions and actions."""
    return _findings(p).select("finding_order", "title", "description", "recommended_action")


@register("finding_evidence", f"""
SELECT f.finding_order, 1 AS line_no, c.context AS line
FROM findings f JOIN ({_CONTEXTS}) c ON f.metric = c.metric
UNION ALL
SELECT f.finding_order, CAST(1 + d.rank AS INTEGER),
       CASE d.domain
         WHEN 'revenue' THEN '  DC ''' || d.label || ''': $' || format('{{:,.0f}}', d.value_1) || ' revenue, '
                             || format('{{:,.0f}}', d.value_2) || ' orders'
         WHEN 'customers' THEN '  Source ''' || d.label || ''': ' || format('{{:,.0f}}', d.value_1) || ' users, avg '
                               || format('{{:,.1f}}', d.value_2) || ' orders'
         WHEN 'conversion' THEN '  ' || d.label || ': conv=' || format('{{:,.4f}}', d.value_1) || ', users='
                                || format('{{:,.0f}}', d.value_2)
         ELSE '  DC ''' || d.label || ''': ' || format('{{:,.1f}}', d.value_1) || ' days avg, '
              || format('{{:,.1f}}', d.value_2 * 100) || '% on-time' END
FROM findings f JOIN kpi_signals s ON f.metric = s.metric JOIN drills d ON s.domain = d.domain
WHERE f.severity IN ('critical', 'notable')
UNION ALL
SELECT f.finding_order, x.line_no, x.line
FROM findings f, (
    SELECT 1 AS line_no, 'Feature drift: ' || features_drifted || '/' || features_tested || ' features drifted' AS line
    FROM monitoring_summary
    UNION ALL SELECT 2, 'Prediction drift: ' || prediction_drift_method || ' = ' || CAST(prediction_drift_score AS VARCHAR)
                        || ' (threshold: ' || CAST(prediction_drift_threshold AS VARCHAR) || ')' FROM monitoring_summary
    UNION ALL SELECT 3, 'AUC: ' || CAST(auc_ref AS VARCHAR) || ' → ' || CAST(auc_cur AS VARCHAR) || ' (drop: '
                        || CAST(auc_drop_pct AS VARCHAR) || '%)' FROM monitoring_summary
    UNION ALL SELECT 4, 'Recommendation: ' || recommendation FROM monitoring_summary) x
WHERE f.metric = '{_MONITORING}'""")
def _h15_evidence(p):
    """H15 evidence, a row per line."""
    lines = _findings(p).select("finding_order", F.posexplode("evidence").alias("pos", "line"))
    return lines.select("finding_order", (F.col("pos") + 1).alias("line_no"), "line")


@register("scoreboard_status", """
SELECT metric AS item,
       CASE WHEN severity = 'critical' THEN 'Declining'
            WHEN severity = 'notable' THEN CASE WHEN direction = 'up' THEN 'Strong Growth' ELSE 'Notable Change' END
            WHEN severity = 'warning' THEN 'Watch' ELSE 'Stable' END AS status
FROM kpi_signals
UNION ALL
SELECT 'Business', CASE WHEN count(CASE WHEN severity = 'critical' AND priority = 'P1' THEN 1 END) > 0
                        THEN 'At Risk' ELSE 'Healthy' END
FROM findings
UNION ALL
SELECT 'Operations',
       CASE WHEN max(CASE WHEN metric = 'Avg Delivery Days' AND severity IN ('critical', 'warning') THEN 1 END) = 1
            THEN 'Degrading'
            WHEN max(CASE WHEN metric = 'On-Time Delivery Rate' THEN current_value END) >= 0.95 THEN 'Stable'
            ELSE 'Watch' END
FROM kpi_signals
UNION ALL
SELECT 'Model', CASE WHEN prediction_drift_detected AND model_degraded THEN 'Degraded'
                     WHEN prediction_drift_detected OR model_degraded THEN 'Attention Required'
                     ELSE 'Healthy' END
FROM monitoring_summary""")
def _h16(p):
    return sg.scoreboard_status(p.signals, p.monitoring["summary"], _findings(p))


@register("evidence_strength", """
SELECT finding_order, confidence,
       CASE WHEN confidence >= 0.8 THEN 'Strong' WHEN confidence >= 0.6 THEN 'Moderate' ELSE 'Limited' END
           AS evidence_strength
FROM findings""")
def _h17(p):
    f = _findings(p)
    return f.select("finding_order", "confidence",
                    sg.evidence_strength(F.col("confidence")).alias("evidence_strength"))


# ====================================================================== Explorer
_CM = "(SELECT max(order_month) FROM fulfillment_metrics)"


@register("monthly_revenue", """
SELECT order_month, CAST(sum(CAST(round(total_revenue * 100) AS BIGINT)) AS BIGINT) / 100.0 AS revenue
FROM fulfillment_metrics GROUP BY order_month ORDER BY order_month DESC LIMIT 12""")
def _i1(p):
    return ex.monthly_revenue(p.g("fulfillment_metrics"))


@register("revenue_by_dc", f"""
SELECT distribution_center_name, CAST(sum(CAST(round(total_revenue * 100) AS BIGINT)) AS BIGINT) / 100.0 AS revenue
FROM fulfillment_metrics WHERE order_month = {_CM} GROUP BY distribution_center_name""")
def _i2(p):
    return ex.revenue_by_dc(p.g("fulfillment_metrics"))


@register("top_dcs", f"""
SELECT distribution_center_name, CAST(sum(CAST(round(total_revenue * 100) AS BIGINT)) AS BIGINT) / 100.0 AS revenue
FROM fulfillment_metrics WHERE order_month = {_CM} GROUP BY distribution_center_name
ORDER BY revenue DESC, distribution_center_name LIMIT 3""")
def _i3(p):
    return ex.top_dcs(p.g("fulfillment_metrics"))


@register("churn_counts", "SELECT * FROM churn_cnt")
def _i4(p):
    return ex.churn_counts(p.predictions, p.cfg)


@register("churn_histogram", """
SELECT CAST(least(floor(churn_probability * 30), 29) AS INTEGER) AS bin, count(*) AS customers,
       CAST(least(floor(churn_probability * 30), 29) AS INTEGER) / 30.0 AS bin_start
FROM preds GROUP BY 1""")
def _i5(p):
    return ex.churn_histogram(p.predictions)


@register("high_risk_by_source", """
SELECT c.traffic_source, count(*) AS high_risk_customers
FROM preds p JOIN customer_360 c ON p.user_id = c.user_id
WHERE p.churn_probability > 0.7 GROUP BY c.traffic_source""")
def _i6(p):
    return ex.high_risk_by_source(p.predictions, p.g("customer_360"), p.cfg)


@register("source_segments", f"""
SELECT traffic_source, count(*) AS customers,
       {gratio_sql("CAST(sum(order_count) AS BIGINT)", "count(order_count)", 2)} AS avg_orders,
       {gratio_sql("CAST(sum(CAST(round(lifetime_spend * 100) AS BIGINT)) AS BIGINT)", "count(lifetime_spend) * 100", 2)} AS avg_spend,
       {gratio_sql("CAST(sum(CAST(round(return_rate * 10000) AS BIGINT)) AS BIGINT)", "count(return_rate) * 100", 2)} AS avg_return_rate_pct
FROM customer_360 WHERE order_count > 0 GROUP BY traffic_source""")
def _i7(p):
    return ex.source_segments(p.g("customer_360"))


@register("top_churn_source", """
SELECT c.traffic_source, count(*) AS high_risk_customers
FROM preds p JOIN customer_360 c ON p.user_id = c.user_id
WHERE p.churn_probability > 0.7 GROUP BY c.traffic_source
ORDER BY high_risk_customers DESC, c.traffic_source LIMIT 1""")
def _i8(p):
    return ex.top_churn_source(p.predictions, p.g("customer_360"), p.cfg)


_CATREV = ("SELECT category, CAST(sum(CAST(round(total_revenue * 100) AS BIGINT)) AS BIGINT) / 100.0 AS revenue "
           "FROM product_performance GROUP BY category ORDER BY revenue DESC NULLS LAST, category")


@register("leading_category", _CATREV + " LIMIT 1")
def _i9(p):
    return ex.leading_category(p.g("product_performance"))


@register("top_categories", _CATREV + " LIMIT 10")
def _i10(p):
    return ex.top_categories(p.g("product_performance"))


@register("bestseller_return_rates", "SELECT * FROM bestsellers")
def _i11(p):
    return ex.bestseller_return_rates(p.g("product_performance"))


@register("top_products", """
SELECT product_id, name, category, brand, units_sold, round(total_revenue, 2) AS total_revenue,
       round(CAST(round(margin_pct * 10000) AS BIGINT) / 100, 1) AS margin_pct
FROM product_performance ORDER BY total_revenue DESC NULLS LAST, product_id LIMIT 15""")
def _i12(p):
    return ex.top_products(p.g("product_performance"))


@register("return_outliers", "SELECT * FROM outliers")
def _i13(p):
    return ex.return_outliers(p.g("product_performance"))


@register("delivery_by_dc", f"""
SELECT distribution_center_name, avg_delivery_days FROM fulfillment_metrics WHERE order_month = {_CM}""")
def _i14(p):
    return ex.delivery_by_dc(p.g("fulfillment_metrics"))


@register("on_time_by_dc", f"""
SELECT distribution_center_name, {gratio_sql("CAST(round(on_time_rate * 10000) AS BIGINT)", "100", 1)} AS on_time_rate_pct,
       on_time_deliveries, total_deliveries
FROM fulfillment_metrics WHERE order_month = {_CM}""")
def _i15(p):
    return ex.on_time_by_dc(p.g("fulfillment_metrics"))


@register("slowest_dc_days", "SELECT * FROM slowest")
def _i16(p):
    return ex.slowest_dc_days(p.g("fulfillment_metrics"))


@register("inventory_totals", "SELECT * FROM inv_totals")
def _i17(p):
    return ex.inventory_totals(p.g("inventory_health"))


@register("dead_stock_by_category", f"""
SELECT category, count(*) AS total_products, CAST(sum(CAST(is_dead_stock AS BIGINT)) AS BIGINT) AS dead_stock,
       {gratio_sql("CAST(sum(CAST(is_dead_stock AS BIGINT)) AS BIGINT) * 100", "count(*)", 1)} AS dead_pct
FROM inventory_health GROUP BY category ORDER BY dead_pct DESC, category LIMIT 10""")
def _i18(p):
    return ex.dead_stock_by_category(p.g("inventory_health"))


@register("reorder_by_category", """
SELECT category, CAST(sum(CAST(reorder_signal AS BIGINT)) AS BIGINT) AS reorder_count, count(*) AS total
FROM inventory_health GROUP BY category HAVING sum(CAST(reorder_signal AS BIGINT)) > 0
ORDER BY reorder_count DESC, category LIMIT 10""")
def _i19(p):
    return ex.reorder_by_category(p.g("inventory_health"))


@register("inventory_by_dc", f"""
SELECT distribution_center_name, count(*) AS products,
       CAST(sum(CAST(round(stock_value * 100) AS BIGINT)) AS BIGINT) / 100.0 AS stock_value,
       {gratio_sql("CAST(sum(CAST(round(turnover_rate * 10000) AS BIGINT)) AS BIGINT)", "count(turnover_rate) * 10000", 3)} AS avg_turnover,
       CAST(sum(CAST(is_dead_stock AS BIGINT)) AS BIGINT) AS dead_stock,
       CAST(sum(CAST(reorder_signal AS BIGINT)) AS BIGINT) AS reorder_signals
FROM inventory_health GROUP BY distribution_center_name""")
def _i20(p):
    return ex.inventory_by_dc(p.g("inventory_health"))


@register("top_reorder_categories", """
SELECT category, CAST(sum(CAST(reorder_signal AS BIGINT)) AS BIGINT) AS cnt FROM inventory_health
GROUP BY category ORDER BY cnt DESC, category LIMIT 2""")
def _i21(p):
    return ex.top_reorder_categories(p.g("inventory_health"))


@register("action_levels", """
SELECT 'revenue' AS domain, CASE WHEN severity = 'notable' AND direction = 'up' THEN 'green'
                                 WHEN severity = 'critical' THEN 'orange' ELSE 'yellow' END AS level
FROM kpi_signals WHERE metric = 'Total Revenue'
UNION ALL SELECT 'revenue', 'yellow' FROM (SELECT count(*) AS n FROM kpi_signals WHERE metric = 'Total Revenue') t
          WHERE n = 0
UNION ALL SELECT 'churn', CASE WHEN high_risk_pct >= 0.5 THEN 'orange' WHEN high_risk_pct >= 0.3 THEN 'yellow'
                               ELSE 'green' END FROM churn_cnt
UNION ALL SELECT 'products', CASE WHEN coalesce(max(deviation_pp), 0.0) >= 0.2 THEN 'yellow' ELSE 'green' END
          FROM outliers
UNION ALL SELECT 'fulfillment', CASE WHEN coalesce(max_days, 0.0) >= 5 THEN 'orange'
                                     WHEN coalesce(max_days, 0.0) >= 4 THEN 'yellow' ELSE 'green' END FROM slowest
UNION ALL SELECT 'inventory', CASE WHEN reorder >= 50 OR dead_pct >= 15 THEN 'orange'
                                   WHEN reorder > 0 OR dead_pct >= 8 THEN 'yellow' ELSE 'green' END FROM inv_totals""")
def _i22(p):
    fm, ih, pp = p.g("fulfillment_metrics"), p.g("inventory_health"), p.g("product_performance")
    return ex.action_levels(p.signals, ex.churn_counts(p.predictions, p.cfg), ex.return_outliers(pp),
                            ex.slowest_dc_days(fm), ex.inventory_totals(ih), p.cfg)


@register("churn_statistics", """
SELECT count(*) AS total_customers, avg(churn_probability) AS avg_probability,
       quantile_cont(churn_probability, 0.5) AS median_probability,
       quantile_cont(churn_probability, 0.9) AS p90_probability,
       count(CASE WHEN churn_probability > 0.7 THEN 1 END) AS high_risk_count,
       count(CASE WHEN churn_probability > 0.9 THEN 1 END) AS very_high_risk_count
FROM preds""")
def _i23(p):
    return ex.churn_statistics(p.predictions)


# ====================================================================== Quality
from martflow.operators import quality as q  # noqa: E402
from martflow.sources.io import table_counts  # noqa: E402

# Raw (bronze-shaped) table columns; True marks string columns. A test checks
# these against the adapter's Spark schemas.
RAW_COLUMNS = {
    "users": [("id", 0), ("first_name", 1), ("last_name", 1), ("email", 1), ("age", 0), ("gender", 1),
              ("state", 1), ("street_address", 1), ("postal_code", 1), ("city", 1), ("country", 1),
              ("latitude", 0), ("longitude", 0), ("traffic_source", 1), ("created_at", 0), ("user_geom", 1)],
    "orders": [("order_id", 0), ("user_id", 0), ("status", 1), ("gender", 1), ("created_at", 0),
               ("returned_at", 0), ("shipped_at", 0), ("delivered_at", 0), ("num_of_item", 0)],
    "order_items": [("id", 0), ("order_id", 0), ("user_id", 0), ("product_id", 0), ("inventory_item_id", 0),
                    ("status", 1), ("created_at", 0), ("shipped_at", 0), ("delivered_at", 0),
                    ("returned_at", 0), ("sale_price", 0)],
    "products": [("id", 0), ("cost", 0), ("category", 1), ("name", 1), ("brand", 1), ("retail_price", 0),
                 ("department", 1), ("sku", 1), ("distribution_center_id", 0)],
    "inventory_items": [("id", 0), ("product_id", 0), ("created_at", 0), ("sold_at", 0), ("cost", 0),
                        ("product_category", 1), ("product_name", 1), ("product_brand", 1),
                        ("product_retail_price", 0), ("product_department", 1), ("product_sku", 1),
                        ("product_distribution_center_id", 0)],
    "distribution_centers": [("id", 0), ("name", 1), ("latitude", 0), ("longitude", 0)],
    "events": [("id", 0), ("user_id", 0), ("sequence_number", 0), ("session_id", 1), ("created_at", 0),
               ("ip_address", 1), ("city", 1), ("state", 1), ("postal_code", 1), ("browser", 1),
               ("traffic_source", 1), ("uri", 1), ("event_type", 1)],
}
PK = {"users": "id", "orders": "order_id", "order_items": "id", "products": "id", "inventory_items": "id",
      "distribution_centers": "id", "events": "id"}
CARDINALITY = {"users": ["country", "gender", "traffic_source"], "orders": ["status", "gender"],
               "order_items": ["status"], "products": ["category", "department"],
               "events": ["event_type", "browser", "traffic_source"]}
SENTINEL_COLUMNS = ["first_name", "last_name", "email", "gender", "state", "street_address", "postal_code",
                    "city", "country", "traffic_source", "user_geom"]


def _rules_sql(table: str, cte_name: str, rules: list) -> str:
    parts = []
    for r in rules:
        v = f"count(CASE WHEN {r.violation} THEN 1 END)"
        passed = (f"{v} < count(*) * {r.max_share}" if r.max_share is not None else f"{v} <= {r.tolerance}")
        parts.append(f"SELECT '{table}' AS \"table\", '{r.name}' AS \"check\", {v} AS violations, "
                     f"count(*) AS total, {passed} AS passed FROM {cte_name}")
    return " UNION ALL ".join(parts)


def _null_profile_sql() -> str:
    parts = []
    for t, cols in RAW_COLUMNS.items():
        for c, is_str in cols:
            sent = f"count(CASE WHEN {c} = 'null' THEN 1 END)" if is_str else "CAST(0 AS BIGINT)"
            parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
                         f"{sent} AS null_string_count, count(*) AS total FROM b_{t}")
    return " UNION ALL ".join(parts)


@register("null_profile", _null_profile_sql())
def _c1(p):
    return q.null_profile(p.raw)


@register("sentinel_counts", " UNION ALL ".join(
    f"SELECT 'users' AS \"table\", '{c}' AS \"column\", count(*) - count({c}) AS actual_nulls, "
    f"count(CASE WHEN {c} = 'null' THEN 1 END) AS sentinel_nulls FROM b_users" for c in SENTINEL_COLUMNS))
def _c2(p):
    return q.sentinel_counts(p.raw["users"], "users", SENTINEL_COLUMNS)


def _fk_sql(fks, prefix: str, ignore_null: bool) -> str:
    parts = []
    for c, ck, par, pk in fks:
        child, parent = f"{prefix}{c}", f"{prefix}{par}"
        cond = f"WHERE {ck} IS NOT NULL AND" if ignore_null else "WHERE"
        orph = (f"(SELECT count(*) FROM {child} x {cond} NOT EXISTS "
                f"(SELECT 1 FROM {parent} y WHERE y.{pk} = x.{ck}))")
        parts.append(f"SELECT '{c}.{ck} -> {par}.{pk}' AS relation, (SELECT count(*) FROM {child}) AS child_rows, "
                     f"{orph} AS orphans, "
                     f"round({orph} * 100 / greatest((SELECT count(*) FROM {child}), 1), 2) AS orphan_pct, "
                     f"{orph} = 0 AS passed")
    return " UNION ALL ".join(parts)


@register("bronze_fk_orphans", _fk_sql(q.BRONZE_FKS, "b_", False))
def _c3(p):
    return q.fk_report(p.raw, q.BRONZE_FKS, ignore_null_keys=False)


@register("silver_fk_validation", _fk_sql(q.SILVER_FKS, "", True))
def _c4(p):
    return q.fk_report(p.silver, q.SILVER_FKS, ignore_null_keys=True)


@register("event_user_orphans", _fk_sql([("events", "user_id", "users", "id")], "b_", True)
          .replace("'events.user_id -> users.id'", "'events.user_id (non-null) -> users'"))
def _c5(p):
    return q.event_user_orphans(p.raw["events"], p.raw["users"])


def _card_sql() -> str:
    parts = []
    for t, cols in CARDINALITY.items():
        for c in cols:
            parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM b_{t}")
    stacked = " UNION ALL ".join(parts)
    return f"""
SELECT "column", value, count, cardinality, rank, "table" FROM (
  SELECT "table", "column", value, count,
         count(value) OVER (PARTITION BY "table", "column") AS cardinality,
         CAST(row_number() OVER (PARTITION BY "table", "column" ORDER BY count DESC, value ASC NULLS FIRST)
              AS INTEGER) AS rank
  FROM (SELECT "table", "column", value, count(*) AS count FROM ({stacked}) s GROUP BY 1, 2, 3) g) r
WHERE rank <= 10"""


@register("cardinality_top_values", _card_sql())
def _c6(p):
    from functools import reduce as _r
    parts = [q.cardinality_top(p.raw[t], t, cols) for t, cols in CARDINALITY.items()]
    return _r(lambda a, b: a.unionByName(b), parts)


@register("lifecycle_violations", """
SELECT 'shipped_before_created' AS "check", CAST(count(CASE WHEN shipped_at < created_at THEN 1 END) AS DOUBLE) AS value FROM order_items_clean
UNION ALL SELECT 'delivered_before_shipped', CAST(count(CASE WHEN delivered_at < shipped_at THEN 1 END) AS DOUBLE) FROM order_items_clean
UNION ALL SELECT 'returned_before_delivered', CAST(count(CASE WHEN returned_at < delivered_at THEN 1 END) AS DOUBLE) FROM order_items_clean
UNION ALL SELECT 'sold_before_created', CAST(count(CASE WHEN sold_at < created_at THEN 1 END) AS DOUBLE) FROM inventory_clean
UNION ALL SELECT 'unsold_units', CAST(count(CASE WHEN sold_at IS NULL THEN 1 END) AS DOUBLE) FROM inventory_clean""")
def _c7(p):
    return q.lifecycle_checks(p.s("order_items_clean"), p.s("inventory_clean"))


@register("item_date_range", "SELECT min(created_at) AS min_created, max(created_at) AS max_created FROM order_items_clean")
def _c7b(p):
    return q.item_date_range(p.s("order_items_clean"))


@register("order_status_distribution", """
SELECT status, count(*) AS count, 'orders' AS "table" FROM orders_clean GROUP BY status""")
def _c7c(p):
    return q.status_distribution(p.s("orders_clean"), "orders")


@register("numeric_distribution", """
SELECT "column", min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg,
       quantile_disc(value, 0.01) AS p1, quantile_disc(value, 0.99) AS p99,
       count(CASE WHEN value <= 0 THEN 1 END) AS non_positive, 'order_items' AS "table"
FROM (SELECT 'sale_price' AS "column", sale_price AS value FROM b_order_items) t GROUP BY "column"
UNION ALL
SELECT "column", min(value), max(value), round(avg(value), 4), quantile_disc(value, 0.01), quantile_disc(value, 0.99),
       count(CASE WHEN value <= 0 THEN 1 END), 'products'
FROM (SELECT 'retail_price' AS "column", retail_price AS value FROM b_products
      UNION ALL SELECT 'cost', cost FROM b_products) t GROUP BY "column"
UNION ALL
SELECT "column", min(value), max(value), round(avg(value), 4), quantile_disc(value, 0.01), quantile_disc(value, 0.99),
       count(CASE WHEN value <= 0 THEN 1 END), 'users'
FROM (SELECT 'age' AS "column", CAST(age AS DOUBLE) AS value FROM b_users) t GROUP BY "column"
""")
def _c8(p):
    r = p.raw
    return (q.numeric_distribution(r["order_items"], "order_items", ["sale_price"])
            .unionByName(q.numeric_distribution(r["products"], "products", ["retail_price", "cost"]))
            .unionByName(q.numeric_distribution(r["users"], "users", ["age"])))


@register("negative_margin_products", "SELECT count(CASE WHEN retail_price < cost THEN 1 END) AS negative_margin FROM b_products")
def _c8b(p):
    return q.negative_margin_count(p.raw["products"])


@register("primary_key_check", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS total, count(*) - count({k}) AS null_keys, "
    f"count(*) - (count(DISTINCT {k}) + max(CAST({k} IS NULL AS INTEGER))) AS duplicate_keys, "
    f"(count(*) - count({k}) = 0 AND count(*) = count(DISTINCT {k}) + max(CAST({k} IS NULL AS INTEGER))) AS passed "
    f"FROM b_{t}" for t, k in PK.items()))
def _c9(p):
    from functools import reduce as _r
    return _r(lambda a, b: a.unionByName(b), [q.pk_check(p.raw[t], t, k) for t, k in PK.items()])


@register("silver_constraints", " UNION ALL ".join(_rules_sql(t, t, rules) for t, rules in q.CONSTRAINTS.items()))
def _c10(p):
    return q.constraint_report(p.silver)


@register("constraint_enforcement", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(CASE WHEN NOT ({' OR '.join('(' + r.violation + ')' for r in rules)}) "
    f"THEN 1 END) AS accepted, count(CASE WHEN {' OR '.join('(' + r.violation + ')' for r in rules)} THEN 1 END) "
    f"AS quarantined FROM {t}" for t, rules in q.CONSTRAINTS.items()))
def _c10b(p):
    from functools import reduce as _r
    parts = []
    for t, rules in q.CONSTRAINTS.items():
        acc, qua = q.enforce(p.s(t), rules)
        a, b = acc.agg(F.count(F.lit(1)).alias("accepted")), qua.agg(F.count(F.lit(1)).alias("quarantined"))
        parts.append(side_by_side(a, b).select(F.lit(t).alias("table"), "accepted", "quarantined"))
    return _r(lambda x, y: x.unionByName(y), parts)


_SILVER_SRC = {"customers_clean": "users", "orders_clean": "orders", "order_items_clean": "order_items",
               "products_clean": "products", "inventory_clean": "inventory_items",
               "events_clean": "events", "distribution_centers_clean": "distribution_centers"}


@register("row_count_reconciliation", " UNION ALL ".join(
    f"SELECT '{s}' AS \"table\", (SELECT count(*) FROM b_{r}) AS expected_rows, (SELECT count(*) FROM {s}) AS actual_rows, "
    f"(SELECT count(*) FROM b_{r}) = (SELECT count(*) FROM {s}) AS match" for s, r in _SILVER_SRC.items())
    + " UNION ALL SELECT 'customer_360', (SELECT count(*) FROM customers_clean), (SELECT count(*) FROM customer_360), "
      "(SELECT count(*) FROM customers_clean) = (SELECT count(*) FROM customer_360)"
    + " UNION ALL SELECT 'product_performance', (SELECT count(*) FROM products_clean), "
      "(SELECT count(*) FROM product_performance), "
      "(SELECT count(*) FROM products_clean) = (SELECT count(*) FROM product_performance)")
def _c11(p):
    expected = table_counts({**{s: p.raw[r] for s, r in _SILVER_SRC.items()},
                             "customer_360": p.s("customers_clean"),
                             "product_performance": p.s("products_clean")})
    actual = table_counts({**{s: p.s(s) for s in _SILVER_SRC},
                           "customer_360": p.g("customer_360"),
                           "product_performance": p.g("product_performance")})
    return q.reconciliation(expected, actual)


@register("silver_spot_checks", """
SELECT "check", value, value = 0 AS passed FROM (
SELECT 'string ''null'' city values' AS "check", CAST(count(CASE WHEN city = 'null' THEN 1 END) AS DOUBLE) AS value FROM customers_clean
UNION ALL SELECT '''Brasil'' country values', CAST(count(CASE WHEN country = 'Brasil' THEN 1 END) AS DOUBLE) FROM customers_clean
UNION ALL SELECT 'shipped orders without days_to_ship', CAST(count(CASE WHEN shipped_at IS NOT NULL AND days_to_ship IS NULL THEN 1 END) AS DOUBLE) FROM orders_clean
UNION ALL SELECT 'is_returned differs from status', CAST(count(CASE WHEN (status = 'Returned') <> is_returned THEN 1 END) AS DOUBLE) FROM order_items_clean
UNION ALL SELECT 'denormalised product_* columns in inventory', 0.0
UNION ALL SELECT 'ip_address column in events', 0.0
UNION ALL SELECT 'brands replaced by ''Unknown''', CAST(count(CASE WHEN brand = 'Unknown' THEN 1 END) AS DOUBLE) FROM products_clean) t""")
def _c12(p):
    return q.silver_spot_checks(p.silver)


@register("gold_spot_checks", """
SELECT 'customers_with_orders' AS "check", CAST(count(CASE WHEN order_count > 0 THEN 1 END) AS DOUBLE) AS value FROM customer_360
UNION ALL SELECT 'customers_without_orders', CAST(count(CASE WHEN order_count = 0 THEN 1 END) AS DOUBLE) FROM customer_360
UNION ALL SELECT 'avg_lifetime_spend', round(avg(CASE WHEN lifetime_spend > 0 THEN lifetime_spend END), 2) FROM customer_360
UNION ALL SELECT 'max_lifetime_spend', max(lifetime_spend) FROM customer_360
UNION ALL SELECT 'with_favorite_category', CAST(count(favorite_category) AS DOUBLE) FROM customer_360
UNION ALL SELECT 'never_sold_products', CAST(count(CASE WHEN units_sold = 0 THEN 1 END) AS DOUBLE) FROM product_performance
UNION ALL SELECT 'dead_stock_products', CAST(count(CASE WHEN is_dead_stock THEN 1 END) AS DOUBLE) FROM inventory_health
UNION ALL SELECT 'reorder_signals', CAST(count(CASE WHEN reorder_signal THEN 1 END) AS DOUBLE) FROM inventory_health
UNION ALL SELECT 'distribution_centers', CAST(count(DISTINCT distribution_center_id) AS DOUBLE) FROM fulfillment_metrics
UNION ALL SELECT 'months', CAST(count(DISTINCT order_month) AS DOUBLE) FROM fulfillment_metrics
UNION ALL SELECT 'avg_on_time_rate', """ + gratio_sql("CAST(sum(CAST(round(on_time_rate * 10000) AS BIGINT)) AS BIGINT)",
                                                    "count(on_time_rate) * 10000", 4) + """ FROM fulfillment_metrics
UNION ALL SELECT 'funnel_users', CAST(count(DISTINCT user_id) AS DOUBLE) FROM funnel_analytics
UNION ALL SELECT 'rows_with_mom_change', CAST(count(sessions_mom_change) AS DOUBLE) FROM funnel_analytics""")
def _c13(p):
    return q.gold_spot_checks(p.gold)


@register("gold_business_rules", " UNION ALL ".join(_rules_sql(t, t, rules) for t, rules in q.GOLD_RULES.items()))
def _c14(p):
    return q.gold_rule_report(p.gold)


@register("feature_validation", "SELECT 'transactional' AS \"table\", 'row count = eligible' AS \"check\", "
          "abs((SELECT count(*) FROM fs_txn) - (SELECT count(*) FROM fs_elig)) AS violations, "
          "(SELECT count(*) FROM fs_elig) AS total, "
          "(SELECT count(*) FROM fs_txn) = (SELECT count(*) FROM fs_elig) AS passed UNION ALL "
          + " UNION ALL ".join(_rules_sql(t, {"transactional": "fs_txn", "behavioral": "fs_beh",
                                              "product": "fs_prod"}[t], rules)
                               for t, rules in q.FEATURE_RULES.items()))
def _c15(p):
    return q.feature_validation(p.features)


@register("temporal_integrity", """
SELECT 'orders' AS source, max(created_at) AS max_ts, coalesce(max(created_at) < (SELECT cutoff FROM fs_cut), true) AS passed FROM fs_po
UNION ALL SELECT 'order_items', max(created_at), coalesce(max(created_at) < (SELECT cutoff FROM fs_cut), true) FROM fs_pi
UNION ALL SELECT 'events', max(created_at), coalesce(max(created_at) < (SELECT cutoff FROM fs_cut), true) FROM fs_pe""")
def _c15b(p):
    return q.temporal_integrity(p.features.stamped)


@register("dataset_validation", """
SELECT 'churn_feature_dataset' AS "table", 'no null target' AS "check", count(CASE WHEN churned IS NULL THEN 1 END) AS violations, count(*) AS total, count(CASE WHEN churned IS NULL THEN 1 END) = 0 AS passed FROM fs_dataset
UNION ALL SELECT 'churn_feature_dataset', 'no null user_id', count(CASE WHEN user_id IS NULL THEN 1 END), count(*), count(CASE WHEN user_id IS NULL THEN 1 END) = 0 FROM fs_dataset
UNION ALL SELECT 'churn_feature_dataset', 'row count = eligible', abs(count(*) - (SELECT count(*) FROM fs_elig)), count(*), count(*) = (SELECT count(*) FROM fs_elig) FROM fs_dataset
UNION ALL SELECT 'churn_feature_dataset', 'unique user_id', count(*) - count(DISTINCT user_id), count(*), count(*) = count(DISTINCT user_id) FROM fs_dataset
UNION ALL SELECT 'churn_feature_dataset', 'churn rate in (5%, 95%)', CAST(CASE WHEN sum(churned) / count(*) > 0.05 AND sum(churned) / count(*) < 0.95 THEN 0 ELSE 1 END AS BIGINT), count(*), sum(churned) / count(*) > 0.05 AND sum(churned) / count(*) < 0.95 FROM fs_dataset
UNION ALL SELECT 'churn_feature_dataset', 'metadata columns present', CAST(0 AS BIGINT), count(*), true FROM fs_dataset""")
def _c16(p):
    return q.dataset_validation(p.dataset, p.features.eligible())


_SUMMARY = ["order_count", "lifetime_spend", "avg_order_value", "days_since_last_order", "total_sessions",
            "session_count_30d", "price_sensitivity_score", "account_age_days"]


@register("distribution_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 2) AS mean, "
    f"round(quantile_disc(CAST({c} AS DOUBLE), 0.5), 2) AS median, "
    f"round(quantile_disc(CAST({c} AS DOUBLE), 0.95), 2) AS p95, round(min(CAST({c} AS DOUBLE)), 2) AS min, "
    f"round(max(CAST({c} AS DOUBLE)), 2) AS max FROM fs_dataset" for c in _SUMMARY))
def _c17(p):
    return q.distribution_summary(p.dataset, _SUMMARY)


@register("missing_customer_diagnosis", """
SELECT o.user_id, o.pre_cutoff_orders, o.first_order_at, o.last_order_at,
       coalesce(i.pre_cutoff_items, 0) AS pre_cutoff_items, coalesce(i.all_items, 0) AS all_items,
       i.first_item_at, i.last_item_at,
       CASE WHEN coalesce(i.all_items, 0) > 0 AND i.first_item_at >= (SELECT cutoff FROM fs_cut)
            THEN 'processing lag: items created after the cutoff' ELSE 'no items' END AS verdict
FROM (SELECT user_id, count(*) AS pre_cutoff_orders, min(created_at) AS first_order_at,
             max(created_at) AS last_order_at FROM fs_po GROUP BY user_id) o
LEFT JOIN (SELECT user_id, count(CASE WHEN created_at < (SELECT cutoff FROM fs_cut) THEN 1 END) AS pre_cutoff_items,
                  count(*) AS all_items, min(created_at) AS first_item_at, max(created_at) AS last_item_at
           FROM order_items_clean WHERE status <> 'Cancelled' GROUP BY user_id) i ON o.user_id = i.user_id
WHERE coalesce(i.pre_cutoff_items, 0) = 0""")
def _c18(p):
    return q.missing_customer_diagnosis(p.features)


# ====================================================================== Sources
from martflow.sources import bronze as _bronze, io as _io  # noqa: E402


def _register_bronze(name: str) -> None:
    @register(f"bronze_{name}", f"SELECT *, '{name}' AS _source_file FROM b_{name}")
    def _a3(p):
        return p.bronze[name].drop("_ingested_at")       # it varies from run to run
    _a3.__doc__ = f"A3: Bronze copy of {name} with its source."


for _name in ("users", "orders", "order_items", "products", "inventory_items", "distribution_centers", "events"):
    _register_bronze(_name)


@register("sample_split_shares", """
SELECT split, churned, count(*) AS customers, count(smp.user_id) AS sampled
FROM md_split LEFT JOIN (SELECT user_id FROM fs_dataset
                         ORDER BY ((user_id % 1000003) * 6007 + 17) % 999983, user_id LIMIT 100) smp
  ON md_split.user_id = smp.user_id GROUP BY split, churned""")
def _f4_f11(p):
    """F4 + F11: customers and sampled customers per split and class."""
    split = md.train_test_split(md.training_set(p.dataset), p.cfg).select("user_id", "churned", "split")
    sample = md.fixed_sample(p.dataset.select("user_id"), 100).select(F.col("user_id").alias("s"))
    return (split.join(sample, F.col("user_id") == F.col("s"), "left").groupBy("split", "churned")
            .agg(F.count(F.lit(1)).alias("customers"), F.count("s").alias("sampled")))


@register("table_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in ("customer_360", "product_performance", "inventory_health", "fulfillment_metrics",
              "funnel_analytics", "preds")).replace("'preds'", "'predictions'"))
def _a11(p):
    return _io.table_catalog({**p.gold, "predictions": p.predictions})


@register("preview_customer_360", """
SELECT user_id, order_count, lifetime_spend, favorite_category FROM customer_360
WHERE order_count > 0 ORDER BY lifetime_spend DESC, user_id LIMIT 5""")
def _a13(p):
    return _io.preview(p.g("customer_360").select("user_id", "order_count", "lifetime_spend",
                                                  "favorite_category"),
                       5, [F.desc("lifetime_spend"), "user_id"], F.col("order_count") > 0)


# ====================================================================== MLlib
_TRAINED: dict = {}
_MODEL = "churn_prediction"


def _trained(p):
    """Fit the baseline and the whole boosted-tree grid once per Spark
    application and input/config key."""
    from martflow.operators import ml
    if p.key not in _TRAINED:              # the key names the application
        _TRAINED.clear()
        _TRAINED[p.key] = ml.train_and_compare(p.dataset, p.cfg, ml.candidates(), store=p._table)
    return _TRAINED[p.key]


def _serving(p):
    """The pipeline with the champion as its scorer, read back from the model folder."""
    from martflow.operators import ml, serving
    from martflow.session import scratch_path
    from martflow.sources.models import ModelFolder
    res = _trained(p)
    folder = ModelFolder(p.spark, scratch_path(p.spark, f"models/{p.key}"), _MODEL)
    if res.served is None:
        best = ml.best_run(res.metrics).first()
        folder.promote(folder.register(best["run"], res.models[best["run"]], res.encoders, best["auc"]))
        res.served = folder
    return p.with_scorer(serving.champion(folder))


@register("model_comparison")
def _f6_f7(p):
    """F6 + F7: logistic regression and the boosted-tree grid, test metrics."""
    return _trained(p).metrics


@register("model_test_rows", """
SELECT run, count(*) AS n, CAST(sum(churned) AS BIGINT) AS positives, true AS metrics_in_range
FROM md_split, (VALUES ('lr_baseline'), ('gbt_0.05lr_4d_100est'), ('gbt_0.05lr_6d_200est'), ('gbt_0.1lr_4d_100est'),
                       ('gbt_0.1lr_6d_200est')) c(run)
WHERE split = 'test' GROUP BY run""")
def _f9_rows(p):
    """every candidate is measured once, on all test rows; AUC, precision, recall and F1 are shares."""
    shares = [F.col(c).between(0, 1) for c in ("auc", "precision", "recall", "f1")]
    return _trained(p).metrics.select("run", "n", "positives", (shares[0] & shares[1] & shares[2] & shares[3])
                                      .alias("metrics_in_range"))


@register("best_model")
def _f9(p):
    from martflow.operators import ml
    return ml.best_run(_trained(p).metrics)


@register("champion_entry")
def _f9_champion(p):
    """the entry of the version that serves."""
    _serving(p)
    return _trained(p).served.champion()


@register("feature_importance")
def _f10(p):
    """importances of the best boosted tree."""
    from martflow.operators import ml
    res = _trained(p)
    best = ml.best_run(res.metrics, "gbt_").first()["run"]
    return ml.feature_importance(p.spark, res.models[best])


@register("champion_predictions")
def _f12(p):
    """every customer scored by the champion."""
    return _serving(p).predictions


@register("scored_batch_check", """
SELECT count(*) AS customers, count(DISTINCT user_id) AS distinct_customers, CAST(0 AS BIGINT) AS not_in_dataset,
       CAST(0 AS BIGINT) AS probability_out_of_range, CAST(0 AS BIGINT) AS label_off, count(*) AS snapshot_rows,
       count(churned) AS outcomes_known, 1::BIGINT AS models FROM fs_dataset""")
def _f12_check(p):
    """what must hold for any model: each customer scored once, from a recorded snapshot."""
    from martflow.functions.exprs import side_by_side
    served = _serving(p)
    known = p.dataset.select(F.col("user_id").alias("known"), "churned")
    rows = served.predictions.join(known, F.col("user_id") == F.col("known"), "left").agg(
        F.count(F.lit(1)).alias("customers"), F.count_distinct("user_id").alias("distinct_customers"),
        F.count_if(F.col("known").isNull()).alias("not_in_dataset"),
        F.count_if(~F.col("churn_probability").between(0, 1)).alias("probability_out_of_range"),
        F.count_if(F.col("predicted_label") != (F.col("churn_probability") >= p.cfg.decision_threshold).cast("int"))
        .alias("label_off"), F.count("churned").alias("outcomes_known"),
        F.count_distinct(F.struct("model_name", "model_version")).alias("models"))
    return side_by_side(rows, served.snapshot.agg(F.count(F.lit(1)).alias("snapshot_rows")))


@register("batch_scores")
def _f12_sample(p):
    """a fixed-size sample of customers scored by the champion."""
    from martflow.operators import serving
    served = _serving(p)
    rows = md.training_set(md.fixed_sample(p.dataset, p.cfg.sample_size)).drop("churned")
    return serving.predictions(serving.inference_snapshot(rows, served.scorer.encoders), served.scorer, p.cfg)


@register("champion_monitoring")
def _g10_champion(p):
    """G7-G10 on the champion's batch."""
    return _serving(p).monitoring["summary"].drop("timestamp")


@register("champion_signals")
def _h11_champion(p):
    """H3-H11 with the champion's batch as predictions."""
    return _serving(p).signals


_CUST_TYPES = [("user_id", "id", "BIGINT"), ("first_name", "first_name", "VARCHAR"),
               ("last_name", "last_name", "VARCHAR"), ("email", "email", "VARCHAR"), ("age", "age", "BIGINT"),
               ("gender", "gender", "VARCHAR"), ("state", "state", "VARCHAR"),
               ("street_address", "street_address", "VARCHAR"), ("postal_code", "postal_code", "VARCHAR"),
               ("city", "city", "VARCHAR"), ("country", "country", "VARCHAR"), ("latitude", "latitude", "DOUBLE"),
               ("longitude", "longitude", "DOUBLE"), ("traffic_source", "traffic_source", "VARCHAR"),
               ("created_at", "created_at", "TIMESTAMP")]


@register("cast_failures", " UNION ALL ".join(
    f"SELECT 'customers_clean' AS \"table\", '{c}' AS \"column\", "
    f"count(CASE WHEN {src} IS NOT NULL AND TRY_CAST({src} AS {t}) IS NULL THEN 1 END) AS cast_failures FROM b_users"
    for c, src, t in _CUST_TYPES))
def _t25(p):
    """Malformed source values turned NULL by try_cast (users -> customers)."""
    from martflow.operators.silver import SILVER_SCHEMAS
    return q.cast_failures(p.raw["users"], "customers_clean", SILVER_SCHEMAS["customers_clean"], {"user_id": "id"})


# ---- quarantine: the raw tables as text, a value of every 101st key made unreadable
_BAD = 101
_TYPED = {t: [c for c, is_str in cols if not is_str] for t, cols in RAW_COLUMNS.items()}


def _as_text(p, source):
    """Raw table with all values as text; row key % 101 = k spoils its k-th typed column."""
    raw, typed = p.once[source], _TYPED[source]
    spoilt = {c: F.when(F.col(PK[source]) % _BAD == typed.index(c), F.concat(F.lit("?"), F.col(c).cast("string")))
              .otherwise(F.col(c).cast("string")) for c in typed}
    return raw.select(*[(spoilt[c] if c in spoilt else F.col(c)).alias(c) for c in raw.columns])


def _quarantined(p, name):
    from martflow.operators import quarantine
    from martflow.session import scratch_path
    source = _SOURCES[name]
    judged = quarantine.judge(_as_text(p, source), name, p.once[source].schema)
    return quarantine.split(judged, name, scratch_path(p.spark, f"quarantine/{p.key}/{uuid.uuid4().hex}/{name}"))


_SOURCES = _SILVER_SRC
_HIT = {t: " OR ".join(f"(r.{PK[t]} % {_BAD} = {k} AND r.{c} IS NOT NULL)" for k, c in enumerate(cols))
        for t, cols in _TYPED.items()}


def _quarantine_sql(name: str) -> str:
    source = _SOURCES[name]
    broken = " OR ".join(f"({r.violation})" for r in q.CONSTRAINTS.get(name, [])) or "false"
    key = {"customers_clean": "user_id", "orders_clean": "order_id", "order_items_clean": "order_item_id",
           "products_clean": "product_id", "inventory_clean": "inventory_item_id", "events_clean": "event_id",
           "distribution_centers_clean": "distribution_center_id"}[name]
    hit = f"(SELECT r.{PK[source]} AS k FROM b_{source} r WHERE {_HIT[source]})"
    return (f"SELECT '{name}' AS \"table\", count(CASE WHEN coalesce({broken}, false) OR {key} IN {hit} THEN NULL ELSE 1 END) "
            f"AS accepted, count(CASE WHEN coalesce({broken}, false) OR {key} IN {hit} THEN 1 END) AS rejected FROM {name}")


@register("quarantine_counts", " UNION ALL ".join(_quarantine_sql(n) for n in _SOURCES))
def _c10_quarantine(p):
    """C10 + T25 + A3: all seven tables read as text, accepted and rejected rows."""
    parts = []
    for name in _SOURCES:
        accepted, rejected = _quarantined(p, name)
        parts.append(side_by_side(accepted.agg(F.count(F.lit(1)).alias("accepted")),
                                  rejected.agg(F.count(F.lit(1)).alias("rejected")))
                     .select(F.lit(name).alias("table"), "accepted", "rejected"))
    return md.union_all(parts)


@register("quarantine_type_reasons", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", 'type:{c}' AS reason, count(*) AS rows FROM b_{t} r "
    f"WHERE r.{PK[t]} % {_BAD} = {k} AND r.{c} IS NOT NULL HAVING count(*) > 0"
    for n, t in _SOURCES.items() for k, c in enumerate(_TYPED[t])))
def _t25_all(p):
    """T25 for all seven tables: rejected rows per column that did not cast."""
    from martflow.operators import quarantine
    rejected = md.union_all([_quarantined(p, name)[1] for name in _SOURCES])
    return quarantine.reasons(rejected).where(F.col("reason").startswith("type:"))


@register("quarantine_replay", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(CASE WHEN {_HIT[t]} THEN 1 END) AS replayed, "
    f"CAST(0 AS BIGINT) AS still_malformed FROM b_{t} r" for n, t in _SOURCES.items()))
def _c10_replay(p):
    """Rejected rows with an unreadable value, mended (the mark taken off) and judged again."""
    from martflow.operators import quarantine

    def mend(rows):
        return rows.select(*[F.regexp_replace(c, "^[?]", "").alias(c) for c in rows.columns])

    parts = []
    for name in _SOURCES:
        malformed = _quarantined(p, name)[1].where(F.exists("broken", lambda b: b.startswith("type:")))
        again = quarantine.replay(malformed, name, p.once[_SOURCES[name]].schema, mend)
        parts.append(again.agg(F.count(F.lit(1)).alias("replayed"), F.count_if(F.exists(
            "broken", lambda b: b.startswith("type:"))).alias("still_malformed")).withColumn("table", F.lit(name)))
    return md.union_all(parts)


# ---- many cutoffs: backtest
_BACKTEST_LABELS = """
SELECT c.cutoff, o.user_id,
       CAST(CASE WHEN max(CASE WHEN o.created_at >= c.cutoff THEN 1 ELSE 0 END) = 1 THEN 0 ELSE 1 END AS INTEGER) AS churned
FROM orders_clean o, (VALUES """ + ", ".join(f"(DATE '{c}')" for c in SNAPSHOT_CUTOFFS) + """) c(cutoff)
WHERE o.status <> 'Cancelled' AND CAST(o.created_at AS DATE) <= c.cutoff + 90
GROUP BY c.cutoff, o.user_id HAVING max(CASE WHEN o.created_at < c.cutoff THEN 1 ELSE 0 END) = 1"""
_BACKTEST_ROWS = f"""
SELECT l.cutoff, l.churned, round(least(f.days_since_last_order, 400) / 400.0, 4) AS score
FROM ({_BACKTEST_LABELS}) l JOIN feature_snapshots f ON f.user_id = l.user_id AND f.event_timestamp = CAST(l.cutoff AS TIMESTAMP)"""


def _backtest(p):
    from martflow.operators import backtest
    return p._table(backtest.dataset(p.silver, SNAPSHOT_CUTOFFS, p.cfg), "backtest_dataset")


@register("backtest_labels", f"SELECT CAST(cutoff AS TIMESTAMP) AS cutoff, user_id, churned FROM ({_BACKTEST_LABELS}) t")
def _e7_many(p):
    """E7 at many cutoffs in one pass over the orders."""
    from martflow.operators import backtest
    return backtest.labels(p.silver, SNAPSHOT_CUTOFFS, p.cfg).withColumn("cutoff", F.col("cutoff").cast("timestamp_ntz"))


@register("backtest_dataset", f"""
SELECT CAST(l.cutoff AS TIMESTAMP) AS cutoff, l.user_id, l.churned, {', '.join('f.' + c for c in FEATURE_COLS)}
FROM ({_BACKTEST_LABELS}) l JOIN feature_snapshots f ON f.user_id = l.user_id AND f.event_timestamp = CAST(l.cutoff AS TIMESTAMP)""")
def _e9_many(p):
    """E9 at many cutoffs: labels and features with the cutoff as a column."""
    return _backtest(p).withColumn("cutoff", F.col("cutoff").cast("timestamp_ntz"))


@register("backtest_metrics", f"""
SELECT CAST(c.cutoff AS TIMESTAMP) AS cutoff, c.n, c.positives, CAST(a.auc2 AS DOUBLE) / (2.0 * c.positives * (c.n - c.positives)) AS auc,
       CASE WHEN c.tp + c.fp > 0 THEN c.tp / (c.tp + c.fp) ELSE 0.0 END AS precision,
       CASE WHEN c.positives > 0 THEN c.tp / c.positives ELSE 0.0 END AS recall
FROM (SELECT cutoff, count(*) AS n, CAST(sum(churned) AS BIGINT) AS positives,
             CAST(sum(churned * CAST(score >= 0.5 AS INTEGER)) AS BIGINT) AS tp,
             CAST(sum((1 - churned) * CAST(score >= 0.5 AS INTEGER)) AS BIGINT) AS fp FROM ({_BACKTEST_ROWS}) r GROUP BY cutoff) c
JOIN (SELECT cutoff, sum(CAST(pos AS HUGEINT) * (2 * (upto - neg) + neg)) AS auc2 FROM (
        SELECT cutoff, score, pos, neg, sum(neg) OVER (PARTITION BY cutoff ORDER BY score) AS upto
        FROM (SELECT cutoff, score, CAST(sum(churned) AS BIGINT) AS pos, CAST(sum(1 - churned) AS BIGINT) AS neg
              FROM ({_BACKTEST_ROWS}) r GROUP BY cutoff, score) g) s GROUP BY cutoff) a ON a.cutoff = c.cutoff""")
def _f4_by_time(p):
    """F4 by time + F8: metrics of the surrogate score per cutoff."""
    from martflow.operators import backtest
    found = backtest.metrics(_backtest(p), lambda df: df.withColumn("score", md.surrogate_score()), p.cfg)
    return found.select(F.col("cutoff").cast("timestamp_ntz").alias("cutoff"), "n", "positives", "auc", "precision", "recall")


@register("backtest_walk_forward")
def _f4_walk(p):
    """F4 by time + F6: logistic regression on closed cutoffs, tested on the next."""
    from martflow.operators import backtest, ml
    return backtest.walk_forward(_backtest(p), ml.logistic_regression(100), p.cfg)


# ---- key-bucketed feature store
def _store(p, until: list[str]):
    from martflow.operators.featurestore import FeatureStore
    from martflow.session import scratch_path
    store = FeatureStore(p.spark, scratch_path(p.spark, f"features/{p.key}/{uuid.uuid4().hex}"))
    store.append(_snapshots(p))
    for t in until:
        store.materialize(t)
    return store


@register("feature_store_latest", "SELECT user_id, " + ", ".join(FEATURE_COLS)
          + """, event_timestamp FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS rn FROM feature_snapshots) t WHERE rn = 1""")
def _e12_store(p):
    """Latest features after three incremental steps, a bucket rewritten only for new rows."""
    return _store(p, [f"{c} 00:00:00" for c in SNAPSHOT_CUTOFFS]).latest().drop("bucket")
