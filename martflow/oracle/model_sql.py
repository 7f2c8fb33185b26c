"""DuckDB twin of predictions (surrogate), model data, metrics and drift."""

from __future__ import annotations

from martflow.oracle.sqlfn import gratio, rnd

CATEGORICAL = ["favorite_category", "gender", "country", "traffic_source"]
MODEL_FEATURES = ["order_count", "lifetime_spend", "avg_order_value", "days_since_last_order",
                  "first_to_second_order_days", "total_items_purchased", "return_rate",
                  "total_sessions", "session_count_30d", "avg_session_depth", "browse_to_buy_ratio",
                  "cart_abandonment_rate", "days_since_last_session",
                  "distinct_products_purchased", "distinct_categories_purchased", "favorite_category",
                  "age", "gender", "country", "traffic_source", "account_age_days"]
NUMERIC = [f for f in MODEL_FEATURES if f not in CATEGORICAL]


def _fill(c: str) -> str:
    if c in CATEGORICAL:
        return f"coalesce({c}, 'Unknown') AS {c}"
    if c == "first_to_second_order_days":
        return f"coalesce({c}, -1) AS {c}"
    return f"coalesce({c}, 0) AS {c}"


SPLIT = """CASE WHEN row_number() OVER (PARTITION BY churned
    ORDER BY ((user_id % 1000003) * 7919 + 42) % 1000, user_id % 1000003, user_id)
  <= floor(count(*) OVER (PARTITION BY churned) * 0.2 + 0.5) THEN 'test' ELSE 'train' END"""
PROB = rnd("least(days_since_last_order, 400)", "400", 4)


def _melt(src: str, features: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, side FROM {src}" for f in features)


def _w1(counts: str, ref_long: str) -> str:
    """Normed Wasserstein per feature from (feature, value, n_ref, n_cur)."""
    return f"""
SELECT w.feature, w.w1 / greatest(s.std_ref, 0.001) AS stat_value
FROM (SELECT feature, sum(abs(cum_ref / n_ref_tot - cum_cur / n_cur_tot)
                          * coalesce(next_value - value, 0.0)) AS w1
      FROM (SELECT feature, value,
                   sum(n_ref) OVER (PARTITION BY feature ORDER BY value) AS cum_ref,
                   sum(n_cur) OVER (PARTITION BY feature ORDER BY value) AS cum_cur,
                   sum(n_ref) OVER (PARTITION BY feature) AS n_ref_tot,
                   sum(n_cur) OVER (PARTITION BY feature) AS n_cur_tot,
                   lead(value) OVER (PARTITION BY feature ORDER BY value) AS next_value
            FROM {counts}) t
      GROUP BY feature) w
JOIN (SELECT feature, stddev_pop(value) AS std_ref FROM {ref_long} WHERE value IS NOT NULL
      GROUP BY feature) s ON w.feature = s.feature"""


def model_ctes() -> list[tuple[str, str]]:
    fills = ", ".join(_fill(c) for c in MODEL_FEATURES)
    enc_src = " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS col_name, CAST({c} AS VARCHAR) AS value FROM md_split WHERE split = 'train'"
        for c in CATEGORICAL)
    enc_joins = " ".join(
        f"LEFT JOIN md_enc e_{c} ON e_{c}.col_name = '{c}' AND e_{c}.value = CAST(s.{c} AS VARCHAR)"
        for c in CATEGORICAL)
    enc_cols = ", ".join(f"coalesce(e_{c}.idx, -1) AS {c}" if c in CATEGORICAL else f"s.{c}"
                         for c in MODEL_FEATURES)
    cat_list = ", ".join(f"'{c}'" for c in CATEGORICAL)
    return [
        ("preds", f"""
SELECT user_id, {PROB} AS churn_probability, CAST({PROB} >= 0.5 AS INTEGER) AS predicted_label,
       'surrogate_recency' AS model_name, '0' AS model_version
FROM fs_dataset"""),
        ("md_train", f"SELECT user_id, churned, {', '.join(MODEL_FEATURES)} FROM fs_dataset"),
        ("md_filled", f"SELECT user_id, churned, {fills} FROM md_train"),
        ("md_split", f"SELECT *, {SPLIT} AS split FROM md_filled"),
        ("md_enc", f"""
SELECT col_name, value, CAST(row_number() OVER (PARTITION BY col_name ORDER BY value) - 1 AS INTEGER) AS idx
FROM ({enc_src}) t"""),
        ("md_encoded", f"""
SELECT s.user_id, s.churned, s.split, {enc_cols} FROM md_split s {enc_joins}"""),
        # train and test rows, and the scored batch (every customer) with its known outcomes
        ("md_scored", f"""
SELECT e.split AS population, e.user_id, e.churned, p.churn_probability AS score, {', '.join('e.' + c for c in MODEL_FEATURES)}
FROM md_encoded e JOIN preds p ON e.user_id = p.user_id
UNION ALL
SELECT 'batch', p.user_id, a.churned, p.churn_probability, {', '.join('e.' + c for c in MODEL_FEATURES)}
FROM preds p JOIN md_encoded e ON e.user_id = p.user_id LEFT JOIN fs_dataset a ON a.user_id = p.user_id"""),
        # ---- binary metrics per population (score vs known outcome)
        ("mq_conf", """
SELECT population, count(*) AS n, CAST(sum(churned) AS BIGINT) AS positives,
       CAST(sum(churned * CAST(score >= 0.5 AS INTEGER)) AS BIGINT) AS tp,
       CAST(sum((1 - churned) * CAST(score >= 0.5 AS INTEGER)) AS BIGINT) AS fp,
       CAST(sum(churned * (1 - CAST(score >= 0.5 AS INTEGER))) AS BIGINT) AS fn,
       round(-avg(churned * ln(least(greatest(score, 1e-15), 1 - 1e-15))
                  + (1 - churned) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))), 6) AS log_loss
FROM md_scored WHERE churned IS NOT NULL GROUP BY population"""),
        ("mq_auc", """
SELECT population, sum(CAST(pos AS HUGEINT) * (2 * (cum_neg - neg) + neg)) AS auc2 FROM (
  SELECT population, score, pos, neg, sum(neg) OVER (PARTITION BY population ORDER BY score) AS cum_neg
  FROM (SELECT population, score, CAST(sum(churned) AS BIGINT) AS pos, CAST(sum(1 - churned) AS BIGINT) AS neg
        FROM md_scored WHERE churned IS NOT NULL GROUP BY population, score) a) b
GROUP BY population"""),
        ("mq_metrics", f"""
SELECT c.population, c.n, c.positives,
       CASE WHEN c.positives > 0 AND c.n - c.positives > 0
            THEN CAST(a.auc2 AS DOUBLE) / (2.0 * c.positives * (c.n - c.positives)) END AS auc,
       CASE WHEN c.tp + c.fp > 0 THEN c.tp / (c.tp + c.fp) ELSE 0.0 END AS precision,
       CASE WHEN c.tp + c.fn > 0 THEN c.tp / (c.tp + c.fn) ELSE 0.0 END AS recall,
       CASE WHEN 2 * c.tp + c.fp + c.fn > 0 THEN 2 * c.tp / (2 * c.tp + c.fp + c.fn) ELSE 0.0 END AS f1,
       c.log_loss, a.auc2, 2 * c.positives * (c.n - c.positives) AS auc_den
FROM mq_conf c LEFT JOIN mq_auc a ON c.population = a.population"""),
        # ---- data drift (reference = train rows, current = batch)
        ("dr_rows", "SELECT *, CASE WHEN population = 'train' THEN 'ref' ELSE 'cur' END AS side "
                    "FROM md_scored WHERE population <> 'test'"),
        ("dr_long", _melt("dr_rows", MODEL_FEATURES)),
        ("dr_counts", """
SELECT feature, value, CAST(sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS BIGINT) AS n_ref,
       CAST(sum(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS BIGINT) AS n_cur
FROM dr_long WHERE value IS NOT NULL GROUP BY feature, value"""),
        ("dr_kinds", f"""
SELECT feature, (feature IN ({cat_list}) OR count(*) <= 5) AS disc
FROM dr_counts WHERE n_ref > 0 GROUP BY feature"""),
        ("dr_wd", _w1("(SELECT c.* FROM dr_counts c JOIN dr_kinds k ON c.feature = k.feature AND NOT k.disc)",
                      "(SELECT l.* FROM dr_long l JOIN dr_kinds k ON l.feature = k.feature AND NOT k.disc "
                      "WHERE l.side = 'ref')")),
        ("dr_js", """
SELECT feature, sqrt(greatest(sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0.0 END
                                 + 0.5 * CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0.0 END), 0.0)) AS stat_value
FROM (SELECT feature, p, q, (p + q) / 2 AS m FROM (
        SELECT c.feature, c.n_ref / sum(c.n_ref) OVER (PARTITION BY c.feature) AS p,
               c.n_cur / sum(c.n_cur) OVER (PARTITION BY c.feature) AS q
        FROM dr_counts c JOIN dr_kinds k ON c.feature = k.feature AND k.disc) x) y
GROUP BY feature"""),
        ("drift_table", """
SELECT feature, method, round(stat_value, 6) AS stat_value, 0.1 AS threshold,
       round(stat_value, 6) > 0.1 AS drifted
FROM (SELECT feature, 'wasserstein_distance_norm' AS method, stat_value FROM dr_wd
      UNION ALL SELECT feature, 'jensenshannon' AS method, stat_value FROM dr_js) t"""),
        # ---- prediction drift (scores of the test rows and of the batch)
        ("pd_long", "SELECT 'score' AS feature, score AS value, CASE WHEN population = 'test' THEN 'ref' ELSE 'cur' END AS side "
                    "FROM md_scored WHERE population <> 'train'"),
        ("pd_counts", """
SELECT feature, value, CAST(sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS BIGINT) AS n_ref,
       CAST(sum(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS BIGINT) AS n_cur
FROM pd_long WHERE value IS NOT NULL GROUP BY feature, value"""),
        ("pd_w", _w1("pd_counts", "(SELECT * FROM pd_long WHERE side = 'ref')")),
        ("prediction_drift", """
SELECT 'wasserstein_distance_norm' AS method, round(stat_value, 4) AS score, 0.1 AS threshold,
       round(stat_value, 4) > 0.1 AS drift_detected FROM pd_w"""),
        ("model_quality", f"""
SELECT max(CASE WHEN population = 'test' THEN auc END) AS auc_ref, max(CASE WHEN population = 'test' THEN f1 END) AS f1_ref,
       max(CASE WHEN population = 'test' THEN precision END) AS precision_ref,
       max(CASE WHEN population = 'test' THEN recall END) AS recall_ref,
       max(CASE WHEN population = 'batch' THEN auc END) AS auc_cur, max(CASE WHEN population = 'batch' THEN f1 END) AS f1_cur,
       max(CASE WHEN population = 'batch' THEN precision END) AS precision_cur,
       max(CASE WHEN population = 'batch' THEN recall END) AS recall_cur,
       (max(CASE WHEN population = 'test' THEN auc END) - max(CASE WHEN population = 'batch' THEN auc END))
           / max(CASE WHEN population = 'test' THEN auc END) AS auc_drop,
       (max(CASE WHEN population = 'test' THEN auc END) - max(CASE WHEN population = 'batch' THEN auc END))
           / max(CASE WHEN population = 'test' THEN auc END) > 0.05 AS model_degraded
FROM mq_metrics"""),
        ("monitoring_summary", """
SELECT d.features_drifted > 0 AS data_drift_detected, d.features_drifted, d.features_tested,
       p.drift_detected AS prediction_drift_detected, p.method AS prediction_drift_method,
       p.score AS prediction_drift_score, p.threshold AS prediction_drift_threshold,
       q.model_degraded, round(q.auc_ref, 4) AS auc_ref, round(q.auc_cur, 4) AS auc_cur,
       round(q.auc_drop * 100, 2) AS auc_drop_pct,
       CASE WHEN d.features_drifted > 0 OR p.drift_detected OR q.model_degraded
            THEN 'INVESTIGATE' ELSE 'CONTINUE_SERVING' END AS recommendation
FROM (SELECT CAST(sum(CAST(drifted AS INTEGER)) AS BIGINT) AS features_drifted,
             count(*) AS features_tested FROM drift_table) d,
     prediction_drift p, model_quality q"""),
    ]


def gratio_(p, q, d):  # re-export for catalog convenience
    return gratio(p, q, d)
