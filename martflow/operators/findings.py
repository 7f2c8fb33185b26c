"""Drill-downs, confidence, priority and findings.

Inputs are the (tiny) signals table, the Gold tables and the one-row
monitoring summary; every step is a DataFrame expression, the evidence
lists are ``collect_list`` over at most a handful of drill-down rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martflow.config import DEFAULT, Config
from martflow.functions.exprs import cents
from martflow.operators.signals import periods

ACTIONABLE = ["critical", "notable"]
CORROBORATING = ["critical", "notable", "warning"]


def _top(df: DataFrame, domain: str, n: int | None, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(F.lit(domain)).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(w))
    if n is not None:
        out = out.filter(F.col("rank") <= n)
    return out.withColumn("domain", F.lit(domain))


# ----------------------------------------------------------------- H12
def drilldowns(gold: dict[str, DataFrame], cfg: Config = DEFAULT) -> DataFrame:
    """(domain, rank, label, value_1, value_2, evidence) for the four domains."""
    fm, c360, fa = gold["fulfillment_metrics"], gold["customer_360"], gold["funnel_analytics"]
    cur, _ = periods(fm, cfg)
    cur_fm = fm.filter(F.col("order_month") == cur)
    rev = _top(cur_fm.select(F.col("distribution_center_name").alias("label"),
                             (cents("total_revenue") / 100.0).alias("value_1"),
                             F.col("orders_fulfilled").cast("double").alias("value_2")),
               "revenue", 5, [F.desc("value_1"), F.asc("label")])
    rev = rev.withColumn("evidence", F.format_string(
        "  DC '%s': $%s revenue, %s orders", "label", F.format_number("value_1", 0),
        F.format_number("value_2", 0)))
    src = (c360.groupBy("traffic_source")
           .agg(F.count(F.lit(1)).cast("double").alias("value_1"),
                F.avg("order_count").alias("value_2"))
           .select(F.col("traffic_source").alias("label"), "value_1", "value_2"))
    src = _top(src, "customers", None, [F.desc("value_1"), F.asc("label")])
    src = src.withColumn("evidence", F.format_string(
        "  Source '%s': %s users, avg %s orders", "label", F.format_number("value_1", 0),
        F.format_number("value_2", 1)))
    conv = (fa.groupBy("event_month")
            .agg((F.sum(F.round(F.col("session_to_purchase_rate") * 10000).cast("long"))
                  / F.count("session_to_purchase_rate") / 10000.0).alias("value_1"),
                 F.count_distinct("user_id").cast("double").alias("value_2"))
            .select(F.date_format("event_month", "yyyy-MM-dd HH:mm:ss").alias("label"),
                    "value_1", "value_2"))
    conv = _top(conv, "conversion", 6, [F.desc("label")])
    conv = conv.withColumn("evidence", F.format_string(
        "  %s: conv=%s, users=%s", "label", F.format_number("value_1", 4), F.format_number("value_2", 0)))
    ful = (cur_fm.groupBy("distribution_center_name")
           .agg((F.sum(F.round(F.col("avg_delivery_days") * 10).cast("long"))
                 / F.count("avg_delivery_days") / 10.0).alias("value_1"),
                (F.sum(F.round(F.col("on_time_rate") * 10000).cast("long"))
                 / F.count("on_time_rate") / 10000.0).alias("value_2"))
           .select(F.col("distribution_center_name").alias("label"), "value_1", "value_2"))
    ful = _top(ful, "fulfillment", 5, [F.desc("value_1"), F.asc("label")])
    ful = ful.withColumn("evidence", F.format_string(
        "  DC '%s': %s days avg, %s%% on-time", "label", F.format_number("value_1", 1),
        F.format_number(F.col("value_2") * 100, 1)))
    cols = ["domain", "rank", "label", "value_1", "value_2", "evidence"]
    return rev.select(cols).unionByName(src.select(cols)).unionByName(conv.select(cols)) \
        .unionByName(ful.select(cols))


# ----------------------------------------------------------------- H13, H14
def confidence(n_corroborating: Column, n_domain: Column, n_evidence: Column) -> Column:
    """Share of corroborating signals in the domain, +0.2 with > 2 evidence
    lines, capped at 1, rounded to 2 decimals."""
    base = F.least(n_corroborating / F.greatest(n_domain, F.lit(1)), F.lit(1.0))
    return F.round(F.when(n_evidence > 2, F.least(base + 0.2, F.lit(1.0))).otherwise(base), 2)


def priority(severity: Column, conf: Column) -> Column:
    """P1 critical, or notable with confidence >= 0.8; P2 notable / warning
    with confidence >= 0.6; else P3."""
    return (F.when(severity == "critical", "P1")
             .when((severity == "notable") & (conf >= 0.8), "P1")
             .when(severity.isin("notable", "warning") & (conf >= 0.6), "P2")
             .otherwise("P3"))


def _pct1(x: Column) -> Column:
    return F.concat(F.regexp_replace(F.format_number(x * 100, 1), ",", ""), F.lit("%"))


def _signed_pct1(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), _pct1(x))


# ----------------------------------------------------------------- H15
def findings(signals: DataFrame, drills: DataFrame, monitoring: DataFrame,
             fulfillment: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Actionable findings (with drill-down evidence), warning findings and
    the always-present monitoring finding, ordered by priority."""
    cur, prior = periods(fulfillment, cfg)
    w_dom = Window.partitionBy("domain")
    sig = signals.withColumns({
        "_n_dom": F.count(F.lit(1)).over(w_dom),
        "_n_corr": F.sum(F.col("severity").isin(*CORROBORATING).cast("int")).over(w_dom)})
    ev = (drills.groupBy("domain")
          .agg(F.sort_array(F.collect_list(F.struct("rank", "evidence"))).alias("_ev")))
    act = sig.filter(F.col("severity").isin(*ACTIONABLE)).join(ev, "domain", "left")
    act_evidence = F.concat(F.array(F.col("context")),
                            F.coalesce(F.transform("_ev", lambda s: s["evidence"]),
                                       F.array().cast("array<string>")))
    act = act.withColumn("evidence", act_evidence)
    conf = confidence(F.col("_n_corr"), F.col("_n_dom"), F.size("evidence"))
    title = F.concat(F.col("metric"), F.lit(" — "), F.upper("direction"), F.lit(" "),
                     _pct1(F.abs(F.col("delta_pct"))))
    fmt_ts = "yyyy-MM-dd HH:mm:ss"
    act = act.select(
        F.col("metric"), title.alias("title"),
        F.concat(F.col("metric"), F.lit(" moved "), _signed_pct1(F.col("delta_pct")), F.lit(" from "),
                 F.date_format(prior, fmt_ts), F.lit(" to "), F.date_format(cur, fmt_ts),
                 F.lit(".")).alias("description"),
        conf.alias("confidence"), "severity", "evidence",
        F.concat(F.lit("Investigate "), F.lower("metric"), F.lit(" drivers in the "), F.col("domain"),
                 F.lit(" domain.")).alias("recommended_action"),
        F.lit(0).alias("_group"), F.col("signal_order").alias("_order"))
    warn = signals.filter(F.col("severity") == "warning").select(
        "metric", title.alias("title"), F.col("context").alias("description"),
        F.lit(0.6).alias("confidence"), "severity", F.array("context").alias("evidence"),
        F.concat(F.lit("Monitor "), F.lower("metric"), F.lit(" trend over the next period."))
         .alias("recommended_action"),
        F.lit(1).alias("_group"), F.col("signal_order").alias("_order"))
    flags = (F.col("data_drift_detected").cast("int") + F.col("prediction_drift_detected").cast("int")
             + F.col("model_degraded").cast("int"))
    yes_no = lambda c: F.when(F.col(c), "YES").otherwise("No")
    mon = monitoring.select(
        F.lit("ML Model Monitoring Status").alias("metric"),
        F.lit("ML Model Monitoring Status").alias("title"),
        F.concat(F.lit("Data drift: "), F.col("features_drifted").cast("string"), F.lit("/"),
                 F.col("features_tested").cast("string"), F.lit(" features. Prediction drift: "),
                 yes_no("prediction_drift_detected"), F.lit(". Model degradation: "),
                 yes_no("model_degraded"), F.lit(". Recommendation: "), F.col("recommendation"),
                 F.lit(".")).alias("description"),
        F.round(F.lit(0.7) + flags * 0.1, 2).alias("confidence"),
        F.when(F.col("prediction_drift_detected"), "warning").otherwise("normal").alias("severity"),
        F.array(
            F.concat(F.lit("Feature drift: "), F.col("features_drifted").cast("string"), F.lit("/"),
                     F.col("features_tested").cast("string"), F.lit(" features drifted")),
            F.concat(F.lit("Prediction drift: "), F.col("prediction_drift_method"), F.lit(" = "),
                     F.col("prediction_drift_score").cast("string"), F.lit(" (threshold: "),
                     F.col("prediction_drift_threshold").cast("string"), F.lit(")")),
            F.concat(F.lit("AUC: "), F.col("auc_ref").cast("string"), F.lit(" → "),
                     F.col("auc_cur").cast("string"), F.lit(" (drop: "),
                     F.col("auc_drop_pct").cast("string"), F.lit("%)")),
            F.concat(F.lit("Recommendation: "), F.col("recommendation"))).alias("evidence"),
        F.lit("Investigate prediction drift source before retraining.").alias("recommended_action"),
        F.lit(2).alias("_group"), F.lit(0).alias("_order"))
    allf = act.unionByName(warn).unionByName(mon)
    allf = allf.withColumn("priority", priority(F.col("severity"), F.col("confidence")))
    # stable priority sort: P1, P2, P3, then the order findings were produced
    w = Window.orderBy(F.col("priority"), F.col("_group"), F.col("_order"))
    return (allf.withColumn("finding_order", F.row_number().over(w))
            .withColumn("evidence_count", F.size("evidence"))
            .drop("_group", "_order"))
