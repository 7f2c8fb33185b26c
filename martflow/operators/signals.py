"""KPI signals (H1-H11, H16, H17) over the Gold tables and predictions.

The eight signals are a small long-form table
``(metric, domain, current_value, prior_value, delta_pct, direction,
severity, context)``. Period values come from one conditional aggregate per
source table (fulfillment, funnel, inventory, predictions) instead of one
query per metric; the classifier is column expressions.

Averages of 1- and 4-decimal Gold columns are summed in integer units, so
they do not depend on task order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow.config import DEFAULT, Config
from martflow.functions.exprs import cents


# ----------------------------------------------------------------- H1
def periods(fulfillment: DataFrame, cfg: Config = DEFAULT) -> tuple[Column, Column]:
    """Current and prior period as scalar-subquery columns: the latest two
    months in ``fulfillment_metrics`` (or ``signal_as_of`` and the month
    before it that exists). Prior is NULL when fewer than two periods exist."""
    months = fulfillment.select("order_month")
    if cfg.signal_as_of:
        cur = F.to_timestamp_ntz(F.lit(cfg.signal_as_of))
    else:
        cur = months.select(F.max("order_month")).scalar()
    prior = months.filter(F.col("order_month") < cur).select(F.max("order_month")).scalar()
    return cur, prior


def periods_table(fulfillment: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """H1 as a table: one row (current_period, prior_period), none when < 2 periods."""
    cur, prior = periods(fulfillment, cfg)
    return (fulfillment.agg(F.count(F.lit(1)).alias("_n"))
            .select(cur.alias("current_period"), prior.alias("prior_period"))
            .filter(F.col("prior_period").isNotNull() & F.col("current_period").isNotNull()))


# ----------------------------------------------------------------- H2
def _pct1(x: Column) -> Column:
    """Python's '{:+.1%}' style: sign, one decimal, percent sign."""
    return F.concat(F.when(x >= 0, "+").otherwise(""),
                    F.regexp_replace(F.format_number(x * 100, 1), ",", ""), F.lit("%"))


def classify(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Delta, direction (+-flat band) and direction-aware severity for
    month-over-month rows; point-in-time rows (dead stock, churn) keep the
    values their builders set."""
    cur, prior = F.col("current_value"), F.col("prior_value")
    delta = F.when(prior == 0, F.lit(0.0)).otherwise((cur - prior) / F.abs(prior))
    direction = (F.when(F.col("delta_pct") > cfg.flat_band, "up")
                  .when(F.col("delta_pct") < -cfg.flat_band, "down").otherwise("flat"))
    a = F.abs(F.col("delta_pct"))
    severity = (F.when(a >= cfg.critical_threshold,
                       F.when(F.col("direction") == "down", "critical").otherwise("notable"))
                 .when(a >= cfg.warning_threshold, "warning").otherwise("normal"))
    mom = F.col("kind") == "mom"
    out = df.withColumn("delta_pct", F.when(mom, delta).otherwise(F.col("delta_pct")))
    out = out.withColumn("direction", F.when(mom, direction).otherwise(F.col("direction")))
    out = out.withColumn("severity", F.when(mom, severity).otherwise(F.col("severity")))
    ctx = F.concat(F.col("metric"), F.lit(": "), F.format_number(cur, 2), F.lit(" (was "),
                   F.format_number(prior, 2), F.lit("), "), _pct1(F.col("delta_pct")),
                   F.lit(" "), F.col("direction"))
    return out.withColumn("context", F.when(mom, ctx).otherwise(F.col("context")))


def _row(metric: str, domain: str, cur: Column, prior: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), F.lit(domain).alias("domain"),
                    F.coalesce(cur.cast("double"), F.lit(0.0)).alias("current_value"),
                    F.coalesce(prior.cast("double"), F.lit(0.0)).alias("prior_value"))


def _avg_units(col: str, month: str, period: Column, scale: int) -> Column:
    """Exact average of a column stored with ``log10(scale)`` decimals."""
    sel = F.when(F.col(month) == period, F.round(F.col(col) * scale).cast("long"))
    return F.sum(sel) / F.count(sel) / F.lit(float(scale))


# ----------------------------------------------------------------- H3-H10
def signal_values(fulfillment: DataFrame, funnel: DataFrame, inventory: DataFrame,
                  predictions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Raw (metric, domain, current_value, prior_value, kind, ...) rows."""
    cur, prior = periods(fulfillment, cfg)
    m = "order_month"
    f = fulfillment.agg(F.array(
        _row("Total Revenue", "revenue",                                       # H3
             F.sum(F.when(F.col(m) == cur, cents("total_revenue"))) / 100.0,
             F.sum(F.when(F.col(m) == prior, cents("total_revenue"))) / 100.0),
        _row("Orders Fulfilled", "revenue",                                    # H4
             F.sum(F.when(F.col(m) == cur, F.col("orders_fulfilled"))),
             F.sum(F.when(F.col(m) == prior, F.col("orders_fulfilled")))),
        _row("Avg Delivery Days", "fulfillment",                              # H7
             _avg_units("avg_delivery_days", m, cur, 10), _avg_units("avg_delivery_days", m, prior, 10)),
        _row("On-Time Delivery Rate", "fulfillment",                          # H8
             _avg_units("on_time_rate", m, cur, 10000), _avg_units("on_time_rate", m, prior, 10000)),
    ).alias("rows"))
    e = "event_month"
    u = funnel.agg(F.array(
        _row("Active Users", "customers",                                     # H5
             F.count_distinct(F.when(F.col(e) == cur, F.col("user_id"))),
             F.count_distinct(F.when(F.col(e) == prior, F.col("user_id")))),
        _row("Avg Conversion Rate", "conversion",                             # H6
             _avg_units("session_to_purchase_rate", e, cur, 10000),
             _avg_units("session_to_purchase_rate", e, prior, 10000)),
    ).alias("rows"))
    mom = (f.unionByName(u).select(F.explode("rows").alias("r")).select("r.*")
           .withColumns({"kind": F.lit("mom"), "delta_pct": F.lit(None).cast("double"),
                         "direction": F.lit(None).cast("string"),
                         "severity": F.lit(None).cast("string"),
                         "context": F.lit(None).cast("string")}))
    # H9: dead-stock rate, point in time
    dead = inventory.agg(
        (F.sum(F.col("is_dead_stock").cast("long")) / F.count(F.lit(1))).alias("rate"),
        F.count(F.lit(1)).alias("n"))
    dead = dead.select(
        F.lit("Dead Stock Rate").alias("metric"), F.lit("inventory").alias("domain"),
        F.coalesce(F.col("rate"), F.lit(0.0)).alias("current_value"), F.lit(0.0).alias("prior_value"),
        F.lit("point").alias("kind"), F.lit(0.0).alias("delta_pct"), F.lit("flat").alias("direction"),
        F.when(F.coalesce(F.col("rate"), F.lit(0.0)) < cfg.dead_stock_warning_rate, "info")
         .otherwise("warning").alias("severity"),
        F.concat(F.lit("Dead stock rate: "), F.format_number(F.coalesce(F.col("rate"), F.lit(0.0)) * 100, 1),
                 F.lit("% across "), F.format_number(F.col("n"), 0), F.lit(" products")).alias("context"))
    # Churn risk of the scored batch (high-risk count / total / share)
    p = predictions.agg(F.avg("churn_probability").alias("avg_prob"),
                        F.sum((F.col("churn_probability") > cfg.churn_high_risk).cast("long")).alias("hi"),
                        F.count(F.lit(1)).alias("n"))
    share = F.coalesce(F.col("hi"), F.lit(0)) / F.greatest(F.col("n"), F.lit(1))
    churn = p.select(
        F.lit("Churn Risk (Inference Batch)").alias("metric"), F.lit("churn").alias("domain"),
        F.coalesce(F.col("hi"), F.lit(0)).cast("double").alias("current_value"),
        F.col("n").cast("double").alias("prior_value"), F.lit("point").alias("kind"),
        share.alias("delta_pct"),
        F.when(share > cfg.churn_warning_share, "up").otherwise("flat").alias("direction"),
        F.when(share > cfg.churn_warning_share, "warning").otherwise("normal").alias("severity"),
        F.concat(F.lit("Churn risk: "), F.coalesce(F.col("hi"), F.lit(0)).cast("string"), F.lit(" of "),
                 F.col("n").cast("string"), F.lit(" customers high-risk (prob > "),
                 F.lit(str(cfg.churn_high_risk)), F.lit("), avg prob "),
                 F.format_number(F.coalesce(F.col("avg_prob"), F.lit(0.0)), 3)).alias("context"))
    out = mom.unionByName(dead).unionByName(churn)
    # no signals at all when fewer than two periods exist (H1)
    return out.filter(prior.isNotNull())


# The eight signal names in the reference's order.
SIGNAL_ORDER = ["Total Revenue", "Orders Fulfilled", "Active Users", "Avg Conversion Rate",
                "Avg Delivery Days", "On-Time Delivery Rate", "Dead Stock Rate",
                "Churn Risk (Inference Batch)"]


def kpi_signals(gold: dict[str, DataFrame], predictions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All eight signals, classified, with their display order."""
    raw = signal_values(gold["fulfillment_metrics"], gold["funnel_analytics"],
                        gold["inventory_health"], predictions, cfg)
    order = F.array_position(F.array(*[F.lit(s) for s in SIGNAL_ORDER]), F.col("metric")).cast("int")
    return classify(raw, cfg).withColumn("signal_order", order).drop("kind")


# ----------------------------------------------------------------- H16, H17
def signal_status(severity: Column, direction: Column) -> Column:
    """H16 per KPI: Declining / Strong Growth / Notable Change / Watch / Stable."""
    return (F.when(severity == "critical", "Declining")
             .when(severity == "notable",
                   F.when(direction == "up", "Strong Growth").otherwise("Notable Change"))
             .when(severity == "warning", "Watch").otherwise("Stable"))


def scoreboard_status(signals: DataFrame, monitoring: DataFrame, findings: DataFrame,
                      ops_on_time_floor: float = 0.95) -> DataFrame:
    """(item, status) for every KPI plus the business, operations and model rows.

    Business: At Risk with a critical P1 finding, else Healthy.

    Operations: Degrading when delivery days is critical / warning, Stable
    when the on-time rate is >= 0.95, else Watch. Model: Degraded when both
    prediction drift and degradation, Attention Required for either one."""
    kpis = signals.select(F.col("metric").alias("item"),
                          signal_status(F.col("severity"), F.col("direction")).alias("status"))
    s = signals.agg(
        F.max(F.when((F.col("metric") == "Avg Delivery Days")
                     & F.col("severity").isin("critical", "warning"), 1)).alias("_deg"),
        F.max(F.when(F.col("metric") == "On-Time Delivery Rate", F.col("current_value"))).alias("_ot"))
    ops = s.select(F.lit("Operations").alias("item"),
                   F.when(F.col("_deg") == 1, "Degrading")
                    .when(F.col("_ot") >= ops_on_time_floor, "Stable").otherwise("Watch").alias("status"))
    pd_, md = F.col("prediction_drift_detected"), F.col("model_degraded")
    model = monitoring.select(F.lit("Model").alias("item"),
                              F.when(pd_ & md, "Degraded").when(pd_ | md, "Attention Required")
                               .otherwise("Healthy").alias("status"))
    at_risk = (F.col("severity") == "critical") & (F.col("priority") == "P1")
    business = findings.agg(F.count(F.when(at_risk, 1)).alias("_n")).select(
        F.lit("Business").alias("item"), F.when(F.col("_n") > 0, "At Risk").otherwise("Healthy").alias("status"))
    return kpis.unionByName(business).unionByName(ops).unionByName(model)


def evidence_strength(confidence: Column) -> Column:
    """Strong >= 0.8, Moderate >= 0.6, else Limited."""
    return F.when(confidence >= 0.8, "Strong").when(confidence >= 0.6, "Moderate").otherwise("Limited")
