"""Business-explorer queries (I1-I24) over the Gold tables and predictions.

Each function returns a DataFrame; "current month" is the newest
``order_month`` as a scalar subquery. Top-k results are ``orderBy + limit``
(planned as TakeOrderedAndProject: per-task top-k, then a merge) with a
deterministic tie-break. Percent columns derived from 4-decimal Gold rates
are computed from integer units so the rounding is exact.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martflow.config import DEFAULT, Config
from martflow.functions.exprs import cents, side_by_side
from martflow.functions.quantiles import interpolated_quantiles


# Action-level thresholds of the explorer sections.
CHURN_ORANGE_SHARE, CHURN_YELLOW_SHARE = 0.5, 0.3
RETURN_DEVIATION_YELLOW_PP = 0.2
REORDER_ORANGE_COUNT, DEAD_ORANGE_PCT, DEAD_YELLOW_PCT = 50, 15, 8


def _current_month(fm: DataFrame) -> Column:
    return fm.select(F.max("order_month")).scalar()


def _units(col: str | Column, scale: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * scale).cast("long")


def _avg_pct(col: str, digits: int) -> Column:
    """round(avg(rate) * 100, digits) for a 4-decimal rate, exactly."""
    u = _units(col, 10000)
    return F.round(F.sum(u) / (F.count(u) * 100), digits)


def _money_total(col: str) -> Column:
    return F.sum(cents(col)) / 100.0


# ----------------------------------------------------------------- revenue
def monthly_revenue(fm: DataFrame, months: int = 12) -> DataFrame:
    """Revenue per month, the latest ``months`` months."""
    return (fm.groupBy("order_month").agg(_money_total("total_revenue").alias("revenue"))
            .orderBy(F.desc("order_month")).limit(months))


def revenue_by_dc(fm: DataFrame) -> DataFrame:
    """Revenue per centre in the current month."""
    return (fm.filter(F.col("order_month") == _current_month(fm))
            .groupBy("distribution_center_name")
            .agg(_money_total("total_revenue").alias("revenue")))


def top_dcs(fm: DataFrame, n: int = 3) -> DataFrame:
    """Top-n centres by current-month revenue."""
    return revenue_by_dc(fm).orderBy(F.desc("revenue"), "distribution_center_name").limit(n)


# ----------------------------------------------------------------- churn
def churn_counts(pred: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """I4: scored customers, high-risk customers, high-risk share."""
    hi = (F.col("churn_probability") > cfg.churn_high_risk).cast("long")
    return (pred.agg(F.count(F.lit(1)).alias("total"), F.sum(hi).alias("high_risk"))
            .select("total", F.coalesce(F.col("high_risk"), F.lit(0)).alias("high_risk"))
            .withColumn("high_risk_pct", F.col("high_risk") / F.greatest(F.col("total"), F.lit(1))))


def churn_histogram(pred: DataFrame, bins: int = 30) -> DataFrame:
    """Fixed-width histogram of churn probability on [0, 1]."""
    b = F.least(F.floor(F.col("churn_probability") * bins), F.lit(bins - 1)).cast("int")
    return (pred.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("customers"))
            .withColumn("bin_start", F.col("bin") / F.lit(float(bins))))


def high_risk_by_source(pred: DataFrame, c360: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """High-risk customers per traffic source."""
    return (pred.filter(F.col("churn_probability") > cfg.churn_high_risk)
            .join(c360.select("user_id", "traffic_source"), "user_id")
            .groupBy("traffic_source").agg(F.count(F.lit(1)).alias("high_risk_customers")))


def source_segments(c360: DataFrame) -> DataFrame:
    """Buyers per traffic source with average orders, spend and return %."""
    b = c360.filter(F.col("order_count") > 0)
    return b.groupBy("traffic_source").agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.sum("order_count") / F.count("order_count"), 2).alias("avg_orders"),
        F.round(F.sum(cents("lifetime_spend")) / (F.count("lifetime_spend") * 100), 2).alias("avg_spend"),
        _avg_pct("return_rate", 2).alias("avg_return_rate_pct"))


def top_churn_source(pred: DataFrame, c360: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """I8: the traffic source with most high-risk customers."""
    return (high_risk_by_source(pred, c360, cfg)
            .orderBy(F.desc("high_risk_customers"), "traffic_source").limit(1))


# ----------------------------------------------------------------- products
def category_revenue(pp: DataFrame) -> DataFrame:
    return pp.groupBy("category").agg(_money_total("total_revenue").alias("revenue"))


def leading_category(pp: DataFrame) -> DataFrame:
    """I9."""
    return category_revenue(pp).orderBy(F.desc("revenue"), "category").limit(1)


def top_categories(pp: DataFrame, n: int = 10) -> DataFrame:
    """I10."""
    return category_revenue(pp).orderBy(F.desc("revenue"), "category").limit(n)


def bestseller_return_rates(pp: DataFrame, n: int = 10) -> DataFrame:
    """Return rate of the n best-selling categories, with the portfolio
    average and spread over those n rows (a window over the top-n result)."""
    top = (pp.filter(F.col("units_sold") > 0).groupBy("category")
           .agg(F.sum("units_sold").alias("units"), _avg_pct("return_rate", 2).alias("avg_return_rate_pct"))
           .orderBy(F.desc("units"), "category").limit(n))
    w = Window.partitionBy(F.lit(1))
    return top.withColumns({
        "portfolio_avg_pct": F.avg("avg_return_rate_pct").over(w),
        "spread_pp": F.max("avg_return_rate_pct").over(w) - F.min("avg_return_rate_pct").over(w)})


def top_products(pp: DataFrame, n: int = 15, department: str | None = None) -> DataFrame:
    """Top products by revenue, optionally for one department."""
    src = pp if department is None else pp.filter(F.col("department") == department)
    return (src.select("product_id", "name", "category", "brand", "units_sold",
                       F.round("total_revenue", 2).alias("total_revenue"),
                       F.round(_units("margin_pct", 10000) / 100, 1).alias("margin_pct"))
            .orderBy(F.desc_nulls_last("total_revenue"), "product_id").limit(n))


def return_outliers(pp: DataFrame, n: int = 3) -> DataFrame:
    """The n highest return-rate categories among the best sellers and
    their deviation from the portfolio average."""
    b = bestseller_return_rates(pp)
    return (b.orderBy(F.desc("avg_return_rate_pct"), "category").limit(n)
            .select("category", "avg_return_rate_pct", "portfolio_avg_pct",
                    (F.col("avg_return_rate_pct") - F.col("portfolio_avg_pct")).alias("deviation_pp")))


# ----------------------------------------------------------------- fulfillment
def delivery_by_dc(fm: DataFrame) -> DataFrame:
    """Average delivery days per centre, current month."""
    return (fm.filter(F.col("order_month") == _current_month(fm))
            .select("distribution_center_name", "avg_delivery_days"))


def on_time_by_dc(fm: DataFrame) -> DataFrame:
    """On-time table per centre, current month."""
    return (fm.filter(F.col("order_month") == _current_month(fm))
            .select("distribution_center_name",
                    F.round(_units("on_time_rate", 10000) / 100, 1).alias("on_time_rate_pct"),
                    "on_time_deliveries", "total_deliveries"))


def slowest_dc_days(fm: DataFrame) -> DataFrame:
    """I16: the slowest centre's average delivery days, current month."""
    return (fm.filter(F.col("order_month") == _current_month(fm))
            .agg(F.max("avg_delivery_days").alias("max_days")))


# ----------------------------------------------------------------- inventory
def inventory_totals(ih: DataFrame) -> DataFrame:
    """Tracked products, dead stock, reorder signals, dead %."""
    return (ih.agg(F.count(F.lit(1)).alias("total"),
                   F.sum(F.col("is_dead_stock").cast("long")).alias("dead"),
                   F.sum(F.col("reorder_signal").cast("long")).alias("reorder"))
            .withColumn("dead_pct", F.col("dead") / F.greatest(F.col("total"), F.lit(1)) * 100))


def dead_stock_by_category(ih: DataFrame, n: int = 10) -> DataFrame:
    """Dead-stock share per category, top n."""
    dead = F.sum(F.col("is_dead_stock").cast("long"))
    return (ih.groupBy("category")
            .agg(F.count(F.lit(1)).alias("total_products"), dead.alias("dead_stock"),
                 F.round(dead * 100 / F.count(F.lit(1)), 1).alias("dead_pct"))
            .orderBy(F.desc("dead_pct"), "category").limit(n))


def reorder_by_category(ih: DataFrame, n: int = 10) -> DataFrame:
    """Categories with reorder signals (HAVING > 0), top n."""
    r = F.sum(F.col("reorder_signal").cast("long"))
    return (ih.groupBy("category").agg(r.alias("reorder_count"), F.count(F.lit(1)).alias("total"))
            .filter(F.col("reorder_count") > 0)
            .orderBy(F.desc("reorder_count"), "category").limit(n))


def inventory_by_dc(ih: DataFrame) -> DataFrame:
    """Per-centre products, stock value, turnover, dead, reorder."""
    t = _units("turnover_rate", 10000)
    return ih.groupBy("distribution_center_name").agg(
        F.count(F.lit(1)).alias("products"),
        (F.sum(cents("stock_value")) / 100.0).alias("stock_value"),
        F.round(F.sum(t) / (F.count(t) * 10000), 3).alias("avg_turnover"),
        F.sum(F.col("is_dead_stock").cast("long")).alias("dead_stock"),
        F.sum(F.col("reorder_signal").cast("long")).alias("reorder_signals"))


def top_reorder_categories(ih: DataFrame, n: int = 2) -> DataFrame:
    """I21."""
    return (ih.groupBy("category").agg(F.sum(F.col("reorder_signal").cast("long")).alias("cnt"))
            .orderBy(F.desc("cnt"), "category").limit(n))


# ----------------------------------------------------------------- I22
def action_levels(signals: DataFrame, churn: DataFrame, outliers: DataFrame,
                  slowest: DataFrame, inv_totals: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(domain, level) green / yellow / orange for the five sections.

    Each input is a one-row (or tiny) aggregate; they are combined by union
    and one conditional aggregate, not by joins."""
    rev = signals.filter(F.col("metric") == "Total Revenue").select(
        F.lit("revenue").alias("domain"),
        F.when((F.col("severity") == "notable") & (F.col("direction") == "up"), "green")
         .when(F.col("severity") == "critical", "orange").otherwise("yellow").alias("level"))
    rev_default = signals.agg(F.count(F.when(F.col("metric") == "Total Revenue", 1)).alias("n")) \
        .filter(F.col("n") == 0).select(F.lit("revenue").alias("domain"), F.lit("yellow").alias("level"))
    ch = churn.select(F.lit("churn").alias("domain"),
                      F.when(F.col("high_risk_pct") >= CHURN_ORANGE_SHARE, "orange")
                       .when(F.col("high_risk_pct") >= CHURN_YELLOW_SHARE, "yellow").otherwise("green").alias("level"))
    prod = outliers.agg(F.coalesce(F.max("deviation_pp"), F.lit(0.0)).alias("d")).select(
        F.lit("products").alias("domain"),
        F.when(F.col("d") >= RETURN_DEVIATION_YELLOW_PP, "yellow").otherwise("green").alias("level"))
    md = F.coalesce(F.col("max_days"), F.lit(0.0))
    ful = slowest.select(F.lit("fulfillment").alias("domain"),
                         F.when(md >= cfg.explorer_sla_days, "orange")
                          .when(md >= cfg.explorer_sla_days - 1, "yellow").otherwise("green").alias("level"))
    inv = inv_totals.select(F.lit("inventory").alias("domain"),
                            F.when((F.col("reorder") >= REORDER_ORANGE_COUNT)
                                   | (F.col("dead_pct") >= DEAD_ORANGE_PCT), "orange")
                             .when((F.col("reorder") > 0) | (F.col("dead_pct") >= DEAD_YELLOW_PCT), "yellow")
                             .otherwise("green").alias("level"))
    return rev.unionByName(rev_default).unionByName(ch).unionByName(prod).unionByName(ful).unionByName(inv)


# ----------------------------------------------------------------- I23
def churn_statistics(pred: DataFrame) -> DataFrame:
    """Count, mean, interpolated median / p90, > 0.7 and > 0.9 counts."""
    p = F.col("churn_probability")
    rows = pred.agg(
        F.count(F.lit(1)).alias("total_customers"), F.avg(p).alias("avg_probability"),
        F.count(F.when(p > 0.7, 1)).alias("high_risk_count"),
        F.count(F.when(p > 0.9, 1)).alias("very_high_risk_count"))
    middle = interpolated_quantiles(pred, [], "churn_probability", {"median_probability": 0.5, "p90_probability": 0.9})
    return side_by_side(rows, middle)


# ----------------------------------------------------------------- I24
def run_sql(spark: SparkSession, query: str, cap: int = 10) -> dict:
    """Ad-hoc SQL on the registered views: at most ``cap`` rows to the
    driver plus the total row count; friendly messages for empty results
    and errors (the total is computed by Spark, not by collecting)."""
    try:
        df = spark.sql(query)
        rows = df.limit(cap).collect()
        if not rows:
            return {"message": "Query returned no results.", "rows": [], "total": 0}
        total = df.count()
        msg = f"(Showing top {cap} of {total} rows)" if total > cap else ""
        return {"message": msg, "rows": [r.asDict() for r in rows], "total": total,
                "columns": df.columns}
    except PySparkException:          # the contract is a message, not a raise
        return {"message": "Query could not be executed. Please try a simpler query.",
                "rows": [], "total": 0}
