"""Partially aggregated facts that Gold tables and features roll up from.

A fact has one row per pair that would otherwise need a distinct count: a
customer's purchases of a product, a customer's baskets (orders with items), a visitor's
sessions (per month), an order's lines per centre and month. Rolling up then counts rows,
so no plan multiplies its input for several distinct counts (Expand), and
the same fact serves the customer, product, month and cutoff side. ``keys`` names
what a fact is kept per besides its own pair, e.g. (cutoff, user_id).

NULL ids form a group like any other and are not counted as a product, order or session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martflow.config import DEFAULT, Config
from martflow.functions.exprs import cents, count_if, month_start

#: event type -> column, in funnel order
EVENT_COLUMNS = {"home": "home_events", "department": "department_events", "product": "product_view_events",
                 "cart": "cart_events", "purchase": "purchase_events", "cancel": "cancel_events"}
CUSTOMER = ("user_id",)


def kept(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows of orders or items that were not cancelled."""
    return df.filter(F.col("status") != cfg.excluded_status)


def known_visitors(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("is_anonymous"))


# ---------------------------------------------------------------- facts
def purchases(lines: DataFrame, keys=CUSTOMER) -> DataFrame:
    """One row per key and product."""
    at = F.col("created_at")
    return lines.groupBy(*keys, "product_id").agg(
        F.count("order_item_id").alias("units"), F.count("sale_price").alias("priced"),
        F.sum(cents("sale_price")).alias("cents"), count_if(F.col("is_returned")).alias("returned"),
        F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def baskets(lines: DataFrame, keys=CUSTOMER) -> DataFrame:
    """One row per key and order that has items."""
    return lines.groupBy(*keys, "order_id").agg(F.count("order_item_id").alias("units"))


def sessions(events: DataFrame, keys=CUSTOMER) -> DataFrame:
    """One row per key and session."""
    at = F.col("created_at")
    return events.groupBy(*keys, "session_id").agg(
        F.count("event_id").alias("events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
        *[count_if(F.col("event_type") == kind).alias(name) for kind, name in EVENT_COLUMNS.items()])


def session_months(events: DataFrame) -> DataFrame:
    """Sessions per month of their events; a session over a month's end has two rows."""
    return sessions(known_visitors(events).withColumn("event_month", month_start("created_at")), ("user_id", "event_month"))


def whole_sessions(parts: DataFrame, keys=CUSTOMER) -> DataFrame:
    """Parts of sessions (by month) put together."""
    return parts.groupBy(*keys, "session_id").agg(
        F.sum("events").alias("events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        *[F.sum(name).alias(name) for name in EVENT_COLUMNS.values()])


def stock(inventory: DataFrame) -> DataFrame:
    """One row per product: units received and sold, days to sell, unit costs, dates."""
    out = F.col("is_sold")
    days = F.when(out, F.col("days_to_sell"))
    return inventory.groupBy("product_id").agg(
        F.count("inventory_item_id").alias("received"), count_if(out).alias("sold"), count_if(~out).alias("left"),
        F.sum(days).alias("sell_days"), F.count(days).alias("sell_n"),
        F.sum(cents("cost")).alias("cost_cents"), F.count("cost").alias("cost_n"),
        F.max(F.when(out, F.col("sold_at"))).alias("last_sold_at"),
        F.min(F.when(~out, F.col("created_at"))).alias("oldest_left_at"))


def shipments(lines: DataFrame, by: list[str], sla_days: int) -> DataFrame:
    """One row per group and order (cancelled items are kept, T7)."""
    waited, shipped = F.datediff("delivered_at", "created_at"), F.datediff("shipped_at", "created_at")
    return lines.groupBy(*by, "order_id").agg(
        F.count("order_item_id").alias("units"), F.count("delivered_at").alias("delivered"),
        count_if(waited <= sla_days).alias("on_time"), F.sum(waited).alias("wait_days"),
        F.sum(shipped).alias("ship_days"), F.count(shipped).alias("ship_n"),
        count_if(F.col("is_returned")).alias("returned"), F.sum(cents("sale_price")).alias("cents"))


# ---------------------------------------------------------------- roll-ups
def buying(bought: DataFrame, by=CUSTOMER) -> DataFrame:
    """Totals of purchases per customer (``products`` of them)."""
    return bought.groupBy(*by).agg(
        F.sum("units").alias("units"), F.sum("cents").alias("cents"), F.sum("priced").alias("priced"),
        F.sum("returned").alias("returned"), F.count("product_id").alias("products"))


def browsing(visits: DataFrame, recent, by=CUSTOMER) -> DataFrame:
    """Totals of sessions per customer; a session is recent when its last event is
    (``recent`` of its time)."""
    return visits.groupBy(*by).agg(
        F.count("session_id").alias("sessions"), F.sum("events").alias("events"), F.max("last_at").alias("last_at"),
        F.count(F.when(recent(F.col("last_at")), F.col("session_id"))).alias("recent_sessions"),
        *[F.sum(name).alias(name) for name in EVENT_COLUMNS.values()])


def favourite(bought: DataFrame, products: DataFrame, by=CUSTOMER, out: str = "favorite_category") -> DataFrame:
    """Category with the highest revenue; ties go to the smallest name. A ``min_by``
    aggregate over (-revenue, category), combined before the shuffle."""
    per_category = (bought.join(products.select("product_id", "category"), "product_id")
                    .groupBy(*by, "category").agg(F.sum("cents").alias("cents")))
    best = F.struct((-F.col("cents")).alias("r"), F.col("category").alias("c"))
    return per_category.groupBy(*by).agg(F.min_by("category", best).alias(out))


def median_wait(lines: DataFrame, by: list[str]) -> DataFrame:
    """Median of delivery days per group: least number of days that half of the delivered
    units do not exceed. Exact; a group's window holds a row per different number of days."""
    wait = F.datediff("delivered_at", "created_at").alias("wait")
    per_days = lines.where(F.col("delivered_at").isNotNull()).groupBy(*by, wait).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("wait"))
    return (per_days.withColumn("reached", 2 * upto >= F.sum("n").over(group)).where("reached")
            .groupBy(*by).agg(F.min("wait").alias("median_days")))


def discount(retail: Column, paid: Column) -> Column:
    return F.when(retail > 0, (retail - paid) / retail)


#: facts that several Gold tables read, by name: built from (Silver tables, configuration)
FACTS = {
    "purchases": lambda s, cfg: purchases(kept(s["order_items_clean"], cfg)),
    "session_months": lambda s, cfg: session_months(s["events_clean"]),
    "stock": lambda s, cfg: stock(s["inventory_clean"]),
}


def facts(s, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """All facts as plans, for use without a pipeline."""
    return {name: make(s, cfg) for name, make in FACTS.items()}
