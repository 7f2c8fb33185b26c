"""Adapter: the driver's TPC-H-shaped tables -> the seven raw retail tables.

The retail pipeline reads ``users, orders, order_items, products,
inventory_items, distribution_centers, events``. The test data instead has
``customer, orders, lineitem, part, supplier, nation, events``. The adapter
is a set of lazy projections and joins; the DuckDB oracle repeats the same
expressions (see ``martflow.oracle.prelude``) so both sides see identical
inputs.

Scale notes: the only shuffles are on ``l_orderkey`` (line numbering and
the item-count per order, which share one partitioning) and the joins to
``orders`` / ``part``; ``nation`` (25 rows, fixed by the schema) is the only
explicit broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martflow.config import FIXTURE_EVENT_SHIFT_DAYS
from martflow.functions.exprs import add_days, ntz
from martflow.sources.io import read_source

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")

def _null(t: str):
    return F.lit(None).cast(t)


@dataclass
class DriverTables:
    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return read_source(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def _retail_cents(price):
    return F.round(price * 100).cast("long")


def _centers(t: DriverTables):
    """Number of centres: every supplier is one (keys count from 0)."""
    return t.supplier.select(F.max("s_suppkey") + 1).scalar()


def product_cost_cents(partkey, retail_cents):
    """Cost = retail x (0.40, 0.50, 0.60, 0.70, 0.80 by partkey % 5), half-up to the cent."""
    pct = F.lit(40) + (partkey % 5) * 10
    return F.floor((retail_cents * pct * 2 + 100) / 200).cast("long")


def bronze_users(t: DriverTables) -> DataFrame:
    nation = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    cu = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    k = F.col("c_custkey")
    return cu.select(
        k.alias("id"),
        F.col("c_name").alias("first_name"),
        F.concat(F.lit("n"), k.cast("string")).alias("last_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        (F.lit(12) + k % 59).cast("long").alias("age"),
        F.when(k % 2 == 0, "M").otherwise("F").alias("gender"),
        F.concat(F.lit("S"), (k % 7).cast("string")).alias("state"),
        _null("string").alias("street_address"),
        _null("string").alias("postal_code"),
        F.when(k % 100 == 0, F.lit("null"))
         .otherwise(F.concat(F.lit("City"), (k % 40).cast("string"))).alias("city"),
        F.when(F.col("c_nationkey") == 2, F.lit("Brasil")).otherwise(F.col("n_name")).alias("country"),
        _null("double").alias("latitude"),
        _null("double").alias("longitude"),
        F.col("c_mktsegment").alias("traffic_source"),
        add_days(ntz("1994-06-01"), k % 180).alias("created_at"),
        _null("string").alias("user_geom"),
    )


def _order_status():
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    return (F.when((s == "P") & (k % 2 == 1), "Cancelled")
             .when(s == "P", "Processing")
             .when(s == "O", "Shipped")
             .when((s == "F") & (k % 5 == 0), "Returned")
             .when(s == "F", "Complete"))


def _orders_with_status(t: DriverTables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate",
                           _order_status().alias("order_status"))


def bronze_orders(t: DriverTables) -> DataFrame:
    items_per_order = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("num_of_item"))
    o = _orders_with_status(t).join(
        items_per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k, st, created = F.col("o_orderkey"), F.col("order_status"), F.col("o_orderdate")
    shipped = F.when(~st.isin("Processing", "Cancelled"), add_days(created, k % 3))
    delivered = F.when(st.isin("Complete", "Returned"), add_days(created, k % 3 + k % 4 + 1))
    return o.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        st.alias("status"),
        F.when(k % 2 == 0, "M").otherwise("F").alias("gender"),
        created.alias("created_at"),
        F.when(st == "Returned", add_days(delivered, 3)).alias("returned_at"),
        shipped.alias("shipped_at"),
        delivered.alias("delivered_at"),
        F.coalesce(F.col("num_of_item"), F.lit(0)).cast("long").alias("num_of_item"),
    )


def enriched_lines(t: DriverTables) -> DataFrame:
    """lineitem numbered per order and joined to its order and part."""
    li = t.lineitem
    order_cols = ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                  "l_linestatus", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*order_cols)
    li = li.withColumn("seq", F.row_number().over(w))
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    lines = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "seq")
    return (lines.join(_orders_with_status(t), F.col("l_orderkey") == F.col("o_orderkey"))
              .join(part, F.col("l_partkey") == F.col("p_partkey")).drop("o_orderkey", "p_partkey"))


def bronze_order_items(t: DriverTables, lines: DataFrame | None = None) -> DataFrame:
    e = enriched_lines(t) if lines is None else lines
    ost = F.col("order_status")
    created = add_days(F.col("o_orderdate"), F.col("l_orderkey") % 5)
    status = (F.when(ost == "Cancelled", "Cancelled")
               .when(F.col("l_returnflag") == "R", "Returned").otherwise(ost))
    supp3 = F.col("l_suppkey") % 3
    delivered = F.when(ost.isin("Complete", "Returned")
                       | ((ost == "Shipped") & (F.col("l_linestatus") == "F")),
                       add_days(created, supp3 + F.col("l_partkey") % 7))
    retail_c = _retail_cents(F.col("p_retailprice"))
    disc_pct = F.round(F.col("l_discount") * 100).cast("long")
    sale_c = F.floor((retail_c * (F.lit(100) - disc_pct) * 2 + 100) / 200)
    return e.select(
        (F.col("l_orderkey") * 1000 + F.col("seq")).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        (F.col("l_orderkey") * 1000 + F.col("seq")).alias("inventory_item_id"),
        status.alias("status"),
        created.alias("created_at"),
        F.when(~ost.isin("Processing", "Cancelled"), add_days(created, supp3)).alias("shipped_at"),
        delivered.alias("delivered_at"),
        F.when((status == "Returned") & delivered.isNotNull(), add_days(delivered, 3)).alias("returned_at"),
        (sale_c / F.lit(100.0)).alias("sale_price"),
    )


def bronze_products(t: DriverTables) -> DataFrame:
    p = t.part
    k = F.col("p_partkey")
    cost_c = product_cost_cents(k, _retail_cents(F.col("p_retailprice")))
    return p.select(
        k.alias("id"),
        (cost_c / F.lit(100.0)).alias("cost"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("retail_price"),
        F.when(k % 2 == 0, "Men").otherwise("Women").alias("department"),
        F.concat(F.lit("SKU-"), k.cast("string")).alias("sku"),
        (k % _centers(t)).alias("distribution_center_id"),
    )


def bronze_inventory_items(t: DriverTables, lines: DataFrame | None = None) -> DataFrame:
    e = enriched_lines(t) if lines is None else lines
    k = F.col("l_partkey")
    cost_c = product_cost_cents(k, _retail_cents(F.col("p_retailprice")))
    sold = F.when((F.col("l_orderkey") + k) % 20 == 0, _null("timestamp_ntz")).otherwise(
        add_days(F.col("o_orderdate"), F.col("l_quantity")))
    return e.select(
        (F.col("l_orderkey") * 1000 + F.col("seq")).alias("id"),
        k.alias("product_id"),
        F.col("o_orderdate").alias("created_at"),
        sold.alias("sold_at"),
        (cost_c / F.lit(100.0)).alias("cost"),
        F.col("p_type").alias("product_category"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("product_brand"),
        F.col("p_retailprice").alias("product_retail_price"),
        F.when(k % 2 == 0, "Men").otherwise("Women").alias("product_department"),
        F.concat(F.lit("SKU-"), k.cast("string")).alias("product_sku"),
        (k % _centers(t)).alias("product_distribution_center_id"),
    )


def bronze_distribution_centers(t: DriverTables) -> DataFrame:
    return (t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                              _null("double").alias("latitude"), _null("double").alias("longitude")))


def _event_type():
    et, k = F.col("event_type"), F.col("event_id")
    signup = F.when(k % 4 == 0, "home").when(k % 4 == 1, "department").otherwise("cart")
    return (F.when(et == "view", "product").when(et == "purchase", "purchase")
             .when(et == "error", "cancel").when(et == "click", "cart")
             .when(et == "signup", signup))


def bronze_events(t: DriverTables, shift_days: int = FIXTURE_EVENT_SHIFT_DAYS) -> DataFrame:
    ev = t.events
    u = F.col("user_id")
    return ev.select(
        F.col("event_id").alias("id"),
        F.when(u % 15 == 0, _null("long")).otherwise(u).alias("user_id"),
        _null("long").alias("sequence_number"),
        F.concat(u.cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        add_days(F.col("ts"), -shift_days).alias("created_at"),
        F.concat(F.lit("10.0."), (u % 256).cast("string"), F.lit("."),
                 (F.col("event_id") % 256).cast("string")).alias("ip_address"),
        _null("string").alias("city"),
        _null("string").alias("state"),
        _null("string").alias("postal_code"),
        _null("string").alias("browser"),
        _null("string").alias("traffic_source"),
        _null("string").alias("uri"),
        _event_type().alias("event_type"),
    )


BRONZE_BUILDERS = {
    "users": bronze_users,
    "orders": bronze_orders,
    "order_items": bronze_order_items,
    "products": bronze_products,
    "inventory_items": bronze_inventory_items,
    "distribution_centers": bronze_distribution_centers,
    "events": bronze_events,
}


def raw_tables(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """The seven raw retail tables derived (lazily) from the driver tables.
    ``lines`` are written enriched lines, shared by the two tables that need them."""
    t = DriverTables(spark, sf_dir)
    shared = {} if lines is None else {"lines": lines}
    return {name: build(t, **(shared if name in ("order_items", "inventory_items") else {}))
            for name, build in BRONZE_BUILDERS.items()}
