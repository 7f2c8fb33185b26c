"""Silver layer: typed, cleaned, whitelisted projections of the raw tables.

B1-B7 are one ``select`` each (no shuffle). Casts are ``try_cast`` against
a declared schema: a malformed value becomes NULL instead of failing the
whole job under ANSI mode, and ``quality.cast_failures`` counts them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampNTZType)

L, D, S, T, B, I = LongType(), DoubleType(), StringType(), TimestampNTZType(), BooleanType(), IntegerType()


def _schema(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


# Declared Silver schemas (column order is the contract).
SILVER_SCHEMAS = {
    "customers_clean": _schema(
        ("user_id", L), ("first_name", S), ("last_name", S), ("email", S), ("age", L),
        ("gender", S), ("state", S), ("street_address", S), ("postal_code", S), ("city", S),
        ("country", S), ("latitude", D), ("longitude", D), ("traffic_source", S), ("created_at", T)),
    "orders_clean": _schema(
        ("order_id", L), ("user_id", L), ("status", S), ("created_at", T), ("shipped_at", T),
        ("delivered_at", T), ("returned_at", T), ("num_of_item", L), ("days_to_ship", I),
        ("days_to_deliver", I)),
    "order_items_clean": _schema(
        ("order_item_id", L), ("order_id", L), ("user_id", L), ("product_id", L),
        ("inventory_item_id", L), ("status", S), ("created_at", T), ("shipped_at", T),
        ("delivered_at", T), ("returned_at", T), ("sale_price", D), ("is_returned", B)),
    "products_clean": _schema(
        ("product_id", L), ("cost", D), ("category", S), ("name", S), ("brand", S),
        ("retail_price", D), ("department", S), ("sku", S), ("distribution_center_id", L),
        ("base_margin", D)),
    "inventory_clean": _schema(
        ("inventory_item_id", L), ("product_id", L), ("created_at", T), ("sold_at", T),
        ("cost", D), ("is_sold", B), ("days_to_sell", I)),
    "events_clean": _schema(
        ("event_id", L), ("user_id", L), ("sequence_number", L), ("session_id", S),
        ("created_at", T), ("city", S), ("state", S), ("postal_code", S), ("browser", S),
        ("traffic_source", S), ("uri", S), ("event_type", S), ("is_anonymous", B)),
    "distribution_centers_clean": _schema(
        ("distribution_center_id", L), ("name", S), ("latitude", D), ("longitude", D)),
}

# The sentinel string and the country spelling fix.
NULL_SENTINEL = "null"
COUNTRY_FIXES = {"Brasil": "Brazil"}


def null_sentinel(col: str | Column, sentinel: str = NULL_SENTINEL) -> Column:
    """The string 'null' becomes SQL NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(col, F.lit(sentinel))


def standardize(col: str | Column, mapping: dict[str, str] = COUNTRY_FIXES) -> Column:
    """Value standardisation through a small literal mapping."""
    col = F.col(col) if isinstance(col, str) else col
    out = col
    for src, dst in mapping.items():
        out = F.when(col == src, F.lit(dst)).otherwise(out)
    return out


#: Columns that a builder hands through where its input has them (see ``quarantine``).
CARRIED = ("_uncast", "_source_row")


def conform(df: DataFrame, schema: StructType, exprs: dict[str, Column] | None = None) -> DataFrame:
    """Select exactly ``schema``'s columns, each try_cast to its declared type;
    ``exprs`` supplies derived/renamed columns by target name."""
    exprs = exprs or {}
    cols = []
    for f in schema.fields:
        e = exprs.get(f.name, F.col(f.name))
        cols.append(e.try_cast(f.dataType).alias(f.name))
    return df.select(*cols, *[c for c in CARRIED if c in df.columns])


def clean_customers(users: DataFrame) -> DataFrame:
    """B1."""
    return conform(users, SILVER_SCHEMAS["customers_clean"], {
        "user_id": F.col("id"),
        "city": null_sentinel("city"),
        "country": standardize("country"),
    })


def clean_orders(orders: DataFrame) -> DataFrame:
    """B2: + days_to_ship, days_to_deliver."""
    return conform(orders, SILVER_SCHEMAS["orders_clean"], {
        "days_to_ship": F.datediff(F.col("shipped_at"), F.col("created_at")),
        "days_to_deliver": F.datediff(F.col("delivered_at"), F.col("created_at")),
    })


def clean_order_items(items: DataFrame, returned_status: str = "Returned") -> DataFrame:
    """+ is_returned."""
    return conform(items, SILVER_SCHEMAS["order_items_clean"], {
        "order_item_id": F.col("id"),
        "is_returned": F.col("status") == returned_status,
    })


def clean_products(products: DataFrame) -> DataFrame:
    """+ base_margin."""
    return conform(products, SILVER_SCHEMAS["products_clean"], {
        "product_id": F.col("id"),
        "base_margin": F.round(F.col("retail_price") - F.col("cost"), 2),
    })


def clean_inventory(inventory: DataFrame) -> DataFrame:
    """+ is_sold, days_to_sell; the denormalised product_* copies are dropped."""
    return conform(inventory, SILVER_SCHEMAS["inventory_clean"], {
        "inventory_item_id": F.col("id"),
        "is_sold": F.col("sold_at").isNotNull(),
        "days_to_sell": F.datediff(F.col("sold_at"), F.col("created_at")),
    })


def clean_events(events: DataFrame) -> DataFrame:
    """+ is_anonymous; ip_address (PII) is not selected."""
    return conform(events, SILVER_SCHEMAS["events_clean"], {
        "event_id": F.col("id"),
        "is_anonymous": F.col("user_id").isNull(),
    })


def clean_distribution_centers(dcs: DataFrame) -> DataFrame:
    """B7."""
    return conform(dcs, SILVER_SCHEMAS["distribution_centers_clean"], {
        "distribution_center_id": F.col("id"),
    })


SILVER_BUILDERS = {
    "customers_clean": ("users", clean_customers),
    "orders_clean": ("orders", clean_orders),
    "order_items_clean": ("order_items", clean_order_items),
    "products_clean": ("products", clean_products),
    "inventory_clean": ("inventory_items", clean_inventory),
    "events_clean": ("events", clean_events),
    "distribution_centers_clean": ("distribution_centers", clean_distribution_centers),
}


def build(name: str, raw: Mapping[str, DataFrame]) -> DataFrame:
    """One Silver table from the raw (or bronze) tables."""
    source, make = SILVER_BUILDERS[name]
    return make(raw[source] if source in raw else raw[f"{source}_raw"])


def silver_layer(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All seven Silver tables from the raw (or bronze) tables."""
    return {name: build(name, raw) for name in SILVER_BUILDERS}
