"""Paths, row helpers and hand-written Silver rows shared by the tests."""

from datetime import datetime as dt

from martflow.operators.silver import SILVER_SCHEMAS

SF_SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Rows as sorted list of tuples (optionally projected)."""
    d = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in d.collect())


def silver_df(spark, name, rows):
    schema = SILVER_SCHEMAS[name]
    cols = [f.name for f in schema.fields]
    data = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(data, schema)


def ts(s):
    return dt.fromisoformat(s)


def small_silver(spark, customers=(), orders=(), items=(), products=(), inventory=(), events=(), dcs=()):
    return {
        "customers_clean": silver_df(spark, "customers_clean", customers),
        "orders_clean": silver_df(spark, "orders_clean", orders),
        "order_items_clean": silver_df(spark, "order_items_clean", items),
        "products_clean": silver_df(spark, "products_clean", products),
        "inventory_clean": silver_df(spark, "inventory_clean", inventory),
        "events_clean": silver_df(spark, "events_clean", events),
        "distribution_centers_clean": silver_df(spark, "distribution_centers_clean", dcs),
    }
