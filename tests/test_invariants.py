"""Invariants on the driver tables and the T25 cast check."""

from pyspark.sql import functions as F


def test_layer_counts_and_sums(pipe):
    s, g = pipe.silver, pipe.gold
    assert g["customer_360"].count() == s["customers_clean"].count()
    assert g["product_performance"].count() == s["products_clean"].count()
    assert g["inventory_health"].count() <= s["products_clean"].count()
    for raw, clean in [("orders", "orders_clean"), ("order_items", "order_items_clean"),
                       ("events", "events_clean")]:
        assert pipe.raw[raw].count() == s[clean].count()
    # revenue over centres x months = revenue over all items (cancelled included)
    fm = g["fulfillment_metrics"].agg(F.sum(F.round(F.col("total_revenue") * 100).cast("long"))).first()[0]
    it = s["order_items_clean"].agg(F.sum(F.round(F.col("sale_price") * 100).cast("long"))).first()[0]
    assert fm == it


def test_no_feature_row_reads_past_the_cutoff(pipe):
    from martflow.operators import quality as q
    assert all(r.passed for r in q.temporal_integrity(pipe.features.stamped).collect())


def test_signal_periods_are_two_distinct_months(pipe):
    from martflow.operators.signals import periods_table
    r = periods_table(pipe.g("fulfillment_metrics"), pipe.cfg).first()
    assert r.prior_period < r.current_period


def test_cast_failures_count_malformed_values(spark):
    from martflow.operators import quality as q
    from martflow.operators.silver import SILVER_SCHEMAS, clean_customers
    raw = spark.createDataFrame([("1", "x", "41"), ("2", "y", "forty"), ("z", "w", None)],
                                "id string, first_name string, age string")
    got = {r.column: r.cast_failures for r in
           q.cast_failures(raw, "customers_clean", SILVER_SCHEMAS["customers_clean"], {"user_id": "id"}).collect()}
    assert got == {"user_id": 1, "first_name": 0, "age": 1}
