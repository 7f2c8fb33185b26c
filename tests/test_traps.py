"""One test per semantic trap of the reference, on hand-written rows."""

from pyspark.sql import functions as F

from helpers import small_silver, ts
from martflow.config import DEFAULT
from martflow.operators import facts, features, gold, signals


def _item(i, user, order, product, price, status="Complete", created="2001-01-10"):
    return dict(order_item_id=i, order_id=order, user_id=user, product_id=product, status=status,
                created_at=ts(created), sale_price=price, is_returned=status == "Returned")


def test_t5_favourite_category_tie_breaks_on_name(spark):
    s = small_silver(spark,
                     items=[_item(1, 1, 10, 100, 50.0), _item(2, 1, 10, 200, 50.0)],
                     products=[dict(product_id=100, category="Shirts"), dict(product_id=200, category="Jeans")])
    fav = facts.favourite(facts.facts(s)["purchases"], s["products_clean"]).collect()
    assert [(r.user_id, r.favorite_category) for r in fav] == [(1, "Jeans")]


def test_t6_first_to_second_gap_with_equal_dates_is_zero(spark):
    o = [dict(order_id=i, user_id=1, status="Complete", created_at=ts(d))
         for i, d in [(1, "2001-01-01"), (2, "2001-01-01"), (3, "2001-02-01")]]
    o.append(dict(order_id=4, user_id=2, status="Complete", created_at=ts("2001-01-05")))
    s = small_silver(spark, orders=o)
    got = {r.user_id: r.first_to_second_order_days for r in gold.first_to_second_gap(facts.kept(s["orders_clean"])).collect()}
    assert got == {1: 0, 2: None}


def test_t7_fulfillment_keeps_cancelled_items(spark):
    s = small_silver(spark,
                     items=[_item(1, 1, 10, 100, 5.0, status="Cancelled"), _item(2, 1, 11, 100, 7.0)],
                     products=[dict(product_id=100, category="A", distribution_center_id=1, cost=1.0)],
                     dcs=[dict(distribution_center_id=1, name="DC1")])
    fm = gold.fulfillment_metrics(s).collect()
    assert fm[0].items_fulfilled == 2 and fm[0].total_revenue == 12.0


def test_t9_t10_turnover_null_when_no_stock_and_negative_days_since_sale(spark):
    inv = [dict(inventory_item_id=1, product_id=100, created_at=ts("2001-01-01"), sold_at=ts("2001-03-01"),
                cost=2.0, is_sold=True, days_to_sell=59),
           dict(inventory_item_id=2, product_id=200, created_at=ts("2001-02-01"), sold_at=None,
                cost=2.0, is_sold=False)]
    s = small_silver(spark, inventory=inv,
                     products=[dict(product_id=100, category="A", distribution_center_id=1),
                               dict(product_id=200, category="A", distribution_center_id=1)],
                     dcs=[dict(distribution_center_id=1, name="DC1")])
    ih = {r.product_id: r for r in gold.inventory_health(s, facts.facts(s)).collect()}
    sold_out = ih[100]
    assert sold_out.turnover_rate is None            # no stock -> null (T9)
    assert sold_out.days_of_supply == 0 and sold_out.reorder_signal is True
    assert sold_out.days_since_last_sale == -28      # sale after newest receipt (T10)
    assert ih[200].is_dead_stock is True              # never sold, has stock


def test_t11_inventory_health_drops_products_without_inventory(spark):
    s = small_silver(spark, products=[dict(product_id=1, category="A", distribution_center_id=1)],
                     dcs=[dict(distribution_center_id=1, name="DC1")])
    assert gold.inventory_health(s, facts.facts(s)).count() == 0


def _events(user, month_days):
    out, k = [], 0
    for d in month_days:
        k += 1
        out.append(dict(event_id=user * 1000 + k, user_id=user, session_id=f"{user}-{d}",
                        created_at=ts(d), event_type="purchase", is_anonymous=False))
    return out


def test_t12_t13_mom_bridges_gaps_and_conversion_is_capped(spark):
    ev = _events(1, ["2001-01-05", "2001-01-05", "2001-03-02", "2001-03-03"])
    s = small_silver(spark, events=ev)
    fa = sorted(gold.funnel_analytics(facts.facts(s)).collect(), key=lambda r: r.event_month)
    assert [r.sessions for r in fa] == [1, 2]
    assert fa[1].sessions_mom_change == 1               # Jan -> Mar, February gap bridged
    assert fa[0].session_to_purchase_rate == 1.0         # 2 purchases in 1 session, capped


def test_t15_units_returned_not_coalesced(spark):
    s = small_silver(spark, products=[dict(product_id=1, category="A", cost=1.0)])
    pp = gold.product_performance(s, facts.facts(s)).first()
    assert pp.units_sold == 0 and pp.units_returned is None


def test_t4_t23_half_open_windows_and_processing_lag(spark):
    # max order 2001-04-11 -> cutoff 2001-01-11; user 1 ordered 01-10 but its item is dated 01-12
    o = [dict(order_id=1, user_id=1, status="Complete", created_at=ts("2001-01-10")),
         dict(order_id=2, user_id=2, status="Complete", created_at=ts("2001-01-11")),
         dict(order_id=3, user_id=3, status="Complete", created_at=ts("2001-04-11"))]
    items = [_item(1, 1, 1, 100, 9.0, created="2001-01-12")]
    s = small_silver(spark, orders=o, items=items,
                     customers=[dict(user_id=u, created_at=ts("2000-01-01")) for u in (1, 2, 3)],
                     products=[dict(product_id=100, category="A", retail_price=10.0)])
    fb = features.FeatureBuilder(s, DEFAULT)
    assert str(fb.boundaries().first().feature_cutoff) == "2001-01-11"
    assert [r.user_id for r in fb.eligible().collect()] == [1]      # order exactly at cutoff excluded
    txn = fb.transactional().first()
    assert txn.lifetime_spend == 0.0 and txn.total_items_purchased == 0 and txn.avg_order_value is None
    ds = fb.dataset().first()
    assert ds.churned == 1 and ds.days_since_last_session == 360 and ds.total_sessions == 0


def test_t21_prior_zero_gives_zero_delta(spark):
    df = spark.createDataFrame([("m", "d", 5.0, 0.0, "mom")],
                               "metric string, domain string, current_value double, prior_value double, kind string")
    df = df.withColumns({"delta_pct": F.lit(None).cast("double"), "direction": F.lit(None).cast("string"),
                         "severity": F.lit(None).cast("string"), "context": F.lit(None).cast("string")})
    r = signals.classify(df, DEFAULT).first()
    assert r.delta_pct == 0.0 and r.direction == "flat" and r.severity == "normal"


def test_signal_severity_is_direction_aware(spark):
    df = spark.createDataFrame([("up", 120.0, 100.0), ("down", 80.0, 100.0), ("warn", 94.0, 100.0)],
                               "metric string, current_value double, prior_value double")
    df = df.withColumns({"domain": F.lit("x"), "kind": F.lit("mom"), "delta_pct": F.lit(None).cast("double"),
                         "direction": F.lit(None).cast("string"), "severity": F.lit(None).cast("string"),
                         "context": F.lit(None).cast("string")})
    got = {r.metric: r.severity for r in signals.classify(df, DEFAULT).collect()}
    assert got == {"up": "notable", "down": "critical", "warn": "warning"}
