"""Facts roll up to the same numbers as direct aggregates, without Expand."""

from datetime import datetime, timedelta

import pytest
from helpers import rows, silver_df, small_silver, ts
from pyspark.sql import functions as F

from martflow.operators import facts, features, gold, quality


def test_gold_and_feature_plans_hold_no_expand(pipe):
    silver = {n: pipe.s(n) for n in pipe.silver}
    plans = list(gold.gold_layer(silver, pipe.cfg).values())
    plans += [features.FeatureBuilder(silver, pipe.cfg).features(),
              features.snapshots_one_pass(silver, ["2001-02-01", "2001-03-01"], pipe.cfg)]
    for df in plans:
        assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_roll_ups_equal_direct_aggregates(pipe):
    items, events = facts.kept(pipe.s("order_items_clean"), pipe.cfg), facts.known_visitors(pipe.s("events_clean"))
    assert rows(facts.buying(pipe.facts["purchases"]), "user_id", "units", "products") == rows(items.groupBy("user_id").agg(
        F.count("order_item_id").alias("units"), F.count_distinct("product_id").alias("products")))
    assert rows(gold.selling(pipe.facts["purchases"]), "product_id", "buyers") == rows(
        items.groupBy("product_id").agg(F.count_distinct("user_id").alias("buyers")))
    ref = gold.max_ts(pipe.s("events_clean"))
    near = F.datediff(ref, "created_at") <= pipe.cfg.recent_session_days
    assert rows(facts.browsing(facts.whole_sessions(pipe.facts["session_months"]), gold.last_days(ref, pipe.cfg)),
                "user_id", "sessions", "recent_sessions", "events") == rows(events.groupBy("user_id").agg(
                    F.count_distinct("session_id"), F.count_distinct(F.when(near, F.col("session_id"))), F.count("event_id")))


def test_a_session_over_a_months_end_counts_once_and_null_ids_not_at_all(spark):
    e = [dict(event_id=k, user_id=1, session_id=s, created_at=ts(t), event_type=kind, is_anonymous=False)
         for k, (s, t, kind) in enumerate([("a", "2001-01-31 23:59:00", "home"), ("a", "2001-02-01 00:01:00", "cart"),
                                           ("b", "2001-02-02 10:00:00", "purchase"), (None, "2001-02-02 11:00:00", "cart")])]
    parts = facts.session_months(silver_df(spark, "events_clean", e))
    months = {str(r["event_month"])[:7]: r["sessions"] for r in gold.funnel_counts(parts).collect()}
    assert months == {"2001-01": 1, "2001-02": 2}
    whole = facts.browsing(facts.whole_sessions(parts), lambda at: at >= ts("2001-02-01 00:00:30")).first()
    assert (whole["sessions"], whole["recent_sessions"], whole["events"], whole["cart_events"]) == (2, 2, 4, 2)


@pytest.mark.parametrize("days", [[3], [1, 9], [5, 1, 3], [2] * 7 + [40] * 6, [0, 0, 1, 1, 1, 8]])
def test_median_wait_is_exact(spark, days):
    start = datetime(2001, 1, 1)
    lines = [("m", start, start + timedelta(days=d)) for d in days] + [("m", start, None), ("none", start, None)]
    lines = spark.createDataFrame(lines, "g string, created_at timestamp_ntz, delivered_at timestamp_ntz")
    got = {r["g"]: r["median_days"] for r in facts.median_wait(lines, ["g"]).collect()}
    assert got == {"m": sorted(days)[(len(days) + 1) // 2 - 1]}


def test_one_cutoff_is_the_case_of_many(pipe):
    silver = {n: pipe.s(n) for n in pipe.silver}
    cuts = ["2001-02-01", "2001-05-03"]
    names = ["event_timestamp", "user_id", *features.ALL_FEATURES]
    many = features.snapshots_one_pass(silver, cuts, pipe.cfg).select(*names)
    single = features.multi_cutoff_snapshots(silver, cuts, pipe.cfg, one_pass=False).select(*names)
    key = lambda r: (str(r[0]), r[1])                                                      # noqa: E731
    assert sorted(map(tuple, many.collect()), key=key) == sorted(map(tuple, single.collect()), key=key)


def test_temporal_integrity_can_fail(spark):
    s = small_silver(spark, orders=[dict(order_id=1, user_id=1, status="Complete", created_at=ts("2001-01-01 00:00:00"))])
    keep = features.Stamped(s, lambda df: df.filter(F.col("created_at") < "2001-02-01").withColumn(
        "cutoff", F.to_date(F.lit("2001-02-01"))))
    leak = features.Stamped(s, lambda df: df.withColumn("cutoff", F.to_date(F.lit("2001-01-01"))))
    assert [r["passed"] for r in quality.temporal_integrity(keep).collect()] == [True, True, True]
    assert {r["source"]: r["passed"] for r in quality.temporal_integrity(leak).collect()}["orders"] is False
