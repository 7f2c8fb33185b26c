"""Feature store, many-cutoff backtest and quarantine."""

from datetime import datetime

import pytest
from helpers import rows, small_silver, ts
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from martflow.operators import backtest, features, ml, quarantine
from martflow.operators.featurestore import FeatureStore

# ------------------------------------------------------------------ feature store


def _snap(spark, data):
    return spark.createDataFrame(data, "user_id long, f double, event_timestamp timestamp_ntz")


def test_feature_store_upserts_new_ranges_and_prunes_buckets(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"), buckets=32)
    store.append(_snap(spark, [(k, float(k), datetime(2001, 1, 1)) for k in range(300)]
                       + [(None, 1.0, datetime(2001, 1, 1)), (7, 70.0, datetime(2001, 2, 1))]))
    assert store.materialize("2001-01-31 00:00:00") == 32 and store.latest().count() == 300
    assert store.new_rows("2001-03-01 00:00:00").count() == 1            # the first range is not read again
    assert store.materialize("2001-03-01 00:00:00") == 1
    assert store.materialize("2001-04-01 00:00:00") == 0
    store.append(_snap(spark, [(7, 71.0, datetime(2001, 5, 1)), (8, 80.0, datetime(2001, 5, 1)), (9, 9.9, datetime(2000, 5, 1))]))
    store.materialize("2001-06-01 00:00:00")
    want = {k: float(k) for k in range(300)} | {7: 71.0, 8: 80.0}
    assert {r["user_id"]: r["f"] for r in store.latest().collect()} == want
    keys = [1, 7, 8, 9, 10, 11, 12, 13, 14, 999]
    found = store.lookup(keys, ["f"])
    assert {r["user_id"]: r["f"] for r in found.collect()} == {k: want.get(k) for k in keys}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


# ------------------------------------------------------------------ backtest
def test_labels_at_many_cutoffs_equal_single_builders(pipe):
    silver = {n: pipe.s(n) for n in pipe.silver}
    builder = features.FeatureBuilder(silver, pipe.cfg)
    own = str(builder.boundaries().first()["feature_cutoff"])[:10]
    many = backtest.labels(silver, ["2001-02-01", own], pipe.cfg)
    assert rows(many.where(F.col("cutoff") == F.to_date(F.lit(own))), "user_id", "churned") == rows(builder.labels())
    data = backtest.dataset(silver, ["2001-02-01", own], pipe.cfg)
    one = data.where(F.col("cutoff") == F.to_date(F.lit(own))).drop("cutoff")
    assert rows(one, "user_id", "churned", "order_count", "lifetime_spend") == rows(
        builder.dataset(), "user_id", "churned", "order_count", "lifetime_spend")


def test_items_are_not_repeated_per_cutoff(spark):
    at = {1: "2000-12-01 00:00:00", 2: "2001-02-15 00:00:00", 3: "2001-05-30 00:00:00"}
    items = [dict(order_item_id=k, order_id=k, user_id=u, product_id=p, status="Complete", created_at=ts(at[k % 3 + 1]),
                  sale_price=float(10 + k), is_returned=k == 4) for k, (u, p) in
             enumerate([(1, 1), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (None, 3), (2, 9)])]
    products = [dict(product_id=p, category=c, retail_price=100.0) for p, c in [(1, "a"), (2, "b"), (3, None)]]
    orders = [dict(order_id=k, user_id=u, status="Complete", created_at=ts(at[1])) for k, u in enumerate([1, 2, 3])]
    s = small_silver(spark, customers=[dict(user_id=u, created_at=ts(at[1])) for u in (1, 2, 3)], orders=orders, items=items,
                     products=products)
    dates = ["2001-02-01", "2001-03-01", "2001-07-01"]
    each = [F.to_date(F.lit(c)) for c in dates]
    assert features.Stamped(s, lambda df: df, each).items.count() == len(items)
    whole = features.multi_cutoff_snapshots(s, dates)
    apart = features.multi_cutoff_snapshots(s, dates, one_pass=False)
    assert whole.count() == 9 and rows(whole.select(*sorted(whole.columns)).na.fill(-1).na.fill("none")) == rows(
        apart.select(*sorted(whole.columns)).na.fill(-1).na.fill("none"))
    got = {str(r["event_timestamp"])[:10]: r for r in whole.where("user_id = 1").collect()}
    assert [got[d]["total_items_purchased"] for d in dates] == [2, 3, 4]
    assert [got[d]["distinct_products_purchased"] for d in dates] == [2, 2, 3]
    assert [got[d]["distinct_categories_purchased"] for d in dates] == [1, 1, 2]
    assert [got[d]["lifetime_spend"] for d in dates] == [23.0, 34.0, 46.0]
    assert [got[d]["favorite_category"] for d in dates] == [None, "a", "a"]


def test_label_window_has_an_end(spark):
    orders = [dict(order_id=k, user_id=1, status="Complete", created_at=ts(t)) for k, t in
              enumerate(["2000-12-01 00:00:00", "2001-05-02 12:00:00"])]
    s = small_silver(spark, orders=orders)
    got = {str(r["cutoff"]): r["churned"] for r in backtest.labels(s, ["2001-01-01", "2001-02-01", "2001-06-01"]).collect()}
    assert got == {"2001-01-01": 1, "2001-02-01": 0, "2001-06-01": 1}     # 121 days, exactly 90 days, none


def test_walk_forward_trains_on_closed_cutoffs(pipe):
    silver = {n: pipe.s(n) for n in pipe.silver}
    data = backtest.dataset(silver, ["2001-01-01", "2001-03-01", "2001-05-03"], pipe.cfg).cache()
    got = {str(r["cutoff"]): r for r in backtest.walk_forward(data, ml.logistic_regression(10), pipe.cfg).collect()}
    assert set(got) == {"2001-05-03"}                                     # 2001-03-01 lies in the first window
    assert got["2001-05-03"]["n"] == data.where("cutoff = date '2001-05-03'").count()
    with pytest.raises(ValueError):
        backtest.walk_forward(data.where("cutoff < date '2001-04-01'"), ml.logistic_regression(5), pipe.cfg)
    data.unpersist()


# ------------------------------------------------------------------ quarantine
DECLARED = StructType([StructField("id", LongType()), StructField("cost", DoubleType()), StructField("category", StringType()),
                       StructField("name", StringType()), StructField("brand", StringType()), StructField("retail_price", DoubleType()),
                       StructField("department", StringType()), StructField("sku", StringType()),
                       StructField("distribution_center_id", LongType())])


def _products(spark):
    data = [("1", "1.5", "a", "n", "b", "3.0", "d", "s", "1"), ("x2", "1.5", "a", "n", "b", "3.0", "d", "s", "1"),
            ("3", "1,5", "a", "n", "b", "three", "d", "s", None), ("4", None, None, None, None, "9.99", None, None, None),
            ("5", "-2.0", "a", "n", "b", "3.0", "d", "s", "1")]
    return spark.createDataFrame(data, quarantine.text_schema(DECLARED))


def test_quarantine_splits_names_reasons_and_replays(spark, tmp_path):
    from martflow.operators.quality import Rule
    rules = [Rule("cost_not_negative", "cost < 0")]
    raw = _products(spark).withColumn("extra", F.lit("kept in the source row"))
    ok, bad = quarantine.split(quarantine.judge(raw, "products_clean", DECLARED, rules), "products_clean", str(tmp_path / "q"))
    assert sorted(r["product_id"] for r in ok.collect()) == [1, 4]
    assert ok.where("product_id = 1").first()["base_margin"] == 1.5
    broken = sorted(sorted(r["broken"]) for r in bad.collect())
    assert broken == [["cost_not_negative"], ["type:cost", "type:retail_price"], ["type:id"]]
    assert {(r["reason"], r["rows"]) for r in quarantine.reasons(bad).collect()} == {
        ("cost_not_negative", 1), ("type:cost", 1), ("type:retail_price", 1), ("type:id", 1)}
    assert all("kept in the source row" in r["source_row"] for r in bad.collect())

    def mend(df):
        return df.withColumns({"id": F.regexp_replace("id", "x", ""), "cost": F.regexp_replace("cost", ",", "."),
                               "retail_price": F.when(F.col("retail_price") == "three", "3").otherwise(F.col("retail_price"))})
    again = quarantine.replay(bad, "products_clean", DECLARED, mend, rules)
    assert {r["product_id"]: r["broken"] for r in again.collect()} == {2: [], 3: [], 5: ["cost_not_negative"]}


def test_only_rejected_rows_keep_their_source(spark, tmp_path):
    judged = quarantine.judge(_products(spark), "products_clean", DECLARED)
    quarantine.split(judged, "products_clean", str(tmp_path / "q"))
    held = spark.read.parquet(str(tmp_path / "q")).groupBy("accepted").agg(F.count("source_row").alias("n"), F.count("*").alias("all"))
    got = {str(r["accepted"]).lower(): (r["n"], r["all"]) for r in held.collect()}
    assert got["true"][0] == 0 and got["false"][0] == got["false"][1] > 0


def test_quarantine_in_a_stream(spark, tmp_path):
    from martflow.streaming.ingest import bronze_stream
    _products(spark).write.parquet(str(tmp_path / "in"))
    writer = quarantine.batch_writer("products_clean", DECLARED, str(tmp_path / "out"))
    for _ in range(2):                                                   # nothing new the second time
        q = (bronze_stream(spark, str(tmp_path / "in"), quarantine.text_schema(DECLARED)).writeStream.foreachBatch(writer)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 5 and got.where("accepted = 'true'").count() == 3
