"""Constraint runner, PK check, layer runner with observed counts, streaming
Bronze ingest, raw-column lists, and plan properties (no job while building,
no Python UDF, filters pushed into the scan)."""

import glob
import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpers import SF_SMALL
from martflow.operators import quality as q


def test_check_constraint_null_passes_and_enforce_splits(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0), (None, 2.0)], "id long, price double")
    rules = [q.check_rule("pk_not_null", "id IS NOT NULL"), q.check_rule("positive_price", "price > 0")]
    rep = {r.check: (r.violations, r.passed) for r in q.rule_report(df, "t", rules).collect()}
    assert rep == {"pk_not_null": (1, False), "positive_price": (1, False)}
    acc, qua = q.enforce(df, rules)
    assert sorted(r.id for r in acc.collect()) == [1, 2]
    got = sorted(((r.id if r.id is not None else -1), tuple(r.broken_rules)) for r in qua.collect())
    assert got == [(-1, ("pk_not_null",)), (3, ("positive_price",))]


def test_pk_check_counts_null_as_one_distinct_value(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k long")
    r = q.pk_check(df, "t", "k").first()
    assert (r.total, r.null_keys, r.duplicate_keys, r.passed) == (5, 2, 2, False)


def test_raw_column_lists_match_the_adapter(pipe):
    from martflow.plans.catalog import RAW_COLUMNS
    from pyspark.sql.types import StringType
    for t, cols in RAW_COLUMNS.items():
        schema = pipe.raw[t].schema
        assert [c for c, _ in cols] == schema.fieldNames(), t
        assert [bool(s) for _, s in cols] == [isinstance(f.dataType, StringType) for f in schema.fields], t


def test_run_layer_counts_with_observe_in_one_write(spark, pipe):
    from martflow.plans.layer import run_layer
    from martflow.sources.io import Lake
    lake = Lake(spark, tempfile.mkdtemp(prefix="mf-lake-"))
    builders = {"funnel_analytics": lambda: pipe.g("funnel_analytics"),
                "broken": lambda: pipe.g("does_not_exist")}
    rep = {r.table: r for r in run_layer(spark, builders, lake, "gold").collect()}
    assert rep["funnel_analytics"].status == "OK"
    assert rep["funnel_analytics"].rows == lake.table("gold", "funnel_analytics").count()
    assert rep["broken"].status == "FAILED"


def test_streaming_bronze_ingest_is_incremental(spark):
    from martflow.streaming.ingest import ingest_available
    src = tempfile.mkdtemp(prefix="mf-src-")
    out = tempfile.mkdtemp(prefix="mf-out-")
    ck = tempfile.mkdtemp(prefix="mf-ck-")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    orders.filter(F.col("o_orderkey") < 700).write.mode("overwrite").parquet(f"{src}/part1")
    files = glob.glob(f"{src}/part1/*.parquet")
    for i, f in enumerate(files):
        shutil.copy(f, f"{src}/a{i}.parquet")
    ingest_available(spark, src, orders.schema, out, "orders", checkpoint=ck)
    n1 = spark.read.parquet(out).count()
    orders.filter(F.col("o_orderkey") >= 700).write.mode("overwrite").parquet(f"{src}/part2")
    for i, f in enumerate(glob.glob(f"{src}/part2/*.parquet")):
        shutil.copy(f, f"{src}/b{i}.parquet")
    ingest_available(spark, src, orders.schema, out, "orders", checkpoint=ck)
    b = spark.read.parquet(out)
    assert n1 < b.count() == orders.count()
    assert {"_ingested_at", "_source_file"} <= set(b.columns)


def test_builders_trigger_no_job_and_use_no_python_udf(spark, pipe, monkeypatch):
    from martflow.operators import explorer as ex, findings as fi
    _ = pipe.silver, pipe.gold, pipe.dataset, pipe.model_frame   # materialised tables exist

    def boom(*a, **k):
        raise AssertionError("action while building a plan")
    for name in ("collect", "count", "toPandas", "first", "take", "show"):
        monkeypatch.setattr(DataFrame, name, boom)
    plans = [pipe.g(n) for n in pipe.gold] + [
        pipe.signals, pipe.monitoring["summary"], ex.top_products(pipe.g("product_performance")),
        fi.findings(pipe.signals, fi.drilldowns(pipe.gold, pipe.cfg), pipe.monitoring["summary"],
                    pipe.g("fulfillment_metrics"), pipe.cfg)]
    monkeypatch.undo()
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_filters_and_projections_reach_the_scan(spark, pipe):
    df = pipe.s("orders_clean").filter(F.col("status") != "Cancelled").select("user_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(status), Not(EqualTo(status,Cancelled))]" in text
    assert "ReadSchema: struct<user_id:bigint,status:string>" in text


def test_silver_writes_no_bronze_copy_for_itself(spark):
    import os
    import uuid

    from helpers import SF_SMALL, rows

    from martflow.plans.pipeline import Pipeline
    from martflow.session import checkpoint_dir
    p = Pipeline(spark, SF_SMALL, run_id=uuid.uuid4().hex)
    first = rows(p.s("products_clean"))
    folder = os.path.join(checkpoint_dir(spark), "tables", p.key)
    assert os.listdir(folder) == ["silver_products_clean"]
    p.bronze["users"]                                                   # written: Silver reads it
    p.s("customers_clean")
    assert sorted(os.listdir(folder)) == ["bronze_users", "silver_customers_clean", "silver_products_clean"]
    assert "bronze_users" in p.once["users"].inputFiles()[0] and len(first) == p.raw["products"].count()
