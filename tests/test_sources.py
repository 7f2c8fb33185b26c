"""Sources and sinks: extract, views + ad-hoc SQL runner, summary JSON
round trip, export with manifest and verification, drift decision rule."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from helpers import SF_SMALL
from martflow.operators import drift, explorer
from martflow.sources import io


def test_extract_copies_chosen_tables_and_rejects_unknown(spark):
    out = tempfile.mkdtemp(prefix="mf-extract-")
    rep = io.extract(spark, "parquet", {"path": SF_SMALL}, ["nation.parquet"],
                     ["nation.parquet", "region.parquet"], out)
    assert [tuple(r) for r in rep.collect()] == [("nation.parquet", 25)]
    try:
        io.extract(spark, "parquet", {"path": SF_SMALL}, ["nope"], ["nation.parquet"], out)
        raise AssertionError("unknown table accepted")
    except ValueError as e:
        assert "unknown tables" in str(e)


def test_views_catalog_and_sql_runner(spark, pipe):
    names = io.register_views(spark, {**pipe.gold, "predictions": pipe.predictions})
    assert "customer_360" in names
    res = explorer.run_sql(spark, "SELECT user_id FROM customer_360")
    assert len(res["rows"]) == 10 and res["total"] == 150 and "top 10 of 150" in res["message"]
    assert explorer.run_sql(spark, "SELECT * FROM customer_360 WHERE 1 = 0")["message"].startswith("Query returned")
    assert explorer.run_sql(spark, "SELECT nonsense FROM")["message"].startswith("Query could not")
    cat = {r.table_name: r.row_count for r in io.table_catalog({"customer_360": pipe.g("customer_360")}).collect()}
    assert cat == {"customer_360": 150}


def test_summary_json_round_trip(spark, pipe):
    path = os.path.join(tempfile.mkdtemp(prefix="mf-sum-"), "summary")
    summary = pipe.monitoring["summary"]
    io.write_summary_json(summary, path)
    back = io.read_summary_json(spark, path, summary.schema)
    d = io.summary_to_dict(back)
    assert d["recommendation"] in ("INVESTIGATE", "CONTINUE_SERVING")
    assert d["features_tested"] == 21
    json.dumps(d)


def test_export_layer_manifest_and_verification(spark, pipe):
    from martflow.plans.layer import export_layer, run_layer
    lake = io.Lake(spark, tempfile.mkdtemp(prefix="mf-lake-"))
    run_layer(spark, {n: (lambda n=n: pipe.g(n)) for n in ("fulfillment_metrics", "funnel_analytics")},
              lake, "gold")
    out = export_layer(spark, lake, "gold", ["fulfillment_metrics", "funnel_analytics"],
                       tempfile.mkdtemp(prefix="mf-export-"))
    assert all(r.match for r in out["verification"].collect())
    m = out["manifest"].first()
    assert sorted(t.table for t in m.tables) == ["fulfillment_metrics", "funnel_analytics"]


def test_drift_decision_is_method_aware(spark):
    df = spark.createDataFrame([("wasserstein_distance_norm", 0.2), ("jensenshannon", 0.05),
                                ("ks_p_value", 0.01), ("chisquare_p_value", 0.5)], "method string, v double")
    got = {r.method: r.d for r in df.select("method", drift.is_drift(F.col("method"), F.col("v"), 0.1)
                                            .alias("d")).collect()}
    assert got == {"wasserstein_distance_norm": True, "jensenshannon": False,
                   "ks_p_value": True, "chisquare_p_value": False}


def test_lake_partitioned_overwrite_and_preview(spark, pipe):
    lake = io.Lake(spark, tempfile.mkdtemp(prefix="mf-lake-"),
                   partition_by={"fulfillment_metrics": ["distribution_center_id"]})
    fm = pipe.g("fulfillment_metrics")
    lake.write(fm, "gold", "fulfillment_metrics")
    lake.write(fm, "gold", "fulfillment_metrics")            # overwrite, not append
    back = lake.table("gold", "fulfillment_metrics")
    assert back.count() == fm.count() and lake.exists("gold", "fulfillment_metrics")
    one = back.filter(F.col("distribution_center_id") == 3)
    assert "PartitionFilters: [isnotnull(distribution_center_id" in \
        one._jdf.queryExecution().executedPlan().toString()
    top = io.preview(back, 3, [F.desc("total_revenue"), "order_month"])
    assert top.count() == 3
