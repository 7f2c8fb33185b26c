"""Benchmark of the headline pipeline steps.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "pipeline_total", "value": <sec>, "unit": "sec", "queries": {...}, "sf": ...}

Steps are timed in pipeline order with a fresh table folder, so Silver is
really built (and written) inside the run; every later step reads the
written Silver / feature tables like the production layering does. Result
DataFrames are executed with the ``noop`` sink (full execution, no output).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="martflow-bench-")
    from martflow.session import get_session
    spark = get_session(f"local[{cpus}]", app="martflow-bench",
                        shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
                               "spark.checkpoint.dir": scratch,
                               "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    spark.sparkContext.setLogLevel("ERROR")

    from martflow.operators import explorer as ex
    from martflow.operators import findings as fi
    from martflow.plans.pipeline import Pipeline

    p = Pipeline.fixture(spark, sf_dir)
    times: dict[str, float] = {}

    def run(name, thunk):
        t0 = time.time()
        df = thunk()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    # warm-up: JVM / codegen on a small query
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()

    run("bronze_layer", lambda: p.write_layer(p.bronze))                # adapter + 7 Bronze writes
    run("silver_layer", lambda: p.write_layer(p.silver))                # 7 Silver writes
    run("gold_layer", lambda: p.write_layer(p.gold))                    # 5 Gold tables, written
    run("churn_feature_dataset", lambda: (p.dataset, None)[1])        # features + labels, written
    run("asof_retrieval", lambda: _asof(p))
    run("model_frame", lambda: (p.model_frame, None)[1])
    run("drift_monitoring", lambda: p.monitoring["summary"])
    run("kpi_signals", lambda: p.signals)
    run("findings", lambda: fi.findings(p.signals, fi.drilldowns(p.gold, p.cfg), p.monitoring["summary"],
                                        p.g("fulfillment_metrics"), p.cfg))
    run("explorer_top_products", lambda: ex.top_products(p.g("product_performance")))
    run("explorer_inventory_by_dc", lambda: ex.inventory_by_dc(p.g("inventory_health")))

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "pipeline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


def _asof(p):
    from pyspark.sql import functions as F
    from martflow.functions.exprs import add_days, ntz
    from martflow.operators import asof, features
    snaps = features.multi_cutoff_snapshots(p.silver, ["2001-02-01", "2001-03-01", "2001-05-03"], p.cfg)
    ents = p.s("customers_clean").select(
        "user_id", add_days(ntz("2001-01-15"), F.col("user_id") % 150).alias("event_timestamp"))
    return asof.asof_join(ents, snaps, ttl_days=p.cfg.feature_ttl_days)


if __name__ == "__main__":
    main()
