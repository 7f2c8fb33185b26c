"""Model folder, recorded batches and the populations of monitoring."""

import random
import threading

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from martflow.config import DEFAULT
from martflow.operators import ml, modeldata as md, serving
from martflow.sources.models import ModelFolder


@pytest.fixture(scope="module")
def planted(spark):
    """A dataset whose churn follows recency, with noise."""
    rnd = random.Random(4)
    rows = []
    for k in range(600):
        recency = rnd.randint(0, 400)
        row = {f: float(rnd.randint(0, 9)) for f in md.MODEL_NUMERIC}
        row.update({c: rnd.choice(["a", "b", "c", None]) for c in md.MODEL_CATEGORICAL})
        rows.append({**row, "user_id": k, "days_since_last_order": float(recency),
                     "churned": int(recency + rnd.gauss(0, 60) > 200)})
    names = ["user_id", "churned", *md.MODEL_FEATURES]
    kind = ", ".join(f"{c} {'string' if c in md.MODEL_CATEGORICAL else 'double'}" for c in md.MODEL_FEATURES)
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], f"user_id long, churned int, {kind}")


@pytest.fixture(scope="module")
def trained(planted):
    runs = {"lr_baseline": ml.logistic_regression(20), "gbt_small": ml.boosted_trees(0.1, 2, 5)}
    return ml.train_and_compare(planted, runs=runs)


def test_every_candidate_is_measured_and_finds_the_signal(planted, trained):
    rows = {r["run"]: r for r in trained.metrics.collect()}
    assert set(rows) == {"lr_baseline", "gbt_small"}
    assert all(r["n"] == 120 and r["auc"] > 0.8 for r in rows.values())
    assert ml.best_run(trained.metrics).first()["auc"] == max(r["auc"] for r in rows.values())
    assert ml.best_run(trained.metrics, "gbt_").first()["run"] == "gbt_small"


def test_fresh_model_scores_in_a_session_that_observed(spark, planted):
    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    ready, _ = ml.prepare(planted.where("user_id < 100"))
    scored = ml.score(ml.fit(ml.logistic_regression(3), ready), ready)
    assert scored.agg(F.count("score").alias("n")).first()["n"] == 100


def test_candidates_are_fitted_side_by_side(planted, monkeypatch):
    """Each fit waits until the other has begun."""
    both, whole = threading.Barrier(2, timeout=60), ml.fit

    def fit(pipe, rows):
        both.wait()
        assert rows.rdd.getNumPartitions() == 1                           # few rows: one small task a job
        return whole(pipe, rows)
    monkeypatch.setattr(ml, "fit", fit)
    runs = {"a": ml.logistic_regression(2), "b": ml.boosted_trees(0.1, 1, 2)}
    result = ml.train_and_compare(planted, runs=runs)
    assert list(result.models) == ["a", "b"] and result.metrics.count() == 2


def test_candidates_are_fitted_on_few_partitions_of_assembled_rows(planted, monkeypatch):
    seen, whole = [], ml.fit

    def fit(pipe, rows):
        seen.append((rows.columns, rows.rdd.getNumPartitions(), rows.count()))
        return whole(pipe, rows)
    monkeypatch.setattr(ml, "fit", fit)
    monkeypatch.setattr(ml, "FIT_ROWS", 10)
    runs = {"a": ml.logistic_regression(2), "b": ml.boosted_trees(0.1, 1, 2)}
    assert ml.train_and_compare(planted, runs=runs).metrics.count() == 2
    assert seen == [(["features", "churned", "weight"], 2, 480)] * 2                # of four cores
    assert [ml.fit_partitions(n, 8) for n in (5, 25, 10**5, 10**8)] == [1, 2, 4, 50]
    assert ml.fit_partitions(10**5, 1) == 1


def test_model_of_assembled_rows_is_the_model_of_the_rows(planted):
    ready, _ = ml.prepare(planted)
    ready = ready.coalesce(1).cache()
    for pipe in (ml.logistic_regression(5), ml.boosted_trees(0.1, 3, 3)):
        plain = ml.fit(pipe, ready)
        assembled = ml.fit(pipe, ml._assembler().transform(ready).select("features", ml.LABEL, "weight").coalesce(1))
        a, b = ([r["score"] for r in ml.score(m, ready).orderBy("user_id").select("score").collect()] for m in (plain, assembled))
        assert a == b and [type(s) for s in plain.stages] == [type(s) for s in assembled.stages]


def test_scores_are_written_before_the_metrics_read_them(spark, planted, tmp_path):
    def store(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))
    runs = {"a": ml.logistic_regression(2), "b": ml.boosted_trees(0.1, 1, 2)}
    found = ml.train_and_compare(planted, runs=runs, store=store).metrics
    scored = spark.read.parquet(str(tmp_path / "model_test_scores"))
    assert {r["run"]: r["n"] for r in found.collect()} == {"a": 120, "b": 120} and scored.count() == 240


def test_model_folder(spark, planted, trained, tmp_path):
    folder = ModelFolder(spark, str(tmp_path), "m")
    with pytest.raises(FileNotFoundError):
        folder.load()
    assert folder.register("lr_baseline", trained.models["lr_baseline"], trained.encoders, 0.9) == 1
    with pytest.raises(FileNotFoundError):          # registered, not serving
        folder.champion()
    assert folder.register("gbt_small", trained.models["gbt_small"], trained.encoders, None) == 2
    folder.promote(2)
    assert folder.champion().first()["run"] == "gbt_small"
    folder.promote(1)
    assert folder.champion().first()["run"] == "lr_baseline" and folder.entries().count() == 2
    with pytest.raises(ValueError):
        folder.promote(3)
    scorer = serving.champion(folder)
    assert (scorer.name, scorer.version) == ("m", "1")
    ready, _ = ml.prepare(planted, trained.encoders)
    own = {r["user_id"]: r["score"] for r in ml.score(trained.models["lr_baseline"], ready).select("user_id", "score").collect()}
    back = {r["user_id"]: r["score"] for r in scorer.score(ready).select("user_id", "score").collect()}
    assert back == own


def test_batch_is_recorded_and_joined_to_known_outcomes(spark, planted, trained):
    scorer = serving.surrogate()
    new = planted.drop("churned").where("user_id < 50").withColumn(
        "country", F.when(F.col("user_id") < 5, "unseen").otherwise(F.col("country")))
    snapshot = serving.inference_snapshot(new, trained.encoders).cache()
    assert {r["country"] for r in snapshot.where("user_id < 5").collect()} == {-1}
    assert not any(v is None for r in snapshot.collect() for v in r)
    scored = serving.predictions(snapshot, scorer)
    for r in scored.join(snapshot.select("user_id", "days_since_last_order"), "user_id").collect():
        assert r["churn_probability"] == round(min(r["days_since_last_order"], 400) / 400 + 1e-12, 4)
        assert r["predicted_label"] == int(r["churn_probability"] >= DEFAULT.decision_threshold)
    ready, _ = ml.prepare(planted, trained.encoders)
    known = planted.select("user_id", "churned").where("user_id < 30 or user_id >= 50")
    frame = serving.monitoring_frame(ready, scorer, snapshot, scored, known)
    sizes = {r["population"]: (r["n"], r["k"]) for r in frame.groupBy("population").agg(
        F.count("*").alias("n"), F.count("churned").alias("k")).collect()}
    assert sizes == {"train": (480, 480), "test": (120, 120), "batch": (50, 30)}
    quality = {r["population"]: r["n"] for r in serving.quality_metrics(frame).collect()}
    assert quality == {"train": 480, "test": 120, "batch": 30}


def test_pipeline_reads_its_scorer(pipe):
    served = pipe.with_scorer(serving.Scorer("half", "1", lambda df: df.withColumn("score", F.lit(0.5))))
    assert served.predictions.select("churn_probability", "model_name").distinct().collect() == [(0.5, "half")]
    assert served.predictions.count() == pipe.dataset.count() == pipe.predictions.count()
    assert pipe.predictions.select("model_name").distinct().collect() == [("surrogate_recency",)]
    risk = {r["metric"]: r["current_value"] for r in served.signals.collect()}
    assert risk["Churn Risk (Inference Batch)"] == 0
    assert served.monitoring["model_quality"].first()["auc_cur"] == 0.5
