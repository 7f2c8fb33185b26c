"""Batch serving (F12) and the populations that monitoring compares.

A batch is recorded before it is scored: ``inference_snapshot`` holds the encoded
features exactly as the model gets them, and ``predictions`` are scored from that
written snapshot. Monitoring joins both back (inner, by customer) and takes the outcomes
that are known by then (left join), next to the train and test rows.

A ``Scorer`` adds ``score`` to model-ready rows: the champion of a model
folder, or a given expression where a check needs scores that SQL can repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow.config import DEFAULT, Config
from martflow.operators import ml
from martflow.operators import modeldata as md
from martflow.sources.models import ModelFolder

TRAIN, TEST, BATCH = "train", "test", "batch"


@dataclass(frozen=True)
class Scorer:
    name: str
    version: str
    score: Callable[[DataFrame], DataFrame]
    encoders: DataFrame | None = None          # those the model was trained with, if it has its own

    @property
    def key(self) -> str:
        return f"{self.name}_{self.version}"


def surrogate() -> Scorer:
    """Scores by recency alone (``modeldata.surrogate_score``)."""
    return Scorer("surrogate_recency", "0", lambda df: df.withColumn("score", md.surrogate_score()))


def champion(folder: ModelFolder) -> Scorer:
    """The champion of a model folder, read back from it."""
    version, model, encoders = folder.load()
    return Scorer(folder.name, str(version), lambda df: ml.score(model, df), encoders)


def inference_snapshot(features: DataFrame, encoders: DataFrame, ts: Column | None = None) -> DataFrame:
    """user_id, the model's features as it gets them (unseen categories -1, nulls filled), prediction_timestamp."""
    ready = md.apply_encoders(md.null_policy(features), encoders)
    return ready.select("user_id", *md.MODEL_FEATURES, (ts if ts is not None else F.current_timestamp()).alias("prediction_timestamp"))


def predictions(snapshot: DataFrame, scorer: Scorer, cfg: Config = DEFAULT) -> DataFrame:
    """probability (4 decimals), label at the decision threshold, stamps."""
    prob = F.round("score", 4)
    return scorer.score(snapshot).select(
        "user_id", prob.alias("churn_probability"), (prob >= cfg.decision_threshold).cast("int").alias("predicted_label"),
        "prediction_timestamp", F.lit(scorer.name).alias("model_name"), F.lit(scorer.version).alias("model_version"))


def monitoring_frame(prepared: DataFrame, scorer: Scorer, snapshot: DataFrame, scored: DataFrame,
                     actuals: DataFrame) -> DataFrame:
    """G1 + G2: train, test and batch rows with the same columns: population, user_id,
    churned (null where no outcome is known), score, features."""
    columns = ["population", "user_id", "churned", "score", *md.MODEL_FEATURES]
    fitted = scorer.score(prepared).withColumn("population", F.col("split"))
    batch = (snapshot.drop("prediction_timestamp")
             .join(scored.select("user_id", F.col("churn_probability").alias("score")), "user_id")
             .join(actuals.select("user_id", "churned"), "user_id", "left")
             .withColumn("population", F.lit(BATCH)))
    return fitted.select(*columns).unionByName(batch.select(*columns))


def quality_metrics(frame: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """F8 per population, over the rows whose outcome is known."""
    return md.binary_metrics(frame.where(F.col("churned").isNotNull()), label="churned", score="score",
                             group=["population"], threshold=cfg.decision_threshold)
