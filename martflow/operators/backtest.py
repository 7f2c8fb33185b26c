"""Many-cutoff training data and backtest by time.

The cutoff is a column of features and labels alike: a row is a customer at a
cutoff, the features read what lies before it, the label the ``prediction_window_days``
after it. Folds go by time: a fold tests the rows of one cutoff with a model trained on cutoffs
whose label window had closed by then, so nothing that was unknown then is learnt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.config import DEFAULT, Config
from martflow.operators import facts, features, ml
from martflow.operators import modeldata as md


def labels(silver: dict[str, DataFrame], cutoffs: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """E7 per cutoff: (cutoff, user_id, churned) of customers with an order before the
    cutoff; churned without one from the cutoff to the last day of the window."""
    dates = F.array(*[F.to_date(F.lit(c)) for c in sorted(set(cutoffs))])
    at, cutoff = F.col("created_at"), F.col("cutoff")
    near = F.filter(dates, lambda c: F.to_date(at) <= F.date_add(c, cfg.prediction_window_days))
    orders = facts.kept(silver["orders_clean"], cfg).select("user_id", "created_at", F.explode(near).alias("cutoff"))
    return (orders.groupBy("cutoff", "user_id").agg(F.max(at < cutoff).alias("before"), F.max(at >= cutoff).alias("after"))
            .where("before").select("cutoff", "user_id", F.when(F.col("after"), 0).otherwise(1).alias("churned")))


def dataset(silver: dict[str, DataFrame], cutoffs: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """E9 per cutoff: labels and features of every (cutoff, customer)."""
    rows = features.snapshots_one_pass(silver, cutoffs, cfg).withColumn("cutoff", F.to_date("event_timestamp"))
    return labels(silver, cutoffs, cfg).join(rows.drop("event_timestamp"), ["cutoff", "user_id"])


def metrics(rows: DataFrame, score: Callable[[DataFrame], DataFrame], cfg: Config = DEFAULT) -> DataFrame:
    """F8 per cutoff for given scores."""
    return md.binary_metrics(score(rows), label="churned", score="score", group=["cutoff"], threshold=cfg.decision_threshold)


def walk_forward(rows: DataFrame, model: Pipeline, cfg: Config = DEFAULT) -> DataFrame:
    """Metrics per cutoff that has closed cutoffs before it. ``rows`` should be a written
    table (a fold reads it several times); the driver loops over the cutoffs only."""
    cutoffs = sorted(r[0] for r in rows.select("cutoff").distinct().collect())
    parts = []
    for cutoff in cutoffs:
        known = rows.where(F.date_add("cutoff", cfg.prediction_window_days) < F.lit(cutoff))
        if known.isEmpty():
            continue
        encoders = md.fit_encoders(md.null_policy(known))
        train = md.with_weights(md.apply_encoders(md.null_policy(known), encoders), "churned")
        test = md.apply_encoders(md.null_policy(rows.where(F.col("cutoff") == F.lit(cutoff))), encoders)
        parts.append(ml.score(ml.fit(model, train), test).select("cutoff", "churned", "score"))
    if not parts:
        raise ValueError("no cutoff lies behind the label window of an earlier one")
    return md.binary_metrics(md.union_all(parts), label="churned", score="score", group=["cutoff"],
                             threshold=cfg.decision_threshold)
