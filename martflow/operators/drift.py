"""Drift and model monitoring (G6-G10) on profiles.

The statistics come from value counts (``profiles``): the reference side is a stored
profile, the current side the profile of the batch, so a run reads no training rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow.config import DEFAULT, Config
from martflow.functions.exprs import side_by_side
from martflow.operators import profiles
from martflow.operators.profiles import WASSERSTEIN_METHOD

# Distance-type method names (drift when value > threshold)
# and the recommendation labels.
DISTANCE_METHODS = ["wasserstein", "jensen", "jensenshannon", "psi", "earth_mover"]
RECOMMENDATIONS = ("INVESTIGATE", "CONTINUE_SERVING")


def is_drift(method: Column, value: Column, threshold: Column | float) -> Column:
    """Distance methods drift when value > threshold, p-value methods when <."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    distance = F.lower(method).rlike("|".join(DISTANCE_METHODS))
    return F.when(distance, value > thr).otherwise(value < thr)


def drift_table(counts: DataFrame, discrete: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """(feature, method, stat_value, threshold, drifted) for every feature of the
    reference profile, from paired profiles."""
    out = profiles.drift(counts, discrete, cfg)
    return out.withColumn("drifted", is_drift(F.col("method"), F.col("stat_value"), cfg.drift_threshold))


def drift_overview(table: DataFrame) -> DataFrame:
    """Drifted / tested counts from a drift table (one row)."""
    return table.agg(F.sum(F.col("drifted").cast("int")).cast("long").alias("features_drifted"),
                     F.count(F.lit(1)).alias("features_tested"))


def prediction_drift(counts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Normed Wasserstein between the paired profiles of two score columns."""
    w = profiles.wasserstein(counts, profiles.totals(counts))
    return w.select(F.lit(WASSERSTEIN_METHOD).alias("method"),
                    F.round("stat_value", 4).alias("score"),
                    F.lit(cfg.drift_threshold).alias("threshold")) \
        .withColumn("drift_detected", is_drift(F.col("method"), F.col("score"), cfg.drift_threshold))


def model_quality(metrics: DataFrame, ref: str, cur: str, cfg: Config = DEFAULT) -> DataFrame:
    """AUC / F1 / precision / recall of two populations from a metrics table, side by
    side; degraded when the relative AUC drop exceeds the threshold."""
    cols = ("auc", "f1", "precision", "recall")
    pick = [F.max(F.when(F.col("population") == pop, F.col(c))).alias(f"{c}_{side}")
            for side, pop in (("ref", ref), ("cur", cur)) for c in cols]
    drop = (F.col("auc_ref") - F.col("auc_cur")) / F.col("auc_ref")
    return (metrics.agg(*pick).withColumn("auc_drop", drop)
            .withColumn("model_degraded", F.col("auc_drop") > cfg.auc_drop_threshold))


def monitoring_summary(drift_tbl: DataFrame, pred_drift: DataFrame, quality: DataFrame,
                       ts: Column | None = None) -> DataFrame:
    """The one-row monitoring summary with its recommendation (the
    three inputs are one-row aggregates)."""
    s = (side_by_side(drift_overview(drift_tbl), pred_drift, quality)
         .select((ts if ts is not None else F.current_timestamp()).alias("timestamp"),
                 (F.col("features_drifted") > 0).alias("data_drift_detected"),
                 "features_drifted", "features_tested",
                 F.col("drift_detected").alias("prediction_drift_detected"),
                 F.col("method").alias("prediction_drift_method"),
                 F.col("score").alias("prediction_drift_score"),
                 F.col("threshold").alias("prediction_drift_threshold"),
                 "model_degraded",
                 F.round("auc_ref", 4).alias("auc_ref"), F.round("auc_cur", 4).alias("auc_cur"),
                 F.round(F.col("auc_drop") * 100, 2).alias("auc_drop_pct")))
    alert = F.col("data_drift_detected") | F.col("prediction_drift_detected") | F.col("model_degraded")
    return s.withColumn("recommendation",
                        F.when(alert, RECOMMENDATIONS[0]).otherwise(RECOMMENDATIONS[1]))
