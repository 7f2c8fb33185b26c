"""Baseline profiles for drift.

A profile holds, per feature, how often each value occurs: (feature, value, n).
It is written once when a model is trained; a monitoring run reads it and the
new batch, never the training rows. Profiles merge by adding counts, so the
profile of a union is the merge of the profiles, whatever the parts. All drift
statistics (kinds, standard deviation, quantile bins, distances) come from the counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow.config import DEFAULT, Config
from martflow.functions.quantiles import order_statistics, discrete_rank
from martflow.functions.windows import running_totals

# The reported method names and the floors of the statistics.
WASSERSTEIN_METHOD = "wasserstein_distance_norm"
JS_METHOD = "jensenshannon"
STD_FLOOR = 0.001
PSI_FLOOR = 0.0001
#: A feature with at most so many reference values is compared by frequencies.
DISCRETE_VALUES = 5


def profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Value counts of the features' non-null values, one pass over the rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                                for f in features]))
    return (df.select(cells.alias("cell")).select("cell.*").where(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))


def merge(*profiles: DataFrame) -> DataFrame:
    """The profile of all rows of the given profiles."""
    return (reduce(lambda a, b: a.unionByName(b), profiles)
            .groupBy("feature", "value").agg(F.sum("n").alias("n")))


def paired(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """(feature, value, n_ref, n_cur) of two profiles."""
    zero = F.lit(0).cast("long")
    both = (ref.select("feature", "value", F.col("n").alias("n_ref"), zero.alias("n_cur"))
            .unionByName(cur.select("feature", "value", zero.alias("n_ref"), F.col("n").alias("n_cur"))))
    return both.groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))


def totals(counts: DataFrame) -> DataFrame:
    """Per feature: rows of both sides, number of reference values, reference mean."""
    return counts.groupBy("feature").agg(
        F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"),
        F.count_if(F.col("n_ref") > 0).alias("ref_values"),
        (F.sum(F.col("n_ref") * F.col("value")) / F.sum("n_ref")).alias("ref_mean"))


def wasserstein(counts: DataFrame, per_feature: DataFrame) -> DataFrame:
    """Area between the two distribution functions over the reference's standard deviation."""
    steps = running_totals(counts, ["feature"], "value", ["n_ref", "n_cur"]).join(per_feature, "feature")
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    area = F.abs(F.col("cum_n_ref") / F.col("all_ref") - F.col("cum_n_cur") / F.col("all_cur")) * width
    off = F.col("value") - F.col("ref_mean")
    spread = F.sqrt(F.sum(F.col("n_ref") * off * off) / F.max("all_ref"))
    return (steps.groupBy("feature").agg(F.sum(area).alias("area"), spread.alias("spread"))
            .select("feature", (F.col("area") / F.greatest(F.col("spread"), F.lit(STD_FLOOR))).alias("stat_value")))


def jensen_shannon(counts: DataFrame, per_feature: DataFrame) -> DataFrame:
    """Square root of the Jensen-Shannon divergence of the value frequencies."""
    p, q = F.col("n_ref") / F.col("all_ref"), F.col("n_cur") / F.col("all_cur")

    def half(a: Column) -> Column:
        return F.when(a > 0, 0.5 * a * F.log(2 * a / (p + q))).otherwise(F.lit(0.0))

    return (counts.join(per_feature, "feature").groupBy("feature").agg(F.sum(half(p) + half(q)).alias("js"))
            .select("feature", F.sqrt(F.greatest(F.col("js"), F.lit(0.0))).alias("stat_value")))


def stability_index(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index over bins cut at exact quantiles of the reference."""
    ranks = {str(k): discrete_rank(k / bins) for k in range(1, bins)}
    edges = order_statistics(counts, ["feature"], "value", ranks, weight="n_ref").groupBy("feature").agg(
        F.collect_set("value").alias("edges"))                              # bins - 1 values at most
    place = F.size(F.filter("edges", lambda e: e < F.col("value")))
    binned = (counts.join(edges, "feature").groupBy("feature", place.alias("bin"))
              .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")))
    sums = binned.groupBy("feature").agg(F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"))
    r = F.greatest(F.col("n_ref") / F.col("all_ref"), F.lit(PSI_FLOOR))
    c = F.greatest(F.col("n_cur") / F.col("all_cur"), F.lit(PSI_FLOOR))
    return binned.join(sums, "feature").groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("stat_value"))


def drift(counts: DataFrame, discrete: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """(feature, method, stat_value, threshold) for every feature that the reference
    has in ``paired`` counts: frequencies for discrete features, distances for the rest."""
    per_feature = totals(counts).where(F.col("ref_values") > 0)
    by_frequency = F.col("feature").isin(*discrete) | (F.col("ref_values") <= DISCRETE_VALUES)
    few, many = per_feature.where(by_frequency), per_feature.where(~by_frequency)
    parts = [wasserstein(counts.join(many.select("feature"), "feature", "left_semi"), many)
             .select("feature", F.lit(WASSERSTEIN_METHOD).alias("method"), "stat_value"),
             jensen_shannon(counts, few).select("feature", F.lit(JS_METHOD).alias("method"), "stat_value")]
    return parts[0].unionByName(parts[1]).select(
        "feature", "method", F.round("stat_value", 6).alias("stat_value"), F.lit(cfg.drift_threshold).alias("threshold"))
