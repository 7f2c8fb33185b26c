"""Model data operators (F1-F5, F8, F11) and the deterministic surrogate score.

All are DataFrame functions; the only driver-side values anywhere in the
model path are fitted model parameters (see ``ml``).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martflow.config import DEFAULT, Config
from martflow.functions.windows import running_totals
from martflow.session import scratch_path
from martflow.operators.features import ALL_FEATURES, CATEGORICAL, METADATA

GAP_FEATURE = "first_to_second_order_days"
DROPPED_FEATURES = ["price_sensitivity_score"]     # zero-variance in the reference run
MODEL_FEATURES = [f for f in ALL_FEATURES if f not in DROPPED_FEATURES]
MODEL_CATEGORICAL = [f for f in CATEGORICAL if f in MODEL_FEATURES]
MODEL_NUMERIC = [f for f in MODEL_FEATURES if f not in MODEL_CATEGORICAL]
UNKNOWN = "Unknown"


# ----------------------------------------------------------------- F1
def training_set(dataset: DataFrame, labels: DataFrame | None = None,
                 drop: list[str] = DROPPED_FEATURES) -> DataFrame:
    """Features joined with labels; metadata and the zero-variance column dropped."""
    df = dataset if labels is None else dataset.drop("churned").join(labels, "user_id")
    keep = [c for c in df.columns if c not in set(METADATA) | set(drop) | {"event_timestamp"}]
    return df.select(*keep)


# ----------------------------------------------------------------- F2
def null_policy(df: DataFrame, numeric: list[str] = MODEL_NUMERIC,
                categorical: list[str] = MODEL_CATEGORICAL) -> DataFrame:
    """Gap -> -1, other numerics -> 0, categories -> 'Unknown'."""
    fills = {}
    for c in numeric:
        if c in df.columns:
            fills[c] = F.coalesce(F.col(c), F.lit(-1 if c == GAP_FEATURE else 0).cast(df.schema[c].dataType))
    for c in categorical:
        if c in df.columns:
            fills[c] = F.coalesce(F.col(c), F.lit(UNKNOWN))
    return df.withColumns(fills)


# ----------------------------------------------------------------- F3
def fit_encoders(df: DataFrame, categorical: list[str] = MODEL_CATEGORICAL) -> DataFrame:
    """Encoder table (column, value, index): index = position of the value in
    sorted order, like a label encoder, one pass over all columns.

    The distinct values are range-partitioned and written in order (``place`` is
    the partition and the row in it); a range then numbers its values from the count of
    those in earlier ranges, so no column is sorted or numbered in one task. The
    window runs over a row per range and column."""
    spark = df.sparkSession
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in categorical]))
    values = (df.select(cells.alias("kv")).select("kv.column", "kv.value").distinct()
              .repartitionByRange("column", "value").sortWithinPartitions("column", F.asc_nulls_first("value"))
              .withColumn("place", F.monotonically_increasing_id()))
    path = scratch_path(spark, f"dictionary/{uuid.uuid4().hex}")
    values.write.parquet(path)
    values = spark.read.schema(values.schema).parquet(path).withColumn("part", F.shiftright("place", 33))
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (values.groupBy("column", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    return (values.join(starts, ["column", "part"])
            .select("column", "value", (F.col("before") + F.col("place") - F.col("first")).cast("int").alias("index")))


def apply_encoders(df: DataFrame, encoders: DataFrame,
                   categorical: list[str] = MODEL_CATEGORICAL) -> DataFrame:
    """Replace each categorical by its index; unseen values -> -1. One join
    per column against that column's vocabulary; AQE picks the strategy from
    its measured size and splits hot values of a shuffle join."""
    out = df
    for c in categorical:
        enc = encoders.filter(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("index").alias(f"_i_{c}"))
        out = (out.join(enc, out[c].cast("string") == enc[f"_v_{c}"], "left")
               .withColumn(c, F.coalesce(F.col(f"_i_{c}"), F.lit(-1)))
               .drop(f"_v_{c}", f"_i_{c}"))
    return out


# ----------------------------------------------------------------- F4
def split_bucket(key: str = "user_id", seed: int = 42) -> F.Column:
    """Portable deterministic bucket 0..999 of a key (same in any SQL engine)."""
    return F.pmod(F.pmod(F.col(key), F.lit(1000003)) * 7919 + seed, F.lit(1000))


def train_test_split(df: DataFrame, cfg: Config = DEFAULT, key: str = "user_id",
                     label: str = "churned") -> DataFrame:
    """Adds ``split``: of every class the share ``test_fraction`` (to the row)
    with the smallest hash of the key is 'test', the rest 'train'.

    Order-free and reproducible (T19). The place of a row in its class is the
    count of rows in smaller buckets plus its rank inside its (class, bucket), so
    no class is sorted in one task.
    """
    x = df.withColumn("_bk", split_bucket(key, cfg.split_seed))
    sizes = x.groupBy(F.col(label).alias("_y"), F.col("_bk").alias("_ybk")).agg(F.count(F.lit(1)).alias("_n"))
    per_class = Window.partitionBy("_y")
    sizes = sizes.select(
        "_y", "_ybk",
        F.coalesce(F.sum("_n").over(per_class.orderBy("_ybk").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.floor(F.sum("_n").over(per_class) * F.lit(cfg.test_fraction) + F.lit(0.5)).alias("_n_test"))
    inside = F.row_number().over(Window.partitionBy(label, "_bk").orderBy(F.pmod(F.col(key), F.lit(1000003)), key))
    x = x.withColumn("_rk", inside).join(sizes, F.col(label).eqNullSafe(F.col("_y")) & (F.col("_bk") == F.col("_ybk")))
    return (x.withColumn("split", F.when(F.col("_before") + F.col("_rk") <= F.col("_n_test"), "test").otherwise("train"))
            .drop("_bk", "_y", "_ybk", "_before", "_n_test", "_rk"))


# ----------------------------------------------------------------- F5
def class_weights(df: DataFrame, label: str = "churned") -> DataFrame:
    """Per-class count and inverse-frequency weight n / (k * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = df.select(F.count(F.lit(1))).scalar()
    k = df.select(F.count_distinct(label)).scalar()
    return counts.select(label, "n_class", (tot / (k * F.col("n_class"))).alias("weight"))


def with_weights(df: DataFrame, label: str = "churned", weight_col: str = "weight") -> DataFrame:
    """Binary labels: the weight is a column expression over scalar
    subqueries (no join on a two-valued key, which would put each class in
    one partition)."""
    both = df.select(F.struct(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(label) == 1, 1)).alias("p"))).scalar()
    n, n_pos = both["n"], both["p"]
    w = F.when(F.col(label) == 1, n / (2 * n_pos)).otherwise(n / (2 * (n - n_pos)))
    return df.withColumn(weight_col, w)


# ----------------------------------------------------------------- F8
def binary_metrics(scored: DataFrame, label: str = "label", score: str = "score",
                   pred: str | None = None, threshold: float = 0.5,
                   group: list[str] | None = None) -> DataFrame:
    """AUC (rank sum, ties share rank), precision, recall, F1, log loss, n.

    AUC = sum_s pos_s * (2 * neg_below_s + neg_s) / (2 * P * N) over distinct
    scores s; ``neg_below`` comes from bucketed running totals, so no step
    needs all rows in one partition.
    """
    group = list(group or [])
    y = F.col(label).cast("int")
    p_hat = F.col(pred).cast("int") if pred else (F.col(score) >= threshold).cast("int")
    eps = 1e-15
    pc = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    conf = scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).cast("long").alias("positives"),
        F.sum(y * p_hat).cast("long").alias("tp"),
        F.sum((1 - y) * p_hat).cast("long").alias("fp"),
        F.sum(y * (1 - p_hat)).cast("long").alias("fn"),
        F.round(-F.avg(y * F.log(pc) + (1 - y) * F.log(1 - pc)), 6).alias("log_loss"))
    per_score = scored.groupBy(*group, score).agg(
        F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg"))
    rt = running_totals(per_score, group, score, ["neg"])
    auc_num = rt.groupBy(*group).agg(
        F.sum((F.col("pos") * (2 * (F.col("cum_neg") - F.col("neg")) + F.col("neg")))
              .cast("decimal(38,0)")).alias("_auc2"))
    m = conf.join(auc_num, group, "left") if group else conf.withColumn("_auc2", auc_num.scalar())
    P, N = F.col("positives"), F.col("n") - F.col("positives")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return m.select(
        *group, "n", "positives",
        F.when((P > 0) & (N > 0), F.col("_auc2").cast("double") / (2.0 * P * N)).alias("auc"),
        prec.alias("precision"), rec.alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1"),
        "log_loss")


# ----------------------------------------------------------------- F11
def sample_hash(key: str = "user_id") -> F.Column:
    """Portable hash of a key that does not follow ``split_bucket``."""
    return F.pmod(F.pmod(F.col(key), F.lit(1000003)) * 6007 + 17, F.lit(999983))


def fixed_sample(df: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """Deterministic fixed-size sample: the n keys with the smallest hash
    (top-k, planned as TakeOrderedAndProject: per-task top-n then merge). The hash is
    independent of the train/test split, so a sample holds both in their shares."""
    return df.withColumn("_h", sample_hash(key)).orderBy("_h", key).limit(n).drop("_h")


# ----------------------------------------------------------------- surrogate score
def surrogate_score() -> F.Column:
    """Deterministic stand-in for a model's score, used where a check needs fixed
    predictions: round(least(days_since_last_order, 400) / 400, 4)."""
    return F.round(F.least(F.col("days_since_last_order"), F.lit(400)) / F.lit(400.0), 4)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
