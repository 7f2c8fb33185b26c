"""Running sums without a single-partition window.

A cumulative sum over a whole column (CDFs for Wasserstein, negatives
below a score for AUC) written as ``sum(...).over(orderBy(v))`` moves every
row into one task. ``running_totals`` splits the order axis into quantile
cells (global edges, a scalar subquery), and every cell into as many equal
steps as its row count asks for, so the number of buckets follows the data.
Bucket totals are prefix-summed on a small (partition, bucket) table, then
each bucket runs its own window and adds its offset. NULL partition keys are a
partition like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 64
BUCKET_ROWS = 50_000


def _same(keys: list[str], alias: dict[str, str]):
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(alias[k])) for k in keys])


def running_totals(df: DataFrame, part: list[str], order: str, cols: list[str],
                   bucket_rows: int = BUCKET_ROWS, accuracy: int = 10000) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum of ``c`` by ascending ``order``
    within ``part``) and ``next_<order>`` (the next larger order value).

    ``order`` values must be distinct within a partition (aggregate first).
    """
    out_cols = list(df.columns)
    qs = [i / CELLS for i in range(1, CELLS)]
    edges = df.select(F.percentile_approx(order, qs, accuracy)).scalar()
    x = (df.withColumn("_edges", edges)
         .withColumn("_c", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges"))

    key = [*part, "_c"]
    alias = {k: f"_k{i}" for i, k in enumerate([*key, "_b"])}
    renamed = [F.col(k).alias(alias[k]) for k in key]
    cells = x.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket_rows)).alias("_steps"),
                                F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    x = x.join(cells.select(*renamed, "_steps", "_lo", "_hi"), _same(key, alias)).drop(*[alias[k] for k in key])
    step = F.floor((F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_steps"))
    x = x.withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.least(step, F.col("_steps") - 1))
                     .otherwise(F.lit(0)).cast("long")).drop("_steps", "_lo", "_hi")

    key = [*key, "_b"]
    w_b = Window.partitionBy(*part).orderBy("_c", "_b")
    btot = x.groupBy(*key).agg(*[F.sum(c).alias(f"_bt_{c}") for c in cols], F.min(order).alias("_bmin"))
    btot = btot.select(
        *[F.col(k).alias(alias[k]) for k in key],
        *[F.coalesce(F.sum(f"_bt_{c}").over(w_b.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"_off_{c}") for c in cols],
        F.lead("_bmin").over(w_b).alias("_next_bmin"))
    x = x.join(btot, _same(key, alias))
    w_in = Window.partitionBy(*key).orderBy(order)
    run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.select(
        *out_cols,
        *[(F.col(f"_off_{c}") + F.sum(c).over(run)).alias(f"cum_{c}") for c in cols],
        F.coalesce(F.lead(order).over(w_in), F.col("_next_bmin")).alias(f"next_{order}"))


def dense_rank_desc(df: DataFrame, part: list[str], order: str, out: str) -> DataFrame:
    """``dense_rank() OVER (PARTITION BY part ORDER BY order DESC NULLS LAST)``
    without a window over whole partitions.

    A partition with few keys (e.g. a handful of categories) would put a
    large share of all rows into one sort. Instead: distinct (part, value)
    pairs get their rank from bucketed running counts; NULL values rank
    after every value of their partition; the ranks join back on
    (part, value), partition keys matched null-safely.
    """
    alias = {c: f"_rk_{c}" for c in part}
    vals = (df.select(*[F.col(c).alias(alias[c]) for c in part], F.col(order).alias("_v"))
            .filter(F.col("_v").isNotNull()).distinct()
            .withColumns({"_neg": -F.col("_v"), "_one": F.lit(1)}))
    ap = list(alias.values())
    ranked = running_totals(vals, ap, "_neg", ["_one"]).select(
        *ap, "_v", F.col("cum__one").cast("int").alias(out))
    n_vals = vals.groupBy(*ap).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    cond = [F.col(c).eqNullSafe(F.col(alias[c])) for c in part]
    joined = df.join(ranked, cond + [F.col(order) == F.col("_v")], "left").drop(*ap, "_v")
    joined = joined.join(n_vals, cond, "left").drop(*ap)
    return joined.withColumn(out, F.coalesce(F.col(out), F.coalesce(F.col("_n"), F.lit(0)) + 1)).drop("_n")
