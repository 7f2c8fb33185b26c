"""Mixing sources to target weights by entropy balancing (operator 8).

Document rates ``r_i = exp(lambda_source)`` minimise the relative entropy to
the corpus under one token constraint per source. The convex dual
``sum_i size_i * exp(lambda_s(i)) - sum_s lambda_s * target_s`` is minimised by
Newton iterations: each is one aggregation of tilted sizes per source and one
update of the multipliers. Rates are then rounded into whole copies.

All steps are DataFrame functions. Sums run over classes of equal (source,
size), which are pre-aggregated counts of the documents, so a hot source
costs each iteration no more than its distinct sizes.

Rounding: classes stand in descending size; of those up to a class,
``round(rate * documents)`` copies are taken, and what the words so taken
still lack (or exceed) is made up by whole copies in the largest classes that
fit, so a source ends within its smallest documents of the target. Inside a
class copies are spread evenly by hash rank; no document gets more than
MAX_REPEAT. The rank is made in hash buckets of about ``BUCKET_ROWS`` rows, so a
class that holds a third of all rows is no single task.

Defined cases: null text has size 0; a null source is a source of its own,
ordered last; repeated rows are separate documents (each has its own rank);
with no words at all every target and every taken is 0; an empty table gives
an empty result; other columns are kept and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martflow.llm.common import keeps_columns, read_table, stage

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3.0
TOLERANCE = 1e-9
MAX_NEWTON = 60
BUCKET_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(classes: DataFrame) -> DataFrame:
    """(source, total, target): shares by weight, stopped at MAX_REPEAT times
    the source's words; the excess goes to the others by weight. One row per
    source, so its windows are small."""
    src = classes.groupBy("mx_source").agg(F.sum(F.col("mx_size") * F.col("mx_n")).alias("mx_total"))
    rank = F.row_number().over(Window.orderBy(F.col("mx_source").asc_nulls_last()))
    src = (src.withColumn("mx_rank", rank)
           .withColumn("mx_w", F.element_at(F.array(*map(F.lit, WEIGHTS)),
                                            ((F.col("mx_rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
           .withColumn("mx_cap", F.col("mx_total") * F.lit(MAX_REPEAT)))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = (Window.orderBy(F.col("mx_cap") / F.col("mx_w"), "mx_rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    level = ((F.col("mx_all") - F.coalesce(F.sum("mx_cap").over(before), F.lit(0.0)))
             / (F.col("mx_all_w") - F.coalesce(F.sum("mx_w").over(before), F.lit(0.0))))
    src = (src.withColumn("mx_all", F.sum("mx_total").over(everything).cast("double"))
           .withColumn("mx_all_w", F.sum("mx_w").over(everything)))
    src = src.withColumn("mx_level", level)
    # The level rises while sources are capped and is highest at the first that is not.
    return (src.withColumn("mx_top", F.max("mx_level").over(everything))
            .select("mx_source", "mx_total",
                    F.least("mx_cap", F.col("mx_w") * F.col("mx_top")).alias("mx_target")))


def solve_dual(spark: SparkSession, classes: DataFrame, targets: DataFrame) -> DataFrame:
    """Multiplier of each source by Newton iterations on the dual. Sources
    without words keep multiplier 0."""
    state = stage(spark, targets.withColumn("mx_lam", F.lit(0.0)), "mix-newton")
    for _ in range(MAX_NEWTON):
        lam = state.select(F.col("mx_source").alias("k"), "mx_lam")
        tilted = (classes.join(lam, F.col("mx_source").eqNullSafe(F.col("k")))
                  .groupBy("mx_source")
                  .agg(F.sum(F.col("mx_n") * F.col("mx_size") * F.exp("mx_lam")).alias("mx_sum"))
                  .select(F.col("mx_source").alias("k"), "mx_sum"))
        grad = F.col("mx_sum") - F.col("mx_target")
        step = F.when(F.col("mx_sum") > 0, grad / F.col("mx_sum")).otherwise(0.0)   # the Hessian is diagonal
        state = stage(spark, state.join(tilted, F.col("mx_source").eqNullSafe(F.col("k")))
                      .select("mx_source", "mx_total", "mx_target",
                              (F.col("mx_lam") - step).alias("mx_lam"), F.abs(step).alias("mx_step")), "mix-newton")
        worst = state.agg(F.max("mx_step")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state.drop("mx_step")


def mix(spark: SparkSession, rows: DataFrame, classes_from: DataFrame | None = None) -> DataFrame:
    """``rows`` (with mx_source, mx_size and mx_hash, see ``sized``) plus
    mx_total, mx_target, mx_rate and mx_copies."""
    classes = stage(spark, (classes_from if classes_from is not None else rows)
                    .groupBy("mx_source", "mx_size").agg(F.count(F.lit(1)).alias("mx_n")), "mix-classes")
    state = solve_dual(spark, classes, source_targets(classes))
    rate = F.least(F.exp("mx_lam"), F.lit(MAX_REPEAT))
    near = F.round(rate)
    larger = (Window.partitionBy("mx_source").orderBy(F.col("mx_size").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum("mx_n").over(larger), F.lit(0))
    plan = (classes.withColumn("mx_before", before)
            .join(state.withColumnRenamed("mx_source", "k"), F.col("mx_source").eqNullSafe(F.col("k"))).drop("k")
            .withColumn("mx_rate", F.when(F.abs(rate - near) < 1e-7, near).otherwise(rate))
            .withColumn("mx_take", (F.round((F.col("mx_before") + F.col("mx_n")) * F.col("mx_rate"))
                                    - F.round(F.col("mx_before") * F.col("mx_rate"))).cast("long"))
            .select(F.col("mx_source").alias("mx_ks"), F.col("mx_size").alias("mx_kz"), "mx_n", "mx_total", "mx_target",
                    "mx_rate", F.least("mx_take", F.col("mx_n") * int(MAX_REPEAT)).alias("mx_take")))
    plan = stage(spark, plan, "mix-take")
    made_up = made_up_copies(plan)
    plan = (plan.join(made_up, F.col("mx_ks").eqNullSafe(F.col("as")) & (F.col("mx_kz") == F.col("az")), "left")
            .withColumn("mx_take", F.col("mx_take") + F.coalesce("more", F.lit(0)))
            .withColumn("mx_buckets", F.ceil(F.col("mx_n") / F.lit(BUCKET_ROWS)).cast("long"))
            .drop("as", "az", "more"))
    plan = stage(spark, plan, "mix-plan")
    on = F.col("mx_source").eqNullSafe(F.col("mx_ks")) & (F.col("mx_size") == F.col("mx_kz"))
    bucket = F.pmod("mx_hash", "mx_buckets")

    # Counts of each bucket, hence the rank at which the bucket begins.
    counted = ((classes_from if classes_from is not None else rows)
               .select("mx_source", "mx_size", "mx_hash").join(plan.where("mx_buckets > 1"), on)
               .groupBy("mx_ks", "mx_kz", bucket.alias("mx_kb")).agg(F.count(F.lit(1)).alias("c")))
    begins = (counted.withColumn("mx_begin", F.coalesce(F.sum("c").over(
        Window.partitionBy("mx_ks", "mx_kz").orderBy("mx_kb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("mx_ks").alias("mx_bs"), F.col("mx_kz").alias("mx_bz"), "mx_kb", "mx_begin"))
    in_bucket = Window.partitionBy("mx_source", "mx_size", "mx_bucket").orderBy("mx_hash")
    upto = lambda i: F.expr(f"({i} * mx_take) div mx_n")
    return (rows.join(plan, on).drop("mx_ks", "mx_kz")
            .withColumn("mx_bucket", bucket)
            .join(begins, F.col("mx_source").eqNullSafe(F.col("mx_bs")) & (F.col("mx_size") == F.col("mx_bz"))
                  & (F.col("mx_bucket") == F.col("mx_kb")), "left")
            .withColumn("mx_i", F.coalesce("mx_begin", F.lit(0)) + F.row_number().over(in_bucket))
            .withColumn("mx_copies", (upto("mx_i") - upto("(mx_i - 1)")).cast("int"))
            .drop("mx_bs", "mx_bz", "mx_kb", "mx_begin", "mx_bucket", "mx_buckets", "mx_n", "mx_take", "mx_i"))


def made_up_copies(plan: DataFrame) -> DataFrame:
    """(as, az, more): copies by which classes make up what their source's
    words still lack or exceed, from the largest class that fits downwards.
    Folds each source's distinct sizes, which are far fewer than its rows."""
    most = int(MAX_REPEAT)
    per = (plan.where("mx_kz > 0").groupBy("mx_ks")
           .agg(F.first("mx_target").alias("target"), F.sum(F.col("mx_kz") * F.col("mx_take")).alias("taken"),
                F.sort_array(F.collect_list(F.struct("mx_kz", "mx_n", "mx_take")), asc=False).alias("classes")))
    none = F.array().cast("array<struct<az:bigint,more:bigint>>")

    def step(acc, c):
        fit = (acc["rest"] / c["mx_kz"]).cast("long")                   # towards 0
        more = F.greatest(-c["mx_take"], F.least(fit, c["mx_n"] * most - c["mx_take"]))
        return F.when(more == 0, acc).otherwise(F.struct(
            (acc["rest"] - more * c["mx_kz"]).alias("rest"),
            F.concat(acc["made"], F.array(F.struct(c["mx_kz"].alias("az"), more.alias("more")))).alias("made")))

    start = F.struct((F.col("target") - F.col("taken")).alias("rest"), none.alias("made"))
    return (per.select(F.col("mx_ks").alias("as"), F.explode(F.aggregate("classes", start, step)["made"]).alias("m"))
            .select("as", "m.az", "m.more"))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` plus mx_source, mx_size (words) and mx_hash (tie order)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"mx_source": F.col("source"),
                             "mx_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
                             "mx_hash": F.xxhash64("doc_id", "text")})


def op8_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies."""
    docs = read_table(spark, sf_dir, "documents")
    narrow = stage(spark, sized(docs).select("doc_id", "mx_source", "mx_size", "mx_hash"), "mix-sizes")
    return mix(spark, narrow).select(
        "doc_id", F.col("mx_size").alias("size"), F.col("mx_total").alias("source_size"),
        F.col("mx_target").alias("target"), (F.col("mx_copies") * F.col("mx_size")).alias("taken"),
        F.col("mx_copies").alias("copies"))


@keeps_columns
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it."""
    columns = docs.columns
    rows = sized(docs)
    narrow = stage(spark, rows.select("mx_source", "mx_size", "mx_hash"), "mix-sizes")
    mixed = mix(spark, rows, narrow).where("mx_copies > 0")
    return (mixed.withColumn("mx_k", F.explode(F.sequence(F.lit(1), F.col("mx_copies"))))
            .select(*[F.col(f"`{c}`") for c in columns]))
