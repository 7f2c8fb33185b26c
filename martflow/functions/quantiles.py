"""Exact order statistics by refining histograms.

``percentile`` keeps every distinct value of a group in one buffer, and a sketch is
exact only while it holds them all. Here a wanted rank owns an interval that
holds it, at first the whole range of its group. A round cuts every interval
at up to ``CUTS`` of its own approximate quantiles (a sketch of fixed size), counts the rows
of each open range and of each cut itself, and keeps the range or cut that holds the rank,
shrunk to the least and largest value met in it, until that is one value. Each
round leaves an open range some 1/CUTS of the values and a cut that many rows share is
a value of its own, so ties and skew cannot stall it: rounds grow with the
logarithm (base CUTS) of the distinct values.

Every step is an aggregate with partial aggregation; what is kept between rounds is one
row per wanted rank, written to the shared folder as a lineage cut. Intervals of a group are
equal or apart, so a row meets at most one of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from martflow.session import scratch_path

CUTS = 128
#: Of the sketch that proposes cuts; it decides how fast ranges shrink, never the result.
ACCURACY = 2000


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]],
                     weight: str | None = None) -> DataFrame:
    """(``by``, ``name``, ``value``): per group and name the value at the 1-based
    rank ``ranks[name](n)`` among the group's n non-null values in ascending order.

    ``weight`` counts a row that many times. Groups without values and ranks out of 1..n
    have no row. NULL group keys are a group of their own. The input is read some times per round.
    """
    spark = df.sparkSession
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = (df.select(group.alias("g"), F.col(value).cast("double").alias("v"),
                      (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
            .where(F.col("v").isNotNull() & (F.col("w") > 0)))
    folder = scratch_path(spark, f"quantiles/{uuid.uuid4().hex}")

    def kept(state: DataFrame, round_: int) -> tuple[DataFrame, int]:
        """The written state and how many of its intervals are still open."""
        path, seen = f"{folder}/{round_}", Observation()
        state.observe(seen, F.count_if(F.col("lo") < F.col("hi")).alias("open")).write.parquet(path)
        return spark.read.schema(state.schema).parquet(path), seen.get["open"]

    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), fn(F.col("n")).cast("long").alias("rank"))
                                 for k, fn in ranks.items()]))
    state = (rows.groupBy("g").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
             .select("g", wanted.alias("want"), F.lit(0).cast("long").alias("before"), "lo", "hi", "n")
             .where(F.col("want.rank").between(1, F.col("n")))
             .select("g", "want.name", "want.rank", "before", "lo", "hi"))
    state, open_ = kept(state, 0)
    round_ = 0
    while open_:
        round_ += 1
        cells = state.where("lo < hi").select(F.col("g").alias("cg"), "lo", "hi").distinct()
        inside = rows.join(cells, (F.col("g") == F.col("cg")) & F.col("v").between(F.col("lo"), F.col("hi")))
        shares = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
        cuts = inside.groupBy("cg", "lo", "hi").agg(
            F.array_distinct(F.percentile_approx("v", shares, ACCURACY)).alias("cuts"))
        # Written, so that their measured size decides the join: a size guessed from the rows would send all
        # rows of a group to one task.
        cuts.write.parquet(f"{folder}/cuts_{round_}")
        cuts = spark.read.schema(cuts.schema).parquet(f"{folder}/cuts_{round_}")
        # Even numbers are open ranges, odd ones the cuts between them.
        below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        cell = (rows.join(cuts, (F.col("g") == F.col("cg")) & F.col("v").between(F.col("lo"), F.col("hi")))
                .groupBy("cg", F.col("lo").alias("clo"), (2 * below + F.array_contains("cuts", F.col("v")).cast("int")).alias("bin"))
                .agg(F.sum("w").alias("c"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi")))
        upto = Window.partitionBy("cg", "clo").orderBy("bin")                 # at most 2 CUTS + 1 rows
        cell = cell.withColumn("upto", F.sum("c").over(upto))
        found = (state.where("lo < hi").join(cell, (F.col("g") == F.col("cg")) & (F.col("lo") == F.col("clo"))
                 & (F.col("before") + F.col("upto") >= F.col("rank")) & (F.col("before") + F.col("upto") - F.col("c") < F.col("rank")))
                 .select("g", "name", "rank", (F.col("before") + F.col("upto") - F.col("c")).alias("before"),
                         F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi")))
        state, open_ = kept(found.unionByName(state.where("not lo < hi")), round_)
    return state.select(*[F.col(f"g.{k}").alias(k) for k in by], "name", F.col("lo").alias("value"))


def discrete_rank(share: float) -> Callable[[Column], Column]:
    """Rank of the least value that at least ``share`` of the values do not exceed."""
    return lambda n: F.greatest(F.lit(1), n - F.floor(n - n * F.lit(float(share))))


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float],
                    weight: str | None = None) -> DataFrame:
    """One row per group with a column per name in ``shares`` (discrete quantiles)."""
    found = order_statistics(df, by, value, {k: discrete_rank(s) for k, s in shares.items()}, weight)
    return _wide(found, by, list(shares))


def interpolated_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float],
                           weight: str | None = None) -> DataFrame:
    """As ``exact_quantiles``, with linear interpolation between the two nearest ranks."""
    ranks = {}
    for k, s in shares.items():
        at = lambda n, s=s: (n - 1) * F.lit(float(s))                      # noqa: E731
        ranks[f"{k} low"] = lambda n, at=at: F.floor(at(n)) + 1
        ranks[f"{k} high"] = lambda n, at=at: F.ceil(at(n)) + 1
    found = order_statistics(df, by, value, ranks, weight)
    total = F.sum(weight) if weight else F.count(value)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(total.alias("_n"))
    names = list(ranks)
    wide = _wide(found, by, names)
    if by:
        alias = [F.col(k).alias(f"_s_{k}") for k in by]
        sizes = sizes.select(*alias, "_n")
        match = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in by]
        both = wide.join(sizes, match)
    else:
        both = wide.withColumn("_n", sizes.select("_n").scalar())
    out = []
    for k, s in shares.items():
        at = (F.col("_n") - 1) * F.lit(float(s))
        low, high = F.col(f"`{k} low`"), F.col(f"`{k} high`")
        out.append((low + (at - F.floor(at)) * (high - low)).alias(k))
    return both.select(*by, *out)


def _wide(found: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in names])
