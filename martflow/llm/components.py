"""Connected components of a link table by alternating star contractions.

Every round is two joins with pre-aggregated minima, written to the shared
folder; nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.common import stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.where("b > a").join(least, "a").where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(a, b): b is the least node that a can reach; least nodes are left out.
    ``links`` has columns a and b of any order; loops are ignored. The result of an
    earlier call may stand for the links that it came from."""
    e = stage(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .distinct(), "links")
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(e)
    while seen[0]:
        e = stage(spark, _small_star(_large_star(e)), "links")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e
