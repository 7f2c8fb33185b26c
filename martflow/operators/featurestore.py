"""Key-bucketed feature store.

Snapshots lie in folders by key bucket and snapshot day; the latest row of every key
lies by key bucket alone. A lookup computes the buckets of its keys first, so that the scan
prunes all others; ``materialize`` reads only snapshot days after its watermark
and rewrites only the buckets that have new rows.

Defined cases: null keys or times are not stored; of rows of one key at one instant the greatest
counts; unknown keys look up to null features; a range without new snapshots changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.session import path_exists

BUCKETS = 64


@dataclass(frozen=True)
class FeatureStore:
    spark: SparkSession
    root: str
    key: str = "user_id"
    ts: str = "event_timestamp"
    buckets: int = BUCKETS

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def bucket(self, key: Column | None = None) -> Column:
        key = F.col(self.key) if key is None else key
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def append(self, snapshots: DataFrame) -> None:
        """Add snapshot rows under their bucket and day."""
        rows = snapshots.where(F.col(self.key).isNotNull() & F.col(self.ts).isNotNull())
        (rows.withColumn("bucket", self.bucket()).withColumn("day", F.to_date(self.ts))
         .repartition("bucket", "day").write.mode("append").partitionBy("bucket", "day").parquet(self._path("snapshots")))

    def snapshots(self) -> DataFrame:
        return self.spark.read.parquet(self._path("snapshots"))

    def watermark(self) -> datetime | None:
        """Time up to which snapshots are in the latest table."""
        path = self._path("watermark")
        return self.spark.read.parquet(path).first()[0] if path_exists(self.spark, path) else None

    def new_rows(self, until: str) -> DataFrame:
        """Snapshot rows after the watermark and up to ``until``; other days are not read."""
        end = F.to_timestamp_ntz(F.lit(until))
        rows = self.snapshots().where((F.col("day") <= F.to_date(F.lit(until))) & (F.col(self.ts) <= end))
        since = self.watermark()
        if since is not None:
            rows = rows.where((F.col("day") >= F.lit(since.date())) & (F.col(self.ts) > F.lit(since).cast("timestamp_ntz")))
        return rows.drop("day")

    def materialize(self, until: str) -> int:
        """Bring the latest table up to ``until``; returns the number of buckets rewritten."""
        new = self.new_rows(until)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]             # BUCKETS at most
        if touched:
            old = self.latest()
            rows = new if old is None else new.unionByName(old.where(F.col("bucket").isin(touched)))
            held = [c for c in rows.columns if c not in (self.key, "bucket")]
            best = F.max(F.struct(self.ts, *[c for c in held if c != self.ts])).alias("row")
            merged = rows.groupBy("bucket", self.key).agg(best).select("bucket", self.key, *[f"row.{c}" for c in held])
            # The old rows are read while merging, so the result is set aside before it replaces their folders.
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path("merged"))
            self._read("merged", merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "bucket").parquet(self._path("latest"))
        since, end = self.watermark(), datetime.fromisoformat(until)
        if since is None or end > since:
            (self.spark.range(1).select(F.to_timestamp_ntz(F.lit(until)).alias("until")).coalesce(1)
             .write.mode("overwrite").parquet(self._path("watermark")))
        return len(touched)

    def _read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self._path(name))

    def latest(self) -> DataFrame | None:
        path = self._path("latest")
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    def lookup(self, keys: list, features: list[str]) -> DataFrame:
        """One row per key asked for; only the keys' buckets are scanned."""
        asked = self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], self.snapshots().select(self.key).schema)
        places = [r[0] for r in asked.select(self.bucket()).distinct().collect()]        # one per key at most
        found = self.latest().where(F.col("bucket").isin(places)).select(self.key, *features)
        return asked.join(found, self.key, "left")
