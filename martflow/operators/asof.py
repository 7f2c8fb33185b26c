"""Point-in-time feature retrieval.

E11 ``asof_join``: for every entity row (key, ts) the latest feature row of
the same key with ``feature_ts <= ts`` and not older than the TTL; left
semantics (no match or expired -> NULL features).

No pair expansion: entity times and feature times of a key are unioned as
narrow (key, time) rows and swept in time order with ``last(...,
ignorenulls)``. The sweep runs per (key, day); the last feature time of every
earlier day is carried in through a small (key, day) table, so a key's work is spread
over its days whatever its share of the rows. The feature columns are
fetched once, by (key, matched time), at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(entities: DataFrame, features: DataFrame, key: str = "user_id",
              entity_ts: str = "event_timestamp", feature_ts: str = "event_timestamp",
              ttl_days: int | None = 365) -> DataFrame:
    """As-of join (see module doc). Several feature rows of one key at the same
    instant count as their greatest (deterministic); an entity row sees feature rows
    of its own instant; a null key or time matches nothing."""
    feat_cols = [c for c in features.columns if c not in (key, feature_ts)]
    latest = (features.filter(F.col(key).isNotNull() & F.col(feature_ts).isNotNull())
              .groupBy(F.col(key).alias("_fk"), F.col(feature_ts).alias("_fts"))
              .agg(F.max(F.struct(*feat_cols)).alias("_row")))
    f_rows = features.select(F.col(key).alias("_k"), F.col(feature_ts).alias("_ts"),
                             F.col(feature_ts).alias("_f"), F.lit(False).alias("_e"))
    e_rows = entities.select(F.col(key).alias("_k"), F.col(entity_ts).alias("_ts"),
                             F.lit(None).cast(features.schema[feature_ts].dataType).alias("_f"),
                             F.lit(True).alias("_e"))
    rows = (f_rows.unionByName(e_rows).filter(F.col("_k").isNotNull() & F.col("_ts").isNotNull()).distinct()
            .withColumn("_b", F.to_date("_ts")))

    # 1) sweep inside each (key, day); at one instant feature rows come first
    w_local = (Window.partitionBy("_k", "_b").orderBy("_ts", "_e")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = rows.withColumn("_local", F.last("_f", ignorenulls=True).over(w_local))

    # 2) carry-in: the last feature time of the days before, one row per (key, day)
    w_prev = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.groupBy(F.col("_k"), F.col("_b")).agg(F.max("_f").alias("_last"))
             .select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), F.max("_last").over(w_prev).alias("_carry")))
    hit = (swept.filter("_e").join(carry, (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb")))
           .select("_k", "_ts", F.coalesce("_local", "_carry").alias("_hit")))
    if ttl_days is not None:
        hit = hit.filter(F.col("_hit") >= F.col("_ts") - F.make_dt_interval(days=F.lit(ttl_days)))
    found = (hit.join(latest, (F.col("_k") == F.col("_fk")) & (F.col("_hit") == F.col("_fts")))
             .select("_k", "_ts", *[F.col(f"_row.{c}").alias(f"_v_{c}") for c in feat_cols]))
    on = (F.col(f"_ent.{key}") == F.col("_k")) & (F.col(f"_ent.{entity_ts}") == F.col("_ts"))
    ent = entities.select(F.struct(*entities.columns).alias("_ent"))
    return ent.join(found, on, "left").select(
        *[F.col(f"_ent.{c}").alias(c) for c in entities.columns], *[F.col(f"_v_{c}").alias(c) for c in feat_cols])


def materialize_latest(features: DataFrame, start: str, end: str, key: str = "user_id",
                       ts: str = "event_timestamp") -> DataFrame:
    """Latest feature row per key among rows with ts in [start, end]."""
    cols = [c for c in features.columns if c != key]
    in_range = features.filter((F.col(ts) >= F.to_timestamp_ntz(F.lit(start)))
                               & (F.col(ts) <= F.to_timestamp_ntz(F.lit(end))))
    latest = (in_range.groupBy(key)
              .agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), F.struct(*cols))).alias("_r")))
    return latest.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def online_lookup(store: DataFrame, keys: DataFrame, features: list[str],
                  key: str = "user_id") -> DataFrame:
    """Bulk key lookup of a feature subset; unknown keys give NULLs.
    Spark broadcasts the key list only when its measured size allows."""
    return keys.select(key).join(store.select(key, *features), key, "left")
