"""Gold tables kept by month and refreshed by what arrived.

Silver rows lie under ``lines`` and ``events`` by month and by the number of the load that brought
them, so a refresh finds the months to redo from the folders of loads after its
watermark and reads no other. A month's rows are rebuilt from all its loads, by the
builders of the full tables, and replace its folder (dynamic partition
overwrite); months that are left without rows lose their folder.

Two things reach beyond a month:

* a user's change of sessions refers to the user's month before. Users with new, changed or withdrawn
  events get the change anew from the narrow (user, month, sessions) columns of Gold; months in which
  one of their rows differs then are rewritten with that column replaced (no event is read for them);
* a shipment belongs to its product's centre. The products' centres of the last refresh are kept; months
  with lines of products that came, went or moved are redone.

The watermark is written last and all steps before follow from the loads, so a refresh that was cut
off is simply run again.

Defined cases: of versions of one id in a month the one of the latest load counts (within a load,
the greatest row); a version with ``withdrawn`` true takes the id out of that month, which is how a row moves to
another month. Rows without a time have a month of their own (null). A refresh without new loads
and with the same products rewrites nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType, TimestampNTZType

from martflow.config import DEFAULT, Config
from martflow.functions.exprs import month_start
from martflow.operators import facts, gold
from martflow.operators.silver import SILVER_SCHEMAS
from martflow.session import path_exists

#: stored Silver table -> (Silver name, id)
STORED = {"lines": ("order_items_clean", "order_item_id"), "events": ("events_clean", "event_id")}
ABOUT = ["product_id", "distribution_center_id", "distribution_center_name"]


def in_months(column: str, months: list) -> Column:
    """Whether a month column is one of ``months`` (None among them: rows without a time)."""
    named = F.col(column).isin([m for m in months if m is not None])
    return F.when(F.col(column).isNull(), F.lit(None in months)).otherwise(named)


@dataclass
class MonthlyGold:
    """Monthly Gold tables under ``root``. Months and loads are few (folders); all that is collected is lists of them."""
    spark: SparkSession
    root: str
    cfg: Config = field(default_factory=lambda: DEFAULT)

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _has(self, name: str) -> bool:
        return path_exists(self.spark, self._path(name))

    # ---------------------------------------------------------- Silver by month and load
    def append(self, name: str, rows: DataFrame, load: int) -> None:
        """Store Silver rows of a load (and optional ``withdrawn``). A load that is stored again replaces itself."""
        schema = SILVER_SCHEMAS[STORED[name][0]]
        gone = F.coalesce(F.col("withdrawn"), F.lit(False)) if "withdrawn" in rows.columns else F.lit(False)
        (rows.select(*schema.fieldNames(), gone.alias("withdrawn"), month_start("created_at").alias("month"),
                     F.lit(load).alias("load"))
         .hint("rebalance", F.col("month")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("load", "month").parquet(self._path(name)))

    def stored(self, name: str) -> DataFrame:
        schema = SILVER_SCHEMAS[STORED[name][0]]
        whole = StructType([*schema.fields, StructField("withdrawn", BooleanType()), StructField("load", IntegerType()),
                            StructField("month", TimestampNTZType())])
        if not self._has(name):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self._path(name))

    def current(self, name: str, months: list) -> DataFrame:
        """Silver rows of ``months``: the latest version of every id."""
        silver_name, key = STORED[name]
        columns = SILVER_SCHEMAS[silver_name].fieldNames()
        newest = F.max(F.struct("load", "withdrawn", *[c for c in columns if c != key])).alias("v")
        return (self.stored(name).where(in_months("month", months)).groupBy("month", key).agg(newest)
                .where(~F.col("v.withdrawn")).select(*[key if c == key else F.col(f"v.{c}").alias(c) for c in columns]))

    # ---------------------------------------------------------- watermark
    def watermark(self) -> int:
        """Number of the last load that Gold holds (-1: none)."""
        return self.spark.read.parquet(self._path("watermark")).first()[0] if self._has("watermark") else -1

    def _months(self, df: DataFrame, column: str = "month") -> list:
        return [r[0] for r in df.select(column).distinct().collect()]

    def new_months(self, name: str) -> list:
        """Months that loads after the watermark touch."""
        return self._months(self.stored(name).where(F.col("load") > self.watermark()))

    # ---------------------------------------------------------- Gold by month
    def table(self, name: str) -> DataFrame:
        """``fulfillment_metrics`` or ``funnel_analytics`` as refreshed last."""
        return self.spark.read.schema(self._schemas()[name]).parquet(self._path(name)).select(*self._schemas()[name].fieldNames())

    def _schemas(self) -> dict[str, StructType]:
        empty = {n: self.spark.createDataFrame([], s) for n, s in SILVER_SCHEMAS.items()}
        return {"fulfillment_metrics": gold.fulfillment_metrics(empty, self.cfg).schema,
                "funnel_analytics": gold.funnel_analytics(facts.facts(empty, self.cfg), self.cfg).schema}

    def _replace(self, name: str, by: str, rows: DataFrame, months: list) -> None:
        """Put ``rows`` in place of ``months``. Rows may come from the table itself, so they are set aside first."""
        aside = self._path(f"{name}_aside")
        rows.write.mode("overwrite").parquet(aside)
        held = self.spark.read.schema(rows.schema).parquet(aside)
        # Rebalanced by size: small months share a task, a large one is split.
        (held.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(by).parquet(self._path(name)))
        left = set(self._months(held, by))
        emptied = [m for m in months if m not in left]
        for folder in self._folders(name, by, emptied) if emptied else []:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(folder))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _folders(self, name: str, by: str, months: list) -> list[str]:
        """The folders of ``months``, as the files in them name them."""
        files = (self.spark.read.schema(self._schemas()[name]).parquet(self._path(name)).where(in_months(by, months))
                 .select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")))
        return self._months(files, "folder")

    # ---------------------------------------------------------- refresh
    def refresh(self, products: DataFrame, centres: DataFrame) -> dict[str, list]:
        """Bring both tables up to the loads stored; returns the months rewritten per table
        (``sessions_change`` holds those of ``funnel_analytics`` in which only that column changed)."""
        through = self._last_load()
        done = {"fulfillment_metrics": self._refresh_fulfilment(products, centres)}
        done["funnel_analytics"], done["sessions_change"] = self._refresh_funnel()
        if through > self.watermark():
            (self.spark.range(1).select(F.lit(through).alias("load")).coalesce(1)
             .write.mode("overwrite").parquet(self._path("watermark")))
        return done

    def _last_load(self) -> int:
        both = self.stored("lines").select("load").union(self.stored("events").select("load"))
        last = both.agg(F.max("load")).first()[0]
        return -1 if last is None else last

    def _refresh_fulfilment(self, products: DataFrame, centres: DataFrame) -> list:
        name = F.col("name").alias("distribution_center_name")
        about = (products.select("product_id", "distribution_center_id")
                 .join(centres.select("distribution_center_id", name), "distribution_center_id").select(*ABOUT))
        about.write.mode("overwrite").parquet(self._path("about_aside"))
        about = self.spark.read.schema(about.schema).parquet(self._path("about_aside"))
        months = set(self.new_months("lines"))
        if self._has("about"):
            old = self.spark.read.schema(about.schema).parquet(self._path("about"))
            moved = (about.withColumn("side", F.lit(1)).union(old.withColumn("side", F.lit(-1)))
                     .groupBy(*ABOUT).agg(F.sum("side").alias("side")).where("side <> 0").select("product_id"))
            months |= set(self._months(self.stored("lines").join(moved, "product_id", "left_semi")))
        if months or not self._has("fulfillment_metrics"):
            silver = {"order_items_clean": self.current("lines", list(months)), "products_clean": products,
                      "distribution_centers_clean": centres}
            self._replace("fulfillment_metrics", "order_month", gold.fulfillment_metrics(silver, self.cfg), list(months))
        about.write.mode("overwrite").parquet(self._path("about"))
        return sorted(months, key=str)

    def _touched_users(self, months: list) -> DataFrame:
        """Users with an event in new loads, and those of earlier versions of these events."""
        events = self.stored("events").where(in_months("month", months))
        new = events.where(F.col("load") > self.watermark()).select("event_id").distinct()
        return events.join(new, "event_id", "left_semi").where(F.col("user_id").isNotNull()).select("user_id").distinct()

    def _refresh_funnel(self) -> tuple[list, list]:
        months = self.new_months("events")
        first = not self._has("funnel_analytics")
        if not months and not first:
            return [], []
        fresh = gold.funnel_rows(facts.session_months(self.current("events", months)))
        columns = self._schemas()["funnel_analytics"].fieldNames()
        if first:
            rows = fresh.withColumn("sessions_mom_change", gold.sessions_change()).select(*columns)
            self._replace("funnel_analytics", "event_month", rows, months)
            return sorted(months, key=str), []
        fresh.write.mode("overwrite").parquet(self._path("funnel_fresh"))
        fresh = self.spark.read.schema(fresh.schema).parquet(self._path("funnel_fresh"))
        keep = self.table("funnel_analytics").where(~in_months("event_month", months))
        narrow = ["user_id", "event_month", "sessions"]
        # Users of a redone month need their change anew; all others keep what Gold holds.
        users = self._touched_users(months).union(fresh.select("user_id")).distinct()
        history = (fresh.select(*narrow, F.lit(None).cast("long").alias("was"), F.lit(True).alias("fresh"))
                   .union(keep.select(*narrow, F.col("sessions_mom_change").alias("was"), F.lit(False).alias("fresh"))
                          .join(users, "user_id", "left_semi")))
        change = history.withColumn("change", gold.sessions_change()).where(
            F.col("fresh") | ~F.col("change").eqNullSafe(F.col("was"))).select("user_id", "event_month", "change", "fresh")
        change.write.mode("overwrite").parquet(self._path("funnel_change"))
        change = self.spark.read.schema(change.schema).parquet(self._path("funnel_change"))
        rippled = self._months(change.where("not fresh"), "event_month")
        change = change.withColumnsRenamed({"user_id": "u", "event_month": "m"})
        same = F.col("user_id").eqNullSafe(F.col("u")) & F.col("event_month").eqNullSafe(F.col("m"))
        redone = fresh.join(change.where("fresh"), same).withColumnRenamed("change", "sessions_mom_change")
        mended = (keep.where(in_months("event_month", rippled)).join(change.where("not fresh"), same, "left")
                  .withColumn("sessions_mom_change", F.when(F.col("fresh").isNull(), F.col("sessions_mom_change"))
                              .otherwise(F.col("change"))))
        self._replace("funnel_analytics", "event_month", redone.select(*columns).union(mended.select(*columns)), [*months, *rippled])
        return sorted(months, key=str), sorted(rippled, key=str)
