"""Quarantine of malformed rows (C10, T25): one pass that types, checks and splits.

``judge`` casts every source column to its declared type, builds the Silver row and
evaluates the table's rules on it. A row's ``broken`` lists the columns whose value did not
cast (``type:<column>``) and the names of the rules it breaks; its source row is kept as
JSON. ``split`` writes judged rows once and returns both sides; ``replay`` mends rejected rows
from their JSON and judges them again. The same functions serve batch and stream (``foreachBatch``:
a batch writes to a folder of its own, so a repeated batch replaces itself).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from martflow.operators import quality, silver


def text_schema(declared: StructType) -> StructType:
    """The declared columns as strings, as a source file holds them."""
    return StructType([StructField(f.name, StringType()) for f in declared.fields])


def judge(raw: DataFrame, name: str, declared: StructType, rules: list[quality.Rule] | None = None) -> DataFrame:
    """Silver columns of ``name`` plus ``broken`` and ``source_row``. ``rules`` default to the
    table's constraints. Columns of ``raw`` that are not declared stay in ``source_row`` only."""
    rules = quality.CONSTRAINTS.get(name, []) if rules is None else rules
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in declared.fields]
    uncast = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f"type:{f.name}"))
              for f in declared.fields]
    ready = raw.select(*typed, F.filter(F.array(*uncast), lambda x: x.isNotNull()).alias(silver.CARRIED[0]),
                       F.to_json(F.struct(*raw.columns)).alias(silver.CARRIED[1]))
    rows = silver.SILVER_BUILDERS[name][1](ready)
    against = [F.when(F.expr(r.violation), F.lit(r.name)) for r in rules]
    checked = F.filter(F.array(*against), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return (rows.withColumn("broken", F.concat(F.col(silver.CARRIED[0]), checked))
            .withColumn("source_row", F.col(silver.CARRIED[1])).drop(*silver.CARRIED))


def split(judged: DataFrame, name: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write judged rows once, by verdict, and read back (accepted Silver rows, rejected rows). Only
    a rejected row's source is read again, so only that is written."""
    spark = judged.sparkSession
    accepted = F.size("broken") == 0
    judged.withColumns({"accepted": accepted, "source_row": F.when(~accepted, F.col("source_row"))}).write.mode("overwrite").partitionBy("accepted").parquet(folder)
    held = spark.read.schema(StructType([*judged.schema.fields, StructField("accepted", BooleanType())])).parquet(folder)
    accepted = held.where("accepted").drop("accepted", "broken", "source_row")
    rejected = held.where("not accepted").select(F.lit(name).alias("table"), "broken", "source_row")
    return accepted, rejected


def replay(rejected: DataFrame, name: str, declared: StructType, mend: Callable[[DataFrame], DataFrame],
           rules: list[quality.Rule] | None = None) -> DataFrame:
    """Rejected rows of ``name``, mended as text columns and judged again."""
    text = rejected.where(F.col("table") == name).select(F.from_json("source_row", text_schema(declared)).alias("row"))
    return judge(mend(text.select("row.*")), name, declared, rules)


def batch_writer(name: str, declared: StructType, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: split every micro-batch under ``folder``/batch=<id>."""
    def write(batch: DataFrame, batch_id: int) -> None:
        split(judge(batch.drop("_ingested_at", "_source_file"), name, declared), name, f"{folder}/batch={batch_id}")
    return write


def reasons(rejected: DataFrame) -> DataFrame:
    """Rejected rows per table and reason (a row counts for each of its reasons)."""
    return (rejected.select("table", F.explode("broken").alias("reason")).groupBy("table", "reason")
            .agg(F.count(F.lit(1)).alias("rows")))
