"""Sources and sinks: parquet scans, the layered lake, exports, manifests.

A1  read_source            parquet scan (optionally with a declared schema)
A2  Lake.table             scan of a named layer table
A4  Lake.write             overwrite sink (parquet by default, format is config)
A6  export_snapshot        single-file export for small Gold tables
A7  write_manifest         manifest as a one-row nested DataFrame -> JSON
A8  verify_export          source count vs re-read count, one aggregate each
A9  extract                any Spark reader -> parquet / csv for chosen tables
A10 register_views         Gold snapshots + predictions as SQL views
A11 table_catalog          (table, row_count) via one union of count aggregates
A12 write_summary_json / read_summary_json
A13 preview                filter -> order -> limit
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_source(spark: SparkSession, directory: str, name: str,
                schema: StructType | None = None) -> DataFrame:
    """A1: parquet scan of ``directory/name.parquet``; filters and projections
    applied later are pushed into this scan by Catalyst."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(os.path.join(directory, f"{name}.parquet"))


@dataclass
class Lake:
    """A2/A4: layered storage (bronze / silver / gold) under one root path."""
    spark: SparkSession
    root: str
    fmt: str = "parquet"
    partition_by: dict = field(default_factory=dict)

    def path(self, layer: str, name: str) -> str:
        return os.path.join(self.root, layer, name)

    def table(self, layer: str, name: str) -> DataFrame:
        return self.spark.read.format(self.fmt).load(self.path(layer, name))

    def exists(self, layer: str, name: str) -> bool:
        from martflow.session import path_exists
        return path_exists(self.spark, self.path(layer, name))

    def write(self, df: DataFrame, layer: str, name: str) -> str:
        """Overwrite sink. Schema changes are allowed because each write
        replaces the whole directory (the overwriteSchema behaviour)."""
        w = df.write.mode("overwrite").format(self.fmt)
        cols = self.partition_by.get(name)
        if cols:
            w = w.partitionBy(*cols)
        p = self.path(layer, name)
        w.save(p)
        return p


def export_snapshot(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Snapshot export. Outputs keep their partitioning; ``single_file`` is
    for tables known to be small."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").parquet(path)
    return path


def write_manifest(spark: SparkSession, report: DataFrame, path: str) -> DataFrame:
    """{exported_at, tables: [{table, rows, cols, seconds}]} as one JSON row."""
    manifest = report.agg(
        F.current_timestamp().alias("exported_at"),
        F.sort_array(F.collect_list(F.struct("table", "rows", "cols", "seconds"))).alias("tables"),
    )
    manifest.coalesce(1).write.mode("overwrite").json(path)
    return manifest


def table_counts(tables: dict[str, DataFrame], label: str = "row_count") -> DataFrame:
    """One-row count aggregate per table, unioned: (table, <label>)."""
    parts = [df.agg(F.count(F.lit(1)).alias(label)).select(F.lit(name).alias("table"), label)
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def verify_export(source: dict[str, DataFrame], reread: dict[str, DataFrame]) -> DataFrame:
    """Source rows vs re-read rows per table, ``match`` flag."""
    a = table_counts(source, "source_rows")
    b = table_counts(reread, "export_rows")
    return (a.join(b, "table", "full")
             .withColumn("match", F.coalesce(F.col("source_rows") == F.col("export_rows"), F.lit(False))))


def extract(spark: SparkSession, reader_format: str, options: dict, tables: list[str],
            available: list[str], out_dir: str, fmt: str = "parquet",
            table_option: str = "dbtable") -> DataFrame:
    """Copy chosen tables from any Spark source (jdbc, parquet, csv ...) to
    parquet or csv; unknown table names are an error. Returns per-table rows."""
    unknown = sorted(set(tables) - set(available))
    if unknown:
        raise ValueError(f"unknown tables: {unknown}; available: {sorted(available)}")
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format {fmt}")
    written = {}
    for name in tables:
        opts = dict(options)
        if reader_format in ("parquet", "csv", "json", "orc"):
            base = opts.pop("path", None)
            df = spark.read.format(reader_format).options(**opts).load(
                os.path.join(base, name) if base else name)
        else:
            opts[table_option] = name
            df = spark.read.format(reader_format).options(**opts).load()
        target = os.path.join(out_dir, name)
        w = df.write.mode("overwrite")
        (w.option("header", "true").csv(target) if fmt == "csv" else w.parquet(target))
        written[name] = spark.read.format(fmt).option("header", "true").load(target) \
            if fmt == "csv" else spark.read.parquet(target)
    return table_counts(written, "rows")


def register_views(spark: SparkSession, tables: dict[str, DataFrame | str]) -> list[str]:
    """A10: register DataFrames or snapshot paths as temp views. Missing
    inputs (None, or a path without files) fail before any view is made."""
    from martflow.session import path_exists
    missing = sorted(n for n, t in tables.items()
                     if t is None or isinstance(t, str) and not path_exists(spark, t))
    if missing:
        raise FileNotFoundError(f"missing tables: {missing}")
    for name, t in tables.items():
        (spark.read.parquet(t) if isinstance(t, str) else t).createOrReplaceTempView(name)
    return sorted(tables)


def table_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for every registered table."""
    return table_counts(tables, "row_count").withColumnRenamed("table", "table_name")


def write_summary_json(summary: DataFrame, path: str) -> str:
    """A12 sink: one-row monitoring summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_summary_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A12 source: the summary back with a declared schema."""
    return spark.read.schema(schema).json(path)


def summary_to_dict(summary: DataFrame) -> dict:
    """Bring a one-row summary to the driver (bounded: exactly one row)."""
    row = summary.limit(1).collect()
    return json.loads(json.dumps(row[0].asDict(), default=str)) if row else {}


def preview(df: DataFrame, n: int = 5, order_by: list | None = None,
            where=None) -> DataFrame:
    """Deterministic sample for display: filter -> orderBy -> limit."""
    out = df if where is None else df.filter(where)
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(n)
