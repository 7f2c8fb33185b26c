"""A3: Bronze ingest = as-is copy plus two lineage columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_bronze(df: DataFrame, source_file: str | Column | None = None,
              ingested_at: Column | None = None) -> DataFrame:
    """Append ``_ingested_at`` and ``_source_file``.

    ``source_file`` may be a literal name; when omitted the per-row file name
    from the scan's hidden ``_metadata`` column is used (only available on a
    file scan; derived tables pass a literal).
    """
    if source_file is None:
        src = F.col("_metadata.file_name")
    elif isinstance(source_file, str):
        src = F.lit(source_file)
    else:
        src = source_file
    ts = ingested_at if ingested_at is not None else F.current_timestamp()
    return df.withColumns({"_ingested_at": ts.cast("timestamp"), "_source_file": src.cast("string")})


def bronze_layer(raw: dict[str, DataFrame], source_prefix: str = "") -> dict[str, DataFrame]:
    """Bronze versions of every raw table, named ``<table>_raw``."""
    return {f"{name}_raw": to_bronze(df, f"{source_prefix}{name}") for name, df in raw.items()}
