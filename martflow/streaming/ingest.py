"""Incremental Bronze ingestion with Structured Streaming.

The batch Bronze step (``sources.bronze.to_bronze``) copies a table and adds
lineage columns. For sources that grow by new files, the same step runs as
a file stream: only new files are read on each trigger, the lineage columns
come from the file metadata, and the sink's checkpoint (in the shared
checkpoint folder) makes it exactly-once and restartable after executor or
driver loss. ``availableNow`` processes the backlog and stops, so a
scheduled run behaves like an incremental batch job.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from martflow.session import checkpoint_dir


def bronze_stream(spark: SparkSession, source_dir: str, schema: StructType,
                  fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of new files in ``source_dir`` + lineage columns."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(source_dir)
    return df.withColumns({"_ingested_at": F.current_timestamp(),
                           "_source_file": F.col("_metadata.file_name")})


def ingest_available(spark: SparkSession, source_dir: str, schema: StructType, target_dir: str,
                     name: str, fmt: str = "parquet", checkpoint: str | None = None) -> StreamingQuery:
    """Append all not-yet-ingested files to the Bronze table and stop."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "streams", f"bronze_{name}")
    q = (bronze_stream(spark, source_dir, schema, fmt).writeStream
         .format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt)
         .trigger(availableNow=True)
         .start(target_dir))
    q.awaitTermination()
    return q
