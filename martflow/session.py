"""SparkSession construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession

# Session settings every builder relies on: UTC wall clock (timestamps are
# timestamp_ntz end to end), ANSI arithmetic, AQE for runtime re-planning
# (partition coalescing + skew-join splitting), no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "martflow",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_session_conf(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of BASE_CONF to an existing session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled",
              "spark.sql.adaptive.enabled"):
        spark.conf.set(k, BASE_CONF[k])


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, as the session names it.

    On a cluster ``spark.checkpoint.dir`` must name a folder that all machines
    share. Only a local master, as in tests, gets a scratch folder where it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="martflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(spark: SparkSession, df, name: str, key: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return the re-read table: a lineage cut that survives executor loss
    (unlike a local checkpoint) and keeps downstream plans small.

    ``key`` identifies the inputs + configuration; an existing complete
    table (``_SUCCESS`` present) for the same key is reused.
    """
    path = os.path.join(checkpoint_dir(spark), "tables", key, name)
    with _lock_for(path):
        if not path_exists(spark, os.path.join(path, "_SUCCESS")):
            df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_LOCKS: dict[str, threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


def _lock_for(path: str) -> threading.Lock:
    """One lock per table path: concurrent queries in one driver write once."""
    with _LOCKS_GUARD:
        return _LOCKS.setdefault(path, threading.Lock())


def file_status(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, modification time) of a file or of the files of a
    folder, from the file system of the path; empty if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for
    local, HDFS and object-store URIs alike)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
