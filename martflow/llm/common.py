"""Helpers shared by the training-data operators.

* ``stage`` writes an intermediate table once under the folder named by
  ``spark.checkpoint.dir`` and rereads it: a lineage cut that survives lost
  executors.
* The numpy half turns an Arrow text column into flat byte chunks, finds word
  spans and hashes spans of bytes and runs of words without a Python loop over
  words. Texts are never cut: a chunk holds whole texts, and a text larger
  than the chunk size is a chunk of its own.

Null texts behave as empty texts in every helper; callers state what that
means for their result.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from martflow.session import checkpoint_dir

CHUNK_BYTES = 2 << 20      # bytes of text that numpy works on at a time
BATCH_ROWS = 1000          # rows in an Arrow batch sent to Python


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context: they
    need not have it on their own path."""
    sc = spark.sparkContext
    if _SHIPPED.get("to") == sc.applicationId:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="martflow-code-")) / f"martflow-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED["to"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


def map_arrow(spark: SparkSession, df: DataFrame, fn: Callable, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``df.mapInArrow`` with small batches, so that texts of any length keep
    a Python worker's memory low. The setting counts when the result is run."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(fn, schema)


def staged_map(spark: SparkSession, df: DataFrame, fn: Callable, schema: str, rows: int, name: str) -> DataFrame:
    """``df.mapInArrow`` with batches of ``rows``, written and reread at once, so
    that the session keeps its own batch size."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        return stage(spark, df.mapInArrow(fn, schema), name)
    finally:
        spark.conf.set(key, before)


#: Columns of documents that pipeline stages read; all others only pass through.
STAGE_COLUMNS = ("doc_id", "text", "source")


def keeps_columns(step: Callable) -> Callable:
    """A pipeline stage whose other columns may have any names: inside the stage they
    have names of their own, behind it those that they came with."""
    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = {c: f"user_{k}" for k, c in enumerate(docs.columns) if c not in STAGE_COLUMNS}
        out = step(spark, docs.withColumnsRenamed(inside), sf_dir)
        return out.withColumnsRenamed({k: c for c, k in inside.items()})
    return run


# ---------------------------------------------------------------- text chunks
def text_chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts of an Arrow column, some at a time: (first row, end row,
    their UTF-8 bytes, offsets of the texts in those bytes)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        hi = min(hi, lo + BATCH_ROWS)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def _lut(outside: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, bool)
    for a, b in outside:
        t[a:b + 1] = False
    return t


#: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z)
ALNUM = _lut([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: bytes of words [^\x20\x09-\x0D]+
NONSPACE = _lut([(0x20, 0x20), (0x09, 0x0D)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``buf``, and the offsets of each text's
    words in them. Words never cross texts."""
    m = is_word[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(m & (edge[:-1] | ~np.concatenate(([False], m[:-1]))))
    ends = np.flatnonzero(m & (edge[1:] | ~np.concatenate((m[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offs)


# ---------------------------------------------------------------- hashing
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        m = max(n + 1, CHUNK_BYTES + 4096)
        for k, base in enumerate((int(_P), pow(int(_P), -1, 2**64))):
            _POWERS[k] = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(m, base, np.uint64))))
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class ByteHash:
    """Hashes of any byte spans of one chunk, from prefix sums."""

    def __init__(self, buf: np.ndarray):
        pw, self.inv = _powers(len(buf))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[:len(buf)], out=self.sums[1:])

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((self.sums[e] - self.sums[s]) * self.inv[s])


_STEP = (mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1))


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring values (one per start; runs that
    cross texts are for the caller to leave out)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(n))
    for j in range(n):
        out += h[j:j + m] * _STEP[j]
    return mix64(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of start .. start+count-1 for every pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)
