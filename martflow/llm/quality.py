"""Quality classifier: hashed word n-grams, logistic regression, FTRL (operator 3).

Words are runs of letters and digits, or runs of other non-space signs, so
that ``%%%`` or ``|`` is a word. Features are hashed word 1-grams and 2-grams
and two n-grams with a back-reference (a word equal to the one before, or to
the one before that). A feature's value is its count over the square root of
the document's n-grams, so a score is a sparse dot product.

Training: follow-the-regularised-leader, one update per document in hash
order, on at most ``MAX_TRAIN`` labelled documents (a documented bound: those
with the smallest hash of doc_id), in one task. Scoring covers every whole
text on the executors with the 2**BITS weights, whose size is fixed.

Defined cases: null or empty text scores the intercept; a null doc_id is not
held out and not learnt from; a doc_id labelled more than once counts as its
lowest label; labels other than 0 and 1 count as label > 0; without any label every score is 0.5
(predicted 1); repeated rows are scored each; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from martflow.llm.common import (ALNUM, NONSPACE, keeps_columns, map_arrow,
                                 ngram_hash, read_table, text_chunks, ByteHash)

BITS = 18
MAX_TRAIN = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.0001
SAME_1, SAME_2, BIAS = 1, 2, 0      # reserved feature ids


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of every n-gram in the chunk, and each text's offsets."""
    kind = np.where(ALNUM[buf] | ((buf >= 65) & (buf <= 90)), 1, 2) * NONSPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1], [True])) | edge
    starts = np.flatnonzero(change[:-1] & (kind > 0))
    ends = np.flatnonzero(change[1:] & (kind > 0)) + 1
    h = ByteHash(buf).spans(starts, ends)
    words = np.searchsorted(starts, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(words))
    slots = np.uint64((1 << BITS) - 3)
    ids, owner = [(h % slots).astype(np.int64) + 3], [doc]
    for gap, same in ((1, SAME_1), (2, SAME_2)):
        inside = doc[gap:] == doc[:-gap]
        if gap == 1 and len(h) > 1:
            ids.append((ngram_hash(h, 2)[inside] % slots).astype(np.int64) + 3)
            owner.append(doc[1:][inside])
        hit = inside & (h[gap:] == h[:-gap])
        ids.append(np.full(int(hit.sum()), same))
        owner.append(doc[gap:][hit])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(ids)[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(offs) - 1))))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    def __init__(self):
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)

    def weights(self, ids) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, ids: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(ids)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[ids] = n + g * g


def _train(batches):
    """Arrow batches (text, label) in training order -> one row of weights."""
    model, seen = Ftrl(), []
    for b in batches:
        labels = b.column("label").to_numpy(zero_copy_only=False)
        for lo, hi, buf, offs in text_chunks(b.column("text")):
            ids, at = features(buf, offs)
            for k in range(hi - lo):
                u, c = np.unique(ids[at[k]:at[k + 1]], return_counts=True)
                x = c / np.sqrt(max(c.sum(), 1))
                seen.append((np.concatenate(([BIAS], u)).astype(np.int32),
                             np.concatenate(([0.2], x)).astype(np.float32), int(labels[lo + k] > 0)))
    for _ in range(EPOCHS):
        for ids, x, y in seen:
            model.update(ids, x.astype(float), y)
    yield pa.RecordBatch.from_pydict({"weights": [model.weights(np.arange(1 << BITS)).tobytes()]})


def held_out(rest: int, of: int):
    """Whether crc32 of doc_id as text leaves ``rest`` (false for null ids)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == rest, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learnt from labelled rows of ``docs`` that are not held out."""
    picked = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(1, 3))
              .groupBy("doc_id").agg(F.min("quality").alias("label"))
              .withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(MAX_TRAIN))
    # At most MAX_TRAIN rows of three numbers: a bounded broadcast.
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .repartition(1).sortWithinPartitions("o", "doc_id", "text").select("text", "label"))
    got = map_arrow(spark, rows, _train, "weights binary").collect()
    return np.frombuffer(got[0][0]) if got else np.zeros(1 << BITS)


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` plus qc_score, from the column text."""
    model = spark.sparkContext.broadcast(weights)     # 2**BITS doubles, always

    def run(batches):
        w = model.value
        for b in batches:
            out = []
            for _, _, buf, offs in text_chunks(b.column("text")):
                ids, at = features(buf, offs)
                sums = np.concatenate(([0.0], np.cumsum(w[ids])))
                n = np.diff(at)
                dot = (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(n, 1)) + 0.2 * w[BIAS]
                out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep],
                                              pa.array(np.concatenate(out) if out else np.zeros(0))],
                                             names=[*keep, "qc_score"])

    schema = StructType([docs.schema[n] for n in keep]).add("qc_score", DoubleType())
    return map_arrow(spark, docs, run, schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    w = train(spark, docs, labels)
    scored = score(spark, docs.select("doc_id", "text"), w, ["doc_id"])
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), F.col("qc_score").alias("score"),
                         (F.col("qc_score") >= 0.5).cast("int").alias("predicted"))


@keeps_columns
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    w = train(spark, docs, read_table(spark, sf_dir, "labels"))
    kept = score(spark, docs, w, docs.columns).where("qc_score >= 0.5")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
