"""Exact top-k by inner product on an impact-ordered index (operator 13).

Components become integers, floor(``SCALE`` * x). Distinct vectors are dealt by hash to
shards of about ``SHARD``. In a shard every dimension is a posting list, cut into
segments of equal quantised value; for a query the impact of a segment is what
its level adds over the dimension's least possible contribution. Score at a
time: segments are processed in descending impact and add their impact to
accumulators, which bound every score from below; the impacts of the next unread
segments of all dimensions bound what any vector may still gain. Processing
stops when this proves all but ``FEW`` vectors out (or no segment is left); the possible
members that remain are rescored exactly. ``theta``, the TOP + 1st best
exact score among ``PROBE`` long vectors (a bounded sample that changes the work
only, never the result), lets whole shards go unread by the same proof.

Queries meet shards in blocks of ``QUERY_BLOCK``: a partition reads a shard's index and
then a stream of blocks. Shards give their best; a window merges them.

Equal integer vectors form a class that is indexed once with its TOP + 1
smallest ids, and is asked once: neither a hot vector nor a hot query makes a hot shard.

Defined cases: vectors that are null or empty or hold null or non-finite
components, rows with null vec_id and vectors of another length than the most common
one (the shorter on ties) take no part, neither as query nor as candidate;
zero vectors do. Components clamp to +-2**28 after scaling, so that 64-bit sums are exact.
A vec_id counts once, with the least of its vectors in array order where rows of it
differ. Fewer candidates than TOP are all returned; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martflow.llm.common import read_table, staged_map, stage

TOP = 5
QUERY_EVERY = 50
SCALE = 256
SHARD = 4096
LEVELS = 32
ROUNDS = 4
FEW = 64
QUERY_BLOCK = 256
PROBE = 1024
LIMIT = 1 << 28


# ------------------------------------------------------------------ one shard
class Shard:
    """Impact-ordered postings of some integer vectors (rows of ``v``)."""

    def __init__(self, v: np.ndarray, ids: np.ndarray):
        self.v, self.ids = v, ids
        n, dim = v.shape
        self.low = v.min(axis=0)
        self.width = np.maximum(1, -(-(v.max(axis=0) - self.low + 1) // LEVELS))
        segment = (np.arange(dim) * LEVELS + (v - self.low) // self.width).T.ravel()
        order = np.argsort(segment, kind="stable")
        self.count = np.bincount(segment, minlength=dim * LEVELS)
        ends = np.cumsum(self.count)
        posted = order % n
        self.lists = [posted[e - c:e] for e, c in zip(ends, self.count)]

    def best(self, q: np.ndarray, most: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores that hold the ``most`` best by (score, id) of
        this shard, as far as they reach ``theta``."""
        n, dim = self.v.shape
        size = np.abs(q) * self.width
        level = np.arange(LEVELS)
        rank = np.where((q >= 0)[:, None], level, LEVELS - 1 - level)
        impact = (size[:, None] * rank).astype(np.float64)
        base = float(np.where(q >= 0, q * self.low, q * (self.low + LEVELS * self.width - 1)).sum())
        slack = float((np.abs(q) * (self.width - 1)).sum())
        slack += 1e-12 * (abs(base) + float(size.sum()) * LEVELS)       # rounding of large sums
        unread = np.where(self.count.reshape(dim, LEVELS) > 0, impact, 0.0)
        gain = np.zeros(n)
        alive = np.arange(n)
        order = np.argsort(-impact.ravel(), kind="stable")
        order = order[unread.ravel()[order] > 0]
        read = np.cumsum(self.count[order])
        cuts = np.searchsorted(read, np.linspace(0, read[-1] if len(read) else 0, ROUNDS + 1)[1:], "left") + 1
        done = 0
        for cut in np.concatenate(([0], cuts)):
            part = order[done:cut]
            if len(part):
                gain += np.bincount(np.concatenate([self.lists[s] for s in part]),
                                    np.repeat(impact.ravel()[part], self.count[part]), n)
                unread.ravel()[part] = 0.0
                done = cut
            floor = theta
            if done and n > most:
                floor = max(theta, base + float(np.partition(gain, n - most)[n - most]))
            alive = np.flatnonzero(base + gain + slack + unread.max(axis=1, initial=0.0).sum() >= floor)
            if len(alive) <= FEW:
                break
        scores = self.v[alive] @ q
        keep = np.flatnonzero(scores >= theta)
        keep = keep[np.lexsort((self.ids[alive[keep]], -scores[keep]))[:most]]
        return alive[keep], scores[keep]


def _pack(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v, np.int64).tobytes()


def _unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dim)


# ------------------------------------------------------------------ classes
def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (integers) of the rows that take part."""
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("raw"))
            .where(F.col("vec_id").isNotNull() & (F.size("raw") > 0)
                   & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .select("vec_id", F.transform("raw", lambda x: F.floor(
                F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(SCALE)) * x.cast("double"))))
                .cast("long")).alias("vec")))
    common = (rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").limit(1)
              .select("length"))
    return rows.join(F.broadcast(common), F.size("vec") == F.col("length")).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def vector_classes(spark: SparkSession, rows: DataFrame, every: int, top: int) -> tuple[DataFrame, DataFrame]:
    """(cid, members, vec, asked) per distinct vector, and (query_id, qid) per query."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    members = (rows.withColumn("nth", nth).where(F.col("nth") <= top + 1).groupBy("vec")
               .agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("members")))
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = queries.groupBy("vec").agg(F.count(F.lit(1)).alias("times"))
    classes = stage(spark, members.join(asked, "vec", "left").select(
        "cid", "members", "vec", F.col("times").isNotNull().alias("asked")), "impact-classes")
    return classes, queries.join(classes.where("asked").select("vec", F.col("cid").alias("qid")), "vec").select(
        F.col("vec_id").alias("query_id"), "qid")


# ------------------------------------------------------------------ search
_ROW = "shard long, block long, ids array<long>, data binary, theta array<double>"


def _packed(key: str, theta_of=None):
    def pack(table: pa.Table) -> pa.Table:
        v = np.asarray(table["vec"].combine_chunks().flatten(), np.int64).reshape(table.num_rows, -1)
        theta = theta_of(v) if theta_of else np.full(len(v), -np.inf)
        where = table[key][0].as_py()
        return pa.table({"shard": pa.array([where if key == "shard" else 0], pa.int64()),
                         "block": pa.array([-1 if key == "shard" else where], pa.int64()),
                         "ids": pa.array([table["cid"].to_pylist()], pa.list_(pa.int64())),
                         "data": pa.array([_pack(v)], pa.binary()),
                         "theta": pa.array([theta.tolist()], pa.list_(pa.float64()))})
    return pack


def search(spark: SparkSession, vectors: DataFrame, every: int = QUERY_EVERY, top: int = TOP,
           shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` best of every query."""
    rows = integer_vectors(vectors)
    classes, queries = vector_classes(spark, rows, every, top)
    n, n_asked, dim = classes.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("vec"))).first()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = top + 1
    shards, blocks = -(-n // shard_rows), -(-n_asked // QUERY_BLOCK)
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    probe = np.array([r[0] for r in classes.orderBy(F.desc(length), "cid").limit(PROBE).select("vec").collect()],
                     np.int64)                                         # PROBE vectors at most

    def theta_of(q: np.ndarray) -> np.ndarray:
        if len(probe) < most:
            return np.full(len(q), -np.inf)
        return np.partition(q @ probe.T, len(probe) - most, axis=1)[:, len(probe) - most].astype(np.float64)

    index = (classes.select("cid", "vec", F.pmod(F.xxhash64("cid"), F.lit(shards)).alias("shard"))
             .groupBy("shard").applyInArrow(_packed("shard"), _ROW))
    asking = (classes.where("asked").select("cid", "vec", F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("part"))
              .groupBy("part").applyInArrow(_packed("part", theta_of), _ROW)
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))))
    laid = index.unionByName(asking).repartition(int(2 * shards), "shard").sortWithinPartitions("shard", "block")

    def run(batches):
        held = None
        for b in batches:
            for r in b.to_pylist():
                ids, v = np.array(r["ids"], np.int64), _unpack(r["data"], dim)
                if r["block"] < 0:
                    held = (r["shard"], Shard(v, ids))
                    continue
                if held is None or held[0] != r["shard"]:          # a shard that got no vector
                    continue
                out = [[], [], []]
                for k in range(len(v)):
                    at, scores = held[1].best(v[k], most, r["theta"][k])
                    for col, x in zip(out, (np.full(len(at), ids[k]), held[1].ids[at], scores)):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out],
                                                 names=["qid", "cid", "score"])

    # Rows hold whole blocks, so few of them make an Arrow batch.
    found = staged_map(spark, laid, run, "qid long, cid long, score long", 8, "impact-found")
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    best = found.withColumn("nth", first).where(F.col("nth") <= most).select("qid", "cid", "score")
    nearest = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    members = (best.join(classes.select("cid", "members"), "cid")
               .select("qid", "score", F.explode("members").alias("vec_id"))
               .withColumn("nth", nearest).where(F.col("nth") <= most).groupBy("qid")
               .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best")))
    other = F.slice(F.filter("best", lambda p: p["vec_id"] != F.col("query_id")), 1, top)
    return (queries.join(members, "qid").select("query_id", F.posexplode(other).alias("pos", "p"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "p.vec_id", (-F.col("p.s")).alias("score")))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return search(spark, read_table(spark, sf_dir, "embeddings"))
