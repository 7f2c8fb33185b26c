"""Approximate nearest neighbours on shifted space-filling curves (operator 10).

Largest inner product is turned into nearness by one more coordinate (the
length that a vector lacks to the longest). Each of ``CURVES`` curves projects
the vectors at random to ``DIMS`` dimensions, shifts them and orders them by
Hilbert key. Spark range-partitions the keys and cuts them into blocks of at most ``BLOCK``
rows. A query meets the blocks within ``reach`` of its own key on the curves searched; runs of
up to ``SPAN`` blocks meet at most ``TILE`` of their queries at a time. The runs' best are picked by
products in single precision, with a margin for their rounding, and ordered by the exact inner
product in double precision on the original vectors.

``reach`` and the number of curves are measured, not fixed: for at most ``SAMPLE`` queries (a documented
bound) the true neighbours are found by brute force. For each number of curves reach is the least
at which ``TARGET`` of them lie inside a window on some curve, and the number is taken that meets
the fewest blocks. Every vector is on every curve. On data without structure reach grows until
recall holds; one curve is enough where a window covers it, as the others hold the same vectors.

Equal vectors form a class that is indexed once with its TOP + 1 smallest ids;
larger ids of a class can be in no answer. So neither a hot vector nor a hot query
makes a hot block.

Defined cases: vectors that are null, zero or hold null or non-finite
components, rows with null vec_id and vectors of another length than the most common one (the
shorter on ties) take no part, neither as query nor as candidate; a repeated
row counts once; rows with the query's vec_id are its own; fewer candidates than TOP
are all returned; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martflow.llm.common import read_table, ship_package, stage

TOP = 20
QUERY_EVERY = 20
CURVES, DIMS, BITS = 6, 6, 10
BLOCK = 2048
SPAN, TILE = 16, 16384
CHUNK, EXACT_ROWS = 64, 1 << 17
SAMPLE = 64
TARGET = 0.97
SEED = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows), by Skilling's transform."""
    axes = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for k in range(len(axes)):
            up = (axes[k] & bit) != 0
            swap = np.where(up, 0, (axes[0] ^ axes[k]) & low)
            axes[0] = np.where(up, axes[0] ^ low, axes[0] ^ swap)
            axes[k] = axes[k] ^ swap if k else axes[0]
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turn = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        turn = np.where(axes[-1] & (1 << b), turn ^ ((1 << b) - 1), turn)
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << 1) | (((a ^ turn) >> b) & 1)
    return key


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((dim + 1, CURVES * DIMS)) / np.sqrt(dim), rng.random(CURVES * DIMS)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vec of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).where(
        F.col("vec_id").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0))
    common = (rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
              .select(F.col("n").alias("vn")))
    return rows.join(F.broadcast(common), F.size("vec") == F.col("vn")).drop("vn").distinct()


def classes_of(spark: SparkSession, rows: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """(cid, members, vec, is_query) per distinct vector, and (query_id, cid)."""
    first = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    members = (rows.withColumn("k", first).where(F.col("k") <= TOP + 1).groupBy("vec")
               .agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("members")))
    asked = rows.where(F.col("vec_id") % every == 0)
    is_query = asked.groupBy("vec").agg(F.count(F.lit(1)).alias("asked"))
    classes = stage(spark, members.join(is_query, "vec", "left")
                    .select("cid", "members", "vec", F.col("asked").isNotNull().alias("is_query")), "ann-classes")
    queries = asked.join(classes.where("is_query").select("vec", "cid"), "vec").select(
        F.col("vec_id").alias("query_id"), "cid")
    return classes, queries


def lay_out(spark: SparkSession, classes: DataFrame, dim: int, longest: float) -> DataFrame:
    """curve, seq (block number on the curve), is_q, cid: every class on
    every curve, queries once more at the key of their direction."""
    proj, shift = _projections(dim)

    def points(x: np.ndarray) -> np.ndarray:
        x = x / longest
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
        return np.hstack([x, rest]) @ proj

    def sums(batches):
        for b in batches:
            y = points(_matrix(b.column("vec"), dim))
            yield pa.RecordBatch.from_pydict({"k": np.arange(y.shape[1]), "n": np.full(y.shape[1], len(y)),
                                              "s": y.sum(axis=0), "ss": (y * y).sum(axis=0)})

    got = (classes.select("vec").mapInArrow(sums, "k long, n long, s double, ss double").groupBy("k")
           .agg(F.sum("n"), F.sum("s"), F.sum("ss")).orderBy("k").collect())      # CURVES * DIMS rows
    n, s, ss = (np.array([r[c] for r in got], float) for c in (1, 2, 3))
    mean, dev = s / n, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 1e-18))

    def keys(y: np.ndarray, c: int) -> np.ndarray:
        part = slice(c * DIMS, (c + 1) * DIMS)
        unit = np.clip((y[:, part] - mean[part]) / (5 * dev[part]) + 0.5, 0, 1) * 0.5 + 0.5 * shift[part]
        return hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)

    def place(batches):
        for b in batches:
            x = _matrix(b.column("vec"), dim)
            ask = np.flatnonzero(b.column("is_query").to_numpy(zero_copy_only=False))
            y = points(x)
            direction = x[ask] / np.linalg.norm(x[ask], axis=1, keepdims=True)
            yq = np.hstack([direction, np.zeros((len(ask), 1))]) @ proj
            rows = pa.array(np.concatenate([np.arange(len(x)), ask]))
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), c)), pa.array(np.concatenate([keys(y, c), keys(yq, c)])),
                     pa.array(np.arange(len(rows)) >= len(x)), b.column("cid").take(rows)],
                    names=["curve", "key", "is_q", "cid"])

    row = F.monotonically_increasing_id()            # partition number, then place in the sorted partition
    laid = (classes.select("cid", "vec", "is_query")
            .mapInArrow(place, "curve long, key long, is_q boolean, cid long")
            .repartitionByRange("curve", "key", "cid").sortWithinPartitions("curve", "key", "cid", "is_q")
            .withColumn("row", row)
            .withColumn("block", F.floor(F.col("row") / F.lit(BLOCK)).cast("long")))
    laid = stage(spark, laid.drop("row", "key"), "ann-keys")
    seq = F.row_number().over(Window.partitionBy("curve").orderBy("block"))       # a row per block
    blocks = laid.select("curve", "block").distinct().withColumn("seq", seq)
    return laid.join(blocks, ["curve", "block"]).drop("block")


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (q * v).sum(axis=1)


def _near(q: np.ndarray, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places that hold every query's ``most`` best by exact score, and few others.

    A score in single precision is off by at most ``off``. The ``most``-th largest of the maxima of
    equal runs of vectors is at most the ``most``-th best score of all."""
    score = q.astype(np.float32) @ v.astype(np.float32).T
    run = max(1, len(v) // (4 * most))
    tops = score[:, :len(v) // run * run].reshape(len(q), -1, run).max(axis=2)
    cut = np.partition(tops, tops.shape[1] - most, axis=1)[:, -most]
    off = (q.shape[1] + 4) * 2.0 ** -23 * np.linalg.norm(q, axis=1) * np.sqrt((v * v).sum(axis=1).max())
    return np.nonzero(score >= (cut - 2 * off)[:, None])


def best_of(q: np.ndarray, v: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ids and exact scores of its ``most`` best vectors by (exact score, smaller id)."""
    most = min(most, len(ids))
    got_ids, got = np.empty((len(q), most), ids.dtype), np.empty((len(q), most))
    # Scaled, so that no product leaves the range of single precision.
    scale = max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) or 1.0
    for at in range(0, len(q), CHUNK):
        asked, near = _near(q[at:at + CHUNK] / scale, v / scale, most)
        ends = np.searchsorted(asked, np.arange(min(CHUNK, len(q) - at) + 1))
        lo = 0
        while lo < len(ends) - 1:                                  # equal scores may hold a query's every vector
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + EXACT_ROWS, "right")) - 1)
            part = slice(ends[lo], ends[hi])
            who, which = asked[part], near[part]
            exact = exact_scores(q[at + who], v[which])
            order = np.lexsort((ids[which], -exact, who))
            first = np.searchsorted(who, np.arange(lo, hi))        # the order keeps each query's place
            pick = order[(first[:, None] + np.arange(most)).ravel()]
            got_ids[at + lo:at + hi] = ids[which[pick]].reshape(-1, most)
            got[at + lo:at + hi] = exact[pick].reshape(-1, most)
            lo = hi
    return got_ids, got


_FOUND = "cid long, ids array<long>, scores array<double>"


def _found(cids, parts) -> pa.RecordBatch:
    """Rows of _FOUND from (ids, scores) matrices."""
    width = parts[0].shape[1]
    offs = pa.array(np.arange(0, len(cids) * width + 1, width), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(cids), pa.ListArray.from_arrays(offs, pa.array(parts[0].ravel())),
         pa.ListArray.from_arrays(offs, pa.array(parts[1].ravel()))], names=["cid", "ids", "scores"])


def merged(found: DataFrame) -> DataFrame:
    """cid, best: the TOP + 1 best classes of all that were found.

    Rows of a cid follow each other in a sorted partition, so numpy merges a batch at a time; of the cid
    that a batch ends with only its best so far wait for the next."""
    def merge(batches):
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for b in batches:
            width = pa.compute.list_value_length(b.column("ids")).to_numpy()
            new = (np.repeat(b.column("cid").to_numpy(), width), b.column("ids").flatten().to_numpy(), b.column("scores").flatten().to_numpy())
            cid, ids, score = (np.concatenate(x) for x in zip(held, new))
            if not len(cid):
                continue
            order = np.lexsort((ids, -score, cid))
            cid, ids, score = cid[order], ids[order], score[order]
            # A class met on several curves has one score, so its rows follow each other.
            kept = np.append(True, (cid[1:] != cid[:-1]) | (ids[1:] != ids[:-1]))
            cid, ids, score = cid[kept], ids[kept], score[kept]
            kept = np.arange(len(cid)) - np.searchsorted(cid, cid) <= TOP
            cid, ids, score = cid[kept], ids[kept], score[kept]
            end = np.searchsorted(cid, cid[-1])
            held = cid[end:], ids[end:], score[end:]
            if end:
                yield best(cid[:end], ids[:end], score[:end])
        if len(held[0]):
            yield best(*held)

    def best(cid, ids, score) -> pa.RecordBatch:
        one, first = np.unique(cid, return_index=True)
        pairs = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids)], names=["s", "id"])
        return pa.RecordBatch.from_arrays([pa.array(one), pa.ListArray.from_arrays(
            pa.array(np.append(first, len(cid)), pa.int32()), pairs)], names=["cid", "best"])

    return (found.repartition("cid").sortWithinPartitions("cid")
            .mapInArrow(merge, "cid long, best array<struct<s: double, id: long>>"))


def measure_reach(spark: SparkSession, classes: DataFrame, laid: DataFrame, dim: int, blocks: int) -> tuple[int, int]:
    """(curves, reach): the number of curves that meets the fewest blocks, of ``blocks`` on a curve, and the least number of
    blocks to either side that holds TARGET of the true neighbours of the sampled queries on them."""
    some = (classes.where("is_query").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("cid", "vec").toArrow())
    if not some.num_rows:
        return 1, 0
    q, q_ids = _matrix(some["vec"], dim), some["cid"].to_numpy()

    def brute(batches):
        for b in batches:
            ids, scores = best_of(q, _matrix(b.column("vec"), dim), b.column("cid").to_numpy(), TOP + 1)
            yield _found(q_ids, (ids, scores))

    true = merged(classes.select("cid", "vec").mapInArrow(brute, _FOUND)).select(
        F.col("cid").alias("q"), F.explode("best.id").alias("v"))
    at = laid.select("curve", "seq", "cid", "is_q")
    apart = F.abs(F.col("seq") - F.col("qs"))
    far = (true.join(at.where("is_q").select(F.col("cid").alias("q"), "curve", F.col("seq").alias("qs")), "q")
           .join(at.where("not is_q").select(F.col("cid").alias("v"), "curve", "seq"), ["v", "curve"])
           .groupBy("q", "v").agg(*[F.min(F.when(F.col("curve") < k, apart)).alias(f"far{k}") for k in range(1, CURVES + 1)]))
    # SAMPLE * (TOP + 1) distances at most
    reaches = far.selectExpr(*[f"percentile_disc({TARGET}) within group (order by far{k})" for k in range(1, CURVES + 1)]).first()
    met = [(k * min(blocks, 2 * int(r or 0) + 1), k, int(r or 0)) for k, r in enumerate(reaches, 1)]
    return min(met)[1:]


def search(spark: SparkSession, vectors: DataFrame, every: int = QUERY_EVERY, reach: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the TOP nearest found of every query."""
    ship_package(spark)
    rows = stage(spark, valid_vectors(vectors), "ann-rows")
    classes, queries = classes_of(spark, rows, every)
    stats = classes.agg(F.max(F.size("vec")), F.max(F.aggregate(
        "vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    dim, longest = stats[0] or 1, float(np.sqrt(stats[1] or 1.0)) * (1 + 1e-12)
    laid = lay_out(spark, classes, dim, longest) if stats[0] else None
    if laid is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    laid = stage(spark, laid, "ann-blocks")
    blocks = laid.agg(F.max("seq")).first()[0]
    curves, reach = measure_reach(spark, classes, laid, dim, blocks) if reach is None else (CURVES, reach)
    if 2 * reach + 1 >= blocks:          # such a window meets as many blocks as there are: all of them, on one curve
        curves, reach = 1, blocks

    def rerank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_pylist([], pa.schema([("cid", pa.int64()), ("ids", pa.list_(pa.int64())),
                                                         ("scores", pa.list_(pa.float64()))]))]
        if left.num_rows and right.num_rows:
            v, ids = _matrix(right["vec"], dim), right["cid"].to_numpy()
            q, q_ids = _matrix(left["q_vec"], dim), left["q_cid"].to_numpy()
            for k in range(0, len(q), 1024):
                out.append(_found(q_ids[k:k + 1024], best_of(q[k:k + 1024], v, ids, TOP + 1)))
        return pa.Table.from_batches(out)

    span = max(1, min(SPAN, reach // 4))
    run = lambda seq: F.floor((seq - 1) / F.lit(span)).cast("long")
    near = F.sequence(run(F.greatest(F.lit(1), F.col("seq") - reach)), run(F.least(F.lit(blocks), F.col("seq") + reach)))
    laid = laid.where(F.col("curve") < curves)
    # A run's queries are dealt into tiles; each tile meets the run once.
    asks = laid.where("is_q").select("curve", F.explode(near).alias("run"), "cid")
    tiles = F.broadcast(asks.groupBy("curve", "run").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("tiles")))  # a row per run
    asking = (laid.where("is_q").join(classes.select("cid", "vec"), "cid")
              .select("curve", F.explode(near).alias("run"), F.col("cid").alias("q_cid"), F.col("vec").alias("q_vec"))
              .join(tiles, ["curve", "run"]).withColumn("tile", F.pmod(F.xxhash64("q_cid"), "tiles")).drop("tiles"))
    held = (laid.where("not is_q").withColumn("run", run(F.col("seq"))).join(classes.select("cid", "vec"), "cid")
            .join(tiles, ["curve", "run"])
            .select("curve", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), "cid", "vec"))
    asking = asking.withColumnsRenamed({"curve": "q_curve", "run": "q_run", "tile": "q_tile"})
    found = (asking.groupBy("q_curve", "q_run", "q_tile").cogroup(held.groupBy("curve", "run", "tile"))
             .applyInArrow(rerank, _FOUND))
    best = merged(found)
    # Classes become their members; TOP + 1 of them are enough for any query of the class.
    owners = classes.select(F.col("cid").alias("id"), "members")
    listed = (best.select("cid", F.explode("best").alias("b")).select("cid", "b.s", "b.id").join(owners, "id")
              .select("cid", F.explode(F.transform("members", lambda m: F.struct(F.col("s"), m.alias("id")))).alias("p"))
              .groupBy("cid").agg(F.slice(F.array_sort(F.collect_list("p")), 1, TOP + 1).alias("best")))
    own = F.filter("best", lambda p: p["id"] != F.col("query_id"))
    return (queries.join(listed, "cid").select("query_id", F.posexplode(F.slice(own, 1, TOP)).alias("pos", "p"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("p.id").alias("vec_id"),
                    (-F.col("p.s")).alias("score")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return search(spark, read_table(spark, sf_dir, "embeddings"))
