"""N-gram Jaccard join (operator 4).

Documents are sets of hashed word shingles; equal sets form one class. Two
classes link when 100 * |intersection| >= 75 * |union|. The join is exact:

1. Prefixes. Shingles have one global order, by how often their hash bucket
   occurs in the corpus and then by hash, so shingles of passages that many
   documents share stand last. Classes that link share a shingle among the first
   n - ceil(0.75 n) + 1 of each.
2. Stars. Each class is tried with a hub that it met at its prefix shingles.
   Links found so far give components; a run of classes at one shingle
   that is inside one component needs no further pair.
3. Runs with several components. A component with ``LARGE`` classes or more in
   a run is tiled as a whole against the classes that met it: blocks of about
   ``TILE`` members by blocks of those classes. Among the rest of a run, up to
   ``SHORT_RUN`` classes, pairs of different components are counted, summed over all runs, and
   kept if they share enough of their prefixes for a link. Longer rests
   are dealt to size-banded tiles by (shingle, size band); linked sizes differ by at
   most 4/3, so only neighbouring bands meet, and a band with more than
   ``TILE`` classes is split into blocks that meet pairwise.
4. Every class has a hashed bitmap signature of a width that fits its size;
   bits set on one side only bound the overlap from above. Pairs that pass the bound
   are compared exactly as sorted arrays: first each class with the likeliest of every
   other component, then all pairs whose components are still apart.

So components are those of all links, without listing the pairs inside
groups of copies. Set arrays are made again from the texts for the classes that need
them; a Bloom bitmap of fixed size says which texts those are.

Words: ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Shingles are
compared by 54-bit hashes.

Defined cases: null, empty or blank text has the empty set, size 0, and is
its own component; fewer words than SHINGLE are one shingle; rows with the
same doc_id are separate documents; a null doc_id is never the smallest unless it is
alone; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.common import (LOWER, NONSPACE, keeps_columns, map_arrow, mix64, ngram_hash,
                                 ranges, read_table, stage, text_chunks, word_spans, ByteHash)
from martflow.llm.components import components

SHINGLE = 5
PERCENT = 75
TILE = 512
STARS = 2                 # rounds of stars
LARGE = 32                # least classes of a component in a run that are tiled as a component
SHORT_RUN = 64            # most classes of a run whose pairs are counted, not tiled
SKETCH_BITS = 22          # buckets of the corpus-wide shingle counts
SKETCH_PART = 4096        # counts in one row
TASK_MOST = 255           # most that a task counts in a bucket; beyond it the order is as good
BLOOM_BITS = 24
LEAST_WIDTH, MOST_WIDTH = 64, 32768
HASH_BITS = 54
_LOW = np.uint64((1 << HASH_BITS) - 1)


# ------------------------------------------------------------------ sets
class Sets:
    """Distinct shingles of each text of a chunk: ``value`` ascending within
    each text, ``at`` their offsets, ``cid`` the 64-bit digest of each set."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low = LOWER[buf]
        s, e, at = word_spans(low, offs, NONSPACE)
        h = ByteHash(low).spans(s, e)
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        grams = ngram_hash(h, SHINGLE)
        inside = doc[:len(grams)] == doc[SHINGLE - 1:] if len(grams) else np.zeros(0, bool)
        values, owner = [grams[inside]], [doc[:len(grams)][inside]]
        for m in range(1, SHINGLE):
            few = np.flatnonzero(n == m)
            if len(few):
                values.append(ngram_hash(h, m)[at[few]])
                owner.append(few)
        top = np.uint64(HASH_BITS)
        key = np.sort((np.concatenate(owner).astype(np.uint64) << top) | (np.concatenate(values) & _LOW))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        self.owner = (key >> top).astype(np.int64)
        self.value = key & _LOW
        self.at = np.searchsorted(self.owner, np.arange(len(n) + 1))
        self.n = np.diff(self.at)
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(self.value + np.uint64(1)))))
        self.cid = mix64(total[self.at[1:]] - total[self.at[:-1]] + self.n.astype(np.uint64)).view(np.int64)

    def prefixes(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First shingles in the global order and how many per text."""
        rank = level[self.value & np.uint64(len(level) - 1)].astype(np.uint64) << np.uint64(HASH_BITS - 4)
        rank |= self.value >> np.uint64(4)
        key = np.sort((self.owner.astype(np.uint64) << np.uint64(HASH_BITS)) | rank)
        count = np.where(self.n > 0, self.n - (self.n * PERCENT + 99) // 100 + 1, 0)
        return (key[ranges(self.at[:-1], count)] & _LOW).view(np.int64), count

    def bitmaps(self) -> list[bytes]:
        w = widths(self.n)
        base = np.cumsum(w) - w
        bits = np.zeros(int(w.sum()), bool)
        bits[base[self.owner] + (self.value & (w[self.owner] - 1).astype(np.uint64)).astype(np.int64)] = True
        raw = np.packbits(bits, bitorder="little").tobytes()
        return [raw[x:x + y] for x, y in zip((base // 8).tolist(), (w // 8).tolist())]


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the signature of a set of n shingles: a power of two, at least 8 n
    (up to MOST_WIDTH), so that few shingles share a bit and the bound is close."""
    need = 1 << np.ceil(np.log2(np.maximum(8 * n, 1))).astype(np.int64)
    return np.clip(need, LEAST_WIDTH, MOST_WIDTH)


def linked(inter: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether an overlap suffices; ``total`` is the sum of the two sizes."""
    return 100 * inter >= PERCENT * (total - inter)


def bound(n_a: np.ndarray, n_b: np.ndarray, bits_a: list[bytes], bits_b: list[bytes]) -> np.ndarray:
    """Upper bound of the overlap of each pair from its signatures."""
    out = np.minimum(n_a, n_b).astype(np.int64)
    w_a, w_b = widths(n_a) // 8, widths(n_b) // 8
    for w in np.unique(np.minimum(w_a, w_b)):
        k = np.flatnonzero(np.minimum(w_a, w_b) == w)
        a, b = _folded(bits_a, k, w), _folded(bits_b, k, w)
        out[k] = np.minimum(n_a[k] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64),
                            n_b[k] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return out


def _folded(bits: list[bytes], rows: np.ndarray, width: int) -> np.ndarray:
    """Signatures of the rows folded to ``width`` bytes."""
    out = np.zeros((len(rows), width // 8), np.uint64)
    size = np.fromiter((len(bits[r]) for r in rows), np.int64, len(rows))
    for s in np.unique(size):
        k = np.flatnonzero(size == s)
        m = np.frombuffer(b"".join(bits[r] for r in rows[k]), np.uint64).reshape(len(k), s // width, width // 8)
        out[k] = np.bitwise_or.reduce(m, axis=1)
    return out


# ------------------------------------------------------------------ text passes
def _summary(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, th, n, cid, bits) per document, and the popularity level of
    each hash bucket over all shingles of the corpus."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "th", "n", "cid", "bits", "part"]
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                s = Sets(buf, offs)
                np.add.at(counts, (s.value & np.uint64(len(counts) - 1)).astype(np.int64), np.uint32(1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("th").slice(lo, hi - lo), pa.array(s.n),
                     pa.array(s.cid), pa.array(s.bitmaps(), pa.binary()), pa.nulls(hi - lo, pa.int64())],
                    names=names)
        parts = np.minimum(counts, TASK_MOST).astype(np.uint8).reshape(-1, SKETCH_PART)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(len(some), pa.int64())] * 4, pa.array([parts[k].tobytes() for k in some], pa.binary()),
             pa.array(some)], names=names)

    rows = stage(spark, map_arrow(spark, docs, run,
                                  "doc_id long, th long, n long, cid long, bits binary, part long"), "jaccard-docs")

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("part").to_pylist(), b.column("bits").to_pylist()):
                held[k] = held.get(k, np.uint32(0)) + np.frombuffer(c, np.uint8)
        if held:
            yield pa.RecordBatch.from_pydict({"part": list(held), "bits": [v.astype("<u4").tobytes() for v in held.values()]})

    summed = map_arrow(spark, rows.where("part is not null").select("part", "bits").repartition("part"), add,
                       "part long, bits binary")
    # A fixed number of counts, whatever the corpus: 2**SKETCH_BITS.
    total = np.zeros(1 << SKETCH_BITS, np.uint32).reshape(-1, SKETCH_PART)
    for k, c in summed.collect():
        total[k] = np.frombuffer(c, "<u4")
    return rows.where("part is null").drop("part"), levels(total.ravel())


def levels(total: np.ndarray) -> np.ndarray:
    """Popularity 0 to 15 of each bucket: the logarithm of its count above the mean, which is what rare
    shingles leave in a bucket. A passage of a few dozen documents then stands out also where
    a bucket holds more rare shingles than that."""
    mean, out = int(total.mean()), np.empty(len(total), np.uint8)
    for lo in range(0, len(total), 1 << 16):      # in parts: the driver holds little beside the counts
        above = np.maximum(total[lo:lo + (1 << 16)].astype(np.int64) - mean, 1)
        out[lo:lo + (1 << 16)] = np.minimum(np.floor(np.log2(above)), 15)
    return out


def _first_of_each(cid: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Rows that hold a class for the first time in this chunk."""
    first = np.zeros(len(cid), bool)
    first[np.unique(cid, return_index=True)[1]] = True
    return np.flatnonzero(first & ok) if ok.all() else np.flatnonzero(ok)[np.unique(cid[ok], return_index=True)[1]]


def _prefixes(spark: SparkSession, docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(h, n, cid): prefix shingles of each class (once or more)."""
    shared = spark.sparkContext.broadcast(level)           # 2**SKETCH_BITS bytes, always

    def run(batches):
        for b in batches:
            for _, _, buf, offs in text_chunks(b.column("text")):
                s = Sets(buf, offs)
                prefix, count = s.prefixes(shared.value)
                keep = _first_of_each(s.cid, s.n > 0)
                at = np.cumsum(count) - count
                size = count[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix[ranges(at[keep], size)]), pa.array(np.repeat(s.n[keep], size)),
                     pa.array(np.repeat(s.cid[keep], size))], names=["h", "n", "cid"])

    return map_arrow(spark, docs.select("text"), run, "h long, n long, cid long")


def _sets_of(spark: SparkSession, docs: DataFrame, rows: DataFrame, cids: DataFrame) -> DataFrame:
    """(cid, items): sorted set arrays of the asked classes (and of a few
    others, and some more than once)."""
    texts = rows.where("n > 0").groupBy("cid").agg(F.min("th").alias("th")).join(cids, "cid", "left_semi").select("th")

    def mark(batches):
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for b in batches:
            for k in _bloom(b.column("th").to_numpy()):
                bits[k] = True
        packed = np.packbits(bits).reshape(-1, SKETCH_PART)
        some = np.flatnonzero(packed.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_pydict({"part": some, "bits": pa.array([packed[k].tobytes() for k in some])})

    def join(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("part").to_pylist(), b.column("bits").to_pylist()):
                held[k] = held.get(k, np.uint8(0)) | np.frombuffer(c, np.uint8)
        if held:
            yield pa.RecordBatch.from_pydict({"part": list(held), "bits": [v.tobytes() for v in held.values()]})

    marks = map_arrow(spark, texts, mark, "part long, bits binary", 20_000).repartition("part")
    bloom = np.zeros(((1 << BLOOM_BITS) // 8 // SKETCH_PART, SKETCH_PART), np.uint8)       # of fixed size
    for k, c in map_arrow(spark, marks, join, "part long, bits binary", 20_000).collect():
        bloom[k] = np.frombuffer(c, np.uint8)
    shared = spark.sparkContext.broadcast(np.unpackbits(bloom.ravel()).view(bool))       # no copy in the driver

    def run(batches):
        for b in batches:
            ok = np.logical_and.reduce([shared.value[k] for k in _bloom(b.column("th").to_numpy())])
            text = b.column("text").filter(pa.array(ok))
            for _, _, buf, offs in text_chunks(text):
                s = Sets(buf, offs)
                keep = _first_of_each(s.cid, s.n > 0)
                raw = s.value.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.cid[keep]), pa.array([raw[8 * s.at[k]:8 * s.at[k + 1]] for k in keep], pa.binary())],
                    names=["cid", "items"])

    return map_arrow(spark, docs.select("text", "th"), run, "cid long, items binary")


def _bloom(th: np.ndarray) -> list[np.ndarray]:
    h = mix64(th.astype(np.int64).view(np.uint64))
    low = np.uint64((1 << BLOOM_BITS) - 1)
    return [(h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)]


# ------------------------------------------------------------------ pairs
def _runs(spark: SparkSession, met: DataFrame) -> DataFrame:
    """(h, n, cid): prefix shingles met in two classes or more."""

    def run(batches):
        last = None            # the row before, and whether it is still alone at its shingle
        for b in batches:
            r = np.stack([b.column(x).to_numpy() for x in ("h", "n", "cid")])
            new = np.ones(r.shape[1], bool)               # copies of a class stand side by side
            new[1:] = (r[0, 1:] != r[0, :-1]) | (r[2, 1:] != r[2, :-1])
            if last is not None and len(new):
                new[0] = r[0, 0] != last[0][0, 0] or r[2, 0] != last[0][2, 0]
            r = r[:, new]
            if not r.shape[1]:
                continue
            if last is not None:
                r = np.concatenate((last[0], r), axis=1)
            same = np.concatenate(([False], r[0, 1:] == r[0, :-1], [False]))
            keep = (same[1:] | same[:-1])[:-1]             # the last row waits for the next batch
            if last is not None and not last[1]:
                keep[0] = False                            # it has gone out already
            out = r[:, :-1][:, keep]
            alone = not same[-2]
            if not alone:
                out = np.concatenate((out, r[:, -1:]), axis=1)
            last = (r[:, -1:], alone)
            if out.shape[1]:
                yield pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["h", "n", "cid"])

    met = met.repartition("h").sortWithinPartitions("h", "n", "cid")
    return stage(spark, map_arrow(spark, met, run, "h long, n long, cid long", 20_000), "jaccard-runs")


def _mixed(spark: SparkSession, runs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(h, n, cid, comp, met): rows of runs with several components; met is the run's size."""
    if comps is None:
        rows = runs.withColumn("comp", F.col("cid"))
    else:
        rows = _with_component(runs, comps)
    several = (rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("met"))
               .where("lo < hi").select("h", "met"))
    return stage(spark, rows.join(several, "h"), "jaccard-mixed")


def _stars(mixed: DataFrame) -> DataFrame:
    """One pair (a, b) per class of a mixed run: with the hub that it met most
    often. The hub of a run is the class that meets most others at all its
    shingles, which of near copies is the one with the fewest changes."""
    weight = mixed.groupBy("cid").agg(F.sum("met").alias("s"))
    hubs = (mixed.join(weight, "cid").groupBy("h")
            .agg(F.max_by(F.struct("cid", "n", "comp"), F.struct("s", "cid")).alias("hub"))
            .select("h", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.comp").alias("hub_comp")))
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * PERCENT
    return (mixed.join(hubs, "h").where((F.col("comp") != F.col("hub_comp")) & fits)
            .groupBy("cid", "hub").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("cid").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
            .select(F.col("hub").alias("a"), F.col("cid").alias("b")))


def _passing(spark: SparkSession, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, most) whose signatures allow a link; most bounds their Jaccard similarity."""
    def run(batches):
        for b in batches:
            n_a, n_b = b.column("na").to_numpy(), b.column("nb").to_numpy()
            most = bound(n_a, n_b, b.column("ba").to_pylist(), b.column("bb").to_pylist())
            got = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(most / (n_a + n_b - most))],
                                             names=["a", "b", "most"])
            yield got.filter(pa.array(linked(most, n_a + n_b)))

    def side(x):
        return classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))

    return map_arrow(spark, pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ba", "bb"),
                     run, "a long, b long, most double", 2000)


def _links(spark: SparkSession, pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by exact intersection of their sorted arrays.
    The partners of a class meet its array in groups of about ``TILE``."""
    pairs = stage(spark, pairs, "jaccard-pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("k"))
    partner = pairs.join(groups, "a").select(F.col("b").alias("cid"), "a", F.pmod(F.xxhash64("b"), "k").cast("int").alias("g"),
                                             F.lit(1).alias("side"))
    own = groups.select(F.col("a").alias("cid"), "a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("g"),
                        F.lit(0).alias("side"))
    needed = stage(spark, partner.union(own), "jaccard-needed")
    sets = _sets_of(spark, docs, rows, needed.select("cid").distinct())

    def run(batches):
        at, own, before = None, None, None
        for b in batches:
            keys = zip(*[b.column(x).to_pylist() for x in ("a", "g", "side", "cid", "items")])
            found_a, found_b = [], []
            for a, g, side, cid, items in keys:
                items = np.frombuffer(items, "<u8")
                if side == 0:
                    at, own, before = (a, g), items, None
                elif at == (a, g) and cid != before:              # a set may come more than once
                    k = np.minimum(np.searchsorted(own, items), len(own) - 1)
                    if linked(int((own[k] == items).sum()), len(own) + len(items)):
                        found_a.append(a)
                        found_b.append(cid)
                    before = cid
            yield pa.RecordBatch.from_pydict({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    met = (sets.join(needed, "cid").repartition("a", "g").sortWithinPartitions("a", "g", "side", "cid")
           .select("a", "g", "side", "cid", "items"))
    return map_arrow(spark, met, run, "a long, b long", 500).distinct()


def _counted(spark: SparkSession, mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share enough prefix shingles,
    from rows (h, n, cid, comp) of short runs. Of two prefixes the one that ends
    first holds every shingle they share, so a link leaves at least
    ``needed - n + prefix`` of them there."""

    def run(batches):
        held = None
        for b in batches:
            r = np.stack([b.column(x).to_numpy() for x in ("h", "n", "cid", "comp")])
            r = np.concatenate((held, r), axis=1) if held is not None else r
            cut = int(np.searchsorted(r[0], r[0, -1])) if r.shape[1] else 0     # the last run may go on
            held = r[:, cut:]
            yield pairs_of(r[:, :cut])
        if held is not None:
            yield pairs_of(held)

    def pairs_of(r):
        h, n, cid, comp = r
        out, d = [np.zeros((4, 0), np.int64)], 1
        while d < len(h):
            i = np.flatnonzero(h[d:] == h[:-d])
            if not len(i):
                break
            i = i[(comp[i] != comp[i + d]) & (100 * n[i] >= PERCENT * n[i + d])]       # n ascends in a run
            x, y = np.where(cid[i] < cid[i + d], i, i + d), np.where(cid[i] < cid[i + d], i + d, i)
            out.append(np.stack([cid[x], cid[y], n[x], n[y]]))
            d += 1
        got, count = np.unique(np.concatenate(out, axis=1), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([*map(pa.array, got), pa.array(count)], names=["a", "b", "na", "nb", "c"])

    dealt = mixed.repartition("h").sortWithinPartitions("h", "n", "cid")
    pairs = (map_arrow(spark, dealt, run, "a long, b long, na long, nb long, c long", 20_000)
             .groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")))
    needed = F.ceil(F.lit(PERCENT) * (F.col("na") + F.col("nb")) / F.lit(100 + PERCENT))
    beyond = lambda n: F.ceil(F.col(n) * PERCENT / 100) - 1                 # size less prefix
    return pairs.where(F.col("c") >= needed - F.greatest(beyond("na"), beyond("nb"))).select("a", "b")


def _tiles(spark: SparkSession, mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components whose signatures allow a link,
    from rows (h, n, cid, comp, bits) of runs with several components."""
    rows = mixed.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int"))
    sizes = rows.groupBy("h", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("k"))
    near = [sizes.select("h", (F.col("band") + d).alias("band"), F.col("k").alias(name))
            for d, name in ((0, "k0"), (-1, "k_up"), (1, "k_down"))]
    for t in near:
        rows = rows.join(t, ["h", "band"], "left")
    own = F.pmod(F.xxhash64("cid"), F.col("k0")).cast("int")
    each = lambda k: F.when(k.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), k - 1))
    tile = lambda band, kind, x, y, side: F.struct(band.alias("band"), F.lit(kind).alias("kind"), x.alias("x"),
                                                   y.alias("y"), side.alias("side"))
    band = F.col("band")
    tiles = F.concat(
        F.transform(each(F.col("k0")), lambda t: tile(band, 0, F.least(own, t), F.greatest(own, t),
                                                     F.when(own < t, 0).when(own > t, 1).otherwise(2))),
        F.transform(each(F.col("k_up")), lambda t: tile(band, 1, own, t, F.lit(0))),
        F.transform(each(F.col("k_down")), lambda t: tile(band - 1, 1, t, own, F.lit(1))))
    dealt = rows.select("h", F.explode(tiles).alias("t"), "n", "cid", "comp", "bits").select("h", "t.*", "n", "cid", "comp", "bits")
    return _compared(spark, dealt, ["h", "band", "kind", "x", "y"])


def _large(spark: SparkSession, mixed: DataFrame, comps: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a class and the members of another component that holds
    LARGE classes or more of a run, if their signatures allow a link. The
    members of a component are dealt once, in blocks, whatever the number of
    runs; ``mixed`` has (h, cid, comp, large) with large the run's large components."""
    touch = (mixed.select("cid", "comp", "large", F.explode("large").alias("with"))
             .where((F.col("comp") != F.col("with")) & (~F.array_contains("large", F.col("comp")) | (F.col("comp") < F.col("with"))))
             .select("cid", "with").distinct())
    touch = stage(spark, touch, "jaccard-touch")
    blocks = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    asked = touch.groupBy("with").agg(blocks(F.count(F.lit(1))).alias("kx"))
    nodes = comps.select(F.col("a").alias("cid"), F.col("b").alias("with")).union(
        comps.select(F.col("b").alias("cid"), F.col("b").alias("with")).distinct())
    members = nodes.join(asked, "with")
    sizes = members.groupBy("with").agg(blocks(F.count(F.lit(1))).alias("ky"), F.first("kx").alias("kx"))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = lambda k: F.pmod(F.xxhash64("cid"), F.col(k)).cast("int")
    dealt = (members.drop("kx").join(sizes, "with")
             .select("with", own("ky").alias("y"), each("kx").alias("x"), "cid", F.lit(0).alias("side"), F.col("with").alias("comp"))
             .unionByName(touch.join(sizes, "with")
                          .select("with", own("kx").alias("x"), each("ky").alias("y"), "cid", F.lit(1).alias("side"),
                                  F.lit(0).cast("long").alias("comp"))))
    return _compared(spark, dealt.join(classes, "cid"), ["with", "x", "y"])


def _compared(spark: SparkSession, dealt: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (a, b) of the rows of each tile (key, n, cid, comp, side, bits) of
    different sides (2: any) and components whose signatures allow a link."""

    def compare(tile_no, n, cid, comp, side, bits):
        d = 1
        while True:
            i = np.flatnonzero(tile_no[d:] == tile_no[:-d]) if d < len(tile_no) else np.zeros(0, np.int64)
            if not len(i):
                return
            j = i + d
            ok = (comp[i] != comp[j]) & (cid[i] != cid[j]) & ((side[i] != side[j]) | (side[i] == 2))
            ok &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            if len(i):
                most = bound(n[i], n[j], [bits[k] for k in i], [bits[k] for k in j])
                good = linked(most, n[i] + n[j])
                i, j, most = i[good], j[good], most[good]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(cid[i], cid[j]), "b": np.maximum(cid[i], cid[j]),
                                                  "most": most / (n[i] + n[j] - most)})
            d += 1

    def run(batches):
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None and held.num_rows else t
            keys = np.stack([t.column(k).to_numpy().astype(np.int64) for k in key])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            cut = int(new[-1]) + 1 if len(new) else 0
            yield from tiles_of(t.slice(0, cut), keys[:, :cut])
            held = t.slice(cut)            # the last tile, of 2 * TILE rows at most
        if held is not None:
            yield from tiles_of(held, np.stack([held.column(k).to_numpy().astype(np.int64) for k in key]))

    def tiles_of(t, keys):
        if t.num_rows > 1:
            no = np.cumsum(np.concatenate(([0], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            yield from compare(no, *[t.column(x).to_numpy() for x in ("n", "cid", "comp", "side")],
                               t.column("bits").to_pylist())

    dealt = (dealt.repartition(*key).sortWithinPartitions(*key)
             .select(*key, "n", "cid", "comp", "side", "bits"))
    return map_arrow(spark, dealt, run, "a long, b long, most double", 5000)


def _with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return (rows.join(comps.select(F.col("a").alias("cid"), F.col("b").alias("root")), "cid", "left")
            .withColumn("comp", F.coalesce("root", "cid")).drop("root"))


def _ends(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """``pairs`` with the components of both ends (ca, cb), where they differ."""
    out = pairs
    for x in ("a", "b"):
        side = comps.select(F.col("a").alias("node"), F.col("b").alias("root"))
        out = (out.join(side, F.col(x) == F.col("node"), "left").withColumn(f"c{x}", F.coalesce("root", x))
               .drop("node", "root"))
    return out.where("ca <> cb")


def _likeliest(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Of the pairs of a class with a component, the one whose bound is highest."""
    ends = _ends(pairs, comps)
    one = ends.groupBy("a", "cb").agg(F.max_by("b", F.struct("most", "b")).alias("b")).select("a", "b")
    other = ends.groupBy("b", "ca").agg(F.max_by("a", F.struct("most", "a")).alias("a")).select("a", "b")
    return one.union(other).distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    return _ends(pairs, comps).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, cid, comp) per document; th is a hash of its
    text, cid its class of equal sets, comp its component (null without shingles)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    rows, level = _summary(spark, docs)
    runs = _runs(spark, _prefixes(spark, docs, level))
    classes = stage(spark, rows.where("n > 0").select("cid", "n", "bits").dropDuplicates(["cid"]), "jaccard-classes")

    comps = None
    for _ in range(STARS):
        found = _links(spark, _passing(spark, _stars(_mixed(spark, runs, comps)), classes).drop("most"), docs, rows)
        comps = components(spark, found if comps is None else comps.union(found))

    mixed = _mixed(spark, runs, comps)
    large = (mixed.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LARGE)
             .groupBy("h").agg(F.collect_list("comp").alias("large")))             # at most met / LARGE
    some = stage(spark, mixed.where(F.col("met") > LARGE).join(large, "h"), "jaccard-large")
    # The rest of those runs, and the runs without a large component.
    rest = (mixed.where(F.col("met") > LARGE).join(large, "h", "left_anti").drop("met")
            .unionByName(some.where(~F.array_contains("large", F.col("comp"))).select("h", "n", "cid", "comp")))
    rest = stage(spark, rest.join(rest.groupBy("h").agg(F.count(F.lit(1)).alias("met")), "h"), "jaccard-rest")
    short = mixed.where(F.col("met") <= LARGE).unionByName(rest.where(F.col("met") <= SHORT_RUN))
    pairs = (_passing(spark, _counted(spark, short.drop("met")), classes)
             .union(_tiles(spark, rest.where(F.col("met") > SHORT_RUN).join(classes.select("cid", "bits"), "cid")))
             .union(_large(spark, some, comps, classes)))
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("most").alias("most"))
    pairs = stage(spark, pairs, "jaccard-passing")
    # First the likeliest partner in every other component, then what is still apart.
    for find in (_likeliest, _apart):
        comps = components(spark, comps.union(_links(spark, find(pairs, comps), docs, rows)))
    return (_with_component(rows.drop("bits"), comps)
            .withColumn("comp", F.when(F.col("n") > 0, F.col("comp"))).withColumnRenamed("n", "n_shingles"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    found = near_duplicates(spark, read_table(spark, sf_dir, "documents"))
    least = found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return found.join(least, "comp", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


@keeps_columns
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, that with the
    smallest doc_id (ties by a hash of the text); documents without words all stay."""
    columns = docs.columns
    found = near_duplicates(spark, docs).where("comp is not null")
    kept = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "th")).alias("k"))
    kept = stage(spark, kept.select(F.col("k.doc_id").alias("jk_id"), F.col("k.th").alias("jk_th")), "jaccard-kept")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumn("jk", F.xxhash64("text"))
    one = (keyed.where(words).join(kept, F.col("doc_id").eqNullSafe(F.col("jk_id")) & (F.col("jk") == F.col("jk_th")))
           .dropDuplicates(["doc_id", "jk"]))
    return one.select(*[F.col(f"`{c}`") for c in columns]).union(docs.where(~words).select(*[F.col(f"`{c}`") for c in columns]))
