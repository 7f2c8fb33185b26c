"""LM scoring by masked pseudo-likelihood (operator 5).

A window network reads ``SIDE`` words on both sides of a masked word and predicts it:
one table of vectors per place of the window, one tanh layer, and a softmax in two
steps (class, then word in the class). It knows the corpus's most frequent words and
hash buckets for all others. A word of a bucket has the bucket's probability times
its share of the bucket, ``count / (count of the bucket + 1)``, from the table
of counts of all words of the corpus, which grows with the corpus and is joined by
word; the one count that is left over stands for words that the corpus lacks. A document's score
is the sum of its words' log-probabilities given both sides.

Texts are encoded once, into a table of word ids. Training is numpy inside tasks: documents are
dealt to shards of about ``SHARD_WORDS`` words by a hash of their id and words, whose number follows
the corpus and not the cluster. In each of ``ROUNDS`` rounds a shard starts from the shared model and
goes once over its documents with Adagrad steps; every ``ROUNDS``-th word is a target, others each round, so that
every word of the corpus is a target once. The shards' models are averaged by their
number of targets in Spark, part by part. A model has a fixed size; it alone and the
totals of the buckets are collected.

Words: runs of non-space signs of the text with A-Z lower-cased, with signs split
from letters and digits.

Defined cases: null or empty text has no words and log_prob 0; per_word is
null then; repeated rows are scored each; without any word all scores are
0; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.common import (ALNUM, LOWER, NONSPACE, ByteHash, map_arrow, read_table, scratch, stage,
                                 text_chunks)

CLASSES = 64                      # classes, and words in a class
WORDS = CLASSES * CLASSES
BUCKETS = 1024                    # ids of words outside the vocabulary; id 0 stands beside a text
FIRST_BUCKET = WORDS - BUCKETS
HIDDEN, SIDE = 32, 2              # the last hidden unit is always 1, so its weights are the biases
ROUNDS, BATCH, RATE = 2, 8192, 0.1
BLOCK = 1024                      # rows of a batch that numpy works on at a time
SHARD_WORDS = 1 << 22
CHUNK_WORDS = 1 << 17             # words that a training task shuffles at a time
SCORED = 1 << 15                  # words scored at a time
SEED = 5
SHARE_UNIT = 1 << 20              # log shares are summed in this part of one
PART = 1 << 14                    # numbers in a row of the averaged model

SHAPES = {"win": (2 * SIDE, WORDS, HIDDEN), "b1": (HIDDEN,), "wc": (HIDDEN, CLASSES), "ww": (CLASSES, HIDDEN, CLASSES)}


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the texts' offsets."""
    low = LOWER[buf]
    kind = np.where(ALNUM[low], 1, 2) * NONSPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1], [True])) | edge
    s = np.flatnonzero(change[:-1] & (kind > 0))
    e = np.flatnonzero(change[1:] & (kind > 0)) + 1
    return ByteHash(low).spans(s, e), np.searchsorted(s, offs)


class Vocabulary:
    """Ids 1.. of frequent words by hash; a bucket for every other, with the
    number of its words in the corpus. ``counts`` is the folder of the table (word, n) of all words."""

    def __init__(self, hashes: np.ndarray, totals: np.ndarray | None = None, counts: str | None = None):
        self.sorted = np.sort(hashes)
        self.totals = np.zeros(BUCKETS, np.int64) if totals is None else totals
        self.counts = counts

    def ids(self, h: np.ndarray) -> np.ndarray:
        other = (h % np.uint64(BUCKETS)).astype(np.int64) + FIRST_BUCKET
        if not len(self.sorted):
            return other
        k = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[k] == h, k + 1, other)


def new_model() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    scale = {"win": 0.25, "wc": HIDDEN ** -0.5, "ww": HIDDEN ** -0.5}
    return {k: (rng.standard_normal(s) * scale[k] if k in scale else np.zeros(s)).astype(np.float32)
            for k, s in SHAPES.items()}


def pack(model: dict[str, np.ndarray]) -> np.ndarray:
    flat = np.concatenate([model[k].ravel() for k in SHAPES])
    return np.pad(flat, (0, -len(flat) % PART))


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at:at + n].reshape(s).astype(np.float32)
        at += n
    return out


def padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with SIDE zeros around each text, and the places of the words."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(ids)) + SIDE * (doc + 1)
    out = np.zeros(len(ids) + SIDE * len(at), np.int64)
    out[place] = ids
    return out, place


OFFSETS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def _hidden(model, context: np.ndarray) -> np.ndarray:
    h = model["win"][0].take(context[:, 0], axis=0)
    for j in range(1, 2 * SIDE):
        h += model["win"][j].take(context[:, j], axis=0)
    h += model["b1"]
    np.tanh(h, out=h)
    h[:, -1] = 1
    return h


def _softmax(x: np.ndarray) -> np.ndarray:
    """Probabilities in place of the scores ``x``."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x *= 1 / x.sum(axis=1, keepdims=True)
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the column ``at`` of each row of scores, which are overwritten."""
    x -= x.max(axis=1, keepdims=True)
    out = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return out - np.log(x.sum(axis=1))


def _by_class(target: np.ndarray):
    """Order of the rows by class, and (class, first, end) of each class in that order."""
    cls = (target // CLASSES).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    return order, [(c, cut[c], cut[c + 1]) for c in np.flatnonzero(np.diff(cut))]


def log_probs(model, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target given the words on both sides."""
    order, spans = _by_class(target)
    context, goal = context[order], target[order]
    h = _hidden(model, context)
    got = np.empty(len(target), h.dtype)
    for k in range(0, len(target), BLOCK):                       # blocks stay in the processor's cache
        got[k:k + BLOCK] = _log_softmax_at(h[k:k + BLOCK] @ model["wc"], goal[k:k + BLOCK] // CLASSES)
    for c, lo, hi in spans:
        got[lo:hi] += _log_softmax_at(h[lo:hi] @ model["ww"][c], goal[lo:hi] % CLASSES)
    out = np.empty_like(got)
    out[order] = got
    return out


def _slopes(model, context: np.ndarray, target: np.ndarray):
    """Gradient of the mean negative log-probability: dense for all but the window's tables,
    for which the rows met at each place and their gradients come second."""
    n = len(target)
    every = np.arange(n)
    order, spans = _by_class(target)
    context, goal = context[order], target[order]
    h = _hidden(model, context)

    back, wc = np.empty_like(h), np.zeros_like(model["wc"])
    for k in range(0, n, BLOCK):                                 # blocks stay in the processor's cache
        some = slice(k, k + BLOCK)
        g = _softmax(h[some] @ model["wc"])
        g[every[:len(g)], goal[some] // CLASSES] -= 1
        wc += h[some].T @ g
        np.matmul(g, model["wc"].T, out=back[some])
    out = {"wc": wc / n, "ww": np.zeros_like(model["ww"])}
    for c, lo, hi in spans:
        p = _softmax(h[lo:hi] @ model["ww"][c])
        p[every[:hi - lo], goal[lo:hi] % CLASSES] -= 1
        np.matmul(h[lo:hi].T, p, out=out["ww"][c])
        back[lo:hi] += p @ model["ww"][c].T
    out["ww"] /= n
    back /= n
    back *= 1 - h * h                                            # 0 for the unit that is always 1
    out["b1"] = back.sum(axis=0)
    rows, column = [], np.ascontiguousarray(back.T)
    for j in range(2 * SIDE):
        met = np.zeros(WORDS, bool)
        met[context[:, j]] = True
        word, number = np.flatnonzero(met), np.cumsum(met) - 1
        number, g = number[context[:, j]], np.empty((len(word), HIDDEN), back.dtype)
        for k in range(HIDDEN):
            g[:, k] = np.bincount(number, column[k], len(word))
        rows.append((word, g))
    return out, rows


def gradients(model, context: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log-probability."""
    out, rows = _slopes(model, context, target)
    out["win"] = np.zeros_like(model["win"])
    for j, (word, g) in enumerate(rows):
        out["win"][j][word] = g
    return out


class Learner:
    """A model under Adagrad steps."""

    def __init__(self, start: dict[str, np.ndarray], seed: list[int]):
        self.model = {k: v.copy() for k, v in start.items()}
        self.seen = {k: np.full(s, 1e-6, np.float32) for k, s in SHAPES.items()}
        self.rng = np.random.default_rng(seed)
        self.n = 0

    def learn(self, ids: np.ndarray, place: np.ndarray) -> None:
        """Steps over the words at ``place``, in random order."""
        place = self.rng.permutation(place)
        self.n += len(place)
        for k in range(0, len(place), BATCH):
            some = place[k:k + BATCH]
            dense, rows = _slopes(self.model, ids[some[:, None] + OFFSETS], ids[some])
            for name, g in dense.items():
                self.seen[name] += g * g
                self.model[name] -= RATE * g / np.sqrt(self.seen[name])
            for j, (word, g) in enumerate(rows):
                seen = self.seen["win"][j][word] + g * g
                self.seen["win"][j][word] = seen
                self.model["win"][j][word] -= RATE * g / np.sqrt(seen)


_PART_ROWS = "part long, weight double, numbers binary"


def _sum_parts(batches):
    """Sum of the weighted model parts that stream by, sorted by part: (part, weight, numbers)."""
    at, weight, total = None, 0.0, None
    row = lambda: pa.RecordBatch.from_pydict({"part": [at], "weight": [weight], "numbers": [total.tobytes()]})
    for b in batches:
        for k, w, raw in zip(*[b.column(x).to_pylist() for x in ("part", "weight", "numbers")]):
            v = np.frombuffer(raw, "<f4").astype("<f8") * w
            if k == at:
                weight, total = weight + w, total + v
            else:
                if at is not None:
                    yield row()
                at, weight, total = k, w, v
    if at is not None:
        yield row()


def count_words(spark: SparkSession, docs: DataFrame, known: int = FIRST_BUCKET - 1) -> Vocabulary:
    """Counts of all words over all documents, written as a table; the ``known`` most
    frequent words get ids of their own."""

    def run(batches):
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for _, _, buf, offs in text_chunks(b.column("text")):
                u, c = np.unique(word_hashes(buf, offs)[0], return_counts=True)
                key, back = np.unique(np.concatenate((key, u)), return_inverse=True)
                n = np.bincount(back, np.concatenate((n, c)), len(key)).astype(np.int64)
                if len(key) > 1_000_000:             # pass on what has gathered; memory stays bounded
                    yield pa.RecordBatch.from_pydict({"word": key.view(np.int64), "n": n})
                    key, n = key[:0], n[:0]
        yield pa.RecordBatch.from_pydict({"word": key.view(np.int64), "n": n})

    folder = scratch(spark, "lm-counts")
    (map_arrow(spark, docs.select("text"), run, "word long, n long")
     .groupBy("word").agg(F.sum("n").alias("n")).write.parquet(folder))
    counts = spark.read.parquet(folder)
    rows = counts.orderBy(F.desc("n"), "word").limit(known).select("word", "n").collect()
    own, often = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2).T
    # Buckets go by the hash as an unsigned number: BUCKETS divides 2**64, so pmod of the signed one is the same.
    by_bucket = counts.groupBy(F.pmod("word", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(BUCKETS, np.int64)
    totals[[r[0] for r in by_bucket]] = [r[1] for r in by_bucket]
    np.subtract.at(totals, own % BUCKETS, often)
    return Vocabulary(np.ascontiguousarray(own).view(np.uint64), totals, folder)


def encode(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Written table with a row (key, doc_id, ids) per document, ids as 16-bit integers, and a
    row (key, word, n) for each of its words that is in a bucket; key is one per row of ``docs``."""
    shared = spark.sparkContext.broadcast(vocabulary)            # of fixed size

    def run(batches):
        words, key = shared.value, TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                h, at = word_hashes(buf, offs)
                ids = words.ids(h)
                raw = ids.astype("<u2").tobytes()
                m, keys = hi - lo, key + np.arange(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), b.column("doc_id").slice(lo, m),
                     pa.array([raw[2 * x:2 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                     pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=_CODED)
                rare = np.flatnonzero(ids >= FIRST_BUCKET)
                if len(rare):
                    doc, word = np.repeat(np.arange(m), np.diff(at))[rare], h[rare].view(np.int64)
                    order = np.lexsort((word, doc))
                    doc, word = doc[order], word[order]
                    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[doc[first]]), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.binary()),
                         pa.array(word[first]), pa.array(np.diff(np.append(first, len(doc))))], names=_CODED)
                key += m

    return stage(spark, map_arrow(spark, docs.select("doc_id", "text"), run,
                                  "key long, doc_id long, ids binary, word long, n long"), "lm-coded")


_CODED = ["key", "doc_id", "ids", "word", "n"]


def train(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, coded: DataFrame | None = None) -> dict[str, np.ndarray]:
    """The model of ``docs``, whose encoded table may be given."""
    coded = encode(spark, docs, vocabulary) if coded is None else coded
    texts = coded.where("word is null and length(ids) > 0").select("ids", F.xxhash64("doc_id", "ids").alias("o"))
    total = texts.agg(F.sum(F.length("ids"))).first()[0] or 0
    shards = max(1, -(-total // (2 * SHARD_WORDS)))
    dealt = (texts.withColumn("shard", F.pmod("o", F.lit(shards)).cast("int")).repartitionById(shards, "shard")
             .sortWithinPartitions("shard", "o", "ids").select("shard", "ids"))
    model = new_model()
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)             # of fixed size

        def run(batches, turn=turn, shared=shared):
            at, mine, wait, words = None, None, [], 0

            def steps():
                size = np.array([len(t) for t in wait])
                offs = np.concatenate(([0], np.cumsum(size)))
                ids, place = padded(np.concatenate(wait), offs)
                own = np.arange(len(place)) - np.repeat(offs[:-1], size)            # a word's number in its text
                first = np.repeat(np.arange(len(size)), size)                       # texts take turns in starting
                mine.learn(ids, place[(own + first) % ROUNDS == turn])
                wait.clear()

            def done():
                if wait:
                    steps()
                rows = pack(mine.model).astype("<f4").reshape(-1, PART)
                return pa.RecordBatch.from_pydict(
                    {"shard": np.full(len(rows), at, np.int64), "part": np.arange(len(rows)),
                     "weight": np.full(len(rows), float(mine.n)), "numbers": pa.array([r.tobytes() for r in rows], pa.binary())})

            for b in batches:
                for shard, raw in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                    if shard != at:
                        if mine is not None:
                            yield done()
                        at, mine, words = shard, Learner(shared.value, [SEED, turn, shard]), 0
                    wait.append(np.frombuffer(raw, "<u2"))
                    words += len(wait[-1])
                    if words >= CHUNK_WORDS:
                        steps()
                        words = 0
            if mine is not None:
                yield done()

        made = (map_arrow(spark, dealt, run, "shard long, " + _PART_ROWS).where("weight > 0")
                .repartition("part").sortWithinPartitions("part", "shard").select("part", "weight", "numbers"))
        summed = map_arrow(spark, made, _sum_parts, _PART_ROWS)
        got = sorted((r[0], np.frombuffer(r[2], "<f8") / r[1]) for r in summed.collect())     # one model
        if got:
            model = unpack(np.concatenate([v for _, v in got]))
    return model


def score(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, model: dict[str, np.ndarray],
          coded: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_prob, per_word of ``docs``, whose encoded table may be given."""
    coded = encode(spark, docs, vocabulary) if coded is None else coded
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        net = shared.value
        for b in batches:
            raw = b.column("ids").to_pylist()
            size = np.array([len(r) // 2 for r in raw], np.int64)
            total, lo = np.zeros(len(raw)), 0
            while lo < len(raw):
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), CHUNK_WORDS, "right")))
                at = np.concatenate(([0], np.cumsum(size[lo:hi])))
                ids, place = padded(np.frombuffer(b"".join(raw[lo:hi]), "<u2"), at)
                got = [log_probs(net, ids[place[k:k + SCORED, None] + OFFSETS], ids[place[k:k + SCORED]])
                       for k in range(0, len(place), SCORED)]
                upto = np.concatenate(([0.0], np.cumsum(np.concatenate([*got, np.zeros(0)]), dtype=np.float64)))
                total[lo:hi] = upto[at[1:]] - upto[at[:-1]]
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("doc_id"), pa.array(size), pa.array(np.where(size > 0, total, 0.0))],
                names=["key", "doc_id", "n_words", "net"])

    scored = map_arrow(spark, coded.where("word is null").select("key", "doc_id", "ids"), run,
                       "key long, doc_id long, n_words long, net double")
    # A word's share of its bucket; sums of integers, so that their order does not matter.
    totals = F.array(*[F.lit(int(t)) for t in vocabulary.totals])
    counts = spark.read.parquet(vocabulary.counts).withColumnRenamed("n", "count")
    bucket = F.get(totals, F.pmod("word", F.lit(BUCKETS)).cast("int"))
    share = F.log(F.coalesce("count", F.lit(1)) / (bucket + 1).cast("double"))
    shares = (coded.where("word is not null").select("key", "word", "n").join(counts, "word", "left")
              .select("key", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"),
                      F.lit(None).cast("double").alias("net"), F.round(F.col("n") * share * SHARE_UNIT).cast("long").alias("share")))
    both = scored.withColumn("share", F.lit(0).cast("long")).unionByName(shares)
    whole = both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                    (F.max("net") + F.sum("share") / F.lit(float(SHARE_UNIT))).alias("log_prob"))
    return whole.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("per_word"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, log_prob, per_word."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = count_words(spark, docs)
    coded = encode(spark, docs, vocabulary)
    return score(spark, docs, vocabulary, train(spark, docs, vocabulary, coded), coded)
