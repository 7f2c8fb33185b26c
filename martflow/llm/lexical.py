"""Ranked lexical search with per-term geometric blocking (operator 12).

Every benchmark item ranks all documents by an integer term-weighting score. Corpus
statistics (documents with terms, all their terms, documents per term) are Spark
aggregates over all documents. Documents are never shuffled: each task cuts its part
of the written term rows into shards, and in a shard each term has a
posting list. A list is clustered by document similarity (sketches: random
signs times impacts, unit length; every document joins the nearest of
centres taken evenly from the list) into blocks of about ``BLOCK_DOCS``; a block's summary holds,
for every term, the largest impact in its documents. The summary's sum over an item's
terms bounds the score of every document in the block from above, so a block is skipped only
where that bound is below the item's threshold; all others are scored
exactly. Lists whose best impacts together stay below the threshold are skipped
whole, by the same bound with the list as one block.

The threshold comes from a first pass: per shard the documents at the heads of an
item's lists are scored exactly, and the ``top``-th best of all of them over all shards can
only be at or below the true one.

Items are handled in blocks of about ``ITEM_TERMS`` different terms, each block with
its vocabulary and items (bounded) sent to the tasks; more items mean more blocks.

Defined cases: null or empty texts have no terms: such documents are never
returned and do not count in the statistics; every row of documents is a document of its own, a null
doc_id ranks last among equal scores; the rows of one item_id are one item (their terms united), items
without terms and rows without item_id return nothing; empty tables give empty results; other
columns are ignored. Words are compared by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martflow.llm.common import (ALNUM, BATCH_ROWS, LOWER, ByteHash, ranges, read_table, staged_map, text_chunks,
                                 word_spans)

TOP = 50
ITEM_TERMS = 1 << 20
SHARD_POSTINGS = 1 << 19
BLOCK_DOCS = 24
SKETCH = 16
NONE = np.iinfo(np.int64).max            # sorts a null doc_id behind all others


# ------------------------------------------------------------------ terms of texts
def _item_terms(batches):
    """item_id, term (hash): the different terms of each row."""
    for b in batches:
        for lo, hi, buf, offs in text_chunks(b.column("text")):
            buf = LOWER[buf]
            s, e, cut = word_spans(buf, offs, ALNUM)
            owner = np.repeat(np.arange(lo, hi), np.diff(cut))
            term = ByteHash(buf).spans(s, e).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(owner)), pa.array(term)],
                                             names=["item_id", "term"])


def _document_terms(vocabulary: np.ndarray):
    """Map texts to (doc_id, n, terms, tfs) over ``vocabulary`` (sorted hashes)."""
    maybe = np.zeros(1 << 20, bool)
    maybe[(vocabulary & 0xFFFFF)] = True

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                buf = LOWER[buf]
                s, e, cut = word_spans(buf, offs, ALNUM)
                term = ByteHash(buf).spans(s, e).view(np.int64)
                owner = np.repeat(np.arange(hi - lo), np.diff(cut))
                hit = maybe[term & 0xFFFFF]
                term, owner = term[hit], owner[hit]
                at = np.minimum(np.searchsorted(vocabulary, term), max(len(vocabulary) - 1, 0))
                same = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
                pair, tf = np.unique((owner[same] << 32) | at[same], return_counts=True)
                ptr = np.searchsorted(pair >> 32, np.arange(hi - lo + 1)).astype(np.int32)
                n = np.diff(cut)
                rows = pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ptr), pa.array((pair & 0xFFFFFFFF).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ptr), pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))
    return run


# ------------------------------------------------------------------ one shard
class Shard:
    """Documents as rows of (term, impact), posting lists as columns."""

    def __init__(self, doc: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.doc, self.ptr, self.term, self.impact = doc, ptr, term, impact
        row = np.repeat(np.arange(len(doc)), np.diff(ptr))
        order = np.lexsort((-impact, term))                    # every list by descending impact
        self.posted = row[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        length = np.diff(self.starts)
        self.top_impact = np.zeros(n_terms, np.int64)
        some = length > 0
        self.top_impact[some] = impact[order][self.starts[:-1][some]]
        self.n_terms = n_terms
        self.wanted = np.zeros(n_terms, bool)
        self.made: dict[int, tuple] = {}
        self.sketch: np.ndarray | None = None

    def listed(self, t: int) -> np.ndarray:
        return self.posted[self.starts[t]:self.starts[t + 1]]

    def score(self, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Exact scores of documents for an item's terms."""
        self.wanted[terms] = True
        count = self.ptr[rows + 1] - self.ptr[rows]
        at = ranges(self.ptr[rows], count)
        got = np.where(self.wanted[self.term[at]], self.impact[at], 0)
        self.wanted[terms] = False
        total = np.concatenate(([0], np.cumsum(got)))
        end = np.cumsum(count)
        return total[end] - total[end - count]

    def heads(self, terms: np.ndarray, top: int) -> np.ndarray:
        return np.unique(np.concatenate([self.listed(t)[:top] for t in terms]))

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The list of ``t`` in blocks: (documents, block offsets in them, summary
        terms, summary maxima, block offsets in those)."""
        if t not in self.made:
            rows = self.listed(t)
            centres = -(-len(rows) // BLOCK_DOCS)
            near = np.zeros(len(rows), np.int64)
            if centres > 1:
                points = self.sketches()[rows]
                near = np.argmax(points @ points[::BLOCK_DOCS].T, axis=1)
            by = np.argsort(near, kind="stable")
            rows, near = rows[by], near[by]
            # A cluster of more than two blocks' documents is cut, so one crowd makes no huge block.
            first = np.searchsorted(near, near)
            cut = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1]))
                                 | ((np.arange(len(rows)) - first) % (2 * BLOCK_DOCS) == 0))
            block = np.zeros(len(rows), np.int64)
            block[cut[1:]] = 1
            block = np.cumsum(block)
            count = self.ptr[rows + 1] - self.ptr[rows]
            at = ranges(self.ptr[rows], count)
            key = np.repeat(block, count) * self.n_terms + self.term[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            most = np.maximum.reduceat(self.impact[at][order], edge)
            key = key[edge]
            self.made[t] = (rows, np.append(cut, len(rows)), key % self.n_terms, most,
                            np.searchsorted(key // self.n_terms, np.arange(len(cut) + 1)))
        return self.made[t]

    def sketches(self) -> np.ndarray:
        if self.sketch is None:
            signs = np.random.default_rng(12).integers(0, 2, (self.n_terms, SKETCH)).astype(np.float32) * 2 - 1
            full = np.flatnonzero(np.diff(self.ptr) > 0)
            self.sketch = np.zeros((len(self.doc), SKETCH), np.float32)
            self.sketch[full] = np.add.reduceat(signs[self.term] * self.impact[:, None].astype(np.float32),
                                                self.ptr[full], axis=0)
            self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-9)
        return self.sketch

    def search(self, terms: np.ndarray, theta: int, best: Best) -> None:
        """Add to ``best`` every document whose score may reach ``theta``."""
        theta = max(theta, best.floor())
        terms = terms[self.top_impact[terms] > 0]
        terms = terms[np.argsort(self.top_impact[terms], kind="stable")]
        # Documents in these lists alone stay below theta.
        skip = np.searchsorted(np.cumsum(self.top_impact[terms]), theta, "left")
        parts = [self.blocks(t) for t in terms[skip:]]
        if not parts:
            return
        self.wanted[terms] = True
        bounds = [np.add.reduceat(np.where(self.wanted[p[2]], p[3], 0), p[4][:-1]) for p in parts]
        self.wanted[terms] = False
        part = np.repeat(np.arange(len(parts)), [len(b) for b in bounds])
        number = np.concatenate([np.arange(len(b)) for b in bounds])
        bound = np.concatenate(bounds)
        order = np.argsort(-bound, kind="stable")
        seen = np.zeros(len(self.doc), bool)
        lo = 0
        while lo < len(order) and bound[order[lo]] >= theta:
            hi = lo + max(1, 4 * TOP // BLOCK_DOCS)
            take = order[lo:hi][bound[order[lo:hi]] >= theta]
            rows = np.unique(np.concatenate([parts[part[k]][0][parts[part[k]][1][number[k]]:parts[part[k]][1][number[k] + 1]]
                                             for k in take]))
            rows = rows[~seen[rows]]
            seen[rows] = True
            scores = self.score(rows, terms)
            reach = scores >= theta
            best.add(scores[reach], self.doc[rows[reach]])
            theta = max(theta, best.floor())
            lo = hi


class Best:
    """The ``top`` best (score, doc_id) met so far."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """Least score that may still enter (equal scores go by doc_id)."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            order = np.lexsort((ids, -scores))[:self.top]
            self.scores, self.ids = scores[order], ids[order]


def _shards(batches, weight: np.ndarray, n_docs: int, n_all: int):
    """Shards of about SHARD_POSTINGS postings from (doc_id, n, terms, tfs) rows."""
    def built(held):
        t = pa.Table.from_batches(held).combine_chunks()
        doc = t["doc_id"].fill_null(NONE).to_numpy().astype(np.int64)
        size = np.asarray(t["terms"].combine_chunks().value_lengths(), np.int64)
        ptr = np.concatenate(([0], np.cumsum(size)))
        term = t["terms"].combine_chunks().flatten().to_numpy().astype(np.int64)
        tf = t["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 100 - 50 + (50 * t["n"].to_numpy().astype(np.int64) * n_docs) // n_all
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, size)))
        return Shard(doc, ptr, term, impact, len(weight))

    held, postings = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            postings += len(b.column("terms").flatten())
        if postings >= SHARD_POSTINGS:
            yield built(held)
            held, postings = [], 0
    if held:
        yield built(held)


# ------------------------------------------------------------------ search
def _rank_block(spark: SparkSession, docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items of one block of (item_id, term)."""
    listed = pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms")).orderBy("item_id").toArrow()
    items = [np.array(x, np.int64) for x in listed["terms"].to_pylist()]
    ids = listed["item_id"].combine_chunks()
    vocabulary = np.unique(np.concatenate(items)) if items else np.zeros(0, np.int64)
    items = [np.searchsorted(vocabulary, x) for x in items]
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = staged_map(spark, docs.select("doc_id", "text"), _document_terms(vocabulary),
                      f"doc_id {kind}, n long, terms array<int>, tfs array<int>", BATCH_ROWS, "lexical-terms")
    n_docs, n_all = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_all = max(n_all or 0, 1)
    df = F.col("df").cast("double")
    weights = (held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
               .select("term", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * df + 1))).alias("w")).toArrow())
    weight = np.zeros(len(vocabulary), np.int64)              # as many rows as the vocabulary at most
    weight[weights["term"].to_numpy()] = weights["w"].to_numpy()

    def heads(batches):
        best = [Best(top) for _ in items]
        for shard in _shards(batches, weight, n_docs, n_all):
            for b, terms in zip(best, items):
                rows = shard.heads(terms, top)
                scores = shard.score(rows, terms)
                reach = scores >= b.floor()
                b.add(scores[reach], shard.doc[rows[reach]])
        yield _best_rows(best)

    first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    seeds = (held.mapInArrow(heads, "item int, doc_id long, score long").withColumn("nth", first)
             .where(F.col("nth") == top).select("item", "score").toArrow())          # a row per item of the block
    theta = np.ones(len(items), np.int64)
    theta[seeds["item"].to_numpy()] = np.maximum(seeds["score"].to_numpy(), 1)

    def search(batches):
        best = [Best(top) for _ in items]
        for shard in _shards(batches, weight, n_docs, n_all):
            for b, terms, least in zip(best, items, theta):
                shard.search(terms, int(least), b)
        rows = _best_rows(best)
        yield pa.RecordBatch.from_arrays([ids.take(rows.column("item")), rows.column("doc_id"), rows.column("score")],
                                         names=["item_id", "doc_id", "score"])

    kind = pairs.schema["item_id"].dataType.simpleString()
    return staged_map(spark, held, search, f"item_id {kind}, doc_id long, score long", BATCH_ROWS, "lexical-found")


def _best_rows(best: list[Best]) -> pa.RecordBatch:
    size = [len(b.ids) for b in best]
    ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
    scores = np.concatenate([b.scores for b in best]) if best else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(len(best), dtype=np.int32), size)), pa.array(ids, mask=ids == NONE), pa.array(scores)],
        names=["item", "doc_id", "score"])


def rank_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` best documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    pairs = staged_map(spark, items.where(F.col("item_id").isNotNull()).select("item_id", "text"), _item_terms,
                       f"item_id {kind}, term long", BATCH_ROWS, "lexical-items").distinct()
    count = -(-pairs.count() // ITEM_TERMS)
    found = None
    for k in range(count):
        part = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k)
        block = _rank_block(spark, docs, part, top)
        found = block if found is None else found.unionByName(block)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return (found.withColumn("rank", rank).where(F.col("rank") <= top)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score."""
    return rank_documents(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
