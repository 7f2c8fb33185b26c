"""Benchmark decontamination with suffix arrays of the training shards (operator 1).

Every task turns its documents, a chunk at a time, into shards of word
symbols, sorts a suffix array of each shard (packed prefix, then prefix
doubling on ties) and binary-searches every suffix of the benchmark in it.
The search narrows a suffix-array range word by word, which gives the longest
verbatim match of each test suffix and its places, and the places of every
window of ``WINDOW`` words (an item of fewer words is one window). The
documents themselves are never shuffled.

The benchmark is cut into blocks of about ``BLOCK_BYTES`` of text, each written
once to the shared folder by the task that made it; a shard probes one block
after the other, so a task holds one block at a time whatever the size of the
benchmark. Symbols are ranks of the words' 64-bit hashes among a block's
words; 0 is any other word or the end of a document.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

Defined cases: null or empty text has no words and is clean; items that are
null, empty or have a null item_id are no windows; repeated item ids count once; repeated documents are
judged each; without items every document is clean; empty tables give empty
results; other columns are ignored (kept by ``decontaminate``).
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.common import (ALNUM, LOWER, keeps_columns, map_arrow, ngram_hash,
                                 ranges, read_table, scratch, text_chunks, word_spans, ByteHash)
from martflow.llm.tokens import _fs as filesystem

WINDOW = 10
BLOCK_BYTES = 8 << 20


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    s, e, at = word_spans(low, offs, ALNUM)
    return ByteHash(low).spans(s, e), at


# ------------------------------------------------------------ benchmark side
class Block:
    """Some benchmark items: their words as symbols 1.. of ``vocab``, 0 after
    each item; the distinct windows with the items that hold them."""

    def __init__(self, item_ids: np.ndarray, hashes: np.ndarray, at: np.ndarray):
        self.vocab = np.unique(hashes)
        n = np.diff(at)
        item = np.repeat(np.arange(len(n)), n)
        self.sym = np.zeros(len(hashes) + len(n) + 1, np.int64)
        pos = np.arange(len(hashes)) + item
        self.sym[pos] = np.searchsorted(self.vocab, hashes) + 1
        self.start, self.item = pos, item_ids[item]              # every test suffix
        self.word = np.arange(len(hashes)) - at[item]
        left = n[item] - self.word
        need = np.minimum(n[item], WINDOW)
        own = np.flatnonzero((left >= need) & ((need == WINDOW) | (self.word == 0)))
        key = np.zeros(len(own), np.uint64)
        for m in np.unique(need[own]):
            k = need[own] == m
            key[k] = ngram_hash(hashes, int(m))[own[k]]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        self.window = own[first]                                 # one suffix per distinct window
        self.need = need[self.window]
        pairs = np.unique(np.stack([which, self.item[own]]), axis=1) if len(own) else np.zeros((2, 0), np.int64)
        self.items = pairs[1]
        self.items_at = np.searchsorted(pairs[0], np.arange(len(first) + 1))
        self.longest = int(n.max()) if len(n) else 0


def write_blocks(spark: SparkSession, benchmark: DataFrame) -> tuple[str, list[str]]:
    """Write the benchmark's blocks; returns the folder and the file names."""
    path = scratch(spark, "benchmark-blocks")
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // BLOCK_BYTES))

    def run(batches):
        ids, hashes, counts = [], [], []
        for b in batches:
            key = b.column("item_id").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                h, at = word_hashes(buf, offs)
                ids.append(key[lo:hi])
                hashes.append(h)
                counts.append(np.diff(at))
        if not ids or not sum(len(h) for h in hashes):
            return
        out = io.BytesIO()
        np.savez(out, ids=np.concatenate(ids), hashes=np.concatenate(hashes), counts=np.concatenate(counts))
        fs, p = filesystem(path)
        fs.create_dir(p, recursive=True)
        name = f"block-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.npz"
        with fs.open_output_stream(f"{p}/{name}", compression=None) as f:
            f.write(out.getvalue())
        yield pa.RecordBatch.from_pydict({"file": [name]})

    dealt = items.repartition(parts, "item_id", "text")
    return path, sorted(r[0] for r in map_arrow(spark, dealt, run, "file string").collect())     # a name per block


def load_block(path: str, name: str) -> Block:
    fs, p = filesystem(path)
    with fs.open_input_file(f"{p}/{name}") as f:
        z = np.load(io.BytesIO(f.read()))
        return Block(z["ids"], z["hashes"], np.concatenate(([0], np.cumsum(z["counts"]))))


# ------------------------------------------------------------- training side
class Shard:
    """Suffix array over the symbols of some documents."""

    def __init__(self, sym: np.ndarray, symbols: int, depth: int):
        bits = max(1, int(symbols).bit_length())
        self.bits, self.packed = bits, max(1, 63 // bits)
        self.sym = np.concatenate((sym, np.zeros(self.packed + 1, sym.dtype)))
        n = len(sym)
        key = np.zeros(n, np.uint64)
        for j in range(self.packed):
            key = (key << np.uint64(bits)) | self.sym[j:j + n].astype(np.uint64)
        at = np.flatnonzero(sym)
        order = np.argsort(key[at], kind="stable")
        self.sa, self.key = at[order], key[at][order]
        self._refine(n, depth)

    def _refine(self, n: int, depth: int) -> None:
        """Prefix doubling on ties until suffixes differ or match ``depth`` words."""
        sa, size = self.sa, len(self.sa)
        rank = np.zeros(n + 1, np.int64)               # 0: ends here
        head = np.concatenate(([True], self.key[1:] != self.key[:-1])) if size else np.zeros(0, bool)
        k = self.packed
        while size and k < depth:
            first = np.flatnonzero(head)
            group = np.repeat(first, np.diff(np.append(first, size)))
            rank[sa] = group + 1
            tied = np.flatnonzero(np.repeat(np.diff(np.append(first, size)) > 1, np.diff(np.append(first, size))))
            if not len(tied):
                break
            nxt = rank[np.minimum(sa[tied] + k, n)]
            order = np.lexsort((nxt, group[tied]))
            sa[tied], nxt = sa[tied][order], nxt[order]
            head[tied[1:]] |= nxt[1:] != nxt[:-1]
            k *= 2

    def _bound(self, lo: np.ndarray, hi: np.ndarray, d: int, want: np.ndarray, right: bool) -> np.ndarray:
        """First place in [lo, hi) whose suffix has at word d a symbol not
        below (``right``: above) the wanted one."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            got = self.sym[np.minimum(self.sa[np.where(open_, mid, 0)] + d, len(self.sym) - 1)]
            low = open_ & ((got <= want) if right else (got < want))
            lo = np.where(low, mid + 1, lo)
            hi = np.where(open_ & ~low, mid, hi)

    def search(self, test: np.ndarray, start: np.ndarray, depth: int):
        """For depth 1, 2, ... yields (suffixes that match so far, their ranges)."""
        live = np.arange(len(start))
        prefix = np.zeros(len(start), np.uint64)
        lo = hi = None
        for d in range(depth):
            want = test[start[live] + d]
            keep = want > 0
            live, want = live[keep], want[keep]
            if d < self.packed:
                prefix = (prefix[keep] << np.uint64(self.bits)) | want.astype(np.uint64)
                shift = np.uint64(self.bits * (self.packed - d - 1))
                lo = np.searchsorted(self.key, prefix << shift)
                hi = np.searchsorted(self.key, (prefix << shift) | ((np.uint64(1) << shift) - np.uint64(1)), "right")
            else:
                lo, hi = lo[keep], hi[keep]
                lo, hi = self._bound(lo, hi, d, want, False), self._bound(lo, hi, d, want, True)
            found = hi > lo
            live, lo, hi = live[found], lo[found], hi[found]
            if d < self.packed:
                prefix = prefix[found]
            if not len(live):
                return
            yield d + 1, live, lo, hi


def shard_of(block: Block, hashes: np.ndarray, at: np.ndarray) -> tuple[Shard, np.ndarray]:
    """The shard of some documents for a block, and each document's first place."""
    k = np.searchsorted(block.vocab, hashes)
    k[k == len(block.vocab)] = 0
    sym = np.where(block.vocab[k] == hashes, k + 1, 0)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    full = np.zeros(len(hashes) + len(at), np.int64)
    full[np.arange(len(hashes)) + doc] = sym
    return Shard(full, len(block.vocab), block.longest), at[:-1] + np.arange(len(at) - 1)


def hits(block: Block, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words a window covers, and distinct (document, item) pairs."""
    shard, first = shard_of(block, hashes, at)
    cover = np.zeros(len(hashes) + 1, np.int64)
    docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d, live, lo, hi in shard.search(block.sym, block.start[block.window], min(WINDOW, block.longest)):
        done = block.need[live] == d
        if done.any():
            w, a, n = live[done], lo[done], (hi - lo)[done]
            place = shard.sa[ranges(a, n)]
            doc = np.searchsorted(first, place, "right") - 1
            word = place - doc
            np.add.at(cover, word, 1)
            np.add.at(cover, word + d, -1)
            pair = np.unique(np.stack([doc, np.repeat(w, n)]), axis=1)
            per = block.items_at[pair[1] + 1] - block.items_at[pair[1]]
            docs.append(np.repeat(pair[0], per))
            items.append(block.items[ranges(block.items_at[pair[1]], per)])
    return np.cumsum(cover[:-1]) > 0, np.concatenate(docs), np.concatenate(items)


def longest_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, item_word, n_words, doc_id, doc_word: the longest verbatim
    match of every test suffix over all shards (first document on ties)."""
    path, names = write_blocks(spark, benchmark)

    def run(batches):
        for b in batches:
            key = b.column("doc_id").to_pylist()
            for lo_, _, buf, offs in text_chunks(b.column("text")):
                hashes, at = word_hashes(buf, offs)
                for name in names:
                    block = load_block(path, name)
                    shard, first = shard_of(block, hashes, at)
                    length, place = np.zeros(len(block.start), np.int64), np.zeros(len(block.start), np.int64)
                    for d, live, lo, _ in shard.search(block.sym, block.start, block.longest):
                        length[live], place[live] = d, shard.sa[lo]
                    k = np.flatnonzero(length)
                    doc = np.searchsorted(first, place[k], "right") - 1
                    yield pa.RecordBatch.from_pydict({
                        "item_id": block.item[k], "item_word": block.word[k], "n_words": length[k],
                        "doc_id": pa.array([key[lo_ + d] for d in doc], pa.int64()),
                        "doc_word": place[k] - doc - at[doc]})

    found = map_arrow(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                      "item_id long, item_word long, n_words long, doc_id long, doc_word long")
    best = F.max_by(F.struct("n_words", "doc_id", "doc_word"), F.struct("n_words", -F.col("doc_id")))
    return found.groupBy("item_id", "item_word").agg(best.alias("m")).select("item_id", "item_word", "m.*")


COLUMNS = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` plus dc_<name> for each of COLUMNS."""
    path, names = write_blocks(spark, benchmark)

    def judged(b):
        for lo, hi, buf, offs in text_chunks(b.column("text")):
            hashes, at = word_hashes(buf, offs)
            hit = np.zeros(len(hashes), bool)
            docs_, items_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for name in names:
                block = BLOCKS.get((path, name))
                if block is None:
                    BLOCKS.clear()                       # one block at a time
                    block = BLOCKS[path, name] = load_block(path, name)
                h, d, i = hits(block, hashes, at)
                hit |= h
                docs_.append(d)
                items_.append(i)
            pair = np.unique(np.stack([np.concatenate(docs_), np.concatenate(items_)]), axis=1)
            cut = np.searchsorted(pair[0], np.arange(hi - lo + 1))
            upto = np.concatenate(([0], np.cumsum(hit)))
            text = [",".join(sorted(map(str, pair[1][x:y].tolist()))) if y > x else ""
                    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            n_hit = upto[at[1:]] - upto[at[:-1]]
            yield (np.diff(at), n_hit, np.diff(cut), [hashlib.sha256(t.encode()).hexdigest() for t in text], n_hit > 0)

    def run(batches):
        for b in batches:
            if b.num_rows:
                got = list(zip(*judged(b)))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(n) for n in keep],
                     *[pa.array(np.concatenate(c).astype(t) if t is not str else sum(c, []))
                       for c, t in zip(got, (np.int64, np.int64, np.int64, str, bool))]],
                    names=[*keep, *[f"dc_{n}" for n in COLUMNS]])

    schema = ", ".join([*[f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep],
                        *[f"dc_{n} {t}" for n, t in COLUMNS.items()]])
    return map_arrow(spark, docs, run, schema)


#: The block that this Python worker probes now.
BLOCKS: dict[tuple[str, str], Block] = {}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(spark, docs, read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.withColumnsRenamed({f"dc_{n}": n for n in COLUMNS})


@keeps_columns
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go."""
    found = contamination(spark, docs, read_table(spark, sf_dir, "benchmark"), docs.columns)
    return found.where(~F.col("dc_contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
