"""Suffix-array dedup by column-wise construction (operator 7).

Removes every byte covered by a ``LENGTH``-byte string that also starts
anywhere else. Three Spark jobs:

1. Every window of LENGTH bytes has an anchor, the least hash of its
   ``ANCHOR``-byte strings, so equal windows have equal anchors wherever they are.
   Neighbouring windows with one anchor form a fragment. Fragments (anchor, digest, place;
   no bytes) are dealt out by anchor, of copies inside one chunk of texts only two. Anchors that occur once need nothing more; copies of
   one fragment are duplicates as a whole and go on as one with that count.
2. Fragments of anchors that have several different ones are cut from the
   texts and gathered by anchor into collections. Each collection's
   Burrows-Wheeler transform and its common prefixes are built column by
   column: round j inserts the symbol before the suffix of j symbols of every
   string, found by last-to-first mapping, and the common prefixes at the
   new places from range minima of the old. Both sequences are read from and
   written to a sequential file each round (on disk once it is large), which leaves with the collection.
   A symbol is ``SYMBOL`` bytes; a fragment gives one string for each
   alignment of its windows to the anchor, which equal windows share. A
   fragment has fewer than 2 * LENGTH bytes, which bounds the rounds whatever the
   texts' lengths. Windows whose common prefix with a neighbour is LENGTH bytes are duplicates.
   An anchor with more than PART_BYTES of different fragments is split first: windows whose distance
   to the anchor lies in one half of the range share the bytes around the anchor that all of these
   windows hold, so equal windows stay together when they are dealt by a digest of those bytes; halves are halved again
   until a part fits, is alone, or holds windows of one distance, which are then equal as a whole.
3. The duplicate windows of each text are joined to it and cut out.

Texts are known by a 64-bit hash of doc_id and text, fragments by 64-bit
digests besides their anchor.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing;
repeated rows are separate documents, hence duplicates of each other; null doc_ids are
allowed; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.common import ByteHash, map_arrow, mix64, ranges, read_table, stage, text_chunks

LENGTH = 200
ANCHOR = 50
WINDOWS = LENGTH - ANCHOR + 1       # anchors to choose from, and most windows in a fragment
SYMBOL = 8                          # bytes; divides LENGTH
COLLECTION_BYTES = 60_000           # whole anchors up to this; few enough for 16-bit symbols
PART_BYTES = 4 << 20                # most bytes gathered in one collection
CHUNK = 1 << 20
SPOOL_BYTES = 64 << 20


# ------------------------------------------------------------------ fragments
def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def fragments(buf: np.ndarray, offs: np.ndarray):
    """(text, start in the text, windows, anchor, digest) of each fragment."""
    first, count = offs[:-1], np.maximum(np.diff(offs) - LENGTH + 1, 0)
    if not count.any():
        return [np.zeros(0, np.int64)] * 5
    h = ByteHash(buf)
    at = np.arange(len(buf) - ANCHOR + 1)
    grams = h.spans(at, at + ANCHOR)
    least = sliding_minimum(grams, WINDOWS)
    place = ranges(first, count)
    doc = np.repeat(np.arange(len(count)), count)
    m = least[place]
    # A new fragment also begins where the window before began with the anchor:
    # all windows of a fragment share one place of the anchor, so they differ
    # from each other even in periodic texts.
    changes = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | (grams[place[:-1]] == m[:-1])
    start = np.flatnonzero(np.concatenate(([True], changes)))
    size = np.diff(np.append(start, len(m)))
    s = place[start]
    digest = mix64(h.spans(s, s + size + LENGTH - 1) ^ np.uint64(LENGTH)) + size.astype(np.uint64)
    return [doc[start], s - first[doc[start]], size, m[start].view(np.int64), digest.view(np.int64)]


_ROW = "a long, f long, w long, key long, start long"
_COLUMNS = ["a", "f", "w", "key", "start"]


def _batch(rows: np.ndarray, **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(v) for v in more.values()], *[pa.array(r) for r in rows]],
                                      names=[*more, *_COLUMNS])


def _local(rows: np.ndarray):
    """Sorted rows of one chunk: those with copies here (kind 0), and up to two
    of each fragment to be dealt out (kind 2)."""
    new = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))) \
        if rows.shape[1] else np.zeros(0, np.int64)
    size = np.diff(np.append(new, rows.shape[1]))
    some = ranges(new, np.minimum(size, 2))
    copies = np.flatnonzero(np.repeat(size > 1, size))
    for kind, at in ((0, copies), (2, some)):
        yield _batch(rows[:, at], kind=np.full(len(at), kind))


def _classify(batches):
    """Rows sorted by anchor, digest and size -> ``whole`` rows (fragments with
    copies) and one row per distinct fragment of anchors that have several.
    Keeps one row between batches, so a hot anchor is only a long stream."""
    tail = held = None               # the last row while alone; the anchor's first fragment while the only one
    last, runs = None, 0             # last fragment, and fragments of its anchor so far
    for b in batches:
        r = np.stack([b.column(c).to_numpy() for c in _COLUMNS])
        if tail is not None:
            r = np.concatenate((tail, r), axis=1)
        yield from (out := _step(r, tail is None and last, last, runs, held, False))[0]
        tail, held, last, runs = out[1]
    if tail is not None:
        yield from _step(tail, False, last, runs, held, True)[0]


def _step(r, same_run, last, runs, held, end):
    """One batch of _classify: its output and the next state. ``last`` is the
    last row dealt with (not the tail), ``runs`` the fragments of its anchor."""
    n = r.shape[1]
    if not n:
        return [], (None, held, last, runs)
    new_a = np.concatenate(([True], r[0, 1:] != r[0, :-1]))
    new_f = np.concatenate(([True], (r[:3, 1:] != r[:3, :-1]).any(axis=0)))
    begin = np.flatnonzero(new_f)
    size = np.diff(np.append(begin, n))
    goes_on = bool(same_run is not False and last is not None and (r[:3, 0] == last[:3, 0]).all())
    tail = None
    if not end and size[-1] == 1 and not (goes_on and len(begin) == 1):
        tail = r[:, -1:]
        r, begin, size, new_a, n = r[:, :-1], begin[:-1], size[:-1], new_a[:-1], n - 1
        if not n:
            return [], (tail, held, last, runs)
    same_anchor = last is not None and r[0, 0] == last[0, 0]
    whole = size > 1
    whole[0] |= goes_on
    starts_anchor = new_a[begin]
    starts_anchor[0] = not same_anchor
    group = np.cumsum(starts_anchor)                       # 0 is the anchor going on
    order = np.arange(len(begin))
    base = np.zeros(group[-1] + 1, np.int64)
    heads = np.flatnonzero(starts_anchor)
    base[group[heads]] = order[heads]
    ordinal = order - base[group] + 1
    if same_anchor:
        ordinal[group == 0] += runs - goes_on
    most = np.zeros(group[-1] + 1, np.int64)
    np.maximum.at(most, group, ordinal)
    is_new = np.ones(len(begin), bool)
    is_new[0] = not goes_on
    rep = is_new & (most[group] > 1)
    out = [_batch(r[:, np.repeat(whole, size)], kind=np.zeros(int(size[whole].sum()), np.int64)),
           _batch(r[:, begin[rep]], kind=np.ones(int(rep.sum()), np.int64))]
    if same_anchor and held is not None and most[0] > 1:
        out.append(_batch(held, kind=np.ones(1, np.int64)))
        held = None
    if not (same_anchor and group[-1] == 0):
        held = None
        g = np.flatnonzero(group == group[-1])
        if ordinal[g[-1]] == 1:
            held = r[:, begin[g[0]]:begin[g[0]] + 1]
    return out, (tail, held, r[:, -1:], int(ordinal[-1]))


# ------------------------------------------------------------------ collections
class SequentialFile:
    """A temporary file of numbers that is only read and written from its
    beginning to its end. It reaches the disk beyond SPOOL_BYTES."""

    def __enter__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        return self

    def __exit__(self, *_):
        self.file.close()

    def write(self, values: np.ndarray) -> None:
        self.kind = values.dtype
        self.file.seek(0)
        self.file.write(values.tobytes())

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.kind)


class Collection:
    """BWT and common prefixes (up to ``limit``) of a collection of strings of
    symbols 1.., built column by column through sequential files."""

    def __init__(self, symbols: np.ndarray, offs: np.ndarray, limit: int):
        self.limit, self.m = limit, len(offs) - 1
        self.size = np.diff(offs)
        with SequentialFile() as bwt_file, SequentialFile() as lcp_file:
            self._build(symbols, offs, bwt_file, lcp_file)

    def _build(self, symbols, offs, bwt_file: SequentialFile, lcp_file: SequentialFile) -> None:
        m, size = self.m, self.size

        def symbol(i, j):
            """Symbol before the j-suffix of strings i; 0 at their beginning."""
            got = symbols[np.maximum(offs[i + 1] - 1 - j, 0)]
            got[size[i] <= j] = 0
            return got

        live = np.arange(m)
        bwt_file.write(symbol(live, 0))
        lcp_file.write(np.zeros(m, np.uint8))
        place = live.copy()
        for j in range(1, int(size.max(initial=0)) + 1):
            bwt, lcp = bwt_file.read(), lcp_file.read()
            keep = size[live] >= j
            live, place = live[keep], place[keep]
            order, rank = self._mapping(bwt)
            k = rank[place]                                       # among the symbols before a suffix
            # Common prefixes that change: of the new suffix and of its successor.
            fresh = np.zeros(m + len(order) + 1, bool)
            fresh[m + k] = True
            at = np.flatnonzero(fresh[m:-1] | fresh[m - 1:-2])
            prev = order[np.maximum(at - 1, 0)]
            same = (at > 0) & (bwt[prev] == bwt[order[at]])
            lo, hi = prev[same] + 1, order[at][same] + 1
            by = np.argsort(lo)
            cut = np.stack([lo[by], hi[by]], axis=1).ravel()
            least = np.zeros(len(at), np.uint8)
            if len(cut):
                got = np.minimum.reduceat(np.append(lcp, np.uint8(255)), cut)[::2]
                inner = np.zeros(len(by), np.uint8)
                inner[by] = np.minimum(got, self.limit - 1) + 1
                least[same] = inner
            fresh = fresh[:-1]
            bwt2, lcp2 = np.empty(len(fresh), bwt.dtype), np.empty(len(fresh), np.uint8)
            bwt2[~fresh], lcp2[~fresh] = bwt, lcp
            bwt2[m + k] = symbol(live, j)
            lcp2[m + at] = least
            place = m + k
            bwt_file.write(bwt2)
            lcp_file.write(lcp2)
        self.bwt, self.lcp = bwt_file.read(), lcp_file.read()

    @staticmethod
    def _mapping(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a symbol in the order of the suffixes that the symbols
        begin, and each row's place there."""
        order = np.argsort(bwt, kind="stable")
        order = order[int((bwt == 0).sum()):]
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(order))
        return order, rank

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(string, start) of every ``limit`` symbols that start elsewhere too,
        by walking all strings backwards at once."""
        hit = self.lcp >= self.limit
        hit |= np.append(hit[1:], False)
        order, rank = self._mapping(self.bwt)
        live, row = np.arange(self.m), np.arange(self.m)
        strings, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        j = 0
        while len(live):
            if j >= self.limit:
                ok = hit[row]
                strings.append(live[ok])
                starts.append(self.size[live[ok]] - j)
            go = self.bwt[row] > 0
            live, row = live[go], self.m + rank[row[go]]
            j += 1
        return np.concatenate(strings), np.concatenate(starts)


def repeated_windows(raw: np.ndarray, offs: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, start) of the windows that occur in another fragment, sorted."""
    n = len(offs) - 1
    owner = np.repeat(np.arange(n), np.diff(offs))
    at = np.arange(max(len(raw) - ANCHOR + 1, 0))
    hit = np.flatnonzero(ByteHash(raw).spans(at, at + ANCHOR).view(np.int64) == anchor[owner[at]])
    place = hit[np.searchsorted(hit, offs[:-1])] - offs[:-1]      # of the anchor; all windows of a fragment share it
    # One string for each fragment and alignment, of whole symbols.
    frag = np.repeat(np.arange(n), SYMBOL)
    first = (np.repeat(place, SYMBOL) - np.tile(np.arange(SYMBOL), n)) % SYMBOL
    count = (np.diff(offs)[frag] - first) // SYMBOL
    keep = count >= LENGTH // SYMBOL
    frag, first, count = frag[keep], first[keep], count[keep]
    begin = np.repeat(offs[frag] + first, count) + SYMBOL * ranges(np.zeros(len(count), np.int64), count)
    value = raw[begin[:, None] + np.arange(SYMBOL)].view(np.uint64).ravel()
    known, code = np.unique(value, return_inverse=True)
    code = (code + 1).astype(np.uint16 if len(known) < 65535 else np.uint32)
    string, start = Collection(code, np.concatenate(([0], np.cumsum(count))), LENGTH // SYMBOL).repeated()
    frag, start = frag[string], first[string] + SYMBOL * start
    order = np.lexsort((start, frag))
    return frag[order], start[order]


def _collections(batches):
    """Fragments sorted by part -> duplicate windows (key, start, w)."""

    def solve(t: pa.Table):
        raw = t.column("bytes").combine_chunks().cast(pa.large_binary())
        offs = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[offs[0]:offs[-1]]
        offs = offs - offs[0]
        g, a, key, begin = (t.column(x).to_numpy() for x in ("g", "a", "key", "start"))
        heads = np.append(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), len(g))
        lo = 0
        while lo < len(heads) - 1:                 # whole parts, as many as fit
            hi = max(lo + 1, int(np.searchsorted(offs[heads], offs[heads[lo]] + COLLECTION_BYTES, "right")) - 1)
            x, y = heads[lo], heads[hi]
            frag, start = repeated_windows(data[offs[x]:offs[y]], offs[x:y + 1] - offs[x], a[x:y])
            lo = hi
            if len(frag):
                new = np.flatnonzero(np.concatenate(([True], (frag[1:] != frag[:-1]) | (start[1:] != start[:-1] + 1))))
                yield pa.RecordBatch.from_pydict({"key": key[x + frag[new]], "start": begin[x + frag[new]] + start[new],
                                                  "w": np.diff(np.append(new, len(frag)))})

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        g = t.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1])) if len(g) else 0                  # the last part may go on
        if cut:
            yield from solve(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield from solve(held)


# ------------------------------------------------------------------ jobs
def _cut(batches):
    for b in batches:
        for lo, hi, buf, offs in text_chunks(b.column("text"), CHUNK):
            asked = b.column("asked").slice(lo, hi - lo)
            n = pa.compute.list_value_length(asked).to_numpy()
            flat = asked.flatten()
            g, a, s, w = (flat.field(x).to_numpy() for x in ("g", "a", "start", "w"))
            owner = np.repeat(np.arange(hi - lo), n)
            begin, size = offs[owner] + s, w + LENGTH - 1
            raw = buf[ranges(begin, size)]
            cuts = np.concatenate(([0], np.cumsum(size)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(a), b.column("key").slice(lo, hi - lo).take(pa.array(owner)), pa.array(s),
                 pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()),
                                                                  pa.py_buffer(raw.tobytes())]).cast(pa.binary())],
                names=["g", "a", "key", "start", "bytes"])


_PART = "g long, a long, lo long, hi long, key long, start long, w long"


def _halve(batches):
    """Fragments of parts (distances lo .. hi - 1 to the anchor) -> fragments of the parts' halves."""
    for b in batches:
        for lo, hi, buf, offs in text_chunks(b.column("text"), CHUNK):
            asked = b.column("asked").slice(lo, hi - lo)
            n = pa.compute.list_value_length(asked).to_numpy()
            flat = asked.flatten()
            g, a, near, far, start, w = (flat.field(x).to_numpy() for x in ("g", "a", "lo", "hi", "start", "w"))
            owner = np.repeat(np.arange(hi - lo), n)
            key = b.column("key").slice(lo, hi - lo).to_numpy()[owner]
            h = ByteHash(buf)
            # The anchor's place: its first occurrence from the fragment's first window on.
            tried = np.minimum(w + WINDOWS - 1, offs[owner + 1] - offs[owner] - start - ANCHOR + 1)
            at = np.repeat(offs[owner] + start, tried) + ranges(np.zeros(len(tried), np.int64), tried)
            hit = np.flatnonzero(h.spans(at, at + ANCHOR).view(np.int64) == np.repeat(a, tried))
            place = at[hit[np.searchsorted(hit, np.cumsum(tried) - tried)]] - offs[owner]
            middle = (near + far) // 2
            for x, y in ((near, middle), (middle, far)):
                first = np.maximum(start, place - y + 1)              # windows begin at place - distance
                end = np.minimum(start + w, place - x + 1)
                some = np.flatnonzero(end > first)
                o = offs[owner[some]]
                core = h.spans(o + (place - x)[some], o + (place - y)[some] + 1 + LENGTH)
                part = mix64(mix64(core ^ g[some].view(np.uint64)) + x[some].astype(np.uint64))
                yield pa.RecordBatch.from_pydict({
                    "g": part.view(np.int64), "a": a[some], "lo": x[some], "hi": y[some], "key": key[some],
                    "start": first[some], "w": (end - first)[some]})


def _parted(spark: SparkSession, docs: DataFrame, parts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Parts that fit PART_BYTES, and (key, start, w) of windows of one distance that are equal as a whole.
    A round halves the distances of the parts that do not fit; there are 8 at most."""
    def sizes(parts):
        return parts.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") + LENGTH - 1).alias("bytes"),
                                      F.max(F.col("hi") - F.col("lo")).alias("span"))

    columns, large = ["g", "a", "key", "start", "w"], F.col("bytes") > PART_BYTES
    big = stage(spark, sizes(parts).where(large), "substring-parts")             # a row per PART_BYTES of input at most
    fit, equal = [parts.join(big, "g", "left_anti").select(columns)], []
    parts = parts.join(big, "g")
    while not (wide := parts.where(large & (F.col("span") > 1))).isEmpty():
        asked = (wide.groupBy("key")
                 .agg(F.collect_list(F.struct("g", "a", "lo", "hi", "start", "w")).alias("asked")))   # bounded by the text's length
        halves = stage(spark, map_arrow(spark, docs.select("key", "text").join(asked, "key"), _halve, _PART), "substring-halves")
        parts = halves.join(stage(spark, sizes(halves).where("n > 1"), "substring-parts"), "g")
        fit.append(parts.where(~large).select(columns))
        equal.append(parts.where(large & (F.col("span") == 1)).select("key", "start", "w"))
    return reduce(DataFrame.union, fit), equal


def duplicate_windows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(key, start, w): runs of w window starts whose LENGTH bytes start
    elsewhere too. ``docs`` has key and text."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text"), CHUNK):
                doc, start, w, a, f = fragments(buf, offs)
                rows = np.stack([a, f, w, b.column("key").slice(lo, hi - lo).to_numpy()[doc], start])
                yield from _local(rows[:, np.lexsort(rows[2::-1])])

    # kind 0: copies met already in one chunk. kind 2: to be dealt out, two at most of each.
    places = stage(spark, map_arrow(spark, docs.select("key", "text"), run, f"kind long, {_ROW}"), "substring-places")
    dealt = places.where("kind = 2").drop("kind").repartition("a").sortWithinPartitions("a", "f", "w")
    met = stage(spark, map_arrow(spark, dealt, _classify, f"kind long, {_ROW}", 20_000), "substring-fragments")
    met = met.union(places.where("kind = 0"))
    several = met.where("kind = 1").select(F.col("a").alias("g"), "a", F.lit(0).cast("long").alias("lo"),
                                           F.lit(WINDOWS).cast("long").alias("hi"), "key", "start", "w")
    fit, equal = _parted(spark, docs, several)
    asked = (fit.groupBy("key")
             .agg(F.collect_list(F.struct("g", "a", "start", "w")).alias("asked")))     # bounded by the text's length
    cut = map_arrow(spark, docs.select("key", "text").join(asked, "key"), _cut,
                    "g long, a long, key long, start long, bytes binary")
    some = map_arrow(spark, cut.repartition("g").sortWithinPartitions("g"), _collections, "key long, start long, w long")
    return reduce(DataFrame.union, equal, met.where("kind = 0").select("key", "start", "w")
                  .union(stage(spark, some, "substring-windows")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def removed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = (duplicate_windows(spark, docs).groupBy("key")
             .agg(F.collect_list(F.struct("start", "w")).alias("spans")))           # bounded by the text's length

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in text_chunks(b.column("text"), CHUNK):
                spans_ = b.column("spans").slice(lo, hi - lo)
                n = np.nan_to_num(pa.compute.list_value_length(spans_).to_numpy(zero_copy_only=False)).astype(np.int64)
                flat = spans_.flatten()
                begin = np.repeat(offs[:-1], n) + flat.field("start").to_numpy()
                change = np.zeros(len(buf) + 1, np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + flat.field("w").to_numpy() + LENGTH - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                upto = np.concatenate(([0], np.cumsum(gone)))
                edge = np.zeros(len(buf) + 1, bool)
                edge[offs] = True
                heads = np.concatenate(([0], np.cumsum(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))))))
                raw = buf[~gone].tobytes()
                kept = offs - upto[offs]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(np.diff(upto[offs])),
                     pa.array(np.diff(heads[offs])),
                     pa.array([raw[x:y] for x, y in zip(kept[:-1].tolist(), kept[1:].tolist())], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(spark, docs.join(spans, "key", "left").select("doc_id", "text", "spans"), run,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed(spark, read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
