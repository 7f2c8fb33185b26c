"""License scans: fuzzy search for short notices (operator 9).

Texts are normalised to lower-cased words with one space between. A notice of
length n may be changed by k = n // EDIT_EVERY edits. Split into k + 1
pieces, at least one piece of any such variant is unchanged (pigeonhole), so
exact occurrences of the pieces locate every candidate. The regex library
matches the notice with at most k edits inside each candidate's own window, in which two notices
cannot stand side by side, and gives the span and its edits. Of overlapping spans of one notice the
one with the fewest edits counts, then the first. Exact places of a notice are counted at its first piece.

Everything happens in one pass over the texts on the executors, without a
shuffle. Whole texts are searched.

Defined cases: null or empty text has no words, no labels and score 0;
repeated rows are scanned each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from martflow.llm.common import ALNUM, LOWER, map_arrow, ranges, read_table, text_chunks, word_spans

# Base notices and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices that the method adds.
MORE = (("gnu general public license", "gpl"), ("gnu lesser general public license", "lgpl"),
        ("mozilla public license", "mpl"), ("bsd 3 clause license", "bsd"),
        ("creative commons attribution", "cc-by"))
EDIT_EVERY = 10
LINE = regex.compile(rb"[^\n]+")


class Notice:
    def __init__(self, phrase: str, label: str, base: bool):
        self.label, self.base = label, base
        self.text = phrase.encode()
        self.edits = len(phrase) // EDIT_EVERY
        at = np.linspace(0, len(phrase), self.edits + 2).round().astype(int).tolist()
        self.pieces = [(x, self.text[x:y]) for x, y in zip(at[:-1], at[1:])]
        self.pattern = regex.compile(rb"(?b)(?<= )(?:" + regex.escape(phrase).encode()
                                     + rb"){e<=%d}(?= )" % self.edits)


@cache
def notices() -> list[Notice]:
    return [Notice(p, x, True) for p, x in BASE] + [Notice(p, x, False) for p, x in MORE]


def _places(raw: bytes, piece: bytes) -> list[int]:
    out, at = [], raw.find(piece)
    while at >= 0:
        out.append(at)
        at = raw.find(piece, at + 1)
    return out


class Scan:
    """The notices in one chunk of texts. ``found`` has a row per place:
    notice, document, first word, end word, edits."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low = LOWER[buf]
        self.starts, self.ends, self.at = word_spans(low, offs, ALNUM)
        size = self.ends - self.starts
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.at))
        # " w1 w2 ... wn \n" per document
        self.place = np.cumsum(size + 1) - size + 2 * doc
        norm = np.full(int(size.sum()) + len(size) + 2 * (len(offs) - 1), 32, np.uint8)
        norm[ranges(self.place, size)] = low[ranges(self.starts, size)]
        bounds = np.cumsum(np.add.reduceat(np.append(size + 1, 0), self.at[:-1]) * (np.diff(self.at) > 0) + 2)
        norm[bounds - 1] = 10
        self.raw, self.lines = norm.tobytes(), bounds
        self.found = sorted({row for k, n in enumerate(notices()) for row in self._search(k, n)},
                            key=lambda r: (r[1], r[2], r[0], r[4]))

    def _row(self, k: int, a: int, b: int, edits: int) -> tuple[int, int, int, int, int]:
        w = int(np.searchsorted(self.place, a))
        doc = int(np.searchsorted(self.lines, a, "right"))
        end = int(np.searchsorted(self.place, b))
        return k, doc, w - int(self.at[doc]), end - int(self.at[doc]), edits

    def _search(self, k: int, n: Notice):
        raw, size = self.raw, len(n.text)
        exact = {at for at in _places(raw, n.text) if raw[at - 1:at] == b" " == raw[at + size:at + size + 1]}
        yield from (self._row(k, at, at + size, 0) for at in exact)
        if not n.edits:
            return
        aligned = {at - x for x, piece in n.pieces for at in _places(raw, piece)} - exact
        spans = {(0, at, at + size) for at in exact}
        for at in aligned:
            a, b = max(at - n.edits - 1, 0), min(at + size + n.edits + 1, len(raw))
            for line in LINE.finditer(raw, a, b):
                for m in n.pattern.finditer(raw, line.start(), line.end()):
                    spans.add((sum(m.fuzzy_counts), m.start(), m.end()))
        for edits, x, y in apart(spans):
            if edits:
                yield self._row(k, x, y, edits)


def apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (edits, start, end) that overlap no better one."""
    starts, ends, kept = [], [], []
    for span in sorted(spans):
        i = bisect_left(starts, span[2])                 # spans that begin before this one's end
        if i and ends[i - 1] > span[1]:
            continue
        starts.insert(i, span[1])
        ends.insert(i, span[2])
        kept.append(span)
    return kept


def _labels(ks) -> str:
    return ",".join(sorted({notices()[k].label for k in ks}))


def find_notices(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, label, exact, edits, first_word, end_word, first_byte, end_byte
    of every notice found (byte places in the text)."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, _, buf, offs in text_chunks(b.column("text")):
                s = Scan(buf, offs)
                if s.found:
                    k, d, w, e, x = map(np.array, zip(*s.found))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([ids[lo + i] for i in d], pa.int64()),
                        "label": [notices()[i].label for i in k], "exact": x == 0, "edits": x,
                        "first_word": w, "end_word": e, "first_byte": s.starts[s.at[d] + w] - offs[d],
                        "end_byte": s.ends[s.at[d] + e - 1] - offs[d]})

    return map_arrow(spark, docs.selectExpr("cast(doc_id as long) doc_id", "text"), run,
                     "doc_id long, label string, exact boolean, edits long, first_word long, end_word long, "
                     "first_byte long, end_byte long")


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (1 for an exact notice, less by its edits for
    a changed one, 0 for none)."""

    def digest(rows):
        base = [r for r in rows if notices()[r[0]].base and not r[4]]
        words = [r[2] for r in base]
        best = max((1 - r[4] / (notices()[r[0]].edits + 1) for r in rows), default=0.0)
        return (len(base), min(words, default=None), max(words, default=None), _labels(r[0] for r in base),
                _labels(r[0] for r in rows), best)

    def run(batches):
        for b in batches:
            n_words, out = [], []
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                s = Scan(buf, offs)
                n_words.append(np.diff(s.at))
                rows: dict[int, list] = {}
                for r in s.found:
                    rows.setdefault(r[1], []).append(r)
                out += [digest(rows.get(d, ())) for d in range(hi - lo)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.concatenate(n_words)),
                     *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_arrow(spark, docs.selectExpr("cast(doc_id as long) doc_id", "text"), run,
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                     "labels string, score double")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scan(spark, read_table(spark, sf_dir, "documents"))
