"""Token-ID output: a binary file of independent zstandard frames (operator 2).

File layout (little endian), one file per range of doc_id:

* data frames: each an independent zstandard frame of unsigned 32-bit ids of
  consecutive whole documents, closed once it holds ``FRAME_IDS`` ids;
* one index frame: int64 arrays doc_id (``NULL_ID`` for null), frame number
  and count of ids per document, in file order;
* the seek table, in a skippable frame at the end: for every frame its
  compressed size, content size and checksum (low 32 bits of xxh64 of the
  content), then the number of frames, a descriptor byte and a magic number.

A reader fetches the end of the file, then the index frame, then only the
frames of the documents asked for, and verifies their checksums.

Documents are dealt out by ranges of doc_id and sorted inside each range (ties
by text), so files in order of their range hold ascending ids. A task writes
under a name of its own attempt; the manifest lists the file of the attempt
that Spark committed, so lost executors and repeated tasks leave at most an
unlisted file. Files go through ``pyarrow.fs`` to the shared folder.

Ids come from the tokenizers library. Texts are split at single spaces and
newlines between solid signs and between a letter and a sign, where the
vocabulary's own pre-tokenizer always splits, and each distinct piece is encoded once while a bounded cache
remembers it; the concatenation equals encoding the whole text (tested). No text is
split inside an added token of the vocabulary, such as ``<|endoftext|>``, which the library finds first.

Defined cases: null text is empty (one end id); null doc_id comes first;
repeated rows are separate documents; an empty table gives no files and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martflow.llm.common import ByteHash, map_arrow, ranges, read_table, scratch, stage, text_chunks

END_ID = 2
FRAME_IDS = 1 << 17
NULL_ID = -(1 << 63)
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1        # public magic numbers of the seekable format
VOCABULARY = "byte_bpe_50k.json"
CACHE_PIECES = 1_000_000


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


# ------------------------------------------------------------------ encoding
def _byte_letters() -> np.ndarray:
    """Code points by which the byte-level vocabulary writes each byte: the
    printable ones stand for themselves, the rest follow from 256 on."""
    shown = np.zeros(256, bool)
    for x, y in ((33, 126), (161, 172), (174, 255)):
        shown[x:y + 1] = True
    return np.where(shown, np.arange(256), 256 + np.cumsum(~shown) - 1).astype("<u4")


_BYTE_LETTERS = _byte_letters()
_ASCII = np.arange(256)
_ASCII_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122) & (_ASCII < 128)
_ASCII_SIGN = (_ASCII > 32) & (_ASCII < 127) & ~_ASCII_LETTER & ~((_ASCII >= 48) & (_ASCII <= 57))


class PieceEncoder:
    """Encodes chunks of whole texts; equal pieces are encoded once.

    A piece of letters, with or without a space before, is one unit of the
    pre-tokenizer, so it goes straight to the library's model; any other piece
    goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that depend on the signs beside them are not supported")
        self.added = [t.content.encode() for t in added]
        self._forget()

    def _forget(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, buf: np.ndarray, letter: np.ndarray, s: np.ndarray, e: np.ndarray, key: np.ndarray) -> None:
        """Add pieces not known yet."""
        lead = (buf[s] == 32) & (e - s > 1)
        count = np.concatenate(([0], np.cumsum(letter)))
        plain = count[e] - count[s] == e - s - lead
        got: list[list[int]] = [[]] * len(s)
        size = (e - s)[plain]
        raw = _BYTE_LETTERS[buf[ranges(s[plain], size)]].tobytes().decode("utf-32-le")
        ends = np.cumsum(size).tolist()
        for k, x, y in zip(np.flatnonzero(plain).tolist(), [0, *ends], ends):
            got[k] = [t.id for t in self.model.tokenize(raw[x:y])]
        other = np.flatnonzero(~plain).tolist()
        texts = [buf[s[k]:e[k]].tobytes().decode() for k in other]
        for k, g in zip(other, self.tok.encode_batch(texts, add_special_tokens=False)):
            got[k] = g.ids
        size = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))))
        key, at, size = (np.concatenate(x) for x in ((self.key, key), (self.at, at), (self.size, size)))
        order = np.argsort(key)
        self.key, self.at, self.size = key[order], at[order], size[order]

    def _added_spans(self, buf: np.ndarray) -> list[tuple[int, int]]:
        """Start and end of each place that spells an added token."""
        raw, out = buf.tobytes(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out.append((at, at + len(token)))
                at = raw.find(token, at + 1)
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (END_ID after each) and their counts per text."""
        prev = np.concatenate(([0], buf[:-1])) if len(buf) else buf
        # Letters: those of ASCII, and two-byte ones that begin with 0xC3 (all but two signs).
        two = (prev == 0xC3) & (buf != 0x97) & (buf != 0xB7)
        letter = _ASCII_LETTER[buf] | two
        letter[:-1] |= two[1:]
        solid = letter | _ASCII_SIGN[buf] | ((buf >= 48) & (buf <= 57))
        gap = np.zeros(len(buf), bool)
        gap[1:-1] = solid[:-2] & solid[2:] & ((buf[1:-1] == 32) | (buf[1:-1] == 10))
        cut = np.zeros(len(buf) + 1, bool)
        cut[:-1] |= gap                                        # before a space or newline,
        cut[1:] |= gap & (buf == 10)                           # after a newline,
        cut[1:-1] |= letter[:-1] & _ASCII_SIGN[buf[1:]]        # between a letter and a sign
        for x, y in self._added_spans(buf):
            cut[x + 1:y] = False
            letter[x:y] = False                                # not for the model alone
        cut[offs] = True
        cut[len(buf)] = False
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(buf)) if len(s) else s
        h = ByteHash(buf).spans(s, e)
        uniq, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(uniq):
            if len(self.key) + len(uniq) > CACHE_PIECES:      # bounds memory; the ids do not depend on it
                self._forget()
            at = np.minimum(np.searchsorted(self.key, uniq), max(len(self.key) - 1, 0))
            new = self.key[at] != uniq if len(self.key) else np.ones(len(uniq), bool)
            if new.any():
                self._learn(buf, letter, s[first[new]], e[first[new]], uniq[new])
        at = np.searchsorted(self.key, uniq)
        size = self.size[at][which] if len(uniq) else np.zeros(0, np.int64)
        ids = self.pool[ranges(self.at[at][which], size)] if len(uniq) else self.pool[:0]
        ends = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(s, offs)]
        counts = np.diff(ends) + 1
        return np.insert(ids, ends[1:], END_ID), counts


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker; its cache serves task after task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


# --------------------------------------------------------------- file format
def write_file(out, docs: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """Write blocks of (doc_ids, counts, ids) to a binary stream; returns the
    numbers of documents and ids."""
    packer = zstandard.ZstdCompressor(level=1)
    table: list[tuple[int, int, int]] = []
    index: list[np.ndarray] = []
    total = 0

    def frame(raw: bytes) -> None:
        packed = packer.compress(raw)
        table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        out.write(packed)

    held: list[np.ndarray] = []
    size = 0
    for doc_ids, counts, ids in docs:
        at = np.concatenate(([0], np.cumsum(counts)))
        lo = 0
        while lo < len(counts):
            hi = min(len(counts), max(lo + 1, int(np.searchsorted(at, at[lo] + FRAME_IDS - size, "left"))))
            held.append(ids[at[lo]:at[hi]])
            size += int(at[hi] - at[lo])
            index.append(np.stack([doc_ids[lo:hi], np.full(hi - lo, len(table)), counts[lo:hi]]).astype(np.int64))
            if size >= FRAME_IDS:
                frame(np.concatenate(held).astype("<u4").tobytes())
                held, total, size = [], total + size, 0
            lo = hi
    if held:
        frame(np.concatenate(held).astype("<u4").tobytes())
        total += size
    rows = np.concatenate(index, axis=1) if index else np.zeros((3, 0), np.int64)
    frame(rows.astype("<i8").tobytes())
    seek = b"".join(struct.pack("<III", *t) for t in table) + struct.pack("<IBI", len(table), 0x80, SEEKABLE)
    out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
    return rows.shape[1], total


class TokenFile:
    """Random access to one token file."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        end = stream.tell()
        stream.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        stream.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(stream.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.doc_id, self.frame_of, self.count = np.frombuffer(self.frame(n - 1), "<i8").reshape(3, -1)
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        self.stream.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.stream.read(int(self.table[k, 0])),
                                                      max_output_size=max(1, int(self.table[k, 1])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"checksum of frame {k} does not match")
        self.frames_read = getattr(self, "frames_read", 0) + 1
        return raw

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the asked rows (all without argument), decompressing
        only their frames."""
        rows = np.arange(len(self.doc_id)) if rows is None else np.sort(rows)
        for k in np.unique(self.frame_of[rows]):
            inside = np.flatnonzero(self.frame_of == k)
            ids = np.frombuffer(self.frame(int(k)), "<u4")
            at = np.concatenate(([0], np.cumsum(self.count[inside]))) - 0
            for r in rows[self.frame_of[rows] == k]:
                j = int(r - inside[0])
                yield int(r), ids[at[j]:at[j + 1]]


def _fs(path: str):
    fs, p = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, p


# --------------------------------------------------------------- Spark jobs
def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files under ``path``. Returns
    the manifest: part, file, n_docs, n_ids and the ids of all parts before."""
    vocab = tokenizer or vocabulary_path()

    def run(batches):
        part = TaskContext.get().partitionId()
        fs, p = _fs(path)
        name = f"{p}/part-{part:06d}-{TaskContext.get().taskAttemptId()}.ids.zst"

        def blocks(first):
            for b in chain([first], batches):
                keys = b.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                for lo, hi, buf, offs in text_chunks(b.column("text")):
                    ids, counts = encoder(vocab).encode(buf, offs)
                    yield keys[lo:hi], counts, ids

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs.create_dir(p, recursive=True)
        with fs.open_output_stream(name, compression=None) as out:
            n_docs, n_ids = write_file(out, blocks(first))
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [os.path.basename(name)],
                                          "n_docs": [n_docs], "n_ids": [n_ids]})

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    manifest = stage(spark, map_arrow(spark, ordered, run, "part long, file string, n_docs long, n_ids long"),
                     "tokens-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row per file
    return manifest.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_index(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        for b in batches:
            for name, before in zip(b.column("file").to_pylist(), b.column("ids_before").to_pylist()):
                fs, p = _fs(path)
                with fs.open_input_file(f"{p}/{name}") as f:
                    t = TokenFile(f)
                    crc = np.fromiter((zlib.crc32(ids) for _, ids in t.documents()), np.int64, len(t.doc_id))
                start = before + np.cumsum(t.count) - t.count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.doc_id, mask=t.doc_id == NULL_ID), pa.array(start), pa.array(t.count), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "ids_before").repartition(spark.sparkContext.defaultParallelism * 4, "file")
    return map_arrow(spark, files, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, manifest: DataFrame, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents, decompressing only their frames."""

    def run(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                fs, p = _fs(path)
                with fs.open_input_file(f"{p}/{name}") as f:
                    t = TokenFile(f)
                    got = [(int(t.doc_id[r]), ids.astype(np.int64)) for r, ids in
                           t.documents(np.flatnonzero(np.isin(t.doc_id, wanted)))]
                if got:
                    yield pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in got], "ids": [i for _, i in got]})

    return map_arrow(spark, manifest.select("file"), run, "doc_id long, ids array<long>")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token files of the documents, and their index as read back."""
    path = scratch(spark, "tokens")
    return read_index(spark, write_tokens(spark, docs, path), path)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""
    return tokens_stage(spark, read_table(spark, sf_dir, "documents"), sf_dir)
