"""Language ID by rank-order profiles (operator 6).

A text's letters are lower-cased, runs of anything else become one blank, and
its 1-, 2- and 3-grams of characters are ranked by frequency. A language's
profile is the same ranking over texts of that language. The language whose
profile has the smallest out-of-place distance to the text's ``TOP`` grams wins;
a gram absent from a profile counts ``TOP`` places.

Profiles are learnt from at most ``PER_LANGUAGE`` labelled documents per
language (a documented bound; those with the smallest hash of doc_id) that are
not held out; the grams are counted and ranked in Spark. Every whole text is
scored on the executors. The profiles have TOP rows per language and are
refused beyond MAX_LANGUAGES, so what is broadcast has a fixed bound.

Defined cases: text that is null or has no letter is ``und`` with score 0; so
is every text if nothing can be learnt; ties of frequency go by the gram's
hash, ties of distance to the first language in order; a null lang is not
learnt from; null doc_ids are not held out; repeated rows are scored each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martflow.llm.common import map_arrow, mix64, read_table, text_chunks
from martflow.llm.quality import held_out

TOP = 300
PER_LANGUAGE = 1000
MAX_LANGUAGES = 1000
NONE = "und"


@cache
def _letters() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all else."""
    t = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            t[c] = ord(s.lower()[0])
    return t


def ranked_grams(buf: np.ndarray, offs: np.ndarray, group: np.ndarray | None = None):
    """Grams of texts (or of groups of texts) by descending frequency:
    (group, gram, count, rank), and whether each text has a letter."""
    n_docs = len(offs) - 1
    lead = (buf & 0xC0) != 0x80
    upto = np.concatenate(([0], np.cumsum(lead)))
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    code = _letters()[points]
    doc = np.repeat(np.arange(n_docs), np.diff(upto[offs]))
    has_letter = np.bincount(doc, code > 0, n_docs) > 0
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    keep = (code > 0) | first | np.concatenate(([True], code[:-1] > 0))[:len(code)]
    code, doc = code[keep], doc[keep]
    owner = doc if group is None else group[doc]
    shift = np.uint64(21)
    grams = [(code, owner, code > 0)]
    if len(code) > 1:
        two = code[:-1] << shift | code[1:]
        grams.append((two, owner[:-1], doc[:-1] == doc[1:]))
        if len(code) > 2:
            grams.append((two[:-1] << shift | code[2:], owner[:-2], (doc[:-2] == doc[2:]) & (code[1:-1] > 0)))
    half = np.uint64(32)
    key = np.sort(np.concatenate([(mix64(g[ok] + np.uint64(n)) >> half) | (o[ok].astype(np.uint64) << half)
                                  for n, (g, o, ok) in enumerate(grams)]))
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, none, none, none, has_letter
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    who = (key >> half).astype(np.int64)
    order = np.lexsort((-count, who))                          # stable: ties stay in the order of grams
    who, count, gram = who[order], count[order], (key[order] & np.uint64((1 << 32) - 1)).astype(np.int64)
    begin = np.searchsorted(who, np.arange(who[-1] + 1))
    return who, gram, count, np.arange(len(who)) - begin[who], has_letter


def learn(spark: SparkSession, docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all profile grams in order, and their rank by language."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(2, 4))
    order = Window.partitionBy("l").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (usable.select("doc_id", F.col("lang").alias("l")).distinct().withColumn("k", F.row_number().over(order))
              .where(F.col("k") <= PER_LANGUAGE).select(F.col("doc_id").alias("d"), "l"))
    langs = sorted(r[0] for r in picked.select("l").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return [], np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    index = {x: k for k, x in enumerate(langs)}

    def count(batches):
        for b in batches:
            group = np.array([index[x] for x in b.column("lang").to_pylist()], np.int64)
            for lo, hi, buf, offs in text_chunks(b.column("text")):
                who, gram, n, _, _ = ranked_grams(buf, offs, group[lo:hi])
                yield pa.RecordBatch.from_pydict({"lang": who, "gram": gram, "n": n})

    # At most PER_LANGUAGE * MAX_LANGUAGES rows of a number and a name are broadcast.
    texts = usable.select("doc_id", "lang", "text").join(
        F.broadcast(picked), (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l"))).select("lang", "text")
    counted = map_arrow(spark, texts, count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counted.withColumn("rank", rank).where(F.col("rank") <= TOP).select("lang", "gram", "rank").toPandas()
    grams = np.unique(rows["gram"].to_numpy(np.int64))
    table = np.full((len(grams) + 1, len(langs)), -1, np.int64)
    table[np.searchsorted(grams, rows["gram"].to_numpy()), rows["lang"].to_numpy()] = rows["rank"].to_numpy() - 1
    return langs, grams, table


def predict(spark: SparkSession, docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` plus li_lang and li_score. The score is
    1 less the distance over the largest distance possible."""
    shared = spark.sparkContext.broadcast(model)      # at most TOP * MAX_LANGUAGES ranks by language

    def one(buf, offs):
        langs, grams, table = shared.value
        n_docs = len(offs) - 1
        who, gram, _, rank, has_letter = ranked_grams(buf, offs)
        if not langs:
            return [NONE] * n_docs, np.zeros(n_docs)
        top = rank < TOP
        who, gram, rank = who[top], gram[top], rank[top]
        at = np.searchsorted(grams, gram)
        at[at == len(grams)] = len(grams)
        at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] != gram)] = len(grams)
        far = table[at]
        far = np.where(far < 0, TOP, np.abs(far - rank[:, None]))
        total = np.stack([np.bincount(who, far[:, k], n_docs) for k in range(len(langs))], axis=1)
        best = total.argmin(axis=1)
        score = 1 - total[np.arange(n_docs), best] / np.maximum(np.bincount(who, minlength=n_docs) * TOP, 1)
        return ([langs[k] if ok else NONE for k, ok in zip(best.tolist(), has_letter.tolist())],
                np.where(has_letter, np.clip(score, 0, 1), 0.0))

    def run(batches):
        for b in batches:
            got = [one(buf, offs) for _, _, buf, offs in text_chunks(b.column("text"))]
            if got:
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(n) for n in keep], pa.array(sum((x for x, _ in got), []), pa.string()),
                     pa.array(np.concatenate([s for _, s in got]))], names=[*keep, "li_lang", "li_score"])

    schema = ", ".join([*[f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep],
                        "li_lang string", "li_score double"])
    return map_arrow(spark, docs, run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(spark, docs.select("doc_id", "text"), learn(spark, docs), ["doc_id"])
    return found.select("doc_id", held_out(2, 4).alias("held_out"), F.col("li_lang").alias("lang_pred"),
                        F.col("li_score").alias("score"))
