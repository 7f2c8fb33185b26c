"""Small table folders for the training-data operators."""

import os
import random
import re

import pytest
from pyspark.sql.types import (ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType)

SMALL = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(LOWER))


def schema(*fields):
    return StructType([StructField(n, t) for n, t in fields])


# Columns beyond those of the tables, with names that operators use themselves.
CLASH = [(n, StringType()) for n in ("key", "n", "size", "score", "label", "target", "cid", "part", "rank", "th", "k", "ks", "kb", "ck", "rid",
                                         "first", "kind", "copy", "blank", "audit", "terms", "vec", "item")]
DOCUMENTS = schema(("doc_id", LongType()), ("text", StringType()), ("lang", StringType()), ("source", StringType()),
                   ("n_chars", LongType()), *CLASH)
BENCHMARK = schema(("item_id", LongType()), ("text", StringType()), *CLASH)
LABELS = schema(("doc_id", LongType()), ("quality", IntegerType()), ("toxic", IntegerType()), *CLASH)
EMBEDDINGS = schema(("vec_id", LongType()), ("embedding", ArrayType(FloatType())), ("label", IntegerType()))
CONVERSATIONS = schema(("conv_id", LongType()), ("turn", LongType()), ("role", StringType()), ("text", StringType()), *CLASH)

BASE = " ".join(f"word{i} and{i % 7}" for i in range(120))
LONG = " ".join(f"w{i * i % 9973} of the" for i in range(9000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def odd_documents():
    near = BASE.replace("word60", "changed")
    texts = [
        (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, near, "en", None), (3, near, "en", None), (4, None, "en", "b"),
        (5, "", "de", "b"), (6, " \t\n ", None, "b"), (7, "one", "en", "c"), (8, "one", "en", "c"),
        (9, "two words", "fr", None), (10, LONG, "en", "a"), (None, f"no id {PASSAGE} here", "en", "a"),
        (None, None, None, None), (11, f"X {PASSAGE.upper()}! tail", "en", "a"), (12, "ab " * 400, "en", "d"),
        (13, "naïve café über ñandú 東京 \U0001f600 é  x  y\n\nz", "es", "d"), (14, "%%% ### !!", None, "d"),
        (15, "Under the MIT License, under the mit licence; CC BY-NC 4.0 apache license, version 2", "en", "e"),
        (16, "123 4.5 don't l'été a.b\tc\r\nd", "en", "e"), (10, "same id, other text", "en", "a"),
    ]
    return [(i, t, lang, src, len(t) if t else None, *["x"] * len(CLASH)) for i, t, lang, src in texts]


def odd_conversations(seed=5, many=60, longest=300):
    """Every role and fault, nulls, equal turns, repeated rows and one long conversation."""
    rnd = random.Random(seed)
    roles, often = ["user", "assistant", "system", "tool", None, "", "User", "u"], [8, 8, 3, 1, 1, 1, 1, 1]
    texts = ["a.", "b!", "c?", "cut", "dots. no", "", "  ", "e. ", "x.\n", None, "long. one.", "é…", "naïve?\x0b"]
    rows = [(c, rnd.choice([k, k, k, k, k + rnd.randint(0, 3), None]), rnd.choices(roles, often)[0], rnd.choice(texts))
            for c in [*range(many), None] for k in range(rnd.choice([1, 1, 2, 3, 5, 9, 14]))]
    return rows + [(999, k, rnd.choice(roles[:3]), f"t{k % 90}.") for k in range(longest)]


def write(spark, path, documents=(), benchmark=(), labels=(), embeddings=(), conversations=()):
    for name, rows, kind in (("documents", documents, DOCUMENTS), ("benchmark", benchmark, BENCHMARK),
                             ("labels", labels, LABELS), ("embeddings", embeddings, EMBEDDINGS),
                             ("conversations", conversations, CONVERSATIONS)):
        spark.createDataFrame(list(rows), kind).write.mode("overwrite").parquet(os.path.join(path, f"{name}.parquet"))
    return path


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    pad = ["x"] * len(CLASH)
    benchmark = [(1, PASSAGE, *pad), (2, "one", *pad), (2, "one", *pad), (3, None, *pad), (4, "", *pad),
                 (None, "tail", *pad), (20, PASSAGE, *pad), (5, "tail here", *pad)]
    labels = [(1, 1, 0, *pad), (3, 1, 0, *pad), (3, 0, 0, *pad), (14, 0, 0, *pad), (None, 0, 0, *pad), (5, None, None, *pad),
              (10, 1, 0, *pad)]
    vectors = [(i, [float(i % 5 + 1), float(i % 3), 1.0], 0) for i in range(60)]
    vectors += [(60, None, 0), (61, [0.0, 0.0, 0.0], 0), (62, [1.0, None, 2.0], 0), (63, [float("nan"), 1.0, 1.0], 0),
                (64, [float("inf"), 1.0, 1.0], 0), (65, [1.0, 2.0], 0), (None, [1.0, 1.0, 1.0], 0), (20, [3.0, 2.0, 1.0], None),
                (40, vectors[40][1], 1)]
    return write(spark, str(tmp_path_factory.mktemp("odd")), odd_documents(), benchmark, labels, vectors,
                 [(*r, *pad) for r in odd_conversations()])


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def run(spark, name, sf_dir):
    from martflow.llm.registry import QUERIES
    return QUERIES[name](spark, sf_dir).collect()
