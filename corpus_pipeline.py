"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and reread as the next stage's docs. All but the last return the
columns of documents; the last returns the index of the token files as read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martflow.llm.common import read_table, stage
from martflow.llm.decontaminate import decontaminate
from martflow.llm.jaccard import near_duplicate_stage
from martflow.llm.mixing import mix_stage
from martflow.llm.quality import quality_stage
from martflow.llm.tokens import tokens_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontaminate),
    ("mixing_weights", mix_stage),
    ("token_output", tokens_stage),
]

#: A trained classifier and a tokenizer are not SQL; tests/llm holds the result
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
