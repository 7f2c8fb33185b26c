"""Queries of this subpackage, by registered name, with SQL twins where SQL
can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from martflow.llm import oracle
from martflow.llm.convrepair import op11_conversation_repair
from martflow.llm.decontaminate import op1_decontamination
from martflow.llm.impactsearch import op13_exact_topk
from martflow.llm.jaccard import op4_jaccard_join
from martflow.llm.langid import op6_language_id
from martflow.llm.lexical import op12_lexical_search
from martflow.llm.licenses import op9_license_scan
from martflow.llm.lmscore import op5_lm_scoring
from martflow.llm.mixing import op8_mixing_weights
from martflow.llm.neighbours import op10_nearest_neighbours
from martflow.llm.quality import op3_quality_classifier
from martflow.llm.substrings import op7_suffix_dedup
from martflow.llm.tokens import op2_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_output": op2_token_output,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing_weights": op8_mixing_weights,
    "op9_license_scan": op9_license_scan,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_topk": op13_exact_topk,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": oracle.DECONTAMINATION,
    "op4_jaccard_join": oracle.JACCARD,
    "op7_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op12_lexical_search": oracle.LEXICAL_SEARCH,
    "op13_exact_topk": oracle.EXACT_TOPK,
}
