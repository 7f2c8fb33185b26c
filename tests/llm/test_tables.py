"""Every operator on odd and on empty tables, and its result's columns."""

import pytest

from martflow.llm.registry import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op2_token_output": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op3_quality_classifier": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op4_jaccard_join": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op5_lm_scoring": "doc_id:bigint n_words:bigint log_prob:double per_word:double",
    "op6_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op7_suffix_dedup": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op8_mixing_weights": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op9_license_scan": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string "
                        "labels:string score:double",
    "op10_nearest_neighbours": "query_id:bigint rank:int vec_id:bigint score:double",
    "op11_conversation_repair": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint "
                                "cost:bigint audit:string repaired_sha256:string",
    "op12_lexical_search": "item_id:bigint rank:int doc_id:bigint score:bigint",
    "op13_exact_topk": "query_id:bigint rank:int vec_id:bigint score:bigint",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_odd_and_empty_tables(spark, odd, empty, name):
    wanted = [tuple(c.split(":")) for c in COLUMNS[name].split()]
    none = QUERIES[name](spark, empty)
    assert none.dtypes[:len(wanted)] == wanted
    assert none.collect() == []
    some = QUERIES[name](spark, odd)
    assert some.dtypes[:len(wanted)] == wanted
    rows = some.collect()
    if int(name[2:].split("_")[0]) < 10:
        assert len(rows) == spark.read.parquet(f"{odd}/documents.parquet").count()


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    assert QUERIES["pipeline"](spark, empty).collect() == []
    assert QUERIES["pipeline"](spark, odd).count() > 0


def test_names_and_twins():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}
    assert set(ORACLE_SQL) <= set(QUERIES)
