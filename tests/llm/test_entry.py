"""Every registered query of the training-data operators over whole small tables, with the columns that are agreed on."""

import pytest

import __spark_entry__ as entry
from cellmill.llm.queries import QUERIES

COLUMNS = {
    "op1_mixing": "doc_id size source_size target taken",
    "op2_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_katz_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_spotsigs": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_decontamination": "doc_id item_id",
    "op10_jaccard_join": "doc_id class_id n_links",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf, name):
    assert entry.queries()[name] is QUERIES[name]
    df = QUERIES[name](spark, sf)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.count()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows == docs if name not in ("op3_chat_format", "op9_decontamination") else rows > 0


def test_no_python_in_spotsigs(spark, sf):
    plan = QUERIES["op7_spotsigs"](spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
