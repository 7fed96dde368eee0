"""The registered queries: SQL texts where there are any, whole tables, stable columns."""

import pytest

from tests.compare import connect, differences
from wattlens.llm.queries import LLM_ORACLES, LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_sql(spark, name):
    assert differences(LLM_QUERIES[name](spark, FOLDER), connect(FOLDER), LLM_ORACLES[name]) is None


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [
        ("op1_language_id", "documents", ["doc_id", "held_out", "lang_pred", "score"]),
        ("op3_length_buckets", "documents", ["doc_id", "length", "bucket", "batch", "slot", "padding"]),
        ("op4_ordinal_quality", "documents", ["doc_id", "expected_grade", "tail_probability", "selected"]),
        ("op7_toxicity", "documents", ["doc_id", "held_out", "score", "predicted"]),
        ("op8_simhash", "documents", ["doc_id", "fingerprint", "component_id", "members"]),
        ("op9_mix_sources", "documents", ["doc_id", "size", "source_size", "target", "taken"]),
        ("op10_repeats", "documents", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    ],
)
def test_one_row_per_document(spark, name, table, columns):
    found = LLM_QUERIES[name](spark, FOLDER)
    assert set(columns) <= set(found.columns)
    ids = sorted(r["doc_id"] for r in found.select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select("doc_id").collect())
