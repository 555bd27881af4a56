"""The registered queries on the test tables: rows as their SQL gives them, and the columns they promise."""

import os
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables aren't here")

COLUMNS = {
    "op1": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3": "page_id payload_bytes payload_digest record_type refers_to",
    "op4": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "doc_id fingerprint component_id",
    "op7": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op10": "doc_id expected_grade p_from_1 p_from_2 kept",
    "op11": "item_id rank doc_id score",
    "op12": "doc_id n_features weight score rank",
    "op13": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(found.columns)
    rows = found.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted(theirs.fetchall(), key=repr)


def test_pipeline(spark):
    packed = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in packed}
    assert 0 < len(ids) < spark.read.parquet(f"{SF}/documents.parquet").count()
