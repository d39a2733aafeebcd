"""Registered queries on the smallest driver tables, against their SQL where there is one."""

import os
from collections import Counter

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def test_all_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [
    "op1_embedding_near_dedup", "op2_source_mixing", "op4_substring_dedup", "op6_ngram_jaccard_join", "op9_url_filter",
    "op11_periodic_runs", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    from workload.check import compare

    assert compare(spark, FOLDER, [name]) == []


@pytest.mark.parametrize("name, columns", [
    ("op3_secret_scan", {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}),
    ("op5_quality_classifier", {"doc_id", "held_out", "score", "predicted"}),
    ("op7_quality_rules", {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}),
    ("op10_token_id_output", {"doc_id", "start", "n_tokens", "ids_crc32"}),
])
def test_a_row_for_each_document(spark, name, columns):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert columns <= set(df.columns) and df.count() == docs.count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    left, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, FOLDER)
        assert out.schema.fieldNames() == docs.schema.fieldNames()
        left = spark.createDataFrame(out.collect(), docs.schema)
        ids = Counter(r.doc_id for r in left.collect())
        assert set(ids.values()) == {1} and len(ids) <= before
        before = len(ids)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(ids)
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


@pytest.mark.parametrize("name", ["quality rules", "near duplicates", "secrets", "source mix", "packing"])
def test_stages_take_odd_rows(spark, name):
    import corpus_pipeline
    from tests.llm.samples import documents, odd_documents

    stage = dict(corpus_pipeline.STAGES)[name]
    for texts in (odd_documents(), []):
        df = documents(spark, texts, clashing=("domain", "epoch", "score", "kept"))
        assert stage(spark, df, FOLDER).count() >= 0
