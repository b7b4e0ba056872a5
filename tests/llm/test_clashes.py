"""Columns of the caller whose names clash with made ones, and stages on an empty table."""

import os

import pytest

from voltrace.llm.kneser_ney import kn_quality
from voltrace.llm.pii import find_pii

SF = "/root/testdata/sf0.001"


def test_quality_classifier_keeps_columns_of_its_own_names(spark):
    rows = [(k, f"a few words of text {k % 3}", "en", 7.5, "mine") for k in range(30)] + [(99, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity double, kept string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    got = kn_quality(docs, labels, payload=["lang", "perplexity", "kept"], prefix="m_").collect()
    assert {(r["doc_id"], r["perplexity"], r["kept"]) for r in got} == {(r[0], r[3], r[4]) for r in rows}
    assert all(isinstance(r["m_kept"], bool) and r["m_n_tokens"] >= 1 for r in got)


def test_personal_data_keeps_columns_of_its_own_names(spark):
    rows = [(1, "mail a@b.co or 10.0.0.1", "x", 5), (2, None, None, None), (2, "", "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int")
    got = find_pii(docs, payload=["spans", "n_email"], prefix="m_").collect()
    assert sorted((r["doc_id"], str(r["spans"]), str(r["n_email"])) for r in got) == sorted((r[0], str(r[2]), str(r[3])) for r in rows)
    assert {(r["spans"], r["m_n_email"], r["m_spans"]) for r in got} >= {("x", 1, "email:5:11,ip:15:23"), ("y", 0, "")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0, name
