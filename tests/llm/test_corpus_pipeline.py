"""The stages of the corpus pipeline on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
    assert seen[0] >= seen[1] >= seen[2] > 0
    from voltrace.llm.exact_dedup import exact_dedup
    from voltrace.llm.jaccard_join import jaccard_components

    near = spark.read.parquet(str(tmp_path / "2"))
    assert exact_dedup(near).filter("group_size > 1").count() == 0
    assert jaccard_components(near, 5, 80).filter("component_id <> doc_id").count() == 0
    packed = sorted(map(tuple, docs.select("doc_id", "piece", "n_tokens").collect()))
    assert packed == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "n_tokens").collect()))


def test_queries_cover_all_operators(spark):
    from voltrace.llm.queries import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
