import pytest
from conftest import compare

import corpus_pipeline
from tracelet.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got, want = compare(spark, queries.QUERIES[name], queries.SQL[name], SMALL)
    assert got == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    rows, now = docs.count(), docs
    from tracelet.llm.common import cut

    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, SMALL))
        assert now.columns == docs.columns and now.count() <= rows
        rows = now.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert packed.select("doc_id").distinct().count() == rows
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()
