from pathlib import Path

import pytest

import corpus_pipeline
from quaylark.llm import registry

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(D).exists(), reason="no test data")
def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, n = docs.columns, docs.count()
    out = corpus_pipeline.run(spark, D)
    assert out.columns == [*columns, "copies"] and 0 < out.count() < n
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, D).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES if q.startswith("op")) == list(range(1, 14))
    assert "pipeline" in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)
