import os

import pytest

import corpus_pipeline
from finquarry.llm.common import stage

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = stage(step(spark, docs, SF), "test-pipeline")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == names
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[5] > 0
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
