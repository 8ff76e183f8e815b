"""The pipeline: stages keep the columns, take effect on their own input, and leave clean documents alone."""

import os

import pytest

import corpus_pipeline
from reuselake.llm import dartminhash, decontam, linededup
from reuselake.llm.common import stored
from reuselake.llm.queries import QUERIES

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, PATH), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 50
    assert decontam.digest(docs, spark.read.parquet(f"{PATH}/benchmark.parquet")).count() == 0
    assert dartminhash.digest(docs).where("class_rows > 1").count() == 0
    assert linededup.digest(docs).where("n_removed > 0").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, PATH)
    assert last.count() == counts[-1] and last.where("n_tokens = 0").count() == 0


def test_awkward_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, " ".join(f"w{i}" for i in range(80)), "en", "s", 3), (2, " ".join(f"w{i}" for i in range(80)), "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as _kept")
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.where("false")):
            out = stage(spark, some, PATH)
            assert out.count() <= some.count()
            if name != "bpe_encoding":
                assert out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, PATH).count() > 0
