"""The pipeline's stages, each against its own input, and the registered queries on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
import oracle_check
from test_near_dedup import stay
from wardflow.llm import decontaminate, pii
from wardflow.session import run_folder

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_stages(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folder, docs, steps = run_folder(spark, "pipeline-test"), documents, [documents]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        steps.append(docs)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == documents.columns, name
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    before, after = rows[1], rows[2]  # one of each near-duplicate component
    kept, pairs = stay([(i, r.text) for i, r in sorted(before.items())])
    assert pairs and after.keys() == kept < before.keys()
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not any(decontaminate.normal(x) in decontaminate.normal(r.text) for r in rows[3].values() for x in items)
    assert all(any(decontaminate.normal(x)[:10] in decontaminate.normal(after[i].text) for x in items) for i in after.keys() - rows[3].keys())
    assert rows[4].keys() == rows[3].keys() and not any(pii.base_spans(r.text) for r in rows[4].values())
    assert rows[5].keys() == rows[4].keys() and all(r.round_trip and r.text == rows[4][i].text for i, r in rows[5].items())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_url_query_against_sql(spark):
    con = oracle_check.connect(FOLDER)
    ok, message, _ = oracle_check.compare(spark, con, "op10_url_list_join", entry.queries()["op10_url_list_join"], entry.oracle_sql()["op10_url_list_join"], FOLDER)
    assert ok, message
