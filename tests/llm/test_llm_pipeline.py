"""The pipeline stage by stage."""

import hashlib

from llm_helpers import docs, rows

import corpus_pipeline
from voxloom.llm import common


def test_stages_on_awkward_rows(spark, sf_dir):
    frame, sizes = docs(spark), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.columns == frame.columns, name
        frame = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(frame.count())
    data = rows()
    lettered = [r for r in data if r[1] and any(map(str.isalpha, r[1]))]
    assert sizes[0] == len(lettered)
    assert sizes[1] == len({r[1].encode().lower() for r in lettered})
    last = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert len(last) == sizes[-1]
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in last)


def test_stages_on_empty_table(spark, sf_dir):
    frame = docs(spark, [], 1)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, sf_dir).count() == 0


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids"} <= set(found.columns) and found.count() > 0


def test_sizes_of_batches_are_only_filled_in(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k) for k in common.BATCHES}
    try:
        for k, (usual, _) in common.BATCHES.items():
            spark.conf.set(k, usual)
        common.long_texts(docs(spark))
        assert {k: spark.conf.get(k) for k in before} == {k: ours for k, (_, ours) in common.BATCHES.items()}
        spark.conf.set(key, "7")
        common.long_texts(docs(spark))
        assert spark.conf.get(key) == "7"
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def test_language_is_found_once_a_text(spark):
    """A filter on the language must not bring a second evaluation, and a second Python worker a task."""
    plan = corpus_pipeline.identify_language(spark, docs(spark), "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
