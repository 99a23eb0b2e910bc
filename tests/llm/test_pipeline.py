"""The pipeline on the small tables, each stage on what the one before kept."""

import zlib

import pytest

from test_near_copies import smallest_of_groups

import corpus_pipeline
from tidewater.llm import pii, toxicity
from tidewater.llm.shared import documents, store


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SF), [documents(spark, SF)]
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stage_columns_and_decisions(spark, stages):
    first = stages[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "best_fit_packing"]
    for kept in stages[1:4]:
        assert kept.columns == first.columns
    assert 0 < stages[1].count() <= first.count()
    want = smallest_of_groups([(r["doc_id"], r["text"]) for r in stages[1].collect()])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == want
    for r in stages[3].limit(50).collect():
        assert pii.base_spans(r["text"]) == [] or "[" in r["text"]
    assert {r[0] for r in stages[4].select("doc_id").distinct().collect()} == {r[0] for r in stages[3].select("doc_id").collect()}


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[4].columns and got.count() == stages[4].count()


def test_odd_rows_pass(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x", None, None, None), (3, "a b c", "en", "s", 5)], schema)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = store(stage(spark, docs, SF), "odd")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 3]
    assert zlib.crc32(b"1") and toxicity.Weights
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
