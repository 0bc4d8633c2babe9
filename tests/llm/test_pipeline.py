import collections

import pytest

import corpus_pipeline as pipeline
from docmill.llm import _base

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_their_predecessors_kept(spark, tmp_path):
    docs = _base.table(spark, SF, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in _base.table(spark, SF, "labels").collect()}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "mixing", "bpe"]
    counts = [docs.count()]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(path := f"{tmp_path}/{i}")
        after = spark.read.parquet(path)
        if i < len(pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        if i == 0:
            gone = {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in after.select("doc_id").collect()}
            assert all(labels.get(d, 1) == 1 for d in gone) and sum(labels.get(d) == 1 for d in gone) >= 0.5 * sum(labels.values())
        if i == 1:
            texts = collections.Counter(r["text"] for r in after.select("text").collect())
            assert max(texts.values()) == 1
        docs = after
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nulls_and_empty_tables(spark, stage):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert pipeline.STAGES[stage][1](spark, docs, SF).count() >= 1
    assert pipeline.STAGES[stage][1](spark, docs.limit(0), SF).count() == 0
