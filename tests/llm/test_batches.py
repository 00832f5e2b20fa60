"""Rows that the stages of the pipeline hand to Python at a time."""

import pyarrow as pa
import pytest

import corpus_pipeline

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("own, most", [(10_000, 500), (0, 500), (70, 70)])
@pytest.mark.parametrize("name", ["quality", "leaks"])
def test_stages_hand_few_rows_to_python(spark, name, own, most):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get(SETTING)
    try:
        spark.conf.set(SETTING, str(own))
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        sizes = [r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(count, "n long").collect()]
        assert sum(sizes) == 3000 and max(sizes) == most
    finally:
        spark.conf.set(SETTING, before)


def test_larger_groups_find_the_same_pairs(spark, monkeypatch):
    from shoalmark.llm import jaccard_join

    rows = [(b, k, 8, list(range(100 * b + k % 7, 100 * b + k % 7 + 5)), k % 30, 0, 60, 58) for b in (1, 2) for k in range(60)]
    members = spark.createDataFrame(rows, "bucket long, rep long, n long, first array<long>, component long, main long, n_members long, n_queries long")
    pairs = [sorted(map(tuple, jaccard_join._group_candidates(members, 8, 10, *s).collect())) for s in ((8, 8), (256, 1024))]
    assert pairs[0] == pairs[1] and pairs[0]

    used = []
    monkeypatch.setattr(jaccard_join, "jaccard_components", lambda docs, *_, sizes: used.append(sizes) or
                        docs.selectExpr("doc_id", "1L AS n_shingles", "doc_id AS component_id"))
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert dict(corpus_pipeline.STAGES)["groups"](spark, docs, "").count() == 2 and used == [(256, 1024)]
