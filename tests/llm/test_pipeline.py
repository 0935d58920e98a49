"""The pipeline's stages against brute force on a small table."""

import pytest

import corpus_pipeline
from cuewise.llm import mixing

from . import brute
from .test_operators import docs, odd_texts, prose  # noqa: F401  (docs: fixture)

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(odd_texts())]
    rows += [(50 + k, prose(50 + k, 30 + k), "en", "s0", 0) for k in range(20)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_the_columns(spark, documents):
    for name, run in corpus_pipeline.STAGES[:-1]:
        assert run(spark, documents, "").dtypes == documents.dtypes, name


def test_line_stage(spark, documents):
    lost = {9, 10, 11, 12}
    got = {r.doc_id: r for r in stage("line dedup")(spark, documents, "").collect()}
    before = {r.doc_id: r for r in documents.collect()}
    assert {k for k in got if got[k].text != before[k].text} == lost
    assert all(r.n_chars == len(r.text or "") for r in got.values())


def test_near_copies_leave_one(spark, documents):
    before = [(r.doc_id, r.text) for r in documents.collect()]
    want = sorted(doc for doc, _, component in brute.jaccard_components(before) if doc == component)
    assert sorted(r.doc_id for r in stage("n-gram Jaccard join")(spark, documents, "").collect()) == want


def test_mixing_stage_repeats_documents(spark, documents):
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(documents).collect()}
    want = sorted(doc for doc, (t, size) in taken.items() if size for _ in range((2 * t + size) // (2 * size)))
    assert sorted(r.doc_id for r in stage("mixing sources to target weights")(spark, documents, "").collect()) == want


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.length <= 1024 for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None
