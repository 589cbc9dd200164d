"""Each stage against its plain version, on its own input."""

from __future__ import annotations

import brute
import corpus_pipeline as pipeline
import pytest
from test_tokens import check_pieces

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """(stage, input rows, output rows) of every stage."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    junk = spark.createDataFrame([(10_001, "1234 5678", "en", "src0", 9), (10_002, None, "en", "src0", 0), (10_003, 'say token = "0123456789abcdef0123"', "en", "src1", 30)], docs.schema)
    docs = docs.unionByName(junk)
    for name, stage in pipeline.STAGES:
        made = pipeline.write_table(stage(spark, docs, SMALL), "step")
        out.append((name, docs.collect(), made.collect(), docs.columns, made.columns))
        docs = made
    return {x[0]: x[1:] for x in out}


def test_columns(steps):
    for name, (_, _, before, after) in steps.items():
        assert name == "packing" or before == after


def test_language(steps):
    before, after, *_ = steps["language"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {10_001, 10_002}
    assert {r.doc_id: tuple(r) for r in before if r.doc_id not in gone} == {r.doc_id: tuple(r) for r in after}


def test_lines(steps):
    before, after, *_ = steps["line dedup"]
    want = brute.kept_lines([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: (r.text, r.n_chars) for r in after} == {d: (t, len(t)) for d, (_, _, t) in want.items()}


def test_copies(steps):
    before, after, *_ = steps["near dedup"]
    want = brute.alike([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == set(want.values()) and len(after) == len({r.doc_id for r in after})
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_no_document_goes_for_one_that_it_does_not_resemble(steps):
    """Each document that goes has another of a similarity of 0.8 or more; nearly all that have one before them go."""
    before, after, *_ = steps["near dedup"]
    texts, kept = {r.doc_id: r.text for r in before}, {r.doc_id for r in after}
    like = {d: {e for e in texts if e != d and brute.jaccard(texts[d], texts[e]) >= 0.8} for d in texts}
    assert all(like[d] for d in texts if d not in kept)
    due = [d for d in texts if any(e < d for e in like[d])]
    assert sum(d not in kept for d in due) >= 0.9 * len(due)


def test_secrets(steps):
    before, after, *_ = steps["secret scan"]
    assert {r.doc_id: r.text for r in after} == {r.doc_id: brute.masked(r.text) for r in before}
    assert any("[assign]" in r.text for r in after)


def test_packing(steps):
    before, after, *_ = steps["packing"]
    check_pieces(after, {r.doc_id: r.text for r in before})


def test_run(spark):
    from __spark_entry__ import queries

    assert queries()["pipeline"](spark, SMALL).count() > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
