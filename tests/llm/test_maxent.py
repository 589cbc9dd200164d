from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import maxent
from pulsegrid.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def _words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _held_out(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def brute(docs):
    """(id, held out, tokens, known, N, base score) of each document."""
    counts = Counter()
    for d, text in docs:
        if not _held_out(d):
            counts.update([*_words(text), None])
    total, different = sum(counts.values()), len(counts)
    out = []
    for d, text in docs:
        tokens = [*_words(text), None]
        out.append((d, _held_out(d), len(tokens), sum(counts[t] > 0 for t in tokens), total, sum(math.log10((counts[t] + 1) / (total + different + 1)) for t in tokens)))
    return out


def held_against(got, docs):
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    own = sorted((tuple(r)[:6] for r in got), key=key)
    want = sorted(brute(docs), key=key)
    assert [x[:5] for x in own] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in own], [x[5] for x in want], rtol=1e-9, atol=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_query_and_held_out_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries()["op11_lm_scores"](spark, SMALL).collect()
    held_against(got, docs)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.98 * sum(r.base_score for r in out)


def test_learns_more_from_more(spark):
    got = maxent.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.97 * sum(r.base_score for r in got)


@pytest.mark.parametrize("lexicon", [1 << 17, 3])
def test_edges(spark, edge_docs, edge_rows, no_docs, monkeypatch, lexicon):
    """With a small lexicon nearly all words meet their counts in the join."""
    monkeypatch.setattr(maxent, "LEXICON", lexicon)
    rows = edge_rows + edge_rows[3:8] + [(i, "a b a\x1cc \x85 w" + "x" * 300) for i in range(20, 40)]
    frame = spark.createDataFrame([(d, t, 1, "r", 0.5) for d, t in rows], "doc_id long, text string, row int, word string, base double")
    held_against(maxent.score(frame).collect(), rows)
    assert maxent.score(no_docs).count() == 0
    only = [(d, t) for d, t in rows if _held_out(d)]
    held_against(maxent.score(spark.createDataFrame(only, "doc_id long, text string")).collect(), only)


def _events(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.geometric(0.02, n), 150)
    ids[::40] = maxent.END
    return maxent.events_of(ids, np.arange(0, n, 500)), np.bincount(ids, minlength=151)


def test_probabilities_add_up_to_one():
    events, counts = _events()
    weights = maxent.Weights.of_counts(counts)
    distinct, n = np.unique(events, return_counts=True)
    before = (weights.log_probs(distinct) * n).sum()
    weights.learn(distinct, n, 7)
    assert (weights.log_probs(distinct) * n).sum() > before
    for history in (events[5] // maxent.VOCAB, events[900] // maxent.VOCAB):
        assert abs(np.exp(weights.log_probs(history * maxent.VOCAB + np.arange(maxent.VOCAB))).sum() - 1) < 1e-4


def test_steps_follow_the_gradient(monkeypatch):
    """A step's change of a weight has the sign and, by the row, the proportions of the loss' derivative."""
    events, counts = _events(60)
    weights = maxent.Weights.of_counts(counts)
    start = weights.copy()
    weights.step(events, np.ones(len(events)))
    for which in (0, 1):
        row = int(np.argmax(weights.seen[which]))
        change = weights.tables[which][row] - start.tables[which][row]
        slope = np.zeros(len(change))
        for j in range(len(change)):
            sides = []
            for eps in (1e-2, -1e-2):
                moved = start.copy()
                moved.tables[which][row, j] += eps
                sides.append(-moved.log_probs(events).sum())
            slope[j] = (sides[0] - sides[1]) / 2e-2
        assert np.corrcoef(-slope, change)[0, 1] > 0.999


def test_events_begin_anew_with_each_document():
    events = maxent.events_of(np.array([5, 6, 0, 0, 7, 8, 9]), np.array([0, 3, 4]))
    word, last, before = maxent.parts_of(events)
    assert word.tolist() == [5, 6, 0, 0, 7, 8, 9] and last.tolist() == [0, 5, 6, 0, 0, 7, 8] and before.tolist() == [0, 0, 5, 0, 0, 0, 7]


def test_rounds_average_what_tasks_have_seen(spark):
    """Rows that one task alone has seen change as it says; all changes are weighted by what was seen."""
    ids = [np.minimum(np.random.default_rng(i).geometric(0.05, 200), 90).astype("<u2").tobytes() for i in range(40)]
    frame = spark.createDataFrame([(i, False, x) for i, x in enumerate(ids)], "row long, held_out boolean, ids binary").repartition(3)
    start = maxent.Weights.of_counts(np.ones(91))
    rows = maxent.changes(frame, start, 0, 3).collect()
    assert len({(r.which, r.row) for r in rows}) == len(rows) and {r.which for r in rows} == {0, 1}
    bias = next(r for r in rows if r.which == 0 and r.row == maxent.ROWS)
    assert bias.seen % 200 == 0 and bias.seen > 0
    assert all(len(r.change) == 4 * (maxent.CLASSES if r.which == 0 else maxent.MEMBERS) for r in rows)
