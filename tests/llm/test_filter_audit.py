from __future__ import annotations

from collections import Counter
from itertools import permutations

import pytest
from oracle import compare, views

from pulsegrid.llm import filteraudit
from pulsegrid.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


def test_twin(spark):
    compare(queries()["op13_filter_audit"](spark, SMALL), views(SMALL), oracle_sql()["op13_filter_audit"])


def _fails(text: str) -> str:
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    return found + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)


def brute(docs, labels):
    """(part, order, step) → counts, by applying the filters one after the other."""
    rows = []
    for d, text, part in docs:
        smaller = d is not None and any(e is not None and e < d and (t or "") == (text or "") for e, t, _ in docs)
        own = [(q, t) for x, q, t in labels if x is not None and x == d]
        rows.append((part or "", _fails(text or "") + "E" * smaller, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            here, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                lost, stay = [r for r in here if f in r[1]], [r for r in here if f not in r[1]]
                shapley[part, f] += len(lost)
                out[part, order, step] = [len(stay), len(lost), sum(f in r[1] for r in gone), sum(r[1] == f for r in rows if r[0] == part), sum(r[2] for r in lost), sum(r[3] for r in lost)]
                here, gone = stay, gone + lost
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def edges():
    long = " ".join(f"word{i}" for i in range(250))
    docs = [
        (1, None, None), (2, "", ""), (3, long, "en"), (4, long, "en"), (4, long, "de"), (5, long + " $", "en"), (None, long, "en"), (None, None, "en"), (6, "a " * 300, "en"), (7, "A" * 9, "en"), (8, "É" * 30 + "A", "en"),
        (9, long.upper(), "fr"), (10, " \t\n\x0b\x0c\r\x1c\x85  x", "fr"), (11, "w " * 60_000 + long, "fr"), (12, long.upper(), "fr"), (0, "only this one", "x y"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (5, None, 1), (7, 2, 1), (None, 1, 1), (12, 1, 1), (99, 1, 1)]
    return docs, labels


def test_edges(spark, edges):
    docs, labels = edges
    frame = spark.createDataFrame([(*d, "s", 7, 1) for d in docs], "doc_id long, text string, lang string, part string, mask int, state int")
    said = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    rows = filteraudit.audit(frame, said).collect()
    assert len(rows) == 600 * 5
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows} == brute(docs, labels)
    assert filteraudit.audit(frame.limit(0), said).count() == 0
    assert sum(r.good_lost for r in filteraudit.audit(frame, said.limit(0)).collect()) == 0


def test_fields_dont_overflow():
    many, top = 1 << 56, filteraudit.GOOD + filteraudit.TOXIC + 31
    counts, shapley = filteraudit.unpacked(many * filteraudit.packed(top) + 3 * filteraudit.packed(0))
    assert counts.max() == many and shapley.tolist() == [24 * many] * 5
    assert counts[:, 0].tolist() == [3] * 600


def test_sums_are_sent_on_when_many_parts_are_held(spark):
    rows = spark.createDataFrame([(f"p{i % 700}", i % 128) for i in range(2100)], "part string, state int").coalesce(2)
    got = {r.part: int.from_bytes(r.total, "little") for r in filteraudit.summed(rows).collect()}
    want = Counter()
    for i in range(2100):
        want[f"p{i % 700}"] += filteraudit.packed(i % 128)
    assert got == dict(want)
