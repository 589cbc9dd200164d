"""Rows that share an id but not their text."""

from __future__ import annotations

from pulsegrid.llm import langid, linededup, simhash
from pulsegrid.llm.common import drop_rows

COMMON = "a line that is long enough and common"


def test_a_line_goes_only_from_the_row_that_has_it(spark):
    rows = [(1, f"{COMMON}\nthe first row of id one"), (1, f"a line that only this row has\n{COMMON}\n{COMMON}"), (2, COMMON), (3, COMMON), (3, f"last\n{COMMON}")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, "a line that only this row has"), (1, "the first row of id one"), (2, ""), (3, COMMON), (3, f"last\n{COMMON}")]
    assert sorted((r.doc_id, r.text) for r in got) == want


ENGLISH = "the cat and the dog went to the house of the old man in the village by the sea"


def test_language_judges_rows_and_not_ids(spark):
    rows = [(1, "1234", "en"), (1, ENGLISH, "en"), (2, f"{ENGLISH} and back", "en"), (None, "99", "en"), (None, f"{ENGLISH} again", "en"), (3, None, "en")]
    docs = spark.createDataFrame([(*r, "src0", 1) for r in rows], "doc_id long, text string, lang string, source string, gone_id int")
    key = langid.evidence_key()
    kept = drop_rows(docs, langid.identify(docs, extra=key).where("not accepted"), key)
    assert kept.columns == docs.columns
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect()) == sorted((repr(i), t) for i, t, _ in rows if t and not t.isdigit())


def test_one_row_of_a_group_stays(spark):
    """Copies under other ids and without any go, an id's other text stays, and exact repeats of the row that stays stay with it."""
    long = " ".join(f"word{i}" for i in range(300))
    near = long.replace("word7 ", "other ")
    rows = [(1, "a text of its own, with an id of another"), (1, long), (1, long), (5, near), (None, long), (None, "a lone text without an id"), (9, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (0, 100):
        kept = drop_rows(docs, simhash.similar_copies(docs), simhash.text_key(), limit=limit)
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[0], rows[1], rows[2], rows[5], rows[7]]))
