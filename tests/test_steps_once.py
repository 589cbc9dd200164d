"""Filters that Spark would push below costly steps, and so repeat these."""

from __future__ import annotations

import pytest

from pulsegrid.operators import pages
from pulsegrid.plans.queries import queries
from pulsegrid.sinks import division
from pulsegrid.sinks import formats as out
from pulsegrid.sources import formats
from pulsegrid.streaming import ingest

SMALL = "/root/testdata/sf0.001"
LINE = "id string, type string, kind string, startDate string, endDate string, value double, unit string, source string, device string, activity string, duration double"


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return [x for x in plan if x.strip(" :+-").startswith("Filter")]


def test_no_filter_writes_the_line(spark):
    found = _filters(queries()["line_protocol"](spark, SMALL))
    assert not [x for x in found if "translate(" in x or "concat_ws(" in x]


def test_no_filter_takes_payloads_apart(spark):
    """A filter on the pieces made each payload be taken apart three times."""
    for form in division.FORMS:
        payloads = spark.createDataFrame([("1,x\n2,y\n",)], "payload string")
        assert not [x for x in _filters(division.decompose(payloads, form)) if "split(" in x or "regexp_extract_all(" in x], form
    payloads = spark.createDataFrame([("x", "b", None, 0)], "value string, batch string, modified timestamp, block long")
    assert not [x for x in _filters(ingest.lines_of_payloads(payloads)) if "from_json" in x or "regexp_extract_all(" in x]


def test_payloads_without_records_and_not_taken_apart(spark):
    payloads = spark.createDataFrame([("a", "x"), ("b", "[\n]\n"), ("c", None), ("d", '[\n{"k":1},\n{"k":2}\n]\n'), ("e", "[\n\n]\n")], "n string, payload string")
    got = [(r.n, r.pos, r.record) for r in division.decompose(payloads, "json").orderBy("n", "pos").collect()]
    assert got == [("a", None, "x"), ("b", None, "[\n]\n"), ("c", None, None), ("d", 0, '{"k":1}'), ("d", 1, '{"k":2}'), *[x for x in got if x[0] == "e"]]


@pytest.mark.parametrize("reader", [pages.workout_route_points, pages.workout_routes])
def test_lines_of_routes_are_parsed_once(spark, reader):
    """Three readers parsed every line, and each of their filters did so again."""
    lines = spark.range(3).selectExpr("cast(id as string) value")
    plan = reader(formats.route(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("Range (") == 1


def test_tagged_values_are_parsed_once_each(spark):
    """Two values are read back, and each of their uses parsed the text again."""
    plan = queries()["tagged_metadata"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 2


@pytest.mark.parametrize(
    ("row", "told"),
    [
        ({"kind": "deletion", "id": None}, False), ({"kind": "deletion", "id": ""}, False), ({"kind": "deletion", "id": "1"}, True), ({"kind": "workout"}, False), ({"kind": "workout", "id": "1"}, True),
        ({"kind": "workout", "duration": 2.0}, True), ({"kind": "workout", "endDate": "2026-01-01T00:00:01Z"}, True), ({"kind": "workout", "endDate": "2025-01-01T00:00:01Z"}, False), ({"kind": "quantity"}, False),
        ({"kind": "quantity", "value": 1.0}, True), ({"kind": "quantity", "value": float("nan")}, False), ({"kind": "quantity", "id": "1"}, True), ({"kind": None, "value": float("inf"), "id": ""}, False), ({"kind": None, "value": 2.0}, True),
    ],
)
def test_a_record_without_a_field_has_no_line(spark, row, told):
    names = [x.split(" ")[0] for x in LINE.split(", ")]
    whole = {"type": "t", "startDate": "2026-01-01T00:00:00Z", "endDate": "2026-01-01T00:00:00Z", **row}
    got = [r.line for r in out.line_protocol(spark.createDataFrame([tuple(whole.get(n) for n in names)], LINE)).collect()]
    assert len(got) == told and all(" " in x and not x.endswith("null") for x in got)
