"""A text is JSON if it is one value and nothing else."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.variants import _END, whole_json
from pulsegrid.operators import state
from pulsegrid.sources import formats

GOOD = ['{"a":1}', ' {"a":[1,{"b":null}]} \n', "12", '"x"', "null", "[]", json.dumps({"a": _END}), "[[1],[2]]"]
BAD = ['{"a":1} x', '{"a":1}{"b":2}', "123 abc", "1 2", "1,2", '{"a":1},2]', '{"a":1}],[2', f'{{"a":1}},"{_END}"]', '"a', "", " ", "x", '{"a":1},"', "1]"]


def test_one_value_and_nothing_else(spark):
    rows = spark.createDataFrame([(t,) for t in GOOD + BAD + [None]], "t string").select("t", F.to_json(whole_json("t")).alias("j"))
    got = {r.t: r.j for r in rows.collect()}
    assert {t: json.loads(got[t]) for t in GOOD} == {t: json.loads(t) for t in GOOD}
    assert [t for t in [*BAD, None] if got[t] is not None] == []


def test_quarantine_tells_what_follows_a_value(spark):
    """Documents that begin with a number were JSON without fields."""
    lines = spark.createDataFrame([("8294846167456848 Inly onhe.",), ("8294846167456848 Hasttion.",), ('{"k": 1}',), ('{"k": 1}',), (None,)], "line string")
    held = state.quarantine(lines, "line", 7).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("seen").alias("seen"))
    assert {(r.reason, r.n, r.seen) for r in held.collect()} == {("not_json", 2, 2), ("missing_fields", 2, 3)}


@pytest.mark.parametrize("tail", [" x", "{}", ",", "]"])
def test_lines_and_arrays_with_more_behind_them_are_no_records(spark, tail):
    line = '{"id":"1","type":"t","startDate":"2026-01-01T00:00:00Z"}'
    rows = spark.createDataFrame([(line,), (line + tail,)], "value string")
    assert [r.route for r in formats.route(rows).collect()] == ["sample", "quarantine"]
    arrays = spark.createDataFrame([(f"[{line}]{tail}",)], "value string")
    assert [r.route for r in formats.parse_array(arrays).collect()] == ["unreadable"]
