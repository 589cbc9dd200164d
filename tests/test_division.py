"""Payloads taken apart and divided: exact texts, dates, refusals, halving."""

from __future__ import annotations

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.sinks import division
from pulsegrid.sources import formats

_POINT = '{"date":"2026-01-01T00:00:00.500Z","qty":72.0}'
PAYLOADS = {
    "ndjson": '{"a":1,"startDate":"2026-01-01T00:00:00Z"}\n{"kind":"typeCoverage","type":"x"}\n{"b":1.10,"text":"é\\n"}\n',
    "json": '[\n{"a":1},\n{"b":"],"},\n{"c":"x,"}\n]\n',
    "csv": 'id,type,kind,startDate\na,b,c,2026-01-01T00:00:00Z\n"x\ny",b,"c""",\nlast,"a,b",c,never\n',
    "lines": 'health,type=a\\ b,source=x\\,y value=1.5 1787428246500000000\nhealth_deletions,type=h,id=d deleted=true\nh note="a \\"b\\" 5",x=1 7\n',
    "metrics": '{"data":{"deletions":[{"date":"2026-01-03T00:00:00Z"}],"metrics":[{"aggregated":true,"data":[' + _POINT + ',{"date":"é\\"]x","n":{"a":[1,{"b":2}]},"qty":1e5}],"name":"heart_rate","units":"bpm"},'
    '{"data":[{"qty":1.10}],"name":"z","units":"u"}],"workouts":[{"a":1,"start":"2026-01-02 03:04:05 +0100"}]}}',
}


def _held(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "k int, payload string")


def _parts(df):
    return [(r.records, r.payload) for r in df.orderBy("k", "part").collect()]


@pytest.mark.parametrize("form", division.FORMS)
def test_put_together_exactly(spark, form):
    records = division.decompose(_held(spark, PAYLOADS[form]), form)
    assert records.where("pos is null").count() == 0 and records.count() >= 3
    assert division.recompose(records, form, "k").first().payload == PAYLOADS[form]


@pytest.mark.parametrize("form", division.FORMS)
def test_each_record_in_one_part(spark, form):
    held = _held(spark, PAYLOADS[form])
    want = [(r.kind, r.name, r.record) for r in division.decompose(held, form).orderBy("pos").collect()]
    for parts in (division.divide_by_count(held, form, 1), division.divide_by_bytes(held, form, 1)):
        assert [r.records for r in parts.collect()] == [1] * len(want)
        again = division.decompose(parts.select("k", "part", "payload"), form).orderBy("part", "pos").collect()
        assert [(r.kind, r.name, r.record) for r in again] == want


def test_dates(spark):
    dates = lambda form, **x: [r.date for r in division.decompose(_held(spark, PAYLOADS[form]), form, **x).orderBy("pos").collect()]
    day = datetime(2026, 1, 1)
    assert dates("ndjson") == [day, None, None] and dates("csv") == [day, None, None]
    assert dates("lines")[:2] == [datetime(2026, 8, 22, 19, 50, 46, 500000), None]
    assert dates("metrics") == [day.replace(microsecond=500000), None, None, datetime(2026, 1, 2, 2, 4, 5), datetime(2026, 1, 3)]
    seconds = division.decompose(_held(spark, "h x=1 60\n"), "lines", precision=1_000_000_000).first()
    assert seconds.date == datetime(1970, 1, 1, 0, 1)
    assert [r.measurement for r in division.decompose(_held(spark, PAYLOADS["ndjson"]), "ndjson").orderBy("pos").collect()] == [True, False, True]


def test_window_keeps_undated(spark):
    records = division.decompose(_held(spark, PAYLOADS["metrics"]), "metrics").where("date is null or date < timestamp_ntz'2026-01-02'")
    got = json.loads(division.recompose(records, "metrics", "k").first().payload)["data"]
    assert sorted(got) == ["metrics"] and [len(m["data"]) for m in got["metrics"]] == [2, 1]


@pytest.mark.parametrize(
    "form,payload",
    [
        ("ndjson", '{"a":1}\nno object\n'), ("ndjson", '{"a":1}\n\n{"b":1}\n'), ("ndjson", '{"a":1}'), ("json", '[{"a":1},{"b":2}]'), ("csv", ""), ("csv", "id\r\n\n1\n"), ("lines", "a b=1"),
        ("metrics", json.dumps(json.loads(PAYLOADS["metrics"]), indent=1)), ("metrics", '{"data":{"metrics":[{"data":[{"a":1},{"b":1}],"name":"x"}]}}'),
        ("metrics", '{"data":{"metrics":[{"data":[],"name":"x","units":"u"}]}}'), ("metrics", '{"data":{"metrics":[],"other":[{"a":1}]}}'), ("metrics", '{"data":{"metrics":[{"data":[' + '{"a":' * 12 + "1" + "}" * 12 + ',{"b":1}],"name":"x","units":"u"}]}}'),
        ("metrics", "x"), ("metrics", ""), ("json", None), ("lines", None),
    ],
)
def test_not_taken_apart_stays_whole(spark, form, payload):
    held = _held(spark, payload)
    assert _parts(division.divide_by_count(held, form, 1)) == _parts(division.divide_by_bytes(held, form, 5)) == [(None, payload)]
    records = division.decompose(held, form)
    assert [(r.pos, r.record) for r in records.collect()] == [(None, payload)]
    assert division.recompose(records, form, "k").first().payload == payload


def test_halved_until_framed(spark):
    rows = [f'{{"n":{i},"x":"{"y" * (i % 7)}"}}' for i in range(101)]
    held = _held(spark, "".join(f"{r}\n" for r in rows))
    plain = _parts(division.divide_by_bytes(held, "ndjson", 400))
    framed = division.divide_by_bytes(held, "ndjson", 400, frame=lambda c: F.replace(F.base64(c), F.lit("\r\n"), F.lit("")))
    framed = _parts(framed)
    assert len(framed) == 2 * len(plain) - (len(base64.b64encode(plain[-1][1].encode())) <= 400)
    for n, text in framed:
        assert len(base64.b64encode(text.encode())) <= 400 and n == text.count("\n")
    assert "".join(t for _, t in plain) == "".join(t for _, t in framed) == "".join(f"{r}\n" for r in rows)


def test_filled_in_order_larger_ones_alone(spark):
    sizes = [10, 10, 200, 10, 30, 30, 30]
    rows = ["h " + "x" * (n - 4) + "=1" for n in sizes]
    got = _parts(division.divide_by_bytes(_held(spark, "".join(f"{r}\n" for r in rows)), "lines", 64))
    assert [n for n, _ in got] == [2, 1, 2, 2]


def test_large_payload(spark):
    lines = "".join(f'{{"id":"{i}","startDate":"2026-01-01T00:00:00Z"}}\n' for i in range(60_000))
    got = _parts(division.divide_by_bytes(_held(spark, lines), "ndjson", 1 << 18))
    assert sum(n for n, _ in got) == 60_000 and "".join(t for _, t in got) == lines
    points = ",".join(_POINT for _ in range(20_000))
    whole = '{"data":{"metrics":[{"data":[' + points + '],"name":"a","units":"u"},{"data":[' + points + '],"name":"b","units":"u"}]}}'
    got = _parts(division.divide_by_bytes(_held(spark, whole), "metrics", 1 << 18))
    assert sum(n for n, _ in got) == 40_000 and max(len(t) for _, t in got) <= 1 << 18


def test_no_shuffle_no_python(spark):
    plan = division.divide_by_bytes(_held(spark, "x"), "csv", 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_empty_table(spark):
    for form in division.FORMS:
        none = _held(spark, "x").where("false")
        assert division.decompose(none, form).count() == division.divide_by_bytes(none, form, 5).count() == division.divide_by_count(none, form, 5).count() == 0


def test_line_tokens(spark):
    lines = [r'a\ b,type=x\=y\,z,id=c\\ text="q \"r\", s=1",n=5i,ok=true -12', "h x=1", "h,x=1 x=1,x=2 3", "h", "h,x y=1", "", None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(lines)), "i int, l string").select("i", formats.line_tokens(F.col("l")).alias("t")).orderBy("i").collect()]
    assert got[0] == ("a b", {"type": "x=y,z", "id": "c\\"}, {"text": 'q "r", s=1', "n": "5i", "ok": "true"}, -12)
    assert got[1] == ("h", {}, {"x": "1"}, None) and got[2].fields == {"x": "1"}
    assert got[3:] == [None] * 4
