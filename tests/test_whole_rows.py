"""Queries over all rows, where the SQL twin of the same operator covers only some: against brute force."""

from __future__ import annotations

import csv
import json
from collections import defaultdict
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans.queries import queries

SMALL = "/root/testdata/sf0.001"


def _rows(name: str) -> list[dict]:
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def test_every_line_is_a_leg(spark):
    legs, metres = defaultdict(set), defaultdict(lambda: defaultdict(list))
    for x in _rows("lineitem"):
        if x["l_linenumber"] > 1:
            legs[x["l_orderkey"]].add(x["l_linenumber"])
        kind = x["l_suppkey"] % 3
        if kind < 2:
            metres[x["l_orderkey"]][kind] += [x["l_quantity"]] if x["l_partkey"] % 4 else []
    got = {r.id: r.legs for r in queries()["workouts_with_all_legs"](spark, SMALL).collect()}
    assert got == {x["o_orderkey"]: len(legs[x["o_orderkey"]]) for x in _rows("orders")} and max(got.values()) > 2
    total = {r.workout_id: r.total for r in queries()["workout_distance_all_lines"](spark, SMALL).collect()}
    want = {k: sum(sum(v) for v in kinds.values()) or None for k, kinds in metres.items()}
    assert total == pytest.approx(want)


def test_all_days_of_all_types(spark):
    days = defaultdict(set)
    for x in _rows("events"):
        if x["value"] is not None:
            days[x["event_type"]].add(x["ts"].date())
    want = {k: len(v) for k, v in days.items()}
    assert {r.type: r.days for r in queries()["trend_ols_all_days"](spark, SMALL).collect()} == want
    assert {r.type: r.n for r in queries()["lag1_all_days"](spark, SMALL).collect()} == want
    pairs = {r.pair: r.days for r in queries()["correlation_all_days"](spark, SMALL).collect()}
    assert all(pairs[f"{a}-{b}"] == len(days[a] & days[b]) for a in days for b in days if a < b)


def test_all_rows_of_windows_and_streams(spark):
    views = [x for x in _rows("events") if x["event_type"] == "view" and x["value"] is not None and datetime(2024, 1, 23) <= x["ts"] < datetime(2024, 1, 30)]
    got = {r.type: r for r in queries()["snapshot_fallback_window"](spark, SMALL).collect()}["view"]
    assert (got.window_end, got.earlier, got.records) == (datetime(2024, 1, 30), False, len(views))
    types = {x["p_partkey"] % 100 for x in _rows("part")}
    assert queries()["backfill_all_rows"](spark, SMALL).first().records == sum(x["l_partkey"] % 100 in types for x in _rows("lineitem"))


def test_series_reach_earlier_and_later_records(spark, tmp_path):
    """A record long before and one long after the SQL's days."""
    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    far = rows.where("event_type = 'click' and value is not null").limit(1)
    ends = [far.withColumn("ts", F.lit(x).cast("timestamp_ntz")) for x in ("2023-11-05 10:00:00", "2024-03-09 10:00:00")]
    rows.unionByName(ends[0]).unionByName(ends[1]).write.parquet(f"{tmp_path}/events.parquet")
    before = {r.type: r.samples for r in queries()["series_headline_by_kind"](spark, SMALL).collect()}
    after = {r.type: r.samples for r in queries()["series_headline_by_kind"](spark, str(tmp_path)).collect()}
    assert after == before | {"click": before["click"] + 2}
    whole = {r.type: r for r in queries()["series_coverage_days"](spark, str(tmp_path)).collect()}["click"]
    assert (whole.first_bucket, whole.last_bucket) == (datetime(2023, 11, 5), datetime(2024, 3, 9))


def _format(text: str | None) -> str:
    text = text or ""
    bare, first = text.strip(), text.strip().split("\n")[0]
    if not bare or "ConnectionTest" in text:
        return "probe" if bare else "empty"
    if bare[0] in "[{":
        return "array" if bare[0] == "[" else "metrics" if '"metrics"' in text else "ndjson"
    return "csv" if "startDate" in first and "," in first else "ndjson"


def test_values_reach_the_outputs(spark):
    """Every value comes back out of each format, and none is cut."""
    events = {x["event_id"]: x for x in _rows("events")}
    want = {k: x["value"] for k, x in events.items()}
    lines = {r.id: r.line for r in queries()["csv_flat_values"](spark, SMALL).collect()}
    fields = {k: next(csv.reader([x])) for k, x in lines.items()}
    assert {k: float(f[5]) for k, f in fields.items() if len(f) == 9} == {k: v for k, v in want.items() if v is not None}
    points = defaultdict(list)
    for r in queries()["metrics_values_json"](spark, SMALL).collect():
        points[r.name] += [p.get("qty") for p in json.loads(r.metric)["data"]]
    assert {k: sorted(v for v in vs if v is not None) for k, vs in points.items()} == {k: sorted(x["value"] for x in events.values() if x["event_type"] == k and x["value"] is not None) for k in points}
    sent = {r.id: r.line for r in queries()["line_protocol_values"](spark, SMALL).collect()}
    assert sent.keys() == events.keys()
    for k, line in sent.items():
        took = json.loads(events[k]["props"])["k"] * 10
        if k % 5 == 1 and took:
            assert f"duration={float(took)}," in line
        if k % 5 > 1 and want[k] is not None:
            assert line.startswith("health,") and ",unit=u value=" in line and float(line.split(" value=")[1].split(",")[0].split(" ")[0]) == want[k]


def test_own_texts_are_sniffed(spark):
    got = {r.doc_id: r.format for r in queries()["payload_sniffing_texts"](spark, SMALL).collect()}
    assert got == {x["doc_id"]: _format(x["text"]) for x in _rows("documents")}
