"""Notes and tracks as ordered rows; the text helpers."""

from __future__ import annotations

import glob
import os
import xml.etree.ElementTree as ET
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import prose
from pulsegrid.sinks import documents


def _text(lines, doc):
    return "\n".join(r.line for r in lines.where(F.col("doc") == doc).orderBy(*documents.ORDER).collect()) + "\n"


@pytest.mark.parametrize("value,want", [(0.0, "0"), (1234567.0, "1,234,567"), (-1234.5, "-1,234.50"), (999.999, "1,000"), (12.346, "12.35"), (float("nan"), "—"), (float("inf"), "—")])
def test_grouped(spark, value, want):
    assert spark.range(1).select(prose.grouped_number(F.lit(value))).first()[0] == want


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(prose.length_text(F.lit(float(s)))) for s in (0, 59, 60, 3599, 3600, 5400, 90060)] == ["0 s", "59 s", "1 m", "1 h", "1 h", "1 h 30 m", "25 h 1 m"]
    assert [one(prose.listed(F.array(*(F.lit(x) for x in w)).cast("array<string>"))) for w in ("", "a", "ab", "abc")] == ["", "a", "a and b", "a, b, and c"]
    assert [one(prose.yaml_key(F.lit("k"), F.lit(u).cast("string"))) for u in ("count", "", None, "count/min", "%", "m", "·")] == ["k", "k", "k", "k_count_per_min", "k_percent", "k_m", "k"]
    assert one(prose.yaml_text(F.lit('a"b'))) == '"a\\"b"' and one(prose.table_cell(F.lit("a|b\nc"))) == "a\\|b c"
    assert [one(prose.trimmed_decimal(F.lit(v), 3)) for v in (100.0, 1.25, -0.0001, float("nan"))] == ["100", "1.25", "0", "0"]


def test_tracks(spark, tmp_path):
    points = spark.createDataFrame(
        [("r", 0, i, 1.0 + i, 2.5, float(i), f"2026-01-01T00:00:0{i}Z", 1.5) for i in range(3)] + [("r", 1, 7, 95.0, 4.0, None, None, None), ("r", 1, 8, -10.0, 180.0, None, None, None), ("r", 1, 9, None, 4.0, None, None, None), ("r", 2, 11, float("nan"), 1.0, None, None, None)],
        "route string, segment int, pos int, lat double, lon double, ele double, time string, speed double",
    )
    routes = spark.createDataFrame([("r", "A & B", "x", datetime(2026, 1, 1), "Running"), ("empty", None, None, None, None)], "route string, title string, description string, started timestamp_ntz, activity string")
    lines = documents.track_lines(points, routes)
    documents.write_documents(lines, str(tmp_path / "gpx"), partitions=5)
    for doc, n in (("r", [3, 1, 0]), ("empty", [])):
        files = sorted(glob.glob(str(tmp_path / f"gpx/doc={doc}/*.txt")))
        text = "".join(open(f, encoding="utf-8").read() for f in files)
        assert text == _text(lines, doc)
        root = ET.fromstring(text.encode())
        at = "{http://www.topografix.com/GPX/1/1}"
        assert [len(s.findall(f"{at}trkpt")) for s in root.iter(f"{at}trkseg")] == n
    assert os.listdir(tmp_path / "gpx") and len(glob.glob(str(tmp_path / "gpx/doc=r/*.txt"))) > 1
    assert "<name>A &amp; B</name>" in _text(lines, "r") and "<pg:speed>1.5</pg:speed>" in _text(lines, "r") and 'lon="180"' in _text(lines, "r")
    found = spark.createDataFrame([("r", 2, 6, 3, 9, 1, 0, 0)], "route string, segments int, present int, missing int, declared int, gaps int, lead int, tail int")
    got = {r.route: r for r in documents.track_summary(points, routes, found).collect()}
    assert tuple(got["r"])[1:] == (4, 3, 3, False, "Missing 3 of 9 points (1 gap in the middle).")
    assert tuple(got["empty"])[1:] == (0, 0, 0, False, "No pages of this route are there.")


SAMPLE = "id string, type string, kind string, start_ts timestamp_ntz, end_ts timestamp_ntz, value double, unit string, activity string"


def test_notes(spark):
    at = lambda d, h, m=0: datetime(2026, 1, d, h, m)
    q, s = "HKQuantityTypeIdentifier", "HKCategoryTypeIdentifierSleepAnalysis"
    rows = [
        ("1", f"{q}StepCount", "quantity", at(2, 9), at(2, 10), 1200.0, "count", None), ("2", f"{q}StepCount", "quantity", at(2, 11), at(2, 12), 34.5, "count", None), ("3", f"{q}RestingHeartRate", "quantity", at(2, 9), at(2, 9), 61.0, "count/min", None),
        ("4", s, "category", at(1, 23), at(2, 6), 3.0, None, None), ("5", s, "category", at(2, 1), at(2, 7), 1.0, None, None), ("6", "x", "deletion", at(2, 1), None, None, None, None), ("7", "a|b", "category", at(3, 1), None, None, None, None), ("8", "x", "quantity", None, None, 1.0, "m", None),
    ] + [(f"w{i:02}", "HKWorkoutTypeIdentifier", "workout", at(2, 13, i), at(2, 14, i), None, None, "Run|ning") for i in range(27)]
    lines = documents.note_lines(spark.createDataFrame(rows, SAMPLE), "UTC")
    note = _text(lines, "2026-01-02")
    head = 'date: 2026-01-02\nweekday: "Friday"\ntime_zone: "UTC"\nlossy: true\nsteps: 1234.5\nresting_heart_rate_count_per_min: 61\nsleep_hours: 8\nworkouts: 27\nworkout_minutes: 1620\nrecords: 32\nhealth_types: 4\n---\n\n# Friday, 2 January 2026\n'
    assert note.startswith("---\n" + head)
    assert "**1,234.50 steps**. Asleep for **8 h**. 27 workouts totalling **27 h**. Resting heart rate **61 bpm**." in note
    assert note.count("| Run\\|ning | 1 h |") == 25 and "2 further workouts are counted above" in note
    assert "Asleep for 8 h, from 2 segments." in note
    assert "| Step Count | 2 | 1,234.50 | 617.25 | 34.50 | 1,200 | count |" in note and "| Resting Heart Rate | 1 |  | 61 | 61 | 61 | count/min |" in note
    assert "1 record across 1 type." in _text(lines, "2026-01-03") and "| a\\|b | 1 |  |  |  |  |  |" in _text(lines, "2026-01-03")
    assert {r.doc for r in lines.select("doc").distinct().collect()} == {"2026-01-02", "2026-01-03"}
