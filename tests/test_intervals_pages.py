from __future__ import annotations

import random
from datetime import datetime, timedelta

from pulsegrid.operators import intervals, pages

ZERO = datetime(2026, 3, 1)


def test_union_against_brute_force(spark):
    rnd = random.Random(3)
    data = [(t, s, s + rnd.randint(0, 400)) for t in ("a", "b") for s in (rnd.randint(0, 20_000) for _ in range(150))]
    df = spark.createDataFrame([(t, ZERO + timedelta(minutes=a), ZERO + timedelta(minutes=b)) for t, a, b in data], "type string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    want = []
    for t in ("a", "b"):
        merged = []
        for a, b in sorted((a, b) for k, a, b in data if k == t and b > a):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        want += [(t, ZERO + timedelta(minutes=a), ZERO + timedelta(minutes=b)) for a, b in merged]
    assert sorted((r.type, r.start_ts, r.end_ts) for r in intervals.union_islands(df).collect()) == sorted(want)


def test_union_over_many_days(spark):
    """Intervals of minutes to weeks, touching ends at the borders of slots and days, repeats, a null key: as a plain sweep merges them."""
    rnd = random.Random(11)
    data = [(t, s, s + rnd.choice([0, 15, 60, 700, 1440, 20_000])) for t in ("a", "b", None) for s in (rnd.randint(0, 90) * rnd.choice([15, 60, 1440, 97]) for _ in range(120))]
    data += [("c", 0, 15), ("c", 15, 30), ("c", 30, 1440), ("c", 1440, 2880), ("c", 2881, 2890), ("c", 0, 15), ("d", -3000, 100_000), ("d", 5, 6), ("d", 99_999, 100_001), ("e", 7, 7)]
    df = spark.createDataFrame([(t, ZERO + timedelta(minutes=a), ZERO + timedelta(minutes=b)) for t, a, b in data], "type string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    want = []
    for t in ("a", "b", "c", "d", "e", None):
        merged = []
        for a, b in sorted((a, b) for k, a, b in data if k == t and b > a):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2] + 1)
            else:
                merged.append((a, b, 1))
        want += [(str(t), ZERO + timedelta(minutes=a), ZERO + timedelta(minutes=b), n) for a, b, n in merged]
    got = intervals.union_islands(df)
    assert sorted((str(r.type), r.start_ts, r.end_ts, r.members) for r in got.collect()) == sorted(want)
    assert intervals.union_islands(df.limit(0)).count() == 0


def test_union_sorts_no_key_in_one_task(spark):
    """No window goes over intervals of a key alone: those by the key have a row a day."""
    df = spark.createDataFrame([("a", ZERO, ZERO + timedelta(minutes=1))], "type string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    plan = intervals.union_islands(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_d#" in line or "_day#" in line for line in plan.splitlines() if "Window [" in line)


def test_contained_includes_both_ends(spark):
    spans = spark.createDataFrame([(1, "w", ZERO, ZERO + timedelta(hours=2))], "k int, w string, span_start timestamp_ntz, span_end timestamp_ntz")
    points = spark.createDataFrame([(1, ZERO + timedelta(minutes=m)) for m in (-1, 0, 60, 120, 121)], "k int, at timestamp_ntz")
    assert intervals.contained(points, spans, "k").count() == 3


def page(spark, data):
    return spark.createDataFrame(data, "sample_id string, offset long, count long")


def test_waveform_completeness(spark):
    headers = spark.createDataFrame([("whole", 4), ("hole", 6), ("unknown", None)], "sample_id string, expected long")
    held = page(spark, [("whole", 2, 2), ("whole", 0, 2), ("hole", 0, 2), ("hole", 4, 2), ("unknown", 0, 2)])
    out = {r.sample_id: (r.points, r.complete) for r in pages.header_completeness(headers, held).collect()}
    assert out == {"whole": (4, True), "hole": (4, False), "unknown": (2, False)}


def test_count_alone_does_not_see_holes(spark):
    headers = spark.createDataFrame([("x", 4)], "sample_id string, expected long")
    r = pages.header_completeness(headers, page(spark, [("x", 0, 2), ("x", 4, 2)])).first()
    assert (r.complete_by_count, r.complete) == (True, False)


def test_routes(spark):
    claims = spark.createDataFrame([("short", 0, 2, 2), ("lies", 0, 4, 2), ("lies", 4, 2, 2)], "sample_id string, offset long, count long, decoded long")
    declared = spark.createDataFrame([("short", 4), ("lies", 6)], "sample_id string, declared long")
    out = {r.sample_id: (r.points, r.missing_pages) for r in pages.route_gaps(claims, declared).collect()}
    assert out["short"] == (2, 1) and out["lies"][0] == 4 and out["lies"][1] > 0


def test_replay_overwrites(spark):
    df = spark.createDataFrame([("s", 1, 1, "old"), ("s", 1, 2, "new"), ("s", 2, 1, "x")], "sample_id string, sequence int, arrival int, points string")
    assert sorted(r.points for r in pages.latest(df, ["sample_id", "sequence"], ["arrival"]).collect()) == ["new", "x"]


def test_envelope_edges(spark):
    for n, b in ((10, 3), (64, 16), (7, 7), (5, 9), (100, 7)):
        pts = spark.createDataFrame([("s", i, float(i), float((i * 37) % 11)) for i in range(n)], "id string, pos int, seconds double, value double")
        want = {}
        for k in range(b):
            lo, hi = int(k * (n / b)), min(n, int((k + 1) * (n / b)))
            if n > b and lo < hi:
                want[k] = (float(lo), min(float((i * 37) % 11) for i in range(lo, hi)), max(float((i * 37) % 11) for i in range(lo, hi)))
        got = {r.bucket: (r.seconds, r.low, r.high) for r in pages.envelope(pts, "id", b).collect()}
        assert got == (want if n > b else {i: (float(i), float((i * 37) % 11), float((i * 37) % 11)) for i in range(n)}), (n, b)
