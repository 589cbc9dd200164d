from __future__ import annotations

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import names, units
from pulsegrid.functions.calendar import age_years, parse_iso
from pulsegrid.plans.tools import Archive, parse_bound
from pulsegrid.sinks import formats as out
from pulsegrid.sources import formats
from pulsegrid.streaming import ingest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_iso_is_strict(spark):
    t = ["2026-02-06T14:30:00Z", "2026-02-06T14:30:00.125Z", "2026-02-06T14:30:00-08:00", "2026-02-06 14:30:00 -0800", "2026-02-06", "nope"]
    got = [r.x for r in lines(spark, *t).select(parse_iso(F.col("value")).alias("x")).collect()]
    assert got[:3] == [datetime(2026, 2, 6, 14, 30), datetime(2026, 2, 6, 14, 30, 0, 125_000), datetime(2026, 2, 6, 22, 30)] and got[3:] == [None] * 3


def test_units(spark):
    for value, a, b, want in ((42.195, "km", "mi", 26.2187), (1, "in", "m", 0.0254), (1, "ft", "m", 0.3048), (0, "degC", "degF", 32), (38, "degC", "degF", 100.4), (20, "degC", "degF", 68)):
        assert abs(one(spark, units.convert(F.lit(float(value)), F.lit(a), F.lit(b))) - want) < 1e-3
    for value, a, b in ((1.0, "km", "kg"), (1.0, "count", "km"), (float("nan"), "km", "mi")):
        assert one(spark, units.convert(F.lit(value), F.lit(a), F.lit(b))) is None
    assert one(spark, units.preferred(F.lit("m"), F.lit("HKQuantityTypeIdentifierDistanceCycling"), "us")) == "mi"


def test_names_and_measures(spark):
    name = lambda t: one(spark, names.metric_name(F.lit(t)))
    assert [name("HKQuantityTypeIdentifier" + x) for x in ("HeartRate", "BodyMass", "VO2Max", "SixMinuteWalkTestDistance", "NewThing")] == ["heart_rate", "weight_body_mass", "vo2max", "six_minute_walking_test_distance", "new_thing"]
    assert one(spark, names.type_of_metric(F.lit("weight_body_mass"))) == "HKQuantityTypeIdentifierBodyMass"
    assert one(spark, names.type_of_metric(F.lit("heart_rate"))) == "HKQuantityTypeIdentifierHeartRate"
    assert one(spark, names.type_of_metric(F.lit("new_thing"))) is None
    kind = lambda t: one(spark, names.measure_kind(F.lit(t)))
    assert [kind(t) for t in ("HKQuantityTypeIdentifierStepCount", "HKQuantityTypeIdentifierDietaryZinc", "HKQuantityTypeIdentifierHeartRate", "HKCategoryTypeIdentifierSleepAnalysis", "HKCategoryTypeIdentifierX", "HKWorkoutTypeIdentifier", "HKStateOfMind", "Other")] == ["total", "total", "average", "duration", "occurrences", "total", "average", "occurrences"]
    assert one(spark, names.counted_values(F.lit("HKCategoryTypeIdentifierSleepAnalysis"))) == [1, 3, 4, 5]
    assert one(spark, names.display_name(F.lit("HKQuantityTypeIdentifierRestingHeartRate"))) == "Resting Heart Rate"


def test_age(spark):
    assert one(spark, age_years(F.lit("2000-02-29").cast("date"), F.lit("2026-02-28"))) == 25
    assert one(spark, age_years(F.lit("2000-02-28").cast("date"), F.lit("2026-02-28"))) == 26


def test_router_keeps_every_line(spark):
    rows = formats.route(lines(spark, '{"id":"a","type":"t","startDate":"2026-01-01T00:00:00Z","quantity":{"value":2,"unit":"m","count":3}}', '{"kind":"deletion","id":"a","type":"t"}', '{"id":"v","type":"m","startDate":"2026-01-01T00:00:00Z","valence":-0.5}', '{"id":"w","kind":"workout","type":"t","startDate":"2026-01-01T00:00:00Z","duration":60}', "broken", '{"kind":"audiogram","id":"x","startDate":"2026-01-01T00:00:00Z"}', '{"id":"n"}')).collect()
    assert [r.route for r in rows] == ["sample", "deletion", "sample", "sample", "quarantine", "audiogram", "quarantine"]
    assert [(r.value, r.unit) for r in rows[:4]] == [(2.0, "m"), (None, None), (-0.5, "valence"), (60.0, "sec")] and rows[0].reading_count == 3


def test_router_loses_no_malformed_record(spark):
    """Own kinds without what their table needs are samples if they can be, else quarantined; the end of a recording carries nothing."""
    told = [
        '{"kind":"deletion","type":"t"}', '{"kind":"medicationDose","startDate":"2026-01-01T00:00:00Z"}', '{"kind":"medicationDose","logStatus":{"name":"taken"}}', '{"kind":"typeCoverage","observedAt":"2026-01-01T00:00:00Z"}',
        '{"kind":"quantitySeriesReadings","id":"p","type":"t","startDate":"2026-01-01T00:00:00Z","sequence":0,"offset":0,"readings":[]}', '{"kind":"quantitySeriesEnd","sample":"s","type":"t","startDate":"2026-01-01T00:00:00Z"}',
        '{"kind":"characteristics","characteristics":{}}', '{"kind":"electrocardiogram","id":"e","startDate":"2026-01-01T00:00:00Z"}', '{"kind":"electrocardiogramVoltages","id":"v","type":"t","startDate":"2026-01-01T00:00:00Z","sample":"e","sequence":0}', '{"kind":"electrocardiogramEnd"}', '{"kind":"deletion","type":"t","startDate":"2026-01-01T00:00:00Z"}',
    ]
    rows = {r.raw: r.route for r in formats.route(lines(spark, *told)).collect()}
    assert [rows[t] for t in told] == ["quarantine"] * 7 + ["electrocardiogram", "sample", "electrocardiogramEnd", "deletion"]


def test_end_markers_declare_by_the_name_of_their_elements(spark):
    told = ['{"kind":"quantitySeriesEnd","sample":"a","readings":7}', '{"kind":"workoutRouteEnd","sample":"b","locations":9}', '{"kind":"electrocardiogramEnd","sample":"c"}']
    assert {r.sample_id: r.declared for r in formats.series_ends(lines(spark, *told)).collect()} == {"a": 7, "b": 9, "c": None}


def test_payloads_of_every_format_become_lines(spark):
    """Line ends in CSV quotes stay, a probe takes nothing with it, and what can't be read stays whole."""
    header = "id,type,kind,startDate,endDate,value,unit,sourceName,deleted\n"
    told = [header + 'a,t,quantity,2026-01-01T00:00:00Z,,1.5,m,"two\nlines",false\nb,t,quantity,2026-01-01T00:00:00Z,,2,m,"open', '{"kind":"aConnectionTest"}\n{"id":"c"}', '{"id":"d","note":"aConnectionTest"}', "[1, 2", '{"data":{"metrics":[{"name":"s","data":[{"date":"2026-01-01T00:00:00Z","qty":5}]}]}}', "", header]
    rows = spark.createDataFrame([(t, f"f{i}", None, 0) for i, t in enumerate(told)], "value string, batch string, modified timestamp, block long")
    got = {}
    for r in ingest.lines_of_payloads(rows).orderBy("batch", "line").collect():
        got.setdefault(r.batch, []).append(r.value)
    assert set(got) == {"f0", "f1", "f2", "f3", "f4"}
    assert '"sourceName":"two\\nlines"' in got["f0"][0] and len(got["f0"]) == 2 and got["f1"] == ['{"id":"c"}'] and got["f2"] == [told[2]] and got["f3"] == ["[1, 2"]
    assert formats.route(spark.createDataFrame([(x,) for x in got["f4"]], "value string")).first().value == 5.0


def test_csv(spark):
    got = [r.f for r in lines(spark, 'a,"b, ""c""",,d\r', '"",x').select(formats.split_csv(F.col("value")).alias("f")).collect()]
    assert got == [["a", 'b, "c"', "", "d"], ["", "x"]]
    rows = formats.parse_csv(lines(spark, "id,type,kind,startDate,endDate,value,unit,sourceName,deleted", 'a,t,quantity,2026-01-01T00:00:00Z,,1.5,m,"x, y",false', "too,few")).collect()
    assert [r.readable for r in rows] == [True, False] and rows[0].source_name == "x, y" and rows[0].end_ts == datetime(2026, 1, 1)


def test_metrics_envelope(spark):
    body = '{"data":{"metrics":[{"name":"steps","units":"count","data":[{"date":"2026-01-01T00:00:00Z","qty":5},{"date":"bad","qty":6}]}],"workouts":[{"id":"w","start":"2026-01-01T00:00:00Z"}],"deletions":[{"name":"steps","date":"2026-01-02T00:00:00Z"},{"name":"steps","date":""}]}}'
    rows = {r.id: r for r in formats.flatten_metrics(lines(spark, body)).collect()}
    assert set(rows) == {"steps:2026-01-01T00:00:00Z", "w"} and rows["w"].value is None and rows["w"].kind == "workout"
    assert formats.metrics_tombstones(lines(spark, body)).count() == 1


def test_side_tables(spark):
    a = '{"kind":"audiogram","id":"a","sensitivityPoints":[{"frequency":{"value":1000},"ears":[{"ear":"left","sensitivity":{"unit":"dBHL","value":15}},{"ear":"right","sensitivity":{"unit":"dBHL","value":90},"clampingRange":{"lowerBound":{"value":90}}}]}]}'
    assert [(r.ear, r.sensitivity, r.clamped) for r in formats.audiograms(lines(spark, a)).orderBy("ear").collect()] == [("left", 15.0, False), ("right", 90.0, True)]
    d = '{"kind":"medicationDose","id":"d","startDate":"2026-01-01T00:00:00Z","medication":{"nickname":"pill"}}'
    assert formats.doses(lines(spark, d)).first()[2:] == ("unrecorded", "pill")
    m = '{"kind":"stateOfMind","id":"m","startDate":"2026-01-01T00:00:00Z","valence":0.4,"kindOfEntry":{"name":"dailyMood"},"labels":[{"name":"calm"},{"name":"glad"}]}'
    assert formats.moods(lines(spark, m)).first().labels == "calm, glad"
    w = '{"kind":"workout","id":"w","statistics":[{"type":"HR","average":152.4,"minimum":98,"maximum":178}],"activities":[{"id":"l1","statistics":[{"type":"HR","average":128}]}]}'
    rows = formats.workout_statistics(lines(spark, w)).orderBy("leg").collect()
    assert [(r.leg, r.average, r["sum"]) for r in rows] == [("", 152.4, None), ("l1", 128.0, None)]
    c = '{"kind":"typeCoverage","type":"t","state":"brandNew","deliveredCount":3,"observedAt":"2026-01-01T00:00:00Z"}'
    assert formats.coverage_lines(lines(spark, c)).first().state == "unknown"
    assert {(r.type, r.value) for r in formats.characteristics(lines(spark, '{"kind":"characteristics","characteristics":{"sex":"x","blood":"A"}}')).collect()} == {("sex", "x"), ("blood", "A")}


LINE = "id string, type string, kind string, startDate string, endDate string, value double, unit string, source string, device string, activity string, duration double"


def test_line_protocol(spark):
    hr, t = "HKQuantityTypeIdentifierHeartRate", "2026-08-22T19:50:46.500Z"
    rows = [("a", hr, "quantity", t, t, 62.5, "count/min", "Apple Watch", "Apple Watch", None, None), ("b", hr, "quantity", t, t, float("nan"), None, "x=y,z", None, None, None), ("c", hr, "workout", t, "2026-08-22T20:00:46.500Z", None, None, None, None, "Cross Training", None), ('d"', hr, "deletion", t, t, None, None, None, None, None, None), ("", hr, "quantity", t, t, None, None, None, None, None, None)]
    got = [r.line for r in out.line_protocol(spark.createDataFrame(rows, LINE)).collect()]
    assert got == [
        "health,type=heart_rate,source=Apple\\ Watch,device=Apple\\ Watch,unit=count/min value=62.5 1787428246500000000",
        'health_events,type=heart_rate,source=x\\=y\\,z id="b" 1787428246500000000',
        'health_workouts,type=workout,activity=Cross\\ Training duration=600.0,id="c" 1787428246500000000',
        'health_deletions,type=heart_rate,id=d" deleted=true 1787428246500000000',
    ]
    assert one(spark, names.line_nanos(F.lit("2026-01-01T00:00:00.123456789123Z"))) % 1_000_000_000 == 123_456_789
    assert [r.line for r in out.line_protocol(spark.createDataFrame(rows[:1], LINE), precision="ms").collect()][0].endswith(" 1787428246500")


def test_splits(spark):
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate(["aaaa", "bb", "cccccc", "d"])], "k string, pos int, text string")
    assert [r.part for r in out.split_by_count(rows, "k", "pos", 3).orderBy("pos").collect()] == [0, 0, 0, 1]
    assert [r.part for r in out.split_by_bytes(rows, "k", "pos", "text", 6).orderBy("pos").collect()] == [0, 0, 1, 2]


def test_round_trip(spark):
    s = spark.createDataFrame([("a", "t", "quantity", datetime(2026, 1, 1), datetime(2026, 1, 1, 1), 1.5, "m", 'x, "y"', 1), ("b", "t", "quantity", datetime(2026, 1, 2), datetime(2026, 1, 2), 2.0, "m", None, 4)], "id string, type string, kind string, start_ts timestamp_ntz, end_ts timestamp_ntz, value double, unit string, source_name string, reading_count long")
    keep = ["id", "type", "kind", "start_ts", "end_ts", "value", "unit", "source_name"]
    want = sorted(tuple(r) for r in s.select(keep).collect())
    assert sorted(tuple(r) for r in formats.route(out.ndjson(s)).select(keep).collect()) == want
    assert sorted(tuple(r) for r in formats.parse_csv(out.csv_lines(s).select(F.col("line").alias("value"))).select(keep).collect()) == want
    arrays = out.json_array(out.ndjson(s).select(F.lit(1).alias("k"), F.monotonically_increasing_id().alias("pos"), "value"), "k", "pos")
    assert sorted(tuple(r) for r in formats.parse_array(arrays.select(F.col("payload").alias("value"))).select(keep).collect()) == want


def test_zip(spark, tmp_path):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("a.ndjson", "1\n2\n")
        z.writestr("b.ndjson", "3\n")
    (tmp_path / "x.zip").write_bytes(body.getvalue())
    assert sorted(tuple(r) for r in formats.zipped_lines(spark, str(tmp_path)).collect()) == [("a.ndjson", "1"), ("a.ndjson", "2"), ("b.ndjson", "3")]


def test_stream_folds_and_replays(spark, tmp_path):
    line = lambda i, v: f'{{"id":"{i}","type":"t","startDate":"2026-01-01T00:00:00Z","value":{v}}}'
    (tmp_path / "in").mkdir()
    run = lambda: ingest.start_upsert(ingest.line_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in/1.ndjson").write_text("\n".join([line("a", 1), line("b", 2), "junk"]))
    run()
    (tmp_path / "in/2.ndjson").write_text("\n".join(['{"kind":"deletion","id":"b","type":"t"}', line("a", 5)]))
    run()
    run()
    assert [(r.id, r.value) for r in ingest.state(spark, str(tmp_path / "log")).collect()] == [("a", 5.0)]


def test_bounds_of_questions():
    assert parse_bound("2026-06-15", "America/New_York", False) == "2026-06-15 04:00:00.000000"
    assert parse_bound("2026-06-15", "America/New_York", True) == "2026-06-16 03:59:59.999000"
    assert parse_bound("2026-06-15T12:00:00Z", "America/New_York", False) == "2026-06-15 12:00:00.000000"
    assert parse_bound("2026-06-15T12:00:00", "America/New_York", False) == "2026-06-15 16:00:00.000000"
    assert parse_bound(None, "UTC", True) is None
    with pytest.raises(ValueError, match="from"):
        parse_bound("last week", "UTC", False, "from")


def test_tools(spark):
    from pulsegrid.sources import adapters

    small = "/root/testdata/sf0.001"
    coverage = spark.createDataFrame([("click", "anchorClosed"), ("view", "draining")], "type string, state string")
    a = Archive(adapters.sample(spark, small), adapters.measures(spark), coverage, now="2024-02-01 00:00:00")
    assert {r.type: r.standing for r in a.list_health_types().collect()}["purchase"] == "untold"
    assert a.summarise_health_data().first().types == 5
    assert a.aggregate_health_data("click", "week").count() > 0
    assert a.list_health_samples("click", limit=7).count() == 7
    assert a.analyse_health_trend("click", 30).first().status in {"ok", "weak_fit", "not_detectable"}
    assert a.compare_health_types("click", "view", 60).first().status in {"ok", "not_detectable"}
    assert a.anomaly_report("click", 30).count() == 1 and a.find_health_anomalies("click", 30).count() >= 0
    assert a.explain_empty_series("nothing").first().reason == "no_such_type"
    with pytest.raises(ValueError):
        a.aggregate_health_data("click", "fortnight")
    with pytest.raises(ValueError):
        a.list_health_samples(first="2026-02-02", last="2026-01-01")
    with pytest.raises(ValueError):
        a.analyse_health_trend("click", 0)


def test_notes_and_tracks(spark):
    from datetime import date

    daily = spark.createDataFrame([(date(2026, 1, 1), "steps", "count", 3, 700.0)], "local_day date, type string, unit string, n long, sum double")
    assert "- steps: 700 count (3)" in out.day_notes(daily).first().note
    pts = spark.createDataFrame([("r", 0, 0, 1.0, 2.0), ("r", 1, 4, 3.0, 4.0), ("r", 1, 5, 95.0, 4.0)], "k string, segment int, pos int, lat double, lon double")
    gpx = out.gpx_track(pts, "k").first().gpx
    assert gpx.count("<trkseg>") == 2 and gpx.count("<trkpt") == 2


def test_ingest_state_goes_by_id_and_type_in_order_of_arrival(spark, tmp_path):
    """One file: an id in two types stays twice, of an id sent twice the last line counts, whatever its value and date."""
    from pulsegrid.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    record = lambda i, t, v, d: f'{{"id":"{i}","type":"{t}","kind":"quantity","startDate":"2026-01-0{d}T00:00:00Z","value":{v}}}'
    (folder / "a.ndjson").write_text("\n".join([record("a", "T1", 1, 1), record("a", "T2", 2, 1), record("b", "T1", 9, 5), record("b", "T1", 3, 1), record("c", "T1", 4, 1), "broken"]))
    take = lambda: ingest.start_upsert(ingest.line_stream(spark, str(folder)), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    take()
    held = lambda: sorted((r.id, r.type, r.value) for r in ingest.state(spark, str(tmp_path / "log")).collect())
    assert held() == [("a", "T1", 1.0), ("a", "T2", 2.0), ("b", "T1", 3.0), ("c", "T1", 4.0)]
    (folder / "b.ndjson").write_text('{"id":"a","type":"T1","kind":"deletion"}\n{"type":"T1","kind":"deletion","startDate":"2026-01-01T00:00:00Z"}\n' + record("d", "T1", 5, 1))
    take()
    assert held() == []
    assert ingest.quarantined(spark, str(tmp_path / "log")).count() == 1


def test_quarantine_does_not_mind_the_order_of_keys(spark):
    from pulsegrid.operators import state

    lines = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"b":2,"a":1}',), ("not json",), ("not json",)], "value string")
    assert sorted(r.seen for r in state.quarantine(lines, "value", 7).collect()) == [2, 2]


def test_an_unreadable_array_is_counted(spark):
    from pulsegrid.sources import formats

    rows = formats.parse_array(spark.createDataFrame([('[{"id":"1","type":"t","startDate":"2026-01-01T00:00:00Z"}]',), ("[1, 2",)], "value string")).collect()
    assert sorted(r.route for r in rows) == ["sample", "unreadable"]
