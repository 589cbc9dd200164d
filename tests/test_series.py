"""Hand-worked expectations of buckets, series and histograms."""

from __future__ import annotations

from datetime import datetime

import pytest

from pulsegrid.functions.calendar import bucket_plan
from pulsegrid.operators import series

EAST = "America/New_York"


def at(text):
    return datetime.fromisoformat(text)


def rows(spark, data, type_="steps", unit="count"):
    """(start, value[, readings[, end]]) as samples."""
    full = [(str(i), type_, "quantity", at(d[0]), at(d[3]) if len(d) > 3 else at(d[0]), d[1], unit, "s", d[2] if len(d) > 2 else 1) for i, d in enumerate(data)]
    return spark.createDataFrame(full, "id string, type string, kind string, start_ts timestamp_ntz, end_ts timestamp_ntz, value double, unit string, source_name string, reading_count long")


def measure(spark, kind, type_="steps", counted=()):
    return spark.createDataFrame([(type_, kind, list(counted))], "type string, kind string, counted array<bigint>")


def buckets(df):
    return [(r.bucket_start.isoformat(" "), r.value, r["count"]) for r in df.orderBy("bucket_start").collect()]


def test_an_evening_is_one_local_day(spark):
    data = [("2026-06-15 23:00", 100.0), ("2026-06-16 00:30", 200.0), ("2026-06-16 03:00", 400.0)]
    total = measure(spark, "total")
    assert buckets(series.aggregate(rows(spark, data), total, "day", EAST)) == [("2026-06-15 00:00:00", 700.0, 3)]
    assert [b[1] for b in buckets(series.aggregate(rows(spark, data), total))] == [100.0, 600.0]


def test_after_midnight(spark):
    out = buckets(series.aggregate(rows(spark, [("2026-06-15 04:30", 11.0), ("2026-06-15 03:30", 22.0)]), measure(spark, "total"), "day", EAST))
    assert [(b[0][:10], b[1]) for b in out] == [("2026-06-14", 22.0), ("2026-06-15", 11.0)]


def test_spring_forward_and_fall_back(spark):
    spring = rows(spark, [("2026-03-08 05:30", 5.0), ("2026-03-08 12:00", 7.0), ("2026-03-09 03:30", 9.0)])
    assert buckets(series.aggregate(spring, measure(spark, "total"), "day", EAST)) == [("2026-03-08 00:00:00", 21.0, 3)]
    autumn = rows(spark, [("2026-11-01 05:30", 3.0), ("2026-11-01 06:30", 4.0), ("2026-11-02 03:00", 5.0)])
    assert buckets(series.aggregate(autumn, measure(spark, "total"), "day", EAST)) == [("2026-11-01 00:00:00", 12.0, 3)]
    assert len(buckets(series.aggregate(autumn, measure(spark, "total"), "hour", EAST))) == 3


def test_month_and_half_hour_zone(spark):
    out = buckets(series.aggregate(rows(spark, [("2026-06-01 03:30", 10.0), ("2026-06-01 16:00", 20.0)]), measure(spark, "total"), "month", EAST))
    assert [(b[0][:7], b[1]) for b in out] == [("2026-05", 10.0), ("2026-06", 20.0)]
    half = buckets(series.aggregate(rows(spark, [("2026-06-01 03:10", 1.0), ("2026-06-01 03:40", 2.0)]), measure(spark, "total"), "hour", "Asia/Kolkata"))
    assert [b[0] for b in half] == ["2026-06-01 02:30:00", "2026-06-01 03:30:00"]


def test_santiago_midnight_gap_and_sunday_weeks(spark):
    data = [("2026-09-06 03:59", 1.0), ("2026-09-06 04:00", 2.0), ("2026-09-13 02:00", 4.0)]
    out = buckets(series.aggregate(rows(spark, data), measure(spark, "total"), "week", "America/Santiago"))
    assert [(b[0][:10], b[1]) for b in out] == [("2026-08-30", 1.0), ("2026-09-06", 6.0)]


def test_every_sample_in_one_bucket(spark):
    data = [(f"2026-{m:02}-{d:02} {h:02}:17", 1.0) for m in (3, 7, 11) for d in (1, 8, 15) for h in (0, 4, 5, 23)]
    for grain in ("hour", "day", "week", "month", "year"):
        assert sum(b[2] for b in buckets(series.aggregate(rows(spark, data), measure(spark, "total"), grain, EAST))) == len(data)


def head(spark, data, kind, **more):
    s = rows(spark, data, **more)
    plan = bucket_plan(spark, "2026-01-01", "2026-01-05", "day")
    return series.headline(series.series(s, measure(spark, kind), plan), series.unit_guard(s)).first()


def test_weighted_mean_and_cumulative(spark):
    mean = head(spark, [("2026-01-02 01:00", 100.0, 1), ("2026-01-02 02:00", 50.0, 99)], "average")
    assert (mean.headline, mean.samples, mean.readings) == (50.5, 2, 100)
    assert head(spark, [("2026-01-02 01:00", 1000.0, 132)], "total").headline == 1000.0


def test_zero_is_not_empty(spark):
    s = rows(spark, [("2026-01-02 01:00", 0.0)])
    cols = series.series(s, measure(spark, "total"), bucket_plan(spark, "2026-01-01", "2026-01-03", "day"))
    from pyspark.sql import functions as F

    out = {r.idx: (r.v, r.minimum, r.samples) for r in cols.withColumn("v", series.column_value(F.lit(False))).collect()}
    assert out == {0: (None, None, 0), 1: (0.0, 0.0, 1), 2: (None, None, 0)}


def test_mixed_units_have_no_headline(spark):
    s = rows(spark, [("2026-01-02 01:00", 1.0)], unit="g").unionByName(rows(spark, [("2026-01-02 01:00", 1.0)], unit="kg"))
    cols = series.series(s, measure(spark, "total"), bucket_plan(spark, "2026-01-01", "2026-01-03", "day"))
    assert series.headline(cols, series.unit_guard(s)).first().headline is None


def test_histograms(spark):
    total = series.histogram(rows(spark, [("2026-01-02 01:00", 1000.0, 132), ("2026-01-02 02:00", 2000.0)]), measure(spark, "total")).orderBy("idx").collect()
    assert len(total) == 24 and sum(r.n for r in total) == 2
    mean = series.histogram(rows(spark, [("2026-01-02 01:00", 50.0, 60), ("2026-01-02 02:00", 80.0)]), measure(spark, "average")).orderBy("idx").collect()
    assert (mean[0].n, mean[-1].n, sum(r.n for r in mean)) == (60, 1, 61)
    flat = series.histogram(rows(spark, [("2026-01-02 01:00", 5.0, 3)]), measure(spark, "average")).collect()
    assert [(r.lower, r.upper, r.n) for r in flat] == [(5.0, 5.0, 3)]
    assert series.histogram(rows(spark, [("2026-01-02 01:00", 5.0)]), measure(spark, "duration")).count() == 0


SLEEP = "sleep"


def night(spark, data, first=None, last=None):
    s = rows(spark, [(a, v, 1, b) for a, b, v in data], SLEEP, None)
    out = series.aggregate(s, measure(spark, "duration", SLEEP, [1, 3, 4, 5]), "day", "UTC", first, last)
    return {r.bucket_start.date().isoformat(): r.value / 3600 for r in out.collect()}


def test_sleep_is_time_covered(spark):
    assert night(spark, [("2026-03-01 23:00", "2026-03-02 07:00", 3.0), ("2026-03-01 23:30", "2026-03-02 06:30", 3.0)]) == {"2026-03-02": 8.0}
    assert night(spark, [("2026-03-01 23:00", "2026-03-02 07:00", 3.0), ("2026-03-02 03:00", "2026-03-02 04:00", 2.0)]) == {"2026-03-02": 8.0}
    assert night(spark, [("2026-02-28 23:00", "2026-03-01 07:00", 3.0)], first="2026-03-01 00:00:00") == {"2026-03-01": 8.0}


def test_a_night_of_two_devices_is_one_night(spark):
    data = [("2026-03-01 23:00", 3.0, 1, "2026-03-02 07:00"), ("2026-03-01 23:30", 3.0, 1, "2026-03-02 06:30"), ("2026-03-02 23:00", 4.0, 1, "2026-03-03 01:00"), ("2026-03-03 00:30", 3.0, 1, "2026-03-03 03:00")]
    cols = series.series(rows(spark, data, SLEEP, None), measure(spark, "duration", SLEEP, [1, 3, 4, 5]), bucket_plan(spark, "2026-03-01", "2026-03-03", "day"))
    assert {r.bucket_start.day: r.seconds / 3600 for r in cols.collect()} == {1: 0.0, 2: 8.0, 3: 4.0}
    assert series.headline(cols, series.unit_guard(rows(spark, data, SLEEP))).first().headline == 12 * 3600


def test_a_stretch_that_begins_where_the_plan_ends_is_not_merged(spark):
    data = [("2026-03-01 20:00", 3.0, 1, "2026-03-01 22:00"), ("2026-03-01 23:00", 3.0, 1, "2026-03-02 00:00"), ("2026-03-02 00:00", 3.0, 1, "2026-03-02 01:00")]
    cols = series.series(rows(spark, data, SLEEP, None), measure(spark, "duration", SLEEP, [3]), bucket_plan(spark, "2026-03-01", "2026-03-01", "day"))
    assert [r.seconds for r in cols.collect()] == [10_800.0]


def test_bounds_and_plans_are_checked(spark):
    with pytest.raises(ValueError):
        series.aggregate(rows(spark, []), measure(spark, "total"), "decade")
    with pytest.raises(Exception, match="more than 10 buckets"):
        bucket_plan(spark, "2026-01-01", "2026-02-01", "day", most=10).collect()
