from __future__ import annotations

from datetime import datetime

import pytest

from pulsegrid.functions.calendar import bucket_plan
from pulsegrid.operators import pages
from pulsegrid.sources import formats


def _line(**parts):
    import json

    return json.dumps({"startDate": "2026-01-01T00:00:00Z", "type": "t", **parts})


def _page(route, offset, count, *lats, **more):
    return _line(id=f"{route}p{offset}", kind="workoutRouteLocations", sample=route, offset=offset, count=count, locations=[{"latitude": x, "longitude": 2.5, "altitude": 1} if x is not None else {"latitude": 1.0} for x in lats], **more)


@pytest.fixture(scope="module")
def records(spark):
    told = [
        _line(id="r1", kind="workoutRoute", workout={"id": "w"}), _line(id="r2", kind="workoutRoute", workout={"id": "w"}, startDate="2025-12-31T00:00:00Z"), _line(id="r3", kind="workoutRoute", workout={"id": "v"}),
        _line(id="r4", kind="workoutRoute", workout={"id": "none"}), _line(id="r5", kind="workoutRoute"),
        _page("r1", 0, 2, 10.0, 11.0), _page("r1", 4, 2, 12.0, None), _page("r2", 0, 1, 1.0), _page("r3", 0, 3, 5.0, 6.0, 7.0), _page("elsewhere", 0, 1, 9.0),
        _line(id="e1", kind="workoutRouteEnd", sample="r1", locations=9), _line(id="e2", kind="workoutRouteEnd", sample="r2", locations=1), _line(id="e4", kind="workoutRouteEnd", sample="r4", locations=3),
    ]
    return formats.route(spark.createDataFrame([(t,) for t in told], "value string"))


def test_routes_of_a_workout_and_what_is_missing(records):
    """A hole, a page that holds less than it claims, a missing tail and a second route: four; a workout without points isn't there."""
    rows = {r.workout_id: (r.routes, r.points, r.missing_pages, r.complete) for r in pages.workout_routes(records).collect()}
    assert rows == {"w": (2, 4, 4, False), "v": (1, 3, 0, True)}


def test_points_follow_one_another_over_routes(records):
    rows = sorted((r.workout_id, r.position, r.ordinal, r.latitude) for r in pages.workout_route_points(records).collect())
    assert rows == [("v", 0, 0, 5.0), ("v", 1, 0, 6.0), ("v", 2, 0, 7.0), ("w", 0, 0, 1.0), ("w", 1, 1, 10.0), ("w", 2, 1, 11.0), ("w", 3, 1, 12.0)]


def test_routes_told_twice_and_routes_without_names(spark):
    """A route of two records counts twice, of one workout or of two; one without an id counts and has no pages; a page without a route is nobody's."""
    told = [
        _line(id="r1", kind="workoutRoute", workout={"id": "w"}), _line(id="r1", kind="workoutRoute", workout={"id": "w"}), _line(id="r1", kind="workoutRoute", workout={"id": "v"}, startDate="2025-12-31T00:00:00Z"),
        _line(kind="workoutRoute", workout={"id": "w"}, startDate="2025-12-30T00:00:00Z"), _page("r1", 0, 2, 1.0, 2.0), _page("r1", 2, 1, 3.0), _line(id="p", kind="workoutRouteLocations", offset=0, count=1, locations=[{"latitude": 9.0, "longitude": 2.5}]),
        _line(id="e1", kind="workoutRouteEnd", sample="r1", locations=3), _line(id="e2", kind="workoutRouteEnd", sample="r1", locations=4), _line(id="x", kind="quantity", sample="r1", locations=9),
    ]
    records = formats.route(spark.createDataFrame([(t,) for t in told], "value string"))
    assert {r.workout_id: (r.routes, r.points, r.missing_pages, r.complete) for r in pages.workout_routes(records).collect()} == {"w": (3, 6, 4, False), "v": (1, 3, 1, False)}
    rows = sorted((r.workout_id, r.position, r.ordinal, r.latitude) for r in pages.workout_route_points(records).collect())
    assert rows == [("v", i, 0, i + 1.0) for i in range(3)] + [("w", i, 1 + i // 3, i % 3 + 1.0) for i in range(6)]


def test_hours_where_clocks_change(spark):
    plan = lambda a, b, tz: [(r.bucket_start, r.bucket_end) for r in bucket_plan(spark, a, b, "hour", tz=tz).orderBy("idx").collect()]
    spring = plan("2024-03-10 00:00:00", "2024-03-10 23:30:00", "America/New_York")
    autumn = plan("2024-11-03 00:00:00", "2024-11-03 23:30:00", "America/New_York")
    assert len(spring) == 23 and len(autumn) == 25 and spring[0][0] == datetime(2024, 3, 10, 5) and autumn[-1] == (datetime(2024, 11, 4, 4), datetime(2024, 11, 4, 5))
    assert all(a[1] == b[0] for a, b in zip(autumn, autumn[1:], strict=False))
    assert plan("2024-06-01 12:30:00", "2024-06-01 13:30:00", "Asia/Kolkata") == [(datetime(2024, 6, 1, 6, 30), datetime(2024, 6, 1, 7, 30)), (datetime(2024, 6, 1, 7, 30), datetime(2024, 6, 1, 8, 30))]
    howe = plan("2024-04-07 00:00:00", "2024-04-07 05:00:00", "Australia/Lord_Howe")  # goes back by half an hour at two
    assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(howe, howe[1:], strict=False)) and (howe[-1][1] - howe[0][0]).total_seconds() == 6.5 * 3600
    with pytest.raises(Exception, match="more than 10 buckets"):
        bucket_plan(spark, "2024-03-10 00:00:00", "2024-03-10 23:30:00", "hour", most=10, tz="America/New_York").collect()
    assert bucket_plan(spark, "2024-03-10 00:00:00", "2024-03-10 23:30:00", "hour").count() == 24
