"""Paged series: contiguity, completeness, segments, envelopes and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PAGE = 500


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of ``order`` (a replay overwrites): one aggregation with partial maxima."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def contiguity(pages: DataFrame, series: str = "sample_id") -> DataFrame:
    """(series, pages, points, first_offset, gaps, missing, reach): holes between pages in the order of their offsets.

    ``pages`` has the series, offset and count; ``missing`` are the points of the holes, ``reach`` is
    where the last page ends.
    """
    order = Window.partitionBy(series).orderBy("offset")
    expected = F.lag(F.col("offset") + F.greatest(F.col("count"), F.lit(1))).over(order)
    marked = pages.withColumn("_expected", expected)
    hole = F.col("_expected").isNotNull() & (F.col("offset") != F.col("_expected"))
    return marked.groupBy(series).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("count").alias("points"), F.min("offset").alias("first_offset"), F.sum(F.when(hole, 1).otherwise(0)).alias("gaps"),
        F.sum(F.when(hole, F.greatest(F.col("offset") - F.col("_expected"), F.lit(0))).otherwise(0)).alias("missing"), F.max(F.col("offset") + F.col("count")).alias("reach"),
    )


def header_completeness(headers: DataFrame, pages: DataFrame, series: str = "sample_id") -> DataFrame:
    """Each header (series, expected) with its pages: complete by count alone, and complete only if unbroken too.

    An unknown count is never complete.
    """
    found = headers.join(contiguity(pages, series), series, "left").na.fill(0, ["pages", "points", "gaps", "missing"])
    by_count = F.col("expected").isNotNull() & (F.col("expected") > 0) & (F.col("points") >= F.col("expected"))
    whole = by_count & (F.col("gaps") == 0) & (F.coalesce("first_offset", F.lit(0)) == 0)
    return found.select(series, "expected", "pages", "points", "gaps", F.coalesce(by_count, F.lit(False)).alias("complete_by_count"), F.coalesce(whole, F.lit(False)).alias("complete"))


def segments(pages: DataFrame, declared: DataFrame, series: str = "sample_id") -> DataFrame:
    """(series, segments, present, missing, complete): runs without a hole; declared (series, declared) may lack a series."""
    runs = contiguity(pages, series).join(declared, series, "left")
    lead = F.greatest(F.col("first_offset"), F.lit(0))
    tail = F.when(F.col("declared").isNull(), 0).otherwise(F.greatest(F.col("declared") - F.col("points") - F.col("missing") - lead, F.lit(0)))
    missing = (F.col("missing") + lead + tail).cast("long")
    complete = (missing == 0) & (F.col("gaps") == 0) & F.col("declared").isNotNull()
    return runs.select(series, (F.col("gaps") + 1).cast("long").alias("segments"), F.col("points").alias("present"), missing.alias("missing"), complete.alias("complete"))


def _lost(order: WindowSpec) -> Column:
    """What is lost before a page and in it: it doesn't begin where the decoded points of the page before it end, or holds less than it claims."""
    expected = F.coalesce(F.lag(F.col("offset") + F.col("decoded")).over(order), F.lit(0))
    return F.when(F.col("offset") != expected, 1).otherwise(0) + F.when(F.col("decoded") < F.col("count"), 1).otherwise(0)


def route_gaps(pages: DataFrame, declared: DataFrame, series: str = "sample_id") -> DataFrame:
    """(series, points, missing_pages): one per hole, per page that holds less than it claims, and per missing tail.

    ``pages``: series, offset, count (claimed), decoded; the next page is expected where the decoded points end.
    """
    lost = _lost(Window.partitionBy(series).orderBy("offset"))
    end = F.max_by(F.col("offset") + F.col("decoded"), "offset")
    sums = pages.withColumn("_lost", lost).groupBy(series).agg(F.sum("decoded").alias("points"), F.sum("_lost").alias("_lost"), end.alias("_end"))
    tail = F.when(F.col("_end") < F.col("declared"), 1).otherwise(0)
    return sums.join(declared, series, "left").select(series, "points", (F.col("_lost") + tail).cast("long").alias("missing_pages"))


_LOCATIONS = "array<struct<latitude: double, longitude: double, altitude: double, timestamp: string, speed: double>>"


#: Kinds of a route's records, in the order in which they are read: the route itself, its end, its pages.
_ROUTE_KINDS = ("workoutRoute", "workoutRouteEnd", "workoutRouteLocations")


def _route_rows(records: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """Of routed records those of routes: what (0 a route, 1 an end, 2 a page), route_id, workout_id, start_ts, offset, count, declared, decoded, points; only of ``kinds``.

    What links them lies in the records themselves; a location counts if it has a latitude and a longitude.  All
    are told in one pass: the outer generator is one that no filter is pushed below, where it would parse again.
    """
    t = lambda p: F.get_json_object("raw", p)
    what = F.array_position(F.array(*map(F.lit, _ROUTE_KINDS)), F.col("kind")).cast("int") - 1
    is_route, is_end, is_page = (F.col("what") == i for i in range(3))
    long = lambda p: t(p).try_cast("long")
    found = F.filter(F.from_json(t("$.locations"), _LOCATIONS), lambda x: x["latitude"].isNotNull() & x["longitude"].isNotNull())
    told = records.select(what.alias("what"), "id", "start_ts", "raw").select(
        "what", F.when(is_route, F.col("id")).when(is_end | is_page, t("$.sample")).alias("route_id"), F.when(is_route, t("$.workout.id")).alias("workout_id"), F.when(is_route, F.col("start_ts")).alias("start_ts"),
        F.when(is_page, F.coalesce(long("$.offset"), F.lit(0))).alias("offset"), F.when(is_page, F.coalesce(long("$.count"), F.lit(0))).alias("count"), F.when(is_page, F.coalesce(found, F.array())).alias("points"), F.when(is_end, long("$.locations")).alias("declared"),
    )
    linked = F.when(is_route, F.col("workout_id").isNotNull()).otherwise(F.col("route_id").isNotNull())
    row = F.struct("what", "route_id", "workout_id", "start_ts", "offset", "count", "declared", F.when(is_page, F.size("points").cast("long")).alias("decoded"), "points")
    return told.select(F.inline_outer(F.when(F.col("what").isin(*kinds) & linked, F.array(row)))).where("what is not null")


def workout_routes(records: DataFrame) -> DataFrame:
    """(workout_id, routes, points, missing_pages, complete): the routes of each workout that has points, with all that is missing.

    ``records``: id, kind, start_ts, raw.  Every route after the first is a gap like a missing page; a route
    without pages misses one if its end declares locations.  A workout's routes are in the order of their starts.
    A route meets its end and its pages, which it has after it, in one sorted pass.
    """
    order = Window.partitionBy("route_id").orderBy("what", "offset")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = _route_rows(records, (0, 1, 2)).withColumn("_lost", F.when(F.col("what") == 2, _lost(order)))
    ends = {"points": F.sum("decoded"), "lost": F.sum("_lost"), "declared": F.max("declared"), "end": F.max_by(F.col("offset") + F.col("decoded"), "offset")}
    routes = marked.withColumns({k: v.over(whole) for k, v in ends.items()}).where("what = 0")
    routes = routes.withColumn("ordinal", F.row_number().over(Window.partitionBy("workout_id").orderBy("start_ts", "route_id")) - 1)
    tail = F.when(F.col("end") < F.col("declared"), 1).otherwise(0)
    lost = F.coalesce(F.col("lost") + tail, F.when(F.col("declared") > 0, 1).otherwise(0)) + F.when(F.col("ordinal") > 0, 1).otherwise(0)
    sums = routes.groupBy("workout_id").agg(F.count(F.lit(1)).alias("routes"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.sum(lost).cast("long").alias("missing_pages"))
    return sums.where("points > 0").withColumn("complete", F.col("missing_pages") == 0)


def workout_route_points(records: DataFrame) -> DataFrame:
    """(workout_id, ordinal, position, latitude, longitude, altitude, timestamp, speed): the points of a workout's routes, one after the other.

    A workout's routes are in the order of their starts, each with its pages after it.  Where a page's points
    begin, and of which route they are, follows from the rows before it, one a page and one a route: points themselves
    are never sorted.  Pages learn of their route in a pass before; a route that is told twice counts twice.
    """
    met = Window.partitionBy("route_id").orderBy("what", "workout_id", "start_ts", "offset")
    numbered = _route_rows(records, (0, 2)).withColumn("_n", F.row_number().over(met))
    own = F.struct("workout_id", "start_ts", "_n")
    heads = F.collect_list(F.when(F.col("what") == 0, own)).over(met.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    linked = numbered.withColumn("_heads", heads).select("what", "route_id", "offset", "decoded", "points", F.explode(F.when(F.col("what") == 0, F.array(own)).otherwise(F.col("_heads"))).alias("_head"))
    rows = linked.select("what", "route_id", "offset", "decoded", "points", "_head.*")
    order = Window.partitionBy("workout_id").orderBy("start_ts", "route_id", "_n", "what", "offset")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"ordinal": F.sum(F.when(F.col("what") == 0, 1).otherwise(0)).over(before) - 1, "_from": F.coalesce(F.sum("decoded").over(before), F.lit(0))})
    points = placed.select("workout_id", F.col("ordinal").cast("int").alias("ordinal"), "_from", F.posexplode("points").alias("_at", "p"))
    return points.select("workout_id", "ordinal", (F.col("_from") + F.col("_at")).alias("position"), "p.*")


def explode_wave(series: DataFrame, id_col: str, array_col: str, hertz: float) -> DataFrame:
    rows = series.select(id_col, F.posexplode(array_col).alias("pos", "v"))
    return rows.select(id_col, "pos", (F.col("pos") / F.lit(float(hertz))).alias("seconds"), F.col("v").cast("double").alias("value"))


def envelope(points: DataFrame, id_col: str, buckets: int) -> DataFrame:
    """(id, bucket, seconds, low, high): at most ``buckets`` columns with edges at floor(i * n / buckets); short series pass through."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    sized = points.withColumn("_n", n)
    per = F.col("_n").cast("double") / F.lit(float(buckets))
    guess = F.floor(F.col("pos") / per).cast("int")
    # The bucket whose edges floor(i * per) and floor((i + 1) * per) hold the position.
    spot = F.when(F.floor((guess + 1) * per) <= F.col("pos"), guess + 1).when(F.floor(guess * per) > F.col("pos"), guess - 1).otherwise(guess)
    bucket = F.when(F.col("_n") > buckets, spot).otherwise(F.col("pos"))
    return sized.groupBy(id_col, bucket.cast("int").alias("bucket")).agg(F.min("seconds").alias("seconds"), F.min("value").alias("low"), F.max("value").alias("high"))


def stride_envelope(points: DataFrame, id_col: str, columns: int) -> DataFrame:
    """The other reducer: passes up to twice ``columns`` points through, else slices of a fixed stride."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    sized = points.withColumn("_n", n)
    stride = F.when(F.col("_n") > 2 * columns, F.greatest(F.floor(F.col("_n") / columns), F.lit(1))).otherwise(F.lit(1))
    return sized.groupBy(id_col, F.floor(F.col("pos") / stride).cast("int").alias("bucket")).agg(F.min("seconds").alias("seconds"), F.min("value").alias("low"), F.max("value").alias("high"))


def split_pages(elements: DataFrame, series: str, page: int = PAGE) -> DataFrame:
    """(series, sequence, offset, count) of elements (series, pos) cut into pages of a fixed size."""
    spot = F.floor(F.col("pos") / page).cast("long")
    return elements.groupBy(series, spot.alias("sequence")).agg(F.min("pos").cast("long").alias("offset"), F.count(F.lit(1)).alias("count"))


def held_against_declared(pages: DataFrame, ends: DataFrame, series: str = "sample_id") -> DataFrame:
    """(series, held, declared, state): readings that are there against those that the end marker declares."""
    held = pages.groupBy(series).agg(F.sum("count").alias("held"))
    state = F.when(F.col("declared").isNull(), "unknown").when(F.col("held") >= F.col("declared"), "complete").otherwise("incomplete")
    return held.join(ends, series, "left").select(series, "held", "declared", state.alias("state"))
