"""Documents as ordered rows: header, body and footer lines with their places, written by range and sort.

No document is ever one string.  A line is a row (doc, section, part, place, line); ``write_documents`` lays the
rows out by range and sorts them, so a document of any length is spread over tasks, and its part files follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import local_day, local_ts, seconds_between
from pulsegrid.functions.names import catalogue_name, plain_number, xml_text
from pulsegrid.functions.prose import counted, first_upper, grouped_number, length_text, listed, table_cell, trimmed_decimal, yaml_key, yaml_text
from pulsegrid.operators.export import ASLEEP, IN_BED, LISTED_WORKOUTS, listed_workouts
from pulsegrid.operators.series import union_by_bucket
from pulsegrid.schema import HIGHLIGHTS

ORDER = ["doc", "section", "part", "place"]
#: What a point of a track may say beyond the base format.
TRACK_EXTRAS = ["speed", "course", "horizontalAccuracy", "verticalAccuracy", "speedAccuracy", "courseAccuracy"]
_SLEEP = "HKCategoryTypeIdentifierSleepAnalysis"
_FIRST, _LAST = -(2**62), 2**62


def _row(doc: Column, section: int, line: Column, part: Column | None = None, place: Column | None = None) -> list[Column]:
    zero = F.lit(0).cast("long")
    return [doc.cast("string").alias("doc"), F.lit(section).alias("section"), (zero if part is None else part.cast("long")).alias("part"), (zero if place is None else place.cast("long")).alias("place"), line.alias("line")]


def write_documents(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """A folder ``doc=...`` for each document; its part files, in the order of their names, hold its lines in order."""
    args = ([] if partitions is None else [partitions]) + [F.col(c) for c in ORDER]
    ordered = lines.repartitionByRange(*args).sortWithinPartitions(*ORDER)
    ordered.select("doc", "line").write.partitionBy("doc").option("compression", "none").text(path)


def _sound(points: DataFrame) -> Column:
    inside = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return F.coalesce(inside & ~F.isnan("lat") & ~F.isnan("lon"), F.lit(False))


def track_lines(points: DataFrame, routes: DataFrame) -> DataFrame:
    """Lines of a GPX file for each route: points (route, segment, pos, lat, lon, and any of ele, time and ``TRACK_EXTRAS``), routes (route, title, description, started, activity).

    A point off the globe or without a number is left out (``track_summary`` counts it); a segment without points stays.
    A route without any point has a file with an empty track.  Unknown times and activities are left out.
    """
    indent = lambda n, c: F.concat(F.lit(" " * n), c)
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    maybe = lambda n, name, c: F.when(c.isNotNull() & (c != ""), indent(n, tag(name, c)))
    title, about = xml_text(F.col("title")), xml_text(F.col("description"))
    head = F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="pulsegrid" xmlns="http://www.topografix.com/GPX/1/1" xmlns:pg="urn:pulsegrid:track">\n  <metadata>'), indent(4, tag("name", title)), indent(4, tag("desc", about)),
        maybe(4, "time", F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("  </metadata>\n  <trk>"), indent(4, tag("name", title)), indent(4, tag("desc", about)), maybe(4, "type", xml_text(F.col("activity"))),
    )
    heads = routes.select(*_row(F.col("route"), 0, head))
    feet = routes.select(*_row(F.col("route"), 2, F.lit("  </trk>\n</gpx>")))
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), trimmed_decimal(c, 3))
    held = set(points.columns)
    extras = [maybe(12, f"pg:{k}", number(F.col(k))) for k in TRACK_EXTRAS if k in held]
    more = F.concat_ws("\n", *extras) if extras else F.lit("")
    inner = [maybe(8, "ele", number(F.col("ele")))] if "ele" in held else []
    inner += [maybe(8, "time", xml_text(F.col("time")))] if "time" in held else []
    inner += [F.when(more != "", F.concat(F.lit("        <extensions>\n"), more, F.lit("\n        </extensions>")))]
    point = F.concat_ws("\n", F.concat(F.lit('      <trkpt lat="'), trimmed_decimal(F.col("lat"), 7), F.lit('" lon="'), trimmed_decimal(F.col("lon"), 7), F.lit('">')), *inner, F.lit("      </trkpt>"))
    body = points.where(_sound(points)).select(*_row(F.col("route"), 1, point, F.col("segment"), F.col("pos")))
    runs = points.select("route", "segment").distinct()
    ends = [runs.select(*_row(F.col("route"), 1, F.lit(text), F.col("segment"), F.lit(place))) for text, place in (("    <trkseg>", _FIRST), ("    </trkseg>", _LAST))]
    return heads.unionByName(ends[0]).unionByName(body).unionByName(ends[1]).unionByName(feet)


def track_summary(points: DataFrame, routes: DataFrame, found: DataFrame) -> DataFrame:
    """(route, points, dropped, missing, complete, note) for each of ``routes``; found (route, segments, present, missing, declared, gaps, lead, tail) is what its pages told.

    Without a page a route is no track; without a declared count its end is not vouched for.
    """
    sound = _sound(points)
    counts = points.groupBy("route").agg(F.sum(F.when(sound, 1).otherwise(0)).alias("points"), F.sum(F.when(sound, 0).otherwise(1)).alias("dropped"))
    rows = routes.select("route").join(counts, "route", "left").join(found, "route", "left").na.fill(0, ["points", "dropped", "segments", "present", "missing", "gaps", "lead", "tail"])
    missing, known = F.col("missing"), F.col("declared").isNotNull()
    at = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    reasons = F.concat_ws(", ", at("lead", " at the start"), F.when(F.col("gaps") > 0, F.concat(counted(F.col("gaps"), "gap", "gaps"), F.lit(" in the middle"))), at("tail", " at the end"))
    note = (
        F.when(F.col("segments") == 0, "No pages of this route are there.")
        .when(~known & (missing > 0), F.concat(counted(missing, "point is", "points are"), F.lit(" missing, and its end isn't known.")))
        .when(~known, "Its end isn't known.")
        .when(missing > 0, F.concat(F.lit("Missing "), missing.cast("string"), F.lit(" of "), counted(missing + F.col("present"), "point", "points"), F.lit(" ("), reasons, F.lit(").")))
    )
    complete = (missing == 0) & (F.col("gaps") == 0) & known & (F.col("segments") > 0)
    return rows.select("route", "points", "dropped", missing.cast("long").alias("missing"), complete.alias("complete"), note.alias("note"))


def day_totals(sample: DataFrame, tz: str) -> DataFrame:
    """(day, type, records, valued, sum, mean, low, high, unit) of each local day: sleep where it ends, all else where it starts; undated records have no day.

    Values are those of quantities; the unit is that of the first one by id.  Sums and means keep six decimals.
    """
    filed = F.when(F.col("type") == _SLEEP, F.coalesce("end_ts", "start_ts")).otherwise(F.col("start_ts"))
    value = F.when(F.col("kind") == "quantity", F.col("value"))
    rows = sample.where("kind <> 'deletion'").select(local_day(filed, tz).alias("day"), "type", "id", value.alias("value"), F.when(value.isNotNull(), F.col("unit")).alias("unit")).where("day is not null")
    return rows.groupBy("day", "type").agg(
        F.count(F.lit(1)).alias("records"), F.count("value").alias("valued"), F.round(F.sum("value"), 6).alias("sum"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("id"))).alias("unit"),
    )


def _day_heads(totals: DataFrame, sample: DataFrame, tz: str) -> DataFrame:
    """One row a day, from its totals, its workouts and the time asleep."""
    of = lambda t, how: F.max(F.when((F.col("type") == t) & (F.col("valued") > 0), F.struct(F.col("sum" if how == "total" else "mean").alias("v"), F.col("unit").alias("unit"))))
    days = totals.groupBy("day").agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("types"), F.sum(F.when(F.col("type") == _SLEEP, F.col("records")).otherwise(0)).alias("sleep_segments"), *(of(t, how).alias(f"h_{name}") for t, name, how in HIGHLIGHTS))
    took = F.coalesce(seconds_between(F.col("start_ts"), F.col("end_ts")), F.lit(0.0))
    workouts = sample.where("kind = 'workout'").groupBy(local_day(F.col("start_ts"), tz).alias("day")).agg(F.count(F.lit(1)).alias("workouts"), F.round(F.sum(took), 6).alias("workout_seconds"))
    stage = F.when(F.col("value").isin(*ASLEEP), "asleep").when(F.col("value").isin(*IN_BED), "in_bed")
    stretches = sample.where((F.col("type") == _SLEEP) & stage.isNotNull() & (F.col("end_ts") > F.col("start_ts"))).select(stage.alias("type"), "start_ts", "end_ts")
    slept = union_by_bucket(stretches, "day", tz).groupBy(F.to_date("bucket_start").alias("day")).agg(*(F.round(F.sum(F.when(F.col("type") == s, F.col("seconds"))), 6).alias(s) for s in ("asleep", "in_bed")))
    return days.join(workouts, "day", "left").join(slept, "day", "left").na.fill(0, ["workouts"]).na.fill(0.0, ["workout_seconds", "asleep", "in_bed"])


def note_lines(sample: DataFrame, tz: str) -> DataFrame:
    """Lines of a Markdown note for each local day of samples (id, type, kind, start_ts, end_ts, value, unit, activity).

    Front matter with the day's highlights, a headline, the first workouts, sleep as time covered, and a row for
    each type.  A type that is measured and not added up shows no total.
    """
    totals = day_totals(sample, tz)
    days = _day_heads(totals, sample, tz)
    c, day = F.col, F.col("day")
    pair = lambda key, text: F.concat(F.lit(f"{key}: "), text)
    shown = [F.when(c(f"h_{n}").isNotNull(), F.concat(yaml_key(F.lit(n), c(f"h_{n}.unit")), F.lit(": "), plain_number(c(f"h_{n}.v")))) for _, n, _h in HIGHLIGHTS]
    weekday = F.date_format(day, "EEEE")
    front = F.array_compact(F.array(
        F.lit("---"), pair("date", day.cast("string")), pair("weekday", yaml_text(weekday)), pair("time_zone", yaml_text(F.lit(tz))), F.lit("lossy: true"), *shown,
        F.when(c("asleep") > 0, pair("sleep_hours", plain_number(F.round(c("asleep") / 3600, 6)))), F.when(c("in_bed") > 0, pair("in_bed_hours", plain_number(F.round(c("in_bed") / 3600, 6)))),
        F.when(c("workouts") > 0, pair("workouts", c("workouts").cast("string"))), F.when(c("workouts") > 0, pair("workout_minutes", plain_number(F.round(c("workout_seconds") / 60, 6)))),
        pair("records", c("records").cast("string")), pair("health_types", c("types").cast("string")), F.lit("---"), F.lit(""),
    ))
    steps, walked, burnt, rest = (c(f"h_{n}") for n in ("steps", "distance", "active_energy", "resting_heart_rate"))
    km = F.when(walked["unit"] == "m", F.concat(F.lit("**"), plain_number(F.round(walked["v"] / 1000, 6)), F.lit(" km**"))).when(walked["unit"].isin("km", "mi", "ft", "yd"), F.concat(F.lit("**"), plain_number(walked["v"]), F.lit(" "), walked["unit"], F.lit("**")))
    opening = F.array_compact(F.array(F.when(steps.isNotNull(), F.concat(F.lit("**"), grouped_number(steps["v"]), F.lit(" steps**"))), km, F.when(burnt.isNotNull(), F.concat(F.lit("**"), grouped_number(burnt["v"]), F.lit(" kcal** of active energy")))))
    trained = F.concat(counted(c("workouts"), "workout", "workouts"), F.when(c("workout_seconds") > 0, F.concat(F.lit(" totalling **"), length_text(c("workout_seconds")), F.lit("**"))).otherwise(""), F.lit("."))
    told = F.concat_ws(
        " ", F.when(F.size(opening) > 0, F.concat(first_upper(listed(opening)), F.lit("."))), F.when(c("asleep") > 0, F.concat(F.lit("Asleep for **"), length_text(c("asleep")), F.lit("**."))), F.when(c("workouts") > 0, trained),
        F.when(rest.isNotNull(), F.concat(F.lit("Resting heart rate **"), grouped_number(rest["v"]), F.lit(" bpm**."))),
    )
    headline = F.when(told != "", told).otherwise(F.concat(counted(c("records"), "record", "records"), F.lit(" across "), counted(c("types"), "type", "types"), F.lit(".")))
    title = F.array(F.concat(F.lit("# "), weekday, F.date_format(day, ", d MMMM yyyy")), F.lit(""), headline, F.lit(""))
    head = days.select(day, F.posexplode(F.concat(front, title)).alias("pos", "line")).select(*_row(day, 0, c("line"), place=c("pos")))
    trains = days.where("workouts > 0")
    tables = trains.select(*_row(day, 1, F.lit("## Workouts\n\n| Started | Activity | Duration |\n| --- | --- | --- |")))
    rows = listed_workouts(sample.where("kind = 'workout'"), tz)
    rows = rows.select(*_row(day, 2, F.concat(F.lit("| "), c("started"), F.lit(" | "), table_cell(c("activity")), F.lit(" | "), length_text(F.coalesce("seconds", F.lit(0.0))), F.lit(" |")), place=c("place")))
    extra = c("workouts") - LISTED_WORKOUTS
    further = trains.select(*_row(day, 3, F.when(extra > 0, F.concat(F.lit("\n"), counted(extra, "further workout is", "further workouts are"), F.lit(" counted above but not listed.\n"))).otherwise("")))
    parts = F.array_compact(F.array(F.when(c("asleep") > 0, F.concat(F.lit("asleep for "), length_text(c("asleep")))), F.when(c("in_bed") > 0, F.concat(F.lit("in bed for "), length_text(c("in_bed"))))))
    covered = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(counted(c("sleep_segments"), "sleep record", "sleep records"))
    sleep = days.where("sleep_segments > 0").select(*_row(day, 4, F.concat(F.lit("## Sleep\n\n"), first_upper(covered), F.lit(", from "), counted(c("sleep_segments"), "segment", "segments"), F.lit(". Sleep is of the day it ended on.\n"))))
    begin = days.select(*_row(day, 5, F.lit("## Everything recorded\n\n| Type | Records | Total | Average | Low | High | Unit |\n| --- | --- | --- | --- | --- | --- | --- |")))
    name, measured = catalogue_name(c("type")), c("type").isin(*(t for t, _, how in HIGHLIGHTS if how == "mean"))
    figures = [F.when(measured, F.lit("")).otherwise(grouped_number(c("sum"))), grouped_number(c("mean")), grouped_number(c("low")), grouped_number(c("high"))]
    cells = [table_cell(name), grouped_number(c("records").cast("double")), *(F.when(c("valued") > 0, f).otherwise("") for f in figures), table_cell(c("unit"))]
    body = totals.select(day, "type", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"), name.alias("name"))
    # A day's types are few: their order is a rank within the day.
    from pyspark.sql import Window

    body = body.withColumn("pos", F.row_number().over(Window.partitionBy("day").orderBy("name", "type"))).select(*_row(day, 6, c("line"), place=c("pos")))
    foot = days.select(*_row(day, 7, F.concat(F.lit("\n---\n\n*A summary: totals of "), counted(c("records"), "record", "records"), F.lit(", not the records.*"))))
    for more in (tables, rows, further, sleep, begin, body, foot):
        head = head.unionByName(more)
    return head
