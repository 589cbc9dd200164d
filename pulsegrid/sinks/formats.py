"""Projections of samples to the delivery and export formats, as columns; writing is Spark's."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import iso_text, local_ts, seconds_between
from pulsegrid.functions.names import csv_field, line_key, line_measurement, line_nanos, line_string, metric_name, plain_number, sleep_stage
from pulsegrid.schema import COVERAGE_STATES, CSV_COLUMNS


def ndjson(sample: DataFrame) -> DataFrame:
    """(value): one JSON object per record, keys sorted, absent ones left out."""
    quantity = F.when(F.col("value").isNotNull(), F.struct(F.when(F.col("reading_count") > 1, F.col("reading_count")).alias("count"), F.col("unit").alias("unit"), F.col("value").alias("value")))
    source = F.when(F.col("source_name").isNotNull(), F.struct(F.col("source_name").alias("name")))
    return sample.select(F.to_json(F.struct(iso_text(F.col("end_ts")).alias("endDate"), F.col("id").cast("string").alias("id"), "kind", quantity.alias("quantity"), source.alias("source"), iso_text(F.col("start_ts")).alias("startDate"), "type")).alias("value"))


def json_array(lines: DataFrame, key: str, order: str, text: str = "value") -> DataFrame:
    """(key, payload): a JSON array per batch of bounded size, in order."""
    held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), ",\n ")
    return lines.groupBy(key).agg(F.concat(F.lit("[\n "), held, F.lit("\n]\n")).alias("payload"))


def coverage_report_lines(reports: DataFrame) -> DataFrame:
    """(value): a line of JSON, keys in order, per report (type, state, delivered, primed_from, primed_through, observed_at).

    Only a closed anchor is complete.  Absent counts and dates are left out, an unknown word is written as ``unknown``; a
    report without a type or a date of observation could not be read back and has no line.
    """
    state = F.when(F.col("state").isin(*COVERAGE_STATES), F.col("state")).otherwise("unknown")
    at = lambda name: iso_text(F.col(name))
    told = F.struct((state == "anchorClosed").alias("complete"), F.col("delivered").alias("deliveredCount"), F.lit("typeCoverage").alias("kind"), at("observed_at").alias("observedAt"), at("primed_from").alias("primedFrom"), at("primed_through").alias("primedThrough"), state.alias("state"), "type")
    return reports.where("type is not null and observed_at is not null").select(F.to_json(told).alias("value"))


def csv_lines(sample: DataFrame) -> DataFrame:
    """(id, line): the flat CSV without its header; integral numbers have no point."""
    deleted = F.when(F.col("kind") == "deletion", "true").otherwise("false")
    fields = [F.col("id").cast("string"), F.col("type"), F.coalesce("kind", F.lit("sample")), iso_text(F.col("start_ts")), iso_text(F.col("end_ts")), plain_number(F.col("value")), F.col("unit"), F.col("source_name"), deleted]
    return sample.select("id", F.concat_ws(",", *(csv_field(c) for c in fields)).alias("line"))


def csv_header() -> str:
    return ",".join(CSV_COLUMNS)


def _points(sample: DataFrame, order: str, point: Column, units: Column, batch: Column | None) -> DataFrame:
    keys = [metric_name(F.col("type")).alias("name")] + ([] if batch is None else [batch.alias("batch")])
    rows = sample.where("kind <> 'deletion' and kind <> 'workout'").select(*keys, F.struct(F.col(order).alias("pos"), point.alias("p"), units.alias("u")).alias("x"))
    return rows.groupBy(*(["name"] if batch is None else ["name", "batch"])).agg(F.sort_array(F.collect_list("x")).alias("xs"))


def metric_points(sample: DataFrame) -> DataFrame:
    """(name, pos, date, end_date, qty, units, source): the points of the metrics format, one row each, before they are grouped."""
    end = F.when(F.col("end_ts") != F.col("start_ts"), iso_text(F.col("end_ts")))
    rows = sample.where("kind <> 'deletion' and kind <> 'workout'")
    return rows.select(metric_name(F.col("type")).alias("name"), F.col("id").alias("pos"), iso_text(F.col("start_ts")).alias("date"), end.alias("end_date"), F.col("value").alias("qty"), F.coalesce("unit", F.lit("count")).alias("units"), F.col("source_name").alias("source"))


def metrics_json(sample: DataFrame, order: str = "id", batch: Column | None = None) -> DataFrame:
    """(name, points, metric): one JSON object per metric and ``batch``, points in their order, units of the first one.

    With a batch key (name, batch, points, metric); it bounds what one row holds.  Without one, all
    points of a metric are one row, so ``sample`` must itself be a delivery batch.
    """
    point = F.struct(iso_text(F.col("start_ts")).alias("date"), F.when(F.col("end_ts") != F.col("start_ts"), iso_text(F.col("end_ts"))).alias("endDate"), F.col("value").alias("qty"), F.col("source_name").alias("source"), F.coalesce("unit", F.lit("count")).alias("units"))
    grouped = _points(sample, order, point, F.coalesce("unit", F.lit("count")), batch)
    return grouped.select("name", *([] if batch is None else ["batch"]), F.size("xs").cast("long").alias("points"), F.to_json(F.struct(F.transform("xs", lambda x: x["p"]).alias("data"), "name", F.element_at("xs", 1)["u"].alias("units"))).alias("metric"))


def dialect_points(sample: DataFrame, tz: str) -> DataFrame:
    """(id, name, date, end_date, qty, low, high, stage, units) in the other dialect: local dates, hours of sleep, ranges of heart rates."""
    zone = lambda ts: F.concat(F.date_format(local_ts(ts, tz), "yyyy-MM-dd HH:mm:ss"), _offset(ts, tz))
    name = metric_name(F.col("type"))
    sleep, heart = name == "sleep_analysis", name == "heart_rate"
    units = F.when(sleep, "hr").when(F.coalesce("unit", F.lit("")) == "", "count").when(F.col("unit") == "count/min", "bpm").otherwise(F.col("unit"))
    hours = seconds_between(F.col("start_ts"), F.col("end_ts")) / 3600
    return sample.where("kind <> 'deletion' and kind <> 'workout'").select(
        "id", name.alias("name"), zone(F.col("start_ts")).alias("date"), F.when(sleep | (F.col("end_ts") != F.col("start_ts")), zone(F.col("end_ts"))).alias("end_date"),
        F.when(sleep, hours).otherwise(F.col("value")).alias("qty"), F.when(heart, F.col("value")).alias("low"), F.when(heart, F.col("value")).alias("high"), F.when(sleep, sleep_stage(F.col("value"))).alias("stage"), units.alias("units"),
    )


def _offset(ts: Column, tz: str) -> Column:
    """`` +hhmm`` of the zone at an instant."""
    minutes = F.round((F.unix_seconds(local_ts(ts, tz).cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))) / 60).cast("int")
    sign = F.when(minutes < 0, " -").otherwise(" +")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(sign, two(F.floor(F.abs(minutes) / 60)), two(F.abs(minutes) % 60))


#: Nanoseconds of each precision.
PRECISIONS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def line_protocol(records: DataFrame, measurement: str = "health", precision: str = "ns") -> DataFrame:
    """(id, line) of records (id, type, kind, startDate, endDate as text, value, unit, source, device, activity, duration).

    Deletions, workouts, records with a finite value and all others go to measurements of their own;
    empty tags are left out, a record that could have no field has no line.
    """
    kind, value = F.col("kind"), F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    named = F.coalesce(F.col("id").cast("string"), F.lit("")) != ""
    gone, workout = kind == "deletion", kind == "workout"
    # Which records have a field is told by their own columns: a filter on the written line is pushed below all steps, each of which it repeats for every mention.
    lasted = F.col("duration").isNotNull() | F.coalesce(line_nanos(F.col("endDate")) > line_nanos(F.col("startDate")), F.lit(False))
    lines = records.where(F.when(gone, named).when(workout, named | lasted).otherwise(finite | named))
    # A type's name is worked out once, not for each of its records.
    named_types = records.select(F.col("type").alias("_key")).distinct().withColumn("_metric", metric_name(F.col("_key")))
    records = lines.join(named_types, F.col("type").eqNullSafe(F.col("_key")), "left")
    tags = {"type": F.col("_metric"), "id": F.col("id").cast("string"), "source": F.col("source"), "device": F.col("device"), "unit": F.col("unit"), "activity": F.col("activity")}
    # All tags are written by one lambda: written out for each of them, the generated method is too long for the JVM to compile.
    written = F.transform(F.array(*(F.struct(F.lit(f",{k}=").alias("k"), F.coalesce(v, F.lit("")).alias("v")) for k, v in tags.items())), lambda t: F.when(t["v"] == "", "").otherwise(F.concat(t["k"], line_key(t["v"]))))
    # In steps, so that each is computed once.
    rows = records.withColumns({"_written": written, "_stamps": F.transform(F.array("startDate", "endDate"), line_nanos), "_finite": finite})
    stamp, end = F.col("_stamps")[0], F.col("_stamps")[1]
    rows = rows.withColumns({f"_{k}": F.col("_written")[i] for i, k in enumerate(tags)} | {"_stamp": stamp, "_span": F.when(end > stamp, (end - stamp) / 1e9)})
    field = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f"{key}="), c))
    rows = rows.withColumns({"_ident": F.transform(F.array(F.col("id").cast("string")), lambda x: field("id", F.when(x != "", line_string(x))))[0], "_length": field("duration", F.col("_span").cast("string"))})
    route = F.when(gone, "_deletions").when(workout, "_workouts").when(F.col("_finite"), "").otherwise("_events")
    shown = (
        F.when(gone, F.concat("_type", "_id"))
        .when(workout, F.concat(F.lit(",type=workout"), "_activity", "_source", "_device"))
        .otherwise(F.concat("_type", "_source", "_device", F.when(F.col("_finite"), F.col("_unit")).otherwise("")))
    )
    took = F.coalesce(field("duration", F.col("duration").cast("string")), F.col("_length"))
    fields = (
        F.when(gone, F.when(named, F.lit("deleted=true")))
        .when(workout, F.concat_ws(",", took, F.col("_ident")))
        .when(F.col("_finite"), F.concat_ws(",", field("value", value.cast("string")), F.col("_length")))
        .otherwise(F.when(named, F.concat_ws(",", "_ident", "_length")))
    )
    rows = rows.select("id", route.alias("_route"), shown.alias("_tags"), fields.alias("_fields"), F.floor(F.col("_stamp") / PRECISIONS[precision]).alias("_stamp") if precision != "ns" else F.col("_stamp"))
    time = F.coalesce(F.concat(F.lit(" "), F.col("_stamp").cast("string")), F.lit(""))
    of = F.coalesce(*(F.when(F.col("_route") == x, line_measurement(F.lit(f"{measurement}{x}"))) for x in ("", "_deletions", "_workouts", "_events")))  # four constants
    line = F.concat(of, F.col("_tags"), F.lit(" "), F.col("_fields"), time)
    return rows.select("id", line.alias("line"))


def latest_topics(sample: DataFrame, order: str = "start_ts") -> DataFrame:
    """(topic, value, at): the newest point of each metric."""
    rows = sample.where(F.col("value").isNotNull()).groupBy(metric_name(F.col("type")).alias("topic")).agg(F.max_by(F.struct("value", "start_ts"), F.struct(order, "id")).alias("x"))
    return rows.select("topic", F.col("x.value").alias("value"), F.col("x.start_ts").alias("at"))


def split_by_count(records: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """``records`` with part: n in each part of a batch ``key``, in order."""
    return records.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / n).cast("long"))


def split_by_bytes(records: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """``records`` with part: filled in order until the next would not fit; a larger record has a part of its own.

    Which part a record is in depends on all before it, so a batch is walked in order by one task,
    which holds an Arrow batch of it at a time; the sort before it spills.
    """
    from pyspark.sql import types as T

    at = [records.columns.index(c) for c in (key, text)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, held = (), 0, 0
        for batch in batches:
            parts = []
            for k, size in zip(batch.column(at[0]).to_pylist(), pc.fill_null(pc.binary_length(batch.column(at[1])), 0).to_pylist(), strict=True):
                if last != (k,):
                    last, part, held = (k,), 0, 0
                elif held and held + size > most:
                    part, held = part + 1, 0
                held += size
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64())], names=[*batch.schema.names, "part"])

    ordered = records.repartition(key).sortWithinPartitions(key, F.col(order).asc_nulls_last())
    return ordered.mapInArrow(walk, T.StructType([*records.schema.fields, T.StructField("part", T.LongType())]))


def day_notes(daily: DataFrame) -> DataFrame:
    """(local_day, note): one Markdown note per day from ``daily_view`` rows."""
    line = F.concat(F.lit("- "), "type", F.lit(": "), plain_number(F.round("sum", 2)), F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    rows = daily.groupBy("local_day").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.sum("n").alias("records"))
    front = F.concat(F.lit("---\ndate: "), F.col("local_day").cast("string"), F.lit("\nrecords: "), F.col("records").cast("string"), F.lit("\n---\n\n# "), F.date_format("local_day", "EEEE, d MMMM yyyy"), F.lit("\n\n"))
    return rows.select("local_day", F.concat(front, F.array_join("lines", "\n"), F.lit("\n")).alias("note"))


def gpx_track(points: DataFrame, key: str) -> DataFrame:
    """(key, gpx): one track per route (key, segment, pos, lat, lon), a segment per run; a route's points are bounded."""
    told = F.format_string('<trkpt lat="%.7f" lon="%.7f"/>', "lat", "lon")
    sound = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    runs = points.where(sound).groupBy(key, "segment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", told.alias("t")))), lambda x: x["t"]), "").alias("run"))
    tracks = runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("segment", "run"))).alias("runs"))
    return tracks.select(key, F.concat(F.lit('<gpx version="1.1"><trk>'), F.array_join(F.transform("runs", lambda r: F.concat(F.lit("<trkseg>"), r["run"], F.lit("</trkseg>"))), ""), F.lit("</trk></gpx>")).alias("gpx"))


def write_text(lines: DataFrame, path: str, by: str | None = None) -> None:
    writer = lines.write.partitionBy(by) if by else lines.write
    writer.text(path)

