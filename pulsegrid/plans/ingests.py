"""Queries: lines of every kind in, the stream's own tables, and what a second delivery changes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import iso_text
from pulsegrid.operators import state
from pulsegrid.plans.register import query
from pulsegrid.sinks import formats as out
from pulsegrid.sources import adapters, formats
from pulsegrid.sources.adapters import SAMPLE_SQL
from pulsegrid.sources.scratch import scratch
from pulsegrid.streaming import ingest, store

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_MS = "date_trunc('millisecond', {})::TIMESTAMP"


def _named(**parts: Column | str) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in parts.items()))).alias("value")


def _stream(spark: SparkSession, *deliveries: DataFrame, whole: bool = False) -> str:
    """The log after each of the deliveries (value, a file each where ``whole``) came and was taken."""
    home = scratch(spark, f"ingest-{uuid.uuid4().hex}")
    for lines in deliveries:
        writer = lines.select("value").write.mode("append").option("compression", "none")
        (writer.option("maxRecordsPerFile", 1) if whole else writer).text(f"{home}/raw")
        source = ingest.lines_of_payloads(ingest.payload_stream(spark, f"{home}/raw", names="*.txt")) if whole else ingest.line_stream(spark, f"{home}/raw", names="*.txt")
        ingest.start_upsert(source, f"{home}/log", f"{home}/checkpoint").awaitTermination()
    return f"{home}/log"


@query(f"""WITH {SAMPLE_SQL}, once AS (SELECT (id // 2)::VARCHAR AS id, type, max_by(value, sample.id) AS value FROM sample GROUP BY ALL), again AS (
  SELECT id, type, CASE WHEN id::BIGINT % 3 = 0 THEN value + 1 ELSE value END AS value FROM once)
SELECT id, type, value FROM again WHERE id::BIGINT % 7 <> 0 OR id::BIGINT % 3 = 0 AND id::BIGINT % 2 = 0""")
def streaming_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-01..03, DML-06, STR-03: an id in several types, sent again with other values, deleted in all types, and a few sent once more after that."""
    rows = adapters.sample(spark, sf_dir).withColumn("key", F.floor(F.col("id") / 2))
    rows = rows.groupBy("key", "type").agg(F.max_by("value", "id").alias("value"), F.max_by("start_ts", "id").alias("start_ts"))
    line = lambda value, kind="quantity": _named(id=F.col("key").cast("string"), type=F.col("type"), kind=kind, startDate=iso_text(F.col("start_ts")), value=value)
    again = rows.where("key % 3 = 0")
    gone = rows.where("key % 7 = 0").select(_named(id=F.col("key").cast("string"), type="any", kind="deletion"))
    later = again.where("key % 7 = 0 and key % 2 = 0").select(line(F.col("value") + 1))
    log = _stream(spark, rows.select(line(F.col("value"))), again.select(line(F.col("value") + 1)), gone, later)
    return ingest.state(spark, log).select("id", "type", "value")


@query(f"""WITH {SAMPLE_SQL}, once AS (SELECT (id // 2)::VARCHAR AS id, type, max_by(value, sample.id) AS value, max_by(start_ts, sample.id) AS start_ts FROM sample GROUP BY ALL)
SELECT id, type, CASE WHEN id::BIGINT % 3 = 0 THEN value + 1 ELSE value END AS value FROM once
WHERE (id::BIGINT % 7 <> 0 OR id::BIGINT % 3 = 0 AND id::BIGINT % 2 = 0) AND NOT EXISTS (SELECT 1 FROM once d WHERE d.type = once.type AND {_MS.format("d.start_ts")} = {_MS.format("once.start_ts")} AND d.id::BIGINT % 11 = 0)""")
def snapshot_between_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-03, STR-03: the log is compacted after each delivery and its epochs go; late tombstones, with an id and with a date, still delete."""
    rows = adapters.sample(spark, sf_dir).withColumn("key", F.floor(F.col("id") / 2))
    rows = rows.groupBy("key", "type").agg(F.max_by("value", "id").alias("value"), F.max_by("start_ts", "id").alias("start_ts"))
    line = lambda value, kind="quantity": _named(id=F.col("key").cast("string"), type=F.col("type"), kind=kind, startDate=iso_text(F.col("start_ts")), value=value)
    again = rows.where("key % 3 = 0")
    gone = rows.where("key % 7 = 0").select(_named(id=F.col("key").cast("string"), type="any", kind="deletion"))
    later = again.where("key % 7 = 0 and key % 2 = 0").select(line(F.col("value") + 1))
    dated = rows.where("key % 11 = 0").select(_named(type=F.col("type"), kind="deletion", startDate=iso_text(F.col("start_ts"))))
    home = scratch(spark, f"ingest-{uuid.uuid4().hex}")
    for n, lines in enumerate((rows.select(line(F.col("value"))), again.select(line(F.col("value") + 1)), gone, later, dated)):
        lines.write.mode("append").option("compression", "none").text(f"{home}/raw")
        ingest.start_upsert(ingest.line_stream(spark, f"{home}/raw", names="*.txt"), f"{home}/log", f"{home}/checkpoint").awaitTermination()
        if n < 4:  # the last delivery is read from its epoch
            store.compact(spark, f"{home}/log", f"{home}/base")
            store.expire(spark, f"{home}/log", f"{home}/base")
    return ingest.state(spark, f"{home}/log", f"{home}/base").select("id", "type", "value")


@query("""SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 5 <> 0""")
def ledger_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-06: the first batches come again under other names, after corrections and deletions, and change nothing."""
    e = adapters.table(spark, sf_dir, "events")
    line = lambda value: _named(id=F.col("event_id").cast("string"), type=F.col("event_type"), kind="quantity", startDate=iso_text(F.col("ts")), value=value)
    first = e.repartition(4, "event_id").select(line(F.col("value")))
    again = e.where("event_id % 3 = 0").select(line(F.col("value") + 1))
    gone = e.where("event_id % 5 = 0").select(_named(id=F.col("event_id").cast("string"), type="any", kind="deletion"))
    log = _stream(spark, first, again, gone, first)
    return ingest.state(spark, log).select("id", "value")


_BY_FORMAT = f"""WITH {SAMPLE_SQL}, p AS (SELECT *, CASE id % 4 WHEN 0 THEN 'ndjson' WHEN 1 THEN 'csv' WHEN 2 THEN 'array' ELSE 'metrics' END AS format FROM sample),
r AS (SELECT format, CASE WHEN format = 'metrics' THEN type || ':' || {_ISO.format("start_ts")} ELSE id::VARCHAR END AS id, type, {_MS.format("start_ts")} AS start_ts, value, source_name FROM p)
SELECT DISTINCT id, type, start_ts, value, source_name FROM r"""


@query(_BY_FORMAT)
def ingest_csv_and_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18: lines, CSV, arrays and metrics envelopes in one folder, a file of at most 500 ids each, become one table."""
    sample = adapters.sample(spark, sf_dir).withColumns({"batch": F.floor(F.col("id") / 500), "n": F.col("id") % 4})
    text = lambda rows, glue: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]), glue)
    line = _named(id=F.col("id").cast("string"), type=F.col("type"), kind=F.col("kind"), startDate=iso_text(F.col("start_ts")), endDate=iso_text(F.col("end_ts")), value=F.col("value"), sourceName=F.col("source_name"))
    lines = sample.where("n = 0").select("batch", "id", line).groupBy("batch").agg(text(None, "\n").alias("value"))
    array = sample.where("n = 2").select("batch", "id", line).groupBy("batch").agg(F.concat(F.lit("["), text(None, ","), F.lit("]")).alias("value"))
    csv = out.csv_lines(sample.where("n = 1")).withColumnRenamed("line", "value").groupBy(F.floor(F.col("id") / 500).alias("batch")).agg(F.concat(F.lit(out.csv_header() + "\n"), text(None, "\n")).alias("value"))
    point = F.struct(iso_text(F.col("start_ts")).alias("date"), iso_text(F.col("end_ts")).alias("endDate"), F.col("value").alias("qty"), F.col("source_name").alias("source"))
    metrics = sample.where("n = 3").groupBy("batch", "type").agg(F.collect_list(point).alias("data")).groupBy("batch").agg(F.collect_list(F.struct(F.col("type").alias("name"), F.lit("u").alias("units"), "data")).alias("metrics"))
    envelopes = metrics.select(F.to_json(F.struct(F.struct("metrics").alias("data"))).alias("value"))
    log = _stream(spark, lines.select("value").unionByName(array.select("value")).unionByName(csv.select("value")).unionByName(envelopes), whole=True)
    return ingest.state(spark, log).select("id", "type", "start_ts", "value", "source_name")


_SIDE = """WITH m AS (SELECT event_id, event_type, ts, value FROM events)
SELECT 'mood' AS side, event_id::VARCHAR AS id, date_trunc('millisecond', ts)::TIMESTAMP AS at, 'momentaryEmotion' AS word, (event_id % 201 - 100) / 100.0::DOUBLE AS number FROM m WHERE event_id % 3 = 0 AND event_id % 11 <> 0
UNION ALL SELECT 'dose', event_id::VARCHAR, date_trunc('millisecond', ts)::TIMESTAMP, CASE WHEN event_id % 2 = 0 THEN 'taken' ELSE 'unrecorded' END, NULL FROM m WHERE event_id % 3 = 1 AND event_id % 11 <> 0
UNION ALL SELECT 'recording', event_id::VARCHAR, date_trunc('millisecond', ts)::TIMESTAMP, 'sinusRhythm', 512.0::DOUBLE FROM m WHERE event_id % 3 = 2 AND event_id % 11 <> 0"""


@query(_SIDE)
def ingest_side_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-04, SRC-10, SRC-13, SRC-14: kinds with tables of their own, from the same stream; tombstones take them out too."""
    e = adapters.table(spark, sf_dir, "events")
    n, head = F.col("event_id"), {"id": F.col("event_id").cast("string"), "type": F.col("event_type"), "startDate": iso_text(F.col("ts"))}
    name = lambda x: F.struct((F.lit(x) if isinstance(x, str) else x).alias("name"))
    mood = e.where(n % 3 == 0).select(_named(**head, kind="stateOfMind", valence=(n % 201 - 100) / 100, kindOfEntry=name("momentaryEmotion")))
    dose = e.where(n % 3 == 1).select(_named(**head, kind="medicationDose", logStatus=name(F.when(n % 2 == 0, "taken")), medication=F.struct(F.lit("m").alias("displayText"))))
    ecg = e.where(n % 3 == 2).select(_named(**head, kind="electrocardiogram", classification=name("sinusRhythm"), samplingFrequency=F.struct(F.lit("Hz").alias("unit"), F.lit(512.0).alias("value"))))
    gone = e.where(n % 11 == 0).select(_named(id=n.cast("string"), type="any", kind="deletion"))
    log = _stream(spark, mood.unionByName(dose).unionByName(ecg), gone)
    none = F.lit(None).cast("double")
    moods = ingest.side_table(spark, log, "stateOfMind").select(F.lit("mood").alias("side"), "id", "at", F.col("kind").alias("word"), F.col("valence").alias("number"))
    doses = ingest.side_table(spark, log, "medicationDose").select(F.lit("dose").alias("side"), "id", "at", F.col("status").alias("word"), none.alias("number"))
    heads = ingest.side_table(spark, log, "electrocardiogram").select(F.lit("recording").alias("side"), "id", F.col("start_ts").alias("at"), F.col("classification").alias("word"), F.col("hertz").alias("number"))
    return moods.unionByName(doses).unionByName(heads)


_MALFORMED = """SELECT route, coalesce(kind, '-') AS kind, count(*)::BIGINT AS records FROM (SELECT * FROM (
  SELECT event_id % 20 AS n, event_id % 3 AS m FROM events) JOIN (VALUES
  (0, 'deletion', 'deletion', 'quarantine'), (1, 'medicationDose', 'medicationDose', 'quarantine'), (2, 'typeCoverage', 'typeCoverage', 'quarantine'),
  (3, 'characteristics', 'characteristics', 'quarantine'), (4, 'electrocardiogram', 'electrocardiogram', 'quarantine'), (5, 'electrocardiogramVoltages', 'electrocardiogramVoltages', 'sample'),
  (6, 'quantitySeriesReadings', 'quantitySeriesReadings', 'quarantine'), (7, 'quantitySeriesEnd', 'quantitySeriesEnd', 'quarantine'), (8, 'audiogram', 'audiogram', 'quarantine'),
  (9, 'electrocardiogramEnd', 'electrocardiogramEnd', 'electrocardiogramEnd'), (10, 'workoutRouteLocations', 'sample', 'sample'), (11, 'stateOfMind', 'sample', 'quarantine'),
  (12, 'workout', 'sample', 'quarantine'), (13, 'aNewKind', 'sample', 'quarantine'), (14, NULL, 'sample', 'quarantine'), (15, 'characteristic', 'characteristic', 'quarantine')
) AS t(n, kind, good, bad) USING (n)) , LATERAL (SELECT CASE WHEN m = 0 THEN bad ELSE good END AS route) GROUP BY ALL"""


@query(_MALFORMED)
def route_malformed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: a third of the records of every kind lack what their table needs; each is a sample where it can be one and quarantined where not."""
    e, n = adapters.table(spark, sf_dir, "events"), F.col("event_id") % 20
    bad, good = F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0
    at, text, point = iso_text(F.col("ts")), F.col("event_id").cast("string"), F.array(F.struct(F.col("value").alias("volts")))
    kinds = ["deletion", "medicationDose", "typeCoverage", "characteristics", "electrocardiogram", "electrocardiogramVoltages", "quantitySeriesReadings", "quantitySeriesEnd", "audiogram", "electrocardiogramEnd", "workoutRouteLocations", "stateOfMind", "workout", "aNewKind"]
    kind = F.when(n < 14, F.element_at(F.array(*map(F.lit, kinds)), (n + 1).cast("int"))).when(n == 15, "characteristic")
    having = lambda places, what, where=good: F.when(n.isin(places) & where, what)  # noqa: E731  to_json leaves nulls out
    whole = [1, 4, 8, 11, 12, 13, 14]
    lines = e.where(n < 16).select(_named(
        kind=kind, id=F.coalesce(having([0, *whole], text), having([5, 6, 7, 10], text, F.lit(True))), type=F.coalesce(having([2, 15, *whole], F.col("event_type")), having([5, 6, 7, 10], F.col("event_type"), F.lit(True))),
        startDate=F.coalesce(having(whole, at), having([5, 6, 7, 10], at, F.lit(True))), observedAt=having([2], at), characteristics=F.when(n == 3, F.create_map(F.lit("sex"), F.when(good, "x"))),
        sample=having([5, 6, 7], text), sequence=having([5, 6], F.lit(0)), offset=having([5, 6], F.lit(0)), voltages=having([5], point), readings=having([6], point),
    ))
    ends = F.when(F.get_json_object("value", "$.kind") == "quantitySeriesEnd", F.regexp_replace("value", "\\}$", ',"readings":3}')).otherwise(F.regexp_replace("value", '\\{"sex":null\\}|\\{"sex":"x"\\}', F.lit('{}')))
    told = lines.select(F.when(F.col("value").contains('"sex":"x"'), F.col("value")).otherwise(ends).alias("value"))
    return formats.route(told).groupBy("route", F.coalesce("kind", F.lit("-")).alias("kind")).agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT CASE WHEN user_id % 5 = 0 THEN 'unreadable' ELSE 'sample' END AS route, sum(CASE WHEN user_id % 5 = 0 THEN 1 ELSE n END)::BIGINT AS records
FROM (SELECT user_id, event_id // 1000 AS batch, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""")
def array_parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, SNK-02: arrays of bounded batches; a broken one counts as one unreadable record."""
    rows = adapters.table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 1000).alias("batch"), "event_id", _named(id=F.col("event_id").cast("string"), type=F.col("event_type"), startDate=iso_text(F.col("ts")), value=F.col("value")))
    arrays = out.json_array(rows.withColumn("key", F.concat_ws("/", F.col("user_id"), F.col("batch"))), "key", "event_id")
    broken = F.split_part("key", F.lit("/"), F.lit(1)).cast("long") % 5 == 0
    read = formats.parse_array(arrays.select(F.when(broken, F.concat(F.lit("["), "payload")).otherwise(F.col("payload")).alias("value")))
    return read.groupBy("route").agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT event_id::VARCHAR AS id, event_type AS type, value FROM events WHERE (event_id // 500) % 3 <> 1""")
def archives_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: archives of two parts, 500 ids each; of every three one has a line cut short or bytes that are no archive, and gives nothing."""
    e = adapters.table(spark, sf_dir, "events").withColumn("batch", F.floor(F.col("event_id") / 500))
    line = _named(id=F.col("event_id").cast("string"), type=F.col("event_type"), kind="quantity", startDate=iso_text(F.col("ts")), value=F.col("value"))
    part = lambda rest: F.array_join(F.transform(F.sort_array(F.filter(F.collect_list(F.struct("event_id", "value")), lambda x: x["event_id"] % 2 == rest)), lambda x: x["value"]), "\n")
    texts = e.select("batch", "event_id", line).groupBy("batch").agg(part(0).alias("a"), part(1).alias("b"))
    texts = texts.withColumn("b", F.when(F.col("batch") % 6 == 1, F.concat("b", F.lit('\n{"id":'))).otherwise(F.col("b"))).select(F.col("batch").cast("string").alias("archive"), "a", "b", (F.col("batch") % 6 == 4).alias("broken"))

    def pack(batches):  # noqa: ANN001, ANN202
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            made = []
            for a, b, broken in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                body = io.BytesIO()
                with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("head.ndjson", '{"kind":"manifest","parts":2}\n')
                    z.writestr("a.ndjson", a)
                    z.writestr("b.ndjson", b)
                made.append(body.getvalue()[:40] if broken else body.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["archive", "content"])

    _, records = formats.whole_archives(formats.unzipped(texts.mapInArrow(pack, "archive string, content binary")))
    return formats.route(records).where("route = 'sample'").select("id", "type", "value")


@query("""SELECT type, count(*)::BIGINT AS rows FROM (SELECT unnest(CASE WHEN c_custkey % 2 = 0 THEN ['segment', 'nation'] ELSE ['balance'] END) AS type FROM customer) GROUP BY 1""")
def characteristics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09: a map of several characteristics, or a single one."""
    c = adapters.table(spark, sf_dir, "customer")
    several = c.where("c_custkey % 2 = 0").select(_named(kind="characteristics", characteristics=F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))))
    single = c.where("c_custkey % 2 <> 0").select(_named(kind="characteristic", type="balance", value=F.col("c_acctbal")))
    return formats.characteristics(several.unionByName(single)).groupBy("type").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH held AS (SELECT l_orderkey AS s, count(*) AS pages FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS sample_id, CASE WHEN o_orderkey % 2 = 0 THEN 'electrocardiogramEnd' ELSE 'quantitySeriesEnd' END AS kind, (o_orderkey % 8)::BIGINT AS declared, coalesce(pages, 0)::BIGINT AS pages, coalesce(pages * 2, 0)::BIGINT AS decoded FROM orders LEFT JOIN held ON s = o_orderkey""")
def series_end_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SRC-11: pages and end markers of series, read from lines and joined."""
    key = F.col("l_orderkey").cast("string")
    two = lambda a, b: F.array(F.struct(F.col(a).alias("volts")), F.struct(F.col(b).alias("volts")))
    pages = adapters.table(spark, sf_dir, "lineitem").select(_named(kind="electrocardiogramVoltages", sample=key, sequence=F.col("l_linenumber"), offset=F.col("l_linenumber") * 2, count=F.lit(2), voltages=two("l_tax", "l_discount")))
    o = adapters.table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "electrocardiogramEnd").otherwise("quantitySeriesEnd")
    declared = F.col("o_orderkey") % 8  # null fields aren't written
    ends = formats.series_ends(o.select(_named(kind=kind, sample=F.col("o_orderkey").cast("string"), voltages=F.when(F.col("o_orderkey") % 2 == 0, declared), readings=F.when(F.col("o_orderkey") % 2 == 1, declared))))
    held = formats.read_pages(pages).groupBy("sample_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("decoded").alias("decoded"))
    return ends.join(held, "sample_id", "left").na.fill(0, ["pages", "decoded"])


@query("""SELECT l_orderkey::VARCHAR AS workout_id, count(*)::BIGINT AS legs, min(l_shipdate)::TIMESTAMP AS first_start, sum(l_linenumber)::BIGINT AS activities, max(place)::BIGINT AS last_ordinal
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS place FROM lineitem) GROUP BY 1""")
def workout_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: the activities of workouts, a row each in their order."""
    leg = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(leg)).alias("legs"))
    legs = F.transform("legs", lambda x: F.struct(x["l_partkey"].cast("string").alias("id"), x["l_linenumber"].alias("activityType"), iso_text(x["l_shipdate"]).alias("startDate")))
    read = formats.workout_legs(rows.select(_named(kind="workout", id=F.col("l_orderkey").cast("string"), activities=legs)))
    return read.groupBy("workout_id").agg(F.count(F.lit(1)).alias("legs"), F.min("start_ts").alias("first_start"), F.sum("activity_type").alias("activities"), F.max("ordinal").cast("long").alias("last_ordinal"))


@query("""SELECT event_type AS destination, 'd' || (max(event_id) % 2) AS digest, CASE WHEN max(event_id) % 2 = 0 THEN min(ts) ELSE max(ts) END AS moment, max(event_id) % 2 <> 0 AS is_new FROM events GROUP BY 1""")
def coverage_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07: the moment moves on change only."""
    e = adapters.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("destination"))
    told = e.agg(F.concat(F.lit("d"), F.max("event_id") % 2).alias("digest"), F.max("ts").alias("now"))
    return state.observed(told, e.agg(F.lit("d0").alias("digest"), F.min("ts").alias("moment")))


@query("""SELECT p_partkey AS type, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size + 1 END::BIGINT AS anchor, CASE WHEN p_partkey % 3 = 1 THEN 10 + p_partkey ELSE 10 END::BIGINT AS delivered,
  CASE p_partkey % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'committed' ELSE 'kept' END AS status FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_size - 1 ELSE p_size END AS p_size FROM part)""")
def anchor_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-11, STR-01: a commit counts only if nothing was committed since it began."""
    part, size = adapters.table(spark, sf_dir, "part"), F.col("p_size").cast("long")
    stored = part.select(F.col("p_partkey").alias("type"), size.alias("anchor"), F.lit(10).cast("long").alias("delivered"))
    commits = part.where("p_partkey % 3 <> 2").select(F.col("p_partkey").alias("type"), F.when(F.col("p_partkey") % 3 == 0, size - 1).otherwise(size).alias("base"), (size + 1).alias("anchor"), F.col("p_partkey").alias("delivered"))
    return state.commit_anchors(stored, commits)


@query("""SELECT event_id FROM (SELECT event_id, ['frequent', 'hourly', 'daily', 'manual'][(event_id % 4)::INTEGER + 1] AS cadence, CASE WHEN event_id % 5 > 0 THEN ts END AS tried FROM events)
WHERE cadence <> 'manual' AND (tried IS NULL OR date_diff('second', tried, TIMESTAMP '2024-01-15 00:00:00') >= CASE cadence WHEN 'frequent' THEN 300 WHEN 'hourly' THEN 3300 ELSE 82800 END)""")
def due_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: cadence floors."""
    n = F.col("event_id")
    cadence = F.element_at(F.array(*(F.lit(x) for x in ("frequent", "hourly", "daily", "manual"))), (n % 4 + 1).cast("int"))
    rows = adapters.table(spark, sf_dir, "events").select("event_id", cadence.alias("cadence"), F.when(n % 5 > 0, F.date_trunc("second", "ts")).alias("last_attempt"))
    return state.due(rows, F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select("event_id")
