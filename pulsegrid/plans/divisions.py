"""Queries: payloads of every form taken apart, put together and divided; notes and tracks as ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans.bucketed import ZONE
from pulsegrid.plans.exports import _BODY, _DAY, _body
from pulsegrid.plans.register import query
from pulsegrid.plans.wires import _CSV, _ISO, _LINES, line_protocol
from pulsegrid.sinks import division, documents
from pulsegrid.sinks import formats as out
from pulsegrid.sources import adapters, formats
from pulsegrid.sources.adapters import SAMPLE_SQL

_BATCH = 500
_HEADER = out.csv_header()


def _texts(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """(batch, id, line): the records of a form of lines."""
    sample = adapters.sample(spark, sf_dir)
    if form == "csv":
        lines = out.csv_lines(sample)
    elif form == "lines":
        lines = line_protocol(spark, sf_dir)
    else:
        rows = out.ndjson(sample)
        lines = rows.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.col("value").alias("line"))
    return lines.select(F.floor(F.col("id") / _BATCH).alias("batch"), "id", "line")


def _payloads(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """(batch, payload): requests of 500 ids each."""
    if form == "metrics":
        metrics = out.metrics_json(adapters.sample(spark, sf_dir), batch=F.floor(F.col("id") / _BATCH))
        held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "metric"))), lambda x: x["metric"]), ",")
        return metrics.groupBy("batch").agg(F.concat(F.lit('{"data":{"metrics":['), held, F.lit("]}}")).alias("payload"))
    lines: Column = F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda x: x["line"])
    before, between, after = {"json": ("[\n", ",\n", "\n]\n"), "csv": (_HEADER + "\n", "\n", "\n")}.get(form, ("", "\n", "\n"))
    return _texts(spark, sf_dir, form).groupBy("batch").agg(F.concat(F.lit(before), F.array_join(lines, between), F.lit(after)).alias("payload"))


_NDJSON = f"""WITH {SAMPLE_SQL} SELECT id, '{{"endDate":"' || {_ISO.format("end_ts")} || '","id":"' || id || '","kind":"quantity",' || CASE WHEN value IS NULL THEN '' ELSE '"quantity":{{' || CASE WHEN reading_count > 1 THEN '"count":' || reading_count || ',' ELSE '' END || '"unit":"u","value":' || value::VARCHAR || '}},' END
  || '"source":{{"name":"' || source_name || '"}},"startDate":"' || {_ISO.format("start_ts")} || '","type":"' || type || '"}}' AS line FROM sample"""
_POINTS = f"""WITH {SAMPLE_SQL} SELECT type, id, id // {_BATCH} AS batch, '{{"date":"' || {_ISO.format("start_ts")} || '"' || CASE WHEN end_ts <> start_ts THEN ',"endDate":"' || {_ISO.format("end_ts")} || '"' ELSE '' END
  || CASE WHEN value IS NOT NULL THEN ',"qty":' || value::VARCHAR ELSE '' END || ',"source":"' || source_name || '","units":"u"}}' AS point FROM sample"""


def _digests(form: str, lines: str, text: str) -> str:
    return f"SELECT '{form}' AS form, (id // {_BATCH})::BIGINT AS batch, count(*)::BIGINT AS records, md5({text}) AS digest FROM ({lines}) GROUP BY 2"


_TOGETHER = " UNION ALL ".join([
    _digests("ndjson", _NDJSON, "string_agg(line || chr(10), '' ORDER BY id)"),
    _digests("json", _NDJSON, "'[' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY id) || chr(10) || ']' || chr(10)"),
    _digests("csv", _CSV, f"'{_HEADER}' || chr(10) || string_agg(line || chr(10), '' ORDER BY id)"),
    _digests("lines", _LINES, "string_agg(line || chr(10), '' ORDER BY id)"),
    f"""SELECT 'metrics', batch::BIGINT, sum(n)::BIGINT, md5('{{"data":{{"metrics":[' || string_agg(m, ',' ORDER BY type) || ']}}}}') FROM (
  SELECT batch, type, count(*) AS n, '{{"data":[' || string_agg(point, ',' ORDER BY id) || '],"name":"' || type || '","units":"u"}}' AS m FROM ({_POINTS}) GROUP BY batch, type) GROUP BY batch""",
])


@query(_TOGETHER)
def payload_forms_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13: payloads of five forms, taken apart to records and put together again, have the text that they had."""
    done = None
    for form in division.FORMS:
        records = division.decompose(_payloads(spark, sf_dir, form), form).where("pos is not null")
        counted = records.groupBy("batch").agg(F.count(F.lit(1)).alias("records"))
        again = division.recompose(records, form, "batch").join(counted, "batch").select(F.lit(form).alias("form"), "batch", "records", F.md5("payload").alias("digest"))
        done = again if done is None else done.unionByName(again)
    return done


@query(f"""SELECT form, d::DATE AS day, count(*)::BIGINT AS records FROM (
  SELECT unnest(['ndjson', 'json', 'csv', 'metrics']) AS form, start_ts AS d FROM (WITH {SAMPLE_SQL} SELECT start_ts FROM sample)
  UNION ALL SELECT 'lines', start_ts FROM (WITH {SAMPLE_SQL} SELECT start_ts, id, value FROM sample)) GROUP BY ALL""")
def payload_record_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13: each form's records are dated as their samples."""
    done = None
    for form in division.FORMS:
        records = division.decompose(_payloads(spark, sf_dir, form), form).select(F.lit(form).alias("form"), F.to_date(F.date_trunc("day", "date")).alias("day"))
        done = records if done is None else done.unionByName(records)
    return done.groupBy("form", "day").agg(F.count(F.lit(1)).alias("records"))


_MOST = 4000


def _base64(payload: Column) -> Column:
    """Base64 in one line, whatever the session's setting."""
    return F.replace(F.base64(payload), F.lit("\r\n"), F.lit(""))


@query(f"""WITH RECURSIVE rec AS (
  SELECT 'csv' AS form, id // {_BATCH} AS batch, row_number() OVER (PARTITION BY id // {_BATCH} ORDER BY id) AS pos, strlen(line) AS len, 0 AS env, 0 AS new FROM ({_CSV})
  UNION ALL SELECT 'metrics', batch, row_number() OVER w, strlen(point), strlen('{{"data":[],"name":"' || type || '","units":"u"}}'), CASE WHEN lag(type) OVER w = type THEN 0 ELSE 1 END FROM ({_POINTS}) WINDOW w AS (PARTITION BY batch ORDER BY type, id)
), cum AS (SELECT *, sum(len) OVER w AS s, sum(new) OVER w AS c, sum(env * new) OVER w AS e, count(*) OVER (PARTITION BY form, batch) AS held, CASE form WHEN 'csv' THEN {len(_HEADER) + 1} ELSE 60 END AS frame FROM rec WINDOW w AS (PARTITION BY form, batch ORDER BY pos)
), walk AS (
  SELECT form, batch, pos, frame + len + env + 2 AS bytes, 0 AS part FROM cum WHERE pos = 1
  UNION ALL SELECT n.form, n.batch, n.pos, CASE WHEN w.bytes + n.len + n.env + 2 > {_MOST} THEN n.frame ELSE w.bytes END + n.len + n.env + 2, w.part + CASE WHEN w.bytes + n.len + n.env + 2 > {_MOST} THEN 1 ELSE 0 END
  FROM walk w JOIN cum n ON n.form = w.form AND n.batch = w.batch AND n.pos = w.pos + 1
), ends AS (SELECT form, batch, pos AS a, s - len AS s0, c AS c0, e AS e0, env, held FROM cum
), measured AS (SELECT x.form, x.batch, x.a, y.pos AS b, x.held, (CASE x.form WHEN 'csv' THEN {len(_HEADER) + 1} + y.s - s0 + y.pos - a + 1 ELSE 23 + y.s - s0 + y.pos - a + e - e0 + x.env END + 2) // 3 * 4 AS bytes FROM ends x JOIN cum y ON x.form = y.form AND x.batch = y.batch AND x.a <= y.pos
), ranges AS (
  SELECT form, batch, min(pos) AS a, max(pos) AS b FROM walk WHERE (form, batch) NOT IN (SELECT (form, batch) FROM measured WHERE a = 1 AND b = held AND bytes <= {_MOST}) GROUP BY form, batch, part
  UNION ALL SELECT form, batch, unnest([a, a + (b - a + 1) // 2]), unnest([a + (b - a + 1) // 2 - 1, b]) FROM ranges JOIN measured USING (form, batch, a, b) WHERE bytes > {_MOST} AND b > a
) SELECT form, batch::BIGINT AS batch, (row_number() OVER (PARTITION BY form, batch ORDER BY a) - 1)::BIGINT AS part, (b - a + 1)::BIGINT AS records, bytes::BIGINT AS bytes FROM ranges JOIN measured USING (form, batch, a, b) WHERE bytes <= {_MOST} OR a = b
UNION ALL SELECT form, batch::BIGINT, 0, NULL, bytes::BIGINT FROM measured WHERE a = 1 AND b = held AND bytes <= {_MOST}""")
def payload_divide_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12: parts filled by an estimate, then halved until their Base64 fits."""
    done = None
    for form in ("csv", "metrics"):
        parts = division.divide_by_bytes(_payloads(spark, sf_dir, form), form, _MOST, frame=_base64)
        told = parts.select(F.lit(form).alias("form"), "batch", "part", "records", F.octet_length(_base64(F.col("payload"))).cast("long").alias("bytes"))
        done = told if done is None else done.unionByName(told)
    return done


@query(f"""SELECT id, CASE id % 5 WHEN 0 THEN 'health_deletions' WHEN 1 THEN 'health_workouts' ELSE CASE WHEN value IS NULL THEN 'health_events' ELSE 'health' END END AS measurement,
  CASE WHEN id % 5 = 1 THEN 'workout' ELSE type END AS type, CASE WHEN id % 5 = 1 THEN 'Cross Training' END AS activity, CASE WHEN id % 5 > 0 THEN 'a,b=' || source_name END AS source, CASE WHEN id % 5 > 1 THEN value END AS value,
  CASE WHEN id % 5 > 0 AND (id % 5 = 1 OR end_ts > start_ts) THEN (epoch_us(end_ts) // 1000 - epoch_us(start_ts) // 1000) / 1000.0::DOUBLE END AS duration, (epoch_us(start_ts) // 1000) * 1000000 AS ticks FROM (WITH {SAMPLE_SQL} SELECT * FROM sample)""")
def line_protocol_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07, SNK-13: lines read back to tags and fields, escapes undone."""
    t = line_protocol(spark, sf_dir).select("id", formats.line_tokens(F.col("line")).alias("t"))
    tag, number = lambda k: F.col("t.tags")[k], lambda k: F.col("t.fields")[k].cast("double")
    return t.select("id", "t.measurement", tag("type").alias("type"), tag("activity").alias("activity"), tag("source").alias("source"), number("value").alias("value"), number("duration").alias("duration"), "t.ticks")


_DECIMAL = "regexp_replace(printf('%.7f', {}::DOUBLE), '\\.?0+$', '')"


@query(f"""WITH p AS (SELECT conv_id, turn // 4 AS segment, turn, (turn - 40) / 2.0::DOUBLE AS lat, length(text) / 16.0::DOUBLE AS lon, role FROM conversations), e AS (SELECT DISTINCT conv_id, segment FROM p)
SELECT conv_id::VARCHAR AS doc, 1 AS section, segment::BIGINT AS part, turn::BIGINT AS place, '      <trkpt lat="' || {_DECIMAL.format("lat")} || '" lon="' || {_DECIMAL.format("lon")} || '">' || chr(10) || '        <time>' || role || '</time>' || chr(10) || '      </trkpt>' AS line FROM p WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180
UNION ALL SELECT conv_id::VARCHAR, 1, segment::BIGINT, -(2::BIGINT ** 62)::BIGINT, '    <trkseg>' FROM e UNION ALL SELECT conv_id::VARCHAR, 1, segment::BIGINT, (2::BIGINT ** 62)::BIGINT, '    </trkseg>' FROM e
UNION ALL SELECT DISTINCT conv_id::VARCHAR, 2, 0, 0, '  </trk>' || chr(10) || '</gpx>' FROM p""")
def track_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-17: the tracks' files as ordered rows, after their headers."""
    points, routes = _tracks(spark, sf_dir)
    return documents.track_lines(points, routes).where("section > 0")


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = adapters.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("route"), F.floor(F.col("turn") / 4).alias("segment"), F.col("turn").alias("pos"), ((F.col("turn") - 40) / 2).cast("double").alias("lat"), (F.char_length("text") / 16).cast("double").alias("lon"), F.col("role").alias("time"))
    none = F.lit(None).cast("string")
    return rows, rows.select("route").distinct().select("route", F.col("route").cast("string").alias("title"), none.alias("description"), none.cast("timestamp_ntz").alias("started"), none.alias("activity"))


@query("""WITH p AS (SELECT conv_id, turn, (turn - 40) / 2.0::DOUBLE AS lat, length(text) / 16.0::DOUBLE AS lon FROM conversations),
c AS (SELECT conv_id, count(*) AS present, count(*) FILTER (WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) AS points, CASE WHEN conv_id % 3 > 0 THEN count(*) + conv_id % 2 END AS declared FROM p GROUP BY 1)
SELECT conv_id AS route, points::BIGINT AS points, (present - points)::BIGINT AS dropped, coalesce(declared - present, 0)::BIGINT AS missing, coalesce(declared = present, false) AS complete,
  CASE WHEN declared IS NULL THEN 'Its end isn''t known.' WHEN declared > present THEN 'Missing ' || (declared - present) || ' of ' || declared || CASE WHEN declared = 1 THEN ' point' ELSE ' points' END || ' (' || (declared - present) || ' at the end).' END AS note FROM c""")
def track_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-17: points off the globe are counted; a route is whole only if its end is known."""
    points, routes = _tracks(spark, sf_dir)
    told = points.groupBy("route").agg(F.count(F.lit(1)).alias("present")).withColumn("declared", F.when(F.col("route") % 3 > 0, F.col("present") + F.col("route") % 2))
    lost = F.coalesce(F.col("declared") - F.col("present"), F.lit(0))
    found = told.select("route", F.lit(1).alias("segments"), "present", lost.alias("missing"), "declared", F.lit(0).alias("gaps"), F.lit(0).alias("lead"), lost.alias("tail"))
    return documents.track_summary(points, routes, found)


def _grouped(x: str) -> str:
    return f"""(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN abs({x} - round({x})) < 0.005 THEN format('{{:,}}', abs(round({x}))::BIGINT) ELSE format('{{:,}}', floor(abs({x}))::BIGINT) || printf('.%02d', round((abs({x}) - floor(abs({x}))) * 100)::INTEGER) END)"""


def _count(n: str, one: str) -> str:
    return f"format('{{:,}}', ({n})::BIGINT) || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {one}s' END"


_FILED = "timezone('America/New_York', (CASE WHEN kind = 'category' THEN end_ts ELSE start_ts END) AT TIME ZONE 'UTC')::DATE"
_SECONDS = "greatest(0, epoch_us(end_ts) - epoch_us(start_ts)) / 1e6"
_MINUTES = f"round({_SECONDS} / 60)::BIGINT"
_LENGTH = f"CASE WHEN {_SECONDS} < 60 THEN round({_SECONDS})::BIGINT || ' s' WHEN {_MINUTES} < 60 THEN {_MINUTES} || ' m' WHEN {_MINUTES} % 60 = 0 THEN {_MINUTES} // 60 || ' h' ELSE {_MINUTES} // 60 || ' h ' || {_MINUTES} % 60 || ' m' END"


@query(f"""WITH {_BODY}, t AS (SELECT {_FILED} AS day, type, count(*) AS n, count(value) FILTER (WHERE kind = 'quantity') AS v, round(sum(value) FILTER (WHERE kind = 'quantity'), 6) AS s, round(avg(value) FILTER (WHERE kind = 'quantity'), 6) AS a, min(value) FILTER (WHERE kind = 'quantity') AS lo, max(value) FILTER (WHERE kind = 'quantity') AS hi FROM b GROUP BY 1, 2),
named AS (SELECT *, CASE type WHEN 'HKWorkoutTypeIdentifier' THEN 'Workout' ELSE regexp_replace(regexp_replace(type, '^HK(Quantity|Category)?(TypeIdentifier)?', ''), '([a-z])([A-Z])', '\\1 \\2', 'g') END AS name FROM t), d AS (SELECT day, sum(n)::BIGINT AS n FROM t GROUP BY 1),
w AS (SELECT *, {_DAY} AS day, row_number() OVER (PARTITION BY {_DAY} ORDER BY start_ts, id) AS place, count(*) OVER (PARTITION BY {_DAY}) AS held FROM b WHERE kind = 'workout')
SELECT day::VARCHAR AS doc, 2 AS section, 0::BIGINT AS part, place::BIGINT AS place, '| ' || strftime(timezone('America/New_York', start_ts AT TIME ZONE 'UTC'), '%H:%M') || ' | A\\|' || (id % 7) || ' | ' || {_LENGTH} || ' |' AS line FROM w WHERE place <= 25
UNION ALL SELECT DISTINCT day::VARCHAR, 3, 0, 0, CASE WHEN held > 25 THEN chr(10) || format('{{:,}}', (held - 25)::BIGINT) || CASE WHEN held = 26 THEN ' further workout is' ELSE ' further workouts are' END || ' counted above but not listed.' || chr(10) ELSE '' END FROM w
UNION ALL SELECT day::VARCHAR, 5, 0, 0, '## Everything recorded' || chr(10) || chr(10) || '| Type | Records | Total | Average | Low | High | Unit |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- |' FROM d
UNION ALL SELECT day::VARCHAR, 6, 0, row_number() OVER (PARTITION BY day ORDER BY name, type), '| ' || name || ' | ' || format('{{:,}}', n::BIGINT) || ' | ' || CASE WHEN v > 0 THEN CASE WHEN type LIKE '%StepCount' THEN {_grouped("s")} ELSE '' END || ' | ' || {_grouped("a")} || ' | ' || {_grouped("lo")} || ' | ' || {_grouped("hi")} ELSE ' |  |  | ' END || ' | ' || CASE WHEN v > 0 THEN 'u' ELSE '' END || ' |' FROM named
UNION ALL SELECT day::VARCHAR, 7, 0, 0, chr(10) || '---' || chr(10) || chr(10) || '*A summary: totals of ' || {_count("n", "record")} || ', not the records.*' FROM d""")
def note_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-16, SCL-26: each day's note as ordered rows; its front matter's figures are those of ``daily_highlights``."""
    sample = _body(spark, sf_dir).withColumn("activity", F.concat(F.lit("A|"), F.col("id") % 7))
    return documents.note_lines(sample, ZONE).where("section in (2, 3, 5, 6, 7)")


_STATES = ["anchorClosed", "draining", "noSuchWord", "unsupported"]


@query(f"""WITH r AS (SELECT event_id, event_type || event_id AS type, [{", ".join(f"'{x}'" for x in _STATES)}][(event_id % 4)::INTEGER + 1] AS word, date_trunc('millisecond', ts)::TIMESTAMP AS seen FROM events)
SELECT type, CASE word WHEN 'noSuchWord' THEN 'unknown' ELSE word END AS state, CASE WHEN event_id % 3 > 0 THEN event_id END::BIGINT AS delivered, seen AS observed_at, md5('{{"complete":' || (word = 'anchorClosed') || CASE WHEN event_id % 3 > 0 THEN ',"deliveredCount":' || event_id ELSE '' END || ',"kind":"typeCoverage","observedAt":"' || {_ISO.format("seen")}
  || '"' || CASE WHEN event_id % 2 = 0 THEN ',"primedFrom":"' || {_ISO.format("seen")} || '"' ELSE '' END || ',"state":"' || CASE word WHEN 'noSuchWord' THEN 'unknown' ELSE word END || '","type":"' || type || '"}}') AS line FROM r""")
def coverage_report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: reports of coverage written as lines and read again."""
    e, at = adapters.table(spark, sf_dir, "events"), F.col("ts").cast("timestamp_ntz")
    word = F.element_at(F.array(*(F.lit(x) for x in _STATES)), (F.col("event_id") % 4 + 1).cast("int"))
    reports = e.select(F.concat("event_type", "event_id").alias("type"), word.alias("state"), F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("delivered"), F.when(F.col("event_id") % 2 == 0, at).alias("primed_from"), F.lit(None).cast("timestamp_ntz").alias("primed_through"), at.alias("observed_at"))
    lines = out.coverage_report_lines(reports)
    read = formats.coverage_lines(lines)
    texts = lines.select(F.get_json_object("value", "$.type").alias("type"), F.md5("value").alias("line"))
    return read.join(texts, "type").select("type", "state", "delivered", "observed_at", "line")
