"""Queries: wire formats in and out, and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import seconds_between
from pulsegrid.plans.bucketed import ZONE
from pulsegrid.plans.register import query
from pulsegrid.sinks import formats as out
from pulsegrid.sources import adapters, formats
from pulsegrid.sources.adapters import SAMPLE_SQL

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as NDJSON, some without a date, some as tombstones, some broken."""
    lines = out.ndjson(adapters.sample(spark, sf_dir).withColumn("kind", F.when(F.col("id") % 9 == 0, "deletion").otherwise(F.lit("quantity"))))
    n = F.get_json_object("value", "$.id").cast("long")
    return lines.select(F.when(n % 13 == 0, F.concat(F.lit("x"), "value")).when(n % 17 == 0, F.replace("value", F.lit("startDate"), F.lit("begun"))).otherwise(F.col("value")).alias("value"))


@query(f"""WITH {SAMPLE_SQL} SELECT CASE WHEN id % 13 = 0 THEN 'quarantine' WHEN id % 9 = 0 THEN 'deletion' WHEN id % 17 = 0 THEN 'quarantine' ELSE 'sample' END AS route, count(*)::BIGINT AS records,
  round(sum(CASE WHEN id % 13 <> 0 THEN value END), 2) AS total, sum(CASE WHEN id % 13 <> 0 THEN reading_count ELSE 1 END)::BIGINT AS readings FROM sample GROUP BY 1""")
def ndjson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, SRC-07, SRC-08: every line goes somewhere."""
    rows = formats.route(_lines(spark, sf_dir))
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("value"), 2).alias("total"), F.sum("reading_count").alias("readings"))


@query(f"""WITH {SAMPLE_SQL} SELECT id::VARCHAR AS id, type, {_ISO.format("start_ts").replace(" || 'Z'", "")}::TIMESTAMP AS start_ts, value, CASE WHEN id % 4 = 0 THEN 'a, "b"' ELSE source_name END AS source_name, id % 6 = 0 AS deleted FROM sample""")
def csv_parse_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, SRC-05: what is written reads back, commas and quotes included."""
    rows = adapters.sample(spark, sf_dir).withColumns({"source_name": F.when(F.col("id") % 4 == 0, 'a, "b"').otherwise(F.col("source_name")), "kind": F.when(F.col("id") % 6 == 0, "deletion").otherwise(F.lit("quantity"))})
    read = formats.parse_csv(out.csv_lines(rows).select(F.col("line").alias("value")))
    return read.where("readable").select("id", "type", "start_ts", "value", "source_name", "deleted")


@query(f"""WITH {SAMPLE_SQL}, p AS (SELECT CASE type WHEN 'purchase' THEN 'purchase' ELSE type END AS type, date_trunc('millisecond', start_ts)::TIMESTAMP AS start_ts, date_trunc('millisecond', CASE WHEN end_ts <> start_ts THEN end_ts ELSE start_ts END)::TIMESTAMP AS end_ts, value, source_name FROM sample)
SELECT type || ':' || {_ISO.format("start_ts")} AS id, type, start_ts, end_ts, value, source_name FROM p""")
def metrics_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: envelopes of the points of at most 500 ids each, flattened."""
    sample = adapters.sample(spark, sf_dir).withColumn("batch", F.floor(F.col("id") / 500))
    point = F.struct(F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("date"), F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("endDate"), F.col("value").alias("qty"), F.col("source_name").alias("source"))
    metrics = sample.groupBy("batch", "type").agg(F.collect_list(point).alias("data")).select("batch", F.struct(F.col("type").alias("name"), F.lit("u").alias("units"), "data").alias("m"))
    payloads = metrics.groupBy("batch").agg(F.to_json(F.struct(F.struct(F.collect_list("m").alias("metrics")).alias("data"))).alias("value"))
    return formats.flatten_metrics(payloads).select("id", "type", "start_ts", "end_ts", "value", "source_name")


@query(f"""WITH {SAMPLE_SQL} SELECT type AS name, id AS pos, {_ISO.format("start_ts")} AS date, CASE WHEN end_ts <> start_ts THEN {_ISO.format("end_ts")} END AS end_date, value AS qty, unit AS units, source_name AS source FROM sample""")
def metrics_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04 before grouping."""
    return out.metric_points(adapters.sample(spark, sf_dir))


_METRICS = f"""WITH {SAMPLE_SQL}, p AS (SELECT type, id, id // 500 AS batch, '{{"date":"' || {_ISO.format("start_ts")} || '"' || CASE WHEN end_ts <> start_ts THEN ',"endDate":"' || {_ISO.format("end_ts")} || '"' ELSE '' END
  || CASE WHEN value IS NOT NULL THEN ',"qty":' || value::VARCHAR ELSE '' END || ',"source":"' || source_name || '","units":"u"}}' AS point FROM sample)
SELECT type AS name, batch::BIGINT AS batch, count(*)::BIGINT AS points, '{{"data":[' || string_agg(point, ',' ORDER BY id) || '],"name":"' || type || '","units":"u"}}' AS metric FROM p GROUP BY type, batch"""


@query(_METRICS)
def metrics_group_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: points in their order, in delivery batches of 500 ids."""
    return out.metrics_json(adapters.sample(spark, sf_dir), batch=F.floor(F.col("id") / 500))


@query(_METRICS)
def metrics_values_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, as ``metrics_group_json``."""
    return metrics_group_json(spark, sf_dir)


_NY = "timezone('America/New_York', {} AT TIME ZONE 'UTC')"


@query(f"""WITH {SAMPLE_SQL} SELECT id, type AS name, strftime({_NY.format("start_ts")}, '%Y-%m-%d %H:%M:%S') || ' -0500' AS date, CASE WHEN end_ts <> start_ts THEN strftime({_NY.format("end_ts")}, '%Y-%m-%d %H:%M:%S') || ' -0500' END AS end_date, value AS qty, unit AS units FROM sample""")
def dialect_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: local times with their offset."""
    return out.dialect_points(adapters.sample(spark, sf_dir), ZONE).select("id", "name", "date", "end_date", "qty", "units")


_LINES = f"""WITH {SAMPLE_SQL}, r AS (
  SELECT *, (epoch_us(start_ts) // 1000) * 1000000 AS stamp, (epoch_us(end_ts) // 1000 - epoch_us(start_ts) // 1000) / 1000.0::DOUBLE AS span FROM sample
)
SELECT id, CASE WHEN id % 5 = 0 THEN 'health_deletions,type=' || type || ',id=' || id || ' deleted=true '
  WHEN id % 5 = 1 THEN 'health_workouts,type=workout,activity=Cross\\ Training,source=a\\,b\\=' || source_name || ' duration=' || span::VARCHAR || ',id="' || id || '" '
  WHEN value IS NOT NULL THEN 'health,type=' || type || ',source=a\\,b\\=' || source_name || ',device=Watch,unit=u value=' || value::VARCHAR || CASE WHEN span > 0 THEN ',duration=' || span::VARCHAR ELSE '' END || ' '
  ELSE 'health_events,type=' || type || ',source=a\\,b\\=' || source_name || ',device=Watch id="' || id || '"' || CASE WHEN span > 0 THEN ',duration=' || span::VARCHAR ELSE '' END || ' ' END || stamp AS line FROM r"""


@query(_LINES)
def line_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: routing, tags, escapes, values, durations and nanoseconds."""
    return _line_protocol(adapters.sample(spark, sf_dir), F.col("value"), seconds_between(F.col("start_ts"), F.col("end_ts")))


@query(_LINES)
def line_protocol_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07, as ``line_protocol``."""
    return line_protocol(spark, sf_dir)


def _line_protocol(s: DataFrame, value: Column, duration: Column) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kind = F.when(F.col("id") % 5 == 0, "deletion").when(F.col("id") % 5 == 1, "workout").otherwise("quantity")
    rows = s.select("id", "type", kind.alias("kind"), text("start_ts").alias("startDate"), text("end_ts").alias("endDate"), value.alias("value"), "unit", F.concat(F.lit("a,b="), "source_name").alias("source"), F.when(kind == "quantity", "Watch").alias("device"), F.lit("Cross Training").alias("activity"), duration.alias("duration"))
    return out.line_protocol(rows)


_CSV = f"""WITH {SAMPLE_SQL} SELECT id, id || ',' || type || ',quantity,' || {_ISO.format("start_ts")} || ',' || {_ISO.format("end_ts")} || ',' ||
  CASE WHEN value IS NULL THEN '' WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END || ',u,' || source_name || ',false' AS line FROM sample"""


@query(_CSV)
def csv_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: integral numbers have no point."""
    return out.csv_lines(adapters.sample(spark, sf_dir))


@query(_CSV)
def csv_flat_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, as ``csv_flat``."""
    return csv_flat(spark, sf_dir)


@query(f"WITH {SAMPLE_SQL} SELECT id, source_name, (row_number() OVER (PARTITION BY source_name ORDER BY start_ts, id) - 1) // 7 AS part FROM sample")
def payload_split_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11."""
    from pyspark.sql import Window

    rows = adapters.sample(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("source_name").orderBy("start_ts", "id")))
    return out.split_by_count(rows, "source_name", "pos", 7).select("id", "source_name", "part")


@query(f"""WITH RECURSIVE {SAMPLE_SQL}, n AS (SELECT id, source_name, raw, strlen(coalesce(raw, '')) AS size, row_number() OVER (PARTITION BY source_name ORDER BY id) AS k FROM sample), walk AS (
  SELECT id, source_name, raw, k, size AS held, 0::BIGINT AS part FROM n WHERE k = 1
  UNION ALL SELECT n.id, n.source_name, n.raw, n.k, CASE WHEN w.held > 0 AND w.held + n.size > 64 THEN n.size ELSE w.held + n.size END, CASE WHEN w.held > 0 AND w.held + n.size > 64 THEN w.part + 1 ELSE w.part END
  FROM walk w JOIN n ON n.source_name = w.source_name AND n.k = w.k + 1
) SELECT id, source_name, raw, part FROM walk""")
def payload_split_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12: which part depends on all records before it."""
    return out.split_by_bytes(adapters.sample(spark, sf_dir).select("id", "source_name", "raw"), "source_name", "id", "raw", 64)


@query(f"WITH {SAMPLE_SQL} SELECT type AS topic, max_by(value, (start_ts, id)) AS value, max(start_ts) AS at FROM sample WHERE value IS NOT NULL GROUP BY type")
def latest_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10, WIN-10."""
    return out.latest_topics(adapters.sample(spark, sf_dir))


def _sniffed(source: str) -> str:
    return f"""SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty' WHEN starts_with(trim(text, ' '), '{{') AND regexp_matches(text, '"[A-Za-z]*ConnectionTest"') THEN 'probe' WHEN starts_with(trim(text, ' '), '[') THEN 'array'
  WHEN starts_with(trim(text, ' '), '{{') AND contains(text, '"metrics"') THEN 'metrics' WHEN starts_with(trim(text, ' '), '{{') THEN 'ndjson'
  WHEN contains(string_split(trim(text, ' '), chr(10))[1], 'startDate') AND contains(string_split(trim(text, ' '), chr(10))[1], ',') THEN 'csv' ELSE 'ndjson' END AS format FROM ({source})"""


@query(_sniffed("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN ' ' || text WHEN 1 THEN '[' || text WHEN 2 THEN '{"data":{"metrics"' || text WHEN 3 THEN '{' || text WHEN 4 THEN 'id,startDate' || chr(10) || text
  WHEN 5 THEN '{"kind":"aConnectionTest"}' || text ELSE 'ConnectionTest ' || text END AS text FROM documents"""))
def payload_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: the documents' texts as payloads of seven beginnings."""
    n = F.col("doc_id") % 7
    begin = F.when(n == 0, " ").when(n == 1, "[").when(n == 2, '{"data":{"metrics"').when(n == 3, "{").when(n == 4, "id,startDate\n").when(n == 5, '{"kind":"aConnectionTest"}').otherwise("ConnectionTest ")
    return adapters.table(spark, sf_dir, "documents").select("doc_id", formats.payload_format(F.concat(begin, "text")).alias("format"))


@query(_sniffed("SELECT doc_id, text FROM documents"))
def payload_sniffing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01 over the documents' own texts."""
    return adapters.table(spark, sf_dir, "documents").select("doc_id", formats.payload_format(F.col("text")).alias("format"))


@query(f"""WITH {SAMPLE_SQL} SELECT id::VARCHAR AS id, type, value FROM sample WHERE id % 9 <> 0 AND id % 13 <> 0 AND id % 17 <> 0""")
def streaming_upsert_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-03: the lines arrive as files, the stream takes them until there are no more, and the log is folded."""
    from pulsegrid.sources.scratch import scratch
    from pulsegrid.streaming import ingest

    home = scratch(spark, f"stream-{uuid.uuid4().hex}")
    _lines(spark, sf_dir).withColumnRenamed("value", "text").write.option("compression", "none").text(f"{home}/raw")
    # Spark names its part files *.txt.
    ingest.start_upsert(ingest.line_stream(spark, f"{home}/raw", names="*.txt"), f"{home}/log", f"{home}/checkpoint").awaitTermination()
    return ingest.state(spark, f"{home}/log").select("id", "type", "value")
