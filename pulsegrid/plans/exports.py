"""Queries: exports, catalogue, text forms, resumes and the question surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import names
from pulsegrid.functions.calendar import iso_text
from pulsegrid.operators import export, pages, series, state, stats
from pulsegrid.plans.bucketed import ISLANDS_SQL, ZONE
from pulsegrid.plans.register import query
from pulsegrid.plans.timelines import _JUDGED, _ORDER_DAYS, _order_days
from pulsegrid.plans.tools import Archive
from pulsegrid.schema import HIGHLIGHTS, METRIC_NAMES
from pulsegrid.sinks import formats as out
from pulsegrid.sources import adapters, formats
from pulsegrid.sources.adapters import PAGES_SQL, SAMPLE_SQL
from pulsegrid.streaming import ingest

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_AS = {"purchase": "HKQuantityTypeIdentifierStepCount", "click": "HKQuantityTypeIdentifierHeartRate", "error": "HKQuantityTypeIdentifierBodyMass", "view": "HKCategoryTypeIdentifierSleepAnalysis", "signup": "HKWorkoutTypeIdentifier"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AS.items())
_DAY = "timezone('America/New_York', start_ts AT TIME ZONE 'UTC')::DATE"
_BODY = f"""{SAMPLE_SQL}, b AS (SELECT id, CASE type {_CASES} END AS type, CASE type WHEN 'view' THEN 'category' WHEN 'signup' THEN 'workout' ELSE 'quantity' END AS kind, start_ts, end_ts,
  CASE type WHEN 'view' THEN (id % 6)::DOUBLE ELSE value END AS value FROM sample)"""


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the types of a body: steps, heart rates, weights, sleep stages and workouts."""
    s, t = adapters.sample(spark, sf_dir), F.col("type")
    kind = F.when(t == "view", "category").when(t == "signup", "workout").otherwise("quantity")
    return s.select("id", names.lookup(_AS, t).alias("type"), kind.alias("kind"), "start_ts", "end_ts", F.when(t == "view", (F.col("id") % 6).cast("double")).otherwise(F.col("value")).alias("value"), "unit", "source_name")


_SHOWN = [h for h in HIGHLIGHTS if h[0] in _AS.values()]


@query(f"""WITH {_BODY}, st AS (SELECT CASE WHEN value IN (1, 3, 4, 5) THEN 'asleep' ELSE 'in_bed' END AS type, start_ts, end_ts FROM b WHERE kind = 'category' AND value IN (0, 1, 3, 4, 5)),
{ISLANDS_SQL.replace("FROM sample", "FROM st")}, sl AS (SELECT timezone('America/New_York', (end_ts - INTERVAL 1 MICROSECOND) AT TIME ZONE 'UTC')::DATE AS day,
  sum(CASE WHEN type = 'asleep' THEN epoch_us(end_ts) - epoch_us(start_ts) END) / 1e6 AS asleep, sum(CASE WHEN type = 'in_bed' THEN epoch_us(end_ts) - epoch_us(start_ts) END) / 1e6 AS in_bed FROM island GROUP BY 1),
d AS (SELECT {_DAY} AS day, count(*)::BIGINT AS records, count(*) FILTER (WHERE kind = 'workout')::BIGINT AS workouts, coalesce(sum(greatest(0, epoch_us(end_ts) - epoch_us(start_ts))) FILTER (WHERE kind = 'workout'), 0) / 1e6 AS ws,
  count(*) FILTER (WHERE kind = 'category')::BIGINT AS segments, {", ".join(f"{'sum' if how == 'total' else 'avg'}(value) FILTER (WHERE type = '{t}') AS {n}" for t, n, how in _SHOWN)} FROM b GROUP BY 1)
SELECT coalesce(d.day, sl.day) AS day, coalesce(records, 0)::BIGINT AS records, coalesce(workouts, 0)::BIGINT AS workouts, round(coalesce(ws, 0)::DOUBLE, 3) AS workout_seconds, round(coalesce(asleep, 0)::DOUBLE, 3) AS asleep_seconds, round(coalesce(in_bed, 0)::DOUBLE, 3) AS in_bed_seconds,
  coalesce(segments, 0)::BIGINT AS sleep_segments, {", ".join(f"round({n}, 4) AS {n}" for _, n, _h in _SHOWN)} FROM d FULL JOIN sl ON d.day = sl.day""")
def daily_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, SNK-16: what a day's note is made of; sleep is time covered, filed where it ends."""
    rows = export.day_summaries(_body(spark, sf_dir), ZONE)
    seconds = ("workout_seconds", "asleep_seconds", "in_bed_seconds")
    return rows.select("day", "records", "workouts", *(F.round(c, 3).alias(c) for c in seconds), "sleep_segments", *(F.round(n, 4).alias(n) for _, n, _h in _SHOWN))


@query(f"""WITH {_BODY}, w AS (SELECT *, {_DAY} AS day, row_number() OVER (PARTITION BY {_DAY} ORDER BY start_ts, id) AS place FROM b WHERE kind = 'workout')
SELECT day, place::INTEGER AS place, strftime(timezone('America/New_York', start_ts AT TIME ZONE 'UTC'), '%H:%M') AS started, 'A' || (id % 7) AS activity, greatest(0, epoch_us(end_ts) - epoch_us(start_ts)) / 1e6::DOUBLE AS seconds FROM w WHERE place <= 25""")
def note_workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-16: the first 25 of a day."""
    rows = _body(spark, sf_dir).where("kind = 'workout'").withColumn("activity", F.concat(F.lit("A"), F.col("id") % 7))
    return export.listed_workouts(rows, ZONE)


@query("""WITH e AS (SELECT event_id, event_type AS type, ts, CASE WHEN event_type = lag(event_type) OVER (ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT event_id, type, type || CASE WHEN k > 1 THEN '-' || k::BIGINT ELSE '' END AS entry FROM n""")
def type_run_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-14: a file for each unbroken run of a type; no window holds more than a day, or one row a day."""
    e = adapters.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), "ts", F.to_date("ts").alias("day"))
    return export.type_runs(e, "day", ["ts", "event_id"]).select("event_id", "type", "entry")


@query(f"""WITH {SAMPLE_SQL} SELECT id, id || ',' || type || ',' || {_ISO.format("start_ts")} || ',' || {_ISO.format("end_ts")} || ',' || CASE WHEN value IS NULL THEN '' WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END || ',u,' || reading_count || ',' || source_name || ',,,,' AS line FROM sample""")
def csv_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, SNK-19: a quantity's own columns."""
    s = adapters.sample(spark, sf_dir)
    rows = s.select("id", "type", iso_text(F.col("start_ts")).alias("startDate"), iso_text(F.col("end_ts")).alias("endDate"), "value", "unit", F.col("reading_count").alias("count"), F.col("source_name").alias("sourceName"))
    return export.kind_csv(rows, "quantity")


@query(f"""WITH {SAMPLE_SQL} SELECT 'source' AS tab, source_name AS name, count(*)::BIGINT AS records, min(start_ts) AS first_start, max(start_ts) AS last_start FROM sample GROUP BY source_name
UNION ALL SELECT 'type', type, count(*), min(start_ts), max(start_ts) FROM sample GROUP BY type, kind UNION ALL SELECT 'unit', type || '/' || unit, count(*), min(start_ts), max(start_ts) FROM sample GROUP BY type, unit""")
def export_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-15: the tables beside the records."""
    t = export.relational(adapters.sample(spark, sf_dir))
    span = ["records", "first_start", "last_start"]
    one = t["source"].select(F.lit("source").alias("tab"), F.col("source_name").alias("name"), *span)
    return one.unionByName(t["type"].select(F.lit("type").alias("tab"), F.col("type").alias("name"), *span)).unionByName(t["unit"].select(F.lit("unit").alias("tab"), F.concat_ws("/", "type", "unit").alias("name"), *span))


@query("""SELECT year(timezone('America/New_York', o_orderdate AT TIME ZONE 'UTC'))::INTEGER AS year, count(*)::BIGINT AS workouts, sum(o_orderkey % 5400)::BIGINT AS seconds, round(sum(o_totalprice), 2) AS energy FROM orders GROUP BY 1""")
def workout_year_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-07."""
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("start_ts"), (F.col("o_orderkey") % 5400).alias("duration"), F.col("o_totalprice").alias("energy"))
    return export.year_totals(o, ZONE).withColumn("energy", F.round("energy", 2))


@query(f"""WITH {SAMPLE_SQL} SELECT id, start_ts, (SELECT count(*) FROM sample WHERE type = 'click') > 100 AS truncated FROM sample WHERE type = 'click' ORDER BY start_ts DESC, id LIMIT 100""")
def samples_with_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06: a list says whether there is more."""
    rows = adapters.sample(spark, sf_dir).where("type = 'click'").select("id", "start_ts")
    return export.with_notice(rows, [F.desc("start_ts"), F.col("id")], 100)


@query("SELECT p_type AS type, count(*)::BIGINT AS records FROM part GROUP BY 1 ORDER BY records DESC, type LIMIT 25")
def script_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08."""
    rows = adapters.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type")).agg(F.count(F.lit(1)).alias("records"))
    return rows.orderBy(F.desc("records"), "type").limit(25)


@query(f"""WITH {_ORDER_DAYS}, {_JUDGED} SELECT key, day, records FROM k WHERE NOT judged AND days >= 14 ORDER BY day, key LIMIT 10""")
def low_coverage_first10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04."""
    return stats.low_coverage(_order_days(spark, sf_dir), ["key"]).select("key", "day", "records").orderBy("day", "key").limit(10)


@query("""SELECT user_id AS device, max(ts) AS last_seen, row_number() OVER (ORDER BY max(ts) DESC, user_id)::INTEGER AS place FROM events GROUP BY user_id""")
def devices_by_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05: the newest device first; a row per device."""
    from pyspark.sql import Window

    rows = state.accumulate_devices(adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), "ts"), "device", "ts", F.lit(1))
    return rows.select("device", "last_seen", F.row_number().over(Window.orderBy(F.desc("last_seen"), "device")).alias("place"))


@query("""SELECT p_brand AS type, 'occurrences' AS kind, min(nullif(CASE WHEN p_partkey % 2 = 0 AND p_size > 10 THEN p_type ELSE '' END, '')) AS unit FROM part GROUP BY 1""")
def measures_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04: types with a unit and those without."""
    rows = adapters.table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.when((F.col("p_partkey") % 2 == 0) & (F.col("p_size") > 10), F.col("p_type")).otherwise("").alias("unit"))
    return export.measures_of(rows)


@query("SELECT DISTINCT p_partkey AS type FROM part WHERE p_partkey % 5 NOT IN (1, 2)")
def unsettled_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05."""
    part = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("type"))
    word = F.element_at(F.array(*(F.lit(x) for x in ("complete", "empty", "failed", "running"))), (F.col("type") % 5).cast("int"))
    return export.unsettled(part, part.where("type % 5 <> 0").select("type", word.alias("state")))


@query("""SELECT o_custkey AS series, o_orderdate AS bucket_start, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), TIMESTAMP '2030-01-01') AS bucket_end FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)""")
def bucket_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08: a bucket ends where the next begins."""
    starts = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("bucket_start")).distinct()
    return export.chained(starts, "series", "bucket_start", F.expr("timestamp_ntz'2030-01-01 00:00:00'"))


@query("""WITH e AS (SELECT max(ts) AS t, min(ts) AS f FROM events), d AS (SELECT t::DATE AS d, f FROM e)
SELECT '7d' AS preset, i::INTEGER AS idx, (d - 6 + i::INTEGER)::TIMESTAMP AS bucket_start FROM d, range(7) r(i) UNION ALL SELECT '30d', i::INTEGER, (d - 29 + i::INTEGER)::TIMESTAMP FROM d, range(30) r(i)
UNION ALL SELECT '53w', i::INTEGER, (d - dayofweek(d)::INTEGER - 364 + 7 * i::INTEGER)::TIMESTAMP FROM d, range(53) r(i)
UNION ALL SELECT 'all', i::INTEGER, date_trunc('month', f)::TIMESTAMP + to_months(i::INTEGER) FROM (SELECT f, unnest(range(date_diff('month', f::DATE, d) + 1)) AS i FROM d)""")
def range_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-05: ranges that end with the archive's last day."""
    ends = series.span(adapters.sample(spark, sf_dir)).select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("earliest", "latest"))).first()
    found = None
    for preset in ("7d", "30d", "53w", "all"):
        rows = export.preset_plan(spark, preset, ends.latest, ends.earliest).select(F.lit(preset).alias("preset"), "idx", "bucket_start")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("""SELECT p_partkey, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE printf('%.2f', p_retailprice) END AS number, replace(t, ' ', '%20') AS header,
  regexp_replace(regexp_replace(replace(p_brand, '#', 'X') || 'VO2MaxHRVSdnn', '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS shown
FROM (SELECT *, '<' || p_name || ' & ' || p_brand || '>' AS t FROM part)""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-17, SCL-21, SCL-25, SCL-34: text for XML, files, tools and headers."""
    t = F.concat(F.lit("<"), "p_name", F.lit(" & "), "p_brand", F.lit(">"))
    shown = F.concat(F.lit("HKQuantityTypeIdentifier"), F.replace("p_brand", F.lit("#"), F.lit("X")), F.lit("VO2MaxHRVSdnn"))
    return adapters.table(spark, sf_dir, "part").select("p_partkey", names.xml_text(t).alias("xml"), names.slug(t).alias("slug"), names.tool_number(F.col("p_retailprice")).alias("number"), names.header_safe(t).alias("header"), names.catalogue_name(shown).alias("shown"))


@query("SELECT CASE WHEN event_id % 4 IN (1, 2) THEN 'pages' ELSE 'samples' END AS home, count(*)::BIGINT AS records FROM events GROUP BY 1")
def pages_rehomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-09."""
    kinds = F.element_at(F.array(F.lit("quantity"), F.lit("quantitySeriesReadings"), F.lit("workoutRouteEnd"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    samples, moved = export.rehomed(adapters.table(spark, sf_dir, "events").select("event_id", kinds.alias("kind")))
    n = lambda df, home: df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(home).alias("home"), "records")
    return n(samples, "samples").unionByName(n(moved, "pages"))


@query(f"""WITH {PAGES_SQL}, a(destination, pending, delivered) AS (VALUES ('one', 100, 1000), ('two', 700, 0)) SELECT destination, sample_id, sequence FROM page JOIN a ON sample_id > pending OR sample_id = pending AND "offset" >= delivered""")
def resumed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: a delivery goes on in the middle of a series."""
    anchors = spark.createDataFrame([("one", 100, 1000), ("two", 700, 0)], "destination string, pending long, delivered long")
    rows = pages.latest(adapters.pages(spark, sf_dir), ["sample_id", "sequence"], ["seq"])
    return export.resumed(rows, anchors).select("destination", "sample_id", "sequence")


@query("""WITH p AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber)::BIGINT * 500 AS points FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey, coalesce(points, 0) AS points, nullif(o_orderkey % 8 * 500, 0) AS expected FROM orders LEFT JOIN p ON k = o_orderkey)
SELECT o_orderkey AS sample_id, CASE WHEN points = 0 THEN 'no voltages stored' WHEN expected IS NULL THEN points || ' points, total unknown' WHEN points >= expected THEN points || ' points, complete' ELSE points || ' of ' || expected || ' points' END AS state FROM s""")
def waveform_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-35."""
    rows = pages.header_completeness(adapters.headers(spark, sf_dir), pages.latest(adapters.pages(spark, sf_dir), ["sample_id", "sequence"], ["seq"]))
    return rows.select("sample_id", export.wave_state(F.col("points"), F.col("expected")).alias("state"))


_LISTED = ", ".join(f"('{k}', '{v}')" for k, v in sorted(METRIC_NAMES.items()))


@query(f"""WITH held AS (SELECT [{", ".join(f"'{k}'" for k, _ in sorted(METRIC_NAMES.items()))}][(p_partkey % {len(METRIC_NAMES)})::INTEGER + 1] AS type, count(*)::BIGINT AS records FROM part GROUP BY 1)
SELECT type, kind, metric, name, coalesce(records, 0)::BIGINT AS records FROM (SELECT type, CASE WHEN starts_with(type, 'HKCategory') THEN 'category' ELSE 'quantity' END AS kind, metric,
  regexp_replace(regexp_replace(regexp_replace(type, '^HK(Quantity|Category)TypeIdentifier', ''), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS name FROM (VALUES {_LISTED}) t(type, metric)) LEFT JOIN held USING (type)
WHERE contains(metric, 'rate') OR contains(lower(name), 'rate')""")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-26, APP-12: the entries with "rate" in their names, and how much there is of each."""
    types = F.array(*(F.lit(k) for k, _ in sorted(METRIC_NAMES.items())))
    held = adapters.table(spark, sf_dir, "part").groupBy(F.element_at(types, (F.col("p_partkey") % len(METRIC_NAMES) + 1).cast("int")).alias("type")).agg(F.count(F.lit(1)).alias("records"))
    entries = export.catalogue(spark).join(held, "type", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return export.catalogue_search(entries, "rate").select("type", "kind", "metric", "name", "records")


@query(f"""SELECT p_partkey, m AS metric, type FROM (SELECT p_partkey, [{", ".join(f"'{v}'" for _, v in sorted(METRIC_NAMES.items()))}, 'no_such_metric'][(p_partkey % {len(METRIC_NAMES) + 1})::INTEGER + 1] AS m FROM part) LEFT JOIN (VALUES {_LISTED}) t(type, metric) ON metric = m""")
def metric_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-16: back from a metric's name."""
    known = F.array(*(F.lit(v) for _, v in sorted(METRIC_NAMES.items())), F.lit("no_such_metric"))
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", F.element_at(known, (F.col("p_partkey") % (len(METRIC_NAMES) + 1) + 1).cast("int")).alias("metric"))
    return rows.select("p_partkey", "metric", names.type_of_metric(F.col("metric")).alias("type"))


@query(f"""WITH {SAMPLE_SQL} SELECT id, id || ',' || type || ',quantity,' || {_ISO.format("start_ts")} || ',' || {_ISO.format("end_ts")} || ',' || CASE WHEN value IS NULL THEN '' WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END || ',u,' || source_name || ',false' AS line FROM sample""")
def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13: a CSV payload taken apart to dated records and written again is what it was."""
    lines = out.csv_lines(adapters.sample(spark, sf_dir))
    payloads = lines.groupBy(F.floor(F.col("id") / 500).alias("batch")).agg(F.concat(F.lit(out.csv_header() + "\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")).alias("value"))
    apart = ingest.lines_of_payloads(payloads.select("value", F.col("batch").cast("string").alias("batch"), F.lit(None).cast("timestamp").alias("modified"), F.lit(0).cast("long").alias("block")))
    return out.csv_lines(formats.route(apart.select("value")).withColumn("id", F.col("id").cast("long")))


@query("""WITH p AS (SELECT conv_id, turn, (turn - 40) / 2.0::DOUBLE AS lat, length(text) / 16.0::DOUBLE AS lon FROM conversations)
SELECT conv_id AS route, '<gpx version="1.1"><trk>' || string_agg(run, '' ORDER BY segment) || '</trk></gpx>' AS gpx FROM (
  SELECT conv_id, turn // 4 AS segment, '<trkseg>' || string_agg(printf('<trkpt lat="%.7f" lon="%.7f"/>', lat, lon), '' ORDER BY turn) || '</trkseg>' AS run FROM p WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY ALL) GROUP BY 1""")
def gpx_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-17, PAG-05: a track per route, a segment per run; points off the globe are dropped."""
    rows = adapters.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("route"), F.floor(F.col("turn") / 4).alias("segment"), F.col("turn").alias("pos"), ((F.col("turn") - 40) / 2).cast("double").alias("lat"), (F.char_length("text") / 16).cast("double").alias("lon"))
    return out.gpx_track(rows, "route")


def _archive(spark: SparkSession, sf_dir: str) -> Archive:
    coverage = spark.createDataFrame([("click", "anchorClosed"), ("view", "draining"), ("error", "deviceLockedDeferred")], "type string, state string")
    return Archive(adapters.sample(spark, sf_dir), adapters.measures(spark), coverage, now="2024-02-01 00:00:00")


_STANDING = "CASE WHEN type = 'click' THEN 'complete' WHEN type IN ('view', 'error') THEN 'incomplete' ELSE 'untold' END"


@query(f"""WITH {SAMPLE_SQL} SELECT type, count(*)::BIGINT AS records, max(unit) AS unit, min(start_ts) AS earliest, max(start_ts) AS latest, {_STANDING} AS standing,
  CASE type WHEN 'click' THEN 'stopped' WHEN 'view' THEN 'arriving' WHEN 'error' THEN 'paused' ELSE 'unknown' END AS motion, type = 'click' AS licenses_latest FROM sample GROUP BY type""")
def tool_list_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question which types there are, SRT-02."""
    return _archive(spark, sf_dir).list_health_types()


@query(f"""WITH {SAMPLE_SQL}, t AS (SELECT type, count(*) AS n, min(start_ts) AS a, max(start_ts) AS b, {_STANDING} AS standing FROM sample GROUP BY type)
SELECT sum(n)::BIGINT AS records, count(*)::BIGINT AS types, min(a) AS earliest, max(b) AS latest, count(*) FILTER (WHERE standing = 'incomplete')::BIGINT AS unfinished, count(*) FILTER (WHERE standing = 'untold')::BIGINT AS untold FROM t""")
def tool_summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question what there is altogether, AGG-22."""
    return _archive(spark, sf_dir).summarise_health_data()


@query(f"""WITH {SAMPLE_SQL} SELECT 'click' AS type, count(*)::BIGINT AS records, count(value) FILTER (WHERE start_ts >= TIMESTAMP '2024-01-02')::BIGINT AS inside, 'complete' AS standing,
  CASE WHEN count(*) = 0 THEN 'no_such_type' WHEN count(value) FILTER (WHERE start_ts >= TIMESTAMP '2024-01-02') > 0 THEN 'has_values' ELSE 'gap' END AS reason FROM sample WHERE type = 'click'""")
def tool_explain_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-06, STA-07, FLT-05, FLT-06: why there is nothing to show."""
    return _archive(spark, sf_dir).explain_empty_series("click", 30)


@query("""SELECT event_id AS id, ts AS at, valence, CASE WHEN valence < -0.6 THEN 'very unpleasant' WHEN valence < -0.2 THEN 'unpleasant' WHEN valence < 0.2 THEN 'neutral' WHEN valence < 0.6 THEN 'pleasant' ELSE 'very pleasant' END AS band
FROM (SELECT *, (event_id % 201 - 100) / 100.0::DOUBLE AS valence FROM events) WHERE ts >= TIMESTAMP '2023-11-03' ORDER BY ts DESC, event_id LIMIT 100""")
def tool_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question of moods, newest first."""
    archive = _archive(spark, sf_dir)
    archive.mood = adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), ((F.col("event_id") % 201 - 100) / 100).cast("double").alias("valence"))
    return archive.list_mood_entries()


@query("""WITH p AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber)::BIGINT * 500 AS points FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderdate AS start_ts, nullif(o_orderkey % 8 * 500, 0) AS expected, coalesce(points, 0)::BIGINT AS points, coalesce(o_orderkey % 8 > 0 AND coalesce(points, 0) >= o_orderkey % 8 * 500, false) AS complete
FROM orders LEFT JOIN p ON k = o_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def tool_ecg_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question of recordings, newest first."""
    archive, o = _archive(spark, sf_dir), adapters.table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 8 * 500
    archive.ecg = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start_ts"), F.when(n > 0, n).alias("expected"))
    archive.ecg_pages = pages.latest(adapters.pages(spark, sf_dir), ["sample_id", "sequence"], ["seq"])
    return archive.list_electrocardiograms()
