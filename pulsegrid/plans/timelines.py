"""Queries: intervals, paged series, waveforms and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import bucket_plan, bucket_start, iso_text, local_ts
from pulsegrid.operators import domain, intervals, pages, series, stats
from pulsegrid.plans.bucketed import ISLANDS_SQL
from pulsegrid.plans.register import query
from pulsegrid.schema import T_CRITICAL
from pulsegrid.sources import adapters, formats
from pulsegrid.sources.adapters import PAGES_SQL, SAMPLE_SQL


@query(f"WITH {SAMPLE_SQL}, {ISLANDS_SQL} SELECT * FROM island")
def interval_islands_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01."""
    return intervals.union_islands(adapters.sample(spark, sf_dir))


@query(f"""WITH {SAMPLE_SQL}, {ISLANDS_SQL} SELECT type, date_trunc('day', end_ts - INTERVAL 1 MICROSECOND)::TIMESTAMP AS bucket_start, sum(epoch_us(end_ts) - epoch_us(start_ts))::BIGINT / 1e6::DOUBLE AS seconds
FROM island GROUP BY ALL""")
def union_seconds_per_day_end_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, T4: filed in (lo, hi]."""
    return series.union_by_bucket(adapters.sample(spark, sf_dir), "day", "UTC").select("type", "bucket_start", "seconds")


@query(f"""WITH {SAMPLE_SQL}, {ISLANDS_SQL}, u AS (SELECT type, sum(epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS united FROM island GROUP BY type),
n AS (SELECT type, sum(epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS added FROM iv GROUP BY type)
SELECT type, round(united, 3) AS united, round(added, 3) AS added FROM u JOIN n USING (type)""")
def union_vs_naive_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: time covered against durations added."""
    rows = adapters.sample(spark, sf_dir).where("end_ts > start_ts")
    took = F.sum(series.seconds_between(F.col("start_ts"), F.col("end_ts")))
    united = intervals.union_islands(rows).groupBy("type").agg(F.round(took, 3).alias("united"))
    return united.join(rows.groupBy("type").agg(F.round(took, 3).alias("added")), "type")


@query(f"""WITH {SAMPLE_SQL} SELECT w.id AS workout_id, count(*)::BIGINT AS readings, round(sum(h.value), 2) AS total, min(h.value) AS lowest, max(h.value) AS highest
FROM sample w JOIN sample h ON w.type = 'purchase' AND h.type = 'click' AND h.start_ts >= w.start_ts AND h.start_ts <= w.end_ts AND h.value IS NOT NULL GROUP BY w.id""")
def workout_hr_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09: both ends included; an equi-join on time slots."""
    s = adapters.sample(spark, sf_dir)
    spans = s.where("type = 'purchase'").select(F.lit(1).alias("person"), F.col("id").alias("workout_id"), F.col("start_ts").alias("span_start"), F.col("end_ts").alias("span_end"))
    points = s.where("type = 'click' and value is not null").select(F.lit(1).alias("person"), F.col("start_ts").alias("at"), "value")
    met = intervals.contained(points, spans, "person", 1800)
    return met.groupBy("workout_id").agg(F.count(F.lit(1)).alias("readings"), F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("""WITH e AS (SELECT event_type AS type, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e)
SELECT type, min(ts) AS session_start, max(ts) AS session_end, count(*)::BIGINT AS events FROM g GROUP BY type, s""")
def session_coalesce_3s_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08."""
    return intervals.sessions(adapters.sample(spark, sf_dir), "type", "start_ts")


@query("""WITH s AS (SELECT o_orderkey % 50 AS type, date_trunc('day', o_orderdate) + to_hours(((o_orderkey % 3) * 8)::INTEGER) AS start_ts, date_trunc('day', o_orderdate) + INTERVAL 24 HOUR AS end_ts FROM orders),
c AS (SELECT type, date_trunc('day', end_ts)::TIMESTAMP AS bucket_start, count(*) AS n FROM s GROUP BY ALL),
d AS (SELECT type, start_ts::DATE AS day, min(start_ts) AS a FROM s GROUP BY ALL), g AS (SELECT *, day - (row_number() OVER (PARTITION BY type ORDER BY day))::INTEGER AS grp,
  a = day::TIMESTAMP AS glued FROM d),
i AS (SELECT *, sum(CASE WHEN glued AND prev = day - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM (SELECT *, lag(day) OVER (PARTITION BY type ORDER BY day) AS prev FROM g)),
u AS (SELECT type, min(a) AS a, max(day) AS last FROM i GROUP BY type, isl),
b AS (SELECT type, last::TIMESTAMP AS bucket_start, sum(epoch_us((last + 1)::TIMESTAMP) - epoch_us(a)) / 1e6 AS seconds FROM u GROUP BY ALL)
SELECT coalesce(c.type, b.type) AS type, coalesce(c.bucket_start, b.bucket_start) AS bucket_start, coalesce(n, 0)::BIGINT AS n, round(coalesce(seconds, 0.0)::DOUBLE, 3) AS seconds
FROM c FULL JOIN b ON c.type = b.type AND c.bucket_start = b.bucket_start""")
def duration_counts_vs_seconds_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: what ends at midnight counts in the new day and has its seconds in the old one."""
    day = F.to_date("o_orderdate").cast("timestamp_ntz")
    rows = adapters.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("type"), (day + F.make_dt_interval(hours=(F.col("o_orderkey") % 3 * 8).cast("int"))).alias("start_ts"), (day + F.expr("interval 24 hours")).alias("end_ts"))
    counts = rows.groupBy("type", series.bucket_start(F.col("end_ts"), "day", "UTC").alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(series.union_by_bucket(rows, "day", "UTC"), ["type", "bucket_start"], "full")
    return both.select("type", "bucket_start", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("seconds", F.lit(0.0)), 3).alias("seconds"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.latest(adapters.pages(spark, sf_dir), ["sample_id", "sequence"], ["seq"])


@query(f'WITH {PAGES_SQL} SELECT sample_id, sequence, "offset", "count", part FROM page')
def pages_latest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAG-08: a replay overwrites."""
    return _pages(spark, sf_dir).select("sample_id", "sequence", "offset", "count", "part")


_CHAIN = f"""WITH {PAGES_SQL}, e AS (SELECT *, lag("offset" + greatest("count", 1)) OVER (PARTITION BY sample_id ORDER BY "offset") AS expected FROM page), c AS (
  SELECT sample_id, count(*)::BIGINT AS pages, sum("count")::BIGINT AS points, min("offset")::BIGINT AS first_offset, coalesce(sum(CASE WHEN expected IS NOT NULL AND "offset" <> expected THEN 1 ELSE 0 END), 0)::BIGINT AS gaps,
    coalesce(sum(CASE WHEN expected IS NOT NULL THEN greatest("offset" - expected, 0) ELSE 0 END), 0)::BIGINT AS missing, max("offset" + "count")::BIGINT AS reach
  FROM e GROUP BY sample_id
), h AS (SELECT o_orderkey AS sample_id, nullif(o_orderkey % 8 * 500, 0) AS expected FROM orders)"""


@query(f"{_CHAIN} SELECT * FROM c")
def page_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05."""
    return pages.contiguity(_pages(spark, sf_dir))


@query(f"""{_CHAIN} SELECT h.sample_id, expected, coalesce(pages, 0) AS pages, coalesce(points, 0) AS points, coalesce(gaps, 0) AS gaps,
  coalesce(expected > 0 AND coalesce(points, 0) >= expected, false) AS complete_by_count,
  coalesce(expected > 0 AND coalesce(points, 0) >= expected AND gaps = 0 AND first_offset = 0, false) AS complete FROM h LEFT JOIN c USING (sample_id)""")
def header_page_left_join_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-05, T13: an unknown count is never complete."""
    return pages.header_completeness(adapters.headers(spark, sf_dir), _pages(spark, sf_dir))


@query(f"""{_CHAIN} SELECT c.sample_id, gaps + 1 AS segments, points AS present, (missing + first_offset + CASE WHEN expected IS NULL THEN 0 ELSE greatest(expected - points - missing - first_offset, 0) END)::BIGINT AS missing,
  (missing + first_offset + CASE WHEN expected IS NULL THEN 0 ELSE greatest(expected - points - missing - first_offset, 0) END) = 0 AND gaps = 0 AND expected IS NOT NULL AS complete
FROM c LEFT JOIN h USING (sample_id)""")
def route_segments_missing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAG-05."""
    declared = adapters.headers(spark, sf_dir).withColumnRenamed("expected", "declared")
    return pages.segments(_pages(spark, sf_dir), declared)


@query(f"""{_CHAIN}, d AS (SELECT sample_id, "offset", "count", CASE WHEN part % 7 = 0 THEN 400 ELSE 500 END::BIGINT AS decoded FROM page), x AS (
  SELECT *, coalesce(lag("offset" + decoded) OVER (PARTITION BY sample_id ORDER BY "offset"), 0) AS expected_at FROM d
), y AS (SELECT sample_id, sum(decoded)::BIGINT AS points, sum((CASE WHEN "offset" <> expected_at THEN 1 ELSE 0 END) + (CASE WHEN decoded < "count" THEN 1 ELSE 0 END)) AS lost, max_by("offset" + decoded, "offset") AS fin FROM x GROUP BY sample_id)
SELECT y.sample_id, points, (lost + CASE WHEN fin < h.expected THEN 1 ELSE 0 END)::BIGINT AS missing_pages FROM y LEFT JOIN h USING (sample_id)""")
def route_reassembly_missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAG-04: a page that holds less than it claims leaves a hole behind it."""
    rows = _pages(spark, sf_dir).withColumn("decoded", F.when(F.col("part") % 7 == 0, 400).otherwise(500).cast("long"))
    return pages.route_gaps(rows, adapters.headers(spark, sf_dir).withColumnRenamed("expected", "declared"))


_ROUTES_SQL = """WITH page AS (SELECT l_orderkey AS w, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber % 2 ELSE 0 END AS r, l_linenumber AS line, max(l_partkey) AS part FROM lineitem GROUP BY ALL HAVING max(l_partkey) % 4 <> 0),
d AS (SELECT w, r, CASE WHEN w % 2 = 0 THEN line // 2 ELSE line - 1 END * 2 AS spot, CASE WHEN part % 5 = 0 THEN 1 ELSE 2 END AS decoded, part FROM page),
route AS (SELECT o_orderkey AS w, r, row_number() OVER (PARTITION BY o_orderkey ORDER BY r DESC) - 1 AS ordinal, o_orderkey % 9 AS declared FROM orders, LATERAL (SELECT unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0, 1] ELSE [0] END) AS r)),
x AS (SELECT *, coalesce(lag(spot + decoded) OVER (PARTITION BY w, r ORDER BY spot), 0) AS expected FROM d),
y AS (SELECT w, r, sum(decoded) AS points, sum((CASE WHEN spot <> expected THEN 1 ELSE 0 END) + (CASE WHEN decoded < 2 THEN 1 ELSE 0 END)) AS lost, max_by(spot + decoded, spot) AS fin FROM x GROUP BY ALL)"""


def _route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workouts, those of even keys with two routes of which the second begins first; lines as their pages, some of which are missing or hold too little."""
    o, text = adapters.table(spark, sf_dir, "orders"), lambda *cs: F.to_json(F.struct(*cs)).alias("value")
    name = lambda key, r: F.concat(F.col(key).cast("string"), F.lit("-"), r.cast("string"))
    routes = o.select("*", F.explode(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("r"))
    start = iso_text(F.col("o_orderdate") - F.make_dt_interval(hours=F.col("r")))
    id_ = name("o_orderkey", F.col("r"))
    heads = routes.select(text(id_.alias("id"), F.lit("HKWorkoutRouteTypeIdentifier").alias("type"), F.lit("workoutRoute").alias("kind"), start.alias("startDate"), F.struct(F.col("o_orderkey").cast("string").alias("id")).alias("workout")))
    ends = routes.select(text(F.concat(id_, F.lit("e")).alias("id"), F.lit("t").alias("type"), F.lit("workoutRouteEnd").alias("kind"), start.alias("startDate"), id_.alias("sample"), (F.col("o_orderkey") % 9).alias("locations")))
    page = adapters.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(F.max("l_partkey").alias("part")).where("part % 4 <> 0")
    r, even = F.when(F.col("l_orderkey") % 2 == 0, F.col("line") % 2).otherwise(0), F.col("l_orderkey") % 2 == 0
    spot = lambda n: F.struct((F.col("part") / 100_000 + n).alias("latitude"), F.when(F.lit(n == 0) | (F.col("part") % 5 != 0), F.col("line") + F.lit(0.5)).alias("longitude"))
    at = F.when(even, F.floor(F.col("line") / 2)).otherwise(F.col("line") - 1) * 2
    route_id = name("l_orderkey", r)
    pages_ = page.select(text(F.concat(route_id, F.lit("p"), F.col("line")).alias("id"), F.lit("t").alias("type"), F.lit("workoutRouteLocations").alias("kind"), F.lit("2024-01-01T00:00:00.000Z").alias("startDate"), route_id.alias("sample"), at.alias("offset"), F.lit(2).alias("count"), F.array(spot(0), spot(1)).alias("locations")))
    return heads.unionByName(ends).unionByName(pages_)


@query(f"""{_ROUTES_SQL} SELECT w::VARCHAR AS workout_id, count(*)::BIGINT AS routes, sum(coalesce(points, 0))::BIGINT AS points,
  sum(coalesce(lost + CASE WHEN fin < declared THEN 1 ELSE 0 END, CASE WHEN declared > 0 THEN 1 ELSE 0 END) + CASE WHEN ordinal > 0 THEN 1 ELSE 0 END)::BIGINT AS missing_pages,
  sum(coalesce(lost + CASE WHEN fin < declared THEN 1 ELSE 0 END, CASE WHEN declared > 0 THEN 1 ELSE 0 END) + CASE WHEN ordinal > 0 THEN 1 ELSE 0 END) = 0 AS complete
FROM route LEFT JOIN y USING (w, r) GROUP BY w HAVING sum(coalesce(points, 0)) > 0""")
def routes_of_workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-08, PAG-04: routes joined to their workouts through the records, several in the order of their starts, each further one a gap."""
    return pages.workout_routes(formats.route(_route_lines(spark, sf_dir)))


@query(f"""{_ROUTES_SQL}, p AS (SELECT w, r, ordinal, spot, part, unnest(range(decoded)) AS k FROM d JOIN route USING (w, r))
SELECT w::VARCHAR AS workout_id, ordinal::INTEGER AS ordinal, (row_number() OVER (PARTITION BY w ORDER BY ordinal, spot, k) - 1)::BIGINT AS position, round(part / 100000 + k, 5) AS latitude FROM p""")
def route_points_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAG-04: the points of a workout's routes one after the other, by running offsets."""
    rows = pages.workout_route_points(formats.route(_route_lines(spark, sf_dir)))
    return rows.select("workout_id", "ordinal", "position", F.round("latitude", 5).alias("latitude"))


@query("""WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-03-08 20:00:00' ELSE TIMESTAMP '2024-11-01 20:00:00' END + to_minutes((event_id * 7919 % 7200)::INTEGER) AS moment FROM events),
plan AS (SELECT unnest(range(TIMESTAMP '2024-03-09 05:00:00', TIMESTAMP '2024-03-12 04:00:00', INTERVAL 1 HOUR)) AS h UNION ALL SELECT unnest(range(TIMESTAMP '2024-11-02 04:00:00', TIMESTAMP '2024-11-05 05:00:00', INTERVAL 1 HOUR)))
SELECT h AS bucket_start, h + INTERVAL 1 HOUR AS bucket_end, strftime(h - CASE WHEN h >= TIMESTAMP '2024-03-10 07:00:00' AND h < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%d %H:%M') AS wall, count(moment)::BIGINT AS n
FROM plan LEFT JOIN e ON date_trunc('hour', moment) = h GROUP BY h""")
def hour_plan_over_clock_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-05: the hours of three days around both clock changes of a year in New York, 71 and 73 of them, empty ones too."""
    n = F.col("event_id")
    begin = F.when(n % 2 == 0, F.expr("timestamp_ntz'2024-03-08 20:00:00'")).otherwise(F.expr("timestamp_ntz'2024-11-01 20:00:00'"))
    at = adapters.table(spark, sf_dir, "events").select((begin + F.make_dt_interval(mins=(n * 7919 % 7200).cast("int"))).cast("timestamp_ntz").alias("at"))
    zone = "America/New_York"
    counts = at.groupBy(bucket_start(F.col("at"), "hour", zone).alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))
    plan = bucket_plan(spark, "2024-03-09 00:00:00", "2024-03-11 23:00:00", "hour", tz=zone).unionByName(bucket_plan(spark, "2024-11-02 00:00:00", "2024-11-04 23:00:00", "hour", tz=zone))
    met = plan.join(counts, "bucket_start", "left")
    return met.select("bucket_start", "bucket_end", F.date_format(local_ts(F.col("bucket_start"), zone), "dd HH:mm").alias("wall"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""{_CHAIN} SELECT c.sample_id, points AS held, expected AS declared, CASE WHEN expected IS NULL THEN 'unknown' WHEN points >= expected THEN 'complete' ELSE 'incomplete' END AS state FROM c LEFT JOIN h USING (sample_id)""")
def declared_vs_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20."""
    return pages.held_against_declared(_pages(spark, sf_dir), adapters.headers(spark, sf_dir).withColumnRenamed("expected", "declared"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, pos // 5 AS sequence, min(pos)::BIGINT AS "offset", count(*)::BIGINT AS "count" FROM e GROUP BY ALL""")
def page_split_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAG-06, with pages of 5 so that these short series have several."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return pages.split_pages(adapters.table(spark, sf_dir, "events").select("user_id", pos.alias("pos")), "user_id", 5)


_WAVE = """w AS (SELECT vec_id AS id, (i - 1)::INTEGER AS pos, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


@query(f"WITH {_WAVE} SELECT id, pos, pos / 512.0::DOUBLE AS seconds, value FROM w")
def waveform_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAG-01."""
    return pages.explode_wave(adapters.waveform(spark, sf_dir), "id", "embedding", 512)


@query(f"""WITH {_WAVE}, b AS (SELECT i AS bucket, floor(i * 64.0 / 16)::INTEGER AS lo, floor((i + 1) * 64.0 / 16)::INTEGER AS hi FROM range(16) r(i))
SELECT id, bucket::INTEGER AS bucket, min(pos) / 512.0::DOUBLE AS seconds, min(value) AS low, max(value) AS high FROM w JOIN b ON pos >= lo AND pos < hi GROUP BY ALL""")
def waveform_envelope_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAG-07."""
    return pages.envelope(pages.explode_wave(adapters.waveform(spark, sf_dir), "id", "embedding", 512), "id", 16)


@query(f"""WITH {_WAVE} SELECT id, (pos // 6)::INTEGER AS bucket, min(pos) / 512.0::DOUBLE AS seconds, min(value) AS low, max(value) AS high FROM w GROUP BY ALL""")
def waveform_stride_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-04: the other reducer; 64 points in 10 columns make a stride of 6."""
    return pages.stride_envelope(pages.explode_wave(adapters.waveform(spark, sf_dir), "id", "embedding", 512), "id", 10)


_T = "CASE WHEN n - 2 <= 0 THEN 12.706 WHEN n - 2 > 120 THEN 1.96 " + " ".join(f"WHEN n - 2 >= {d} THEN {t}" for d, t in reversed(T_CRITICAL)) + " END::DOUBLE"


def _trend_sql(source: str) -> str:
    return f"""t AS (
  SELECT type, count(*)::BIGINT AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, avg(y) AS my, min(x) AS x0, max(x) AS x1
  FROM (SELECT type, (day - DATE '1970-01-01')::DOUBLE AS x, value AS y FROM {source}) GROUP BY type
), t2 AS (
  SELECT *, sxy / nullif(sxx, 0) AS slope, greatest(0.0, syy - coalesce(sxy * sxy / nullif(sxx, 0), 0.0)) AS rss FROM t
), t3 AS (
  SELECT *, sqrt(rss / greatest(n - 2, 1) / nullif(sxx, 0)) * {_T} AS margin, CASE WHEN syy > 0 THEN greatest(0.0, 1 - rss / syy) ELSE 0.0 END AS r2 FROM t2
), t4 AS (
  SELECT *, slope - margin AS low, slope + margin AS high, coalesce(slope - margin > 0 OR slope + margin < 0, false) AS sure FROM t3
), trend AS (
  SELECT type, n AS days, CASE WHEN n < 14 THEN 'refused_min_days' WHEN sxx <= 0 THEN 'no_variation' WHEN NOT sure THEN 'not_detectable' WHEN r2 < 0.2 THEN 'weak_fit' ELSE 'ok' END AS status,
    CASE WHEN n < 14 OR sxx <= 0 OR NOT sure THEN 'none' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction,
    CASE WHEN n >= 14 AND sxx > 0 THEN slope END AS slope, CASE WHEN n >= 14 AND sxx > 0 THEN slope * 7 END AS per_week, CASE WHEN n >= 14 AND sxx > 0 THEN low END AS ci_low, CASE WHEN n >= 14 AND sxx > 0 THEN high END AS ci_high,
    CASE WHEN n >= 14 AND sxx > 0 THEN my + slope * (x0 - mx) END AS start_value, CASE WHEN n >= 14 AND sxx > 0 THEN my + slope * (x1 - mx) END AS end_value, CASE WHEN n >= 14 AND sxx > 0 THEN r2 END AS r_squared
  FROM t4
)"""


_TREND_OUT = "SELECT type, days, status, direction, round(slope, 5) AS slope, round(per_week, 5) AS per_week, round(ci_low, 5) AS ci_low, round(ci_high, 5) AS ci_high, round(start_value, 5) AS start_value, round(end_value, 5) AS end_value, round(r_squared, 5) AS r_squared FROM trend"
_TREND_ROUNDED = ("slope", "per_week", "ci_low", "ci_high", "start_value", "end_value", "r_squared")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and records of each type and day."""
    rows = adapters.sample(spark, sf_dir).where("value is not null").groupBy("type", F.to_date("start_ts").alias("day")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("records"))
    return rows.select("type", "day", (F.round("s", 2) / F.col("records")).alias("value"), "records")


_DAILY = f"""{SAMPLE_SQL}, daily AS (
  SELECT type, start_ts::DATE AS day, round(sum(value), 2) / count(*) AS value, count(*)::BIGINT AS records FROM sample WHERE value IS NOT NULL GROUP BY ALL)"""


def _round(df: DataFrame, columns: tuple[str, ...], digits: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {_DAILY}, {_trend_sql('daily')} {_TREND_OUT}")
def trend_ols_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-01, STA-02, T10."""
    return _round(stats.trend(_daily(spark, sf_dir), ["type"]), _TREND_ROUNDED)


@query(f"WITH {_DAILY}, {_trend_sql('daily')} {_TREND_OUT}")
def trend_ols_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-01, STA-02 over all days of all types."""
    return _round(stats.trend(_daily(spark, sf_dir), ["type"]), _TREND_ROUNDED)


@query(f"""WITH {_DAILY}, o AS (SELECT o_orderpriority AS type, o_orderdate::DATE AS day, sum(o_totalprice) AS value FROM orders GROUP BY ALL), mix AS (
  SELECT type, day, value FROM daily UNION ALL SELECT type, day, round(value, 2) FROM o UNION ALL SELECT 'flat', day, 5.0 FROM daily WHERE type = 'click'
), {_trend_sql('mix')} SELECT type, days, status FROM trend""")
def refusals_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-08, T20: refusals are rows; a constant series has a trend of 0."""
    d = _daily(spark, sf_dir).select("type", "day", "value")
    o = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("type"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    flat = d.where("type = 'click'").select(F.lit("flat").alias("type"), "day", F.lit(5.0).alias("value"))
    return stats.trend(d.unionByName(o).unionByName(flat), ["type"]).select("type", "days", "status")


_LAG = """{name} AS (SELECT pair, CASE WHEN count(*) > 2 THEN greatest(0.0, coalesce(CASE WHEN regr_sxx(v, p) > 0 AND regr_syy(v, p) > 0 THEN regr_sxy(v, p) / sqrt(regr_sxx(v, p) * regr_syy(v, p)) END, 0.0)) ELSE 0.0 END AS lag
  FROM (SELECT pair, {c} AS v, lag({c}) OVER (PARTITION BY pair ORDER BY day) AS p FROM both_days) GROUP BY pair)"""
_CORRELATION = f"""WITH {_DAILY}, o AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'a' ELSE 'b' END AS type, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL), both_days AS (
  SELECT a.type || '-' || b.type AS pair, a.day, a.value AS x, b.value AS y FROM daily a JOIN daily b ON a.day = b.day AND a.type < b.type
  UNION ALL SELECT 'orders', a.day, a.value, b.value FROM o a JOIN o b ON a.day = b.day AND a.type = 'a' AND b.type = 'b'
  UNION ALL SELECT 'flat', day, value, 1.0 FROM o WHERE type = 'a'
), {_LAG.format(name="lx", c="x")}, {_LAG.format(name="ly", c="y")}, {_trend_sql("(SELECT pair AS type, day, x AS value FROM both_days)").replace("trend AS", "trx AS")}, {_trend_sql("(SELECT pair AS type, day, y AS value FROM both_days)").replace("t AS (", "s AS (", 1).replace("FROM t)", "FROM s)").replace("t2 AS", "s2 AS").replace("FROM t\n", "FROM s\n").replace("t3 AS", "s3 AS").replace("FROM t2", "FROM s2").replace("t4 AS", "s4 AS").replace("FROM t3", "FROM s3").replace("trend AS", "try_ AS").replace("FROM t4", "FROM s4")}, r AS (
  SELECT pair, count(*)::BIGINT AS n, CASE WHEN regr_sxx(x, y) > 0 AND regr_syy(x, y) > 0 THEN regr_sxy(x, y) / sqrt(regr_sxx(x, y) * regr_syy(x, y)) END AS r FROM both_days GROUP BY pair
), e AS (SELECT r.*, least(n::DOUBLE, greatest(3.0, n * greatest(0.0, (1 - lx.lag * ly.lag) / (1 + lx.lag * ly.lag)))) AS eff FROM r JOIN lx USING (pair) JOIN ly USING (pair)
), ci AS (SELECT *, CASE WHEN eff > 3 THEN tanh(atanh(least(greatest(r, -0.999999), 0.999999)) - 1.96 * sqrt(1.0 / (eff - 3))) ELSE -1.0 END AS low, CASE WHEN eff > 3 THEN tanh(atanh(least(greatest(r, -0.999999), 0.999999)) + 1.96 * sqrt(1.0 / (eff - 3))) ELSE 1.0 END AS high FROM e
), st AS (SELECT *, CASE WHEN n < 28 THEN 'refused_min_days' WHEN r IS NULL THEN 'no_variation' WHEN (low > 0 OR high < 0) AND eff >= 10 THEN 'ok' ELSE 'not_detectable' END AS status FROM ci)
SELECT pair, n AS days, st.status, CASE WHEN st.status IN ('ok', 'not_detectable') THEN round(r, 5) END AS r, CASE WHEN st.status IN ('ok', 'not_detectable') THEN round(eff, 4) END AS effective_days,
  CASE WHEN st.status IN ('ok', 'not_detectable') THEN round(low, 5) END AS ci_low, CASE WHEN st.status IN ('ok', 'not_detectable') THEN round(high, 5) END AS ci_high,
  CASE WHEN st.status IN ('ok', 'not_detectable') THEN CASE WHEN abs(r) < 0.2 THEN 'negligible' WHEN abs(r) < 0.4 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' WHEN abs(r) < 0.8 THEN 'strong' ELSE 'very strong' END END AS strength,
  CASE WHEN st.status IN ('ok', 'not_detectable') THEN trx.status IN ('ok', 'weak_fit') AND try_.status IN ('ok', 'weak_fit') END AS both_trending
FROM st JOIN trx ON trx.type = pair JOIN try_ ON try_.type = pair"""


@query(_CORRELATION)
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-03, STA-04, T11, T20, B13: all pairs of types over the days that both have."""
    return _correlation(spark, sf_dir, _daily(spark, sf_dir))


@query(_CORRELATION)
def correlation_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-03, STA-04 over all days of all types."""
    return _correlation(spark, sf_dir, _daily(spark, sf_dir))


def _correlation(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    a, b = d.select(F.col("type").alias("ta"), "day", F.col("value").alias("x")), d.select(F.col("type").alias("tb"), "day", F.col("value").alias("y"))
    pairs = a.join(b, "day").where("ta < tb").select(F.concat_ws("-", "ta", "tb").alias("pair"), "day", "x", "y")
    o = adapters.table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    o = o.groupBy(F.to_date("o_orderdate").alias("day"), "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    urgent, low = o.where("o_orderpriority = '1-URGENT'").select("day", F.col("v").alias("x")), o.where("o_orderpriority = '5-LOW'").select("day", F.col("v").alias("y"))
    more = urgent.join(low, "day").select(F.lit("orders").alias("pair"), "day", "x", "y").unionByName(urgent.select(F.lit("flat").alias("pair"), "day", "x", F.lit(1.0).alias("y")))
    out = stats.correlation(pairs.unionByName(more), ["pair"])
    return _round(_round(out, ("r", "ci_low", "ci_high")), ("effective_days",), 4)


_LAG_ONE = f"""WITH {_DAILY}, l AS (SELECT type, value AS v, lag(value) OVER (PARTITION BY type ORDER BY day) AS p FROM daily)
SELECT type, count(*)::BIGINT AS n, round(CASE WHEN count(*) > 2 THEN greatest(0.0, coalesce(regr_sxy(v, p) / nullif(sqrt(regr_sxx(v, p) * regr_syy(v, p)), 0), 0.0)) ELSE 0.0 END, 6) AS lag1 FROM l GROUP BY type"""


@query(_LAG_ONE)
def lag1_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04, T11: by row, not by day."""
    return _round(stats.lag_one(_daily(spark, sf_dir), ["type"]), ("lag1",), 6)


@query(_LAG_ONE)
def lag1_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04 over all days of all types."""
    return _round(stats.lag_one(_daily(spark, sf_dir), ["type"]), ("lag1",), 6)


_JUDGED = """f AS (SELECT key, count(*)::BIGINT AS days, greatest(1.0, median(records) * 0.34) AS floor FROM d GROUP BY key),
k AS (SELECT d.*, days, floor, records >= floor AS judged FROM d JOIN f USING (key)),
c AS (SELECT key, median(value) AS centre, count(*)::BIGINT AS judged_days FROM k WHERE judged GROUP BY key),
z AS (SELECT key, median(abs(value - centre)) * 1.4826 AS scaled FROM k JOIN c USING (key) WHERE judged GROUP BY key)"""
_ORDER_DAYS = "d AS (SELECT o_orderpriority AS key, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS value, count(*)::BIGINT AS records FROM orders GROUP BY ALL)"


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).alias("records"))


@query(f"""WITH {_ORDER_DAYS}, {_JUDGED} SELECT key, day, value, records, round((value - centre) / scaled, 5) AS deviations FROM k JOIN c USING (key) JOIN z USING (key)
WHERE judged AND days >= 14 AND judged_days >= 14 AND scaled > 0 AND abs((value - centre) / scaled) >= 3.0""")
def anomalies_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-05, T18."""
    return _round(stats.anomalies(_order_days(spark, sf_dir), ["key"]), ("deviations",))


@query(f"WITH {_ORDER_DAYS}, {_JUDGED} SELECT key, day, records, round(floor, 4) AS floor FROM k WHERE NOT judged AND days >= 14")
def low_coverage_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-05: days that were hardly measured are no outliers."""
    return _round(stats.low_coverage(_order_days(spark, sf_dir), ["key"]), ("floor",), 4)


@query(f"""WITH {_ORDER_DAYS}, {_JUDGED} SELECT key, days, judged_days AS considered, (days - judged_days)::BIGINT AS low_days, round(centre, 4) AS median, round(scaled, 4) AS deviation, CASE WHEN scaled > 0 THEN 'ok' ELSE 'no_variation' END AS status
FROM f JOIN c USING (key) JOIN z USING (key)""")
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.anomaly_report(_order_days(spark, sf_dir), ["key"]), ("median", "deviation"), 4)


@query("""SELECT conv_id AS route, (min(lat) + max(lat)) / 2 AS lat_centre, greatest((max(lat) - min(lat)) * 1.35, 0.004) AS lat_span, (min(lon) + max(lon)) / 2 AS lon_centre, greatest((max(lon) - min(lon)) * 1.35, 0.004) AS lon_span
FROM (SELECT conv_id, length(text) / 16.0::DOUBLE AS lat, turn / 4.0::DOUBLE AS lon FROM conversations) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY conv_id""")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-05, FLT-14: points off the globe are left out."""
    points = adapters.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("route"), (F.char_length("text") / 16.0).cast("double").alias("lat"), (F.col("turn") / 4.0).cast("double").alias("lon"))
    return domain.bounding_box(points, "route")
