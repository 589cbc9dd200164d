"""Queries: buckets, series, histograms, units and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import names, units
from pulsegrid.functions.calendar import bucket_plan
from pulsegrid.operators import series
from pulsegrid.plans.register import query
from pulsegrid.schema import UNITS
from pulsegrid.sources import adapters
from pulsegrid.sources.adapters import SAMPLE_SQL

ZONE = "America/New_York"
_LOCAL = "timezone('America/New_York', {} AT TIME ZONE 'UTC')"

ISLANDS_SQL = """iv AS (SELECT type, start_ts, end_ts FROM sample WHERE end_ts > start_ts), fl AS (
  SELECT *, CASE WHEN max(end_ts) OVER w IS NULL OR start_ts > max(end_ts) OVER w THEN 1 ELSE 0 END AS fresh
  FROM iv WINDOW w AS (PARTITION BY type ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), gr AS (
  SELECT *, sum(fresh) OVER (PARTITION BY type ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM fl
), island AS (
  SELECT type, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*)::BIGINT AS members FROM gr GROUP BY type, island
)"""


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _exact(df: DataFrame) -> DataFrame:
    """Values are cents: sums are exact at two digits, and a mean of such a sum has no digits that depend on the order of adding."""
    df = df.withColumn("sum", F.round("sum", 2)).withColumn("average", F.col("sum") / F.col("count"))
    return df.withColumn("value", F.when(F.col("measure") == "average", F.col("average")).when(F.col("measure") == "total", F.col("sum")).otherwise(F.col("value"))) if "value" in df.columns else df


def _aggregate_sql(where: str = "", low: str = "") -> str:
    return f"""WITH {SAMPLE_SQL}, {ISLANDS_SQL.replace("WHERE end_ts > start_ts", f"WHERE end_ts > start_ts AND type = 'view' {low}")}, sums AS (
  SELECT type, measure, date_trunc('day', filed)::TIMESTAMP AS bucket_start, sum(value) AS s, avg(value) AS a, min(value) AS lo, max(value) AS hi, count(*) AS n, sum(counts) AS c
  FROM m WHERE value IS NOT NULL {where} GROUP BY ALL
), secs AS (
  SELECT type, date_trunc('day', end_ts - INTERVAL 1 MICROSECOND)::TIMESTAMP AS bucket_start, sum(epoch_us(end_ts) - epoch_us(start_ts)) AS micros FROM island GROUP BY ALL
)
SELECT type, bucket_start, measure, round(s, 2) AS sum, round(s, 2) / n AS average, lo AS minimum, hi AS maximum, n::BIGINT AS count, c::BIGINT AS counted,
  CASE measure WHEN 'total' THEN round(s, 2) WHEN 'average' THEN round(s, 2) / n WHEN 'duration' THEN (coalesce(micros, 0)::BIGINT + 500) // 1000 / 1000.0::DOUBLE ELSE c::DOUBLE END AS value
FROM sums LEFT JOIN secs USING (type, bucket_start)"""


@query(_aggregate_sql())
def aggregate_day_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, T1, T4, T5: how much of each type each day."""
    out = series.aggregate(adapters.sample(spark, sf_dir), adapters.measures(spark))
    return _exact(out)


@query(_aggregate_sql("AND filed >= TIMESTAMP '2024-01-05 06:30:00' AND filed <= TIMESTAMP '2024-01-12 18:00:00'", "AND start_ts >= TIMESTAMP '2024-01-03 00:00:00'"))
def aggregate_bounds_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6: both bounds are inclusive, and the union's seconds are not cut at them."""
    out = series.aggregate(adapters.sample(spark, sf_dir), adapters.measures(spark), first="2024-01-05 06:30:00", last="2024-01-12 18:00:00")
    return _exact(out)


def _orders(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    out = series.aggregate(adapters.orders_sample(spark, sf_dir), adapters.order_measures(spark), grain, ZONE)
    return _exact(out.select("type", "bucket_start", "sum", "average", "minimum", "maximum", "count"))


def _orders_sql(key: str) -> str:
    wall = _LOCAL.format("o_orderdate")
    return f"""SELECT type, key AS bucket_start, round(sum(v), 2) AS sum, round(sum(v), 2) / count(*) AS average, min(v) AS minimum, max(v) AS maximum, count(*)::BIGINT AS count
FROM (SELECT o_orderstatus AS type, o_totalprice AS v, ({key.replace("WALL", wall)})::TIMESTAMP AS key FROM orders WHERE o_totalprice IS NOT NULL) GROUP BY ALL"""


@query(_orders_sql("o_orderdate - (WALL - date_trunc('hour', WALL))"))
def aggregate_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19: hours are instants."""
    return _orders(spark, sf_dir, "hour")


@query(_orders_sql("(WALL)::DATE - dayofweek((WALL)::DATE)::INTEGER"))
def aggregate_week_sunday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "week")


@query(_orders_sql("date_trunc('month', WALL)"))
def aggregate_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "month")


@query(_orders_sql("date_trunc('year', WALL)"))
def aggregate_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "year")


def _plan(spark: SparkSession, sample: DataFrame, grain: str = "day") -> DataFrame:
    """The days from the archive's first record to its last: no record is outside the plan."""
    ends = sample.agg(F.min(F.least("start_ts", "end_ts")).alias("first"), F.max(F.greatest("start_ts", "end_ts")).alias("last"))
    day = lambda c: F.date_format(F.date_trunc(grain, c), "yyyy-MM-dd HH:mm:ss")
    first, last = ends.select(day("first"), day("last")).first()
    return bucket_plan(spark, first or "1970-01-01 00:00:00", last or "1970-01-01 00:00:00", grain)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = adapters.sample(spark, sf_dir)
    return series.series(sample, adapters.measures(spark), _plan(spark, sample))


SERIES_SQL = f"""{SAMPLE_SQL}, {ISLANDS_SQL.replace("WHERE end_ts > start_ts", "WHERE end_ts > start_ts AND type = 'view'")}, ends AS (
  SELECT date_trunc('day', min(least(start_ts, end_ts)))::TIMESTAMP AS a, date_trunc('day', max(greatest(start_ts, end_ts)))::TIMESTAMP AS b FROM sample
), plan AS (
  SELECT i::INTEGER AS idx, a + to_days(i::INTEGER) AS bucket_start, a + to_days(i::INTEGER + 1) AS bucket_end FROM (SELECT a, unnest(range(date_diff('day', a, b) + 1)) AS i FROM ends)
), sums AS (
  SELECT type, date_trunc('day', filed)::TIMESTAMP AS bucket_start, count(*) AS samples, sum(counts) AS counted_rows, sum(CASE WHEN counts = 1 THEN value END) AS total,
    sum(CASE WHEN counts = 1 THEN value * reading_count END) AS weighted, sum(CASE WHEN counts = 1 AND value IS NOT NULL THEN reading_count END) AS weight,
    min(CASE WHEN counts = 1 THEN value END) AS minimum, max(CASE WHEN counts = 1 THEN value END) AS maximum, sum(reading_count) AS all_readings,
    count(DISTINCT filed::DATE) AS days, sum(CASE WHEN counts = 1 AND measure <> 'duration' THEN greatest(0, epoch_us(end_ts) - epoch_us(start_ts)) END) AS lasted
  FROM m GROUP BY ALL
), merged AS (
  SELECT type, date_trunc('day', end_ts - INTERVAL 1 MICROSECOND)::TIMESTAMP AS bucket_start, sum(epoch_us(end_ts) - epoch_us(start_ts)) AS micros FROM island GROUP BY ALL
), full_series AS (
  SELECT t.type, t.measure, p.idx, p.bucket_start, p.bucket_end, coalesce(samples, 0)::BIGINT AS samples, coalesce(counted_rows, 0)::BIGINT AS counted_rows, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(all_readings, 0)::BIGINT AS all_readings, coalesce(days, 0)::BIGINT AS days, coalesce(total, 0.0) AS total, coalesce(weighted, 0.0) AS weighted, minimum, maximum,
    round(coalesce(u.micros, lasted, 0)::DOUBLE / 1e6, 3) AS seconds
  FROM (SELECT DISTINCT type, measure FROM m) t CROSS JOIN plan p LEFT JOIN sums s ON s.type = t.type AND s.bucket_start = p.bucket_start
  LEFT JOIN merged u ON u.type = t.type AND u.bucket_start = p.bucket_start
)"""


@query(f"WITH {SERIES_SQL} SELECT * REPLACE (round(total, 4) AS total, round(weighted, 2) AS weighted) FROM full_series")
def series_day_with_empty_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, JON-04, T7: empty buckets are there, with no extremes."""
    return _rounded(_rounded(_series(spark, sf_dir), "total", digits=4), "weighted", digits=2)


@query(f"WITH {SERIES_SQL} SELECT type, bucket_start, round(weighted / weight, 6) AS average FROM full_series WHERE weight > 0 AND measure = 'average'")
def series_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03, T1: weighted by readings."""
    rows = _series(spark, sf_dir).where("measure = 'average' and weight > 0")
    return rows.select("type", "bucket_start", F.round(series.column_value(F.lit(False)), 6).alias("average"))


@query(f"""WITH {SERIES_SQL} SELECT type, measure,
  round(CASE measure WHEN 'total' THEN sum(total) WHEN 'average' THEN sum(weighted) / sum(weight) WHEN 'duration' THEN sum(seconds) ELSE sum(counted_rows)::DOUBLE END, 4) AS headline,
  min(minimum) AS lowest, max(maximum) AS highest, sum(samples)::BIGINT AS samples, sum(all_readings)::BIGINT AS readings FROM full_series GROUP BY type, measure""")
def series_headline_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, T2, T9."""
    return _rounded(series.headline(_series(spark, sf_dir), series.unit_guard(adapters.sample(spark, sf_dir))), "headline", digits=4)


@query(f"""WITH {SERIES_SQL} SELECT type, sum(days)::BIGINT AS days_with_data, count(*)::BIGINT AS days, min(CASE WHEN samples > 0 THEN bucket_start END) AS first_bucket,
  max(CASE WHEN samples > 0 THEN bucket_start END) AS last_bucket, min(CASE WHEN samples > 0 THEN idx END)::BIGINT AS leading_empty FROM full_series GROUP BY type""")
def series_coverage_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.coverage(_series(spark, sf_dir))


@query(f"WITH {SAMPLE_SQL} SELECT type, count(*)::BIGINT AS records, max(unit) AS unit, min(start_ts) AS earliest, max(start_ts) AS latest FROM sample GROUP BY type")
def type_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.type_summaries(adapters.sample(spark, sf_dir))


@query("SELECT min(ts) AS earliest, max(ts) AS latest FROM events")
def archive_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.span(adapters.sample(spark, sf_dir))


@query(f"SELECT date_trunc('day', {_LOCAL.format('ts')})::TIMESTAMP AS bucket_start, count(*)::BIGINT AS records, count(DISTINCT event_type)::BIGINT AS types FROM events GROUP BY 1")
def archive_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.density(adapters.sample(spark, sf_dir), "day", ZONE)


@query("""SELECT p_brand AS type, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS units, count(DISTINCT p_type)::BIGINT AS unit_count, count(DISTINCT p_type) > 1 AS mixed
FROM part WHERE p_type IS NOT NULL AND p_type <> '' GROUP BY p_brand""")
def distinct_units_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17, T9: part types stand in for units."""
    return series.unit_guard(adapters.table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.col("p_type").alias("unit")))


@query(f"WITH {SAMPLE_SQL} SELECT id, type, start_ts, end_ts, value FROM sample WHERE type = 'click' AND start_ts >= TIMESTAMP '2024-01-03' AND start_ts <= TIMESTAMP '2024-01-20' ORDER BY start_ts DESC, id LIMIT 100")
def list_samples_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, SRT-01."""
    return series.newest(adapters.sample(spark, sf_dir), 100, "click", "2024-01-03 00:00:00", "2024-01-20 00:00:00").select("id", "type", "start_ts", "end_ts", "value")


_FALLBACK = f"""WITH {SAMPLE_SQL}, ends AS (
  SELECT type, max(start_ts) AS latest, count(*) FILTER (WHERE start_ts >= TIMESTAMP '2024-01-29' AND start_ts < TIMESTAMP '2024-01-30' AND value IS NOT NULL) AS inside FROM sample GROUP BY type
), win AS (
  SELECT type, inside = 0 AS earlier, CASE WHEN inside = 0 THEN (latest::DATE + 1)::TIMESTAMP ELSE TIMESTAMP '2024-01-30' END AS window_end FROM ends
)
SELECT s.type, window_end, earlier, count(*) FILTER (WHERE start_ts >= window_end - INTERVAL 7 DAY AND start_ts < window_end)::BIGINT AS records
FROM sample s JOIN win USING (type) WHERE value IS NOT NULL GROUP BY ALL"""


@query(_FALLBACK)
def snapshot_fallback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type without a value in the window is shown up to its own last record."""
    return series.fallback_window(adapters.sample(spark, sf_dir), "2024-01-29 00:00:00", "2024-01-30 00:00:00", 7)


@query(_FALLBACK.replace("'2024-01-29'", "'2024-03-01'").replace("'2024-01-30'", "'2024-03-08'"))
def snapshot_fallback_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a week that may be later than all records: each type falls back to its own end."""
    return series.fallback_window(adapters.sample(spark, sf_dir), "2024-03-01 00:00:00", "2024-03-08 00:00:00", 7)


@query(f"WITH {SERIES_SQL} SELECT type, max(bucket_start) AS bucket_start, max_by(samples, bucket_start)::BIGINT AS samples FROM full_series WHERE samples > 0 GROUP BY type")
def series_latest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07."""
    return series.latest_bucket(_series(spark, sf_dir))


@query(f"""WITH {SERIES_SQL}, h AS (SELECT type, measure,
    CASE measure WHEN 'total' THEN sum(total) WHEN 'average' THEN sum(weighted) / sum(weight) WHEN 'duration' THEN sum(seconds) ELSE sum(counted_rows)::DOUBLE END AS headline,
    min(minimum) AS lowest, max(maximum) AS highest, sum(samples)::BIGINT AS samples, sum(all_readings)::BIGINT AS readings, count(*) FILTER (WHERE samples > 0)::BIGINT AS active_buckets FROM full_series GROUP BY type, measure)
SELECT type, measure, round(headline, 4) AS headline, lowest, highest, samples, readings, active_buckets, round(CASE WHEN measure = 'total' THEN headline / active_buckets END, 4) AS average_per_active FROM h""")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, AGG-15: with the buckets that have data, and what a total comes to in each."""
    return _rounded(series.summary(_series(spark, sf_dir), series.unit_guard(adapters.sample(spark, sf_dir))), "headline", "average_per_active", digits=4)


@query(f"WITH {SERIES_SQL} SELECT type, count(*) FILTER (WHERE samples > 0)::BIGINT AS drawn, count(*) FILTER (WHERE samples > 0) >= 2 AS shown FROM full_series GROUP BY type")
def series_sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-11."""
    return series.sparklines(_series(spark, sf_dir))


def _histogram_sql(source: str, weight: str) -> str:
    return f"""{source}, b AS (SELECT type, min(value) AS low, max(value) AS high FROM h GROUP BY type HAVING count(DISTINCT unit) <= 1), s AS (
  SELECT h.type, CASE WHEN high > low THEN least(floor((value - low) / ((high - low) / 24.0)), 23)::INTEGER ELSE 0 END AS idx, sum({weight}) AS n FROM h JOIN b USING (type) GROUP BY ALL
), bands AS (SELECT type, low, high, unnest(range(CASE WHEN high > low THEN 24 ELSE 1 END))::INTEGER AS idx FROM b)
SELECT type, idx, round(low + (high - low) / 24.0 * idx, 6) AS lower, round(CASE WHEN high > low THEN low + (high - low) / 24.0 * (idx + 1) ELSE high END, 6) AS upper, coalesce(n, 0)::BIGINT AS n
FROM bands LEFT JOIN s USING (type, idx)"""


@query(_histogram_sql(f"WITH {SAMPLE_SQL}, h AS (SELECT * FROM m WHERE measure IN ('total', 'average') AND value IS NOT NULL)", "CASE WHEN measure = 'average' THEN reading_count ELSE 1 END"))
def histogram_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, T16."""
    return _rounded(series.histogram(adapters.sample(spark, sf_dir), adapters.measures(spark)), "lower", "upper")


@query(_histogram_sql("WITH h AS (SELECT p_brand AS type, 7.5::DOUBLE AS value, 'u' AS unit FROM part)", "1"))
def histogram_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16: equal values give one band."""
    parts = adapters.table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.lit(7.5).alias("value"), F.lit("u").alias("unit"), F.lit(None).cast("timestamp_ntz").alias("start_ts"), F.lit(3).alias("reading_count"))
    kinds = parts.select("type").distinct().select("type", F.lit("total").alias("kind"), F.expr("cast(array() as array<bigint>)").alias("counted"))
    return _rounded(series.histogram(parts, kinds), "lower", "upper")


_PAIRS = [("km", "mi"), ("in", "cm"), ("kg", "lb"), ("kcal", "kJ"), ("m/s", "km/hr"), ("mL", "fl_oz_us"), ("mmHg", "kPa"), ("degC", "degF"), ("degF", "K"), ("km", "kg"), ("count", "km")]
_SIZES = " ".join(f"WHEN '{u}' THEN {f!r}" for u, (_, f) in UNITS.items())
_KINDS = " ".join(f"WHEN '{u}' THEN '{d}'" for u, (d, _) in UNITS.items())


@query(f"""WITH pair AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_PAIRS))}) t(i, source, target)), x AS (
  SELECT p_partkey, p_retailprice::DOUBLE AS v, source, target FROM part JOIN pair ON p_partkey % {len(_PAIRS)} = i
)
SELECT p_partkey, source, target, round(CASE WHEN source = 'degC' AND target = 'degF' THEN v * 9 / 5 + 32 WHEN source = 'degF' AND target = 'K' THEN (v - 32) * 5 / 9 + 273.15
  WHEN (CASE source {_KINDS} END) = (CASE target {_KINDS} END) THEN v * (CASE source {_SIZES} END)::DOUBLE / (CASE target {_SIZES} END)::DOUBLE END, 6) AS converted FROM x""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-11: incompatible and unknown units convert to nothing."""
    part = adapters.table(spark, sf_dir, "part")
    i = (F.col("p_partkey") % len(_PAIRS)).cast("int")
    at = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in _PAIRS)), i + 1)
    rows = part.select("p_partkey", at(0).alias("source"), at(1).alias("target"), F.col("p_retailprice").alias("v"))
    return rows.select("p_partkey", "source", "target", F.round(units.convert(F.col("v"), F.col("source"), F.col("target")), 6).alias("converted"))


@query(f"""SELECT p_partkey, u AS unit, CASE WHEN k = 'length' THEN CASE WHEN contains(lower(p_type), 'brass') THEN 'distance' ELSE 'bodyLength' END WHEN k = 'pressure' THEN 'bloodPressure' WHEN k <> 'time' THEN k END AS family
FROM (SELECT *, CASE u WHEN 'degC' THEN 'temperature' {_KINDS} END AS k FROM (SELECT p_partkey, p_type, ['m', 'kg', 'kcal', 's', 'degC', 'count'][(p_partkey % 6)::INTEGER + 1] AS u FROM part))""")
def unit_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-12: "brass" stands in for "distance"."""
    unit = F.element_at(F.array(*(F.lit(u) for u in ("m", "kg", "kcal", "s", "degC", "count"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), F.regexp_replace(F.lower("p_type"), "brass", "distance").alias("t"))
    return rows.select("p_partkey", "unit", units.family(F.col("unit"), F.col("t")).alias("family"))


@query("""WITH d AS (SELECT o_orderpriority AS type, abs(o_totalprice) AS v FROM orders), r AS (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY v) AS k, count(*) OVER (PARTITION BY type) AS n FROM d
)
SELECT type, v AS magnitude, CASE WHEN v >= 5400 THEN 'hr' WHEN v >= 90 THEN 'min' ELSE 'sec' END AS label,
  round(CASE WHEN v >= 5400 THEN 1.0 / 3600 WHEN v >= 90 THEN 1.0 / 60 ELSE 1.0 END, 9) AS scale FROM r WHERE k = n // 2 + 1""")
def display_unit_by_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-14: the unit that fits the upper median."""
    rows = series.upper_median(adapters.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.abs("o_totalprice").alias("v")), "type", "v").withColumnRenamed("v", "magnitude")
    shown = units.display(F.lit("total"), F.lit("sec"), F.col("type"), F.col("magnitude"))
    return rows.select("type", "magnitude", shown.label.alias("label"), F.round(shown.scale, 9).alias("scale"))


@query("""SELECT DISTINCT t AS type, lower(left(t, 1) || regexp_replace(substr(t, 2), '([A-Z])', '_\\1', 'g')) AS metric FROM (SELECT replace(p_name, ' ', '') AS t FROM part)""")
def metric_name_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-15."""
    rows = adapters.table(spark, sf_dir, "part").select(F.regexp_replace("p_name", " ", "").alias("type")).distinct()
    return rows.select("type", names.metric_name(F.col("type")).alias("metric"))


@query("""SELECT DISTINCT t AS type, regexp_replace(substr(t, 25), '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS shown
FROM (SELECT 'HKQuantityTypeIdentifier' || replace(p_name, ' ', '') || replace(p_brand, '#', 'X') AS t FROM part)""")
def display_name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-17."""
    rows = adapters.table(spark, sf_dir, "part").select(F.concat(F.lit("HKQuantityTypeIdentifier"), F.regexp_replace("p_name", " ", ""), F.regexp_replace("p_brand", "#", "X")).alias("type")).distinct()
    return rows.select("type", names.display_name(F.col("type")).alias("shown"))


@query(f"""WITH {SAMPLE_SQL} SELECT {_LOCAL.format('start_ts')}::DATE AS local_day, type, unit, count(*)::BIGINT AS n, round(sum(value), 2) AS sum, round(sum(value), 2) / count(*) AS average, min(value) AS minimum, max(value) AS maximum
FROM sample WHERE value IS NOT NULL GROUP BY ALL""")
def daily_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12."""
    out = series.daily_view(adapters.sample(spark, sf_dir), ZONE)
    return out.withColumn("sum", F.round("sum", 2)).withColumn("average", F.col("sum") / F.col("n"))


@query(f"""WITH {SAMPLE_SQL} SELECT id, type, value, unit FROM sample
UNION ALL SELECT o_orderkey, 'workout', (o_orderkey % 5400)::DOUBLE, 'sec' FROM orders""")
def record_union_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01: samples and workouts as seconds."""
    workouts = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("workout").alias("type"), (F.col("o_orderkey") % 5400).cast("double").alias("value"), F.lit("sec").alias("unit"))
    return adapters.sample(spark, sf_dir).select("id", "type", "value", "unit").unionByName(workouts)


@query("""WITH b AS (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket_start, count(*)::BIGINT AS records, count(DISTINCT event_type)::BIGINT AS types FROM events GROUP BY 1)
SELECT * FROM b ORDER BY records DESC, bucket_start LIMIT 1""")
def busiest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-08."""
    from pulsegrid.operators.domain import busiest

    return busiest(series.density(adapters.sample(spark, sf_dir)))


@query(f"""WITH {SERIES_SQL}, v AS (
  SELECT type, bucket_start, CASE measure WHEN 'total' THEN CASE WHEN weight > 0 THEN total END WHEN 'average' THEN weighted / nullif(weight, 0) WHEN 'duration' THEN seconds ELSE counted_rows::DOUBLE END AS v FROM full_series WHERE samples > 0
), w AS (SELECT *, min(v) OVER p AS lo, max(v) OVER p AS hi, count(*) OVER p AS n FROM v WHERE v IS NOT NULL WINDOW p AS (PARTITION BY type))
SELECT type, bucket_start, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled FROM w WHERE n >= 2""")
def comparison_minmax_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09."""
    from pulsegrid.operators.stats import min_max_normalised

    rows = _series(spark, sf_dir).withColumn("value", series.column_value(F.lit(False))).where("value is not null")
    return _rounded(min_max_normalised(rows, ["type"], "bucket_start"), "scaled")
