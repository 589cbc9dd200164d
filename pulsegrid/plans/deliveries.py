"""Queries: delivery floors, selections, units and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.names import counted_values, measure_kind
from pulsegrid.functions.tagged import tagged_map, untagged
from pulsegrid.operators import delivery, series
from pulsegrid.plans.bucketed import ZONE
from pulsegrid.plans.register import query
from pulsegrid.schema import CUMULATIVE
from pulsegrid.sources import adapters
from pulsegrid.sources.adapters import SAMPLE_SQL

_NOW = "2024-01-20 02:30:00"


@query("""SELECT event_type AS type, count(*) FILTER (WHERE event_id % 50 = 0 OR ts >= TIMESTAMP '2024-01-12 05:00:00')::BIGINT AS sent, count(*) FILTER (WHERE NOT (event_id % 50 = 0 OR ts >= TIMESTAMP '2024-01-12 05:00:00'))::BIGINT AS excluded FROM events GROUP BY 1""")
def delivery_floor_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07, FLT-08: local midnight a week back; undated records are sent."""
    rows = adapters.sample(spark, sf_dir).withColumn("start_ts", F.when(F.col("id") % 50 != 0, F.col("start_ts")))
    marked = delivery.admitted(rows, delivery.floor_at(F.expr(f"timestamp_ntz'{_NOW}'"), 7, ZONE))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return marked.groupBy("type").agg(n(F.col("admitted")).alias("sent"), n(~F.col("admitted")).alias("excluded"))


@query("SELECT count(*)::BIGINT AS records FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 200)")
def selected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09."""
    rows = adapters.sample(spark, sf_dir)
    return delivery.selected(rows, rows.where("value > 200").select("type")).agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT p_partkey, CASE u WHEN 'm' THEN CASE WHEN brass THEN 'mi' ELSE 'in' END WHEN 'kg' THEN 'lb' WHEN 'degC' THEN 'degF' ELSE u END AS unit, CASE WHEN u IN ('m', 'kg', 'degC') THEN u END AS converted_from,
  round(CASE u WHEN 'm' THEN CASE WHEN brass THEN v / 1609.344 ELSE v / 0.0254 END WHEN 'kg' THEN v * 1000 / 453.59237 WHEN 'degC' THEN v * 9 / 5 + 32 ELSE v END, 5) AS value
FROM (SELECT p_partkey, p_retailprice::DOUBLE AS v, contains(lower(p_type), 'brass') AS brass, ['m', 'kg', 'degC', 'count'][(p_partkey % 4)::INTEGER + 1] AS u FROM part)""")
def unit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: value and unit move together."""
    unit = F.element_at(F.array(*(F.lit(u) for u in ("m", "kg", "degC", "count"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), F.regexp_replace(F.lower("p_type"), "brass", "distance").alias("type"), F.col("p_retailprice").alias("value"))
    return delivery.in_units(rows, "us").select("p_partkey", "unit", "converted_from", F.round("value", 5).alias("value"))


@query("SELECT p_type AS type, count(*)::BIGINT AS records FROM part GROUP BY 1 HAVING count(*) >= 10")
def comparable_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12."""
    rows = adapters.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type")).agg(F.count(F.lit(1)).alias("records"))
    return delivery.comparable(rows)


@query("SELECT event_id FROM events WHERE event_id % 4 NOT IN (1, 2)")
def detail_kinds_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10: pages and end markers are no readings."""
    kinds = F.element_at(F.array(F.lit("quantity"), F.lit("quantitySeriesReadings"), F.lit("workoutRouteEnd"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return delivery.without_details(adapters.table(spark, sf_dir, "events").select("event_id", kinds.alias("kind"))).select("event_id")


@query("""SELECT user_id AS type, max_by(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'click' AND value IS NOT NULL THEN event_id END) AS summary, max_by(props, CASE WHEN event_type = 'error' THEN event_id END) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id""")
def export_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19."""
    e = adapters.table(spark, sf_dir, "events")
    return delivery.export_states(e.select(F.col("user_id").alias("type"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "click", F.col("value")).alias("summary"), F.when(F.col("event_type") == "error", F.col("props")).alias("error")))


@query("SELECT vec_id AS sample_id, (vec_id % 3) * 64 + i - 1 AS place, embedding[i]::DOUBLE AS reading FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def readings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-20, PAG-03."""
    pages = adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 3 * 64).alias("offset"), F.col("embedding").alias("readings"))
    return delivery.readings(pages).select("sample_id", "place", F.col("reading").cast("double").alias("reading"))


@query("""WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'), big AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20')
SELECT event_id, 'day' AS win FROM w WHERE (SELECT count(*) FROM w) <= 5000 UNION ALL SELECT event_id, 'long' FROM big WHERE (SELECT count(*) FROM big) <= 10""")
def dated_window_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22: a window that holds too much gives nothing."""
    e, at = adapters.table(spark, sf_dir, "events"), lambda d: F.expr(f"timestamp_ntz'{d} 00:00:00'")
    one = delivery.dated(e, at("2024-01-03"), at("2024-01-04"), 5000, "ts").select("event_id", F.lit("day").alias("win"))
    return one.unionByName(delivery.dated(e, at("2024-01-03"), at("2024-01-20"), 10, "ts").select("event_id", F.lit("long").alias("win")))


@query("""SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INTEGER % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS identity
FROM (SELECT p_partkey, sha256('HKClinicalRecord' || p_name || chr(0) || p_brand || chr(0) || p_type) AS h FROM part)""")
def clinical_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-28, SCL-30: the same content has the same name."""
    return adapters.table(spark, sf_dir, "part").select("p_partkey", delivery.clinical_identity(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("identity"))


_NAMES = [f"HKQuantityTypeIdentifier{x}" for x in [*CUMULATIVE, "HeartRate", "DietaryZinc", "DistanceCycling", "UVExposure"]] + ["HKCategoryTypeIdentifierSleepAnalysis", "HKCategoryTypeIdentifierAppleStandHour", "HKCategoryTypeIdentifierX", "HKWorkoutTypeIdentifier", "HKDataTypeStateOfMind", "HKWorkoutRouteTypeIdentifier"]
_LIST = ", ".join(f"'{x}'" for x in CUMULATIVE)


@query(f"""SELECT p_partkey, t AS type, CASE WHEN t = 'HKCategoryTypeIdentifierSleepAnalysis' THEN 'duration' WHEN starts_with(t, 'HKCategory') THEN 'occurrences' WHEN starts_with(t, 'HKQuantity') THEN CASE WHEN substr(t, 25) IN ({_LIST}) OR substr(t, 25, 7) = 'Dietary' OR substr(t, 25, 8) = 'Distance' THEN 'total' ELSE 'average' END
  WHEN contains(t, 'StateOfMind') THEN 'average' WHEN t = 'HKWorkoutTypeIdentifier' THEN 'total' ELSE 'occurrences' END AS kind, CASE WHEN t LIKE '%SleepAnalysis' THEN 4 WHEN t LIKE '%StandHour' THEN 1 ELSE 0 END::BIGINT AS counted
FROM (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _NAMES)}][(p_partkey % {len(_NAMES)})::INTEGER + 1] AS t FROM part)""")
def measure_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13, T3."""
    t = F.element_at(F.array(*(F.lit(x) for x in _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", t.alias("type"))
    return rows.select("p_partkey", "type", measure_kind(F.col("type")).alias("kind"), F.size(counted_values(F.col("type"))).cast("long").alias("counted"))


@query(f"WITH {SAMPLE_SQL} SELECT a.type, count(*)::BIGINT AS shared_days FROM (SELECT DISTINCT type, start_ts::DATE AS d FROM sample) a JOIN (SELECT DISTINCT start_ts::DATE AS d FROM sample WHERE type = 'click') b USING (d) WHERE a.type <> 'click' GROUP BY 1")
def shared_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03."""
    rows = series.with_measure(adapters.sample(spark, sf_dir), adapters.measures(spark)).select("type", F.to_date("start_ts").alias("d")).distinct()
    return rows.where("type <> 'click'").join(rows.where("type = 'click'").select("d"), "d").groupBy("type").agg(F.count(F.lit(1)).alias("shared_days"))


@query("""SELECT event_id, '{"at":{"type":"date","value":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"},"even":{"type":"bool","value":' || (event_id % 2 = 0) || '},"name":{"type":"string","value":"' || event_type || '"},"value":' || CASE WHEN value IS NULL THEN '{"class":"VOID","type":"unsupported"}' ELSE '{"type":"number","value":' || value::VARCHAR || '}' END || '}' AS metadata,
  date_trunc('millisecond', ts)::TIMESTAMP AS at, value FROM events""")
def tagged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-29: values of four types written with their types, and two of them read back."""
    e = adapters.table(spark, sf_dir, "events")
    values = {"value": F.col("value"), "at": F.col("ts").cast("timestamp_ntz"), "name": F.col("event_type"), "even": F.col("event_id") % 2 == 0}
    rows = e.select("event_id", tagged_map(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("variant"))))).alias("metadata"))
    back = lambda k, t: F.try_variant_get(untagged(F.get_json_object("metadata", f"$.{k}")), "$", t)
    return rows.select("event_id", "metadata", back("at", "timestamp_ntz").alias("at"), back("value", "double").alias("value"))


@query("""SELECT p_partkey, '{"clinicalType":"' || p_type || '","fhir":' || CASE p_partkey % 3 WHEN 2 THEN '{"reason":"There is no resource behind this record.","state":"absent"}' WHEN 1 THEN '{"encoding":"base64","identifier":"' || p_type || '","resourceData":"' || base64(p_name::BLOB) || '","resourceType":"' || p_brand || '","state":"present"}'
    ELSE '{"identifier":"' || p_type || '","resource":{"size":' || p_size || '},"resourceType":"' || p_brand || '","state":"present"}' END || ',"healthKitUUID":"' || p_partkey || '","id":"' || CASE p_partkey % 3 WHEN 2 THEN p_partkey::VARCHAR
    ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INTEGER % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) END || '","identityIsStable":' || (p_partkey % 3 < 2) || ',"kind":"clinicalRecord"}' AS envelope
FROM (SELECT *, sha256('HKClinicalRecord' || p_name || chr(0) || p_brand || chr(0) || p_type) AS h FROM part)""")
def clinical_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-28: a resource that is JSON is held as such, any other as Base64, and none is told."""
    n, none = F.col("p_partkey") % 3, F.lit(None).cast("string")
    resource = F.when(n == 0, F.concat(F.lit('{ "size": '), F.col("p_size"), F.lit("}"))).when(n == 1, F.col("p_name")).cast("binary")
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("uuid"), F.col("p_name").alias("source"), F.col("p_type").alias("clinical_type"), none.alias("display_name"), F.col("p_brand").alias("resource_type"), F.col("p_type").alias("identifier"), resource.alias("resource"), none.alias("fhir_version"))
    return delivery.clinical_envelopes(rows).select("p_partkey", "envelope")
