"""Views over the driver's tables that look like the archive, each with the SQL that DuckDB runs for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (type, kind, values that count) of the event types.
MEASURES = [("purchase", "total", []), ("click", "average", []), ("error", "average", []), ("view", "duration", []), ("signup", "occurrences", list(range(0, 1000, 2)))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEASURES, "type string, kind string, counted array<bigint>")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: k of their JSON gives the length in tens of seconds and the readings."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.lit("quantity").alias("kind"), F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_dt_interval(secs=(k * 10).cast("decimal(18,6)"))).alias("end_ts"), "value", F.lit("u").alias("unit"), F.col("user_id").cast("string").alias("source_name"),
        F.greatest(k, F.lit(1)).alias("reading_count"), F.col("props").alias("raw"),
    )


SAMPLE_SQL = """sample AS (
  SELECT event_id AS id, event_type AS type, 'quantity' AS kind, ts AS start_ts, ts + to_seconds(k * 10) AS end_ts, value, 'u' AS unit,
    user_id::VARCHAR AS source_name, greatest(k, 1) AS reading_count, props AS raw
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), measure AS (
  SELECT * FROM (VALUES ('purchase', 'total'), ('click', 'average'), ('error', 'average'), ('view', 'duration'), ('signup', 'occurrences')) t(type, measure)
), m AS (
  SELECT s.*, measure, CASE WHEN measure = 'duration' THEN coalesce(end_ts, start_ts) ELSE start_ts END AS filed,
    CASE WHEN measure <> 'occurrences' THEN 1 WHEN trunc(value)::BIGINT % 2 = 0 AND trunc(value)::BIGINT BETWEEN 0 AND 999 THEN 1 ELSE 0 END AS counts
  FROM sample s JOIN measure USING (type)
)"""


def orders_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as instants of one kind of total."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.lit("quantity").alias("kind"), F.col("o_orderdate").alias("start_ts"), F.col("o_orderdate").alias("end_ts"),
        F.col("o_totalprice").alias("value"), F.lit("u").alias("unit"), F.lit("orders").alias("source_name"), F.lit(1).cast("long").alias("reading_count"), F.lit(None).cast("string").alias("raw"),
    )


def order_measures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, "total", []) for t in ("F", "O", "P")], "type string, kind string, counted array<bigint>")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pages of 500 elements; keys repeat, so there are replays to overwrite."""
    n = F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), n.alias("sequence"), ((n - 1) * 500).alias("offset"), F.lit(500).cast("long").alias("count"), F.col("l_partkey").alias("part"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("seq"),
    )


PAGES_SQL = """replayed AS (
  SELECT l_orderkey AS sample_id, l_linenumber::BIGINT AS sequence, (l_linenumber::BIGINT - 1) * 500 AS "offset", 500::BIGINT AS "count", l_partkey AS part,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) AS newest
  FROM lineitem
), page AS (SELECT sample_id, sequence, "offset", "count", part FROM replayed WHERE newest = 1)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 8 * 500
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.when(n > 0, n).alias("expected"))


def waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("type"), F.when(F.col("quality") == 1, "anchorClosed").otherwise("draining").alias("state"))


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("medication"), F.col("role").alias("status"), F.col("turn").alias("at"))
