"""Queries: change folds, standings, domain questions and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import age_years
from pulsegrid.functions.names import activity_name, sleep_stage
from pulsegrid.functions.variants import whole_json
from pulsegrid.operators import domain, state
from pulsegrid.plans.register import query
from pulsegrid.schema import ACTIVITIES, SLEEP_STAGES
from pulsegrid.sources import adapters

_SEQ = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NEWEST = ", ".join(f"{c} DESC" for c in _SEQ)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "delete").otherwise("upsert").alias("op"), F.col("l_quantity").alias("value"), F.struct(*_SEQ).alias("seq"))


@query(f"""SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_NEWEST}) AS k FROM lineitem) WHERE k = 1 AND l_returnflag <> 'R'""")
def cdc_fold_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-01..03: the last change wins, unless it deletes."""
    return state.fold(_changes(spark, sf_dir), ["id", "line"], ["seq"]).select("id", "line", "value")


@query("""SELECT p_size AS type, observed AS observed_at, delivered FROM (
  SELECT p_size, p_retailprice AS observed, p_partkey AS delivered, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey DESC) AS k FROM part) WHERE k = 1""")
def coverage_guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-05: the newest observation stays whatever arrives later; keys stand in for arrival."""
    rows = adapters.table(spark, sf_dir, "part").select(F.col("p_size").alias("type"), F.col("p_retailprice").alias("observed_at"), F.col("p_partkey").alias("delivered"))
    return state.guarded_upsert(rows, "type", "observed_at", "delivered").select("type", "observed_at", "delivered")


@query("""SELECT ts::DATE AS batch, count(*)::BIGINT AS records FROM events WHERE ts::DATE NOT IN (SELECT ts::DATE FROM events WHERE event_type = 'signup' AND value > 150) GROUP BY 1""")
def batch_idempotency_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-06, JON-11: days with a large signup stand in for batches seen before."""
    rows = adapters.table(spark, sf_dir, "events").withColumn("batch", F.to_date("ts"))
    return state.unseen_batches(rows, rows.where("event_type = 'signup' and value > 150")).groupBy("batch").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT user_id AS device, min(ts) AS first_seen, max(ts) AS last_seen, count(*)::BIGINT AS delivered_records FROM events GROUP BY user_id")
def device_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-07."""
    rows = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), "ts")
    return state.accumulate_devices(rows, "device", "ts", F.lit(1))


@query("SELECT user_id AS destination, event_id AS receipt, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")
def receipts_keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-12."""
    rows = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("destination"), F.col("event_id").alias("receipt"), "ts")
    return state.keep_last(rows, ["destination"], [F.desc("ts"), F.desc("receipt")], 3)


_INBOX = """inbox AS (SELECT props AS line FROM events UNION ALL SELECT text FROM documents UNION ALL SELECT '{"id":"' || event_id || '","type":"' || event_type || '","startDate":"x","kind":"k' || (event_id % 3) || '"}' FROM events WHERE event_id % 5 = 0)"""


def _inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    whole = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","type":"'), "event_type", F.lit('","startDate":"x","kind":"k'), (F.col("event_id") % 3).cast("string"), F.lit('"}'))
    lines = events.select(F.col("props").alias("line")).unionByName(adapters.table(spark, sf_dir, "documents").select(F.col("text").alias("line")))
    return lines.unionByName(events.where("event_id % 5 = 0").select(whole.alias("line")))


@query(f"""WITH {_INBOX}, q AS (SELECT sha256(line) AS fingerprint, CASE WHEN NOT json_valid(line) THEN 'not_json' ELSE 'missing_fields' END AS reason, count(*) AS seen FROM inbox
  WHERE NOT json_valid(line) OR NOT coalesce(json_extract_string(line, '$.id') IS NOT NULL AND json_extract_string(line, '$.type') IS NOT NULL AND json_extract_string(line, '$.startDate') IS NOT NULL, false) GROUP BY 1, 2)
SELECT 'unknown' AS kind, reason, count(*)::BIGINT AS records, sum(seen)::BIGINT AS seen FROM q GROUP BY reason""")
def quarantine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, SRC-17: each content is held once."""
    held = state.quarantine(_inbox(spark, sf_dir), "line", 7)
    return held.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind"), "reason").agg(F.count(F.lit(1)).alias("records"), F.sum("seen").alias("seen"))


@query("""SELECT CASE WHEN event_id % 4 < 3 AND json_valid(props) THEN 'promoted' ELSE 'kept' END AS outcome, CASE WHEN event_id % 4 < 3 AND NOT json_valid(props) THEN 3 ELSE (event_id % 4)::INTEGER END AS parser_version, count(*)::BIGINT AS records
FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'nope' ELSE props END AS props FROM events) GROUP BY ALL""")
def promotion_reparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-08: what an older parser refused is read again; the rest is marked with this version."""
    held = adapters.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, "nope").otherwise(F.col("props")).alias("raw"), (F.col("event_id") % 4).cast("int").alias("parser_version"))
    promoted, kept = state.promote(held, 3, whole_json("raw").isNotNull())
    both = promoted.select(F.lit("promoted").alias("outcome"), "parser_version").unionByName(kept.select(F.lit("kept").alias("outcome"), "parser_version"))
    return both.groupBy("outcome", "parser_version").agg(F.count(F.lit(1)).alias("records"))


@query("""WITH s AS (SELECT event_id AS id, event_type AS type, ts AS start_ts, event_id AS at FROM events), t AS (
  SELECT event_id + 7 AS id, event_type AS type, CASE WHEN event_id % 2 = 0 THEN ts END AS start_ts, event_id + 5 AS at FROM events WHERE event_id % 11 = 0)
SELECT s.id, s.type FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.start_ts IS NULL AND t.id = s.id AND t.at >= s.at) AND NOT EXISTS (SELECT 1 FROM t WHERE t.start_ts = s.start_ts AND t.type = s.type AND t.at >= s.at)""")
def tombstone_by_type_and_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-02, T12: dated tombstones delete by type and start, others by id; only what came before."""
    events = adapters.table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("start_ts"), F.col("event_id").alias("at"))
    gone = events.where("event_id % 11 = 0").select((F.col("event_id") + 7).alias("id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("start_ts"), (F.col("event_id") + 5).alias("at"))
    return state.delete_by_id(rows, gone, "at").select("id", "type")


@query("""SELECT d.doc_id AS type, CASE WHEN quality IS NULL THEN 'untold' WHEN quality = 1 THEN 'complete' ELSE 'incomplete' END AS standing,
  CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'stopped' ELSE 'arriving' END AS motion, coalesce(quality = 1, false) AS licenses_latest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def standing_three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-10, STR-06, T14."""
    return state.standing(adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("type")), adapters.coverage(spark, sf_dir))


@query("SELECT conv_id::VARCHAR AS medication, role AS status, count(*)::BIGINT AS doses, min(turn) AS first_at, max(turn) AS last_at FROM conversations GROUP BY ALL")
def adherence_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, T15."""
    return domain.adherence(adapters.doses(spark, sf_dir))


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as figures of workouts: line 1 is the whole, the others are legs; some have no sum."""
    rows = adapters.table(spark, sf_dir, "lineitem")
    leg = F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_linenumber").cast("string"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("DistanceCycling", "DistanceSwimming", "ActiveEnergyBurned"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return rows.select(F.col("l_orderkey").alias("workout_id"), leg.alias("leg"), kind.alias("type"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_quantity")).alias("sum"), F.col("l_extendedprice").alias("average"), F.col("l_discount").alias("minimum"), F.col("l_tax").alias("maximum"))


_STATISTICS = """st AS (SELECT l_orderkey AS workout_id, CASE WHEN l_linenumber = 1 THEN '' ELSE l_linenumber::VARCHAR END AS leg, ['DistanceCycling', 'DistanceSwimming', 'ActiveEnergyBurned'][(l_suppkey % 3)::INTEGER + 1] AS type,
  CASE WHEN l_partkey % 4 <> 0 THEN l_quantity END AS sum, l_extendedprice AS average FROM lineitem)"""


_WORKOUTS = f"""WITH {_STATISTICS}, w AS (SELECT workout_id, count(*) AS n, max(average) AS best, count(sum) AS sums FROM st WHERE leg = '' GROUP BY 1), l AS (SELECT workout_id, count(DISTINCT leg) AS n FROM st WHERE leg <> '' GROUP BY 1)
SELECT o_orderkey AS id, coalesce(w.n, 0)::BIGINT AS figures, best, coalesce(sums, 0)::BIGINT AS sums, coalesce(l.n, 0)::BIGINT AS legs FROM orders LEFT JOIN w ON w.workout_id = o_orderkey LEFT JOIN l ON l.workout_id = o_orderkey"""


@query(_WORKOUTS)
def workouts_with_stats_and_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-07, T17: figures that aren't there stay null."""
    return _workouts(spark, sf_dir, _statistics(spark, sf_dir))


@query(_WORKOUTS)
def workouts_with_all_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-07, T17 over every line."""
    return _workouts(spark, sf_dir, _statistics(spark, sf_dir))


def _workouts(spark: SparkSession, sf_dir: str, statistics: DataFrame) -> DataFrame:
    headers = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    rows = domain.workouts(headers, statistics)
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    sums = F.when(F.col("figures").isNotNull(), F.size(F.filter("figures", lambda x: x["sum"].isNotNull())))
    return rows.select("id", size("figures").alias("n"), F.array_max(F.transform("figures", lambda x: x["average"])).alias("best"), F.coalesce(sums, F.lit(0)).cast("long").alias("sums"), size("legs").alias("legs")).withColumnRenamed("n", "figures")


_DISTANCES = f"""WITH {_STATISTICS}, d AS (SELECT workout_id, type, sum(sum) AS metres FROM st WHERE contains(type, 'Distance') GROUP BY ALL)
SELECT workout_id, CASE WHEN count(*) FILTER (WHERE metres > 0) = 1 THEN sum(metres) FILTER (WHERE metres > 0) END AS sole, CASE WHEN sum(metres) > 0 THEN sum(metres) END AS total,
  coalesce(max(metres) FILTER (WHERE type = 'DistanceSwimming'), max(metres) FILTER (WHERE type = 'DistanceCycling')) AS first_listed, count(*)::BIGINT AS kinds FROM d GROUP BY workout_id"""


@query(_DISTANCES)
def workout_distance_three_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-06, SCL-36, B11."""
    return domain.distance_rules(_statistics(spark, sf_dir), ["DistanceSwimming", "DistanceCycling"])


@query(_DISTANCES)
def workout_distance_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-06, SCL-36, B11 over every line."""
    return domain.distance_rules(_statistics(spark, sf_dir), ["DistanceSwimming", "DistanceCycling"])


@query("""SELECT vec_id AS id, (i * 125)::DOUBLE AS frequency, CASE WHEN s = 0 THEN 'left' ELSE 'right' END AS ear, embedding[2 * i + s - 1]::DOUBLE AS sensitivity, embedding[2 * i + s - 1] < 0 AS masked, abs(embedding[2 * i + s - 1]) > 0.2::FLOAT AS clamped
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) // 2 + 1)) AS i FROM embeddings), (SELECT unnest(range(2)) AS s)""")
def threshold_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: a point's ears, one row each; clamped where the range is there."""
    v = lambda i, s: F.element_at("embedding", (2 * i + s - 1).cast("int"))
    ear = lambda i, s, name: F.struct(F.lit(name).alias("ear"), v(i, s).cast("double").alias("sensitivity"), (v(i, s) < 0).alias("masked"), F.when(F.abs(v(i, s)) > F.lit(0.2).cast("float"), F.lit("range")).alias("clamping"))
    halves = F.filter(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int")), lambda i: i > 0)
    points = F.transform(halves, lambda i: F.struct((i * 125).cast("double").alias("frequency"), F.array(ear(i, F.lit(0), "left"), ear(i, F.lit(1), "right")).alias("ears")))
    return domain.thresholds(adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").select("id", points.alias("points")))


@query("""SELECT o_orderkey AS person, date_diff('year', o_orderdate::DATE, DATE '2026-02-28') - CASE WHEN strftime(o_orderdate, '%m%d') > '0228' THEN 1 ELSE 0 END AS age FROM orders""")
def age_from_dob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-20."""
    return adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("person"), age_years(F.to_date("o_orderdate"), F.lit("2026-02-28")).alias("age"))


@query("SELECT p_brand AS type, count(*)::BIGINT AS records FROM part GROUP BY 1 ORDER BY records DESC, type LIMIT 10")
def overview_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03."""
    return adapters.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("type")).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "type").limit(10)


@query("SELECT trim(w) AS name, count(*)::BIGINT AS entries FROM (SELECT unnest(string_split(text, ',')) AS w FROM conversations) WHERE trim(w) <> '' GROUP BY 1 ORDER BY entries DESC, name LIMIT 10")
def association_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-01."""
    return domain.association_top(adapters.table(spark, sf_dir, "conversations"), "text")


_MOOD = "mood AS (SELECT CASE WHEN event_type = 'view' THEN 'dailyMood' ELSE event_type END AS kind, greatest(-1.0, least(1.0, value / 50 - 1)) AS valence FROM events WHERE value IS NOT NULL)"


def _mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 50 - 1))
    return adapters.table(spark, sf_dir, "events").where("value is not null").select(F.when(F.col("event_type") == "view", "dailyMood").otherwise(F.col("event_type")).alias("kind"), v.alias("valence"))


@query(f"WITH {_MOOD} SELECT CASE WHEN kind = 'dailyMood' THEN 'daily' ELSE 'momentary' END AS entry_kind, round(avg(valence), 5) AS mean_valence, count(*)::BIGINT AS entries FROM mood GROUP BY 1")
def mood_mean_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-02."""
    return domain.mood_means(_mood(spark, sf_dir)).withColumn("mean_valence", F.round("mean_valence", 5))


@query(f"""WITH {_MOOD} SELECT CASE WHEN valence < -0.6 THEN 'very unpleasant' WHEN valence < -0.2 THEN 'unpleasant' WHEN valence < 0.2 THEN 'neutral' WHEN valence < 0.6 THEN 'pleasant' ELSE 'very pleasant' END AS band, count(*)::BIGINT AS entries FROM mood GROUP BY 1""")
def valence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-03."""
    return _mood(spark, sf_dir).groupBy(domain.valence_band(F.col("valence")).alias("band")).agg(F.count(F.lit(1)).alias("entries"))


_BACKFILL = """WITH w AS (SELECT s_suppkey % 4 AS destination, p_partkey % 100 AS type FROM (SELECT DISTINCT s_suppkey % 4 AS s_suppkey FROM supplier) s CROSS JOIN (SELECT DISTINCT p_partkey % 100 AS p_partkey FROM part) p), st AS (
  SELECT l_suppkey % 4 AS destination, l_partkey % 100 AS type, count(*) AS records, bool_and(l_quantity > 0) AND any_value(l_partkey % 100) % 3 <> 0 AS closed, bool_or(l_tax > 0.07) AND any_value(l_partkey % 100) % 5 = 0 AS failed
  FROM lineitem GROUP BY ALL
), t AS (SELECT w.type, bool_and(coalesce(closed, false)) AS complete, bool_or(coalesce(closed, false) OR coalesce(records, 0) > 0) AS started, sum(coalesce(records, 0)) AS records, bool_or(coalesce(failed, false)) AS failed FROM w LEFT JOIN st ON w.destination = st.destination AND w.type = st.type GROUP BY 1)
SELECT count(*) FILTER (WHERE complete)::BIGINT AS complete, count(*) FILTER (WHERE started)::BIGINT AS started, count(*)::BIGINT AS selected, sum(records)::BIGINT AS records, count(*) FILTER (WHERE complete AND records = 0)::BIGINT AS empty, count(*) FILTER (WHERE failed AND NOT complete)::BIGINT AS failed FROM t"""


@query(_BACKFILL)
def backfill_all_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-09: complete only where every destination closed it; a stream that isn't there hasn't closed."""
    return _backfill(spark, sf_dir, adapters.table(spark, sf_dir, "lineitem"))


@query(_BACKFILL)
def backfill_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-09 over all rows."""
    return _backfill(spark, sf_dir, adapters.table(spark, sf_dir, "lineitem"))


def _backfill(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    kind = F.col("l_partkey") % 100
    streams = items.groupBy((F.col("l_suppkey") % 4).alias("destination"), kind.alias("type")).agg(F.count(F.lit(1)).alias("records"), F.bool_and(F.col("l_quantity") > 0).alias("c"), F.bool_or(F.col("l_tax") > 0.07).alias("f"))
    streams = streams.select("destination", "type", "records", (F.col("c") & (F.col("type") % 3 != 0)).alias("closed"), (F.col("f") & (F.col("type") % 5 == 0)).alias("failed"))
    types = adapters.table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("type")).distinct()
    return domain.backfill(types.select("type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("destination")), streams)


@query("SELECT max(o_orderdate) AS last_success, sum(o_orderkey % 10)::BIGINT AS delivered, bool_or(o_orderpriority = '1-URGENT') AS needs_attention, count(*) > 0 AS any_destination FROM orders")
def delivery_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APP-10."""
    rows = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("last_success"), (F.col("o_orderkey") % 10).alias("delivered"), (F.col("o_orderpriority") == "1-URGENT").alias("needs_attention"))
    return domain.delivery_rollup(rows)


def _turns(spark: SparkSession, sf_dir: str, slot: int = 473_000) -> DataFrame:
    types = adapters.table(spark, sf_dir, "events").select("event_type").distinct()
    return state.rotated(types, "event_type", slot)


_TURNS = "turns AS (SELECT event_type, (((k - 473000 % n) % n + n) % n)::INTEGER AS turn FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT event_type FROM events)))"


@query(f"WITH {_TURNS} SELECT * FROM turns")
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06."""
    return _turns(spark, sf_dir)


@query(f"""WITH {_TURNS}, r AS (SELECT event_id, e.event_type, turn, row_number() OVER (PARTITION BY e.event_type ORDER BY ts, event_id) AS pos FROM events e JOIN turns USING (event_type)),
x AS (SELECT *, CASE WHEN pos <= 500 THEN 0 ELSE 1 END AS round FROM r WHERE pos <= 5000), y AS (SELECT *, row_number() OVER (ORDER BY round, turn, pos)::BIGINT AS place FROM x)
SELECT event_id, event_type, turn, round::INTEGER AS round, place FROM y WHERE place <= 5000""")
def fair_share_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02: every type has its share before any has more."""
    rows = adapters.table(spark, sf_dir, "events").select("event_id", "event_type", "ts").join(_turns(spark, sf_dir), "event_type")
    return state.fair_share(rows, "event_type", [F.col("ts"), F.col("event_id")], 5).select("event_id", "event_type", "turn", "round", "place")


@query(f"""WITH {_TURNS}, r AS (SELECT event_id, e.event_type, turn, 1000 + event_id % 997 AS bytes, row_number() OVER (PARTITION BY e.event_type ORDER BY ts, event_id) AS pos FROM events e JOIN turns USING (event_type)),
x AS (SELECT *, CASE WHEN pos <= 500 THEN 0 ELSE 1 END AS round FROM r WHERE pos <= 5000), y AS (SELECT *, row_number() OVER (ORDER BY round, turn, pos)::BIGINT AS place, (pos - 1 - CASE WHEN round = 1 THEN 500 ELSE 0 END) // 500 AS page FROM x),
z AS (SELECT * FROM y WHERE place <= 5000), q AS (SELECT round, turn, page, sum(bytes) AS b FROM z GROUP BY ALL), p AS (SELECT round, turn, page, sum(b) OVER (ORDER BY round, turn, page) - b AS before FROM q)
SELECT event_id, event_type, turn, round::INTEGER AS round, place FROM z JOIN p USING (round, turn, page) WHERE before < 2000000""")
def fair_share_within_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02: the batch ends with the page that passes its budget of bytes."""
    rows = adapters.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", (1000 + F.col("event_id") % 997).alias("bytes")).join(_turns(spark, sf_dir), "event_type")
    return state.fair_share(rows, "event_type", [F.col("ts"), F.col("event_id")], 5, size="bytes", most=2_000_000).select("event_id", "event_type", "turn", "round", "place")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'draining' WHEN event_id % 7 > 0 THEN 'anchorClosed' ELSE 'authorizationIndeterminate' END AS state FROM events""")
def coverage_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05."""
    return adapters.table(spark, sf_dir, "events").select("event_id", state.coverage_state(F.col("event_id") % 3 != 0, F.col("event_id") % 7).alias("state"))


@query(f"""WITH h AS (SELECT sha256(doc_id || '|' || CASE WHEN quality = 1 THEN 'anchorClosed' ELSE 'draining' END) AS h FROM labels)
SELECT count(*)::BIGINT AS reports, sha256(concat_ws(':', count(*)::VARCHAR, {", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT), 0)::VARCHAR" for i in range(4))})) AS digest FROM h""")
def coverage_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23, STR-07: the same in any order."""
    return state.digest(adapters.coverage(spark, sf_dir), ["type", "state"])


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN [30, 120, 600, 1800, 7200, 21600][least(event_id % 9 + 1, 6)::INTEGER] END::INTEGER AS seconds FROM events")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12."""
    return adapters.table(spark, sf_dir, "events").select("event_id", state.retry_delay(F.col("event_id") % 9 + 1, F.col("event_type") != "error").alias("seconds"))


@query(f"""SELECT p_partkey, CASE p_size {" ".join(f"WHEN {k} THEN '{v}'" for k, v in ACTIVITIES.items())} ELSE 'Activity ' || p_size END AS activity, coalesce([{", ".join(f"'{x}'" for x in SLEEP_STAGES)}][p_size + 1], 'Unspecified') AS stage FROM part""")
def activity_and_stage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-18, SCL-19."""
    return adapters.table(spark, sf_dir, "part").select("p_partkey", activity_name(F.col("p_size")).alias("activity"), sleep_stage(F.col("p_size")).alias("stage"))


@query("SELECT l_shipmode_free.kind AS kind, count(*)::BIGINT AS records FROM (SELECT l_returnflag || l_linestatus AS kind FROM lineitem) l_shipmode_free GROUP BY 1")
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18."""
    return domain.inventory(adapters.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind")), ["kind"])


@query("SELECT count(*)::BIGINT AS records, sum(strlen(props))::BIGINT AS bytes FROM events")
def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21."""
    return domain.storage_report(adapters.sample(spark, sf_dir))
