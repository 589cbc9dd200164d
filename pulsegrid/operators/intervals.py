"""Intervals: unions by gaps and islands, containment, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of a slot: intervals that start in one are sorted together.
SLOT = 900


def _with_carried(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``_before``: the largest ``value`` of all earlier slots of the key.

    Maxima go up and down again as in a parallel scan: over a day's slots, and over a key's days, of each of
    which there is one row.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("_k", "_day", "_slot").agg(F.max(value).alias("_reach"))
    days = slots.groupBy("_k", "_day").agg(F.max("_reach").alias("_most"))
    days = days.select("_k", "_day", F.max("_most").over(earlier(Window.partitionBy("_k").orderBy("_day"))).alias("_earlier"))
    within = F.max("_reach").over(earlier(Window.partitionBy("_k", "_day").orderBy("_slot")))
    carried = slots.withColumn("_within", within).join(days, ["_k", "_day"]).select("_k", "_day", "_slot", F.greatest("_within", "_earlier").alias("_before"))
    return rows.join(carried, ["_k", "_day", "_slot"])


def union_islands(rows: DataFrame, key: str = "type") -> DataFrame:
    """(key, start_ts, end_ts, members): intervals of a key merged where they overlap or touch; empty ones are left out.

    Intervals are merged within slots of their starts.  What is left of a slot is disjoint and in order, so
    whether one begins an island depends only on the latest end of all earlier slots, and an island is known
    by the start of the one that began it: both are carried over slots by a scan.  No task sorts all
    intervals of a key, whether they overlap or not.
    """
    at = F.unix_seconds(F.col("start_ts").cast("timestamp"))
    # A struct of the key, for a null key is one like any other.
    rows = rows.where(F.col("end_ts") > F.col("start_ts")).select(F.struct(key).alias("_k"), F.floor(at / 86_400).alias("_day"), F.floor(at / SLOT).alias("_slot"), "start_ts", "end_ts")
    slot = Window.partitionBy("_k", "_day", "_slot").orderBy("start_ts", "end_ts")
    before = F.max("end_ts").over(slot.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("start_ts") > before), F.col("start_ts"))
    marked = rows.withColumn("_begins", begins).withColumn("_of", F.max("_begins").over(slot.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("_k", "_day", "_slot", "_of").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("members"))

    reached = _with_carried(merged, "end_ts")
    fresh = F.when(F.col("_before").isNull() | (F.col("start_ts") > F.col("_before")), F.col("start_ts"))
    known = _with_carried(reached.withColumn("_fresh", fresh).drop("_before"), "_fresh")
    running = F.max("_fresh").over(Window.partitionBy("_k", "_day", "_slot").orderBy("start_ts").rowsBetween(Window.unboundedPreceding, 0))
    islands = known.withColumn("_island", F.coalesce(running, F.col("_before")))
    return islands.groupBy("_k", "_island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("members").alias("members")).select(F.col(f"_k.{key}").alias(key), "start_ts", "end_ts", "members")


def contained(points: DataFrame, spans: DataFrame, key: str, slot_seconds: int = 3600) -> DataFrame:
    """Points (key, at, …) joined to the spans (key, span_start, span_end, …) that hold them, both ends included.

    Spans are laid over time slots, so that the join is one on key and slot and not a nested loop.
    """
    slot = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / slot_seconds).cast("long")
    laid = spans.where(F.col("span_end") >= F.col("span_start")).withColumn("_slot", F.explode(F.sequence(slot(F.col("span_start")), slot(F.col("span_end")))))
    met = points.withColumn("_slot", slot(F.col("at"))).join(laid, [key, "_slot"])
    return met.where((F.col("at") >= F.col("span_start")) & (F.col("at") <= F.col("span_end"))).drop("_slot")


def sessions(events: DataFrame, key: str, at: str, quiet: str = "3 seconds") -> DataFrame:
    """(key, session_start, session_end, events): runs of events no further apart than less than ``quiet``."""
    w = F.session_window(F.col(at).cast("timestamp"), quiet)
    rows = events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("session_start"), F.max(at).alias("session_end"))
    return rows.select(key, "session_start", "session_end", "events")
