"""Calendar columns over UTC wall-clock timestamps (TIMESTAMP_NTZ); none depends on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAINS = ("hour", "day", "week", "month", "year")
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def local_ts(ts: Column, tz: str) -> Column:
    """The wall clock of ``tz`` at a UTC instant."""
    return ts if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def utc_ts(local: Column, tz: str) -> Column:
    return local if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), local)


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(local_ts(ts, tz))


def bucket_start(ts: Column, grain: str, tz: str, sunday_weeks: bool = True) -> Column:
    """The bucket that an instant falls in: local midnight of its first day, or for hours the UTC instant the local hour began.

    Hours are instants, so that the hour that the clock repeats in autumn is two buckets.
    """
    if grain not in GRAINS:
        raise ValueError(f"bucket must be one of {', '.join(GRAINS)}, not {grain!r}")
    wall = local_ts(ts, tz)
    if grain == "hour":
        past = F.make_dt_interval(mins=F.minute(wall), secs=F.second(wall) + F.date_format(wall, "SSSSSS").cast("decimal(18,6)") / 1000000)
        return (ts - past).cast("timestamp_ntz")
    if grain == "week" and sunday_weeks:
        day = F.to_date(wall)
        return F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp_ntz")
    return F.to_date(F.date_trunc(grain, F.to_date(wall))).cast("timestamp_ntz")


def bucket_plan(spark: SparkSession, first: str, last: str, grain: str, most: int = 100_000, tz: str = "UTC") -> DataFrame:
    """(idx, bucket_start, bucket_end): the buckets from that of ``first`` to that of ``last``, both wall clocks of ``tz``; refuses more than ``most``.

    Buckets of a day and more are local starts.  Hours are the instants that local hours begin at, as
    ``bucket_start`` gives them: where the clock goes back an hour is there twice, where it goes forward one is
    missing, and where it changes by half an hour one lasts half as long, or longer.
    """
    step = {"hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}[grain]
    guard = lambda starts, n: F.when(n <= most, starts).otherwise(F.raise_error(F.lit(f"more than {most} buckets")))
    if grain == "hour" and tz != "UTC":
        begin, end = (utc_ts(F.expr(f"timestamp_ntz'{x}'"), tz) for x in (first, last))
        ends = spark.range(1).select(bucket_start(begin, "hour", tz).alias("a"), bucket_start(end, "hour", tz).alias("b"))
        # Clocks change by whole quarters of an hour, so a quarter's hour tells every hour there is.
        quarters = F.expr("sequence(a, b, interval 15 minutes)")
        at = ends.select("b", F.explode(guard(quarters, F.size(quarters) / 4)).alias("at"))
        hours = at.select("b", bucket_start(F.col("at"), "hour", tz).alias("bucket_start")).distinct()
        last_end = bucket_start(F.col("b") + F.expr("interval 65 minutes"), "hour", tz)
        order = Window.partitionBy("b").orderBy("bucket_start")  # the plan's own rows, ``most`` at most
        return hours.select((F.row_number().over(order) - 1).alias("idx"), "bucket_start", F.coalesce(F.lead("bucket_start").over(order), last_end).alias("bucket_end"))
    starts = F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval {step})")
    rows = spark.range(1).select(F.posexplode(guard(starts, F.size(starts))).alias("idx", "bucket_start"))
    return rows.withColumn("bucket_end", F.expr(f"bucket_start + interval {step}"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds, never less than zero; null if either is."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0.0), (micros(end) - micros(start)) / 1e6))


def parse_iso(text: Column) -> Column:
    """An ISO-8601 instant with or without a fraction as UTC wall clock; null for anything else, however close."""
    instant = F.try_to_timestamp(F.when(text.rlike(_ISO), text))
    return F.to_timestamp_ntz(F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz")).cast("string"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_years(born: Column, now: Column) -> Column:
    """Whole years; who was born on 29 February is a year older on 1 March."""
    now, turned = F.to_date(now), F.date_format(F.to_date(now), "MMdd") >= F.date_format(born, "MMdd")
    return (F.year(now) - F.year(born) - F.when(turned, 0).otherwise(1)).cast("long")
