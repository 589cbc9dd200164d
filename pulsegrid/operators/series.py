"""Bucketed series and aggregates.  One grouped pass serves all types; the bucket is a computed key, never a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import bucket_start, local_day, seconds_between, utc_ts
from pulsegrid.operators.intervals import union_islands

_STEP = {"hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}


def with_measure(sample: DataFrame, measures: DataFrame) -> DataFrame:
    """Join the measure dimension (type, kind, counted): a row per type, small by nature; AQE decides how."""
    return sample.join(measures.select("type", F.col("kind").alias("measure"), "counted"), "type")


def counts() -> Column:
    """1 where the row's value counts towards its measure, else 0; an empty list counts all."""
    listed = F.array_contains("counted", F.expr("cast(value as bigint)"))
    return F.when((F.size("counted") == 0) | F.coalesce(listed, F.lit(False)), 1).otherwise(0)


def filed() -> Column:
    """When a record is filed: durations at their end, all others at their start."""
    return F.when(F.col("measure") == "duration", F.coalesce("end_ts", "start_ts")).otherwise(F.col("start_ts"))


def bounded(df: DataFrame, column: str, first: str | None, last: str | None, closed: bool = False) -> DataFrame:
    if first is not None:
        df = df.where(F.col(column) >= F.expr(f"timestamp_ntz'{first}'"))
    if last is not None:
        end = F.expr(f"timestamp_ntz'{last}'")
        df = df.where(F.col(column) <= end if closed else F.col(column) < end)
    return df


def union_by_bucket(rows: DataFrame, grain: str, tz: str) -> DataFrame:
    """(type, bucket_start, micros, seconds) of merged intervals, each filed whole where it ends: in (lo, hi], so midnight is the old day's.

    ``rows`` (type, start_ts, end_ts) are merged over the whole range first and filed then.
    """
    whole = union_islands(rows)
    end = F.col("end_ts") - F.expr("interval 1 microsecond")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = whole.groupBy("type", bucket_start(end, grain, tz).alias("bucket_start")).agg(F.sum(micros("end_ts") - micros("start_ts")).alias("micros"))
    return out.withColumn("seconds", F.col("micros") / 1e6)


def aggregate(sample: DataFrame, measures: DataFrame, grain: str = "day", tz: str = "UTC", first: str | None = None, last: str | None = None) -> DataFrame:
    """Sum, plain average, extremes and count of each bucket that holds a value, and the value its measure calls for.

    Bounds are inclusive at both ends.  The seconds of a duration come from merged intervals that
    start two days before the first bucket or later; they are not cut at the bounds.  Units are not
    looked at.
    """
    rows = with_measure(sample, measures).withColumn("filed", filed()).where(F.col("value").isNotNull())
    inside = bounded(rows, "filed", first, last, closed=True).withColumn("bucket_start", bucket_start(F.col("filed"), grain, tz))
    sums = inside.groupBy("type", "measure", "bucket_start").agg(
        F.sum("value").alias("sum"), F.avg("value").alias("average"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.count(F.lit(1)).alias("count"), F.sum(counts()).alias("counted")
    )
    stretches = with_measure(sample, measures.where("kind = 'duration'")).where(F.col("end_ts").isNotNull() & (counts() == 1))
    if first is not None:
        low = bucket_start(F.expr(f"timestamp_ntz'{first}'"), grain, tz)
        stretches = stretches.where(F.col("start_ts") >= low - F.expr("interval 2 days"))
    seconds = union_by_bucket(stretches.select("type", "start_ts", "end_ts"), grain, tz)
    both = sums.join(seconds, ["type", "bucket_start"], "left")
    value = (
        F.when(F.col("measure") == "total", F.col("sum"))
        .when(F.col("measure") == "average", F.col("average"))
        .when(F.col("measure") == "duration", F.expr("coalesce((micros + 500) div 1000, 0) / 1000"))
        .otherwise(F.col("counted").cast("double"))
    )
    return both.select("type", "bucket_start", "measure", "sum", "average", "minimum", "maximum", "count", "counted", value.alias("value"))


def series(sample: DataFrame, measures: DataFrame, plan: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    """Every bucket of ``plan`` (idx, bucket_start, bucket_end) for every type of ``sample``, empty ones with zero counts.

    Averages are weighted by readings, totals are not multiplied; minima and maxima of an empty
    bucket are null.  The seconds of a duration are those of merged intervals that start from two days
    before the plan to its end, filed whole where they end; of other types, the sum of what rows last.
    Both are rounded to milliseconds.  The plan is a bounded dimension and is laid under each type by
    an exploded array.
    """
    rows = with_measure(sample, measures).withColumn("filed", filed()).withColumn("n", counts())
    rows = rows.withColumn("bucket_start", bucket_start(F.col("filed"), grain, tz)).withColumn("readings", F.coalesce("reading_count", F.lit(1)))
    number = F.col("value").isNotNull() & (F.col("n") == 1)
    took = seconds_between(F.col("start_ts"), F.col("end_ts"))
    sums = rows.groupBy("type", "bucket_start").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("n").alias("counted_rows"),
        F.sum(F.when(number, F.col("value"))).alias("total"),
        F.sum(F.when(number, F.col("value") * F.col("readings"))).alias("weighted"),
        F.sum(F.when(number, F.col("readings"))).alias("weight"),
        F.min(F.when(number, F.col("value"))).alias("minimum"),
        F.max(F.when(number, F.col("value"))).alias("maximum"),
        F.sum("readings").alias("all_readings"),
        F.count_distinct(local_day(F.col("filed"), tz)).alias("days"),
        F.sum(F.when((F.col("n") == 1) & (F.col("measure") != "duration"), F.coalesce(took, F.lit(0.0)))).alias("_lasted"),
    )
    ends = plan.agg(F.min("bucket_start").alias("_low"), F.max("bucket_end").alias("_high"))
    stretches = rows.where((F.col("measure") == "duration") & (F.col("n") == 1) & F.col("end_ts").isNotNull()).join(F.broadcast(ends))
    inside = (F.col("start_ts") >= utc_ts(F.col("_low"), tz) - F.expr("interval 2 days")) & (F.col("start_ts") < utc_ts(F.col("_high"), tz))
    merged = union_by_bucket(stretches.where(inside).select("type", "start_ts", "end_ts"), grain, tz).select("type", "bucket_start", F.col("seconds").alias("_merged"))
    span = plan.agg(F.sort_array(F.collect_list(F.struct("idx", "bucket_start", "bucket_end"))).alias("plan"))  # bounded by the plan's guard
    types = sample.select("type").distinct().join(measures.select("type", F.col("kind").alias("measure")), "type").join(F.broadcast(span))
    laid = types.select("type", "measure", F.inline("plan"))
    full = laid.join(sums, ["type", "bucket_start"], "left").join(merged, ["type", "bucket_start"], "left")
    full = full.withColumn("seconds", F.round(F.coalesce("_merged", "_lasted", F.lit(0.0)), 3))
    zero = ["samples", "counted_rows", "weight", "all_readings", "days"]
    return full.na.fill(0, zero).na.fill(0.0, ["total", "weighted"]).select("type", "measure", "idx", "bucket_start", "bucket_end", *zero, "total", "weighted", "minimum", "maximum", "seconds")


def column_value(mixed: Column) -> Column:
    """What to draw for a bucket of ``series``; null for an empty bucket or where units are mixed."""
    value = (
        F.when(F.col("measure") == "total", F.when(F.col("weight") > 0, F.col("total")))
        .when(F.col("measure") == "average", F.try_divide("weighted", F.col("weight").cast("double")))
        .when(F.col("measure") == "duration", F.col("seconds"))
        .otherwise(F.col("counted_rows").cast("double"))
    )
    return F.when(mixed | (F.col("samples") == 0), None).otherwise(value)


def unit_guard(sample: DataFrame) -> DataFrame:
    """(type, units, unit_count, mixed): the distinct units of each type."""
    rows = sample.where(F.col("unit").isNotNull() & (F.col("unit") != "")).groupBy("type").agg(F.sort_array(F.collect_set("unit")).alias("units"))
    return rows.select("type", F.array_join("units", ",").alias("units"), F.size("units").cast("long").alias("unit_count"), (F.size("units") > 1).alias("mixed"))


def headline(columns: DataFrame, units: DataFrame) -> DataFrame:
    """(type, measure, headline, lowest, highest, samples, readings): one number per type, null if units are mixed or nothing counts."""
    kept = columns.groupBy("type", "measure").agg(
        F.sum("total").alias("total"), F.sum("weighted").alias("weighted"), F.sum("weight").alias("weight"), F.sum("seconds").alias("seconds"),
        F.sum("counted_rows").alias("counted_rows"), F.sum("samples").alias("samples"), F.sum("all_readings").alias("readings"),
        F.min("minimum").alias("lowest"), F.max("maximum").alias("highest"),
    )
    guarded = kept.join(units.select("type", "mixed"), "type", "left")
    return guarded.select("type", "measure", column_value(F.coalesce("mixed", F.lit(False))).alias("headline"), "lowest", "highest", "samples", "readings")


def coverage(columns: DataFrame) -> DataFrame:
    """(type, days_with_data, days, first_bucket, last_bucket, leading_empty): how much of the range has data."""
    held = F.col("samples") > 0
    out = columns.groupBy("type").agg(
        F.sum("days").alias("days_with_data"), F.sum(F.greatest(F.datediff("bucket_end", "bucket_start"), F.lit(1))).alias("days"),
        F.min(F.when(held, F.col("bucket_start"))).alias("first_bucket"), F.max(F.when(held, F.col("bucket_start"))).alias("last_bucket"),
        F.min(F.when(held, F.col("idx"))).alias("leading_empty"),
    )
    return out.withColumn("leading_empty", F.col("leading_empty").cast("long")).withColumn("days", F.col("days").cast("long"))


def latest_bucket(columns: DataFrame) -> DataFrame:
    """(type, bucket_start, samples): each type's last bucket that has data."""
    held = columns.where(F.col("samples") > 0)
    return held.groupBy("type").agg(F.max("bucket_start").alias("bucket_start"), F.max_by("samples", "bucket_start").alias("samples"))


def summary(columns: DataFrame, units: DataFrame) -> DataFrame:
    """``headline`` with active_buckets, and for totals average_per_active; every figure is null where units are mixed."""
    active = columns.groupBy("type").agg(F.sum(F.when(F.col("samples") > 0, 1).otherwise(0)).alias("active_buckets"))
    rows = headline(columns, units).join(active, "type").join(units.select("type", "mixed"), "type", "left")
    told = lambda c: F.when(~F.coalesce("mixed", F.lit(False)), c)
    per = F.when(F.col("measure") == "total", F.try_divide("headline", F.col("active_buckets").cast("double")))
    return rows.select("type", "measure", told(F.col("headline")).alias("headline"), *(told(F.col(c)).alias(c) for c in ("lowest", "highest", "samples", "readings", "active_buckets")), told(per).alias("average_per_active"))


def sparklines(columns: DataFrame) -> DataFrame:
    """(type, drawn, shown): buckets with data, and whether two or more make a line."""
    drawn = F.sum(F.when(F.col("samples") > 0, 1).otherwise(0))
    return columns.groupBy("type").agg(drawn.alias("drawn"), (drawn >= 2).alias("shown"))


def type_summaries(sample: DataFrame) -> DataFrame:
    return sample.groupBy("type").agg(F.count(F.lit(1)).alias("records"), F.max("unit").alias("unit"), F.min("start_ts").alias("earliest"), F.max("start_ts").alias("latest"))


def density(sample: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    return sample.groupBy(bucket_start(F.col("start_ts"), grain, tz).alias("bucket_start")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("type").alias("types"))


def span(sample: DataFrame) -> DataFrame:
    return sample.agg(F.min("start_ts").alias("earliest"), F.max("start_ts").alias("latest"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the exact value of rank n // 2 + 1 of the n rows of a key; null where nulls, which come last, reach it.

    Only the middle is sorted, as counts of its distinct values: hundredths by mergeable sketches,
    whose own error is a hundredth of one, bound it from both sides.
    """
    hundredths = F.percentile_approx(value, F.array(*(F.lit(i / 100) for i in range(101))), F.lit(10_000))
    told = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known"), hundredths.alias("_cuts"))
    told = told.withColumn("_rank", F.floor(F.col("_n") / 2) + 1).withColumn("_at", F.floor(F.col("_rank") * 100 / F.greatest("_known", F.lit(1))))
    cut = lambda i: F.element_at("_cuts", (F.least(F.greatest(i, F.lit(0)), F.lit(100)) + 1).cast("int"))
    # A row per key.
    told = F.broadcast(told.select(F.col(key).alias("_key"), "_rank", F.when(F.col("_at") > 1, cut(F.col("_at") - 1)).alias("_low"), F.when(F.col("_at") < 98, cut(F.col("_at") + 2)).alias("_high")))
    met = rows.where(F.col(value).isNotNull()).join(told, F.col(key).eqNullSafe(F.col("_key")))
    place = F.when(F.col(value) < F.col("_low"), -1).when(F.col(value) > F.col("_high"), 1).otherwise(0)
    counts = met.groupBy("_key", "_rank", F.when(place == 0, F.col(value)).alias("_v"), place.alias("_place")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_place", "_v").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
    # The sketches' bounds hold the rank; should they ever not, it is an error and no wrong value.
    v = F.when(F.col("_place") == 0, F.col("_v")).otherwise(F.raise_error(F.lit("the middle is outside its bounds")).cast(rows.schema[value].dataType))
    keys = rows.select(key).distinct()
    return keys.join(found.select("_key", v.alias(value)), F.col(key).eqNullSafe(F.col("_key")), "left").select(key, value)


def newest(sample: DataFrame, limit: int, type_: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Newest first, both bounds inclusive, ties by id; a negative limit is none at all."""
    rows = bounded(sample if type_ is None else sample.where(F.col("type") == type_), "start_ts", first, last, closed=True)
    rows = rows.orderBy(F.desc("start_ts"), "id")
    return rows if limit < 0 else rows.limit(limit)


def fallback_window(sample: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """(type, window_end, earlier, records): where a type has no value in [first, last), the same span up to its own last record."""
    asked = (F.col("start_ts") >= F.expr(f"timestamp_ntz'{first}'")) & (F.col("start_ts") < F.expr(f"timestamp_ntz'{last}'")) & F.col("value").isNotNull()
    ends = sample.groupBy("type").agg(F.max("start_ts").alias("latest"), F.count(F.when(asked, 1)).alias("inside"))
    ends = ends.withColumn("earlier", F.col("inside") == 0)
    ends = ends.withColumn("window_end", F.when(F.col("earlier"), F.date_add(F.to_date("latest"), 1).cast("timestamp_ntz")).otherwise(F.expr(f"timestamp_ntz'{last}'")))
    rows = sample.where(F.col("value").isNotNull()).join(ends, "type")
    low = F.col("window_end") - F.expr(f"interval {days} days")
    held = F.sum(F.when((F.col("start_ts") >= low) & (F.col("start_ts") < F.col("window_end")), 1).otherwise(0))
    return rows.groupBy("type", "window_end", "earlier").agg(held.alias("records"))


def histogram(sample: DataFrame, measures: DataFrame, first: str | None = None, last: str | None = None, buckets: int = 24) -> DataFrame:
    """(type, idx, lower, upper, n): equal bands between a type's extremes, the last one closed, empty ones with 0.

    Only totals and averages; rows count their readings where the value is their mean.  More than one
    unit gives no rows, equal values give one band.
    """
    rows = bounded(with_measure(sample, measures.where(F.col("kind").isin("total", "average"))), "start_ts", first, last).where(F.col("value").isNotNull())
    weight = F.when(F.col("measure") == "average", F.coalesce("reading_count", F.lit(1))).otherwise(F.lit(1))
    bounds = rows.groupBy("type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("unit").alias("units")).where("units <= 1")
    wide = (F.col("high") - F.col("low")) / F.lit(float(buckets))
    spot = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / F.when(wide > 0, wide)), F.lit(buckets - 1))).otherwise(F.lit(0))
    sums = rows.select("type", "value", weight.alias("w")).join(bounds, "type").groupBy("type", spot.cast("int").alias("idx")).agg(F.sum("w").alias("n"))
    last_band = F.when(F.col("high") > F.col("low"), buckets - 1).otherwise(0)
    bands = bounds.select("type", "low", "high", F.explode(F.sequence(F.lit(0), last_band)).alias("idx"))
    upper = F.when(F.col("high") > F.col("low"), F.col("low") + wide * (F.col("idx") + 1)).otherwise(F.col("high"))
    return bands.join(sums, ["type", "idx"], "left").select("type", "idx", (F.col("low") + wide * F.col("idx")).alias("lower"), upper.alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def daily_view(sample: DataFrame, tz: str) -> DataFrame:
    return sample.where(F.col("value").isNotNull()).groupBy(local_day(F.col("start_ts"), tz).alias("local_day"), "type", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.avg("value").alias("average"), F.min("value").alias("minimum"), F.max("value").alias("maximum")
    )
