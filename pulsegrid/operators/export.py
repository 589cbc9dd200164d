"""Exports: day summaries, runs of a type, relational tables, columns by kind, year totals, catalogue and resumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import bucket_plan, local_day, local_ts, seconds_between
from pulsegrid.functions.names import catalogue_name, csv_field, measure_kind, plain_number
from pulsegrid.operators.series import union_by_bucket
from pulsegrid.schema import DETAIL_KINDS, HIGHLIGHTS, KIND_COLUMNS, METRIC_NAMES

#: Workouts that a note lists; sleep values that are asleep, and in bed.
LISTED_WORKOUTS, ASLEEP, IN_BED = 25, (1, 3, 4, 5), (0,)
_SLEEP = "HKCategoryTypeIdentifierSleepAnalysis"


def day_summaries(sample: DataFrame, tz: str) -> DataFrame:
    """(day, records, workouts, workout_seconds, asleep_seconds, in_bed_seconds, sleep_segments, one column per highlight).

    A record is of the local day that it starts in.  Totals and means are of quantities only; sleep is the
    time covered, filed whole where it ends, whatever how many devices recorded it.
    """
    quantity, workout, sleep = F.col("kind") == "quantity", F.col("kind") == "workout", F.col("type") == _SLEEP
    number = lambda t: F.when(quantity & (F.col("type") == t), F.col("value"))
    figures = [(F.sum if how == "total" else F.avg)(number(t)).alias(name) for t, name, how in HIGHLIGHTS]
    took = F.coalesce(seconds_between(F.col("start_ts"), F.col("end_ts")), F.lit(0.0))
    days = sample.groupBy(local_day(F.col("start_ts"), tz).alias("day")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.when(workout, 1).otherwise(0)).alias("workouts"), F.sum(F.when(workout, took).otherwise(0.0)).alias("workout_seconds"),
        F.sum(F.when(sleep, 1).otherwise(0)).alias("sleep_segments"), *figures,
    )
    stage = F.when(F.col("value").isin(*ASLEEP), "asleep").when(F.col("value").isin(*IN_BED), "in_bed")
    stretches = sample.where(sleep & stage.isNotNull() & (F.col("end_ts") > F.col("start_ts"))).select(stage.alias("type"), "start_ts", "end_ts")
    covered = union_by_bucket(stretches, "day", tz).groupBy(F.to_date("bucket_start").alias("day")).agg(*(F.sum(F.when(F.col("type") == s, F.col("seconds"))).alias(f"{s}_seconds") for s in ("asleep", "in_bed")))
    return days.join(covered, "day", "full").na.fill(0, ["records", "workouts", "sleep_segments"]).na.fill(0.0, ["workout_seconds", "asleep_seconds", "in_bed_seconds"])


def listed_workouts(workouts: DataFrame, tz: str) -> DataFrame:
    """(day, place, started, activity, seconds): the first ``LISTED_WORKOUTS`` of each local day."""
    rows = workouts.select(local_day(F.col("start_ts"), tz).alias("day"), "id", "activity", "start_ts", seconds_between(F.col("start_ts"), F.col("end_ts")).alias("seconds"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("start_ts", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= LISTED_WORKOUTS).select("day", "place", F.date_format(local_ts(F.col("start_ts"), tz), "HH:mm").alias("started"), "activity", "seconds")


def type_runs(records: DataFrame, slot: str, order: list[str], key: str = "type") -> DataFrame:
    """``records`` with entry: the file of each unbroken run of one type in the order (slot, ``order``), ``type-2`` for a type's second run.

    Rows are ordered within slots (days, say); only one row for each slot and type goes through a window
    over all slots.
    """
    inside = Window.partitionBy(slot).orderBy(*order)
    rows = records.withColumn("_before", F.lag(key).over(inside))
    ends = records.groupBy(slot).agg(F.max_by(key, F.struct(*order)).alias("_last"))
    led = ends.select(slot, F.lag("_last").over(Window.orderBy(slot)).alias("_led"))
    rows = rows.join(led, slot).withColumn("_fresh", F.when(F.col(key).eqNullSafe(F.coalesce("_before", "_led")), 0).otherwise(1))
    begun = rows.groupBy(slot, key).agg(F.sum("_fresh").alias("_n"))
    upto = Window.partitionBy(key).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select(slot, F.col(key).alias("_key"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_done"))
    own = Window.partitionBy(slot, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_fresh").over(own))
    met = rows.join(begun.withColumnRenamed(slot, "_slot"), (F.col(slot) == F.col("_slot")) & F.col(key).eqNullSafe(F.col("_key")))
    number = F.col("_run") + F.col("_done")
    return met.select(*records.columns, F.concat(F.col(key), F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise("")).alias("entry"))


def kind_csv(records: DataFrame, kind: str) -> DataFrame:
    """(id, line): the rows of one kind with that kind's own columns; a column that ``records`` lacks is empty."""
    shown = [csv_field(plain_number(F.col(c)) if dict(records.dtypes).get(c) == "double" else F.col(c).cast("string")) if c in records.columns else F.lit("") for c in KIND_COLUMNS.get(kind, KIND_COLUMNS[""])]
    return records.select("id", F.concat_ws(",", *shown).alias("line"))


def relational(sample: DataFrame) -> dict[str, DataFrame]:
    """The tables of a relational export: sources, units and types beside the records, each with its count and span."""
    span = [F.count(F.lit(1)).alias("records"), F.min("start_ts").alias("first_start"), F.max("start_ts").alias("last_start")]
    return {"record": sample, "source": sample.groupBy("source_name").agg(*span), "type": sample.groupBy("type", "kind").agg(*span), "unit": sample.where(F.coalesce("unit", F.lit("")) != "").groupBy("type", "unit").agg(*span)}


def year_totals(workouts: DataFrame, tz: str) -> DataFrame:
    """(year, workouts, seconds, energy): no mean heart rate, which workouts of unlike length don't have."""
    return workouts.groupBy(F.year(local_day(F.col("start_ts"), tz)).alias("year")).agg(F.count(F.lit(1)).alias("workouts"), F.sum("duration").alias("seconds"), F.sum("energy").alias("energy"))


def with_notice(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows, and truncated: whether there were more."""
    some = rows.orderBy(*order).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # over limit + 1 rows
    marked = some.withColumn("_place", place).withColumn("truncated", F.max("_place").over(Window.partitionBy()) > limit)
    return marked.where(F.col("_place") <= limit).drop("_place")


def measures_of(sample: DataFrame) -> DataFrame:
    """(type, kind, unit) of every type, with its smallest unit; types without a unit are there too."""
    return sample.groupBy("type").agg(F.min(F.nullif("unit", F.lit(""))).alias("unit")).select("type", measure_kind(F.col("type")).alias("kind"), "unit")


def unsettled(types: DataFrame, runs: DataFrame, key: str = "type") -> DataFrame:
    """Types that a resumed run still has to export: those without a settled state."""
    return types.join(runs.where(F.col("state").isin("complete", "empty")).select(key).distinct(), key, "left_anti")


def chained(starts: DataFrame, key: str, start: str, last: Column) -> DataFrame:
    """``starts`` with bucket_end: the next start of the key, ``last`` for the last one."""
    return starts.withColumn("bucket_end", F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start)), last))


def preset_plan(spark: SparkSession, preset: str, now: str, first: str | None = None) -> DataFrame:
    """(idx, bucket_start, bucket_end) of a range: 7d and 30d of days, 53w of weeks from Sunday, all of months since ``first``; ``now`` is local."""
    if preset not in ("7d", "30d", "53w", "all"):
        raise ValueError(f"range must be 7d, 30d, 53w or all, not {preset!r}")
    at = F.lit(now).cast("timestamp_ntz")
    day = F.date_trunc("day", at)
    sunday = F.date_sub(F.to_date(at), F.dayofweek(F.to_date(at)) - 1).cast("timestamp_ntz")
    low, high, grain = {
        "7d": (day - F.expr("interval 6 days"), day, "day"), "30d": (day - F.expr("interval 29 days"), day, "day"),
        "53w": (sunday - F.expr("interval 364 days"), sunday, "week"), "all": (F.date_trunc("month", F.lit(first or now).cast("timestamp_ntz")), F.date_trunc("month", at), "month"),
    }[preset]
    told = spark.range(1).select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n) for n, c in (("low", low), ("high", high)))).first()
    return bucket_plan(spark, told.low, told.high, grain)


def rehomed(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, pages): pages and end markers that were filed as samples go to the pages."""
    page = F.coalesce(F.col("kind").isin(*DETAIL_KINDS), F.lit(False))
    return samples.where(~page), samples.where(page)


def resumed(pages: DataFrame, anchors: DataFrame, series: str = "sample_id") -> DataFrame:
    """Pages that an interrupted delivery still owes: of the pending sample those from ``delivered`` on, later samples whole.

    ``anchors``: destination, pending (a sample), delivered (its elements).  Samples go in the order of their ids.
    """
    met = pages.join(F.broadcast(anchors), F.col(series) >= F.col("pending"))  # a row per destination
    return met.where((F.col(series) > F.col("pending")) | (F.col("offset") >= F.col("delivered"))).drop("pending", "delivered")


def wave_state(points: Column, expected: Column) -> Column:
    """What a list says of a recording's points."""
    return F.when(points == 0, "no voltages stored").when(expected.isNull(), F.concat(points.cast("string"), F.lit(" points, total unknown"))).when(points >= expected, F.concat(points.cast("string"), F.lit(" points, complete"))).otherwise(F.concat(points.cast("string"), F.lit(" of "), expected.cast("string"), F.lit(" points")))


def catalogue(spark: SparkSession) -> DataFrame:
    """(type, kind, measure, metric, name, family): the listed identifiers; family by the words of the name."""
    rows = spark.createDataFrame(sorted(METRIC_NAMES.items()), "type string, metric string")
    kind = F.when(F.col("type").startswith("HKCategory"), "category").otherwise("quantity")
    family = (
        F.when(F.col("type").rlike("Dietary|Alcoholic"), "nutrition").when(F.col("type").rlike("Heart|Blood|VO2|Perfusion|Fibrillation"), "heart").when(F.col("type").rlike("Sleep|Mindful"), "sleep and mind")
        .when(F.col("type").rlike("Respiratory|Forced|Expiratory|Inhaler"), "breathing").when(F.col("type").rlike("Walking|Running|Cycling|Swimming|Distance|Step|Stair|Energy|Exercise|Move|Stand|Flights|Push|Effort"), "activity")
        .when(F.col("type").rlike("Body|Height|Waist|Lean"), "body").otherwise("other")
    )
    return rows.select("type", kind.alias("kind"), measure_kind(F.col("type")).alias("measure"), "metric", catalogue_name(F.col("type")).alias("name"), family.alias("family"))


def catalogue_search(entries: DataFrame, text: str) -> DataFrame:
    """Entries whose name or metric has the text, in the order of family and name; an empty text has all."""
    low = text.strip().lower()
    return entries.where(F.lower("name").contains(low) | F.col("metric").contains(low)).orderBy("family", "name")
