"""Domain questions: mood, doses, workouts, hearing thresholds, routes and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adherence(doses: DataFrame) -> DataFrame:
    """(medication, status, doses, first_at, last_at); statuses are never merged, a missing one is unrecorded."""
    name = F.coalesce("medication", F.lit("Unnamed medication"))
    return doses.groupBy(name.alias("medication"), F.coalesce("status", F.lit("unrecorded")).alias("status")).agg(F.count(F.lit(1)).alias("doses"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def adherence_map(doses: DataFrame) -> DataFrame:
    rows = adherence(doses).groupBy("medication").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "doses")))).alias("statuses"))
    return rows


def association_top(mood: DataFrame, text: str, n: int = 10) -> DataFrame:
    word = F.trim(F.col("_word"))
    split = mood.select(F.explode(F.split(text, ",")).alias("_word")).select(word.alias("name")).where("name <> ''")
    return split.groupBy("name").agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "name").limit(n)


def mood_means(mood: DataFrame) -> DataFrame:
    """Means within one kind of entry only."""
    kind = F.when(F.col("kind") == "dailyMood", "daily").otherwise("momentary")
    return mood.groupBy(kind.alias("entry_kind")).agg(F.avg("valence").alias("mean_valence"), F.count(F.lit(1)).alias("entries"))


def valence_band(v: Column) -> Column:
    """Bounds and words of the bands."""
    return F.when(v < -0.6, "very unpleasant").when(v < -0.2, "unpleasant").when(v < 0.2, "neutral").when(v < 0.6, "pleasant").otherwise("very pleasant")


def workouts(headers: DataFrame, statistics: DataFrame) -> DataFrame:
    """Workouts (id, …) with whole-workout figures and those of their legs; a figure that isn't there is null, not 0.

    ``statistics``: workout_id, leg ('' for the whole), type, sum, average, minimum, maximum.
    """
    figure = F.struct("type", "sum", "average", "minimum", "maximum")
    whole = statistics.where("leg = ''").groupBy("workout_id").agg(F.sort_array(F.collect_list(figure)).alias("figures"))
    legs = statistics.where("leg <> ''").groupBy("workout_id", "leg").agg(F.sort_array(F.collect_list(figure)).alias("f")).groupBy("workout_id").agg(F.sort_array(F.collect_list(F.struct("leg", "f"))).alias("legs"))
    return headers.join(whole, headers.id == whole.workout_id, "left").drop("workout_id").join(legs, headers.id == legs.workout_id, "left").drop("workout_id")


def distance_rules(statistics: DataFrame, priority: list[str]) -> DataFrame:
    """Three rules side by side: the only positive distance, the sum of all, and the first of a priority list."""
    rows = statistics.where(F.col("type").contains("Distance")).groupBy("workout_id", "type").agg(F.sum("sum").alias("metres"))
    rank = F.coalesce(*(F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(priority)), F.lit(len(priority)))
    rows = rows.withColumn("rank", rank)
    some = F.col("metres") > 0
    sums = rows.groupBy("workout_id").agg(
        F.sum(F.when(some, 1).otherwise(0)).alias("_positive"), F.sum(F.when(some, F.col("metres"))).alias("_sole"), F.sum("metres").alias("_total"),
        F.min_by(F.col("metres"), F.when(F.col("metres").isNotNull() & (F.col("rank") < len(priority)), F.col("rank"))).alias("first_listed"), F.count_distinct("type").alias("kinds"),
    )
    return sums.select("workout_id", F.when(F.col("_positive") == 1, F.col("_sole")).alias("sole"), F.when(F.col("_total") > 0, F.col("_total")).alias("total"), "first_listed", "kinds")


def thresholds(audiograms: DataFrame) -> DataFrame:
    """(id, frequency, ear, sensitivity, masked, clamped): one row per ear of each point; clamped where a clamping range is there."""
    points = audiograms.select("id", F.explode("points").alias("p")).select("id", "p.frequency", F.explode("p.ears").alias("e"))
    return points.select("id", "frequency", "e.ear", "e.sensitivity", "e.masked", F.col("e.clamping").isNotNull().alias("clamped"))


def bounding_box(points: DataFrame, key: str, pad: float = 1.35, least: float = 0.004) -> DataFrame:
    """(key, centre and span of both axes); points off the globe or not finite are left out."""
    sound = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~F.isnan("lat") & ~F.isnan("lon")
    box = points.where(sound).groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))))
    axis = lambda c: [((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"{c}_centre"), F.greatest((F.col(f"max_{c}") - F.col(f"min_{c}")) * pad, F.lit(least)).alias(f"{c}_span")]
    return box.select(key, *axis("lat"), *axis("lon"))


def busiest(buckets: DataFrame, start: str = "bucket_start", records: str = "records") -> DataFrame:
    """The bucket of most records (the earliest of equals); no row where all are empty."""
    return buckets.where(F.col(records) > 0).orderBy(F.desc(records), start).limit(1)


def backfill(wanted: DataFrame, streams: DataFrame) -> DataFrame:
    """Counts of types that are complete, started, selected, empty, failed: complete only where every destination closed it.

    ``wanted``: destination, type; ``streams``: destination, type, records, closed, failed.
    """
    met = wanted.join(streams, ["destination", "type"], "left")
    got, shut, bad = F.coalesce("records", F.lit(0)), F.coalesce("closed", F.lit(False)), F.coalesce("failed", F.lit(False))
    types = met.groupBy("type").agg(F.bool_and(shut).alias("complete"), F.bool_or(shut | (got > 0)).alias("started"), F.sum(got).alias("records"), F.bool_or(bad).alias("failed"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return types.agg(n(F.col("complete")).alias("complete"), n(F.col("started")).alias("started"), F.count(F.lit(1)).alias("selected"), F.sum("records").alias("records"), n(F.col("complete") & (F.col("records") == 0)).alias("empty"), n(F.col("failed") & ~F.col("complete")).alias("failed"))


def delivery_rollup(receipts: DataFrame) -> DataFrame:
    return receipts.agg(F.max("last_success").alias("last_success"), F.sum("delivered").alias("delivered"), F.bool_or("needs_attention").alias("needs_attention"), (F.count(F.lit(1)) > 0).alias("any_destination"))


def inventory(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))


def storage_report(samples: DataFrame, raw: str = "raw") -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length(raw)).alias("bytes"))
