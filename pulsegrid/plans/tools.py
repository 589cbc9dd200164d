"""The question surface: thirteen tools over an archive, each a DataFrame.  Arguments are checked, never silently ignored."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import GRAINS, local_day
from pulsegrid.functions.names import activity_name
from pulsegrid.operators import domain, pages, series, state, stats

_STAMP = "%Y-%m-%d %H:%M:%S.%f"


def parse_bound(text: str | None, tz: str, end: bool, argument: str = "date") -> str | None:
    """A UTC wall clock for a query's bound: a full instant as it is, a bare date as its local start or last millisecond, a zoneless time as local."""
    if text is None:
        return None
    zone = ZoneInfo(tz)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        day = datetime.fromisoformat(text).replace(tzinfo=zone)
        at = (datetime.fromisoformat(text) + timedelta(days=1)).replace(tzinfo=zone).astimezone(timezone.utc) - timedelta(milliseconds=1) if end else day
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?", text):
        at = datetime.fromisoformat(text)
        at = at if at.tzinfo else at.replace(tzinfo=zone)
    else:
        raise ValueError(f"{argument}: {text!r} is no date or time")
    return at.astimezone(timezone.utc).strftime(_STAMP)


def limited(asked: int | None, default: int, most: int) -> int:
    return default if asked is None else max(1, min(asked, most))


@dataclass
class Archive:
    """An archive's tables; those that are missing have no answers."""

    sample: DataFrame
    measures: DataFrame
    coverage: DataFrame
    tz: str = "UTC"
    now: str = field(default_factory=lambda: datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
    mood: DataFrame | None = None
    doses: DataFrame | None = None
    workouts: DataFrame | None = None
    statistics: DataFrame | None = None
    ecg: DataFrame | None = None
    ecg_pages: DataFrame | None = None
    audiograms: DataFrame | None = None

    def _since(self, days: int) -> str:
        if not 1 <= days <= 3650:
            raise ValueError("days must be from 1 to 3650")
        return (datetime.fromisoformat(self.now) - timedelta(days=days)).strftime(_STAMP)

    def _bounds(self, first: str | None, last: str | None) -> tuple[str | None, str | None]:
        a, b = parse_bound(first, self.tz, False, "from"), parse_bound(last, self.tz, True, "to")
        if a and b and a > b:
            raise ValueError("from is later than to")
        return a, b

    def _daily(self, type_: str, days: int) -> DataFrame:
        rows = self.sample.where(F.col("type") == type_)
        out = series.aggregate(rows, self.measures, "day", self.tz, self._since(days), self.now)
        return out.select("type", F.to_date("bucket_start").alias("day"), "value", F.col("count").alias("records"))

    def list_health_types(self) -> DataFrame:
        return state.standing(series.type_summaries(self.sample), self.coverage)

    def summarise_health_data(self) -> DataFrame:
        """One row: totals, span, and the types whose history isn't complete or of which nothing was told."""
        told = self.list_health_types()
        return told.agg(
            F.sum("records").alias("records"), F.count(F.lit(1)).alias("types"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"),
            F.sum(F.when(F.col("standing") == "incomplete", 1).otherwise(0)).alias("unfinished"), F.sum(F.when(F.col("standing") == "untold", 1).otherwise(0)).alias("untold"),
        )

    def largest_types(self) -> DataFrame:
        return series.type_summaries(self.sample).orderBy(F.desc("records"), "type").limit(10)

    def aggregate_health_data(self, type_: str, bucket: str = "day", first: str | None = None, last: str | None = None) -> DataFrame:
        if bucket not in GRAINS[:4]:
            raise ValueError(f"bucket must be one of {', '.join(GRAINS[:4])}")
        a, b = self._bounds(first, last)
        return series.aggregate(self.sample.where(F.col("type") == type_), self.measures, bucket, self.tz, a, b)

    def list_health_samples(self, type_: str | None = None, first: str | None = None, last: str | None = None, limit: int | None = None) -> DataFrame:
        a, b = self._bounds(first, last)
        return series.newest(self.sample, limited(limit, 100, 1000), type_, a, b)

    def analyse_health_trend(self, type_: str, days: int = 90) -> DataFrame:
        return stats.trend(self._daily(type_, days), ["type"])

    def compare_health_types(self, first: str, second: str, days: int = 180) -> DataFrame:
        x = self._daily(first, days).select("day", F.col("value").alias("x"))
        y = self._daily(second, days).select("day", F.col("value").alias("y"))
        pair = F.lit(f"{first} / {second}").alias("pair")
        return stats.correlation(x.join(y, "day").select(pair, "day", "x", "y"), ["pair"])

    def find_health_anomalies(self, type_: str, days: int = 90) -> DataFrame:
        return stats.anomalies(self._daily(type_, days), ["type"]).orderBy(F.desc(F.abs("deviations")), "day").limit(20)

    def anomaly_report(self, type_: str, days: int = 90) -> DataFrame:
        return stats.anomaly_report(self._daily(type_, days), ["type"])

    def explain_empty_series(self, type_: str, days: int = 90) -> DataFrame:
        """(type, records, inside, standing, reason): why a type has nothing to show."""
        at = F.expr(f"timestamp_ntz'{self._since(days)}'")
        rows = self.sample.where(F.col("type") == type_).agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("start_ts") >= at, F.col("value"))).alias("inside")).select(F.lit(type_).alias("type"), "records", "inside")
        met = state.standing(rows, self.coverage)
        reason = F.when(F.col("records") == 0, "no_such_type").when(F.col("inside") > 0, "has_values").when(F.col("standing") == "complete", "gap").otherwise(F.col("standing"))
        return met.select("type", "records", "inside", "standing", reason.alias("reason"))

    def list_mood_entries(self, days: int = 90, limit: int | None = None) -> DataFrame:
        rows = self.mood.where(F.col("at") >= F.expr(f"timestamp_ntz'{self._since(days)}'"))
        return rows.withColumn("band", domain.valence_band(F.col("valence"))).orderBy(F.desc("at"), "id").limit(limited(limit, 100, 1000))

    def summarise_medication_adherence(self, days: int = 90) -> DataFrame:
        return domain.adherence(self.doses.where(F.col("at") >= F.expr(f"timestamp_ntz'{self._since(days)}'")))

    def list_workouts(self, days: int = 90, limit: int | None = None) -> DataFrame:
        rows = self.workouts.where(F.col("start_ts") >= F.expr(f"timestamp_ntz'{self._since(days)}'")).withColumn("activity", activity_name(F.col("activity_type")))
        return domain.workouts(rows, self.statistics).orderBy(F.desc("start_ts"), "id").limit(limited(limit, 50, 500))

    def list_electrocardiograms(self, limit: int | None = None) -> DataFrame:
        """Headers with their pages: complete by count alone, as a list tells it."""
        held = self.ecg_pages.groupBy(F.col("sample_id").alias("id")).agg(F.sum("count").alias("points"))
        rows = self.ecg.join(held, "id", "left").na.fill(0, ["points"])
        complete = F.coalesce((F.col("expected") > 0) & (F.col("points") >= F.col("expected")), F.lit(False))
        return rows.withColumn("complete", complete).orderBy(F.desc("start_ts"), "id").limit(limited(limit, 50, 500))

    def get_electrocardiogram_voltages(self, id_: str, limit: int | None = None) -> DataFrame:
        """(pos, voltage) of the first points in order."""
        rows = pages.latest(self.ecg_pages.where(F.col("sample_id") == id_), ["sample_id", "sequence"], ["arrival"])
        points = rows.select("offset", F.posexplode("points").alias("i", "point")).select((F.col("offset") + F.col("i")).alias("pos"), "point.*")
        return points.orderBy("pos").limit(limited(limit, 500, 20_000))

    def list_audiograms(self, limit: int | None = None) -> DataFrame:
        newest = self.audiograms.select("id", "start_ts").distinct().orderBy(F.desc("start_ts"), "id").limit(limited(limit, 20, 200))
        rows = self.audiograms.join(newest.select("id"), "id")
        told = F.when(F.col("clamped"), F.concat(F.lit("at least "), F.col("sensitivity").cast("string"))).otherwise(F.col("sensitivity").cast("string"))
        return rows.withColumn("shown", told).orderBy("id", "frequency", "ear")

    def samples_of_day(self, day: str) -> DataFrame:
        return self.sample.where(local_day(F.col("start_ts"), self.tz) == F.lit(day).cast("date"))
