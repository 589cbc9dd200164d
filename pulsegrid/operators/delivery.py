"""Delivery and export: what is sent, in which units, from when on, and what each type's export came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.units import convert, preferred
from pulsegrid.functions.variants import whole_json
from pulsegrid.schema import DETAIL_KINDS

#: Days that a delivery floor may lie before today.
FLOORS = (0, 1, 7, 30)


def floor_at(now: Column, days: int | None, tz: str) -> Column:
    """UTC wall clock of local midnight ``days`` before today's; null for no floor."""
    from pulsegrid.functions.calendar import local_day, utc_ts

    if days is None:
        return F.lit(None).cast("timestamp_ntz")
    if days not in FLOORS:
        raise ValueError(f"a floor lies {', '.join(map(str, FLOORS))} days back")
    return utc_ts(F.date_sub(local_day(now, tz), days).cast("timestamp_ntz"), tz)


def admitted(records: DataFrame, floor: Column, at: str = "start_ts") -> DataFrame:
    """``records`` with admitted: undated ones always, others from the floor on."""
    return records.withColumn("admitted", floor.isNull() | F.col(at).isNull() | (F.col(at) >= floor))


def selected(records: DataFrame, selection: DataFrame | None, key: str = "type") -> DataFrame:
    """Only selected types; no selection, or an empty one, is everything."""
    if selection is None or selection.isEmpty():
        return records
    return records.join(selection.select(key).distinct(), key, "left_semi")


def without_details(records: DataFrame) -> DataFrame:
    """Without pages and end markers of series, which are no readings of their own."""
    return records.where(F.coalesce(~F.col("kind").isin(*DETAIL_KINDS), F.lit(True)))


def in_units(records: DataFrame, region: str) -> DataFrame:
    """Values and units in the region's; converted_from keeps the first unit, and what can't be converted stays as it is."""
    target = preferred(F.col("unit"), F.col("type"), region)
    value = convert(F.col("value"), F.col("unit"), target)
    moved = value.isNotNull() & (target != F.col("unit"))
    return records.withColumns({"value": F.when(moved, value).otherwise(F.col("value")), "unit": F.when(moved, target).otherwise(F.col("unit")), "converted_from": F.when(moved, F.col("unit"))})


def comparable(summaries: DataFrame, least: int = 10) -> DataFrame:
    return summaries.where(F.col("records") >= least)


def export_states(events: DataFrame, key: str = "type", order: str = "ordinal") -> DataFrame:
    """(key, summary, error): the last of each that isn't null."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return events.groupBy(key).agg(last("summary"), last("error"))


def readings(pages: DataFrame, elements: str = "readings") -> DataFrame:
    """One row per reading of series pages, at offset and position."""
    rest = [c for c in pages.columns if c != elements]
    return pages.select(*rest, F.posexplode(elements).alias("_i", "reading")).withColumn("place", F.col("offset") + F.col("_i")).drop("_i")


def dated(changes: DataFrame, first: Column, last: Column, limit: int, at: str = "start_ts") -> DataFrame:
    """Changes of a window, or none at all if it holds more than ``limit``: a part of a window is not passed off as the whole."""
    inside = changes.where((F.col(at) >= first) & (F.col(at) < last))
    fits = inside.limit(limit + 1).agg((F.count(F.lit(1)) <= limit).alias("_fits"))
    return inside.join(F.broadcast(fits.where("_fits").select(F.lit(1).alias("_one"))), F.lit(True)).drop("_one")  # a row or none


def clinical_identity(source: Column, resource_type: Column, identifier: Column) -> Column:
    """A UUID-shaped name of a clinical record's content address."""
    h = F.sha2(F.concat(F.lit("HKClinicalRecord"), source, F.lit("\0"), resource_type, F.lit("\0"), identifier).cast("binary"), 256)
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def clinical_envelopes(records: DataFrame) -> DataFrame:
    """``records`` with envelope: the record as one JSON object, keys in order.

    Of uuid, source, clinical_type, display_name and, null where there is no resource, resource_type, identifier,
    resource (binary) and fhir_version.  A resource that is a JSON object or array is held as such; any other is kept as Base64.
    The identity is the content's where there is an identifier, otherwise the device's own.
    """
    present, named = F.col("resource").isNotNull(), F.col("resource").isNotNull() & (F.coalesce("identifier", F.lit("")) != "")
    text = F.try_validate_utf8(F.col("resource"))
    parsed = whole_json(F.when(text.rlike(r"(?s)^\s*[\[{]"), text))
    kept = F.when(parsed.isNull(), F.replace(F.base64("resource"), F.lit("\r\n"), F.lit("")))
    there = F.struct(F.when(kept.isNotNull(), "base64").alias("encoding"), F.col("fhir_version").alias("fhirVersion"), "identifier", parsed.alias("resource"), kept.alias("resourceData"), F.col("resource_type").alias("resourceType"), F.lit("present").alias("state"))
    absent = F.lit('{"reason":"There is no resource behind this record.","state":"absent"}')
    own = F.coalesce(F.when(named, clinical_identity(F.coalesce("source", F.lit("")), F.coalesce("resource_type", F.lit("")), F.col("identifier"))), F.lower("uuid"))
    rest = F.to_json(F.struct(F.lower("uuid").alias("healthKitUUID"), own.alias("id"), named.alias("identityIsStable"), F.lit("clinicalRecord").alias("kind")))
    first = F.to_json(F.struct(F.col("clinical_type").alias("clinicalType"), F.col("display_name").alias("displayName")))
    opened = F.when(first == "{}", "{").otherwise(F.concat(F.left(first, F.char_length(first) - 1), F.lit(",")))
    return records.withColumn("envelope", F.concat(opened, F.lit('"fhir":'), F.when(present, F.to_json(there)).otherwise(absent), F.lit(","), F.substring(rest, F.lit(2), F.char_length(rest))))
