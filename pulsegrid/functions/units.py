"""Units: conversion by factor, families, and the unit to show a series in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.schema import TEMPERATURES, UNITS

_DIMENSION = {u: d for u, (d, _) in UNITS.items()} | {u: "temperature" for u in TEMPERATURES}


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def dimension(unit: Column) -> Column:
    return _lookup(_DIMENSION, unit)


def convert(value: Column, source: Column, target: Column) -> Column:
    """``value`` in the target unit; null if it isn't finite, a unit is unknown, or the dimensions differ."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    factor = {u: f for u, (_, f) in UNITS.items()}
    celsius = F.when(source == "degC", value).when(source == "degF", (value - 32) * 5 / 9).when(source == "K", value - 273.15)
    warm = F.when(target == "degC", celsius).when(target == "degF", celsius * 9 / 5 + 32).when(target == "K", celsius + 273.15)
    scaled = value * _lookup(factor, source) / _lookup(factor, target)
    same = dimension(source) == dimension(target)
    return F.when(finite & (source == target), value).when(finite & same, F.when(dimension(source) == "temperature", warm).otherwise(scaled))


def family(unit: Column, type_: Column) -> Column:
    """Lengths are distances or body lengths by the type's name; times have no family."""
    d = dimension(unit)
    return F.when(d == "length", F.when(F.lower(type_).contains("distance"), "distance").otherwise("bodyLength")).when(d == "pressure", "bloodPressure").when(d != "time", d)


#: Preferred units of each region by family.
REGIONS = {
    "us": {"distance": "mi", "bodyLength": "in", "mass": "lb", "temperature": "degF", "volume": "fl_oz_us", "energy": "kcal", "speed": "mi/hr", "bloodPressure": "mmHg"},
    "uk": {"distance": "mi", "bodyLength": "cm", "mass": "kg", "temperature": "degC", "volume": "mL", "energy": "kcal", "speed": "mi/hr", "bloodPressure": "mmHg"},
    "metric": {"distance": "km", "bodyLength": "cm", "mass": "kg", "temperature": "degC", "volume": "mL", "energy": "kcal", "speed": "km/hr", "bloodPressure": "mmHg"},
}


def preferred(unit: Column, type_: Column, region: str) -> Column:
    return F.coalesce(_lookup(REGIONS[region], family(unit, type_)), unit)


def display(kind: Column, unit: Column, type_: Column, magnitude: Column) -> Column:
    """struct(label, scale, digits) to show numbers of this size in."""
    size = F.abs(magnitude)
    shown = lambda label, scale, digits: F.struct((label if isinstance(label, Column) else F.lit(label)).alias("label"), F.lit(float(scale)).alias("scale"), (digits if isinstance(digits, Column) else F.lit(digits)).alias("digits"))
    rate = F.when(type_.rlike("(HeartRate|HeartRateAverage|RestingHeartRate)$"), "bpm").when(type_.endswith("RespiratoryRate"), "breaths/min").otherwise("count/min")
    number = (
        F.when(unit == "count/s", shown(rate, 60, 0))
        .when(unit == "%", shown("%", 100, 1))
        .when((unit == "m") & type_.contains("Distance") & (size >= 1000), shown("km", 0.001, 2))
        .when((unit == "m") & type_.contains("Distance"), shown("m", 1, 0))
        .when(unit == "m", shown("m", 1, 2))
        .when((unit == "min") & (size >= 90), shown("hr", 1 / 60, 1))
        .when(unit == "min", shown("min", 1, 0))
        .when((unit == "sec") & (size >= 5400), shown("hr", 1 / 3600, 1))
        .when((unit == "sec") & (size >= 90), shown("min", 1 / 60, 0))
        .when(unit == "sec", shown("sec", 1, 0))
        .when((unit == "g") & (size < 1), shown("mg", 1000, 1))
        .when(unit == "count/min", shown(rate, 1, 0))
        .when(unit == "count", shown("", 1, F.when(kind == "total", 0).otherwise(1)))
        .when(unit == "degC", shown("°C", 1, 2))
        .when(unit == "degF", shown("°F", 1, 1))
        .when(unit.isin("kcal", "ms", "mL"), shown(unit, 1, 0))
        .otherwise(shown(F.coalesce(unit, F.lit("")), 1, 1))
    )
    return F.when((kind == "duration") & (size >= 5400), shown("hr", 1 / 3600, 1)).when(kind == "duration", shown("min", 1 / 60, 0)).when(kind == "occurrences", shown("", 1, 0)).otherwise(number)
