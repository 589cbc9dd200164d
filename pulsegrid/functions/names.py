"""Names: measures of types, metric and display names, activities, and text forms of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.schema import ACTIVITIES, CATALOGUE_PREFIXES, CUMULATIVE, DISPLAY_NAMES, DURATION_CATEGORIES, METRIC_NAMES, OCCURRENCE_CATEGORIES, PREFIXES, SLEEP_STAGES


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def stripped(type_: Column) -> Column:
    """The identifier without its prefix."""
    return F.regexp_replace(type_, f"^({'|'.join(PREFIXES)})", "")


def measure_kind(type_: Column) -> Column:
    """total, average, duration or occurrences, from the identifier alone; what isn't known to add up is averaged."""
    name = stripped(type_)
    adds = name.isin(*CUMULATIVE) | name.startswith("Dietary") | name.startswith("Distance")
    return (
        F.when(type_.isin(*DURATION_CATEGORIES), "duration")
        .when(type_.startswith(PREFIXES[1]), "occurrences")
        .when(type_.startswith(PREFIXES[0]), F.when(adds, "total").otherwise("average"))
        .when(type_.contains("StateOfMind"), "average")
        .when(type_ == "HKWorkoutTypeIdentifier", "total")
        .otherwise("occurrences")
    )


def counted_values(type_: Column) -> Column:
    """Values that count towards the measure; empty if all do."""
    table = {k: v for k, v in (DURATION_CATEGORIES | OCCURRENCE_CATEGORIES).items() if v}
    return F.coalesce(*(F.when(type_ == k, F.array(*(F.lit(x).cast("long") for x in v))) for k, v in table.items()), F.expr("cast(array() as array<bigint>)"))


def snake(name: Column) -> Column:
    return F.lower(F.concat(F.left(name, F.lit(1)), F.regexp_replace(F.substring(name, 2, 1 << 30), "(\\p{Lu})", "_$1")))


def metric_name(type_: Column) -> Column:
    return F.coalesce(lookup(METRIC_NAMES, type_), snake(F.regexp_replace(type_, f"^({PREFIXES[0]}|{PREFIXES[1]})", "")))


def type_of_metric(metric: Column) -> Column:
    """The identifier that a listed metric name stands for, else null."""
    return lookup({v: k for k, v in METRIC_NAMES.items()}, metric)


def catalogue_name(type_: Column) -> Column:
    """The display name as a catalogue has it: runs of capitals are words too."""
    bare = F.regexp_replace(stripped(type_), f"^({'|'.join(CATALOGUE_PREFIXES)})", "")
    apart = F.regexp_replace(bare, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.coalesce(lookup(DISPLAY_NAMES, type_), F.when(bare == "", type_).otherwise(F.regexp_replace(apart, "([a-z0-9])([A-Z])", "$1 $2")))


def tool_number(value: Column) -> Column:
    """Integral numbers under 1e15 without a point, others with two digits."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(F.format_string("%.2f", value))


def xml_text(text: Column) -> Column:
    """Text for XML: the five characters that have a meaning, and none that XML 1.0 forbids."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        out = F.replace(out, F.lit(char), F.lit(f"&{name};"))
    return out


def slug(text: Column, empty: str = "route") -> Column:
    """Lower-case letters and digits with single dashes between."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(out == "", empty).otherwise(out)


def header_safe(text: Column, most: int = 200) -> Column:
    """A header's value: bytes that are no visible ASCII, and percent signs, as %XX; cut to ``most`` characters; null for an empty one."""
    kept = F.left(text, F.lit(most))
    encoded = F.replace(F.url_encode(kept), F.lit("+"), F.lit("%20"))
    plain = {"%21": "!", "%22": '"', "%23": "#", "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")", "%2B": "+", "%2C": ",", "%2F": "/", "%3A": ":", "%3B": ";", "%3C": "<", "%3D": "=", "%3E": ">", "%3F": "?", "%40": "@", "%5B": "[", "%5C": "\\", "%5D": "]", "%5E": "^", "%60": "`", "%7B": "{", "%7C": "|", "%7D": "}", "%7E": "~"}
    for code, char in plain.items():
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return F.nullif(encoded, F.lit(""))


def display_name(type_: Column) -> Column:
    return F.when(stripped(type_) == "", type_).otherwise(F.regexp_replace(stripped(type_), "([a-z0-9])([A-Z])", "$1 $2"))


def activity_name(raw: Column) -> Column:
    return F.coalesce(lookup(ACTIVITIES, raw.cast("int")), F.concat(F.lit("Activity "), raw.cast("string")))


def sleep_stage(raw: Column) -> Column:
    return F.coalesce(lookup(dict(enumerate(SLEEP_STAGES)), raw.cast("int")), F.lit("Unspecified"))


def plain_number(value: Column) -> Column:
    """Integral numbers under 1e15 without a point, others in their shortest form."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))


def csv_field(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


#: The line ends and marks that the line protocol can't hold.
_BREAKS = "\n\r\x00\x0b\x0c\x85  "


def _clean(text: Column) -> Column:
    return F.translate(text, _BREAKS, " " * len(_BREAKS))


def _escaped(text: Column, marks: str) -> Column:
    """A backslash before each of ``marks``, itself first among them."""
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(f"\\{mark}"))
    return text


def line_key(text: Column) -> Column:
    """A tag or field key, or a tag's value, of the line protocol."""
    return _escaped(_clean(text), "\\,= ")


def line_measurement(text: Column) -> Column:
    bare = F.regexp_replace(_clean(text), "^[#_]+", "")
    return _escaped(F.when(bare == "", "health").otherwise(bare), "\\, ")


def line_string(text: Column) -> Column:
    return F.concat(F.lit('"'), _escaped(_clean(text), '\\"'), F.lit('"'))


def line_nanos(text: Column) -> Column:
    """Nanoseconds of an ISO instant: the fraction's digits are taken from the text, nine at most."""
    whole = F.unix_seconds(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.concat(F.left(text, F.lit(19)), F.lit("Z")))))
    digits = F.rpad(F.left(F.replace(F.substring(text, 21, 64), F.lit("Z"), F.lit("")), F.lit(9)), 9, "0")
    return whole * 1_000_000_000 + digits.cast("long")
