"""Text of notes and tracks: numbers and lengths for readers, Markdown cells, YAML values and keys, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed_decimal(value: Column, places: int) -> Column:
    """``places`` decimals at most, without trailing zeros; "0" for what isn't finite."""
    text = F.regexp_replace(F.format_string(f"%.{places}f", value), r"\.?0+$" if places else "$^", "")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite & (text != "-0"), text).otherwise("0")


def grouped_number(value: Column) -> Column:
    """Thousands in groups; two decimals unless within 0.005 of a whole number; a dash for what isn't finite."""
    rounded = F.round(value)
    is_whole = F.abs(value - rounded) < 0.005
    whole = F.abs(F.when(is_whole, rounded).otherwise(F.signum(value) * F.floor(F.abs(value))))
    rest = F.when(is_whole, "").otherwise(F.format_string(".%02d", F.round((F.abs(value) - whole) * 100).cast("int")))
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.format_number(whole.cast("long"), 0), rest)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), "—").otherwise(text)


def length_text(seconds: Column) -> Column:
    """Seconds under a minute, then minutes, then hours and minutes."""
    minutes = F.round(seconds / 60).cast("long")
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    long = F.when(rest == 0, F.concat(hours, F.lit(" h"))).otherwise(F.concat(hours, F.lit(" h "), rest.cast("string"), F.lit(" m")))
    short = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" m"))).otherwise(long)
    return F.when(seconds < 60, F.concat(F.round(seconds).cast("long").cast("string"), F.lit(" s"))).otherwise(short)


def counted(n: Column, one: str, more: str) -> Column:
    """"1 workout", "2 workouts"."""
    return F.concat(grouped_number(n.cast("double")), F.when(n == 1, f" {one}").otherwise(f" {more}"))


def listed(items: Column) -> Column:
    """An array of texts as "a", "a and b" or "a, b, and c"."""
    n = F.size(items)
    last, before = F.try_element_at(items, F.lit(-1)), F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat(before, F.lit(" and "), last)).otherwise(F.concat(before, F.lit(", and "), last))


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.char_length(text)))


def yaml_text(text: Column) -> Column:
    """A quoted YAML value."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def yaml_key(base: Column, unit: Column) -> Column:
    """A front-matter key that names its unit: "distance_m", "heart_rate_count_per_min"."""
    suffix = F.regexp_replace(F.lower(F.replace(F.replace(F.coalesce(unit, F.lit("")), F.lit("/"), F.lit("_per_")), F.lit("%"), F.lit("percent"))), r"[^\p{L}\p{N}_]", "")
    return F.when((unit == "count") | (suffix == ""), base).otherwise(F.concat(base, F.lit("_"), suffix))


def table_cell(text: Column) -> Column:
    """A Markdown table's cell: a bar in it doesn't end it, nor does a line end."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), "[\\r\\n]+", " ")
