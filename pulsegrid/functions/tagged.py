"""Metadata values written with their types, and read back: VARIANT to JSON text and again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import iso_text, parse_iso
from pulsegrid.functions.variants import whole_json

#: Arrays within arrays that are told apart; what lies deeper is written as unsupported.
DEPTH = 3


def _tag(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f'{{"type":"{kind}","value":'), value, F.lit("}"))


def _json_text(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def tagged(value: Column, depth: int = DEPTH) -> Column:
    """A VARIANT as JSON text with its type: date, string, data (Base64), quantity, bool, number, nonFiniteNumber or array.

    A quantity is an object whose only key is ``quantity``.  Numbers that JSON can't hold are written by name; other
    objects, nulls and deeper arrays say which class they are.  A null column is null; no value is left out.
    """
    kind = F.schema_of_variant(value)
    get = lambda t: F.try_variant_get(value, "$", t)
    number = get("double")
    odd = F.when(F.isnan(number), "nan").when(number > 0, "infinity").otherwise("-infinity")
    plain = F.base64(get("binary"))
    out = F.when(kind == "STRING", _tag("string", F.to_json(value)))
    out = out.when(kind == "BOOLEAN", _tag("bool", F.to_json(value)))
    out = out.when(kind.isin("TIMESTAMP", "TIMESTAMP_NTZ", "DATE"), _tag("date", _json_text(iso_text(get("timestamp_ntz")))))
    out = out.when(kind == "BINARY", _tag("data", _json_text(F.replace(plain, F.lit("\r\n"), F.lit("")))))
    out = out.when(kind.isin("DOUBLE", "FLOAT") & (F.isnan(number) | (F.abs(number) == float("inf"))), _tag("nonFiniteNumber", _json_text(odd)))
    out = out.when(kind.isin("DOUBLE", "FLOAT", "BIGINT") | kind.startswith("DECIMAL"), _tag("number", F.to_json(value)))
    out = out.when(kind == "OBJECT<quantity: STRING>", F.concat(F.lit('{"description":'), _json_text(F.try_variant_get(value, "$.quantity", "string")), F.lit(',"type":"quantity"}')))
    if depth > 0:
        inner = F.transform(get("array<variant>"), lambda v: tagged(v, depth - 1))
        out = out.when(kind.startswith("ARRAY"), _tag("array", F.concat(F.lit("["), F.array_join(inner, ",", '{"class":"VOID","type":"unsupported"}'), F.lit("]"))))
    return out.otherwise(F.concat(F.lit('{"class":'), _json_text(F.regexp_extract(kind, "^[A-Z_]+", 0)), F.lit(',"type":"unsupported"}')))


def tagged_map(values: Column) -> Column:
    """map<string, variant> as a JSON object of tagged values, keys in order; a null value is unsupported."""
    entries = F.array_sort(F.map_keys(values))
    pair = lambda k: F.concat(_json_text(k), F.lit(":"), F.coalesce(tagged(values[k]), F.lit('{"class":"VOID","type":"unsupported"}')))
    return F.when(values.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ","), F.lit("}")))


def untagged(text: Column) -> Column:
    """The VARIANT of a tagged scalar, or of an array of them as its JSON; null for what can't be told or isn't tagged."""
    # Through an array of one, so that the text is parsed once.
    return F.get(F.transform(F.array(whole_json(text)), _told), F.lit(0))


def _told(v: Column) -> Column:
    kind, value = F.try_variant_get(v, "$.type", "string"), F.try_variant_get(v, "$.value", "string")
    odd = F.when(value == "nan", float("nan")).when(value == "infinity", float("inf")).when(value == "-infinity", float("-inf"))
    quantity = F.to_variant_object(F.struct(F.try_variant_get(v, "$.description", "string").alias("quantity")))
    return (
        F.when(kind.isin("string", "bool", "number", "array"), F.try_variant_get(v, "$.value", "variant"))
        .when(kind == "date", parse_iso(value).cast("variant"))
        .when(kind == "data", F.try_to_binary(value, F.lit("base64")).cast("variant"))
        .when(kind == "nonFiniteNumber", odd.cast("variant"))
        .when(kind == "quantity", quantity)
    )
