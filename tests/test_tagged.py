"""Tagged metadata and clinical envelopes."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid

from pyspark.sql import functions as F

from pulsegrid.functions.tagged import tagged, tagged_map, untagged
from pulsegrid.operators import delivery

VALUES = {
    "timestamp_ntz'2026-01-02 03:04:05.006'": {"type": "date", "value": "2026-01-02T03:04:05.006Z"}, "'a\"é'": {"type": "string", "value": 'a"é'}, "x'00ff'": {"type": "data", "value": "AP8="}, "true": {"type": "bool", "value": True},
    "1.5d": {"type": "number", "value": 1.5}, "7L": {"type": "number", "value": 7}, "double('NaN')": {"type": "nonFiniteNumber", "value": "nan"}, "double('-Infinity')": {"type": "nonFiniteNumber", "value": "-infinity"},
}


def test_scalars_both_ways(spark):
    for sql, want in VALUES.items():
        row = spark.range(1).select(F.expr(f"cast({sql} as variant)").alias("v")).select(tagged(F.col("v")).alias("t"), "v")
        got = row.select("t", (F.schema_of_variant(untagged(F.col("t"))) == F.schema_of_variant("v")).alias("kind"), F.to_json(untagged(F.col("t"))).eqNullSafe(F.to_json("v")).alias("same")).first()
        assert json.loads(got.t) == want, sql
        assert got.same and (got.kind or want["type"] == "number"), sql


def test_nested_and_unsupported(spark):
    of = lambda text: json.loads(spark.range(1).select(tagged(F.parse_json(F.lit(text)))).first()[0])
    assert of('[1,["a",null],{"quantity":"5 m"}]') == {"type": "array", "value": [{"type": "number", "value": 1}, {"type": "array", "value": [{"type": "string", "value": "a"}, {"type": "unsupported", "class": "VOID"}]}, {"type": "quantity", "description": "5 m"}]}
    assert of('{"b":1}') == {"type": "unsupported", "class": "OBJECT"} and of("null") == {"type": "unsupported", "class": "VOID"}
    assert of("[[[[1]]]]")["value"][0]["value"][0]["value"] == [{"type": "unsupported", "class": "ARRAY"}]
    row = spark.range(1).select(tagged_map(F.expr("map('b', parse_json('1'), 'a\"', parse_json('\"x\"'), 'c', null)"))).first()[0]
    assert list(json.loads(row)) == ['a"', "b", "c"] and json.loads(row)["c"]["type"] == "unsupported"
    assert spark.range(1).select(untagged(F.lit("junk")), untagged(F.lit(None).cast("string"))).first()[0] is None


def test_untagged_takes_one_value_and_nothing_more(spark):
    one = '{"type":"string","value":"a"}'
    rows = spark.createDataFrame([(one,), (f" {one}\n",), (one + " x",), (f"{one},{one}",), ("1",), ("",), (None,)], "t string")
    got = [r.j for r in rows.select(F.to_json(untagged(F.col("t"))).alias("j")).collect()]
    assert got == ['"a"', '"a"', None, None, None, None, None]


def test_envelope(spark):
    rows = [("u1", "app", "t", "n", "Lab", "id-1", '{"b":1,"a":[2]}'.encode(), "R4"), ("u2", "app", "t", "n", "Lab", "id-1", b"not json \xff", None), ("u3", "app", "t", "n", None, None, None, None), ("u4", "app", "t", "n", "Lab", "", b"1", None)]
    df = spark.createDataFrame(rows, "uuid string, source string, clinical_type string, display_name string, resource_type string, identifier string, resource binary, fhir_version string")
    got = {r.uuid: json.loads(r.envelope) for r in delivery.clinical_envelopes(df).collect()}
    h = bytearray(hashlib.sha256(b"HKClinicalRecordapp\0Lab\0id-1").digest()[:16])
    h[6], h[8] = h[6] & 15 | 80, h[8] & 63 | 128
    assert got["u1"]["id"] == got["u2"]["id"] == str(uuid.UUID(bytes=bytes(h))) and got["u1"]["identityIsStable"]
    assert got["u1"]["fhir"] == {"state": "present", "resourceType": "Lab", "identifier": "id-1", "fhirVersion": "R4", "resource": {"a": [2], "b": 1}}
    assert base64.b64decode(got["u2"]["fhir"]["resourceData"]) == b"not json \xff" and got["u2"]["fhir"]["encoding"] == "base64"
    assert got["u3"]["id"] == "u3" and not got["u3"]["identityIsStable"] and got["u3"]["fhir"]["state"] == "absent"
    assert got["u4"]["id"] == "u4" and got["u4"]["fhir"]["state"] == "present" and got["u4"]["fhir"]["encoding"] == "base64"
