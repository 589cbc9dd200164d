"""Payloads taken apart to their records, put together again, and divided by count or by bytes.

A payload is one request, so what a row holds is bounded, and it is divided where it lies: nothing is
shuffled, and no task walks the records of more than a payload.  Records are slices of the payload's
own text.  A payload whose records don't give exactly its text again is never divided: it stays whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import parse_iso
from pulsegrid.sources import formats

FORMS = ("ndjson", "json", "csv", "lines", "metrics")
#: Nesting that a record of the metrics form may have; a payload with more of it stays whole.
DEPTH = 8
#: Bytes that a form's frame and each of its records are estimated to take beside the record's text.
FRAME_BYTES = {"ndjson": 0, "json": 5, "csv": 0, "lines": 0, "metrics": 60}
RECORD_BYTES = 2
#: Halvings of a part that is too large once framed: enough for any payload that a row can hold.
HALVINGS = 31

_STRING = r'"(?:[^"\\]++|\\.)*+"'


def _nested(depth: int) -> str:
    inner = ""
    for _ in range(depth):
        inner = rf'[\[{{](?:[^\[\]{{}}"]++|{_STRING}{"|" + inner if inner else ""})*+[\]}}]'
    return inner


_MEMBER = rf"(?s)({_STRING}):({_STRING}|{_nested(DEPTH + 3)}|[^,\[\]{{}}\"\s]++)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _elements(array: Column) -> Column:
    """The objects of a JSON array, as they are written."""
    inner = F.substring(array, F.lit(2), F.char_length(array) - 2)
    return F.coalesce(F.regexp_extract_all(inner, F.lit("(?s)" + _nested(DEPTH)), F.lit(0)), F.array().cast("array<string>"))


def _members(text: Column) -> Column:
    """Keys (with their quotes) and values of a compact JSON object, as they are written."""
    return F.struct(F.regexp_extract_all(text, F.lit(_MEMBER), F.lit(1)).alias("keys"), F.regexp_extract_all(text, F.lit(_MEMBER), F.lit(2)).alias("values"))


def _value(members: Column, key: str) -> Column:
    at = F.array_position(members["keys"], f'"{key}"')
    return F.when(at > 0, F.try_element_at(members["values"], at.cast("int")))


def _piece(kind: str | Column, text: Column, name: Column | None = None, head: Column | None = None, tail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    told = {"kind": F.lit(kind) if isinstance(kind, str) else kind, "name": name, "head": head, "tail": tail, "text": text}
    return F.struct(*((none if v is None else v).alias(k) for k, v in told.items()))


def _points(metric: Column) -> Column:
    """The points of a metric, each with the text before and after the points."""

    def of(m: Column) -> Column:
        at = F.array_position(m["keys"], '"data"').cast("int")
        written = F.zip_with(m["keys"], m["values"], lambda k, v: F.concat(k, F.lit(":"), v))
        before, after = F.slice(written, F.lit(1), at - 1), F.slice(written, at + 1, F.size(written))
        head = F.concat(F.lit("{"), F.array_join(before, ","), F.when(at > 1, ",").otherwise(""), F.lit('"data":['))
        tail = F.concat(F.lit("]"), F.when(F.size(after) > 0, ",").otherwise(""), F.array_join(after, ","), F.lit("}"))
        told = F.struct(_value(m, "name").alias("name"), head.alias("head"), tail.alias("tail"), _elements(_value(m, "data")).alias("data"))
        whole = (at > 0) & _value(m, "name").startswith('"') & _value(m, "units").startswith('"')
        return F.when(whole, let(told, lambda t: F.transform(t["data"], lambda e: _piece("point", e, t["name"], t["head"], t["tail"]))))

    return let(_members(metric), of)


def _pieces(payload: Column, form: str) -> Column:
    if form == "metrics":
        found = lambda d: F.concat(
            F.flatten(F.transform(_elements(_value(d, "metrics")), _points)),
            F.transform(_elements(_value(d, "workouts")), lambda e: _piece("workout", e)),
            F.transform(_elements(_value(d, "deletions")), lambda e: _piece("deletion", e)),
        )
        return let(_members(payload), lambda root: let(_members(_value(root, "data")), found))
    rows = formats.csv_rows(payload) if form == "csv" else F.filter(F.split(payload, "\n"), lambda x: x != "")
    if form == "csv":
        return F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: _piece("record", x))
    if form == "json":
        rows = F.transform(F.filter(rows, lambda x: ~x.isin("[", "]")), lambda x: F.when(x.endswith(","), F.left(x, F.char_length(x) - 1)).otherwise(x))
    pieces = F.transform(rows, lambda x: _piece("record", x))
    return pieces if form == "lines" else F.when(F.forall(rows, lambda x: x.startswith("{")), pieces)


def _together(pieces: Column, form: str, header: Column | None = None) -> Column:
    """The payload of ``pieces`` in their order; points that follow one another under one name share its metric."""
    texts = lambda ps: F.transform(ps, lambda p: p["text"])
    if form == "json":
        return F.concat(F.lit("[\n"), F.array_join(texts(pieces), ",\n"), F.lit("\n]\n"))
    if form != "metrics":
        body = F.when(F.size(pieces) > 0, F.concat(F.array_join(texts(pieces), "\n"), F.lit("\n"))).otherwise("")
        return body if header is None else F.concat(header, body)

    def metrics(ps: Column) -> Column:
        places = F.filter(F.transform(ps, lambda p, i: i), lambda i: (i == 0) | ~F.get(ps, i)["name"].eqNullSafe(F.get(ps, i - 1)["name"]) | ~F.get(ps, i)["tail"].eqNullSafe(F.get(ps, i - 1)["tail"]))
        run = lambda first, end: F.concat(F.get(ps, first)["head"], F.array_join(texts(F.slice(ps, first + 1, end - first)), ","), F.get(ps, first)["tail"])
        return let(places, lambda at: F.array_join(F.transform(at, lambda first, j: run(first, F.coalesce(F.get(at, j + 1), F.size(ps)))), ","))

    of = lambda ps, kind: F.filter(ps, lambda p: p["kind"] == kind)
    listed = lambda name, ps: F.when(F.size(ps) > 0, F.concat(F.lit(f'"{name}":['), F.array_join(texts(ps), ","), F.lit("]")))
    body = lambda ps: F.concat_ws(",", listed("deletions", of(ps, "deletion")), F.concat(F.lit('"metrics":['), let(of(ps, "point"), metrics), F.lit("]")), listed("workouts", of(ps, "workout")))
    return F.concat(F.lit('{"data":{'), let(pieces, body), F.lit("}}"))


def _header(payload: Column, form: str) -> Column | None:
    return F.concat(F.get(formats.csv_rows(payload), F.lit(0)), F.lit("\n")) if form == "csv" else None


def apart(payload: Column, form: str) -> Column:
    """Records array<struct<kind, name, head, tail, text>> of a payload, or null for one that they don't give again exactly."""
    return let(_pieces(payload, form), lambda ps: F.when(_together(ps, form, _header(payload, form)) == payload, ps))


def _instant(text: Column, zone: bool) -> Column:
    """UTC wall clock of an ISO instant, or with ``zone`` also of the other dialect's local time and offset."""
    local = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z"))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), local.cast("timestamp_ntz"))
    return F.coalesce(parse_iso(text), utc) if zone else parse_iso(text)


def record_date(kind: Column, text: Column, form: str, precision: int = 1) -> Column:
    """When a record happened (UTC), or null where its form doesn't say; ``precision`` is nanoseconds a tick of the lines form."""
    if form == "lines":
        seconds = (formats.line_tokens(text)["ticks"] * F.lit(precision)).cast("decimal(38,9)") / 1_000_000_000
        return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    if form == "csv":
        return _instant(F.get(formats.split_csv(text), F.lit(3)), False)
    if form == "metrics":
        field = lambda name: F.get_json_object(text, f"$.{name}")
        return _instant(F.when(kind == "workout", field("start")).when(kind == "deletion", field("date")).otherwise(F.coalesce(field("date"), field("startDate"))), True)
    return _instant(F.get_json_object(text, "$.startDate"), False)


def decompose(payloads: DataFrame, form: str, text: str = "payload", precision: int = 1) -> DataFrame:
    """``payloads`` without their text, a row per record: pos, kind, name, head, tail, record, date, measurement, header.

    A payload that can't be taken apart gives one row with null pos and itself as the record, so nothing is lost; one
    without records gives none.  A report of coverage is a record, but no measurement.  Null payloads count as not taken apart.
    """
    others = [c for c in payloads.columns if c != text]
    header = _header(F.col(text), form)
    held = payloads.select(*others, text, (F.lit(None).cast("string") if header is None else header).alias("header"), F.coalesce(apart(F.col(text), form), F.array(F.lit(None))).alias("_pieces"))
    # An outer generator with the filter behind it: a filter on the pieces, or the one that Spark infers for an inner
    # generator, is pushed below and takes every payload apart again.  One that can't be taken apart has one null piece.
    rows = held.select(*others, text, "header", F.posexplode_outer("_pieces").alias("pos", "_p")).where("pos is not null")
    rows = rows.withColumn("pos", F.when(F.col("_p").isNotNull(), F.col("pos")))
    kind, record = F.col("_p.kind"), F.coalesce(F.col("_p.text"), F.when(F.col("pos").isNull(), F.col(text)))
    measured = F.coalesce(F.get_json_object(record, "$.kind") != "typeCoverage", F.lit(True)) if form in ("ndjson", "json") else F.lit(True)
    date = F.when(F.col("pos").isNotNull(), record_date(kind, record, form, precision))
    return rows.select(*others, F.col("pos").cast("long").alias("pos"), kind.alias("kind"), "_p.name", "_p.head", "_p.tail", record.alias("record"), date.alias("date"), measured.alias("measurement"), "header")


def recompose(records: DataFrame, form: str, *keys: str) -> DataFrame:
    """(keys, payload) of any records that ``decompose`` gave, in their order; a payload that stayed whole comes back as it was."""
    piece = F.struct("pos", "kind", "name", "head", "tail", F.col("record").alias("text"))
    held = records.groupBy(*keys).agg(F.sort_array(F.collect_list(piece)).alias("ps"), F.max("header").alias("header"))
    return held.select(*keys, F.when(F.get("ps", F.lit(0))["pos"].isNull(), F.get("ps", F.lit(0))["text"]).otherwise(_together(F.col("ps"), form, F.col("header") if form == "csv" else None)).alias("payload"))


def _parts(payloads: DataFrame, form: str, text: str, ranges: Callable[[Column, Column], Column], whole: Column | None = None) -> DataFrame:
    others = [c for c in payloads.columns if c != text]
    payload, header = F.col(text), _header(F.col(text), form)
    alone = F.array(F.struct(F.lit(None).cast("long").alias("records"), payload.alias("payload")))

    def of(ps: Column) -> Column:
        return F.when(F.size(ps) > 1, F.transform(ranges(ps, header), lambda r: F.struct(r["n"].cast("long").alias("records"), _together(F.slice(ps, r["first"], r["n"]), form, header).alias("payload"))))

    divided = F.coalesce(let(apart(payload, form), of), alone)
    divided = divided if whole is None else F.when(F.coalesce(whole, F.lit(True)), alone).otherwise(divided)
    return payloads.select(*others, F.posexplode_outer(divided).alias("part", "_p")).select(*others, F.col("part").cast("long").alias("part"), "_p.records", "_p.payload")


def divide_by_count(payloads: DataFrame, form: str, most: int, text: str = "payload") -> DataFrame:
    """``payloads`` with part, records and payload: at most ``most`` records a part, each record in exactly one, in order.

    A payload that isn't divided (few enough records, or it can't be taken apart) has one part, itself, and null records.
    """

    def ranges(ps: Column, header: Column | None) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ps), F.lit(most)), lambda first: F.struct(first.alias("first"), F.least(F.lit(most), F.size(ps) - first + 1).alias("n")))

    return _parts(payloads, form, text, ranges)


def divide_by_bytes(payloads: DataFrame, form: str, most: int, text: str = "payload", frame: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``payloads`` with part, records and payload, where ``frame`` of a part's payload, as it is sent, takes ``most`` bytes at most.

    Parts are filled in order by an estimate of their bytes; a part that is too large once framed is halved until it
    fits or holds one record.  A record larger than ``most`` is a part of its own.  What fits, or can't be taken apart, stays as it is.
    """
    fits = lambda c: F.octet_length(frame(c)) <= most

    def ranges(ps: Column, header: Column | None) -> Column:
        cost = lambda p: (F.octet_length(p["text"]) + F.coalesce(F.octet_length(p["head"]) + F.octet_length(p["tail"]), F.lit(0)) + RECORD_BYTES).cast("long")
        framing = F.lit(FRAME_BYTES[form]).cast("long") + (F.lit(0) if header is None else F.octet_length(header))

        def fill(held: Column, size: Column) -> Column:
            new = (held["i"] == 0) | (held["bytes"] + size > most)
            starts = F.when(new, F.concat(held["starts"], F.array(held["i"] + 1))).otherwise(held["starts"])
            return F.struct((F.when(new, framing).otherwise(held["bytes"]) + size).cast("long").alias("bytes"), (held["i"] + 1).alias("i"), starts.alias("starts"))

        empty = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))
        filled = F.aggregate(F.transform(ps, cost), empty, fill, lambda held: held["starts"])
        settled = lambda first, n: F.struct(first.alias("first"), n.alias("n"), ((n <= 1) | fits(_together(F.slice(ps, first, n), form, header))).alias("settled"))
        begun = let(filled, lambda at: F.transform(at, lambda first, j: settled(first, F.coalesce(F.get(at, j + 1), F.size(ps) + 1) - first)))

        def halve(parts: Column, _: Column) -> Column:
            half = lambda r: (F.floor(r["n"] / 2)).cast("int")
            cut = lambda r: F.array(settled(r["first"], half(r)), settled(r["first"] + half(r), r["n"] - half(r)))
            return F.when(F.forall(parts, lambda r: r["settled"]), parts).otherwise(F.flatten(F.transform(parts, lambda r: F.when(r["settled"], F.array(r)).otherwise(cut(r)))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), begun, halve)

    return _parts(payloads, form, text, ranges, fits(F.col(text)))
