"""Readers of the wire formats.  Each takes lines or payloads as a column, and nothing that can't be read is lost: it is counted or kept whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import parse_iso
from pulsegrid.functions.variants import whole_json
from pulsegrid.schema import COVERAGE_STATES, CSV_COLUMNS

ENVELOPE = """struct<data: struct<
    metrics: array<struct<name: string, units: string, data: array<struct<date: string, endDate: string, qty: string, source: string>>>>,
    workouts: array<struct<id: string, name: string, start: string, end: string, source: string>>,
    deletions: array<struct<name: string, type: string, date: string>>>>"""


def payload_format(payload: Column, probe: str = "[A-Za-z]*ConnectionTest") -> Column:
    """empty, probe, array, metrics, ndjson or csv, by what the text begins with; a probe begins with an object whose kind is ``probe``."""
    bare = F.btrim(payload)
    asked = F.coalesce(F.get_json_object(bare, "$.kind").rlike(f"^{probe}$"), F.lit(False))
    header = F.split_part(bare, F.lit("\n"), F.lit(1))
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", "empty")
        .when(bare.startswith("{") & asked, "probe")
        .when(bare.startswith("["), "array")
        .when(bare.startswith("{") & bare.contains('"metrics"'), "metrics")
        .when(bare.startswith("{"), "ndjson")
        .when(header.contains("startDate") & header.contains(","), "csv")
        .otherwise("ndjson")
    )


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _number(v: Column, path: str) -> Column:
    return _text(v, path).try_cast("double")


def _is(v: Column, path: str, what: str) -> Column:
    """Whether there is an OBJECT, an ARRAY, a STRING at the path."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(what), F.lit(False))


def record_fields(v: Column) -> list[Column]:
    """id, type, kind, start, end, value, unit, source name and reading count of a generic record, a variant.

    The value is the quantity's, else the plain one, else a valence, else a workout's duration.
    """
    kind, quantity = _text(v, "$.kind"), _text(v, "$.quantity")
    plain = F.when(quantity.isNotNull(), _number(v, "$.quantity.value")).otherwise(_number(v, "$.value"))
    unit = F.when(quantity.isNotNull(), _text(v, "$.quantity.unit")).otherwise(_text(v, "$.unit"))
    valence, length = _number(v, "$.valence"), F.when(kind == "workout", _number(v, "$.duration"))
    value = F.coalesce(plain, valence, length)
    unit = F.when(plain.isNotNull(), unit).when(valence.isNotNull(), F.coalesce(unit, F.lit("valence"))).when(length.isNotNull(), F.coalesce(unit, F.lit("sec"))).otherwise(unit)
    start = parse_iso(_text(v, "$.startDate"))
    source = F.when(_text(v, "$.source").startswith("{"), _text(v, "$.source.name")).otherwise(_text(v, "$.sourceName"))
    return [
        _text(v, "$.id").alias("id"), _text(v, "$.type").alias("type"), kind.alias("kind"), start.alias("start_ts"), F.coalesce(parse_iso(_text(v, "$.endDate")), start).alias("end_ts"),
        value.alias("value"), unit.alias("unit"), source.alias("source_name"), F.coalesce(_text(v, "$.quantity.count").try_cast("long"), F.lit(1)).alias("reading_count"),
    ]


#: Kinds that have a table of their own and are no generic sample when they are well formed; of those in STRICT, a malformed one is no sample either.
OWN_KINDS = ["characteristics", "characteristic", "typeCoverage", "medicationDose", "electrocardiogram", "electrocardiogramVoltages", "electrocardiogramEnd", "quantitySeriesReadings", "quantitySeriesEnd", "audiogram"]
STRICT = ["characteristics", "characteristic", "typeCoverage", "quantitySeriesReadings", "quantitySeriesEnd"]


#: What quarantined records were refused by.
PARSER_VERSION = 7


def well_formed(v: Column) -> Column:
    """Whether a record of one of OWN_KINDS has what its table needs."""
    kind, dated = F.col("kind"), F.col("id").isNotNull() & F.col("start_ts").isNotNull()
    series = F.col("type").isNotNull() & F.col("start_ts").isNotNull() & _text(v, "$.sample").isNotNull()
    placed = _number(v, "$.sequence").isNotNull() & _number(v, "$.offset").isNotNull()
    return (
        F.when(kind.isin("characteristics", "characteristic"), F.when(_is(v, "$.characteristics", "OBJECT"), _text(v, "$.characteristics") != "{}").otherwise(F.col("type").isNotNull()))
        .when(kind == "typeCoverage", F.col("type").isNotNull() & parse_iso(_text(v, "$.observedAt")).isNotNull())
        .when(kind.isin("medicationDose", "electrocardiogram", "audiogram"), dated)
        .when(kind == "electrocardiogramVoltages", _text(v, "$.sample").isNotNull() & placed & _is(v, "$.voltages", "ARRAY"))
        .when(kind == "quantitySeriesReadings", series & placed & _is(v, "$.readings", "ARRAY"))
        .when(kind == "quantitySeriesEnd", series & _number(v, "$.readings").isNotNull())
        .otherwise(kind == "electrocardiogramEnd")
    )


def route(lines: DataFrame, text: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Each line with its fields and where it goes: sample, deletion, its own kind's table, or quarantine; columns of ``keep`` stay.

    A line is parsed once.  A deletion has an id, or a type and a moment.  A record of a kind with a table of
    its own goes there if it is well formed; else it is a sample if it has an id, a type and a moment and
    isn't of a strict kind, and what is neither is quarantined.
    """
    v = F.col("_v")
    parsed = lines.select(*(keep or []), whole_json(text).alias("_v"), F.col(text).alias("raw"))
    rows = parsed.select(*(keep or []), "_v", *record_fields(v), "raw", _text(v, "$.deleted").alias("_deleted"))
    whole = F.col("id").isNotNull() & F.col("type").isNotNull() & F.col("start_ts").isNotNull()
    gone = (F.col("kind") == "deletion") | F.col("_deleted").isin("true", "1")
    known = F.col("id").isNotNull() | (F.col("type").isNotNull() & F.col("start_ts").isNotNull())
    to = F.when(v.isNull(), "quarantine").when(gone & known, "deletion").when(gone, "quarantine").when(F.col("kind").isin(*OWN_KINDS) & F.coalesce(well_formed(v), F.lit(False)), F.col("kind"))
    to = to.when(F.col("kind").isin(*STRICT), "quarantine").when(whole, "sample").otherwise("quarantine")
    return rows.withColumn("route", to).drop("_deleted", "_v")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return route(spark.read.text(path).where(F.btrim("value") != ""))


def parse_array(payloads: DataFrame, text: str = "value") -> DataFrame:
    """One row per element of JSON arrays; an array that can't be read is one row whose route is unreadable."""
    elements = F.try_variant_get(whole_json(text), "$", "array<variant>")
    whole = payloads.select(elements.isNull().alias("_bad"), F.when(elements.isNull(), F.array(text)).otherwise(F.transform(elements, lambda v: F.to_json(v))).alias("_e"))
    rows = route(whole.select("_bad", F.explode("_e").alias("value")), keep=["_bad"])
    return rows.withColumn("route", F.when(F.col("_bad"), "unreadable").otherwise(F.col("route"))).drop("_bad")


def csv_record(fields: Column, raw: Column) -> Column:
    """A row of the flat CSV, already split, as a generic record; a row of a wrong number of fields stays as it is."""
    field = lambda name: F.nullif(F.try_element_at(fields, F.lit(CSV_COLUMNS.index(name) + 1)), F.lit(""))
    gone = F.coalesce(field("deleted").isin("true", "1"), F.lit(False))
    record = F.to_json(F.struct(
        field("id").alias("id"), field("type").alias("type"), F.when(gone, "deletion").otherwise(field("kind")).alias("kind"), field("startDate").alias("startDate"), field("endDate").alias("endDate"),
        field("value").try_cast("double").alias("value"), field("unit").alias("unit"), field("sourceName").alias("sourceName"),
    ))
    return F.when(F.size(fields) == len(CSV_COLUMNS), record).otherwise(raw)


def metrics_records(data: Column) -> Column:
    """Points, workouts and deletions of a metrics envelope's ``data`` as generic records, an array of JSON; a deletion has a type, a date and no id."""
    name = lambda *cs: F.coalesce(*cs, F.lit("unknown"))
    point = lambda m, p: F.to_json(F.struct(F.concat_ws(":", name(m["name"]), p["date"]).alias("id"), name(m["name"]).alias("type"), F.lit("quantity").alias("kind"), p["date"].alias("startDate"), p["endDate"].alias("endDate"), p["qty"].try_cast("double").alias("value"), m["units"].alias("unit"), p["source"].alias("sourceName")))
    points = F.flatten(F.transform(F.coalesce(data["metrics"], F.array()), lambda m: F.transform(F.coalesce(m["data"], F.array()), lambda p: point(m, p))))
    workouts = F.transform(F.coalesce(data["workouts"], F.array()), lambda w: F.to_json(F.struct(w["id"].alias("id"), F.coalesce(w["name"], F.lit("Workout")).alias("type"), F.lit("workout").alias("kind"), w["start"].alias("startDate"), w["end"].alias("endDate"), w["source"].alias("sourceName"))))
    gone = F.transform(F.coalesce(data["deletions"], F.array()), lambda x: F.to_json(F.struct(F.coalesce(x["name"], x["type"]).alias("type"), F.lit("deletion").alias("kind"), x["date"].alias("startDate"))))
    return F.concat(points, workouts, gone)


def csv_rows(text: Column) -> Column:
    """The rows of a CSV text: a line end within quotes ends none; an open quote runs to the end of the text."""
    return F.regexp_extract_all(text, F.lit(r'(?:[^"\n]++|"[^"]*+(?:""[^"]*+)*+(?:"|$))++'), F.lit(0))


def split_csv(line: Column) -> Column:
    """RFC 4180 fields of one row: quotes go, doubled ones become one."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace(line, "\r$", "")), F.lit(',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    return F.transform(fields, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.greatest(F.char_length(x) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(x))


# A key or a tag's value of the line protocol: a backslash takes the next character with it.
_TOKEN = r"(?:[^\\,= ]|\\.)++"
_FIELD = rf'{_TOKEN}=(?:"(?:[^"\\]|\\.)*+"|[^ ,"]++)'
_LINE = rf"^((?:[^\\, ]|\\.)++)((?:,{_TOKEN}={_TOKEN})*+) ({_FIELD}(?:,{_FIELD})*+)(?: (-?\d{{1,19}}))?$"


def line_tokens(line: Column) -> Column:
    """(measurement, tags, fields, ticks) of a line of the line protocol, null for one that isn't.

    Escapes are undone in names and tags; a field's value stays as written, quotes and escapes of its text undone.
    """
    part = lambda i: F.regexp_extract(line, _LINE, i)
    plain = lambda c: F.regexp_replace(c, r"\\([\\,= ])", "$1")
    bare = lambda c: F.when(c.startswith('"'), F.regexp_replace(F.substring(c, F.lit(2), F.char_length(c) - 2), r'\\([\\"])', "$1")).otherwise(c)
    found = lambda text, pattern, i, undo: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), undo)
    tag, field = rf",({_TOKEN})=({_TOKEN})", rf'(?:^|,)({_TOKEN})=("(?:[^"\\]|\\.)*+"|[^ ,"]++)'
    # Entries by way of a filter on first names, so that a repeated key doesn't fail the query: the first one counts.
    table = lambda keys, values: F.map_from_entries(F.filter(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: F.when(F.array_position(keys, x["k"]) == i + 1, F.struct(x["k"].alias("key"), x["v"].alias("value")))), lambda x: x.isNotNull()))
    tags = table(found(part(2), tag, 1, plain), found(part(2), tag, 2, plain))
    fields = table(found(part(3), field, 1, plain), found(part(3), field, 2, bare))
    told = F.struct(F.regexp_replace(part(1), r"\\([\\, ])", "$1").alias("measurement"), tags.alias("tags"), fields.alias("fields"), part(4).try_cast("bigint").alias("ticks"))
    return F.when(line.rlike(_LINE), told)


def parse_csv(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rows of the flat CSV without its header; empty fields are null, a wrong number of fields is unreadable."""
    cut = lines.select(split_csv(F.col(text)).alias("f"), F.col(text).alias("raw")).where(~F.col("raw").startswith("id,type,kind,"))
    field = lambda i: F.nullif(F.try_element_at("f", F.lit(i + 1)), F.lit(""))
    rows = cut.select((F.size("f") == len(CSV_COLUMNS)).alias("readable"), *(field(i).alias(c) for i, c in enumerate(CSV_COLUMNS)), "raw")
    start = parse_iso(F.col("startDate"))
    return rows.select(
        "readable", "id", "type", "kind", start.alias("start_ts"), F.coalesce(parse_iso(F.col("endDate")), start).alias("end_ts"), F.col("value").try_cast("double").alias("value"),
        "unit", F.col("sourceName").alias("source_name"), F.coalesce(F.col("deleted").isin("true", "1"), F.lit(False)).alias("deleted"), "raw",
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The flat CSV from files, quoted line ends included."""
    schema = ", ".join(f"`{c}` string" for c in CSV_COLUMNS)
    rows = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)
    start = parse_iso(F.col("startDate"))
    return rows.select("id", "type", "kind", start.alias("start_ts"), F.coalesce(parse_iso(F.col("endDate")), start).alias("end_ts"), F.col("value").try_cast("double").alias("value"), "unit", F.col("sourceName").alias("source_name"), F.coalesce(F.col("deleted").isin("true", "1"), F.lit(False)).alias("deleted"))


def flatten_metrics(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Samples of metrics envelopes with ids of name and date; points without a readable date are left out."""
    data = payloads.select(F.from_json(text, ENVELOPE).alias("e"))
    points = data.select(F.explode("e.data.metrics").alias("m")).select(F.coalesce("m.name", F.lit("unknown")).alias("name"), "m.units", F.explode("m.data").alias("p"))
    start = parse_iso(F.col("p.date"))
    quantity = points.select(
        F.concat_ws(":", "name", "p.date").alias("id"), F.col("name").alias("type"), F.lit("quantity").alias("kind"), start.alias("start_ts"), F.coalesce(parse_iso(F.col("p.endDate")), start).alias("end_ts"),
        F.col("p.qty").try_cast("double").alias("value"), F.col("units").alias("unit"), F.col("p.source").alias("source_name"),
    ).where("start_ts is not null")
    w = data.select(F.explode("e.data.workouts").alias("w"))
    began = parse_iso(F.col("w.start"))
    workouts = w.select(
        F.col("w.id").alias("id"), F.coalesce("w.name", F.lit("Workout")).alias("type"), F.lit("workout").alias("kind"), began.alias("start_ts"), F.coalesce(parse_iso(F.col("w.end")), began).alias("end_ts"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.col("w.source").alias("source_name"),
    ).where("id is not null and start_ts is not null")
    return quantity.unionByName(workouts)


def metrics_tombstones(payloads: DataFrame, text: str = "value") -> DataFrame:
    """(type, start_ts) of an envelope's deletions; without a readable date they delete nothing."""
    d = payloads.select(F.explode(F.from_json(text, ENVELOPE)["data"]["deletions"]).alias("d"))
    return d.select(F.coalesce("d.name", "d.type").alias("type"), parse_iso(F.col("d.date")).alias("start_ts")).where("start_ts is not null and type is not null")


def coverage_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    t = lambda p: F.get_json_object(text, p)
    state = F.when(t("$.state").isin(*COVERAGE_STATES), t("$.state")).otherwise("unknown")
    return lines.where(t("$.kind") == "typeCoverage").select(t("$.type").alias("type"), state.alias("state"), t("$.deliveredCount").try_cast("long").alias("delivered"), parse_iso(t("$.observedAt")).alias("observed_at"))


def characteristics(lines: DataFrame, text: str = "value") -> DataFrame:
    """One row per type of a line's map of characteristics, or the one of a line with a type and a value."""
    t = lambda p: F.get_json_object(text, p)
    m = F.from_json(t("$.characteristics"), "map<string, string>")
    several = lines.where(t("$.kind") == "characteristics").select(F.explode(m).alias("type", "value"))
    return several.unionByName(lines.where((t("$.kind") == "characteristic") & t("$.type").isNotNull()).select(t("$.type").alias("type"), t("$.value").alias("value")))


def audiograms(lines: DataFrame, text: str = "value") -> DataFrame:
    """(id, frequency, ear, sensitivity, unit, masked, clamped) of audiogram lines."""
    points = "array<struct<frequency: struct<value: double>, ears: array<struct<ear: string, sensitivity: struct<unit: string, value: double>, masked: boolean, clampingRange: string>>>>"
    rows = lines.where(F.get_json_object(text, "$.kind") == "audiogram").select(F.get_json_object(text, "$.id").alias("id"), F.explode_outer(F.from_json(F.get_json_object(text, "$.sensitivityPoints"), points)).alias("p"))
    ears = rows.select("id", F.col("p.frequency.value").alias("frequency"), F.explode_outer("p.ears").alias("e"))
    return ears.select("id", "frequency", "e.ear", F.col("e.sensitivity.value").alias("sensitivity"), F.col("e.sensitivity.unit").alias("unit"), F.coalesce("e.masked", F.lit(False)).alias("masked"), F.col("e.clampingRange").isNotNull().alias("clamped"))


def electrocardiograms(lines: DataFrame, text: str = "value") -> DataFrame:
    """(id, start_ts, classification, symptoms, expected, heart_rate, hertz) of recordings' headers."""
    t = lambda p: F.get_json_object(text, p)
    return lines.where(t("$.kind") == "electrocardiogram").select(
        t("$.id").alias("id"), parse_iso(t("$.startDate")).alias("start_ts"), t("$.classification.name").alias("classification"), t("$.symptomsStatus.name").alias("symptoms"),
        t("$.numberOfVoltageMeasurements").try_cast("long").alias("expected"), t("$.averageHeartRate.value").try_cast("double").alias("heart_rate"), t("$.samplingFrequency.value").try_cast("double").alias("hertz"),
    )


def series_ends(lines: DataFrame, text: str = "value") -> DataFrame:
    """(sample_id, kind, declared): the end markers of paged series, with the elements that they declare under the name of their pages' elements."""
    t = lambda p: F.get_json_object(text, p)
    kinds = ["electrocardiogramEnd", "quantitySeriesEnd", "workoutRouteEnd"]
    declared = F.coalesce(*(t(f"$.{k}").try_cast("long") for k in ("readings", "locations", "voltages")))
    return lines.where(t("$.kind").isin(*kinds)).select(t("$.sample").alias("sample_id"), t("$.kind").alias("kind"), declared.alias("declared"))


def workout_legs(lines: DataFrame, text: str = "value") -> DataFrame:
    """(workout_id, ordinal, leg, activity_type, start_ts, end_ts): the activities of workouts in their order."""
    t = lambda p: F.get_json_object(text, p)
    legs = F.from_json(t("$.activities"), "array<struct<id: string, activityType: int, startDate: string, endDate: string>>")
    rows = lines.where(t("$.kind") == "workout").select(t("$.id").alias("workout_id"), F.posexplode(legs).alias("ordinal", "a"))
    return rows.select("workout_id", "ordinal", F.col("a.id").alias("leg"), F.col("a.activityType").alias("activity_type"), parse_iso(F.col("a.startDate")).alias("start_ts"), parse_iso(F.col("a.endDate")).alias("end_ts"))


def moods(lines: DataFrame, text: str = "value") -> DataFrame:
    t = lambda p: F.get_json_object(text, p)
    names = lambda p: F.array_join(F.transform(F.from_json(t(p), "array<struct<name: string>>"), lambda x: x["name"]), ", ")
    return lines.where(t("$.kind") == "stateOfMind").select(t("$.id").alias("id"), parse_iso(t("$.startDate")).alias("at"), t("$.valence").try_cast("double").alias("valence"), t("$.valenceClassification.name").alias("classification"), t("$.kindOfEntry.name").alias("kind"), names("$.labels").alias("labels"), names("$.associations").alias("associations"))


def doses(lines: DataFrame, text: str = "value") -> DataFrame:
    t = lambda p: F.get_json_object(text, p)
    return lines.where(t("$.kind") == "medicationDose").select(t("$.id").alias("id"), parse_iso(t("$.startDate")).alias("at"), F.coalesce(t("$.logStatus.name"), F.lit("unrecorded")).alias("status"), F.coalesce(t("$.medication.displayText"), t("$.medication.nickname")).alias("medication"))


def workout_statistics(lines: DataFrame, text: str = "value") -> DataFrame:
    """(workout_id, leg, type, sum, average, minimum, maximum): of the whole ('') and of each activity."""
    stat = "array<struct<type: string, unit: string, sum: double, average: double, minimum: double, maximum: double>>"
    t = lambda p: F.get_json_object(text, p)
    rows = lines.where(t("$.kind") == "workout")
    whole = rows.select(t("$.id").alias("workout_id"), F.lit("").alias("leg"), F.inline(F.from_json(t("$.statistics"), stat)))
    legs = rows.select(t("$.id").alias("workout_id"), F.explode(F.from_json(t("$.activities"), f"array<struct<id: string, statistics: {stat}>>")).alias("a")).select("workout_id", F.col("a.id").alias("leg"), F.inline("a.statistics"))
    return whole.unionByName(legs)


def read_pages(lines: DataFrame, text: str = "value") -> DataFrame:
    """(sample_id, sequence, offset, count, decoded, elements) of series pages of any kind."""
    t = lambda p: F.get_json_object(text, p)
    elements = F.coalesce(t("$.voltages"), t("$.readings"), t("$.locations"))
    kinds = ["electrocardiogramVoltages", "quantitySeriesReadings", "workoutRouteLocations"]
    return lines.where(t("$.kind").isin(*kinds)).select(t("$.sample").alias("sample_id"), t("$.sequence").try_cast("long").alias("sequence"), t("$.offset").try_cast("long").alias("offset"), t("$.count").try_cast("long").alias("count"), F.coalesce(F.json_array_length(elements), F.lit(0)).cast("long").alias("decoded"), elements.alias("elements"))


#: Kinds of an archive's own bookkeeping, which are no records.
BOOKKEEPING = ["manifest", "completion", "typeSummary", "typeError", "resume"]
#: Lines of a part that are handed on together.
_TOGETHER = 10_000


def unzipped(archives: DataFrame) -> DataFrame:
    """(archive, part, line, value, error): the lines of every part of ZIP archives (archive, content).

    A task has one archive's bytes and some thousand lines of a part at a time.  Where an archive or a part
    can't be read on, a row says so in ``error``.
    """
    import io
    import zipfile
    import zlib

    import pyarrow as pa

    names = ["archive", "part", "line", "value", "error"]

    def told(archive, part, first, lines, error=None):  # noqa: ANN001, ANN202
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([archive] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string()), pa.array([error] * n, pa.string())], names=names)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = None
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for part in z.namelist():
                            with z.open(part) as opened:
                                held, first = [], 0
                                for x in opened:
                                    held.append(x.decode("utf-8", "replace").rstrip("\r\n"))
                                    if len(held) == _TOGETHER:
                                        yield told(archive, part, first, held)
                                        held, first = [], first + len(held)
                                yield told(archive, part, first, held)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as error:
                    yield told(archive, part, 0, [None], str(error)[:200])

    return archives.select(F.col("archive").cast("string"), "content").mapInArrow(run, "archive string, part string, line long, value string, error string")


def whole_archives(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, records) of ``unzipped`` lines: an archive of which one line is no JSON, or one part unreadable, gives nothing.

    The manifest has (archive, parts, lines, bad, taken); records are the lines of the archives that are taken,
    without empty ones and an archive's own bookkeeping.
    """
    filled = F.col("error").isNotNull() | (F.btrim(F.coalesce("value", F.lit(""))) != "")
    bad = F.col("error").isNotNull() | (filled & whole_json("value").isNull())
    sums = lines.groupBy("archive").agg(F.count_distinct("part").alias("parts"), F.sum(filled.cast("long")).alias("lines"), F.sum(bad.cast("long")).alias("bad"))
    manifest = sums.withColumn("taken", F.col("bad") == 0)
    kind = F.coalesce(F.get_json_object("value", "$.kind"), F.lit(""))
    records = lines.where(filled & ~kind.isin(*BOOKKEEPING) & ~kind.rlike("ConnectionTest$"))
    return manifest, records.join(manifest.where("taken").select("archive"), "archive", "left_semi").drop("error")


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): the lines of every part in ZIP files."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
    return unzipped(files).where("error is null").select(F.col("part").alias("name"), "value")
