"""Streaming ingest: a folder of batches becomes tables of samples and of the other kinds, each batch taken once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.functions.variants import whole_json
from pulsegrid.operators.state import latest_wins
from pulsegrid.sources import formats
from pulsegrid.streaming import store

_COLUMNS = ["id", "type", "kind", "start_ts", "end_ts", "value", "unit", "source_name", "reading_count"]


def line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000, names: str = "*.ndjson") -> DataFrame:
    """(value, batch, modified, block): lines of NDJSON files as they arrive; the file's name is the batch's key.

    No watermark: a record's date says nothing about when it comes, and late ones count.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).text(folder)
    return lines.select("value", F.col("_metadata.file_name").alias("batch"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("block"))


def payload_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000, names: str = "*.{ndjson,json,csv}") -> DataFrame:
    """(value, batch, modified, block): whole files of any wire format; a request, and so a file, has 64 MB at most."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).text(folder, wholetext=True)
    return files.select("value", F.col("_metadata.file_name").alias("batch"), F.col("_metadata.file_modification_time").alias("modified"), F.lit(0).cast("long").alias("block"))


def lines_of_payloads(payloads: DataFrame) -> DataFrame:
    """(value, batch, modified, block, line): payloads of any format as generic records, a line of JSON each.

    An array that can't be read stays whole, for quarantine; of a probe only what follows it counts.  A
    metrics envelope's deletions have a type and a date, and no id.  Each payload is read once.
    """
    keep = ["batch", "modified", "block"]
    held = payloads.select(*keep, "value", formats.payload_format(F.col("value")).alias("format"))
    one = F.col("format")
    held = held.withColumn("elements", F.when(one == "array", F.try_variant_get(whole_json("value"), "$", "array<variant>"))).withColumn("data", F.when(one == "metrics", F.from_json("value", formats.ENVELOPE)["data"]))
    bare = lambda texts: F.filter(texts, lambda x: F.btrim(x) != "")
    lines = bare(F.split("value", "\\r?\\n"))
    pieces = (
        F.when((one == "array") & F.col("elements").isNull(), F.array("value"))
        .when(one == "array", F.transform("elements", lambda v: F.to_json(v)))
        .when(one == "metrics", formats.metrics_records(F.col("data")))
        .when(one == "csv", bare(formats.csv_rows(F.col("value"))))
        .when(one == "probe", F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
        .otherwise(lines)
    )
    # Outer, so that no filter on the pieces is inferred and pushed below, which would read each payload again.
    rows = held.select(*keep, "format", F.posexplode_outer(pieces).alias("line", "value")).where("line is not null and (format <> 'csv' or not startswith(value, 'id,type,kind,'))")
    rows = rows.withColumn("fields", F.when(F.col("format") == "csv", formats.split_csv(F.col("value"))))
    value = F.when(F.col("format") == "csv", formats.csv_record(F.col("fields"), F.col("value"))).otherwise(F.col("value"))
    return rows.select(value.alias("value"), *keep, F.col("line").cast("long").alias("line"))


def changes_of(lines: DataFrame, epoch: int) -> DataFrame:
    """Every line with its fields and route, in the order seq: (epoch, file's time and name, upserts first, place in the file)."""
    if "line" not in lines.columns:
        lines = lines.withColumn("line", F.monotonically_increasing_id())
    for name, kind in (("batch", "string"), ("modified", "timestamp"), ("block", "long")):
        lines = lines if name in lines.columns else lines.withColumn(name, F.lit(None).cast(kind))
    routed = formats.route(lines, keep=["batch", "modified", "block", "line"])
    phase = F.when(F.col("route") == "deletion", 1).otherwise(0)
    seq = F.struct(F.lit(epoch).cast("long").alias("epoch"), "modified", "batch", phase.alias("phase"), "block", "line")
    return routed.select(*_COLUMNS, "route", "raw", seq.alias("seq"))


def batch_keys(lines: DataFrame) -> DataFrame:
    """(batch, modified, records, key): each batch's key by its content: the lines that it has, how often, in any order."""
    from pulsegrid.operators.state import content_sums

    sums = content_sums(F.sha2(F.col("value").cast("binary"), 256))
    rows = lines.groupBy("batch").agg(F.max("modified").alias("modified"), F.count(F.lit(1)).alias("records"), *(x.alias(f"s{i}") for i, x in enumerate(sums)))
    told = F.concat_ws(":", F.col("records").cast("string"), *(F.col(f"s{i}") for i in range(len(sums))))
    return rows.select("batch", "modified", "records", F.sha2(told.cast("binary"), 256).alias("key"))


def judged(keys: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """``keys`` with ``duplicate``: whether the ledger has the key, or an earlier batch of the same epoch."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("modified", "batch"))  # a row per batch
    rows = keys.withColumn("again", place > 1)
    if ledger is None:
        return rows.select("batch", "modified", "records", "key", F.col("again").alias("duplicate"))
    known = ledger.where("not duplicate").select(F.col("key").alias("known")).distinct()
    met = rows.join(known, F.col("key") == F.col("known"), "left")
    return met.select("batch", "modified", "records", "key", (F.col("again") | F.col("known").isNotNull()).alias("duplicate"))


def start_upsert(lines: DataFrame, log: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch's changes under ``log``/epoch=n; writing an epoch again replaces it.

    ``lines`` is a ``line_stream`` or a ``payload_stream`` with ``lines_of_payloads``.  The effect is exactly
    once: Spark replays an unfinished epoch with the same rows, and the replay overwrites its own folder.
    All tables are folds of this one log, so a batch is in all of them or in none.

    A batch whose content an earlier one had, under whatever name, is a duplicate: the ledger, which is
    written with the epoch, says so, and none of its lines counts.  Lines without a batch have no key.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        if "batch" not in batch.columns or "modified" not in batch.columns:
            changes_of(batch, epoch).write.mode("overwrite").parquet(f"{log}/epoch={epoch}")
            return
        held = batch.persist()  # read for the keys and for the log; lost parts are read from the files again
        try:
            spark = batch.sparkSession
            earlier = ledger(spark, log)
            keys = judged(batch_keys(held), None if earlier is None else earlier.where(F.col("epoch") < epoch))
            keys.write.mode("overwrite").parquet(f"{log}/ledger/epoch={epoch}")
            again = spark.read.parquet(f"{log}/ledger/epoch={epoch}").where("duplicate").select(F.col("batch").alias("_again"))
            fresh = held.join(again, F.col("batch") == F.col("_again"), "left_anti")
            changes_of(fresh, epoch).write.mode("overwrite").parquet(f"{log}/epoch={epoch}")
        finally:
            held.unpersist()

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ledger(spark: SparkSession, log: str) -> DataFrame | None:
    """(batch, modified, records, key, duplicate, epoch): every batch that has come; None before the first."""
    return spark.read.option("basePath", f"{log}/ledger").parquet(f"{log}/ledger/epoch=*") if store.folders(spark, f"{log}/ledger") else None


def changes(spark: SparkSession, log: str, base: str | None = None) -> DataFrame:
    """All changes that a table can depend on: of the epochs, or of the snapshot in ``base`` and the epochs after it."""
    return store.changes(spark, log, base).drop("epoch")


def state(spark: SparkSession, log: str, base: str | None = None) -> DataFrame:
    """The samples after all epochs: the last upsert of each id and type that no later tombstone deletes.

    A tombstone with an id deletes it in every type; one without, which has a type and a date, deletes
    what began then.  With a snapshot, only the epochs after it are folded: its samples are alive, and those
    that later changes touch are left out by joins with the keys of these.
    """
    log_ = store.deltas(spark, log, base)
    held = latest_wins(log_.where("route = 'sample' and id is not null").drop("route", "raw", "epoch"), ["id", "type"], ["seq"])
    gone = log_.where("route = 'deletion'")
    plain = gone.where("id is not null").groupBy("id").agg(F.max("seq").alias("_plain"))
    dated = gone.where("id is null and start_ts is not null").groupBy("type", "start_ts").agg(F.max("seq").alias("_dated"))
    met = held.join(plain, "id", "left").join(dated, ["type", "start_ts"], "left")
    live = met.where((F.col("_plain").isNull() | (F.col("_plain") < F.col("seq"))) & (F.col("_dated").isNull() | (F.col("_dated") < F.col("seq")))).select(*_COLUMNS)
    old = store.snapshot(spark, base) if base else None
    if old is None:
        return live
    old = old.where("route = 'sample'").select(*_COLUMNS)
    old = old.join(held.select("id", "type"), ["id", "type"], "left_anti").join(plain, "id", "left_anti").join(dated, ["type", "start_ts"], "left_anti")
    return live.unionByName(old.select(*_COLUMNS))


#: Kinds that have tables of their own: what a row of each is known by, and its reader.
SIDE_TABLES: dict[str, tuple[list[str], Callable[[DataFrame], DataFrame]]] = {
    "typeCoverage": (["type"], formats.coverage_lines),
    "medicationDose": (["id"], formats.doses),
    "stateOfMind": (["id"], formats.moods),
    "electrocardiogram": (["id"], formats.electrocardiograms),
    "electrocardiogramVoltages": (["sample", "sequence"], formats.read_pages),
    "quantitySeriesReadings": (["sample", "sequence"], formats.read_pages),
    "workoutRouteLocations": (["sample", "sequence"], formats.read_pages),
    "electrocardiogramEnd": (["sample"], formats.series_ends),
    "quantitySeriesEnd": (["sample"], formats.series_ends),
    "workoutRouteEnd": (["sample"], formats.series_ends),
    "audiogram": (["id"], formats.audiograms),
    "workout": (["id"], formats.workout_statistics),
}


def side_table(spark: SparkSession, log: str, kind: str, base: str | None = None) -> DataFrame:
    """The table of one kind after all epochs: the last line of each key, read; ids that a later tombstone deletes are left out.

    Coverage goes by the moment of observation instead, whatever arrives last.
    """
    keys, read = SIDE_TABLES[kind]
    log_ = changes(spark, log, base)
    rows = log_.where((F.col("kind") == kind) & F.col("route").isin(kind, "sample")).select(F.col("raw").alias("value"), "seq")
    named = [F.get_json_object("value", f"$.{k}").alias(f"_{k}") for k in keys]
    order = [F.get_json_object("value", "$.observedAt").alias("_at")] if kind == "typeCoverage" else []
    rows = rows.select(*named, *order, "value", "seq")
    last = latest_wins(rows, [f"_{k}" for k in keys], [*(["_at"] if order else []), "seq"])
    if keys == ["id"]:
        gone = log_.where("route = 'deletion' and id is not null").groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_gone"))
        last = last.join(gone, "_id", "left").where("_gone is null or _gone < seq")
    return read(last.select("value"))


def quarantined(spark: SparkSession, log: str, base: str | None = None) -> DataFrame:
    """Lines that no table takes, each content once."""
    from pulsegrid.operators.state import quarantine

    return quarantine(changes(spark, log, base).where("route = 'quarantine'").select("raw"), "raw", formats.PARSER_VERSION)
