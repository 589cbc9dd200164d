"""Snapshots of the change log: what a fold needs of old epochs, in buckets of keys, so that the epochs can go.

A snapshot has versions.  A version holds the buckets that the epochs since the last one touch, folded again;
all others stay where they are, and a manifest, written last as one file, says which version each bucket is
of and through which epoch they go.  Whatever breaks off before the manifest leaves the old one in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.state import latest_wins

#: Buckets of keys; a manifest has a row for each.
BUCKETS = 64
#: Parts that the rows of a bucket are written in.
_PARTS = 4
_PAGES, _ENDS = ["electrocardiogramVoltages", "quantitySeriesReadings"], ["electrocardiogramEnd", "quantitySeriesEnd"]


def _fs(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in the folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _numbered(spark: SparkSession, path: str, word: str) -> list[int]:
    return sorted(int(x.split("=")[1]) for x in folders(spark, path) if x.startswith(f"{word}="))


def head(spark: SparkSession, base: str) -> tuple[int, int, dict[int, int]]:
    """(version, epoch through which it goes, version of each bucket) of the last manifest; before the first, (-1, -1, nothing)."""
    for version in reversed(_numbered(spark, f"{base}/manifest", "version")):
        rows = spark.read.schema("bucket int, of int, through long").parquet(f"{base}/manifest/version={version}").collect()  # a row per bucket
        if rows:
            return version, rows[0].through, {r.bucket: r.of for r in rows if r.bucket >= 0}
    return -1, -1, {}


def _read(spark: SparkSession, base: str, buckets: dict[int, int]) -> DataFrame | None:
    paths = [f"{base}/version={v}/bucket={b}" for b, v in sorted(buckets.items())]
    return spark.read.parquet(*paths) if paths else None


def snapshot(spark: SparkSession, base: str) -> DataFrame | None:
    """The snapshot's changes: live samples, the last line of each key of the other kinds, all tombstones and what is quarantined."""
    return _read(spark, base, head(spark, base)[2])


def deltas(spark: SparkSession, log: str, base: str | None) -> DataFrame:
    """The changes of the epochs after the snapshot, of all epochs without one."""
    through = head(spark, base)[1] if base else -1
    rows = spark.read.option("basePath", log)
    late = [e for e in _numbered(spark, log, "epoch") if e > through]
    if late or not base or through < 0:
        return rows.parquet(*(f"{log}/epoch={e}" for e in late)) if late else rows.parquet(f"{log}/epoch=*")
    return snapshot(spark, base).limit(0).withColumn("epoch", F.lit(None).cast("int"))


def changes(spark: SparkSession, log: str, base: str | None) -> DataFrame:
    """The snapshot's changes and those after it."""
    rows, old = deltas(spark, log, base), snapshot(spark, base) if base else None
    return rows if old is None else rows.unionByName(old, allowMissingColumns=True)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with what each is folded by: _what, _a, _b, and before the order of arrival _at; and the bucket of _a."""
    t = lambda p: F.get_json_object("raw", p)
    route, id_ = F.col("route"), F.col("id")
    content = F.sha2(F.coalesce("raw", F.lit("")).cast("binary"), 256)
    what = F.when((route == "deletion") & id_.isNull(), "dated").otherwise(route)
    a = F.when(what.isin("dated", "typeCoverage"), F.col("type")).when(route.isin(*_PAGES, *_ENDS), t("$.sample")).when(route.isin("quarantine", "characteristics", "characteristic"), content).otherwise(id_)
    b = F.when(what == "dated", F.col("start_ts").cast("string")).when(route == "sample", F.col("type")).when(route.isin(*_PAGES), t("$.sequence")).when(route == "quarantine", F.to_json("seq"))
    at = F.when(route == "typeCoverage", t("$.observedAt"))
    return rows.withColumns({"_what": what, "_a": a, "_b": b, "_at": at}).withColumn("bucket", F.pmod(F.xxhash64("_a"), F.lit(BUCKETS)).cast("int"))


def compact(spark: SparkSession, log: str, base: str) -> int:
    """Bring the snapshot in ``base`` up to the log's last epoch; the number of buckets that were written.

    Samples that a tombstone of the snapshot or of the new epochs deletes are left out, tombstones stay.  One
    with a date and no id can delete in any bucket, so it touches all.
    """
    version, through, buckets = head(spark, base)
    late = [e for e in _numbered(spark, log, "epoch") if e > through]
    if not late:
        return 0
    new = _keyed(deltas(spark, log, base).drop("epoch"))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # BUCKETS at most
    if not new.where("_what = 'dated'").isEmpty():
        touched = sorted({*touched, *buckets})
    old = _read(spark, base, {b: v for b, v in buckets.items() if b in touched})
    rows = new if old is None else new.unionByName(_keyed(old))
    last = latest_wins(rows, ["_what", "_a", "_b"], ["_at", "seq"])
    plain = last.where("_what = 'deletion'").select(F.col("id").alias("_id"), F.col("seq").alias("_plain"))
    dated = last.where("_what = 'dated'").select(F.col("type").alias("_type"), F.col("start_ts").alias("_start"), F.col("seq").alias("_dated"))
    sample = F.col("_what") == "sample"
    met = last.join(plain, sample & (F.col("id") == F.col("_id")), "left").join(dated, sample & (F.col("type") == F.col("_type")) & (F.col("start_ts") == F.col("_start")), "left")
    live = (F.col("_plain").isNull() | (F.col("_plain") < F.col("seq"))) & (F.col("_dated").isNull() | (F.col("_dated") < F.col("seq")))
    kept = met.where(live).select(*new.columns).withColumn("_part", F.pmod(F.xxhash64("_a", "_b"), F.lit(_PARTS)))
    spread = kept.repartition(_PARTS * len(touched) or 1, "bucket", "_part").drop("_what", "_a", "_b", "_at", "_part")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/version={version + 1}")
    there = {int(x.split("=")[1]) for x in folders(spark, f"{base}/version={version + 1}") if x.startswith("bucket=")}
    now = {b: v for b, v in buckets.items() if b not in touched} | dict.fromkeys(there, version + 1)  # a bucket may have become empty
    listed = [(b, v, late[-1]) for b, v in now.items()] + [(-1, -1, late[-1])]
    spark.createDataFrame(listed, "bucket int, of int, through long").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/version={version + 1}")
    return len(touched)


def expire(spark: SparkSession, log: str, base: str) -> None:
    """Remove the epochs that the snapshot holds, and versions of buckets and manifests that nothing names any more."""
    version, through, buckets = head(spark, base)
    for epoch in _numbered(spark, log, "epoch"):
        if epoch <= through:
            _drop(spark, f"{log}/epoch={epoch}")
    named = set(buckets.items())
    for v in _numbered(spark, base, "version"):
        for b in _numbered(spark, f"{base}/version={v}", "bucket"):
            if (b, v) not in named:
                _drop(spark, f"{base}/version={v}/bucket={b}")
    for v in _numbered(spark, f"{base}/manifest", "version"):
        if v < version:
            _drop(spark, f"{base}/manifest/version={v}")
