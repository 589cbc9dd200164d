"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast id list may have; beyond it the same rows go through a shuffle join.
BROADCAST_IDS = 200_000

#: Words of 64 bits of the bitmap that ``likely`` broadcasts, at most.
BITMAP_WORDS = 1 << 20

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        p = hadoop.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is the cluster's scratch space
        pass


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it goes when the program ends."""
    app = spark.sparkContext.applicationId
    base = _made.get(app)
    if base is None:
        base = _made[app] = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, base)
    return f"{base}/{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table of ``write_table`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if any(f"{base}/" in path for base in _made.values()):
            _remove(df.sparkSession, path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to differ from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def spread(spark: SparkSession) -> int:
    """Partitions for a stage whose rows grow before the next shuffle."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def drop_rows(docs: DataFrame, gone: DataFrame, key: Column, id_col: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` without the rows whose id and ``key`` are both in ``gone`` (id, key); a null id is a value like any other.

    ``key`` tells rows of one id apart, so a row never goes for another of the same id.  The list is
    written once and counted: up to ``limit`` rows it is broadcast and the texts stay where they are,
    beyond that both sides are shuffled by id and key.
    """
    id_, mark = free_names(docs, "gone_id", "gone_key")
    listed = write_table(gone.select(F.col(id_col).alias(id_), F.col("key").alias(mark)).distinct(), "gone")
    few = listed.limit(limit + 1).count() <= limit
    met = F.col(id_col).eqNullSafe(F.col(id_)) & (key == F.col(mark))
    return docs.join(F.broadcast(listed) if few else listed, met, "left_anti")


def likely(rows: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """``rows`` that may have the values of ``names`` that a row of ``wanted`` has: all that do, and few others.

    None of ``rows`` is shuffled: what is broadcast is a bitmap of the hashes of ``wanted``, a row a word and
    ``BITMAP_WORDS`` of them at most, so that of n wanted values a share of n / 2^26 of the others stays.
    """
    spot, word = free_names(rows, "spot", "word")
    at, bit = F.pmod(F.xxhash64(*names), F.lit(BITMAP_WORDS)), F.shiftrightunsigned(F.xxhash64(*names), 58).cast("int")
    words = wanted.groupBy(at.alias(spot)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(word))
    return rows.join(F.broadcast(words), (at == F.col(spot)) & (F.bit_get(F.col(word), bit) == 1), "left_semi")


def row_slices(batch, column: int, most: int = 4 << 20):  # noqa: ANN001, ANN201  Arrow record batches
    """The batch in slices of about ``most`` bytes of ``column``, one row at least: what a task holds at once."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
