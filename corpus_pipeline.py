"""The corpus pipeline: language, repeated lines, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the next stage's ``docs``.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import langid, linededup, packing, secrets, simhash
from pulsegrid.llm.common import drop_rows, drop_table, write_table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars again, after a stage that changes texts."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose language isn't accepted: no letters, or no better than chance.

    Each row is judged by its own text, declared language and address, whatever other rows have its id.
    """
    key = langid.evidence_key()
    found = langid.identify(docs, extra=key)
    return drop_rows(docs, found.where("not accepted"), key)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents keep; a null text becomes an empty one."""
    return _measured(linededup.dedup_lines(docs, told=False))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are alike to 0.8 or more over shingles of five words: that of the smallest id.

    Rows that repeat an id and its text are one document, and stay or go together.
    """
    return drop_rows(docs, simhash.similar_copies(docs), simhash.text_key())


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    return _measured(secrets.redact_secrets(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed token windows."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("line dedup", repeated_lines), ("near dedup", near_copies), ("secret scan", secret_scan), ("packing", pack_windows)]
#: SQL cannot express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_table(last)  # none but tables of this program's own
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
