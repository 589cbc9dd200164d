"""Interaction of quality filters: every order of five filters, audited in one pass.

What a filter removes depends on those before it, but a document's fate in all 120 orders follows from
the set of filters that it fails: its mask.  ``packed`` maps a mask, with the document's labels, to one big
integer whose fields of 64 bits hold the outcomes of all 600 steps.  Tasks add the integers of their
documents by part; sums meet in salted groups first, then by part, and are unpacked into rows.

A field counts each document once (a Shapley field 120 times at most), so fields can't overflow into each
other below 2^63 / 120 documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import BROADCAST_IDS, spread, write_table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
#: Counts of a step that differ from document to document by mask and labels, in fields one after the other.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
WIDTH = 8
#: Bits of a document's state above those of its mask.
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
STATES = 4 << len(FILTERS)
#: Parts whose sums a task holds; beyond it they are sent on and begun anew.
HELD = 256
#: Capitals, the marks of filter D, and the bytes of a code point after its first.
_CAPITALS, _MARKS, _INNER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))


def outcomes(state: int) -> np.ndarray:
    """(step, count) and then a Shapley field a filter: what one document of the state adds to each."""
    mask, good, toxic = state & (GOOD - 1), bool(state & GOOD), bool(state & TOXIC)
    fails = {f: bool(mask >> i & 1) for i, f in enumerate(FILTERS)}
    steps, shapley = np.zeros((len(STEPS), len(COUNTS)), dtype="<u8"), np.zeros(len(FILTERS), dtype="<u8")
    for k, (order, step) in enumerate(STEPS):
        own = order[step - 1]
        gone = any(fails[f] for f in order[: step - 1])
        removed = fails[own] and not gone
        alone = fails[own] and sum(fails.values()) == 1
        steps[k] = [not gone and not fails[own], removed, fails[own] and gone, alone, removed and good, removed and toxic]
        shapley[FILTERS.index(own)] += removed
    return np.concatenate([steps.ravel(), shapley])


def packed(state: int) -> int:
    """The big integer of a state."""
    return int.from_bytes(outcomes(state).tobytes(), "little")


FIELDS = len(STEPS) * len(COUNTS) + len(FILTERS)
_BYTES = FIELDS * WIDTH


def unpacked(total: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps by counts, Shapley counts by filter) of a sum of packed integers."""
    fields = np.frombuffer(total.to_bytes(_BYTES, "little"), dtype="<u8").astype(np.int64)
    return fields[: -len(FILTERS)].reshape(len(STEPS), len(COUNTS)), fields[-len(FILTERS) :]


def failed(text: bytes) -> int:
    """The bits of the filters A to D that the text fails."""
    words = text.split()  # at exactly the six white characters
    chars = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    marked = len(text) != len(text.translate(None, _MARKS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * chars) << 2 | marked << 3


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, mask): filters A to D by the whole text, and the text's SHA-256 for filter E."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([failed(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(3).cast(pa.large_binary())], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["id", "part", "digest", "mask"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(judge, "id long, part string, digest binary, mask int")


def states(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, state): each document's mask of all five filters, and its labels."""
    known = write_table(masks(docs, id_col, text_col, part_col), "masks")
    firsts = known.where("id is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    firsts = write_table(firsts.select("digest", "first"), "firsts")
    # Few repeated texts are broadcast; many meet in a join whose large partitions Spark can split.
    few = firsts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    met = known.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    mask = F.col("mask") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)
    met = write_table(met.select("id", "part", mask.alias("mask")), "repeats")
    said = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = F.coalesce("good", F.lit(0)) * GOOD + F.coalesce("toxic", F.lit(0)) * TOXIC
    return met.join(said, "id", "left").select("part", (F.col("mask") + told).cast("int").alias("state"))


def _added(sums: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.to_bytes(_BYTES, "little") for x in sums.values()], pa.binary())], names=["part", "total"])


def summed(rows: DataFrame) -> DataFrame:
    """(part, total): the sums of the states' big integers, as little-endian bytes, a row a part and task at most HELD parts at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = [packed(s) for s in range(STATES)], {}
        for batch in batches:
            parts, where = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            counts = np.bincount(where * STATES + batch.column(1).to_numpy(), minlength=len(parts) * STATES)
            for i in np.nonzero(counts)[0].tolist():
                part = parts[i // STATES]
                sums[part] = sums.get(part, 0) + int(counts[i]) * table[i % STATES]
                if len(sums) >= HELD:
                    yield _added(sums)
                    sums = {}
        if sums:
            yield _added(sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, 0
        for batch in batches:
            out: dict[str, int] = {}
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part is not None and p != part:
                    out[part], total = total, 0
                part, total = p, total + int.from_bytes(x.as_buffer().to_pybytes(), "little")
            if out:
                yield _added(out)
        if part is not None:
            yield _added({part: total})

    n = spread(rows.sparkSession)
    shape = "part string, total binary"
    own = rows.mapInArrow(add, shape).withColumn("salt", F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.shiftright(F.monotonically_increasing_id(), 33)), F.lit(n)))
    once = own.repartition(n, "part", "salt").sortWithinPartitions("part").select("part", "total").mapInArrow(merge, shape)
    return once.repartition(n, "part").sortWithinPartitions("part").mapInArrow(merge, shape)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, counts): 600 rows a part, what each step of each order of the five filters does.

    Filters, by the failure: A under 200 words, B fewer than half of the words distinct, C more than 3 %
    capitals, D a mark of ``#$%&*|``, E a text that a smaller id has too, removed or not.  A null text is
    empty, a null part the empty string.  Rows with a null id have no smaller id and are no one's; rows
    that repeat an id count each, and their equal texts don't fail for one another.  An id with several
    label rows is good or toxic if any says so; other labels than 1, and null, say nothing.  No documents
    give no rows.  Other columns are left.
    """
    rows = summed(states(docs, labels, id_col, text_col, part_col))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = pa.array([o for o, _ in STEPS]), pa.array([s for _, s in STEPS], pa.int32())
        own = [FILTERS.index(o[s - 1]) for o, s in STEPS]
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts, shapley = unpacked(int.from_bytes(x.as_buffer().to_pybytes(), "little"))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(STEPS), pa.string()), orders, steps, *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(shapley[own])], names=["part", "filter_order", "step", *COUNTS, "shapley"])

    return rows.mapInArrow(unpack, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*COUNTS, "shapley"]))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang::VARCHAR, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM texts t JOIN firsts USING (text) LEFT JOIN said USING (doc_id)
), masks AS (SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step:step] AS f, filter_order[1:step - 1] AS before
  FROM orders, unnest(range(1, 6)) AS t(step)
), met AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS fail, fails = f AS alone,
    len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM masks, steps
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND fail THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND fail AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND fail AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
