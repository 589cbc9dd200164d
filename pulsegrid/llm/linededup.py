"""Line dedup with DataFrame functions only.

Lines become 128-bit hashes.  Range partitions over (hash, document), sorted by document and position
within, hold all occurrences of a line in one document together, however common the line is.  A pass in
that order marks each document's first occurrence; counts and last documents by hash are partial sums
of these rows, so a common line is met in many tasks.  What goes back to the documents is a bitmap of
the lines to keep, in words of 32 bits: texts are never shuffled by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import BROADCAST_IDS, drop_table, free_names, spread, write_table

_SPACE = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines in a word of the bitmap.
WORD = 32
#: Words of bitmaps that are broadcast, some MB; beyond it bitmaps and documents are shuffled by id.
BROADCAST_WORDS = 400_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(text: Column) -> Column:
    """A hash that tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(id, row_key, word, bits): the lines that go, as set bits of the row's bitmap words.

    Rows that share an id are one document, but each has bits of its own (``row_key``, of its text).

    A key of ``least_chars`` code points that ``least_docs`` documents hold goes from all but the
    largest id.  Documents without an id hold no key.
    """
    n = spread(docs.sparkSession)
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), row_key(F.col(text_col)).alias("row_key"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keys = lines.select("doc", "row_key", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    hashed = keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "row_key", "pos")
    # Hashes are written first: finding the ranges' bounds reads its input twice, and that shall not be the texts.
    hashed = write_table(hashed, "hashes")
    # A partition boundary falls between documents, so a line of a third of all documents is spread out.
    ordered = hashed.repartitionByRange(n, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    # The window follows the order that is there: nothing is sorted or shuffled again.
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc").orderBy("pos")) == 1
    held = write_table(ordered.withColumn("first", first), "lines")
    drop_table(hashed)
    counted = held.where("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= least_docs)
    # A common line's rows lie spread out, to be met by a broadcast of few keys or by a join whose large
    # partitions Spark can split.
    common = write_table(counted.select("h1", "h2", "last"), "common")
    few = common.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    gone = held.join(F.broadcast(common) if few else common, ["h1", "h2"]).where(F.col("doc") < F.col("last"))
    bits = gone.select("doc", "row_key", F.floor(F.col("pos") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, pos % {WORD})").alias("bit"))
    return bits.groupBy("doc", "row_key", "word").agg(F.bit_or("bit").alias("bits")).withColumnRenamed("doc", id_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", told: bool = True, **rules: int) -> DataFrame:
    """``docs`` with ``text_col`` rebuilt of its kept lines, and with ``told`` also n_lines, n_dropped, keep_bitmap.

    ``keep_bitmap``: the words of 32 lines in which a line goes, as ``word:hex`` joined by commas, the
    lowest line in the lowest bit, a set bit for a line that stays; every line of the other words
    stays, so it is empty if nothing goes.  A null or empty text is one empty line; a text that loses
    all its lines becomes empty.  Rows with a null id keep every line, rows that repeat an id with
    another text have bitmaps of their own.

    Columns of ``docs`` stay, whatever their names; only with ``told`` do columns named n_lines,
    n_dropped and keep_bitmap give way to those told.  Bitmaps of up to ``BROADCAST_WORDS`` words are
    broadcast and no text moves; beyond that documents are shuffled by id, once.
    """
    words = write_table(dropped_lines(docs, id_col, text_col, **rules), "bitmaps")
    few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    id_, row, cut, lines, gone, kept = free_names(docs, "cut_id", "cut_row", "cut_words", "cut_lines", "cut_gone", "cut_kept")
    entries = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    maps = words.groupBy(F.col(id_col).alias(id_), F.col("row_key").alias(row)).agg(entries.alias(cut))
    met = (F.col(id_col) == F.col(id_)) & (row_key(F.col(text_col)) == F.col(row))
    marked = docs.join(F.broadcast(maps) if few else maps, met, "left").drop(id_, row).withColumn(lines, lines_of(F.col(text_col)))
    dense = F.expr(f"transform(sequence(0, (size({lines}) - 1) div {WORD}), w -> coalesce(try_element_at({cut}, w), 0L))")
    marked = marked.withColumn(gone, F.when(F.col(cut).isNotNull(), dense))
    marked = marked.withColumn(kept, F.expr(f"filter({lines}, (x, i) -> {gone} is null or shiftright({gone}[i div {WORD}], i % {WORD}) & 1 = 0)"))
    bitmap = F.expr(
        f"""coalesce(array_join(transform(array_sort(map_entries({cut})),
        e -> concat(e.key, ':', lower(hex(~e.value & (shiftleft(1L, least({WORD}, size({lines}) - e.key * {WORD})) - 1))))), ','), '')"""
    )
    counts = [F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"), bitmap.alias("keep_bitmap")] if told else []
    rest = [c for c in docs.columns if not told or c not in ("n_lines", "n_dropped", "keep_bitmap")]
    return marked.select(*[F.array_join(kept, "\n").alias(c) if c == text_col else F.col(c) for c in rest], *counts)


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: line counts, the digest of the kept text and the bitmap."""
    out = dedup_lines(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    return out.select(id_col, "n_lines", "n_dropped", F.sha2(F.col(text_col).cast("binary"), 256).alias("kept_sha256"), "keep_bitmap")


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (c.last IS NOT NULL AND k.doc_id < c.last) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
), words AS (
  SELECT doc_id, pos // 32 AS word, bool_or(gone) AS cut,
    sum(CASE WHEN gone THEN 0 ELSE (1::BIGINT << (pos % 32)::INTEGER) END)::BIGINT AS bits
  FROM marked GROUP BY ALL
), maps AS (
  SELECT doc_id, string_agg(word || ':' || printf('%X', bits), ',' ORDER BY word) AS told FROM words WHERE cut GROUP BY doc_id
)
SELECT m.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256,
  coalesce(lower(any_value(told)), '') AS keep_bitmap
FROM marked m LEFT JOIN maps USING (doc_id) GROUP BY m.doc_id
"""
