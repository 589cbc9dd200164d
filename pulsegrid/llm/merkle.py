"""Merkle fingerprints of documents: root over sections, sections over paragraphs, paragraphs over their sentences.

A section ends after a blank paragraph or one whose own hash says so, so that an edit moves no later
boundary.  Equal roots mean equal texts; where roots differ, equal sections are skipped and only the
leaves of the others are compared.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import spread

#: One paragraph in so many ends a section; characters from which a sentence is cut by words, and these words.
SECTION, LONG, WORDS = 4, 64, 6
_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*|[.!?]+\s*")
_SOME_WORDS = re.compile(r"\s*(?:\S+\s*){1,%d}|\s+" % WORDS)
_LEAST = -(1 << 63)


def _digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def leaves_of(paragraph: str) -> list[str]:
    """The paragraph in sentences, long ones in runs of words; joined, they are the paragraph."""
    out = []
    for x in _SENTENCE.findall(paragraph):
        out += _SOME_WORDS.findall(x) if len(x) > LONG else [x]
    return out


@dataclass(frozen=True)
class Tree:
    """``sections``: (hash, leaf hashes) in order."""

    root: bytes
    sections: tuple[tuple[bytes, tuple[bytes, ...]], ...]

    @property
    def leaves(self) -> int:
        return sum(len(x) for _, x in self.sections)

    def told(self) -> str:
        """``root:section;section``: 32 hex digits, then per section the first 16 of its own and 8 of each leaf."""
        return f"{self.root.hex()}:" + ";".join(h[:8].hex() + "".join(x[:4].hex() for x in leaves) for h, leaves in self.sections)


def tree(text: str) -> Tree:
    sections, nodes, leaves = [], [], []
    for paragraph in text.split("\n"):
        own = [_digest(x.encode("utf-8", "surrogatepass")) for x in leaves_of(paragraph)]
        node = _digest(b"p" + b"".join(own))
        nodes.append(node)
        leaves += own
        if not own or node[0] % SECTION == 0:
            sections.append((_digest(b"s" + b"".join(nodes)), tuple(leaves)))
            nodes, leaves = [], []
    if nodes:
        sections.append((_digest(b"s" + b"".join(nodes)), tuple(leaves)))
    return Tree(_digest(b"r" + b"".join(h for h, _ in sections), 16), tuple(sections))


def parse(told: str) -> Tree:
    """The tree of a fingerprint; leaf hashes are as short as it has them."""
    root, _, rest = told.partition(":")
    cut = lambda x: tuple(bytes.fromhex(x[i : i + 8]) for i in range(16, len(x), 8))
    return Tree(bytes.fromhex(root), tuple((bytes.fromhex(x[:16]), cut(x)) for x in rest.split(";")))


def _open(a: Tree, b: Tree) -> tuple[int, list[tuple[bytes, ...]], list[tuple[bytes, ...]]]:
    """Leaves in sections that both have, and the other sections of each."""
    had, shared, rest = Counter(h for h, _ in a.sections), 0, []
    for h, leaves in b.sections:
        if had[h] > 0:
            had[h] -= 1
            shared += len(leaves)
        else:
            rest.append(leaves)
    own = []
    for h, leaves in reversed(a.sections):
        if had[h] > 0:
            had[h] -= 1
            own.append(leaves)
    return shared, own[::-1], rest


def likeness(a: Tree, b: Tree) -> float:
    """Twice the shared leaves over all leaves, 1 for equal roots."""
    if a.root == b.root:
        return 1.0
    shared, own, other = _open(a, b)
    left = Counter(x[:4] for leaves in own for x in leaves)
    right = Counter(x[:4] for leaves in other for x in leaves)
    shared += sum((left & right).values())
    total = a.leaves + b.leaves
    return 2 * shared / total if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Where ``a`` has text that ``b`` lacks: (start, end) of leaves, in code points, adjoining ones joined."""
    one, two = tree(a), tree(b)
    if one.root == two.root:
        return []
    _, _, other = _open(one, two)
    there, kept = Counter(x for leaves in other for x in leaves), Counter(h for h, _ in two.sections)
    spans, out, at = [], [], 0
    for paragraph in a.split("\n"):
        for x in leaves_of(paragraph):
            spans.append((at, at + len(x)))
            at += len(x)
        at += 1
    place = iter(spans)
    for h, leaves in one.sections:
        same = kept[h] > 0
        kept[h] -= same
        for x in leaves:
            start, end = next(place)
            if same:
                continue
            if there[x] > 0:
                there[x] -= 1
            elif out and out[-1][1] >= start - 1:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first code points of ``following``, as many or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document.

    A document's next one is that of the next larger id (integers; equal ids in the order of a hash of
    their texts, null ids first), the last one's is the first; a sole document follows itself.  A null
    text is empty.  Two empty texts are alike (1); an empty and another one are not (0).  Other columns
    are left.

    Ids are cut into ranges by their quantiles, and an id that several quantiles fall on is cut by the
    hash of the text; a range is a partition.  Each also gets a copy of the next range's first document,
    so that texts are shuffled once and no task needs another's rows.
    """
    n, context = spread(docs.sparkSession), docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("long").alias("raw"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    base = base.withColumns({"place": F.coalesce("raw", F.lit(_LEAST)), "mix": F.xxhash64("text")})
    at = [i / n for i in range(1, n)] or [0.5]
    found = base.agg(F.percentile_approx("place", at, max(10_000, 40 * n)).alias("x")).first().x or []
    # (cut, ranges begun at or before it, parts that rows of just this id have)
    cuts, begun = np.unique(np.array(found, dtype=np.int64), return_counts=True)
    bounds = context.broadcast((cuts, np.concatenate([[0], np.cumsum(begun)]), begun))

    # Ranges are found by bisection: an expression over all cuts would cost each row as many steps.
    @F.pandas_udf("int")
    def range_of(place: pd.Series, mix: pd.Series) -> pd.Series:
        cuts, upto, parts = bounds.value
        where = place.to_numpy()
        at = np.searchsorted(cuts, where, side="right")
        out = upto[at]
        if len(cuts):
            hot = np.maximum(at - 1, 0)
            on = (at > 0) & (cuts[hot] == where) & (parts[hot] > 1)
            share = (mix.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
            out = np.where(on, upto[hot] + 1 + np.minimum((share * parts[hot]).astype(np.int64), parts[hot] - 1), out)
        return pd.Series(out.astype(np.int32))

    ranged = base.withColumn("range", range_of("place", "mix"))
    order = F.struct("place", "mix")
    told = sorted((r.range, r.first.place, r.first.mix) for r in ranged.groupBy("range").agg(F.min(order).alias("first")).collect())
    firsts = context.broadcast(tuple(np.array([t[i] for t in told], dtype=np.int64) for i in range(3)))

    @F.pandas_udf("int")
    def copied_to(place: pd.Series, mix: pd.Series, own: pd.Series) -> pd.Series:
        """The range before, for documents that are the first of theirs, else -1."""
        order, first, mixed = firsts.value
        at = np.searchsorted(order, own.to_numpy())
        return pd.Series(np.where((first[at] == place.to_numpy()) & (mixed[at] == mix.to_numpy()), order[at - 1], -1).astype(np.int32))

    copies = F.nullif(copied_to("place", "mix", "range"), F.lit(-1))
    rows = ranged.select("id", "text", "place", "mix", F.explode(F.array_compact(F.array(F.struct("range", F.lit(0).alias("copy")), F.when(copies.isNotNull(), F.struct(copies.alias("range"), F.lit(1).alias("copy")))))).alias("to"))
    met = rows.select("id", "text", "place", "mix", "to.range", "to.copy").repartitionById(n, F.col("range")).sortWithinPartitions("range", "copy", "place", "mix", "text")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held, size, last, key = [], 0, None, None

        def told() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*held, strict=True)) or [[]] * 7
            kinds = [key, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            key = batch.column(0).type
            for id_, text, copy in zip(batch.column(0), batch.column(1), batch.column(4), strict=True):
                if last is None and copy.as_py():
                    continue
                body = text.as_py().decode("utf-8", "replace")
                here = (id_.as_py(), body, tree(body))
                if last is not None:
                    own, mine, made = last
                    new = edited(mine, body)
                    after = tree(new)
                    held.append((own, len(mine), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), made.told(), after.told(), likeness(made, after), likeness(made, here[2])))
                    size += len(mine)
                    if size > 2 << 20:
                        yield told()
                last = None if copy.as_py() else here
        if key is not None:
            yield told()

    out = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return met.select("id", "text", "place", "range", "copy").mapInArrow(run, out)
