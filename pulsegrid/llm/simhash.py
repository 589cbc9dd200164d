"""SimHash near-duplicates through Golay codes.

Two fingerprints that differ in at most 4 of 64 bits agree in one of five disjoint parts.  Of the
other bits, two segments of 23 are taken; one of them has at most 2 differing bits.  The binary Golay
code packs the words of 23 bits perfectly: words at distance 2 or less have a codeword within
distance 4 of both.  So a part's bits with the index of each codeword near a segment (one or six) are
keys of which linked fingerprints share one.  Equal keys meet in a sorted partition and are verified;
only different fingerprints take part, and of those within 4 bits of one another there are at most
679,121, which bounds a bucket of copies.

``similar_copies`` goes beyond 4 bits for a similarity of 0.8: four fingerprints of one text and the keys of
each give candidates, which are verified by the texts' sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop_table, likely, row_slices, spread, write_table

#: Bits that linked fingerprints may differ in.
MOST_BITS = 4
_PARTS = (13, 13, 13, 13, 12)
_SEGMENT, _CHECK = 23, 11
#: Generator polynomial of the binary Golay code of length 23.
_GENERATOR = 0b101011100011
#: Runs up to this length are compared pair by pair; longer ones by a search over what is unvisited.
_PAIRWISE = 32
_HASHES = 1 << 16
#: Fingerprints of a text that two halves of a sketch are made of; of a half's 128 bits, those that candidates may
#: differ in: texts of a similarity of 0.8 (cosine 0.89) are expected to differ in 19.
SEEDS, SKETCH_BITS = 4, 24


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """The hashes as another seed would have them; those of seed 0 as they are."""
    if not seed:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * seed & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; in runs of 255, whose counts fit a byte."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(h) // 255 * 255
    runs = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
    return runs.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def sketch(text: bytes, shingle: int, seeds: int) -> list[int]:
    """The SimHashes of a text's word shingles under several seeds; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return [0] * seeds
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    wide = min(shingle, len(words)) - 1
    digest, total, counts = xxhash.xxh64_intdigest, len(words) - wide, np.zeros((seeds, 64), dtype=np.int64)
    first, last = starts[:total].tolist(), ends[wide:].tolist()
    for at in range(0, total, _HASHES):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + _HASHES], last[at : at + _HASHES], strict=True)], dtype="<u8")
        for seed in range(seeds):
            counts[seed] += _set_bits(_mixed(hashes, seed))
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words."""
    return sketch(text, shingle, 1)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp as a signed long.  A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in part.column(1)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndrome tables by byte, and for each syndrome the error patterns of weight 4 or less (one or six, the first repeated)."""
    unit = []
    for bit in range(_SEGMENT):
        rest = 1 << bit
        for high in range(_SEGMENT - 1, _CHECK - 1, -1):
            if rest >> high & 1:
                rest ^= _GENERATOR << (high - _CHECK)
        unit.append(rest)
    tables = []
    for low in range(0, _SEGMENT, 8):
        table = np.zeros(256, dtype=np.int64)
        for j in range(min(8, _SEGMENT - low)):
            table[np.arange(256) >> j & 1 == 1] ^= unit[low + j]
        tables.append(table)
    found: list[list[int]] = [[] for _ in range(1 << _CHECK)]
    for weight in range(5):
        for bits in combinations(range(_SEGMENT), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= unit[b]
            found[syndrome].append(sum(1 << b for b in bits))
    return tables, np.array([(x + x[:1] * 6)[:6] for x in found], dtype=np.int64)


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each word of 23 bits: six columns, repeats where there is one."""
    tables, errors = _golay()
    syndrome = tables[0][segment & 255] ^ tables[1][segment >> 8 & 255] ^ tables[2][segment >> 16]
    return (segment[:, None] ^ errors[syndrome]) >> _CHECK


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every key of every fingerprint (uint64)."""
    keys, rows, low = [], [], 0
    for part, width in enumerate(_PARTS):
        exact = (fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        below = fps & np.uint64((1 << low) - 1)
        above = np.zeros_like(fps) if low + width == 64 else fps >> np.uint64(low + width) << np.uint64(low)
        rest = (below | above).astype(np.int64)
        for half in range(2):
            index = codewords(rest >> half * _SEGMENT & (1 << _SEGMENT) - 1)
            key = ((part * 2 + half << 13 | exact) << 12)[:, None] | index
            fresh = np.ones(key.shape, dtype=bool)
            fresh[:, 1:] = key[:, 1:] != key[:, :1]
            keys.append(key[fresh])
            rows.append(np.nonzero(fresh)[0])
        low += width
    return np.concatenate(keys), np.concatenate(rows)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, or of rows of several."""
    bits = np.bitwise_count(x ^ y)
    return bits if bits.ndim == 1 else bits.sum(axis=1)


def _grown(run: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the linked fingerprints in one run, by search from the smallest on."""
    left, parents, children = run, [run[:0]], [run[:0]]
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _apart(left, at[None]) <= most if run.ndim == 2 else _apart(left, at) <= most
            if near.any():
                got = left[near]
                parents.append(np.repeat(at[None], len(got), axis=0))
                children.append(got)
                front += list(got)
                left = left[~near]
    return np.concatenate(parents), np.concatenate(children)


def _tree(run: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest of a run's rows, of at most ``most`` bits each.

    Whatever number of bits is asked for, rows that are connected by edges of so few are so in the forest:
    candidates that fail later leave those connected that don't.
    """
    parents, children = [run[:0]], [run[:0]]
    left, apart, via = np.arange(1, len(run)), _apart(run[1:], run[:1]), np.zeros(max(0, len(run) - 1), dtype=np.int64)
    while len(left):
        i = int(apart.argmin())
        at = left[i]
        if apart[i] <= most:
            parents.append(run[via[i]][None])
            children.append(run[at][None])
        left, apart, via = np.delete(left, i), np.delete(apart, i), np.delete(via, i)
        now = _apart(run[left], run[at][None])
        closer = now < apart
        apart, via = np.where(closer, now, apart), np.where(closer, at, via)
    return np.concatenate(parents), np.concatenate(children)


def links_in(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints (or rows of them) of equal keys; both arrays are sorted by key, and runs are whole."""
    if not len(keys):
        return fps, fps
    bounds = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
    sizes = np.diff(bounds)
    one, two = [fps[:0]], [fps[:0]]
    for i in np.nonzero(sizes > _PAIRWISE)[0]:
        a, b = (_grown if fps.ndim == 1 or fps.shape[1] == 1 else _tree)(np.unique(fps[bounds[i] : bounds[i + 1]], axis=0), most)
        one.append(a)
        two.append(b)
    small = np.repeat(sizes <= _PAIRWISE, sizes)
    k, f = keys[small], fps[small]
    for step in range(1, _PAIRWISE):
        same = np.nonzero(k[step:] == k[:-step])[0]
        if not len(same):
            break
        a, b = f[same], f[same + step]
        differing = _apart(a, b)
        near = (differing <= most) & (differing > 0)
        one.append(a[near])
        two.append(b[near])
    a, b = (np.concatenate(x).reshape(-1, 1 if fps.ndim == 1 else fps.shape[1]) for x in (one, two))
    turned = np.zeros(len(a), dtype=bool)
    for c in reversed(range(a.shape[1])):
        turned = np.where(a[:, c] == b[:, c], turned, a[:, c] > b[:, c])
    a[turned], b[turned] = b[turned], a[turned]
    pairs = np.unique(np.concatenate([a, b], axis=1), axis=0)
    half = a.shape[1]
    return (pairs[:, 0], pairs[:, 1]) if fps.ndim == 1 else (pairs[:, :half], pairs[:, half:])


def sketch_links(sketches: DataFrame, most: int) -> DataFrame:
    """(a0, …, b0, …): links between the different rows of ``sketches``, whose columns are fingerprints of one text each.

    Candidates share a key of one of the fingerprints and differ in at most ``most`` bits of all.  Those
    of one key are connected by the links told; a run of many equal keys gives a spanning forest instead
    of all its pairs.
    """
    n, wide = spread(sketches.sparkSession), len(sketches.columns)
    words = [f"w{i}" for i in range(wide)]
    ends = [f"{side}{i}" for side in "ab" for i in range(wide)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for at in range(0, len(values), 20_000):
                some = values[at : at + 20_000]
                for w in range(wide):
                    keys, rows = fuzzy_keys(some[:, w].astype(np.int64).view(np.uint64))
                    # The ten families of a fingerprint take less than 29 bits.
                    yield pa.RecordBatch.from_arrays([pa.array((keys | w << 29).astype(np.int32)), *(pa.array(c) for c in some[rows].T)], names=["key", *words])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, dtype=np.int32), np.empty((0, wide), dtype=np.uint64)

        def told(end: int) -> pa.RecordBatch:
            a, b = links_in(keys[:end], fps[:end], most)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for side in (a, b) for c in side.T], names=ends)

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint64)])
            if len(keys) >= 100_000 and keys[0] != keys[-1]:
                end = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
                yield told(end)
                keys, fps = keys[end:], fps[end:]
        yield told(len(keys))

    rows = sketches.toDF(*words).repartition(n).mapInArrow(keyed, "key int, " + ", ".join(f"{w} long" for w in words))
    met = rows.repartition(n, "key").sortWithinPartitions("key", *words)
    return met.mapInArrow(verified, ", ".join(f"{e} long" for e in ends)).distinct()


def near_links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(a, b): enough links between the different fingerprints of ``fps`` to connect all that are linked.

    Every pair within ``most`` bits is connected by these links: up to 4 differing bits, a shared key is certain.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError("five parts and two segments find up to 4 differing bits")
    return sketch_links(fps.select("fp"), most).toDF("a", "b")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; ``links`` (a, b), ``nodes`` (node).

    Each round takes the least label among neighbours, then the label's own label, so that long
    chains shrink by halves.  A round is written to the shared folder; rounds end when nothing changes.
    """
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = write_table(links.select(F.inline(F.array(F.struct("a", "b"), turned))), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
    labels = write_table(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        met = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        ups = labels.select(F.col("node").alias("mid"), F.col("root").alias("up"))
        after = met.join(ups, "mid", "left").select("node", "old", F.least("mid", F.coalesce("up", "mid")).alias("root"))
        after = write_table(after, "labels")
        drop_table(labels)
        labels = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            drop_table(both)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS, shingle: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): one row per document, the component's smallest id with each.

    Exact copies share a fingerprint and are one node, however many.  Null and empty texts have the
    fingerprint 0 and are linked like any other; a null id is never a component's id, unless none of
    its documents has another.  Repeated rows are kept.
    """
    marked = write_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = write_table(marked.groupBy("fp").agg(F.min(id_col).alias("node")), "nodes")
    named = nodes.where(F.col("node").isNotNull())
    links = near_links(nodes, most)
    one = named.select(F.col("fp").alias("a"), F.col("node").alias("na"))
    two = named.select(F.col("fp").alias("b"), F.col("node").alias("nb"))
    by_node = links.join(one, "a").join(two, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    roots = components(by_node, nodes)
    of_fp = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = marked.join(of_fp, "fp")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key(text_col: str = "text") -> Column:
    """A hash that tells rows of one id apart by their texts."""
    return F.xxhash64(F.isnull(text_col), text_col)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted; of its whole words where there are fewer.

    32 bits of each: of two texts of n shingles, n^2 / 2^32 differing ones are taken for equal, less than one
    up to 65,000 shingles.
    """
    words = text.lower().split()
    wide = max(1, min(shingle, len(words)))
    return np.unique(np.array([xxhash.xxh32_intdigest(b" ".join(words[i : i + wide]), 42) for i in range(len(words) - wide + 1)], dtype=np.uint32))


def verified_links(links: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """The ``links`` (a, b) whose texts' sets of shingles have a Jaccard similarity of ``least`` or more.

    ``nodes``: node, and id and key of a row that has its text.  Sets are made for texts that are in a link, and
    hardly any other text is shuffled.
    """
    asked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(nodes, "node")
    asked = write_table(asked.select("node", F.col("id").alias("_id"), F.col("key").alias("_key")), "asked")
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    held = likely(rows, asked.select(F.col("_id").alias("id"), F.col("_key").alias("key")), "id", "key")
    held = held.join(asked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("node", "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                sets = [shingle_set(t.as_py() or b"", shingle).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(both >= least * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = write_table(held.mapInArrow(run, "node long, hashes binary"), "shingles")
    met = links.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")
    found = write_table(met.mapInArrow(compare, "a long, b long"), "similar")
    drop_table(sets)
    return found


def similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int = SKETCH_BITS, least: float = 0.8) -> DataFrame:
    """(id, key): the rows that go so that one document of each group of similar ones stays; key is ``text_key``.

    A text's sketch is four fingerprints of its word shingles.  Two texts are candidates where they share a
    Golay key of one of them and differ in at most ``most`` of the 128 bits of either half, and linked if
    the Jaccard similarity of their sets of shingles is ``least`` or more, so that none goes for another that
    it doesn't resemble; how many pairs the keys find README tells.  Groups are all that links connect; the
    smallest id of each stays (a null one comes last, of equal ids the smallest key).  Rows that repeat an
    id and its text stay or go together.  Texts without words are one group.
    """
    names = [f"s{i}" for i in range(SEEDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 2):
                made = np.array([sketch(t.as_py() or b"", shingle, SEEDS) for t in part.column(2)], dtype=np.uint64).reshape(-1, SEEDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(np.ascontiguousarray(c)) for c in made.T)], names=["id", "key", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    marked = write_table(read.mapInArrow(run, f"id {kind}, key long, " + ", ".join(f"{s} long" for s in names)), "sketches")
    # Texts of one sketch are one node: they have the same shingles, or 256 majorities of them alike.
    order = F.struct(F.isnull("id").alias("none"), "id", "key")
    nodes = write_table(marked.groupBy(*names).agg(F.min(order).alias("of")).select(*names, F.xxhash64(*names).alias("node"), "of.id", "of.key"), "nodes")
    found = None
    for half in (names[:2], names[2:]):
        firsts = nodes.groupBy(*half).agg(F.min("node").alias("first"))
        same = nodes.join(firsts, half).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
        links = sketch_links(firsts.select(*half), most)
        one = firsts.toDF("a0", "a1", "a")
        two = firsts.toDF("b0", "b1", "b")
        links = same.unionByName(links.join(one, ["a0", "a1"]).join(two, ["b0", "b1"]).select("a", "b"))
        found = links if found is None else found.unionByName(links)
    found = write_table(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    roots = components(verified_links(found, nodes, docs, id_col, text_col, shingle, least), nodes.select("node"))
    grouped = marked.join(nodes.join(roots, "node", "left").select(*names, F.coalesce("root", "node").alias("group")), names).select("id", "key", "group")
    stay = grouped.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.id").alias("keep"), F.col("first.key").alias("keep_key"))
    gone = marked.join(stay, F.col("id").eqNullSafe(F.col("keep")) & (F.col("key") == F.col("keep_key")), "left_anti")
    return gone.select(F.col("id").alias(id_col), "key")
