"""Exact top-k by inner product through M-trees.

A vector x gets one more component, the root of M^2 - |x|^2 with M the largest norm, and a query a zero:
then the Euclidean distance falls as the inner product grows.  Vectors are dealt into regions of the
nearest of a bounded sample of pivots, and large regions into blocks; each block is a tree of paged
nodes with covering radii and distances to the parent.  The search takes nodes by the least distance
that they can hold; stored distances give triangle-inequality bounds that spare computing others.

A query first searches its own block, then those blocks whose region can hold a better score than its
k-th so far.  Scores are integers, and bounds leave room for rounding, so results are exact.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import spread, write_table

#: Vectors in a block (one tree) and in a leaf page, children of an inner node.
BLOCK, PAGE, FANOUT = 8192, 256, 16
#: Neighbouring blocks whose trees a task holds together (5 MB each at 64 dimensions), so that a query goes once to all of them;
#: queries that it searches them for, and queries that are worth a copy of them where tasks would idle.
GROUP, QUERIES, FEW = 8, 8192, 256
#: Regions at most: what is known of them is all that is broadcast, some MB.
REGIONS = 1024
_SLACK = 1e-6
_LOWEST = -(1 << 63)


def _halved(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of parts of at most ``most`` points, halved between two points that are far from each other."""
    todo, out = [np.arange(len(points))], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            out += [part] * bool(len(part))
            continue
        at = points[part]
        a = at[np.argmax(((at - at[0]) ** 2).sum(axis=1))]
        b = at[np.argmax(((at - a) ** 2).sum(axis=1))]
        rank = np.argsort(at @ (b - a), kind="stable")
        todo += [part[rank[: len(part) // 2]], part[rank[len(part) // 2 :]]]
    return out


class MTree:
    """Bulk-loaded tree over integer vectors ``x`` with ids, which break ties.

    Node i has the pivot ``pivot[i]``, the covering radius ``radius[i]``, and for each of ``entries[i]``
    (places of vectors in a leaf, of nodes elsewhere) its distance to the pivot in ``parent[i]``.  Leaves
    come first, the root last.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        norms = (x.astype(np.float64) ** 2).sum(axis=1)
        self.top = float(norms.max(initial=0))
        points = np.column_stack([x, np.sqrt(self.top - norms)]).astype(np.float64)
        groups = _halved(points, PAGE)
        order = np.concatenate([np.zeros(0, dtype=np.int64), *groups])
        # Floats hold all products exactly where no one can reach 2 ** 53.
        self.ids, self.x = ids[order], x[order].astype(np.float64) if self.top < 2.0**52 else x[order]
        points = points[order]
        ends = np.cumsum([len(g) for g in groups])
        self.entries = [np.arange(e - len(g), e) for g, e in zip(groups, ends, strict=True)]
        self.leaves = len(self.entries)
        pivots, self.parent, radius = [], [], []

        def close(at: np.ndarray, covers: np.ndarray) -> None:
            pivots.append(at.mean(axis=0))
            self.parent.append(np.linalg.norm(at - pivots[-1], axis=1))
            radius.append(float((self.parent[-1] + covers).max()))

        for e in self.entries:
            close(points[e], np.zeros(len(e)))
        level = np.arange(self.leaves)
        while len(level) > 1:
            above = []
            for g in _halved(np.array([pivots[i] for i in level]), FANOUT):
                children = level[g]
                above.append(len(pivots))
                self.entries.append(children)
                close(np.array([pivots[i] for i in children]), np.array([radius[i] for i in children]))
            level = np.array(above)
        self.pivot, self.radius = np.array(pivots).reshape(len(pivots), points.shape[1]), np.array(radius)

    def search(self, own: int, q: np.ndarray, k: int, least: int = _LOWEST) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (ids, scores) of ``least`` or more for the query, itself left out, and how many vectors were scored."""
        point, square = np.append(q, 0).astype(np.float64), float(q.astype(np.float64) @ q)
        asked = q.astype(self.x.dtype)
        ids, scores, scored = np.empty(0, dtype=np.int64), np.empty(0, dtype=self.x.dtype), 0

        def reach(score: float) -> float:
            return np.sqrt(max(0.0, square + self.top - 2.0 * score)) * (1 + _SLACK) + _SLACK

        worst = np.inf if least == _LOWEST else reach(float(least))
        root = len(self.pivot) - 1
        heap = []
        if root >= 0:
            away = float(np.linalg.norm(self.pivot[root] - point))
            heap = [(max(0.0, away - self.radius[root]), root, away)]
        while heap:
            low, node, away = heapq.heappop(heap)
            if low > worst:
                break
            entries, stored = self.entries[node], self.parent[node]
            if node >= self.leaves:
                children = entries[np.abs(away - stored) - self.radius[entries] <= worst]
                aways = np.linalg.norm(self.pivot[children] - point, axis=1)
                for c, a, r in zip(children.tolist(), aways.tolist(), self.radius[children].tolist(), strict=True):
                    if a - r <= worst:
                        heapq.heappush(heap, (max(0.0, a - r), c, a))
                continue
            near = np.abs(away - stored) <= worst
            span = slice(entries[0], entries[-1] + 1)
            there, x = (self.ids[span], self.x[span]) if near.all() else (self.ids[span][near], self.x[span][near])
            scored += len(there)
            found = x @ asked
            good = (found >= (scores[-1] if len(scores) == k else least)) & (there != own)
            if good.any():
                ids, scores = np.concatenate([ids, there[good]]), np.concatenate([scores, found[good]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(scores) == k:
                    worst = min(worst, reach(float(scores[-1])))
        return ids, scores.astype(np.int64), scored


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): vectors as arrays of ``floor(scale * x)``; null ids and vectors, and those with a null, NaN or infinite component, go."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of ``width``, shorter ones filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) for each run of equal numbers in the first column: one run is held at a time."""
    number, held = None, []
    for batch in batches:
        here = batch.column(0).to_numpy()
        cuts = [0, *(np.nonzero(here[1:] != here[:-1])[0] + 1).tolist(), len(here)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and here[a] != number:
                yield number, pa.Table.from_batches(held)
                held = []
            number = int(here[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield number, pa.Table.from_batches(held)


class Regions:
    """Pivots of a sample of vectors in the space with one more component."""

    def __init__(self, sample: np.ndarray, top: int) -> None:
        self.top = float(top)
        self.pivot = self._lifted(sample)

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.top - (x.astype(np.float64) ** 2).sum(axis=1)))]).astype(np.float64)

    def _apart(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(axis=1)[:, None] + (self.pivot**2).sum(axis=1) - 2 * points @ self.pivot.T
        return np.sqrt(np.maximum(0.0, square))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The region of each vector and its distance from the pivot."""
        apart = self._apart(self._lifted(x))
        region = apart.argmin(axis=1)
        return region, apart[np.arange(len(x)), region]

    def within_reach(self, q: np.ndarray, least: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(query, region): whether a vector of the region can have a score of ``least`` or more."""
        square = (q.astype(np.float64) ** 2).sum(axis=1)
        low = np.maximum(0.0, self._apart(np.column_stack([q, np.zeros(len(q))])) - radius)
        most = (square[:, None] + self.top - low**2) / 2
        return most * (1 + _SLACK) + 1 + np.abs(self.top) * _SLACK >= least[:, None].astype(np.float64)


def with_trees(trees: DataFrame, targets: DataFrame, groups: int, tasks: int) -> DataFrame:
    """(group, part, tree, first, last, own, id, v, least): queries and, for each part of a group's queries, the trees of its blocks.

    A group has a part for each QUERIES queries; where there are fewer parts than ``tasks``, one for each FEW.
    """
    many = targets.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    spare = F.least(F.ceil(F.col("n") / FEW), F.lit(-(-tasks // groups)))
    parts = write_table(many.select("group", F.greatest(F.ceil(F.col("n") / QUERIES), spare).cast("int").alias("parts")), "parts")
    asked = targets.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")).drop("parts").withColumn("tree", F.lit(None).cast("binary"))
    laid = trees.withColumn("group", F.floor(F.col("block") / GROUP).cast("int")).join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    laid = laid.select("group", "part", "tree", F.col("block").alias("first"), F.col("block").alias("last"), none("int").alias("own"), none("long").alias("id"), F.expr("cast(array() as array<bigint>)").alias("v"), none("long").alias("least"))
    return laid.unionByName(asked)


def searched(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, vec_id, score, scored): what the searched blocks give each query, k rows of each at most.

    A row without a vec_id tells how many vectors a block's search scored.
    """
    session = vectors.sparkSession
    n = spread(session)
    # Numbers of rows, written with them, deal large regions into blocks: an id that many rows repeat is spread out.
    base = quantised(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id())
    base = write_table(base.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)), "vectors")
    total, width, top = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max("norm"), F.lit(0))).first()
    wanted = max(1, min(REGIONS, -(-total // BLOCK)))
    # A sample by the hash of the row's number, four times as large as wanted so that vectors that repeat leave enough.
    sample = base.orderBy(F.xxhash64("row"), "row").limit(4 * wanted).select("v").toArrow().column("v").combine_chunks()
    lists = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
    first = np.unique(_matrix(lists, width), axis=0, return_index=True)[1] if len(lists) else np.zeros(0, dtype=np.int64)
    pivots = _matrix(lists, width)[np.sort(first)[:wanted]] if len(lists) else np.zeros((1, width), dtype=np.int64)
    regions = session.sparkContext.broadcast(Regions(pivots, top))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, away = regions.value.nearest(_matrix(batch.column(1), width)) if len(batch) else (np.zeros(0, dtype=np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "region", "away"])

    dealt = write_table(base.select("id", "v", "row").mapInArrow(deal, "id long, v array<long>, row long, region int, away double"), "regions")
    known = dealt.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).orderBy("region").collect()  # a row per region
    radius = np.full(len(pivots), -np.inf)
    parts, start = np.zeros(len(pivots), dtype=np.int64), 0
    places = []
    for r in known:
        radius[r.region], parts[r.region] = r.radius, -(-r.n // BLOCK)
        places.append((r.region, start, int(parts[r.region])))
        start += int(parts[r.region])
    place = F.broadcast(session.createDataFrame(places, "region int, start int, parts int"))
    blocks = max(1, start)
    dealt = dealt.join(place, "region").withColumn("block", (F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts").cast("long"))).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _runs(batches):
            ids, lists = rows.column("id").to_numpy(), rows.column("v").combine_chunks()
            order = np.argsort(rows.column("row").to_numpy(), kind="stable")  # a task that runs again builds the same tree
            made = MTree(ids[order], _matrix(lists, width)[order])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pickle.dumps(made)], pa.binary())], names=["block", "tree"])

    built = dealt.select("block", "id", "v", "row").repartition(min(blocks, 4 * n), "block").sortWithinPartitions("block").mapInArrow(build, "block int, tree binary")
    trees = write_table(built, "trees")
    own = dealt.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "block")).alias("q"))
    queries = write_table(own.select("id", "q.v", "q.block"), "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, here = {}, None
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, dtype=np.int64)] for _ in range(4)]
            whole = _matrix(batch.column("v"), width)
            for i, (g, part, blob, first, last, own, q, least) in enumerate(zip(*(batch.column(c) for c in ("group", "part", "tree", "first", "last", "own", "id", "least")), strict=True)):
                if (g, part) != here:
                    held, here = {}, (g, part)
                if blob.is_valid:
                    held[first.as_py()] = pickle.loads(blob.as_py())
                    continue
                ids, scores, scored, worst, own = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0, least.as_py(), own.as_py()
                for block in range(first.as_py(), last.as_py() + 1):
                    if block == own:
                        continue
                    more, theirs, n_scored = held[block].search(q.as_py(), whole[i], k, worst)
                    ids, scores, scored = np.concatenate([ids, more]), np.concatenate([scores, theirs]), scored + n_scored
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    if len(scores) == k:
                        worst = max(worst, int(scores[-1]))
                row = np.full(len(ids) + 1, q.as_py()), np.append(ids, _LOWEST), np.append(scores, 0), np.append(np.zeros(len(ids), dtype=np.int64), -1 - scored)
                for kept, x in zip(out, row, strict=True):
                    kept.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score", "scored"])

    def ask(targets: DataFrame) -> DataFrame:
        """Search for each query (id, v, least) the blocks from first to last, which lie in one group, but its own."""
        met = with_trees(trees, targets, -(-blocks // GROUP), n)
        ordered = met.repartition(4 * n, "group", "part").sortWithinPartitions("group", "part", F.col("tree").isNull(), "first", "id")
        found = ordered.mapInArrow(search, "query_id long, vec_id long, score long, scored long")
        return found.select("query_id", F.when(F.col("scored") == 0, F.col("vec_id")).alias("vec_id"), "score", F.when(F.col("scored") < 0, -1 - F.col("scored")).otherwise(0).alias("scored"))

    at_home = queries.select(F.floor(F.col("block") / GROUP).cast("int").alias("group"), F.col("block").alias("first"), F.col("block").alias("last"), F.lit(-1).alias("own"), "id", "v", F.lit(_LOWEST).alias("least"))
    near = write_table(ask(at_home), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    told = near.where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = regions.value.within_reach(_matrix(batch.column(1), width), batch.column(3).to_numpy(), radius)
            targets = pa.array([np.nonzero(x)[0].astype(np.int32) for x in reach], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, targets], names=[*batch.schema.names, "targets"])

    bounded = queries.join(told, "id", "left").select("id", "v", "block", F.coalesce("least", F.lit(_LOWEST)).alias("least"))
    aimed = bounded.mapInArrow(aim, "id long, v array<long>, block int, least long, targets array<int>")
    rest = aimed.select("id", "v", "least", F.col("block").alias("own"), F.explode("targets").alias("region")).join(place, "region")
    end = F.col("start") + F.col("parts") - 1
    rest = rest.withColumn("group", F.explode(F.sequence(F.floor(F.col("start") / GROUP).cast("int"), F.floor(end / GROUP).cast("int"))))
    first, last = F.greatest(F.col("start"), F.col("group") * GROUP), F.least(end, F.col("group") * GROUP + GROUP - 1)
    rest = rest.select("group", first.alias("first"), last.alias("last"), "own", "id", "v", "least").where("first <> last or first <> own")
    return near.unionByName(ask(rest))


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row whose id is divisible by ``every``.

    All other rows are candidates; ties go to the smaller id.  Shorter vectors count as filled up with
    zeros.  A row that repeats a query's id is the query's own and no candidate for it; repeated ids
    among candidates count each, a repeated query id is searched once, with its smallest vector.  Other
    columns are left.

    Vectors are shuffled to their blocks once, and queries to the blocks that can hold better scores than
    they have found at home.
    """
    found = searched(vectors, every, k, id_col, vector_col, scale).where("vec_id is not null")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH sound AS (
  SELECT vec_id AS id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.id AS query_id, x.id AS vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM sound q JOIN sound x ON q.id % 20 = 0 AND x.id <> q.id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
