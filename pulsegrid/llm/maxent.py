"""Language-model scores of documents by a hashed maximum-entropy model.

The model knows the corpus' most frequent words, an end and a symbol for all others; what a symbol for others
stands for is told by counts of every word of the training documents.  Words lie in classes, and
P(word | history) = P(class | history) P(word | class, history).  Both are softmaxes over sums of weight rows:
features of the history (the last word, the last two, the one before the last) are hashed to rows of one
table for classes and one for the words of a class.

Training goes in rounds over shares of the documents, so that each is learned from once.  A task takes
adaptive gradient steps from the round's weights over the distinct events of its documents and returns
the rows that it has changed; changes are averaged by how much each task has seen of a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import row_slices, spread, write_table

#: Symbols of the model: END, OTHER, and words with LEAST occurrences or more; classes and members of each.
VOCAB, CLASSES, MEMBERS, LEAST = 4096, 64, 64, 3
END, OTHER = 0, 1
#: Rows of weights that features are hashed to, in each of the two tables.
ROWS = 1 << 14
#: Words whose counts are broadcast, of at most LONGEST bytes each (33 MB at the very most); those of all others meet their counts in a join.
LEXICON, LONGEST = 1 << 17, 256
#: Classes of counts for each doubling, by which the lexicon's least count is found.
_CLASSES = 64
#: Different words that a counting task holds.
COUNTED = 1 << 18
#: Tokens whose events are made distinct together, in learning and in scoring; events in a gradient step and in a batch of scores.
LEARNED, CHUNK, STEP, BATCH = 1 << 19, 1 << 21, 1024, 8192
#: Shares of the training documents, one learned from after the other, and tokens that a task learns from in a round.
ROUNDS, TASK_TOKENS = 4, 4_000_000
RATE = 0.2
_LOG10 = 1 / np.log(10)


def words_of(text: bytes) -> list[bytes]:
    """Words between the six white characters, A-Z in lower case."""
    return text.lower().split()


def _mix(a: np.ndarray, b: np.ndarray | int, seed: int) -> np.ndarray:
    """Rows that the pairs are hashed to."""
    x = (a.astype(np.uint64) << np.uint64(20)) + np.asarray(b, dtype=np.uint64) + np.uint64(seed << 40)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % ROWS


def class_rows(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows of the class table: the bias, the last word, the last two, and the one before the last."""
    return np.stack([np.full(len(last), ROWS), _mix(last, 0, 1), _mix(last, before, 2), _mix(before, 0, 3)], axis=1)


def word_rows(class_: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows of the word table: the class' bias, the last word and the one before the last in the class."""
    return np.stack([ROWS + class_, _mix(last, class_, 4), _mix(before, class_, 5)], axis=1)


def _normal(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities: the softmax of the sums of each line's rows."""
    x = table[rows[:, 0]]
    for i in range(1, rows.shape[1]):
        x += table[rows[:, i]]
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


class Weights:
    """Both tables, for each row the squares of its gradients so far and, in training, how much was seen of it."""

    def __init__(self, classes: np.ndarray, words: np.ndarray, squares: tuple[np.ndarray, np.ndarray]) -> None:
        self.tables, self.squares = (classes, words), squares
        self.seen = tuple(np.zeros(len(t), dtype=np.float32) for t in self.tables)

    @staticmethod
    def of_counts(counts: np.ndarray) -> Weights:
        """The model without features: smoothed frequencies of the symbols."""
        n = np.zeros(CLASSES * MEMBERS)
        n[: len(counts)] = counts + 1.0
        n = n.reshape(CLASSES, MEMBERS)
        with np.errstate(divide="ignore"):
            own = np.maximum(np.log(n), -30.0)
            whole = np.maximum(np.log(n.sum(axis=1)), -30.0)
        classes, words = np.zeros((ROWS + 1, CLASSES), dtype=np.float32), np.zeros((ROWS + CLASSES, MEMBERS), dtype=np.float32)
        classes[ROWS], words[ROWS:] = whole - whole.max(), own - own.max(axis=1, keepdims=True)
        return Weights(classes, words, (np.zeros(len(classes), dtype=np.float32), np.zeros(len(words), dtype=np.float32)))

    def copy(self) -> Weights:
        return Weights(self.tables[0].copy(), self.tables[1].copy(), (self.squares[0].copy(), self.squares[1].copy()))

    def log_probs(self, events: np.ndarray) -> np.ndarray:
        """Natural log probability of each event's symbol after its history."""
        out = np.empty(len(events))
        for a in range(0, len(events), BATCH):
            word, last, before = parts_of(events[a : a + BATCH])
            class_, member = np.divmod(word, MEMBERS)
            at = np.arange(len(word))
            out[a : a + BATCH] = _normal(self.tables[0], class_rows(last, before))[at, class_].astype(np.float64) + _normal(self.tables[1], word_rows(class_, last, before))[at, member]
        return out

    def _update(self, which: int, rows: np.ndarray, slope: np.ndarray, weight: np.ndarray) -> None:
        """One adaptive gradient step for the rows, whose events have the slopes (already times their weight)."""
        table, squares, seen = self.tables[which], self.squares[which], self.seen[which]
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        line, flat = order // rows.shape[1], flat[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        own, size = flat[first], np.diff(np.append(first, len(flat)))
        sums = slope[line[first]]
        many = np.flatnonzero(size > 1)  # most rows occur once in a step; only the others are summed
        if len(many):
            again = np.repeat(size > 1, size)
            sums[many] = np.add.reduceat(slope[line[again]], np.cumsum(size[many]) - size[many], axis=0)
        squares[own] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        seen[own] += np.add.reduceat(weight[line], first)
        sums *= (RATE / np.sqrt(squares[own] + 1e-6))[:, None]
        table[own] -= sums

    def step(self, events: np.ndarray, weight: np.ndarray) -> None:
        """A gradient step on the events, which count by their weight."""
        word, last, before = parts_of(events)
        class_, member = np.divmod(word, MEMBERS)
        at, weight = np.arange(len(word)), weight.astype(np.float32)
        both = (class_rows(last, before), class_), (word_rows(class_, last, before), member)
        slopes = []
        for table, (rows, goal) in zip(self.tables, both, strict=True):
            slope = np.exp(_normal(table, rows))
            slope[at, goal] -= 1
            slopes.append(slope * weight[:, None])
        for i, (rows, _) in enumerate(both):
            self._update(i, rows, slopes[i], weight)

    def learn(self, events: np.ndarray, weight: np.ndarray, seed: int) -> None:
        """Steps over all the events, in an order that the seed fixes."""
        order = np.random.default_rng(seed).permutation(len(events))
        for a in range(0, len(order), STEP):
            some = order[a : a + STEP]
            self.step(events[some], weight[some])


def parts_of(events: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, last, before) of packed events."""
    return events % VOCAB, events // VOCAB % VOCAB, events // VOCAB**2


def events_of(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The packed event of each token; documents begin at ``starts``, after two ends."""
    ids = ids.astype(np.int64)
    last, before = np.full_like(ids, END), np.full_like(ids, END)
    last[1:], before[2:] = ids[:-1], ids[:-2]
    last[starts], before[starts] = END, END
    second = starts + 1
    before[second[second < len(ids)]] = END
    return (before * VOCAB + last) * VOCAB + ids


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column, none of which is empty, one after the other, and where each document starts."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], dtype="<u2")[offsets[0] // 2 : offsets[-1] // 2], (offsets[:-1] - offsets[0]) // 2


@dataclass
class Lexicon:
    """Counts of the training documents: N, V, and of the words that are broadcast; ``size`` of them are symbols of the model."""

    ranks: dict[bytes, int]
    counts: np.ndarray
    total: int
    different: int
    ends: int
    size: int

    @property
    def others(self) -> tuple[int, int]:
        """Training tokens and different words outside the model's symbols."""
        own = self.counts[: self.size]
        return self.total - self.ends - int(own.sum()), self.different - (self.ends > 0) - self.size

    @property
    def base_floor(self) -> float:
        return float(np.log10(self.total + self.different + 1))

    @property
    def other_floor(self) -> float:
        return float(np.log10(sum(self.others) + 1))

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([[self.ends, self.others[0]], self.counts[: self.size]])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): every word of the column ``text`` (binary), and the ends under the empty word."""

    def told(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held[b""] += len(batch)
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > COUNTED:
                    yield told(held)
                    held.clear()
        yield told(held)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_of(counts: DataFrame) -> Lexicon:
    """The counts' sums, and the most frequent words from some count on, LEXICON at most; the driver gets a number for each class of counts, and them."""
    class_ = F.floor(F.log2("n") * _CLASSES).cast("int")
    short = counts.where((F.col("word") != F.lit(b"")) & (F.octet_length("word") <= LONGEST) & (F.col("n") > 0))
    left, least = LEXICON, 0
    for r in sorted(short.groupBy(class_.alias("c")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        left -= r.words
        if left < 0:
            least = r.c + 1
            break
    found = short.where(class_ >= least).select("word", "n").toArrow()
    words, n = found.column("word").to_pylist(), found.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    total, different, ends = counts.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == F.lit(b""), F.col("n"))), F.lit(0))).first()
    sizes = np.array([n[i] for i in order], dtype=np.int64)
    return Lexicon({words[i]: k for k, i in enumerate(order)}, sizes, total, different, ends, min(VOCAB - 2, int((sizes >= LEAST).sum())))


_ENCODED = "row long, id string, held_out boolean, n_tokens long, n_known long, base double, others double, rare array<struct<word: binary, tf: int>>, ids binary"


def encode(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Documents as symbols of the model: ``ids``, what the broadcast counts tell, and the words that they don't know."""
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        get, size = own.ranks.get, own.size
        logs = np.log10(np.append(own.counts, own.ends) + 1.0)  # the last is the end's
        known_end = int(own.ends > 0)
        for batch in batches:
            for part in row_slices(batch, 3, 4 << 20):
                told: list[tuple] = []
                for text in part.column(3):
                    words = words_of(text.as_py())
                    ranks = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                    listed = ranks[ranks >= 0]
                    rare = list(Counter(w for w, r in zip(words, ranks.tolist(), strict=True) if r < 0).items()) if len(listed) < len(words) else []
                    ids = np.where((ranks >= 0) & (ranks < size), ranks + 2, OTHER)
                    base = logs[listed].sum() + logs[-1] - own.base_floor * (len(listed) + 1)
                    outside = listed[listed >= size]
                    others = logs[outside].sum() - own.other_floor * len(outside)
                    told.append((len(words) + 1, len(listed) + known_end, base, others, [{"word": w, "tf": n} for w, n in rare], np.append(ids, END).astype("<u2").tobytes()))
                n, known, base, others, rare, ids = zip(*told, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(others), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))), pa.array(ids, pa.binary())],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "base", "others", "rare", "ids"],
                )

    return texts.mapInArrow(run, _ENCODED)


def changes(encoded: DataFrame, weights: Weights, share: int, tasks: int) -> DataFrame:
    """(which, row, seen, squares, change): what a round over a share of the training documents makes of the weights, averaged by what each task has seen."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    shape = "which int, row int, seen double, squares double, change binary"

    def told(keys: list, seen: list, squares: list, change: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k // (2 * ROWS) for k in keys], pa.int32()), pa.array([k % (2 * ROWS) for k in keys], pa.int32()), pa.array(seen, pa.float64()), pa.array(squares, pa.float64()), pa.array(change, pa.binary())], names=["which", "row", "seen", "squares", "change"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk = None, 0
        held: list[np.ndarray] = []

        def take() -> None:
            nonlocal own, chunk
            own = own or sent.value.copy()
            distinct, n = np.unique(np.concatenate(held), return_counts=True)
            own.learn(distinct, n, chunk)
            chunk += 1
            held.clear()

        for batch in batches:
            for part in row_slices(batch, 0):
                events = events_of(*_joined(part.column(0)))
                for a in range(0, len(events), LEARNED):
                    held.append(events[a : a + LEARNED])
                    if sum(map(len, held)) >= LEARNED:
                        take()
        if held:
            take()
        if own is not None:
            for which in (0, 1):
                rows = np.nonzero(own.seen[which])[0]
                before = sent.value
                change = (own.tables[which][rows] - before.tables[which][rows]).astype(np.float32)
                yield told([2 * ROWS * which + r for r in rows.tolist()], own.seen[which][rows], own.squares[which][rows] - before.squares[which][rows], [c.tobytes() for c in change])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seen, squares, change = None, 0.0, 0.0, np.zeros(0)
        for batch in batches:
            out: list[tuple] = []
            for w, r, s, q, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                key = 2 * ROWS * w + r
                if key != here:
                    if here is not None:
                        out.append((here, seen, squares, (change / seen).astype("<f4").tobytes()))
                    here, seen, squares, change = key, 0.0, 0.0, np.zeros(len(c) // 4)
                seen, squares, change = seen + s, squares + q, change + s * np.frombuffer(c, "<f4")
            if out:
                yield told(*map(list, zip(*out, strict=True)))
        if here is not None:
            yield told([here], [seen], [squares], [(change / seen).astype("<f4").tobytes()])

    mine = encoded.where(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == share)).select("ids")
    found = mine.coalesce(tasks).mapInArrow(learn, shape)
    return found.repartition(spread(encoded.sparkSession), "which", "row").sortWithinPartitions("which", "row", "seen").mapInArrow(merge, shape)


def train(encoded: DataFrame, lexicon: Lexicon) -> Weights:
    """Weights after all rounds.  The driver gets the rows of two tables, as large for any corpus (8 MB)."""
    weights = Weights.of_counts(lexicon.symbol_counts())
    for share in range(ROUNDS):
        rows = changes(encoded, weights, share, -(-lexicon.total // (ROUNDS * TASK_TOKENS)) or 1).toArrow()
        which, row = rows.column("which").to_numpy(), rows.column("row").to_numpy()
        for w, width in ((0, CLASSES), (1, MEMBERS)):
            own = np.nonzero(which == w)[0]
            if len(own):
                weights.tables[w][row[own]] += np.frombuffer(b"".join(rows.column("change").take(own).to_pylist()), "<f4").reshape(-1, width)
                weights.squares[w][row[own]] += rows.column("squares").to_numpy()[own].astype(np.float32)
    return weights


def model_scores(encoded: DataFrame, weights: Weights) -> DataFrame:
    """(row, model): log10 probability of each document's symbols."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                ids, starts = _joined(part.column(1))
                events = events_of(ids, starts)
                logs = np.empty(len(events))
                for a in range(0, len(events), CHUNK):
                    distinct, which = np.unique(events[a : a + CHUNK], return_inverse=True)
                    logs[a : a + CHUNK] = sent.value.log_probs(distinct)[which]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.add.reduceat(logs, starts) * _LOG10)], names=["row", "model"])

    return encoded.select("row", "ids").mapInArrow(run, "row long, model double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): every document, by what the training documents teach.

    ``base_score`` is the add-one unigram model's, ``score`` the maximum-entropy model's log10 probability of the
    whole text.  Held out are ids whose CRC-32 as text leaves ``held`` modulo ``folds``; a null id counts as an
    empty text.  A null or empty text is an end alone.  Rows that repeat an id count and are scored each.  If
    there are no training documents, N and V are 0.  An empty table gives no rows; other columns are left.
    """
    spark: SparkSession = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), (fold == held).alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    counts = write_table(count_words(texts.where("not held_out")), "words")
    lexicon = lexicon_of(counts)
    encoded = write_table(encode(texts, lexicon), "symbols")
    scored = write_table(model_scores(encoded, train(encoded, lexicon)), "scores")

    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf").join(counts, "word", "left")
    seen = F.coalesce("n", F.lit(0))
    log = F.log10(seen + F.lit(1.0))
    rest = rare.groupBy("row").agg(
        F.sum(F.when(seen > 0, F.col("tf")).otherwise(0)).alias("rare_known"), F.sum(F.col("tf") * (log - lexicon.base_floor)).alias("rare_base"), F.sum(F.col("tf") * (log - lexicon.other_floor)).alias("rare_others")
    )
    told = encoded.drop("ids", "rare").join(scored, "row").join(rest, "row", "left")
    kind = docs.schema[id_col].dataType
    return told.select(
        F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("model") + F.col("others") + F.coalesce("rare_others", F.lit(0.0))).alias("score"),
    )
