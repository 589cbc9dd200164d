"""Word-level BPE with a minimal acyclic transducer as lexicon.

The corpus' frequent words are counted over all documents and compiled into an automaton that shares
prefixes and suffixes; additive outputs on its arcs give each word's number, and by it the word's
ids.  Processes map the file into memory.  Words that it lacks are merged by rank, exactly.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import row_slices, write_table
from pulsegrid.llm.tokens import u32

#: Words in the lexicon at most; chunks that a process keeps in each of two generations; different chunks that a
#: task counts at once; bytes of text that are encoded together.
LEXICON, CHUNKS, COUNTED, TOGETHER = 65_536, 120_000, 150_000, 1 << 20
#: Bytes of words that are merged together; longer ones are merged each.
_WIDTHS = (8, 16, 32, 64)
#: Classes of counts for each doubling, by which the lexicon's least count is found.
_CLASSES = 64
_BITS, _NONE = 20, 1 << 62
_LOW = (1 << _BITS) - 1
#: Characters that Python splits at, but the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: The tokenizer's words in a lower-case ASCII text without white space.
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    """The parts of a tokenizer file that encoding and decoding need."""

    def __init__(self, tokenizer_file: str) -> None:
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", r"\p{White_Space}"))
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        letters = byte_letters()
        self._inner = [self.vocab.get(x) for x in letters]  # the id of each byte within a word, and at its end
        self._final = [self.vocab.get(x + self.suffix) for x in letters]
        self._merge: dict[tuple[int, int], int] = {}  # rank and, in the low bits, the merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._merge.setdefault((self.vocab[a], self.vocab[b]), rank << _BITS | self.vocab[a + b])
        pairs = sorted((a << _BITS | b, v) for (a, b), v in self._merge.items())
        self._pairs, self._ranks = (np.array([x[i] for x in pairs], dtype=np.int64) for i in (0, 1))

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter: no final sigma."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def words_of(self, chunk: str) -> list[str]:
        """The words of a text without white space; ASCII has a shorter way to the same."""
        if chunk.isascii():
            low = chunk.lower()
            return [low] if low.isalpha() else _ASCII.findall(low)
        return self.words.findall(self.normal(chunk))

    def merge(self, word: str) -> list[int]:
        """The ids of one word: the pair of the lowest rank, leftmost first, until none is left."""
        data, inner = word.encode("utf-8", "surrogatepass"), self._inner
        ids = [x for x in [inner[b] for b in data[:-1]] + [self._final[data[-1]]] if x is not None]
        if len(ids) > 256:
            return self._merge_long(ids)
        get = self._merge.get
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            ids[i] = best & _LOW
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NONE)
        return ids

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair; ``_NONE`` where there is none, or no right part (-1)."""
        key = a.astype(np.int64) << _BITS | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where((b >= 0) & (self._pairs[at] == key), self._ranks[at], _NONE)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers: ``merge`` for many words at once."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(d) for d in data], dtype=np.int64)
        out: list[bytes] = [b""] * len(data)
        whole = None not in self._inner and None not in self._final
        for i in np.nonzero((size > _WIDTHS[-1]) | (not whole))[0].tolist():
            out[i] = u32(self.merge(words[i]))
        low = 0
        for width in _WIDTHS if whole else ():
            group = np.nonzero((size > low) & (size <= width))[0]
            low = width
            if len(group):
                letters = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in group.tolist()), dtype=np.uint8).reshape(-1, width)
                self._merge_rows(letters, size[group], group, out)
        return out

    def _merge_rows(self, letters: np.ndarray, size: np.ndarray, place: np.ndarray, out: list[bytes]) -> None:
        width, column = letters.shape[1], np.arange(letters.shape[1])
        inner, final = np.array(self._inner, dtype=np.int32), np.array(self._final, dtype=np.int32)
        ids = np.where(column < size[:, None] - 1, inner[letters], np.where(column == size[:, None] - 1, final[letters], -1)).astype(np.int32)
        ranks = np.full(ids.shape, _NONE, dtype=np.int64)  # of each id with the next one
        ranks[:, :-1] = self._rank_of(ids[:, :-1], ids[:, 1:])
        while len(ids):
            best = ranks.argmin(axis=1)  # the leftmost of equal ranks
            value = ranks[np.arange(len(ids)), best]
            done = value == _NONE
            if done.any():
                held = ids[done]
                kept = held >= 0
                flat, ends = held[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)).tolist()
                for i, a, b in zip(place[done].tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[4 * a : 4 * b]
                ids, ranks, place, best, value = (x[~done] for x in (ids, ranks, place, best, value))
                if not len(ids):
                    return
            row, spot = np.arange(len(ids)), best[:, None]
            # The right part goes: what follows it moves one to the left.
            ids = np.take_along_axis(ids, np.minimum(column + (column > spot), width - 1), axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(column + (column > spot), width - 1), axis=1)
            ids[:, -1], ranks[:, -1] = -1, _NONE
            ids[row, best] = value & _LOW
            ranks[row, best] = self._rank_of(ids[row, best], np.where(best + 1 < width, ids[row, np.minimum(best + 1, width - 1)], -1))
            left = np.nonzero(best > 0)[0]
            ranks[left, best[left] - 1] = self._rank_of(ids[left, best[left] - 1], ids[left, best[left]])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words in which shifting lists would add up."""
        n, get = len(ids), self._merge.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(get(p), i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self._merge]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = best & _LOW, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (p := (ids[x], ids[after[x]])) in self._merge:
                    heapq.heappush(heap, (get(p), x, p))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """As the library does where a file names no decoder: the tokens, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """A minimal acyclic transducer from words (UTF-8) to ids, as one block of bytes.

    Words go in sorted order; whenever a branch is finished, its nodes are replaced by equal ones that
    were met before.  An arc's output is the count of words that sort before it at its node, so that
    the outputs of a path and the final nodes on it add up to the word's place.
    """
    listed = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in words.items())
    met: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in met:
            met[key] = len(nodes)
            nodes.append(key)
        return met[key]

    path: list[list] = [[False, []]]  # of the word last added: final, arcs that are settled
    last = b""
    for word, _ in [*listed, (b"", None)]:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            done = settle(*path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in word[same:]]
        if word:
            path[-1][0] = True
        last = word
    root = settle(*path[0])
    below = [0] * len(nodes)
    for i, (final, arcs) in enumerate(nodes):  # a node's targets were settled before it
        below[i] = final + sum(below[to] for _, to in arcs)
    first, labels, target, skip = [0], bytearray(), [], []
    for final, arcs in nodes:
        passed = int(final)
        for label, to in arcs:
            labels.append(label)
            target.append(to)
            skip.append(passed)
            passed += below[to]
        first.append(len(labels))
    starts = np.cumsum([0, *(len(ids) for _, ids in listed)])
    parts = [np.array(x, dtype="<i4").tobytes() for x in (first, target, skip, [f for f, _ in nodes], starts, [i for _, ids in listed for i in ids])]
    sizes = [len(p) // 4 for p in parts] + [len(labels), root]
    return np.array([*sizes, 0, 0], dtype="<i4")[:8].tobytes() + b"".join(parts) + bytes(labels)


class Lexicon:
    """A compiled lexicon, mapped from a file that goes when the mapping does.

    The file is one of the process' own folder: every process makes it again from the broadcast, so
    none is looked for on another machine.
    """

    def __init__(self, block: bytes) -> None:
        f, path = tempfile.mkstemp(suffix=".lexicon")
        try:
            os.write(f, block)
            self._map = mmap.mmap(f, len(block), access=mmap.ACCESS_READ)
        finally:
            os.close(f)
            os.unlink(path)
        head = np.frombuffer(self._map, "<i4", 8)
        self._root, at, views = int(head[7]), 32, []
        for n in head[:6].tolist():
            views.append(np.frombuffer(self._map, "<i4", n, at))
            at += 4 * n
        first, self._target, self._skip, self._final, self._starts, self._ids = views
        labels = np.frombuffer(self._map, np.uint8, int(head[6]), at)
        # A node's arcs are in the order of their labels, so node and label together are sorted.
        self._arcs = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) << 8 | labels

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian unsigned 32-bit integers, null for a word that it lacks: one step of all words at a time."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        data, begin = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(size) - size
        node, place = np.full(len(words), self._root, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        found, step = np.zeros(len(words), dtype=bool), 0
        live = np.arange(len(words)) if len(self._arcs) else np.arange(0)
        while len(live):
            ended = size[live] == step
            found[live[ended]] = self._final[node[live[ended]]] != 0
            live = live[~ended]
            key = node[live] << 8 | data[begin[live] + step]
            arc = np.minimum(np.searchsorted(self._arcs, key), len(self._arcs) - 1)
            there = self._arcs[arc] == key
            live, arc = live[there], arc[there]
            place[live] += self._skip[arc]
            node[live] = self._target[arc]
            step += 1
        out: list[bytes | None] = [None] * len(words)
        hit = np.nonzero(found)[0]
        for i, a, b in zip(hit.tolist(), self._starts[place[hit]].tolist(), self._starts[place[hit] + 1].tolist(), strict=True):
            out[i] = self._ids[a:b].tobytes()
        return out


class Encoder:
    """Ids and decoded text of whole texts; keeps the ids of the chunks between white space that it met lately."""

    def __init__(self, bpe: Bpe, lexicon: bytes) -> None:
        self._bpe, self._lexicon = bpe, Lexicon(lexicon)
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _of_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words: those of the lexicon, and merges for the others."""
        found = dict(zip(words, self._lexicon.get_all([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        unseen = [w for w, ids in found.items() if ids is None]
        found.update(zip(unseen, self._bpe.merge_all(unseen), strict=True))
        return found

    def _learn(self, chunks: set[str]) -> None:
        if len(self._chunks) > CHUNKS:
            self._older, self._chunks = self._chunks, {}
        kept, older = self._chunks, self._older
        fresh = []
        for c in chunks:
            if c not in kept:
                ids = older.get(c)
                if ids is None:
                    fresh.append(c)
                else:
                    kept[c] = ids
        split = [self._bpe.words_of(c) for c in fresh]
        ids = self._of_words(list(dict.fromkeys(chain.from_iterable(split))))
        for c, words in zip(fresh, split, strict=True):
            kept[c] = ids[words[0]] if len(words) == 1 else b"".join(map(ids.__getitem__, words))

    def _parts(self, text: str) -> list[list[str] | bytes]:
        """Chunks, and ids where a part has no chunks: a special token, or white space that only the tokenizer doesn't split at."""
        bpe, out = self._bpe, []
        for part in bpe.split.split(text) if bpe.split and any(s in text for s in bpe.special) else [text]:
            if part in bpe.special:
                out.append(u32([bpe.special[part]]))
            elif _ODD.search(part):
                words = bpe.words.findall(bpe.normal(bpe.spaces.sub(" ", part)))
                ids = self._of_words(list(dict.fromkeys(words)))
                out.append(b"".join(map(ids.__getitem__, words)))
            else:
                out.append(part.split())
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        split = [self._parts(t) for t in texts]
        self._learn(set(chain.from_iterable(p for parts in split for p in parts if isinstance(p, list))))
        kept, out = self._chunks.__getitem__, []
        for parts in split:
            ids = b"".join(p if isinstance(p, bytes) else b"".join(map(kept, p)) for p in parts)
            out.append((ids, self._bpe.decode(np.frombuffer(ids, "<u4").tolist())))
        return out

    def __call__(self, text: str) -> tuple[bytes, str]:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def _bpe(tokenizer_file: str) -> Bpe:
    """Once in each Python process."""
    return Bpe(tokenizer_file)


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str, lexicon: bytes) -> Encoder:
    """Once in each Python process: the next task goes on with the same chunks."""
    return Encoder(_bpe(tokenizer_file), lexicon)


def count_words(docs: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """(word, n): how often all documents have each word.  A task adds up ``COUNTED`` different chunks before it sends words on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, held = _bpe(tokenizer_file).words_of, Counter()

        def told() -> pa.RecordBatch:
            words: dict[str, int] = {}
            for chunk, n in held.items():
                for word in words_of(chunk):
                    words[word] = words.get(word, 0) + n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update((text.as_py() or b"").decode("utf-8", "replace").split())
                if len(held) > COUNTED:
                    yield told()
        yield told()

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, tokenizer_file: str, text_col: str = "text", most: int = LEXICON) -> DataFrame:
    """(word, n): the corpus' most frequent words, ``most`` at most: all from some count on, so no two of equal counts are told apart.

    Which words are in the lexicon decides no id.  The driver gets one number for each class of counts,
    64 for each doubling.
    """
    class_ = F.floor(F.log2("n") * _CLASSES).cast("int")
    counted = write_table(count_words(docs, tokenizer_file, text_col).where("word <> ''"), "words")
    left, least = most, 0
    for r in sorted(counted.groupBy(class_.alias("c")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        left -= r.words
        if left < 0:
            least = r.c + 1
            break
    return counted.where(class_ >= least)


def lexicon_for(docs: DataFrame, tokenizer_file: str, text_col: str = "text", most: int = LEXICON) -> bytes:
    """The compiled lexicon of ``frequent_words``, a few MB at most: ``most`` bounds it."""
    bpe = Bpe(tokenizer_file)
    found = frequent_words(docs, tokenizer_file, text_col, most).toArrow().column("word").to_pylist()
    return compile_lexicon({w: bpe.merge(w) for w in found})


def encode_texts(docs: DataFrame, tokenizer_file: str, text_col: str = "text", most: int = LEXICON) -> DataFrame:
    """``docs`` with ids (binary, little-endian unsigned 32-bit) and decoded (the ids' text).

    A null or empty text has no ids and decodes to an empty text.  Special tokens in a text get their
    ids, as in the library.  Two passes over the texts, no shuffle of them; columns named ids or
    decoded are replaced.
    """
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    place = keep.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon_for(docs, tokenizer_file, text_col, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_file, sent.value).encode_all
        for batch in batches:
            for part in row_slices(batch, place, TOGETHER):
                done = encode([(t.as_py() or b"").decode("utf-8", "replace") for t in part.column(place).cast(pa.binary())])
                columns = [*part.columns, pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "ids", "decoded"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(*keep).mapInArrow(run, schema)


def token_digest(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: token count and the digests of ids and decoded text."""
    out = encode_texts(docs.select(F.col(id_col), F.col(text_col)), tokenizer_file, text_col)
    return out.select(id_col, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
