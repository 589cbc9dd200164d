"""Sum-of-squares packing of token sequences into windows.

Each task packs the documents of its partition online.  A document's full windows stand alone; its
rest goes to the fill level that makes the sum of squared counts of partly filled windows least,
read from an array of counts by level.  At most ``OPEN`` windows are open: where one more would be
opened, the piece is cut instead, into the level of which most windows are open among those that it
fills.  At the end of the partition the few open windows are topped up with cuts of the emptiest
ones, and the last one is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import row_slices
from pulsegrid.llm.tokens import byte_encoder

#: Ids in a window; windows that a task holds open.
WINDOW, OPEN = 1024, 64
#: Sequences that one partition can number.
_PER_PARTITION = 1 << 36


class Packer:
    """Sum-of-squares online packing.  A piece is (key, start, ids as bytes); ``closed`` gets (sequence, pieces)."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN) -> None:
        self.window, self.most_open, self.open = window, most_open, 0
        self.count = np.zeros(window + 1, dtype=np.int64)  # of open windows by fill level
        self._open: list[list[list]] = [[] for _ in range(window)]
        self.closed: list[list] = []

    def level_for(self, size: int) -> int:
        """The level whose window takes a piece of ``size``; 0 for a new window.  Ties go to the fullest."""
        room = self.window - size
        had, then = self.count[1 : room + 1], self.count[1 + size : self.window + 1]
        change = 2 * (then - had) + 2
        if room:
            change[-1] = 1 - 2 * had[-1]
        change[had == 0] = np.iinfo(np.int64).max
        best = room - int(np.argmin(change[::-1])) if room else 0
        found = bool(room and self.count[best])
        if self.open >= self.most_open:  # a new window is no choice
            return best if found else 0
        return best if found and change[best - 1] <= 2 * self.count[size] + 1 else 0

    def level_to_fill(self, size: int) -> int:
        """The level of most open windows of those that a piece larger than their room fills; 0 if there is none."""
        low = self.window - size + 1
        counts = self.count[low : self.window]
        best = self.window - 1 - int(np.argmax(counts[::-1])) if len(counts) else 0
        return best if best and self.count[best] else 0

    def add(self, key: object, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.closed.append([(key, at, ids[4 * at : 4 * (at + self.window)])])
            at += self.window
        if total > at:
            self._place((key, at, ids[4 * at :]))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        level = self.level_for(size)
        if not level and self.open >= self.most_open and (level := self.level_to_fill(size)):
            key, start, ids = piece
            room = self.window - level
            self._put((key, start, ids[: 4 * room]), room, level)
            self._place((key, start + room, ids[4 * room :]))
            return
        self._put(piece, size, level)

    def _put(self, piece: tuple, size: int, level: int) -> None:
        window = self._open[level].pop() if level else []
        window.append(piece)
        if level:
            self.count[level] -= 1
            self.open -= 1
        if level + size == self.window:
            self.closed.append(window)
        else:
            self.count[level + size] += 1
            self._open[level + size].append(window)
            self.open += 1

    def finish(self) -> None:
        """Close what is open, with at most one window that isn't full or a power of two: none."""
        stock = [p for level in range(self.window - 1, 0, -1) for w in self._open[level] for p in w]
        self._open, self.count[:], self.open = [[] for _ in range(self.window)], 0, 0
        row: list = []
        room = self.window
        for key, start, ids in stock:
            at = 0
            while at < len(ids) // 4:
                take = min(room, len(ids) // 4 - at)
                row.append((key, start + at, ids[4 * at : 4 * (at + take)]))
                at, room = at + take, room - take
                if not room:
                    self.closed.append(row)
                    row, room = [], self.window
        left = self.window - room
        for bit in reversed(range(left.bit_length())):
            if not left >> bit & 1:
                continue
            part, need = [], 1 << bit
            while need:
                key, start, ids = row.pop(0)
                take = min(need, len(ids) // 4)
                part.append((key, start, ids[: 4 * take]))
                need -= take
                if 4 * take < len(ids):
                    row.insert(0, (key, start + take, ids[4 * take :]))
            self.closed.append(part)


_PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id and offset; with ``with_ids`` also ids (binary).

    A document is its text's ids and then ``end_id``; a null text is empty, so every row gives at
    least one id.  Rows that repeat or lack an id are packed each.  Other columns are left.  The plan
    is a map: partitions are packed on their own, sequences are numbered by partition, and a task
    that runs again gives the same rows.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, t) for n, t in _PIECE] + [T.StructField("ids", T.BinaryType())] * with_ids
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, number = byte_encoder(tokenizer_file, ranks_file, pattern), Packer(window), TaskContext.get().partitionId() * _PER_PARTITION
        kind = None

        def told() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for pieces in packer.closed:
                at = 0
                for (key, tokens), start, ids in pieces:
                    n = len(ids) // 4
                    rows.append((key, start, n, zlib.crc32(ids), tokens, number, at, *[ids] * with_ids))
                    at += n
                number += 1
            packer.closed.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            kinds = [kind, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.name for f in fields])

        for batch in batches:
            kind = batch.column(0).type
            for part in row_slices(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = encode((text.as_py() or b"").decode("utf-8", "replace")) + end
                    packer.add((key, len(ids) // 4), ids)
                yield told()
        if kind is not None:
            packer.finish()
            yield told()

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, T.StructType(fields))
