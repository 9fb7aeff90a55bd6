"""Sum-of-squares online packing of token sequences into windows.

Each task packs the documents of its input split as they come. A document's whole windows stand alone; what is
left of it goes to the fill level where the sum of the squared counts of partially filled windows, kept in an
array by level, is least (Csirik et al., 2006). At the end of a task so many of the fullest open windows stay as they
are as all open ones fill; the emptier ones are cut to fill them up, and what then is left into lengths that are
powers of two. No sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestay.llm.common import text_slices
from lodestay.llm.tokens import UnitEncoder

Piece = tuple  # (doc_id, start, doc_tokens, ids, whether it was cut or moved when the task closed)
_NEVER = np.iinfo(np.int64).max
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, recut boolean, ids binary"


class SumOfSquares:
    """Open windows by fill level. ``add`` and ``close`` return the windows that are full, as lists of pieces."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}

    def level_for(self, length: int) -> int:
        """The level (0: a new window) whose change leaves the least sum of squares; of equal ones the fullest."""
        top = self.capacity - length
        change = 2 * (self.count[length:] - self.count[: top + 1]) + 2
        change[top] -= 2 * self.count[self.capacity] + 1  # a full window counts no more
        change[1:][self.count[1 : top + 1] == 0] = _NEVER
        if top:
            change[0] = 2 * self.count[length] + 1
        return top - int(np.argmin(change[::-1]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        n, capacity = len(ids), self.capacity
        for start in range(0, n - capacity + 1, capacity):
            yield [(doc_id, start, n, ids[start : start + capacity], False)]
        rest = n % capacity
        if not rest:
            return
        level = self.level_for(rest)
        window: list[Piece] = []
        if level:
            window = self.windows[level].pop()
            self.count[level] -= 1
        window.append((doc_id, n - rest, n, ids[n - rest :].copy(), False))  # a copy, so as not to hold the whole batch
        if level + rest == capacity:
            yield window
        else:
            self.windows.setdefault(level + rest, []).append(window)
            self.count[level + rest] += 1

    def close(self) -> Iterator[list[Piece]]:
        open_windows = [w for level in sorted(self.windows, reverse=True) for w in self.windows[level]]
        left = sum(len(p[3]) for w in open_windows for p in w)
        full, tail = divmod(left, self.capacity)
        # Any ``full`` of the fullest windows lack as many ids as the others hold beyond the tail.
        kept, donors = open_windows[:full], [p for w in open_windows[full:] for p in w]
        at, used = 0, 0

        def take(size: int) -> Iterator[Piece]:
            nonlocal at, used
            while size:
                doc_id, start, n, ids, _ = donors[at]
                cut = ids[used : used + size]
                yield doc_id, start + used, n, cut, True
                size -= len(cut)
                used += len(cut)
                if used == len(ids):
                    at, used = at + 1, 0

        for window in kept:
            yield window + list(take(self.capacity - sum(len(p[3]) for p in window)))
        for bit in reversed(range(tail.bit_length())):
            if tail >> bit & 1:
                yield list(take(1 << bit))
        self.__init__(self.capacity)


def _rows(windows: list[list[Piece]], first: int) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(8)]
    for sequence, window in enumerate(windows, first):
        offset = 0
        for doc_id, start, n, ids, recut in window:
            for column, value in zip(columns, (doc_id, start, len(ids), n, sequence, offset, recut, ids.astype("<u4").tobytes()), strict=True):
                column.append(value)
            offset += len(ids)
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])


def _pack(tokenizer: str, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = UnitEncoder(tokenizer), SumOfSquares(capacity)
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, lengths = encoder.encode(part.column(1))
                windows: list[list[Piece]] = []
                ended = np.insert(ids, np.cumsum(lengths), end_id)
                at = 0
                for doc_id, n in zip(part.column(0).to_pylist(), (lengths + 1).tolist(), strict=True):
                    windows += packer.add(doc_id, ended[at : at + n])
                    at += n
                yield _rows(windows, sequence)
                sequence += len(windows)
        yield _rows(list(packer.close()), sequence)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, recut, ids) of the packed ``docs`` (doc_id, text).

    A document is its ids by the tokenizers file, then ``end_id``; null and empty texts are the end id alone.
    Every row counts, repeated ids and null ids too. ids are little-endian unsigned 32-bit. A sequence holds
    ``capacity`` ids, or a power of two of them. There is no shuffle: a sequence never spans two input splits, and a
    task that is run again gives the same sequences. ``recut`` marks the pieces of windows that were taken apart when
    their task closed. An empty table gives no pieces. Further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, end_id, capacity), _SCHEMA)
