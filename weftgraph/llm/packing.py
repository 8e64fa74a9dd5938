"""Best-fit packing of token sequences with a bounded number of open bins.

Each task packs the pieces of its own partition as they come: no shuffle, and memory for one batch
and the open bins alone. An open bin is kept under its free space, and a bitset has a bit for each
free space that some open bin has; the best fit for a piece is the lowest bit at or above its
length. When all places for open bins are taken, the fullest closes. Sequence ids hold the
partition's number, so a task that is run again gives the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG, encode, encoding

LENGTH = 1024
OPEN_BINS = 512
TASK_BYTES = 16 << 20
_TASK_SHIFT = 36  # sequence_id: partition number, then a count within it


class BestFit:
    """Places pieces into bins of ``size``; at most ``most_open`` bins are open at once."""

    def __init__(self, size: int = LENGTH, most_open: int = OPEN_BINS, first_bin: int = 0):
        self.size, self.most_open, self.next_bin = size, most_open, first_bin
        self.bits, self.by_free, self.open = 0, [[] for _ in range(size + 1)], 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        found = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of 1 to ``size`` tokens."""
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            found, free = self.next_bin, self.size
            self.next_bin += 1
        left = free - length
        if left:
            if self.open == self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.size - free


def cut(n: int, size: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; if it is longer than ``size``, only the first may be shorter."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def whole_tasks(rows: DataFrame, task_bytes: int) -> DataFrame:
    """``rows`` in no more partitions than there are ``task_bytes``, but in as many as there are cores if it has them."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))
    return rows.coalesce(most) if most < 1 << 31 else rows


def pack(
    docs: DataFrame, path: str, pattern: str, end_id: int = 2, size: int = LENGTH, most_open: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, long: int = LONG, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row for each piece of each row of ``docs``.

    A document's ids are followed by ``end_id``, so that a null or empty text is one piece of one
    token. A text of any length is encoded whole, then cut. Rows that repeat an id are packed each
    on its own. An empty table gives no rows. Other columns are ignored. Partitions that the
    optimizer takes for smaller than ``task_bytes`` are brought together without a shuffle, as long
    as every core has one: each leaves some of its last bins open.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(path, pattern)
        end = np.array([end_id], dtype="<u4")
        bins = BestFit(size, most_open, TaskContext.get().partitionId() << _TASK_SHIFT)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.concatenate([encode(codec, text.as_py() or "", long), end])
                for i, (start, length) in enumerate(cut(len(ids), size)):
                    own = ids[start : start + length]
                    rows.append((doc, i, start, length, zlib.crc32(own.tobytes()), *bins.place(length)) + ((own.astype("<i4"),) if with_ids else ()))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())]
            columns = list(zip(*rows, strict=True)) or [()] * (7 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return whole_tasks(rows, task_bytes).mapInArrow(packed, schema)
