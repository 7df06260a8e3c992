"""Sequence packing by best-fit decreasing (operator 5).

A document's ids, closed by an end id, are first cut into full windows, each a
sequence of its own.  What is left of each document is packed by best-fit
decreasing: pieces come longest first, and a segment tree indexed by remaining
capacity finds the tightest open sequence.  Only (document, length) rows are
shuffled; the number of packing tasks follows the number of pieces, and with
tens of thousands of pieces in each, tasks pad as little as one would.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import ARROW, blobs, id_and_text, map_batches, settle, table
from leafmill.llm.tokens import VOCABULARY, chunks_of

SIZE = 4096
END = 2
#: Pieces for each packing task.
PIECES = 50_000


class BestFit:
    """Best-fit packing into sequences of ``size``; the segment tree counts open sequences by remaining capacity."""

    def __init__(self, size: int):
        self.size = size
        self.width = 1 << size.bit_length()
        self.tree = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = 0

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.width
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity, at least ``length``, of an open sequence."""
        tree, i = self.tree, length + self.width
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up, until a right neighbour holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - self.width

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        capacity = self.tightest(length)
        if capacity is None:
            capacity, sequence = self.size, self.count
            self.count += 1
        else:
            sequence = self.open[capacity].pop()
            self._add(capacity, -1)
        if left := capacity - length:
            self.open[left].append(sequence)
            self._add(left, 1)
        return sequence, self.size - capacity


def pieces(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document in full windows and what is left of it."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        known = chunks_of(vocabulary)
        out: dict[str, list] = {x: [] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc, found in zip(batch.column(0).to_pylist(), known.each(blobs(batch.column(1))), strict=True):
            ids = found.astype("<u4").tobytes() + end.to_bytes(4, "little")
            for a in range(0, len(ids), 4 * size):
                part = ids[a : a + 4 * size]
                for x, y in zip(out.values(), (doc, a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                    x.append(y)
        yield out

    return map_batches(id_and_text(docs), "doc_id long,start long,length long,ids_crc32 long,doc_tokens long", make)


def packed(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str = VOCABULARY, per_task: int = PIECES) -> DataFrame:
    """Operator 5's contract: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its one piece is the end id.  Rows that repeat and
    null doc_ids are documents of their own.  An empty table gives no rows.
    """
    cut = settle(pieces(docs, size, end, vocabulary))
    tasks = max(1, math.ceil(cut.count() / per_task))
    dealt = cut.repartition(tasks, "doc_id", "start").sortWithinPartitions(F.desc("length"), "doc_id", "start")
    ddl = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long"
    schema = pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in ddl.split(","))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(size), TaskContext.get().partitionId() << 40
        for batch in batches:
            put = [fit.put(n) for n in batch.column("length").to_pylist()]
            ids, offsets = pa.array([base + s for s, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, offsets], schema=schema)

    return dealt.mapInArrow(pack, ddl)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
