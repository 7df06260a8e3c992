"""The distributed pass that both exact repeat finders are made of, and what they do with the spans they find.

Documents are told apart by (doc_id, v), v being a hash of the text: rows that
repeat a doc_id with one text are one document, with different texts they are
different ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import runs
from leafmill.llm.common import blobs, id_and_text, map_batches, release, settle

RUN = "doc_id long,v long,lo int,n int,key long,body long,rest long"
WORDING = ["key", "body", "rest"]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, v, text) of all rows; text as Zstandard frames, for exchanges that carry whole texts; null stays null."""
    import zstandard

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        pack, texts = zstandard.ZstdCompressor(level=1).compress, blobs(batch.column(1))
        packed = [pack(t) if known else None for t, known in zip(texts, batch.column(1).is_valid().to_pylist(), strict=True)]
        yield {"doc_id": batch.column(0), "v": [runs.text_hash(t) for t in texts], "text": packed}

    return map_batches(id_and_text(docs), "doc_id long,v long,text binary", make)


def first_runs(docs: DataFrame, find: Callable[[bytes, np.ndarray], dict | None]) -> DataFrame:
    """(RUN) of all documents; find: runs_of for texts end to end and their bounds."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), blobs(batch.column(1))
        for first, last, joined, bounds in runs.joined(texts):
            if found := find(joined, bounds):
                doc = found.pop("doc")
                yield found | {"doc_id": ids[first + doc], "v": np.array([runs.text_hash(t) for t in texts[first:last]])[doc]}

    return map_batches(docs, RUN, make)


def digit_pass(found: DataFrame, first: str, later: str, shared: str, mixed: str) -> DataFrame:
    """One pass: runs whose key is not shared are dropped, the others are compared by wording.

    found: RUN.  The rest is SQL: first and later say what comes first among the
    runs of one wording and whether a run comes after it; shared is what the
    runs of a key, mixed what the wordings of a key must meet for windows to be
    equal across them.  Returns a settled table of doc_id, v, lo, n, key, later,
    open (the key is mixed), and how many wordings (runs) and windows it has;
    rows that are neither later nor open are left out.

    Counts are combined on the map side.  What is joined back is settled before,
    so that AQE can split a key that a third of all rows share.
    """
    keys = settle(found.groupBy("key").agg(F.expr(shared).alias("shared")).where("shared").select("key"))
    hot = settle(found.join(keys, "key"))
    release(keys)
    wordings = settle(hot.groupBy(*WORDING).agg(F.expr(first).alias("first"), F.min("n").alias("n")))
    held = wordings.groupBy("key").agg(F.expr(mixed).alias("open"), F.count("*").alias("runs"), F.sum(F.abs("n")).alias("windows"))
    held = settle(held.where("open"))
    named = settle(wordings.drop("n").join(held, "key", "left"))
    release(wordings, held)
    out = hot.join(named, WORDING).select("doc_id", "v", "lo", "n", "key", F.expr(later).alias("later"), F.col("open").isNotNull().alias("open"), "runs", "windows")
    out = settle(out.where("later or open"))
    release(hot, named)
    return out


def pieces(docs: DataFrame, spans: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, v, text, r): the marked rows that have spans, and these as an array of structs."""
    kept = spans.groupBy("doc_id", "v").agg(F.collect_set(F.struct(*names)).alias("r"))
    return marked(docs).join(kept, ["doc_id", "v"])


def listed(column: pa.ListArray, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """An array-of-structs column as flat values: the row of each element, and the fields."""
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
    flat = column.flatten()
    return row, [flat.field(x).to_numpy(zero_copy_only=False) for x in names]


def merged(lo: list[int] | None, n: list[int] | None, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered stretches (starts, ends) of a row of ``length`` units."""
    if not lo:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.array(lo)
    b = np.minimum(a + np.array(n) - 1 + size, length)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    start = a[new]
    end = b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
    ok = start < end
    return start[ok], end[ok]


def with_spans(docs: DataFrame, spans: DataFrame, lo: str = "lo", n: str = "n") -> DataFrame:
    """docs (doc_id, v, ...) with two arrays, starts and counts of the repeated windows, null where there is none."""
    listed = spans.groupBy("doc_id", "v").agg(F.collect_list(F.struct("lo", "n")).alias("r")).select("doc_id", "v", F.col("r.lo").alias(lo), F.col("r.n").alias(n))
    return docs.join(listed, ["doc_id", "v"], "left")
