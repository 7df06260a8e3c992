"""Word-window repeats by level-wise doubling (operator 10).

A window of 13 words can only repeat in another document if its parts do, so
what repeats at one length alone is extended to twice that length: 4 words, 8
words, and 13 (the last doubling is cut at the window's own length).

A level counts the grams of its length.  Of the grams inside a window its least
one stands for it, and windows next to each other that share it are one row.
Rows whose gram occurs in one document only are dropped.  Of rows with one
wording the later ones are repeats, and only the first goes on to the next
level, and only if its gram is met in other wordings too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import runs
from leafmill.llm.common import id_and_text, map_batches, settle, table, unsqueezed
from leafmill.llm.repeats import RUN, digit_pass, first_runs, listed, marked, merged, pieces, with_spans

SIZE = 13
LEVEL = 4


def _runs(units: np.ndarray, bounds: np.ndarray, size: int, level: int) -> dict | None:
    at = np.arange(max(0, len(units) - level + 1))
    return runs.runs_of(runs.Prefix(units)(at, at + level), units, bounds, size, level)


def _extended(size: int, level: int):
    """The windows of the runs that go on, as runs of the next level."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, v, texts = batch.column("doc_id").to_numpy(), batch.column("v").to_numpy(), unsqueezed(batch.column("text"))
        row, (lo, n) = listed(batch.column("r"), ["lo", "n"])
        for first, last, joined, bounds in runs.joined(texts):
            units, words = runs.word_units(joined, bounds)
            mine = slice(*np.searchsorted(row, [first, last]))
            at, long = words[row[mine] - first] + lo[mine], np.abs(n[mine]) - 1 + size
            cuts = np.append(0, np.cumsum(long))
            if found := _runs(units[np.arange(cuts[-1]) + np.repeat(at - cuts[:-1], long)], cuts, size, level):
                run = found.pop("doc")
                of = row[mine][run]
                yield found | {"doc_id": doc[of], "v": v[of], "lo": found["lo"] + lo[mine][run]}

    return make


def repeated_spans(docs: DataFrame, size: int = SIZE, level: int = LEVEL) -> DataFrame:
    """(doc_id, v, lo, n): the word windows lo ... lo + n - 1 also start in a document with a smaller doc_id.

    Rows with a null doc_id take no part.  Rows that repeat one doc_id count as
    one document, also if their texts differ: none is smaller than the other.
    """
    known = id_and_text(docs).where("doc_id is not null and text is not null")
    found, later = first_runs(known, lambda joined, bounds: _runs(*runs.word_units(joined, bounds), size, level)), None
    while True:
        judged = digit_pass(found, "min(doc_id)", "doc_id > first", "min(doc_id) < max(doc_id)", "min(first) < max(first)")
        part = judged.where("later").select("doc_id", "v", "lo", F.abs("n").alias("n"))
        later = part if later is None else later.union(part)
        if level == size:
            return later
        level = min(2 * level, size)
        found = settle(map_batches(pieces(known, judged.where("not later"), ["lo", "n"]), RUN, _extended(size, level)))


def _cut(text: bytes, lo: list[int] | None, n: list[int] | None, size: int) -> tuple[int, int, list[bytes]]:
    words = text.split()
    a, b = merged(lo, n, size, len(words))
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        kept += words[at:x]
        at = y
    return len(words), int((b - a).sum()), kept + words[at:]


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Operator 10's contract: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words; a null doc_id keeps all of them; rows that repeat
    a doc_id and text have one result.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": []}
        for text, lo, n in zip(unsqueezed(batch.column("text")), batch.column("lo").to_pylist(), batch.column("n").to_pylist(), strict=True):
            words, removed, kept = _cut(text, lo, n, size)
            out["n_words"].append(words)
            out["n_removed"].append(removed)
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield out

    rows = with_spans(marked(docs), repeated_spans(docs, size)).select("doc_id", "text", "lo", "n")
    return map_batches(rows, "doc_id long,n_words long,n_removed long,kept_sha256 string", make)


def op10_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
