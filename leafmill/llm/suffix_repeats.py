"""Byte repeats by a depth-limited radix sort of suffixes (operator 7).

Suffixes are ordered through their first ``size`` bytes only, by passes over
most-significant digits; a suffix leaves as soon as no other shares its digits,
and groups that are still together at that depth are exactly the repeated
windows.

The first digit, which deals suffixes out to tasks, is not the first byte but
the least 16-byte gram among the ``size`` bytes: equal windows have equal ones,
and neighbouring suffixes mostly share it, so a run of them travels as one row
(about one for 40 bytes).  Runs with one wording need no further digit: all but
the first are repeats.  Where runs of one gram differ, at the border of a
repeated passage, the first run of each wording goes on:

* a bucket that fits into a task is sorted there, eight bytes of the texts
  themselves at a time, from the most significant on;
* the suffixes of a larger bucket are dealt out by all of their ``size`` bytes
  (128 bits of XXH3), first by parts of the corpus, then the first of each part
  among themselves, so no group ever meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from leafmill.llm import runs
from leafmill.llm.common import blobs, id_and_text, map_batches, settle, sliced, table, unsqueezed
from leafmill.llm.repeats import digit_pass, first_runs, listed, marked, merged, pieces, with_spans

SIZE = 100
#: A bucket of so many runs and suffixes at most is sorted inside one task.
RUNS, SUFFIXES = 4096, 1 << 19
#: Parts of the corpus in which the suffixes of a larger bucket are compared first.
PARTS = 64

_PLACE = "doc_id long,v long,lo int,n int"


def _wording(size: int):
    """The bytes that each run covers."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, v, texts = batch.column("doc_id").to_numpy(), batch.column("v").to_numpy(), unsqueezed(batch.column("text"))
        row, (lo, n, key, small) = listed(batch.column("r"), ["lo", "n", "key", "small"])
        ends = lo + np.abs(n) - 1 + size
        yield {"doc_id": doc[row], "v": v[row], "lo": lo, "n": n, "key": key, "small": small, "body": [texts[i][a:z] for i, a, z in zip(row.tolist(), lo.tolist(), ends.tolist(), strict=True)]}

    return make


def repeated_windows(bodies: list[bytes], bucket: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, start) of the windows of runs that are equal to an earlier window of their bucket.

    Sorts by eight bytes at a time, most significant first; only windows that
    still share all digits with another go on to the next.
    """
    bounds = np.cumsum([0, *map(len, bodies)])
    n = np.diff(bounds) - size + 1
    run = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    digits = runs.eights(np.frombuffer(b"".join(bodies), np.uint8), big=True)
    at, window, group = bounds[run] + start, np.arange(len(run)), bucket[run]
    for depth in range(0, size, 8):
        digit = digits[at + depth]
        if size - depth < 8:
            digit = digit >> np.uint64(8 * (8 - size + depth))
        order = np.lexsort((digit, group))  # stable: earlier windows first
        at, window, group, digit = at[order], window[order], group[order], digit[order]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        first, alone = new[:-1], new[:-1] & new[1:]
        group = np.cumsum(first)[~alone]
        at, window, first = at[~alone], window[~alone], first[~alone]
        if not len(at):
            break
    else:
        window = window[~first]
    if not len(at):
        window = at
    window = np.sort(window)
    return run[window], start[window]


def _found(doc: np.ndarray, v: np.ndarray, lo: np.ndarray, run: np.ndarray, start: np.ndarray) -> dict:
    """Windows, sorted by run and start, as spans."""
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    run, at = run[first], start[first]
    return {"doc_id": doc[run], "v": v[run], "lo": lo[run] + at, "n": np.diff(np.append(first, len(start)))}


def _sorted_in_task(size: int):
    """Rows come sorted by key, doc_id, v and lo, all runs of a key together."""

    def find(rows: pa.Table) -> pa.RecordBatch:
        key, doc, v, lo = (rows.column(x).to_numpy() for x in ("key", "doc_id", "v", "lo"))
        once = np.ones(len(key), bool)  # rows that repeat a document
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1])
        rows, key, doc, v, lo = rows.filter(pa.array(once)), key[once], doc[once], v[once], lo[once]
        found = _found(doc, v, lo, *repeated_windows(rows.column("body").to_pylist(), key, size))
        return pa.RecordBatch.from_arrays([pa.array(found["doc_id"], pa.int64()), pa.array(found["v"], pa.int64()), pa.array(found["lo"], pa.int32()), pa.array(found["n"], pa.int32())], ["doc_id", "v", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for piece in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                key = piece.column(piece.schema.get_field_index("key")).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut or (held and held[-1].column("key")[-1].as_py() != key[0]):
                    held.append(piece.slice(0, cut))
                    yield find(pa.Table.from_batches(held))
                    held = []
                held.append(piece.slice(cut))
        if held and sum(x.num_rows for x in held):
            yield find(pa.Table.from_batches(held))

    return run


def _suffixes(size: int, parts: int):
    """Each window of each run: its place, 128 bits for its bytes, and the part of the corpus that it stands in."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for piece in sliced([batch], 1 << 16):
            doc, v, lo = (piece.column(x).to_numpy() for x in ("doc_id", "v", "lo"))
            bodies = piece.column("body").to_pylist()
            n = np.array([len(b) - size + 1 for b in bodies])
            run = np.repeat(np.arange(len(n)), n)
            start = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            whole = np.frombuffer(b"".join([xxh3_128_digest(b[i : i + size]) for b in bodies for i in range(len(b) - size + 1)]), np.int64).reshape(-1, 2)
            place = lo[run] + start
            part = runs.mixed(doc[run].view(np.uint64) ^ runs.mixed(place.astype(np.uint64))) % np.uint64(parts)
            yield {"doc_id": doc[run], "v": v[run], "lo": place, "one": whole[:, 0], "two": whole[:, 1], "part": part.astype(np.int32)}

    return make


def _after_the_first(names: list[str]):
    """Rows come sorted by names, doc_id, v and lo: a row with leads = true for the first place of each group, and the places after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            by = [batch.column(batch.schema.get_field_index(x)).to_numpy() for x in names]
            place = [batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("doc_id", "v", "lo")]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in by], axis=0)
            goes_on = group is not None and group == [x[0] for x in by]
            new[0] = not goes_on
            first = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), -1))
            head = [np.where(first >= 0, x[first], 0 if lead is None else lead[k]) for k, x in enumerate(place)]
            later = np.any([x != h for x, h in zip(place, head, strict=True)], axis=0)
            keep = new | later
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "v", "lo", "one", "two")), pa.array(new)], ["doc_id", "v", "lo", "one", "two", "leads"]).filter(pa.array(keep))
            group, lead = [x[-1] for x in by], [h[-1] for h in head]

    return run


def _across_parts(suffixes: DataFrame) -> DataFrame:
    """(doc_id, v, lo, n) of the suffixes that are equal to an earlier one: first within parts, then among the first of each part."""
    ddl = "doc_id long,v long,lo int,one long,two long,leads boolean"
    by = ["one", "two", "part"]
    inside = settle(suffixes.repartition(*by).sortWithinPartitions(*by, "doc_id", "v", "lo").mapInArrow(_after_the_first(by), ddl))
    across = inside.where("leads").repartition("one", "two").sortWithinPartitions("one", "two", "doc_id", "v", "lo").mapInArrow(_after_the_first(["one", "two"]), ddl)
    return inside.union(across).where("not leads").select("doc_id", "v", "lo", F.lit(1).alias("n"))


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, v, lo, n): the windows lo, lo + 1, ... lo + n - 1 of a document also start earlier.

    Earlier: in a smaller doc_id, or before in the same document.  Rows with a
    null doc_id take no part.  Rows that repeat one doc_id and text count once;
    different texts under one doc_id are documents in the order of v.
    """
    known = id_and_text(docs).where(f"doc_id is not null and octet_length(text) >= {size}")

    def find(joined: bytes, bounds: np.ndarray) -> dict | None:
        raw = np.frombuffer(joined, np.uint8)
        return runs.runs_of(runs.byte_grams(raw), raw, bounds, size, runs.GRAM)

    alone = "min(n) < 0"  # a run that may repeat itself
    judged = digit_pass(first_runs(known, find), "min(struct(doc_id, v, lo))", "struct(doc_id, v, lo) > first", f"count(*) > 1 or {alone}", f"count(*) > 1 or {alone}")
    judged = judged.withColumn("small", F.expr(f"runs <= {RUNS} and windows <= {SUFFIXES}"))
    bodies = settle(map_batches(pieces(known, judged.where("not later"), ["lo", "n", "key", "small"]), "doc_id long,v long,lo int,n int,key long,small boolean,body binary", _wording(size)))
    parts = bodies.where("small").select("doc_id", "v", "lo", "key", "body")
    inside = parts.repartition("key").sortWithinPartitions("key", "doc_id", "v", "lo").mapInArrow(_sorted_in_task(size), _PLACE)
    suffixes = map_batches(bodies.where("not small"), "doc_id long,v long,lo int,one long,two long,part int", _suffixes(size, PARTS))
    return judged.where("later").select("doc_id", "v", "lo", F.abs("n").alias("n")).union(inside).union(_across_parts(suffixes))


def _kept(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(text)]
    return b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Operator 7's contract: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; a null doc_id keeps its whole text; rows that repeat a
    doc_id and text have one result.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, lo, n in zip(unsqueezed(batch.column("text")), batch.column("lo").to_pylist(), batch.column("n").to_pylist(), strict=True):
            a, b = merged(lo, n, size, len(text))
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int((b - a).sum()))
            out["n_spans"].append(len(a))
            out["kept_sha256"].append(hashlib.sha256(_kept(text, a, b)).hexdigest())
        yield out

    rows = with_spans(marked(docs), repeated_spans(docs, size)).select("doc_id", "text", "lo", "n")
    return map_batches(rows, "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string", make)


def cleaned(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with repeated stretches cut out of text, every column and row kept.

    A character goes only if all its bytes do.  Null texts stay null, rows with
    a null doc_id stay as they are, rows that repeat are cut alike.  n_chars,
    where there is one, is set anew for texts that changed.
    """

    def cut(text: bytes, lo: list[int] | None, n: list[int] | None) -> str:
        a, b = merged(lo, n, size, len(text))
        whole = np.append((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, True)  # where a character starts
        starts = np.flatnonzero(whole)
        a, b = starts[np.searchsorted(starts, a)], starts[np.searchsorted(starts, b, side="right") - 1]
        ok = a < b
        return _kept(text, a[ok], b[ok]).decode("utf-8", "replace")

    names = {x: x for x in ("__id", "__v", "__lo", "__n")}
    while set(names.values()) & set(docs.columns):
        names = {k: f"_{x}" for k, x in names.items()}
    doc, v, lo, n = names.values()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([runs.text_hash(t) for t in blobs(batch.column(at))], pa.int64())], schema=batch.schema.append(pa.field(v, pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = batch.schema.get_field_index("text")
            spans = (batch.column(i).to_pylist() for i in (batch.num_columns - 2, batch.num_columns - 1))
            texts = pa.array([cut(t, lo, n) for t, lo, n in zip(blobs(batch.column(at)), *spans, strict=True)], pa.string())
            columns = [texts if i == at else batch.column(i) for i in range(batch.num_columns - 2)]
            fields = [pa.field("text", pa.string()) if i == at else batch.schema.field(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    from pyspark.sql.types import LongType, StructType

    spans = repeated_spans(docs, size).groupBy("doc_id", "v").agg(F.collect_list(F.struct("lo", "n")).alias("r"))
    spans = spans.select(F.col("doc_id").alias(doc), F.col("v").alias(v), F.col("r.lo").alias(lo), F.col("r.n").alias(n))
    whole = docs.withColumn("text", F.col("text").cast("string"))
    told = whole.mapInArrow(named, StructType([*whole.schema.fields]).add(v, LongType())).withColumn(doc, F.col("doc_id").cast("long"))
    listed = told.join(spans, [doc, v], "left").select(*docs.columns, lo, n)
    touched = listed.where(F.col(lo).isNotNull()).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return touched.select(docs.columns).union(listed.where(F.col(lo).isNull()).select(docs.columns))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
