"""Folds: what hangs on the order of a group's rows and can't be said with windows.

Rows are dealt out by group and sorted; one pass carries a small state from row
to row, so no group is ever held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark's types as Arrow's, for what a fold returns.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def folded(rows: DataFrame, by: list[str], order: list[str], value: str, state: Callable[[], Callable], out: dict[str, str], keep: list[str] | None = None, deal: bool = True) -> DataFrame:
    """by, order, keep and the columns ``out`` (name: type): what a fresh ``state()`` returns for each value of its group, in order; group keys are not null.

    keep: columns that go along, so that nothing has to be joined back.  deal:
    False if each group is in one partition already.
    """
    types = dict(rows.dtypes)
    keys = [*by, *[c for c in order if c not in by], *(keep or [])]
    schema = ", ".join([f"{c} {types[c]}" for c in keys] + [f"{c} {t}" for c, t in out.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            found = []
            for *group, v in zip(*[batch.column(c).to_pylist() for c in (*by, "_value")], strict=True):
                if step is None or group != at:
                    at, step = group, state()
                found.append(step(v))
            made = list(zip(*found, strict=True)) or [()] * len(out)
            columns = [pa.array(list(x), ARROW[t]) for x, t in zip(made, out.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *columns], [*keys, *out])

    kept = rows.select(*keys, F.col(value).alias("_value"))
    return (dealt(kept, by, order) if deal else kept.sortWithinPartitions(*by, *order)).mapInArrow(run, schema)


def dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with each group in one partition, sorted.

    Dealt by a hash of the keys and not by the keys: a union whose parts are
    already dealt by them would count as dealt itself, the exchange would be left
    out, and adaptive execution would then merge the parts' partitions on their own.
    """
    return rows.withColumn("_group", F.xxhash64(*by)).repartition("_group").drop("_group").sortWithinPartitions(*by, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Of sorted rows, tables of whole groups with where each one begins and ends; only the last, open group waits for the next batch."""
    open_ = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if open_ is None else pa.concat_tables([open_, pa.Table.from_batches([batch])])
        keys = list(zip(*[rows.column(c).to_pylist() for c in by], strict=True))
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]).combine_chunks(), list(pairwise(starts))
        open_ = rows.slice(starts[-1]) if starts else None
    if open_ is not None:
        yield open_.combine_chunks(), [(0, open_.num_rows)]


def whole_rows(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of sorted rows, tables of whole groups with where each one begins; rows of the last, open group wait for its end."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = changes(batch, by)
        if open_ and changes(pa.Table.from_batches([open_[-1].slice(open_[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks(), by).size:
            new = np.append(0, new)
        if new.size:
            rows = pa.Table.from_batches([*open_, batch.slice(0, new[-1])]).combine_chunks()
            if rows.num_rows:
                before = sum(x.num_rows for x in open_)
                yield rows, np.unique(np.append(0, new[:-1] + before))
            open_ = []
        open_.append(batch.slice(new[-1] if new.size else 0))
    if open_:
        yield pa.Table.from_batches(open_).combine_chunks(), np.array([0])


def changes(rows: pa.RecordBatch | pa.Table, by: list[str]) -> np.ndarray:
    """Where a group begins that the row before is not in."""
    found = np.zeros(rows.num_rows - 1, bool)
    for c in by:
        a, b = (rows.column(c).slice(k, rows.num_rows - 1) for k in (0, 1))
        found |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | np.asarray(pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return np.flatnonzero(found) + 1
