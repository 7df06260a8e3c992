"""Periodic runs of words by power-of-two names (operator 11).

Karp, Miller and Rosenberg's naming: a block of 2**(k+1) words is named by the
names of its two halves, so two blocks of one text have one name if and only if
they are equal.  Names are exact: words are named by a dictionary, pairs of
names by sorting them.  A block that comes once in its text has no name, and
larger blocks are only looked for where both halves have one, so levels get
short quickly.

A run of period q that holds ``exponent`` periods covers grid points g, g + q
(multiples of q) after which at least (exponent - 2) * q words agree.  For all q
between 2**k and 2**(k+1) these pairs are compared at one level of names; the
first pair of each row of hits is extended both ways by descending the levels.
All of this is NumPy over many texts end to end; a word that exists once
stands between two texts, so nothing reaches across.

The operator is map only: a row is a document and nothing is shuffled.  Memory
is bounded by the longest single text: 4 bytes a word and level.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import SLICE, blobs, id_and_text, sliced, table

#: A run has at least so many words and so many periods.
LEAST, EXPONENT = 6, 4
#: Texts are worked on in pieces of about so many words, whole texts at a time.
PIECE = 1 << 16
#: Names go up to blocks of 2**TOP words; longer agreement takes several steps at the top.
TOP = 15


class Names:
    """Names of the blocks of 2**k words from each place on; a block that comes once has a negative one of its own."""

    def __init__(self, words: np.ndarray, top: int = TOP):
        """words: a value for each place; equal for equal words of one text, unique for what stands between texts."""
        n = len(words)
        alone = -1 - np.arange(n, dtype=np.int32)
        self.levels = []
        at, code = np.arange(n), words
        for k in range(top + 1):
            _, name, times = np.unique(code, return_inverse=True, return_counts=True)
            again = times > 1
            compact = np.cumsum(again, dtype=np.int32) - 1
            here = again[name]
            at, name = at[here], compact[name[here]]
            if not len(at):
                break
            level = alone.copy()
            level[at] = name
            self.levels.append(level)
            # the next level: both halves have a name
            at = at[at + (1 << k) < n]
            left, right = level[at].astype(np.int64), level[at + (1 << k)].astype(np.int64)
            both = right >= 0
            at, code = at[both], left[both] << 32 | right[both]

    def equal(self, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
        """Whether the blocks of 2**k words at i and at j (another place) are equal."""
        if k >= len(self.levels):
            return np.zeros(len(i), bool)
        return self.levels[k][i] == self.levels[k][j]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j > i on."""
        i, j, begun = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            open_ = np.arange(len(i))
            while len(open_):  # more than once only at the top
                hit = self.equal(i[open_], j[open_], k)
                open_ = open_[hit]
                i[open_] += 1 << k
                j[open_] += 1 << k
                if k < TOP:
                    break
        return i - begun

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree before i and before j > i; a word that exists once stands at 0."""
        i, j, begun = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            open_ = np.arange(len(i))
            while len(open_):
                open_ = open_[i[open_] >= 1 << k]
                hit = self.equal(i[open_] - (1 << k), j[open_] - (1 << k), k)
                open_ = open_[hit]
                i[open_] -= 1 << k
                j[open_] -= 1 << k
                if k < TOP:
                    break
        return begun - i


def _stretches(names: Names, n: int, longest: int, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the maximal stretches of at least ``least`` words and ``exponent`` periods, periods not yet the smallest."""
    found = []
    for k in range(longest.bit_length()):
        q = np.arange(1 << k, min((2 << k) - 1, longest // exponent) + 1)
        if not len(q):
            break
        # LCE(g, g + q) >= (exponent - 2) * q at some grid point; the level just below that decides
        level = k + (exponent - 2).bit_length() - 1
        if level < TOP and level >= len(names.levels):
            break  # no block of that length comes twice, nor does a longer one
        level = min(level, TOP)
        for part in np.array_split(q, max(1, int(n / (1 << k) * len(q)) // (1 << 22))):
            points = (n - 1 - part) // part + 1  # multiples of q below n - q
            points = np.maximum(points, 0)
            p = np.repeat(part, points)
            first = np.cumsum(points) - points
            place = np.arange(len(p)) - np.repeat(first, points)
            g = place * p
            hit = names.equal(g, g + p, level)
            led = hit.copy()  # g - q was a hit over at least q words: the same stretch
            if 1 << level >= 2 << k or k == 0:
                led[1:] &= ~(hit[:-1] & (place[1:] > 0))
            g, p = g[led], p[led]
            if not len(g):
                continue
            end = g + p + names.ahead(g, g + p)
            start = g - names.behind(g, g + p)
            long = end - start >= np.maximum(least, exponent * p)
            found.append((start[long], end[long], p[long]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


def runs(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of several texts, each a list of words; by text, start and period."""
    if exponent < 3:
        raise ValueError("a run holds at least three periods")
    sizes = np.array([len(x) for x in texts], np.int64)
    bounds = np.append(0, np.cumsum(sizes + 1)) + 1  # a place before each text, and one after the last
    n = int(bounds[-1])
    known: dict = defaultdict(count().__next__)
    flat = np.fromiter((known[w] for x in texts for w in x), np.int64, int(sizes.sum()))
    words = np.full(n, -1, np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    words[np.arange(len(flat)) + of + 1] = flat + of * len(known)
    gaps = np.flatnonzero(words < 0)
    words[gaps] = -1 - gaps
    start, end, period = _stretches(Names(words), n, int(sizes.max(initial=0)), least, exponent)
    # one stretch was found by its smallest period and perhaps by multiples of it
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    text = np.searchsorted(bounds, start, side="right") - 1
    return text, start - bounds[text], end - start, period


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    held, first, words = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.split())
        words += len(held[-1])
        if words >= PIECE or i == len(texts) - 1:
            yield first, held
            held, first, words = [], i + 1, 0


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not len(start):
        return b" ".join(words)
    deep = np.zeros(len(words) + 1, np.int64)
    np.add.at(deep, start + period, 1)
    np.add.at(deep, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(deep[:-1]) == 0).tolist()])


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period) and collapsed, for each row of docs.

    A run is a stretch of words whose smallest period is ``period``, which
    holds at least ``exponent`` periods and ``least`` words and which no word
    next to it extends.  collapsed: the words joined by one space, without
    those that a run holds after its first period.  Words are separated by
    ASCII white space.

    A null or empty text has no words, no runs and an empty collapsed text; a
    row without a doc_id is judged like any other; rows that repeat have a
    result each; other columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", kind), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE // 4):
            ids, texts = batch.column("doc_id"), blobs(batch.column("text"))
            for first, words in _pieces(texts):
                of, start, length, period = runs(words, least, exponent)
                cuts = np.searchsorted(of, np.arange(len(words) + 1))
                out = [_collapsed(w, start[a:z], length[a:z], period[a:z]) for w, a, z in zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(kind.value_type))
                columns = [ids.slice(first, len(words)), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found), pa.array(out, pa.binary()).cast(pa.string(), safe=False)]
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()), columns[1], columns[2].cast(kind), columns[3]], schema=schema)

    return id_and_text(docs).mapInArrow(run, RUNS)


def best(runs: str = "runs") -> Column:
    """The run of the greatest exact length / period, the first of them by start and period; null if there is none."""
    greater = "r.length * b.period > b.length * r.period"
    return F.expr(f"reduce({runs}, get({runs}, 0), (b, r) -> if({greater}, r, b))")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by crc32 of its id repeats its own words from one of them on.

    h = crc32 of the decimal doc_id, g = floor(h / 10).  If h % 10 = 0 and there
    are n > 0 words, each word i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.expr(r"filter(split(text, '[ \\t-\\r]+'), x -> x <> '')")
    some = id_and_text(docs).withColumn("_h", h)
    tenth = F.coalesce(F.col("_h") % 10 == 0, F.lit(False))
    changed = (
        some.where(tenth).withColumn("_w", words).withColumn("_n", F.size("_w")).withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_a", F.expr("if(_n > 0, cast(_g % _n as int), 0)"))
        .withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
        .withColumn("text", F.expr("if(_n > 0, array_join(concat(slice(_w, 1, _a), transform(sequence(0, _n - _a - 1), j -> get(_w, _a + j % _p))), ' '), text)"))
    )
    return some.where(~tenth).select("doc_id", "text").union(changed.select("doc_id", "text"))


def digests(docs: DataFrame) -> DataFrame:
    """Operator 11's contract, of texts as they are given."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = periodic_runs(docs).withColumn("_b", best())
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_b.start", "_b.length", "_b.period", F.expr("1000 * _b.length div _b.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(planted(table(spark, sf_dir, "documents")))
