"""Benchmark passages in documents by SimHash windows (operator 6).

Words are runs of letters and digits, A-Z read as a-z.  Every window of a
document that is as long as a benchmark item is compared with the items of that
length: both get a SimHash of their five-word shingles, items are indexed by
four 16-bit blocks of theirs, and since two fingerprints within RADIUS bits must
agree in one block to within RADIUS // 4 bits, the blocks find all of them.  An
exact weighted Jaccard similarity over the shingles' counts decides.

Windows are fingerprinted only where it can matter: a similarity of t takes
2 t / (1 + t) of an item's shingles, so a window with fewer shingles that occur
in any item at all is passed over.  This drops no pair.

A document shorter than an item is compared with it as one whole window, by the
same fingerprints and the same similarity, if it has at least t times the
item's shingles; with fewer it can't reach t.

The benchmark is the stated query set; it goes to the tasks in blocks of at
most BLOCK bytes, one pass over the documents for each.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import runs
from leafmill.llm.common import blobs, id_and_text, map_batches, sliced, table

WORDS = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 two fingerprints differ in about 10 bits; 24 leaves four deviations.
RADIUS = 24
BLOCK = 16 << 20
_FILTER = 22


def _units(text: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs.word_units(text.lower(), bounds, runs.LETTERS)


def _shingles(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    at = np.arange(max(0, len(units) - k + 1))
    return runs.Prefix(units)(at, at + k) if len(at) else np.empty(0, np.uint64)


def _windows(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHashes of the windows of n shingles at ``starts``."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[starts + n] - sums[starts]) > n, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


@dataclass
class Index:
    """A block of items, by length: ids, fingerprints, and shingle counts."""

    sizes: dict[int, list[int]] = field(default_factory=dict)
    ids: list[int] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    prints: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    blocks: dict[int, list[dict[int, list[int]]]] = field(default_factory=dict)
    known: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def index(items: list[tuple[int, str]]) -> Index:
    """Index items (item_id, text); those without words are left out."""
    out, prints, known = Index(), [], defaultdict(list)
    for item, text in items:
        raw = (text or "").encode()
        units, _ = _units(raw, np.array([0, len(raw)]))
        if not len(units):
            continue
        k = min(WORDS, len(units))
        hashes = _shingles(units, k)
        known[k].append(hashes)
        prints.append(_windows(hashes, np.array([0]), len(hashes))[0])
        out.sizes.setdefault(len(units), []).append(len(out.ids))
        out.ids.append(item)
        out.counts.append(Counter(hashes.tolist()))
    out.prints = np.array(prints, np.uint64)
    for n, members in out.sizes.items():
        tables = [defaultdict(list) for _ in range(4)]
        for i in members:
            for b, t in enumerate(tables):
                t[int(out.prints[i]) >> 16 * b & 0xFFFF].append(i)
        out.blocks[n] = [dict(t) for t in tables]
    for k, parts in known.items():
        values = np.unique(np.concatenate(parts))
        seen = np.zeros(1 << _FILTER, bool)
        seen[values & np.uint64((1 << _FILTER) - 1)] = True
        out.known[k] = seen, values
    return out


def near(found: Index, n: int, prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, item) indices of all fingerprints within ``radius`` bits of an item of n words."""
    pairs = []
    for b, blocks in enumerate(found.blocks[n]):
        part = (prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
        values = np.array(list(blocks), np.uint64)
        for i in range(0, len(part), 4096):
            w, v = np.nonzero(np.bitwise_count(part[i : i + 4096, None] ^ values) <= radius // 4)
            for value in np.unique(v):
                windows = w[v == value] + i
                for item in blocks[int(values[value])]:
                    close = windows[np.bitwise_count(prints[windows] ^ found.prints[item]) <= radius]
                    pairs += [(x, item) for x in close.tolist()]
    return sorted(set(pairs))


def passages(texts: list[bytes], found: Index, similarity: float = SIMILARITY, radius: int = RADIUS) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item_id, first word, words, similarity): the best window of each text for each item that it holds."""
    share = 2 * similarity / (1 + similarity)
    for first, _, joined, bounds in runs.joined(texts):
        units, words = _units(joined, bounds)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k, (seen, values) in found.known.items():
            hashes = _shingles(units, k)
            at = np.flatnonzero(seen[hashes & np.uint64((1 << _FILTER) - 1)])
            at = at[np.isin(hashes[at], values)]
            doc = np.searchsorted(words, at, side="right") - 1
            at = at[at + k <= words[doc + 1]]
            if not len(at):
                continue
            hit = np.zeros(len(hashes) + 1, np.int64)
            hit[at + 1] = 1
            hits = np.cumsum(hit)
            for n in found.sizes:
                if min(WORDS, n) != k:
                    continue
                m = n - k + 1
                need = math.ceil(share * m - 1e-9)
                # Windows that hold enough known shingles start near one of them.
                starts = np.unique((at[:, None] - np.arange(m)).ravel()) if len(at) * m < 4 * len(hashes) else np.arange(len(hashes))
                starts = starts[(starts >= 0) & (starts + m <= len(hashes))]
                starts = starts[hits[starts + m] - hits[starts] >= need]
                doc = np.searchsorted(words, starts, side="right") - 1
                ok = starts + n <= words[doc + 1]
                starts, doc = starts[ok], doc[ok]
                if not len(starts):
                    continue
                # Fingerprints over the stretch of each cluster of windows.
                for piece in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > m) + 1):
                    for p in (piece[i : i + 2048] for i in range(0, len(piece), 2048)):
                        low, high = starts[p[0]], starts[p[-1]] + m
                        prints = _windows(np.ascontiguousarray(hashes[low:high]), starts[p] - low, m)
                        for w, item in near(found, n, prints, radius):
                            s = int(starts[p[w]])
                            value = weighted_jaccard(Counter(hashes[s : s + m].tolist()), found.counts[item])
                            if value >= similarity - 1e-12:
                                d = int(doc[p[w]])
                                entry = (-value, s - int(words[d]), n)
                                best[d, item] = min(best.get((d, item), entry), entry)
            if k < WORDS:  # such an item is one shingle, which a shorter text hasn't
                continue
            # Whole texts that are shorter than an item: m shingles and own ones share t / (1 + t) of both.
            own = np.diff(words) - k + 1
            held = np.where(own > 0, hits[np.clip(words[:-1] + own, 0, len(hashes))] - hits[np.clip(words[:-1], 0, len(hashes))], 0)
            part = similarity / (1 + similarity)
            for d in np.flatnonzero((own > 0) & (held >= part * (2 * own + 1) - 1e-9)).tolist():
                s, m = int(words[d]), int(own[d])
                mine = hashes[s : s + m]
                counts, prints = Counter(mine.tolist()), _windows(np.ascontiguousarray(mine), np.array([0]), m)
                for n in found.sizes:
                    if n - k + 1 <= m or m < similarity * (n - k + 1) - 1e-9 or held[d] < part * (m + n - k + 1) - 1e-9:
                        continue
                    for _, item in near(found, n, prints, radius):
                        value = weighted_jaccard(counts, found.counts[item])
                        if value >= similarity - 1e-12:
                            best[d, item] = (-value, 0, m + k - 1)
        for (d, item), (value, start, n) in sorted(best.items()):
            yield first + d, found.ids[item], start, n, -value


def blocks_of(items: DataFrame, size: int = BLOCK) -> Iterator[Index]:
    """The benchmark (item_id, text) in indexed blocks of about ``size`` bytes."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(held / size))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield index([(r["item_id"], r["text"]) for r in part.collect()])


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: each pair of a document and an item of which it holds a near copy.

    A null text holds nothing; null or repeated doc_ids give rows of their own,
    and so do repeated item_ids.  Items without words are left out; an item of
    fewer than five words is one shingle.  An empty benchmark or an empty table
    gives no rows.  The documents are read once for each BLOCK bytes of items.
    """
    ddl = "doc_id long,item_id long,start_word long,n_words long,similarity double"
    out = None
    for found in blocks_of(items):

        def make(batch: pa.RecordBatch, found: Index = found) -> Iterator[dict]:
            ids = batch.column(0).to_pylist()
            rows = [(ids[d], *rest) for d, *rest in passages(blobs(batch.column(1)), found, similarity, radius)]
            if rows:
                yield dict(zip(("doc_id", "item_id", "start_word", "n_words", "similarity"), zip(*rows, strict=True), strict=True))

        part = map_batches(id_and_text(docs), ddl, make)
        out = part if out is None else out.union(part)
    return out


def without_passages(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the rows whose text holds a near copy of an item; all columns are kept.

    Null and empty texts hold nothing and stay, and so do rows without a doc_id;
    rows that repeat are judged each.  An empty benchmark leaves all rows.
    """
    for found in blocks_of(items):

        def keep(batches: Iterator[pa.RecordBatch], found: Index = found) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                held = {d for d, *_ in passages(blobs(batch.column(batch.schema.get_field_index("text"))), found, similarity, radius)}
                yield batch.filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
