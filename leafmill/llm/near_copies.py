"""Near copies by five-word similarity, for the pipeline's second stage.

Documents of one shingle set are one class.  The binary-trie self-join of operator
1 links the SimHashes of the sets that differ in at most two bits, and the classes
that it brings together are compared.  At a similarity of 0.8 SimHashes lie about 10
bits apart (24 with four deviations), and within so many bits a trie prunes next
to nothing, so what lies further apart is found by min-hashes of the shingle set:
BANDS keys of ROWS minima each.  A pair of similarity J shares no key with
probability (1 - J ** ROWS) ** BANDS, 2 in a million at 0.8 and less above.
An exact Jaccard similarity over the sets of shingles decides on all of them.

Besides the trie's pairs, classes are first compared with the
least class of their keys: each with one hub, then, where that one did not link
them, with the hubs of their other keys.  Under keys whose classes are not all
linked by then, those outside the largest component visit the others: a key's
classes are dealt out in blocks, visitors go through every block of their key,
and a task returns links only, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leafmill.llm import runs, simhash_trie
from leafmill.llm.common import blobs, map_batches, release, settle, sliced, unsqueezed
from leafmill.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 4
#: Shingles of the classes that a block holds, about.
BLOCK = 1 << 20

_TURNS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Distinct hashes, ascending, of each text's word shingles, A-Z as a-z; a shorter text is one shingle, one without words has none."""
    out: list[np.ndarray] = []
    for _, _, joined, bounds in runs.joined([t.lower() for t in texts]):
        units, cuts = runs.word_units(joined, bounds)
        span = runs.Prefix(units)
        at = np.arange(max(0, len(units) - words + 1))
        hashes = span(at, at + words)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if z - a >= words:
                out.append(np.unique(hashes[a : z - words + 1]))
            else:
                out.append(span(np.array([a]), np.array([z])) if z > a else np.empty(0, np.uint64))
    return out


def keys(hashes: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, np.multiply.outer(_TURNS, hashes[i : i + 1024]).min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles as a signed number; 0 for an empty set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def mark_of(key: int) -> int:
    """The lower 32 bits of a key, as a signed number: what tells the keys of two classes apart where many are compared."""
    return int(np.array(key, np.int64).astype(np.int32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, h, key, fp, n, bands, marks, text): key names the shingle set, fp is its SimHash, n its size, marks are the keys' lower halves, text is a Zstandard frame."""
    import zstandard

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=1).compress
        texts = blobs(batch.column(1))
        sets = shingles(texts)
        named = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        bands = [keys(s) for s in sets]
        yield {"doc_id": batch.column(0), "h": batch.column(2), "key": named, "fp": [simhash(s) for s in sets], "n": [len(s) for s in sets], "bands": bands, "marks": [b.astype(np.int32).tobytes() for b in bands], "text": [pack(t) for t in texts]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    return map_batches(rows, "doc_id long,h long,key long,fp long,n int,bands array<long>,marks binary,text binary", make)


def by_trie(classes: DataFrame, budget: int = simhash_trie.BUDGET) -> DataFrame:
    """(u, v): the least class of each component of SimHashes (fp) that differ in at most ``budget`` bits, with the component's other classes (key); a settled table."""
    named = settle(classes.where("n > 0").select("key", "fp"))
    roots = components(simhash_trie.links(named.select("fp").distinct(), budget)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = settle(named.join(roots, "fp", "left").select("key", F.coalesce("root", "fp").alias("root")))
    least = settle(rooted.groupBy("root").agg(F.min("key").alias("u"), F.count("*").alias("held")).where("held > 1").drop("held"))
    out = settle(rooted.join(least, "root").where("key <> u").select("u", F.col("key").alias("v")))
    release(named, rooted, least)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of classes that are as similar as that."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.append(True, u[1:] != u[:-1])  # rows come by u: its set is made once
        first = shingles(unsqueezed(batch.column(2).filter(pa.array(new))))
        of, second = np.cumsum(new) - 1, shingles(unsqueezed(batch.column(3)))
        near = np.array([jaccard(first[i], b) >= similarity - 1e-12 for i, b in zip(of.tolist(), second, strict=True)], bool)
        yield {"u": u[near], "v": v[near]}

    first, second = texts.select(F.col("key").alias("u"), F.col("text").alias("a")), texts.select(F.col("key").alias("v"), F.col("text").alias("b"))
    return map_batches(pairs.join(second, "v").join(first, "u").select("u", "v", "a", "b"), "u long,v long", make)


def _rooted(at: DataFrame, found: DataFrame) -> DataFrame:
    """at (band, key, n, hub) with the root of each key's component."""
    roots = components(found).select(F.col("u").alias("key"), F.col("v").alias("root"))
    return at.join(roots, "key", "left").select("band", "key", "n", "hub", F.coalesce("root", "key").alias("root"))


def _visits(similarity: float):
    """Rows come by band and block, first the block's own classes, then the visitors: the links between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own = None, []
        for batch in sliced(batches, 1 << 20):
            names = {x: batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("band", "block", "visits", "key", "root", "loose", "n", "marks")}
            sets = shingles(unsqueezed(batch.column(batch.schema.get_field_index("text"))))
            found = []
            for band, block, visits, key, root, loose, n, marks, mine in zip(*names.values(), sets, strict=True):
                if here != (band, block):
                    here, own, table = (band, block), [], None
                marks = np.frombuffer(marks, np.int32)
                if not visits:
                    own.append((key, root, loose, n, marks, mine))
                    continue
                if not own:
                    continue
                if table is None:
                    table = [np.array([x[k] for x in own]) for k in range(5)]
                near = (table[1] != root) & (np.minimum(table[3], n) >= (similarity - 1e-12) * np.maximum(table[3], n)) & (~table[2] | (table[0] > key))
                at = np.flatnonzero(near)
                if len(at):  # a pair is looked at under the first key that it shares
                    at = at[marks[(table[4][at] == marks).argmax(axis=1)] == mark_of(band)]
                linked = set()
                for i in at.tolist():
                    if own[i][1] not in linked and jaccard(mine, own[i][5]) >= similarity - 1e-12:
                        linked.add(own[i][1])
                        found.append((key, own[i][0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def links(marked: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(u, v): links between classes (key, fp, n, bands) with the components of all pairs as similar as that; a settled table."""
    at = classes.select("key", "n", F.explode("bands").alias("band"))
    shared = settle(at.groupBy("band").agg(F.count("*").alias("held"), F.min("key").alias("hub")).where("held > 1").drop("held"))
    at = settle(at.join(shared, "band"))
    alike = by_trie(classes)
    wanted = at.select("key").union(alike.select("u")).union(alike.select("v")).distinct()
    texts = settle(marked.join(wanted, "key", "left_semi").select("key", "marks", "text").dropDuplicates(["key"]))
    first = settle(at.where("key <> hub").groupBy("key").agg(F.min("hub").alias("u")).select("u", F.col("key").alias("v")))
    near = settle(_verified(alike.union(first).distinct(), texts, similarity))
    known = settle(_rooted(at, near))
    hubs = settle(known.where("key = hub").groupBy(F.col("key").alias("hub")).agg(F.min("root").alias("hub_root")))
    stars = known.where("key <> hub").join(hubs, "hub").where("root <> hub_root").select(F.col("hub").alias("u"), F.col("key").alias("v")).distinct()
    found = settle(near.union(_verified(stars.join(first, ["u", "v"], "left_anti"), texts, similarity)))
    release(shared, alike, first, near, known, hubs)
    known = settle(_rooted(at, found))
    mixed = known.groupBy("band", "root").agg(F.count("*").alias("held"), F.sum("n").alias("n")).groupBy("band").agg(F.max(F.struct("held", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("n"))
    mixed = settle(mixed.where("roots > 1").select("band", F.col("most.root").alias("most"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    open_ = known.join(mixed, "band").select("band", "key", "n", "root", "blocks", (F.col("root") != F.col("most")).alias("loose"))
    own = open_.select("*", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), F.lit(False).alias("visits"))
    visitors = open_.where("loose").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visits"))
    dealt = own.union(visitors).drop("blocks").join(texts, "key")
    dealt = dealt.repartition("band", "block").sortWithinPartitions("band", "block", "visits", "key")
    out = settle(found.union(dealt.mapInArrow(_visits(similarity), "u long,v long")))
    release(at, texts, found, known, mixed)
    return out


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """docs with the row of the smallest doc_id of each group of near copies, chains followed.

    Rows that repeat doc_id and text count once; different texts under one
    doc_id are compared like any others; rows without a doc_id stay.  All texts
    without words are one group.
    """
    marked = settle(_marked(docs.where("doc_id is not null")))
    classes = settle(marked.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    linked = links(marked, classes, similarity, block)
    roots = settle(components(linked).select(F.col("u").alias("key"), F.col("v").alias("root")))
    keep = classes.select("key", "least").join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("least").alias("least"))
    keep = settle(keep.select(F.col("least.doc_id").alias("kept_id"), F.col("least.h").alias("kept_hash")))
    release(marked, classes, linked, roots)
    same = (docs["doc_id"].cast("long") == F.col("kept_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("kept_hash"))
    return docs.join(keep, same, "left_semi").dropDuplicates(["doc_id", "text"]).union(docs.where("doc_id is null"))
