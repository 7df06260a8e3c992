"""SimHash near duplicates by a binary-trie self-join (operator 1).

The distinct fingerprints form a binary trie.  Pairs of its nodes are walked
down together; each step adds the bit in which the two nodes differ, and a pair
whose sum passes the error budget is dropped with all below it.

Spark walks the upper levels: a row is a fingerprint that stands at a node,
either as the node's own or, with some of its budget spent, as the visitor of a
node that differs in one or two bits.  Nodes that still hold many fingerprints
go on down, the others are finished inside a task.  Bits are taken in the order
of how evenly they split the corpus.  A task returns a spanning forest of the
links it finds, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leafmill.llm.common import blobs, id_and_text, map_batches, settle, table
from leafmill.llm.components import components

BUDGET = 2
WORDS = 3
#: Fingerprints of its own that one node should hold at most; Spark walks on down where a node and its visitors hold more than
#: CROWD times as many.  A single fingerprint, the lowest node, has no more visitors than there are values within the budget:
#: 2,080 for two bits.
NODE, CROWD = 4096, 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[words - 1 :] or [len(line)]
    hashes = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))  # noqa: B905  ends has words - 1 fewer
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a long. A null text counts as empty."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        fps = np.array([fingerprint(t, words) for t in blobs(batch.column(1))], np.uint64)
        yield {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

    return map_batches(id_and_text(docs), "doc_id long,fp long", make)


def _bits(fp: Column, order: list[int]) -> Column:
    """The bits of ``order`` as a number, the first one highest."""
    out = F.lit(0).cast("long")
    for b in order:
        out = out.bitwiseOR(F.shiftleft(F.shiftright(fp, b).bitwiseAND(F.lit(1).cast("long")), len(order) - 1 - order.index(b)))
    return out


def _walk(rows: DataFrame, order: list[int], budget: int) -> DataFrame:
    """Node pairs one stride further down: rows (path, own, spent, fp) at the children they can still reach.

    Of two nodes under one parent only the lower one's fingerprints visit the
    other; visitors go wherever their budget lets them.
    """
    masks = [sum(1 << b for b in c) for k in range(budget + 1) for c in combinations(range(len(order)), k)]
    here = rows.select("*", _bits(F.col("fp"), order).alias("child"))
    here = here.select("*", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    here = here.select("path", "own", "fp", "child", "mask", (F.col("spent") + F.bit_count("mask")).cast("int").alias("spent")).where(f"spent <= {budget}")
    child = F.col("child").bitwiseXOR(F.col("mask"))
    here = here.where(~F.col("own") | (child >= F.col("child")))
    return here.select(F.xxhash64("path", child).alias("path"), (F.col("own") & (F.col("mask") == 0)).alias("own"), "spent", "fp")


def permuted(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """Bits in the order of the walk, first one highest."""
    out = np.zeros(len(fps), np.uint64)
    for b in order:
        out = (out << np.uint64(1)) | ((fps >> np.uint64(b)) & np.uint64(1))
    return out


def trie_pairs(a: np.ndarray, b: np.ndarray | None, budget: int, leaf: int = 16, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs within ``budget`` bits of each other, of sorted distinct values a and b (None: a with itself).

    Walks pairs of trie nodes, as index ranges, level by level; at most
    ``most`` pairs of nodes are open at one time in each level.
    """
    alone = b is None
    b = a if alone else b
    if not len(a) or not len(b):
        return
    ones = {}

    def ones_to(k: int, depth: int, x: np.ndarray) -> np.ndarray:
        if (k, depth) not in ones:
            ones[k, depth] = np.append(0, np.cumsum((x >> np.uint64(63 - depth)) & np.uint64(1))).astype(np.int64)
        return ones[k, depth]

    stack = [(0, np.array([[0, len(a), 0, len(b), budget]]))]
    while stack:
        depth, open_ = stack.pop()
        if len(open_) > most:
            stack += [(depth, open_[i : i + most]) for i in range(0, len(open_), most)]
            continue
        a0, a1, b0, b1, left = open_.T
        small = ((a1 - a0) * (b1 - b0) <= leaf) | (depth == 64)
        if small.any():
            s = open_[small]
            wide = s[:, 3] - s[:, 2]
            n = (s[:, 1] - s[:, 0]) * wide
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(wide, n)
            i, j = np.repeat(s[:, 0], n) + at // wide, np.repeat(s[:, 2], n) + at % wide
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if alone:
                near &= i < j
            yield i[near], j[near]
            open_ = open_[~small]
        if not len(open_):
            continue
        a0, a1, b0, b1, left = open_.T
        na, nb = ones_to(0, depth, a), ones_to(1, depth, b)
        am, bm = a1 - (na[a1] - na[a0]), b1 - (nb[b1] - nb[b0])
        below = [(a0, am, b0, bm, left), (am, a1, bm, b1, left), (a0, am, bm, b1, left - 1), (am, a1, b0, bm, left - 1)]
        if alone:  # a node with itself: its two mixed pairs are one
            same = a0 == b0
            below[3] = tuple(x[~same] for x in below[3])
        nxt = np.concatenate([np.column_stack(x) for x in below])
        stack.append((depth + 1, nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] >= 0)]))


def forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(n)
    for u, v in links:
        while True:
            x, y = root[u], root[v]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


def links(fps: DataFrame, budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp: long) with the components of all pairs within ``budget`` bits."""
    tally = fps.agg(F.count("*").alias("n"), *[F.sum(F.shiftright("fp", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]).first()
    n = tally["n"]
    order = sorted(range(64), key=lambda b: (abs(2 * (tally[f"b{b}"] or 0) - n), b))
    depth = min(16, max(0, math.ceil(math.log2(max(1, n) * 4 / node))))
    rows = fps.select(F.lit(0).cast("long").alias("path"), F.lit(True).alias("own"), F.lit(0).alias("spent"), "fp")
    rows, done, taken = _walk(rows, order[:depth], budget) if depth else rows, [], depth
    while taken < 64 and n > node:
        rows = settle(rows)
        full = rows.groupBy("path").agg(F.count("*").alias("held"), F.max("own").alias("owned"))
        full = settle(full.where("owned").select("path", "held"))  # nodes without a fingerprint of their own need no visitors
        rows = rows.join(full, "path")
        done.append(rows.where(F.col("held") <= CROWD * node).drop("held"))
        rows = rows.where(F.col("held") > CROWD * node).drop("held")
        if full.where(F.col("held") > CROWD * node).isEmpty():
            rows = None
            break
        rows = _walk(rows, order[taken : taken + 6], budget)
        taken += 6
    if rows is not None:
        done.append(rows)
    at_nodes = done[0]
    for x in done[1:]:
        at_nodes = at_nodes.union(x)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["own"].to_numpy()
        fp = rows["fp"].to_numpy().view(np.uint64)
        names = np.concatenate([fp[own], fp[~own]])
        value = permuted(names, order)
        k = int(own.sum())
        first, second = np.argsort(value[:k]), np.argsort(value[k:])
        a, b = value[:k][first], value[k:][second]
        found = [(first[i], first[j]) for i, j in trie_pairs(a, None, budget)]
        found += [(first[i], k + second[j]) for i, j in trie_pairs(a, b, budget)]
        root = forest(len(names), found)
        u = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"u": names[u].view(np.int64), "v": names[root[u]].view(np.int64)})

    return at_nodes.select("path", "own", "fp").groupBy("path").applyInPandas(pairs, "u long, v long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, words: int = WORDS, node: int = NODE) -> DataFrame:
    """Operator 1's contract: doc_id, fingerprint, component_id; then n_alike, documents of the component.

    Rows that repeat, and texts without words, are linked like any others.  A
    null doc_id never names a component, unless all of its documents lack one.
    """
    marked = settle(fingerprints(docs, words))
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("held")))
    roots = components(links(classes.select("fp"), budget, node)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = classes.join(roots, "fp", "left").select("fp", "least", "held", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("held").alias("n_alike"))
    named = settle(rooted.select("fp", "root").join(settle(named), "root").drop("root"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_alike")


def one_of_each(docs: DataFrame, budget: int = BUDGET, words: int = WORDS) -> DataFrame:
    """docs with the smallest doc_id of each component; rows that repeat doc_id and text count once, rows without a doc_id stay.

    Of different texts under that doc_id every one that lies in the component stays.
    """
    keep = near_duplicates(docs.where("doc_id is not null"), budget, words).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns).union(docs.where("doc_id is null"))


def op1_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
