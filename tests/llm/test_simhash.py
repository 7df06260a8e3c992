"""Fingerprints and near-duplicate components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from leafmill.llm import simhash_trie as S
from leafmill.llm.components import components


def plain(text: str) -> int:
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "A b C", "a b c d", "a  b\tc\x0bd\ne", "É é A", "x " * 5000])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain(text)


def brute(values: list[int], budget: int = 2) -> list[int]:
    least = list(range(len(values)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= budget:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("node", [4096, 8])
def test_links(spark, node):
    rnd = random.Random(3)
    values = {rnd.getrandbits(64) for _ in range(150)} | {0, 1, 3}
    for v in list(values)[:60]:
        for _ in range(3):
            v ^= 1 << rnd.randrange(64)
            values.add(v)
    for _ in range(150):  # one crowded ball
        v = 0xABCDEF
        for _ in range(rnd.randint(0, 4)):
            v ^= 1 << rnd.randrange(12)
        values.add(v)
    values = sorted(values)
    fps = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    found = {r.u: r.v for r in components(S.links(fps, node=node)).collect()}
    mine = [found.get(x, x) for x in (int(np.uint64(v).astype(np.int64)) for v in values)]
    want = brute(values)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_documents(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, None), (8, ""), (7, "q w e r t y u i o p"), (7, "q w e r t y u i o p"), (None, "lonely text here now")]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    fp = lambda t: f"{plain(t or ''):016x}"
    assert got == {(5, fp(rows[0][1]), 3), (3, fp(rows[0][1]), 3), (9, "0" * 16, 8), (8, "0" * 16, 8), (7, fp(rows[4][1]), 7), (None, fp(rows[6][1]), None)}
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]
    assert S.near_duplicates(docs.limit(0)).count() == 0 == S.one_of_each(docs.limit(0)).count()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.u: r.v for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
