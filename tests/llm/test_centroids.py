"""Centroid clustering against plain Lloyd rounds."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from leafmill.llm import centroids as C


def lloyd(rows: list[tuple], k: int = 8, rounds: int = 10) -> dict:
    kept = [(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    z = [r[1] for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(z))

    for _ in range(rounds):
        own: dict[int, list] = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        z = [tuple(sum(x) // len(own[j]) for x in zip(*own[j], strict=True)) if j in own else c for j, c in enumerate(z)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, c in last if c == j) for j in range(k)}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for i, d, c in last), key=str)


def cloud(rnd: random.Random, n: int) -> list[tuple]:
    middles = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [float(np.float32(m + rnd.gauss(0, 0.2))) for m in rnd.choice(middles)]) for i in range(n)]


DDL = "vec_id long, embedding array<float>, label int, q string"


def digests(spark, rows):
    got = C.digests(spark.createDataFrame([(*r, 0, "clash") for r in rows], DDL).repartition(3))
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_against_lloyd(spark, monkeypatch):
    rnd = random.Random(1)
    rows = cloud(rnd, 150)
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # one vector many times
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[7][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] * 64), (306, [float("inf")] * 64), (307, [1e30] * 64)]
    fine = [r for r in rows if r[0] != 307]
    want = lloyd(fine)
    assert digests(spark, rows) == want
    monkeypatch.setattr(C, "FAST", 0)
    assert digests(spark, rows) == want


def test_few_equal_and_no_vectors(spark):
    rnd = random.Random(2)
    for rows in (cloud(rnd, 3), [(i, [0.5] * 64) for i in range(20)], []):
        assert digests(spark, rows) == lloyd(rows)


@pytest.mark.parametrize("dim", [1, 2, 64])
def test_filtering_assigns_like_brute_force(dim):
    rng = np.random.default_rng(dim)
    whole = 0
    for size in (1, 31, 33, 500, 4096):
        for spread in (2, 40, 100_000):
            x = (rng.integers(-spread, spread, (size, dim)) // (1 + (rng.integers(0, 3, (size, 1)) == 0) * spread)).astype(np.int32)
            order, nodes = C.tree(x)
            x = x[order]
            first, last = C._node_bounds(size)
            for a, z, lo, hi, s, q in zip(first, last, nodes["lo"], nodes["hi"], nodes["sum"], nodes["square"], strict=True):
                y = x[a:z].astype(np.int64)
                assert (y.min(0) == lo).all() and (y.max(0) == hi).all() and (y.sum(0) == s).all() and (y * y).sum() == q
            c = C._distinct(rng.integers(-spread, spread, (8, dim)))[0]
            got = np.full(size, -1)
            for kind, at, cluster in C.filtered(x, {k: v.astype(np.int64) for k, v in nodes.items() if k != "square"}, c):
                for i, j in zip(at, cluster, strict=True):
                    rows = slice(first[i], last[i]) if kind == "whole" else slice(i, i + 1)
                    assert (got[rows] == -1).all()
                    got[rows] = j
                    whole += kind == "whole"
            far = ((x[:, None].astype(np.int64) - c) ** 2).sum(-1)
            assert (got == far.argmin(1)).all()
    assert whole > (0 if dim == 64 else 50)


def test_large_components_are_exact():
    x = np.array([[C.BOUND - 1] * 64, [-C.BOUND] * 64], np.int32)
    assert C.distances(x, x.astype(np.int64)).tolist() == [[0, 64 * (2 * C.BOUND - 1) ** 2], [64 * (2 * C.BOUND - 1) ** 2, 0]]
