"""Periodic runs against brute force: every period, every stretch."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from leafmill.llm import periodic


def brute(w: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """Maximal stretches of every period, each with the smallest period that it is found with."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, exponent * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def texts(rnd: random.Random) -> list[list[bytes]]:
    out = []
    for _ in range(rnd.randint(1, 6)):
        w = [b"%d" % rnd.randrange(rnd.choice([1, 2, 3, 10])) for _ in range(rnd.randint(0, 60))]
        if w and rnd.random() < 0.5:
            w = w + w[: rnd.randint(1, 12)] * rnd.randint(1, 9) + w[: rnd.randint(0, 5)]
        out.append(w)
    return out


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 3), (9, 5)])
def test_runs_are_those_of_brute_force(least, exponent):
    rnd = random.Random(least)
    for _ in range(150):
        many = texts(rnd)
        got = [[] for _ in many]
        for t, s, n, q in zip(*(x.tolist() for x in periodic.runs(many, least, exponent)), strict=True):
            got[t].append((s, n, q))
        assert got == [brute(w, least, exponent) for w in many]


def test_agreement_beyond_the_top_level(monkeypatch):
    monkeypatch.setattr(periodic, "TOP", 3)
    rnd = random.Random(3)
    for _ in range(20):
        w = [b"%d" % rnd.randrange(2) for _ in range(50)] * rnd.randint(1, 10) + [b"a"] * rnd.randint(0, 300)
        _, s, n, q = periodic.runs([w])
        assert list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)) == brute(w)


def expected(doc_id: int | None, text: str | None) -> tuple:
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found, best, drop = brute(w), (None,) * 3, set()
    for s, m, q in found:
        if best[0] is None or m * best[2] > best[1] * q:
            best = (s, m, q)
        drop |= set(range(s + q, s + m))
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark):
    rnd = random.Random(7)
    words = ["an", "b", "ç", "d\u00a0e", "f"]
    rows = [(i, rnd.choice([" ", "\n", " \t "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 90)))) for i in range(150)]
    rows += [(i, " ".join(f"w{k}" for k in range(rnd.randint(30, 300)))) for i in range(150, 300)]  # only planted periods
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "x " * 5), (304, "x " * 6), (None, "y z " * 9), (None, None), (303, "x " * 7), (303, "x " * 7)]
    rows += [(310, "long and even " * 30_000), (311, " ".join(map(str, range(60_000))))]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, start string, n int").repartition(3)
    got = periodic.digests(periodic.planted(docs)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    small = [r for r in rows if r[0] not in (310, 311)]
    assert sorted((tuple(r) for r in got.where("doc_id is null or doc_id < 310").collect()), key=key) == sorted((expected(*r) for r in small), key=key)
    assert sum(r[1] > 0 for r in (expected(*r) for r in small)) > 20
    long = {r["doc_id"]: tuple(r)[1:6] for r in got.where("doc_id >= 310").collect()}
    assert len(long) == 2 and (zlib.crc32(b"310") % 10 == 0 or long[310] == (1, 0, 90_000, 3, 30_000_000))
    assert periodic.digests(periodic.planted(docs.limit(0))).count() == 0


def test_outputs_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "go on  and on and on and on and on\nand so on")], "doc_id long, text string")
    got = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in got["runs"]] == [(1, 10, 2)] and got["collapsed"] == "go on and so on" and got["n_words"] == 13
