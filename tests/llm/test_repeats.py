"""Byte and word repeats against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from leafmill.llm import suffix_repeats, word_repeats

DOCS = "doc_id long, text string, lo string, n int"


def corpus(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 200))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, rnd.choice(base)) for i in range(8)]  # copies
    for i in range(30):  # near copies, pieces, repeats in one text
        t = rnd.choice(base).split()
        for _ in range(2):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((200 + i, " ".join(t[rnd.randrange(5) :]) + rnd.choice(["\n", " "]) + rnd.choice(base)))
    rows += [(300, "a" * 500), (301, "ab" * 300), (302, "a" * 150 + "b" + "a" * 99), (303, ""), (304, "x" * 99), (305, " \n\t "), (306, "one two " * 40), (307, "two one " * 40)]
    rows += [(308, " ".join(rnd.choice(words) for _ in range(9000)))]
    return rows


def bytes_removed(rows: list[tuple]) -> dict:
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        hit = bytearray(len(t))
        for s in range(len(t) - 99):
            if (w := t[s : s + 100]) in seen:
                hit[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, h in zip(t, hit, strict=True) if not h)
        out[i] = (len(t), sum(hit), sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit)), hashlib.sha256(kept).hexdigest())
    return out


def words_removed(rows: list[tuple]) -> dict:
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        w = t.split()
        hit, own = [False] * len(w), set()
        for s in range(len(w) - 12):
            k = tuple(w[s : s + 13])
            own.add(k)
            if k in seen:
                hit[s : s + 13] = [True] * 13
        seen |= own
        out[i] = (len(w), sum(hit), hashlib.sha256(b" ".join(x for x, h in zip(w, hit, strict=True) if not h)).hexdigest())
    return out


@pytest.mark.parametrize("runs", [suffix_repeats.RUNS, 2])  # 2: groups take the distributed passes
def test_bytes(spark, monkeypatch, runs):
    monkeypatch.setattr(suffix_repeats, "RUNS", runs)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffix_repeats.digests(docs).collect()}
    assert got == bytes_removed(rows)


def test_words(spark):
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(5)
    assert {r[0]: tuple(r)[1:] for r in word_repeats.digests(docs).collect()} == words_removed(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, long), (2, long), (3, long), (None, long), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed) for r in suffix_repeats.digests(docs).collect())
    n = len(long)
    assert got == [(-1, 0, 0), (-1, n, 0), (1, 0, 0), (2, n, 0), (2, n, 0), (3, n, n), (4, 0, 0)]
    assert sorted(r.n_removed for r in word_repeats.digests(docs).collect()) == [0, 0, 0, 0, 0, 0, 60]
    cleaned = suffix_repeats.cleaned(docs)
    assert cleaned.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in cleaned.collect())[-2:] == [(3, ""), (4, "")]
    empty = docs.limit(0)
    assert suffix_repeats.digests(empty).count() == word_repeats.digests(empty).count() == suffix_repeats.cleaned(empty).count() == 0


def test_characters_stay_whole(spark):
    a = "".join(chr(0x400 + i) for i in range(60)) + "x"
    docs = spark.createDataFrame([(1, "12345" + a, 0), (2, a + "zz", 0)], "doc_id long, text string, n_chars long").select("text", "n_chars", "doc_id")
    rows = {r.doc_id: r for r in suffix_repeats.cleaned(docs).collect()}
    assert rows[2].text == "zz" and rows[2].n_chars == 2 and rows[1].text == "12345" + a


def thue_morse(a: str, b: str, n: int = 1024) -> tuple[str, str]:
    """Two complementary Thue-Morse words: no polynomial hash modulo 2**64 tells them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_that_collide_under_polynomial_hashes(spark):
    one, two = thue_morse("b", "e")
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, one), (4, two), (5, "z" * 50 + one + "y" * 50), (6, "z" * 50 + two + "y" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in word_repeats.digests(docs).collect()} == words_removed(rows)
    assert {r[0]: tuple(r)[1:] for r in suffix_repeats.digests(docs).collect()} == bytes_removed(rows)


@pytest.mark.parametrize("runs", [suffix_repeats.RUNS, 2])
def test_rows_of_one_id(spark, monkeypatch, runs):
    monkeypatch.setattr(suffix_repeats, "RUNS", runs)
    rnd = random.Random(3)
    say = lambda n: " ".join(f"{rnd.randrange(10**6):x}" for _ in range(n))
    a, b, c = say(60), say(60), say(20)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, c + a[100:300] + c), (3, c + a[100:300] + c), (4, say(5) + a[150:280] + say(5))], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_repeats.digests(docs).collect())
    third = 2 * len(c) + 200
    repeated = 200 + len(c) if len(c) >= 100 else 200
    fourth = next(x for x in got if x[0] == 4)
    assert got[:6] == sorted([(1, len(a), 0), (2, len(a), len(a)), (2, len(b), 0), (2, len(b), 0), (3, third, repeated), (3, third, repeated)]) and fourth[2] == 130
    words = sorted((r.doc_id, r.n_words, r.n_removed) for r in word_repeats.digests(docs).collect())
    assert words[:4] == sorted([(1, 60, 0), (2, 60, 60), (2, 60, 0), (2, 60, 0)])


def test_a_passage_in_half_of_all_rows(spark):
    """One key holds half of the rows: results as by brute force, and AQE splits the join back."""
    rnd = random.Random(5)
    say = lambda n: " ".join(f"{rnd.randrange(10**6):x}" for _ in range(n))
    hot = say(40)
    rows = [(i, f"{say(12)} {hot} {say(12)}" if i % 2 else say(30)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r[0]: tuple(r)[1:] for r in suffix_repeats.digests(docs).collect()} == bytes_removed(rows)
    assert {r[0]: tuple(r)[1:] for r in word_repeats.digests(docs).collect()} == words_removed(rows)
