"""Token counts, prefix tables and packing against the library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from leafmill.llm import packing, tokens

ODD = [
    "", " ", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "\xa0x y\x85z\x1cq", "é ́ à", "İSTANBUL ΣΑΣ ς don't I'LL 'S", "日本語 テスト１２３ ½", "🙂🙂 a👨‍👩‍👧b", "H̱x Ẍ. İ.",
    "WORD%%% x's. 5. a5,, é.! ×. a×. ß. ª. º!", "x" * 70 + " " + "ab" * 200, "a\x00b\tc\r\nd",
]


@pytest.fixture(scope="module")
def known():
    return tokens.chunks_of(tokens.VOCABULARY)


def library(known, text):
    return known.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_the_library_s(known):
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice("abszAZéÉßñÑ×÷ªº.,!%'5½ \n<|>…—") for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    texts += ["".join(rnd.choice("abcdeéßñthsengionlr") for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    for text, ids in zip(texts, known.each([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library(known, text), repr(text)


@pytest.mark.parametrize("pair", ["be", "x7"])
def test_chunks_that_collide_under_polynomial_hashes(known, pair):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts = ["".join(pair[x] for x in bits), "".join(pair[1 - x] for x in bits)]
    assert [ids.tolist() for ids in known.each([" ".join(texts).encode(), *(t.encode() for t in texts)])] == [library(known, t) for t in (" ".join(texts), *texts)]


def test_chunks_are_forgotten(known, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 20)
    texts = [" ".join(f"word{i}x{j}" for j in range(9)) for i in range(30)]
    for text, ids in zip(texts, known.each([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library(known, text)


def test_prefixes(known):
    text = "The first words, and then 12 more don't fit"
    sizes = next(known.counts([text.encode()]))
    counts, ends = tokens.prefix_counts(sizes), tokens.chunk_ends(text.encode())
    for n, end in zip(counts, ends, strict=True):
        assert n == len(library(known, text.encode()[:end].decode()))
    for budget in range(counts[-1] + 2):
        fit = tokens.fits(counts, ends, budget)
        assert len(library(known, text[:fit])) <= budget


def test_counts(spark, known):
    given = [*enumerate(ODD), (None, None), (3, "again")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in given], "doc_id long, text string, n_tokens int")
    want = Counter((i, len((t or "").encode()), n := len(library(known, t or "")), n > 5) for i, t in given)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, limit=5).collect()) == want
    assert tokens.token_counts(docs.limit(0)).count() == 0 == tokens.prefix_table(docs.limit(0)).count()


def test_stored_prefix_rows(spark, known):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["a", "storm", "xyzzy's", "é.", "日本語", "\n\n", "12"]) for _ in range(rnd.choice([0, 1, 30, 3000]))) for _ in range(12)] + [" \t ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = tokens.prefix_table(docs)
    for r in rows.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.ends[0] == r.counts[0] == 0 and len(r.ends) == len(r.counts) == len(raw.split()) + 1
        for k in {0, len(r.ends) // 2, len(r.ends) - 1}:
            assert r.counts[k] == len(library(known, raw[: r.ends[k]].decode()))
    for budget in (0, 7, 2000, 10**6):
        for r in tokens.within(rows, budget).collect():
            text = texts[r.doc_id] or ""
            assert r.n_tokens == len(library(known, text)) and r.over_limit == (r.n_tokens > budget)
            fit = text.encode()[: r.fit_bytes].decode()
            assert len(library(known, fit)) <= budget and (not r.over_limit or len(library(known, f"{fit} {text.encode()[r.fit_bytes :].split()[0].decode()}")) > budget)


def test_bytes_that_are_not_utf8(spark, known):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61ff62') as string) as text")
    assert [tuple(r)[:3] for r in tokens.token_counts(docs).collect()] == [(1, 3, len(library(known, "a\ufffdb")))]


def test_packing(spark, known):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["a", "storm", "over", "xyzzy", "é"]) for _ in range(rnd.choice([0, 3, 40, 700, 5000])))) for i in range(60)] + [(7, "same"), (7, "same"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, offset int")
    out = packing.packed(docs, per_task=40).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for p in out:
        sequences[p.sequence_id].append((p.offset, p.length))
        pieces[p.doc_id].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for i, t in rows[:60]:
        if i == 7:
            continue
        ids, at = np.array([*library(known, t), 2], "<u4"), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert len(pieces[None]) == 1 and pieces[None][0].length == 1
    assert packing.packed(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest():
    rnd = random.Random(6)
    fit, left = packing.BestFit(50), []
    for n in sorted((rnd.randint(1, 50) for _ in range(400)), reverse=True):
        sequence, offset = fit.put(n)
        room = [x for x in left if x >= n]
        if room:
            assert 50 - offset == min(room)
            left.remove(min(room))
        else:
            assert offset == 0
        if 50 - offset - n:
            left.append(50 - offset - n)
