"""The pipeline's near-copy stage against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
from leafmill.llm import near_copies


def test_near_copies(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(21)
    words = ["".join(rnd.choice("aeioustnrl") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([30, 60, 100])))) for i in range(60)]
    for i in range(60):
        for j in range(3):  # copies with one to four words changed, some under and some over the similarity
            w = docs[i][1].split()
            for k in rnd.sample(range(len(w)), rnd.randint(1, 4)):
                w[k] = rnd.choice(words)
            docs.append((100 + 3 * i + j, " ".join(w)))
    docs += [(402, docs[2][1] + "."), (7, docs[8][1] + " x"), (7, "another text under an id that is taken"), (500, ""), (501, " \n"), (502, "a b"), (503, "A  b"), (5, docs[5][1]), (None, docs[1][1]), (504, None)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")

    rows = sorted({(i, t or "") for i, t in docs if i is not None})
    cut = [t.lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in cut]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] == sets[y] or 5 * both >= 4 * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    want = sorted([rows[x][0] for x in range(len(rows)) if top(x) == x])
    out = near_copies.one_of_each(frame)
    got = out.collect()
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want and sum(r.doc_id is None for r in got) == 1
    stage = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame, str(tmp_path)).collect()}
    assert 402 not in {i for i, _ in stage} and (7, "another text under an id that is taken") in stage
    assert 100 < len(want) < 240
    assert sorted(r.doc_id for r in near_copies.one_of_each(frame, block=60).collect() if r.doc_id is not None) == want  # every key in several blocks
    assert near_copies.one_of_each(frame.limit(0)).count() == 0


def test_a_cloud_of_copies(spark):
    """Copies of one text of which most are under the similarity to each other, and share keys all the same."""
    rnd = random.Random(22)
    words = ["".join(rnd.choice("aeioustnrl") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    base, docs = [rnd.choice(words) for _ in range(120)], []
    for i in range(150):
        w = list(base)
        for k in rnd.sample(range(len(w)), rnd.randint(1, 7)):
            w[k] = rnd.choice(words)
        docs.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(docs)):
        for y in range(x):
            if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    want = sorted(i for i in range(len(docs)) if top(i) == i)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(want) > 3
    for block in (1 << 20, 1500):
        assert sorted(r.doc_id for r in near_copies.one_of_each(frame, block=block).collect()) == want


def test_shingles():
    texts = [b"", b" \n", b"A b", b"a  B", b"one two three four five", b"x " * 500, "É é a b c d".encode()]
    sets = near_copies.shingles(texts)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 1, 2] and sets[2][0] == sets[3][0]


def test_the_trie_brings_near_copies_together(spark):
    rnd = random.Random(21)
    texts = [" ".join(f"{rnd.randrange(10**6):x}" for _ in range(2000)) for _ in range(40)]
    texts += [texts[3] + " more", texts[5] + " x y", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = near_copies._marked(docs).select("doc_id", "key", "fp", "n").cache()
    at = {r.key: r.doc_id for r in marked.collect()}
    assert {frozenset((at[r.u], at[r.v])) for r in near_copies.by_trie(marked).collect()} == {frozenset((3, 40)), frozenset((5, 41))}
    assert near_copies.simhash(np.empty(0, np.uint64)) == 0
