"""Quality rules against brute force; toxicity on a planted corpus, by held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from leafmill.llm import quality, toxicity


def rules(text: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, windows, hit = len(w), Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if windows[x] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality(spark):
    rnd = random.Random(7)
    good = [" ".join(rnd.choice("the of river stone and light by over field rain or sand".split()) for _ in range(80)) for _ in range(40)]
    bad = [" | ".join(f"j{rnd.randrange(400)}" for _ in range(80)) for _ in range(20)]
    odd = ["", " \n\n ", "a", "a b c", "a b c d", "x y z x y z x y z", "a\na\n\nb\n a\na", "é\xa0#\x0b\x0c%&é <|> ", "to be " * 60, "l\n" * 3]
    rows = list(enumerate(good + bad + odd)) + [(900, None), (None, "null id " * 30), (3, good[3])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, w string")
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    got = quality.quality(docs, trusted).collect()
    assert len(got) == len(rows)
    want = Counter((i, *rules(t or "")) for i, t in rows)
    assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] or rules(good[i])[-1] for i in range(40)) and not any(kept[i] for i in range(40, 60))
    assert quality.quality(docs.limit(0), trusted).count() == 0
    alone = quality.quality(docs, trusted.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in alone)


def test_quality_scores(spark):
    """Scores and verdicts against the multinomials written out in Python; only the hashes are Spark's."""
    import math
    import statistics

    rnd = random.Random(15)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rnd.choice(vocabulary[: 30 if i < 25 else 60]) for _ in range(rnd.randint(50, 90))) for i in range(60)} | {60: "", 61: "w1"}
    docs, trusted = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    n = 97
    words = sorted({w for t in texts.values() for w in t.split()})
    pairs = sorted({p for t in texts.values() for p in zip(t.split(), t.split()[1:], strict=False)})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"pmod(xxhash64(w), {n}) as b").collect()}
    bucket |= {(r.a, r.z): r.b for r in spark.createDataFrame(pairs, "a string, z string").selectExpr("a", "z", f"pmod(xxhash64(a, z), {n}) as b").collect()}
    grams = {i: [bucket[g] for g in (*t.split(), *zip(t.split(), t.split()[1:], strict=False))] for i, t in texts.items()}
    raw, target = Counter(range(n)), Counter(range(n))
    for i, g in grams.items():
        raw.update(g)
        if i < 20:
            target.update(g)
    ratio = [math.log(target[b] / target.total()) - math.log(raw[b] / raw.total()) for b in range(n)]
    want = {i: sum(ratio[b] for b in g) / len(g) if g else 0.0 for i, g in grams.items()}
    failed = {i: rules(t)[-1] for i, t in texts.items()}
    sound = [want[i] for i in range(20) if not failed[i]]
    threshold = statistics.mean(sound) - quality.DEVIATIONS * statistics.pstdev(sound)
    for r in quality.quality(docs, trusted, buckets=n).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.kept == (not failed[r.doc_id] and want[r.doc_id] >= threshold)


def test_toxicity(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeioustnrl") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        t = [rnd.choice(words) for _ in range(rnd.randint(10, 120))]
        if toxic:
            for _ in range(rnd.randint(2, 4)):
                t.insert(rnd.randrange(len(t)), rnd.choice(["idiot", "moron,", "zogvat" + rnd.choice(words), "Scum."]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, None, 1), (5000, "", 1), (0, rows[0][1], 1)], "doc_id long, text string, toxic int")
    marks = spark.createDataFrame([*labels, (None, 1), (77, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == 903
    truth = dict(labels)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    stage = toxicity.without_toxic(docs, marks)
    assert stage.columns == docs.columns and stage.where("doc_id is null").count() == 1
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert toxicity.toxicity(docs, marks.limit(0)).where("predicted = 1").count() == 0


def gathered(text: str, arcs: dict | None = None, **factors: float) -> float:
    return toxicity.evidence([text], toxicity.Lexical(arcs or {}), toxicity.grammar(**factors))[0, 0]


def test_grammar():
    assert gathered("a moron walks") == 1.0 and gathered("you idiot") == toxicity.AIMED == gathered("an idiot is what you") and gathered("you have seen what an idiot does") == 1.0
    assert gathered("this is not stupid.") == toxicity.NEGATED and gathered("isn't that stupid") == toxicity.NEGATED
    assert gathered("someone wrote that some moron came") == toxicity.REPORTED and gathered("said it. A moron came") == 1.0
    assert gathered("she wrote that you are not moron") == toxicity.REPORTED * toxicity.NEGATED * toxicity.AIMED
    assert gathered("kill time") == 0 and gathered("kill you") == toxicity.AIMED and gathered("never kill you") == toxicity.AIMED * toxicity.NEGATED
    # The end of a clause closes targets, negations and reports, in both directions.
    assert gathered("A moron. You came here") == gathered("You came! A moron") == gathered("not so; a moron") == gathered("he wrote\na moron") == 1.0
    assert gathered("zogling and zog", {"zog*": 3.0}) == 6.0 and gathered("\u201cidiot\u201d, moron\u2026 scum") == 3.0
    assert gathered("") == gathered("plain words only") == 0


def test_factors_move_scores():
    lexical, link = toxicity.Lexical({}), [-2.0, 2.0, 2.0, 1.0]
    score = lambda t, **f: toxicity.scores([t], lexical, toxicity.grammar(**f), link)[0]
    for text, without in (("you are not an idiot", {"negated": 1.0}), ("they said that he is an idiot", {"reported": 1.0}), ("some idiot said you", {"aimed": 1.0}), ("they kill you", {"aimed": 1.0})):
        assert abs(score(text) - score(text, **without)) > 0.02
    assert score("you are not an idiot") < score("you are an idiot") and score("an idiot") < score("you idiot")


def test_composition_and_search():
    """The composed grammar and its search against every path through the three transducers, one after the other."""
    chain = [toxicity.negation(), toxicity.report(), toxicity.target()]

    def every(clause):
        best = None
        for path in paths(chain, [(s, w, 1.0) for s, w in clause]):
            got = sum(w * f for _, w, f in path)
            best = got if best is None else max(best, got)
        return best or 0.0

    def paths(rest, tape):
        if not rest:
            yield tape
            return
        first = rest[0]
        stack = [(0, 0, [])]
        while stack:
            at, state, out = stack.pop()
            if at == len(tape):
                if state in first.finals:
                    yield from paths(rest[1:], out)
                continue
            symbol, weight, factor = tape[at]
            for written, f, to in first.arcs[state].get(symbol, ()):
                stack.append((at + 1, to, [*out, (written, weight, factor * f)]))

    rnd = random.Random(13)
    over = toxicity.grammar()
    for _ in range(400):
        clause = [(s := rnd.choice(toxicity.SYMBOLS), round(rnd.uniform(0.5, 5), 2) if s in ("insult", "threat") else 0.0) for _ in range(rnd.randint(0, 9))]
        assert abs(toxicity.best_path(over, clause)[0] - every(clause)) < 1e-9


def test_toxicity_edges(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('69ff206964696f74') as string) as text, 5 as score union all select 2L, repeat('you idiot scum ', 40000), 1 union all select 2L, 'other', 1 union all select null, null, 1")
    marks = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 5)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, marks).count() == 4 == toxicity.toxicity(docs, marks.limit(0)).count()
    assert toxicity.without_toxic(docs.limit(0), marks).count() == 0


def test_quality_learns_from_all_trusted(spark):
    n = 20_100  # every trusted document has a word of its own
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id) as text")
    words = quality.worded(quality.flagged(docs, docs.select("doc_id")))
    assert words.where("trusted").count() == n
    assert max(abs(x) for x in quality.ratios(words)) < 1e-9


def test_trusted_ids_are_joined_alike_at_every_size(spark):
    """A small table of ids is not broadcast, so what is shuffled grows in proportion."""
    docs, trusted = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (2, "d")], "doc_id long, text string"), spark.createDataFrame([(2,), (2,), (None,), (7,)], "doc_id long")
    found = quality.flagged(docs, trusted)
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in shown and "Broadcast" not in shown
    assert sorted((r.doc_id or 0, r.text or "", r.trusted) for r in found.collect()) == [(0, "c", False), (1, "a b", False), (2, "", True), (2, "d", True)]
