"""Fractions: what makes one, and that bars are served in order, against one bar after the other."""

from __future__ import annotations

import random

from leafmill.operators import fractions as A

SPAN = "doc_id string, page int, ord int, text string, x double, y double, width double, height double, baseline double, size double, source string, font string"
RULE = "doc_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double"


def span(ord_, text, x, baseline, width=40.0, size=12.0, doc="d", source="pdf", font="F"):
    return (doc, 1, ord_, text, float(x), float(baseline) - 10, float(width), 12.0, float(baseline), float(size), source, font)


def bar(ord_, x, y, end, doc="d"):
    return (doc, 1, ord_, float(x), float(y), float(end), float(y))


def read(spark, spans, rules):
    return A.with_fractions(spark.createDataFrame(spans, SPAN), spark.createDataFrame(rules, RULE))


def test_a_fraction_and_what_is_none(spark):
    stack = lambda doc, **c: [span(0, "Top", 120, 100, 60, doc=doc, **c), span(1, "Bottom", 115, 120, 70, doc=doc), span(2, "x =", 60, 109, 40, doc=doc)]
    spans = stack("ok") + stack("prose")[:2] + stack("far")[:2] + [span(2, "x =", 10, 109, 40, doc="far")] + stack("scan", source="ocr")
    spans += [span(0, "Top", 105, 100, 20, doc="left"), span(1, "Bottom", 115, 120, 70, doc="left"), span(2, "x =", 60, 109, 35, doc="left")]
    spans += [*stack("two"), span(3, "Higher", 120, 92, 60, doc="two")]
    spans += [*stack("row"), span(3, "more", 182, 100, 18, doc="row"), span(4, "and", 100, 100, 18, doc="row")]
    rules = [bar(0, 100, 106, 200, d) for d in ("ok", "prose", "far", "scan", "left", "two", "row")]
    out, bars = read(spark, spans, rules)
    assert sorted(r.doc_id for r in bars.collect()) == ["ok", "row"]
    got = {(r.doc_id, r.ord): r for r in out.collect()}
    top = got["ok", 0]
    assert (top.text, top.numerator, top.denominator) == ("Top/Bottom", "Top", "Bottom") and ("ok", 1) not in got and got["ok", 2].numerator is None
    assert (top.x, top.y, top.width, top.height, round(top.baseline, 6), top.source) == (100.0, 90.0, 100.0, 32.0, 109.6, "pdf")
    assert got["row", 0].numerator == "and Top more"
    assert len(got) == len(spans) - 4


def test_delimiters_of_a_mathematical_font(spark):
    m = {"font": "ABCDEF+CambriaMath"}
    spans = [span(0, "∑+a", 110, 100, 30, **m), span(1, "b,", 150, 100, 30, **m), span(2, "n", 140, 120, 20, **m), span(3, "= 2 × &", 50, 109, 48, **m), span(4, "' end", 201, 109, 30, **m), span(5, "' other", 300, 109, 30, **m)]
    out, _ = read(spark, spans, [bar(0, 100, 106, 200)])
    assert {r.ord: r.text for r in out.collect()} == {0: "∑(a b)/n", 3: "= 2 × (", 4: ") end", 5: "' other"}
    plain = [s[:-1] + ("Serif",) for s in spans]
    assert {r.text for r in read(spark, plain, [bar(0, 100, 106, 200)])[0].collect()} == {"∑+a b,/n", "= 2 × &", "' end", "' other"}


def one_by_one(spans, bars):
    """Each bar in its turn, over all spans that are left; sides are single lines here."""
    used, out = set(), set()
    for _, _, k, x, y, e, _ in bars:
        free = [s for s in spans if s[2] not in used and s[4] >= x - 2 and s[4] + s[6] <= e + 2]
        over = [s for s in free if y - 1.8 * s[9] <= s[8] <= y - 0.3 * s[9]]
        under = [s for s in free if s[5] >= y - 1 and y + 0.3 * s[9] < s[8] <= y + 1.8 * s[9]]
        if not over or not under or len({s[8] for s in over}) > 1 or len({s[8] for s in under}) > 1:
            continue
        size = min(over, key=lambda s: s[2])[9]
        middle = lambda side: (min(s[4] for s in side) + max(s[4] + s[6] for s in side)) / 2
        if any(abs(middle(side) - (x + e) / 2) > max(3, size / 2) for side in (over, under)):
            continue
        beside = [s for s in spans if abs(s[8] - y) < size / 2 and ((s[4] + s[6] <= x + 2 and x - s[4] - s[6] < 2 * size) or (s[4] >= e - 2 and s[4] - e < size))]
        if not any(set("=×÷") & set(s[3]) for s in beside):
            continue
        out.add((k, min(s[2] for s in over), frozenset(s[2] for s in over), frozenset(s[2] for s in under)))
        used |= {s[2] for s in over + under}
    return out


def test_bars_are_served_in_order(spark):
    rnd, spans, rules, want = random.Random(5), [], [], {}
    for d in range(30):
        doc, page, bars = f"d{d}", [], []
        levels = rnd.randint(2, 9)  # stacked bars whose denominators are the next one's numerators
        for c in range(3):
            x0 = 100 + 200 * c
            for v in range(levels + 1):
                if rnd.random() < 0.9:
                    page.append((rnd.random(), rnd.choice(["a", "b"]), x0 + rnd.choice([30, 30, 30, 5]), 32 + 20 * v, 40))
                if rnd.random() < 0.8:
                    page.append((rnd.random(), rnd.choice(["= c", "= c", "c"]), x0 - 45, 41 + 20 * v, 40))
            bars += [(rnd.random(), x0, 40 + 20 * v, x0 + 100) for v in range(levels)]
        page = [span(i, t, x, b, w, doc=doc) for i, (_, t, x, b, w) in enumerate(sorted(page))]
        bars = [bar(i, x, y, e, doc) for i, (_, x, y, e) in enumerate(sorted(bars))]
        spans, rules = spans + page, rules + bars
        want[doc] = one_by_one(page, bars)
    _, members, _ = A.fractions(spark.createDataFrame(spans, SPAN), spark.createDataFrame(rules, RULE))
    held = {}
    for r in members.collect():
        held.setdefault((r.doc_id, r.bar), {"n": set(), "d": set()})[r.role].add(r.ord)
    got = {d: set() for d in want}
    for (doc, k), sides in held.items():
        got[doc].add((k, min(sides["n"]), frozenset(sides["n"]), frozenset(sides["d"])))
    assert got == want and sum(map(len, want.values())) > 60


def test_no_rules(spark):
    out, bars = read(spark, [span(0, "a", 0, 0)], [])
    assert out.count() == 1 and bars.count() == 0
