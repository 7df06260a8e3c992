"""Preserved regions: seeds, closure against a naive fixpoint, and what regions take."""

from __future__ import annotations

import random

import pytest
from leafmill.operators import regions as R

BOX = "doc_id string, page int, ord int, x double, y double, width double, height double"
LINE = "doc_id string, page int, line int, paragraph int, x double, y double, width double, height double"
SEED = "doc_id string, page int, x double, y double, width double, height double"
PAGES = "doc_id string, page int, width double, height double"


def closed(seeds, lines, tables):
    """Boxes (x, y, right, bottom) until nothing changes, everything with everything."""

    def hull(boxes):
        return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))

    paragraphs = {}
    for p, box in lines:
        paragraphs.setdefault(p, []).append(box)
    now = set(seeds)
    while True:
        new = set()
        for a in now:
            more = [hull(q) for q in paragraphs.values() if any(a[1] < (b[1] + b[3]) / 2 < a[3] for b in q)]
            more += [t for t in tables if min(a[2], t[2]) > max(a[0], t[0]) and min(a[3], t[3]) > max(a[1], t[1])]
            new.add(hull([a, *more]))
        for a in list(new):
            for b in list(new):
                if a in new and b in new and a != b and a[1] <= b[3] + 3 and b[1] <= a[3] + 3:
                    new -= {a, b}
                    new.add(hull([a, b]))
        if new == now:
            return sorted(now)
        now = new


def test_closure_is_the_naive_fixpoint(spark):
    rnd = random.Random(6)
    seeds, lines, tables, want = [], [], [], {}
    box = lambda x, y, w, h: (float(x), float(y), float(x + w), float(y + h))
    row = lambda b: (b[0], b[1], b[2] - b[0], b[3] - b[1])
    for d in range(25):
        doc = f"d{d}"
        s = [box(rnd.randrange(400), rnd.randrange(700), rnd.randint(5, 120), rnd.randint(5, 60)) for _ in range(rnd.randint(0, 4))]
        ln = [(rnd.randrange(12), box(rnd.choice([50, 300]), 20 * k + rnd.choice([0, 3]), 200, 12)) for k in range(35) if rnd.random() < 0.7]
        t = [box(rnd.randrange(300), rnd.randrange(700), rnd.randint(20, 200), rnd.randint(10, 150)) for _ in range(rnd.randint(0, 3))]
        seeds += [(doc, 1, *row(b)) for b in s]
        lines += [(doc, 1, k, p, *row(b)) for k, (p, b) in enumerate(ln)]
        tables += [(doc, 1, k, *row(b)) for k, b in enumerate(t)]
        if s:
            want[doc] = closed(s, ln, t)
    made, rounds = R.closure(spark.createDataFrame(seeds, SEED), spark.createDataFrame(lines, LINE), spark.createDataFrame(tables, BOX))
    got = {}
    for r in made.collect():
        got.setdefault(r.doc_id, []).append((r.x, r.y, r.x + r.width, r.y + r.height))
    assert {d: sorted(v) for d, v in got.items()} == want and 2 < rounds < 12


def test_rounds_of_a_chain_and_no_seeds(spark):
    # Each paragraph's second line lies inside the next paragraph's first: one more is reached in each round.
    lines = [("d", 1, 2 * p + k, p, 50.0, 30.0 * p + 40 * k, 100.0, 12.0) for p in range(5) for k in (0, 1)]
    there = spark.createDataFrame(lines, LINE)
    none = spark.createDataFrame([], BOX)
    made, rounds = R.closure(spark.createDataFrame([("d", 1, 60.0, 2.0, 10.0, 5.0), ("d", 1, 60.0, 2.0, 10.0, 5.0)], SEED), there, none)
    assert [tuple(r)[2:] for r in made.collect()] == [(50.0, 0.0, 100.0, 172.0)] and rounds == 6
    made, rounds = R.closure(spark.createDataFrame([], SEED), there, none)
    assert made.count() == 0 and rounds == 0


def test_seeds(spark):
    line = lambda n, y, doc="d": (doc, 1, n, 0, 50.0, float(y), 300.0, 12.0)
    lines = spark.createDataFrame([line(0, 100), line(1, 200), line(2, 300), line(3, 400), line(4, 500)], LINE)
    spans = [("d", 1, n, None, "clear words", 95) for n in (0, 1, 3, 4)] + [("d", 1, 2, None, "poor", 50), ("d", 1, None, 0, "cell", 95), ("d", 1, None, 1, "cell", 95), ("d", 1, None, 2, "ok", 90), ("d", 1, None, 2, "x", 30)]
    spans = spark.createDataFrame(spans, "doc_id string, page int, line int, table int, text string, confidence int")
    tables = spark.createDataFrame([("d", 1, 0, 50.0, 600.0, 100.0, 20.0), ("d", 1, 1, 50.0, 640.0, 100.0, 20.0), ("d", 1, 2, 50.0, 680.0, 100.0, 20.0), ("d", 1, 3, 50.0, 720.0, 100.0, 20.0)], BOX)
    artwork = spark.createDataFrame([("d", 1, 0, 300.0, 190.0, 90.0, 30.0), ("d", 1, 1, 100.0, 630.0, 20.0, 20.0), ("d", 1, 2, 0.0, 20.0, 240.0, 30.0), ("d", 1, 3, 0.0, 60.0, 100.0, 30.0)], BOX)
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], PAGES)
    marked = spark.createDataFrame([("d", 1, 4)], "doc_id string, page int, line int")
    got = sorted(tuple(r)[2:] for r in R.seeds(lines, spans, tables, artwork, pages, marked).collect())
    assert got == [
        (0.0, 20.0, 240.0, 30.0),  # a banner
        (50.0, 190.0, 340.0, 30.0),  # artwork with the line it crosses
        (50.0, 300.0, 300.0, 12.0), (50.0, 500.0, 300.0, 12.0),  # a doubtful line, a marked one
        (50.0, 640.0, 100.0, 20.0), (50.0, 680.0, 100.0, 20.0), (50.0, 720.0, 100.0, 20.0),  # met by artwork, doubtful, empty
    ]


def test_grey_below_artwork(spark):
    art = spark.createDataFrame([("d", 1, 0, 0.0, 100.0, 90.0, 60.0), ("d", 1, 1, 0.0, 100.0, 70.0, 60.0)], BOX)
    strips = spark.createDataFrame([("d", 1, k, y, 100, g, dark) for k in (0, 1) for y, g, dark in ((170.0, 20, 2), (180.0, 20, 10), (190.0, 40, 0), (175.0, 4, 0))], "doc_id string, page int, ord int, y double, wide int, grey int, dark int")
    assert {r.ord: r.height for r in R.art_extents(art, strips).collect()} == {0: 70.0, 1: 60.0}


def test_what_regions_take(spark):
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], PAGES)
    kept = R.retained(spark.createDataFrame([("d", 1, 1.0, 300.0, 598.5, 50.0), ("d", 1, 50.0, 100.0, 100.0, 200.0)], SEED), pages)
    assert [tuple(r)[2:] for r in kept.orderBy("region").collect()] == [(0, 48.0, 99.0, 104.0, 202.0), (1, 0.0, 299.0, 600.0, 52.0)]
    boxes = spark.createDataFrame([("d", 1, 0, 40.0, 120.0, 30.0, 10.0), ("d", 1, 1, 10.0, 120.0, 30.0, 10.0), ("d", 1, 2, 0.0, 90.0, 600.0, 500.0)], BOX)
    assert sorted(r.ord for r in R.rasterised(boxes, kept, ["doc_id", "page", "ord"]).collect()) == [0, 2]
    spans = spark.createDataFrame([("d", 1, 0, 7), ("d", 1, 1, 7), ("d", 1, 2, 8)], "doc_id string, page int, ord int, paragraph int")
    assert [r.paragraph for r in R.editable_paragraphs(spans, spans.where("ord <> 1")).collect()] == [8]


@pytest.mark.parametrize(("rows", "bad"), [([("", 90)], True), ([("abcdefghij", 83)], True), ([("abcdefghij", 84)], False), ([("abcdefghi", 99), ("x", 59)], False), ([("abcdefgh", 99), ("x", 59)], True), ([("abcdefghijklmnopqrs", 99), ("x", 39)], True), ([("abcdefghijklmnopqrs", 99), ("-", 39)], False), ([("abc", None)], True)])
def test_doubtful(spark, rows, bad):
    made = spark.createDataFrame([("d", 1, 0, t, c) for t, c in rows], "doc_id string, page int, line int, text string, confidence int")
    assert (R.doubtful(made, ["doc_id", "page", "line"]).count() == 1) == bad
