"""Replay of drawing operators, paths, and text against paint."""

from __future__ import annotations

import random

import pytest
from leafmill.operators import drawing as D

OPS = "doc_id string, page int, i int, op string, nums array<double>, text string"
VIEW = "doc_id string, page int, view array<double>"
COMMAND = "doc_id string, page int, i int, k int, command string, x double, y double"
FLAT = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def ops_of(spark, rows, doc="d"):
    rows = [(*r, None, None)[:3] for r in rows]
    return spark.createDataFrame([(doc, 1, i, op, nums and [float(x) for x in nums], text) for i, (op, nums, text) in enumerate(rows)], OPS)


def test_replay_restores_what_was_saved(spark):
    rows = [("fill_color", None, "#ff0000"), ("save",), ("fill_color", None, "00ff00"), ("line_width", [3.0]), ("transform", [2.0, 0, 0, 2, 10, 20]), ("form_begin", [1.0, 0, 0, 1, 5, 5]), ("text_mode", [3.0]), ("form_end",), ("restore",), ("restore",), ("line_width", [2.0]), ("font", [-9.0])]
    got = {r.i: r for r in D.replayed(ops_of(spark, rows)).collect()}
    assert [got[i].fill for i in (0, 1, 2, 7, 8, 9)] == ["FF0000", "FF0000", "00FF00", "00FF00", "FF0000", "000000"]
    assert got[5].matrix == [2, 0, 0, 2, 20, 30] and got[7].matrix == [2, 0, 0, 2, 10, 20] and got[8].matrix == FLAT
    assert [got[i].width for i in (2, 3, 8, 10)] == [1, 3, 1, 2] and [got[i].mode for i in (5, 6, 7)] == [0, 3, 0] and got[11].font_size == 9


def test_images(spark):
    rows = [("save",), ("transform", [100.0, 0, 0, -50, 20, 300]), ("image",), ("restore",), ("show_text", None, "x"), ("blend", None, "multiply"), ("transform", [0.0, 10, -10, 0, 0, 0]), ("image",)]
    got = D.placed_images(D.replayed(ops_of(spark, rows)), spark.createDataFrame([("d", 1, FLAT)], VIEW)).orderBy("i").collect()
    assert [tuple(r)[2:] for r in got] == [(2, 20.0, 250.0, 100.0, 50.0, "source-over", True), (7, -10.0, 0.0, 10.0, 10.0, "multiply", False)]


def rect(i, x, y, w, h, k0=0):
    return [("d", 1, i, k0, "move", x, y), ("d", 1, i, k0 + 1, "line", x + w, y), ("d", 1, i, k0 + 2, "line", x + w, y + h), ("d", 1, i, k0 + 3, "line", x, y + h), ("d", 1, i, k0 + 4, "close", None, None)]


def test_paths_become_rules_and_fills(spark):
    rows = [
        ("stroke_color", None, "CC0000"), ("line_width", [2.0]), ("transform", [1.0, 0, 0, 1, 0, 10]), ("path", None, "stroke"), ("fill_color", None, "ABCDEF"), ("path", None, "fill"), ("path", None, "fill"), ("path", None, "fill_stroke"),
        ("path", None, "stroke"), ("path", None, "fill"), ("path", None, "end"), ("opacity", [0.5]), ("path", None, "fill"), ("path", None, "fill"),
    ]
    f = lambda *c: tuple(float(v) if isinstance(v, int | float) and k > 3 else v for k, v in enumerate(c))
    commands = [("d", 1, 3, 0, "move", 10.0, 0.0), ("d", 1, 3, 1, "line", 110.0, 0.0), ("d", 1, 3, 2, "line", 110.5, 80.0), ("d", 1, 3, 3, "move", 0.0, 0.0), ("d", 1, 3, 4, "line", 50.0, 50.0), ("d", 1, 3, 5, "line", 50.0, 90.0)]
    for i, x, y, w, h in ((5, 20, 30, 100, 2), (6, 20, 30, 100, 40), (7, 0, 0, 2, 60), (10, 1, 1, 9, 9), (12, 20, 50, 60, 60)):
        commands += [f(*c) for c in rect(i, x, y, w, h)]
    commands += [f("d", 1, 8, 0, "move", 0, 0), f("d", 1, 8, 1, "line", 9, 0), f("d", 1, 8, 2, "curve", 9, 9), ("d", 1, 8, 3, "close", None, None)]
    commands += [f(*c) for c in rect(9, 0, 0, 50, 50)] + [f("d", 1, 9, 9, "curve", 5, 5)]
    commands += [f(*c) for c in rect(13, 0, 0, 50, 50)] + [f(*c) for c in rect(13, 100, 0, 50, 50, 10)]
    made = spark.createDataFrame(commands, COMMAND)
    state = D.replayed(ops_of(spark, rows))
    pieces = D.segments(made, state, spark.createDataFrame([("d", 1, FLAT)], VIEW))
    rules, fills = D.painted(pieces, made, state)
    got = sorted((r.i, -1 if r.k is None else r.k, r.x1, r.y1, r.x2, r.y2, r.color, r.thickness) for r in rules.collect())
    assert got == [
        (3, 1, 10.0, 10.0, 110.0, 10.0, "CC0000", 2.0), (3, 2, 110.0, 10.0, 110.5, 90.0, "CC0000", 2.0),  # the second subpath is artwork
        (5, -1, 20.0, 41.0, 120.0, 41.0, "ABCDEF", 2.0),
        (7, -1, 1.0, 10.0, 1.0, 70.0, "ABCDEF", 2.0), (7, 1, 0.0, 10.0, 2.0, 10.0, "CC0000", 2.0), (7, 2, 2.0, 10.0, 2.0, 70.0, "CC0000", 2.0), (7, 3, 2.0, 70.0, 0.0, 70.0, "CC0000", 2.0), (7, 4, 0.0, 70.0, 0.0, 10.0, "CC0000", 2.0),
        (8, 1, 0.0, 10.0, 9.0, 10.0, "CC0000", 2.0),
    ]
    assert sorted((r.i, r.x, r.y, r.width, r.height, r.color, r.opaque) for r in fills.collect()) == [(6, 20.0, 40.0, 100.0, 40.0, "ABCDEF", True), (12, 20.0, 60.0, 60.0, 60.0, "ABCDEF", False)]
    band = spark.createDataFrame([("d", 1, "word", 20.0, 100.0, 40.0, 12.0, "000000")], "doc_id string, page int, text string, x double, width double, baseline double, size double, color string")
    rules, fills = D.painted(pieces, made, state, band)
    assert {r.i for r in rules.collect()} == {3, 7, 8} and {r.i for r in fills.collect()} == {5, 6, 12}


RUN = "doc_id string, page int, i int, text string, color string, bold boolean, invisible boolean"
SPAN = "doc_id string, page int, ord int, text string, width double"


def plain(spans, stream):
    """(ord, start, end) by looking at the whole stream for each span."""
    out, cursor = [], 0
    for ord_, text in spans:
        bare = "".join(text.split())
        if not bare:
            continue
        if stream.startswith("­", cursor) and not bare.startswith("­"):
            here = cursor + 1
        else:
            here = cursor
        if stream[here : here + len(bare)] != bare:
            places = [p for p in range(here, here + 65) if stream[p : p + len(bare)] == bare]
            if len(places) != 1:
                continue
            here = places[0]
        out.append((ord_, here, here + len(bare)))
        cursor = here + len(bare)
    return out


def test_alignment_against_a_plain_search(spark):
    rnd, spans, runs, want = random.Random(2), [], [], set()
    for d in range(40):
        letters = rnd.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 120))]
        shown, drawn = [], []
        for w in words:
            kind = rnd.random()
            if kind < 0.9:
                shown.append(rnd.choice(["", " "]) + w)
            if kind > 0.05:
                drawn.append(w + rnd.choice(["", "", " ", "­"]))
            if rnd.random() < 0.05:
                (shown if rnd.random() < 0.5 else drawn).append("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))))
        text = "".join(drawn)
        cuts = sorted({0, len(text), *(rnd.randrange(len(text) + 1) for _ in range(20))})
        runs += [(f"d{d}", 1, i, text[a:z], "000000", False, False) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
        spans += [(f"d{d}", 1, i, t, 10.0) for i, t in enumerate(shown)]
        want |= {(f"d{d}", *x) for x in plain(enumerate(shown), "".join(text.split()))}
    made = D.aligned(spark.createDataFrame(spans, SPAN), spark.createDataFrame(runs, RUN))
    assert {(r.doc_id, r.ord, r.start, r.end) for r in made.collect()} == want
    assert len(spans) * 0.5 < len(want) < len(spans)


def test_appearance(spark):
    runs = [("d", 1, 3, "Red wor", "FF0000", True, False), ("d", 1, 5, "d black", "FF0000", False, False), ("d", 1, 7, "not text", "0000FF", False, True), ("d", 1, 9, "end", "0000FF", False, True)]
    spans = [("d", 1, 0, "Red", 10.0), ("d", 1, 1, "word", 10.0), ("d", 1, 2, "black", 10.0), ("d", 1, 3, "lost", 10.0), ("d", 1, 4, " ", 1.0), ("d", 1, 5, "textend", 10.0)]
    got = D.appearance(spark.createDataFrame(spans, SPAN), spark.createDataFrame(runs, RUN)).orderBy("ord").collect()
    assert [tuple(r)[2:] for r in got] == [(0, "FF0000", True, False, 3), (1, "FF0000", False, False, 5), (2, "FF0000", False, False, 5), (5, "0000FF", False, True, 9)]
    mixed = D.appearance(spark.createDataFrame([("d", 1, 0, "black not", 10.0)], SPAN), spark.createDataFrame(runs[1:], RUN).where("i > 4"))
    assert [tuple(r)[2:] for r in mixed.collect()] == [(0, None, False, False, 7)]


GLYPH = "doc_id string, page int, i int, k int, text string, width double, in_font boolean"


def test_advances_share_a_span_by_its_glyphs(spark):
    spans = spark.createDataFrame([("d", 1, 0, "ab c", 90.0), ("d", 1, 1, "fi", 10.0)], SPAN)
    runs = spark.createDataFrame([("d", 1, 0, "abc", "0", False, False), ("d", 1, 1, "fi", "0", False, False)], RUN)
    glyphs = spark.createDataFrame([("d", 1, 0, 0, "a", 500.0, True), ("d", 1, 0, 1, "b", 250.0, True), ("d", 1, 0, 2, "c", None, True), ("d", 1, 1, 0, "fi", 600.0, True)], GLYPH)
    got = D.advances(spans, glyphs, D.aligned(spans, runs)).orderBy("ord").collect()
    assert [r.advances for r in got] == [[22.5, 11.25, 11.25, 45.0], [5.0, 5.0]]


@pytest.mark.parametrize(("change", "found"), [({}, True), ({"line_end": False}, False), ({"mode": 3}, False), ({"char_spacing": 0.5}, False), ({"in_font": False}, False), ({"hyphen": 300.0}, False), ({"baseline": 11.0}, False)])
def test_hyphens_that_text_leaves_out(spark, change, found):
    c = {"line_end": True, "mode": 0, "char_spacing": 0.0, "in_font": True, "hyphen": 100.0, "baseline": 10.0} | change
    spans = spark.createDataFrame([("d", 1, 0, "on", False, False, 0.0, 10.0, 10.0, "f", 12.0), ("d", 1, 1, "to", c["line_end"], False, 10.0, 10.0, c["baseline"], "f", 12.0), ("d", 1, 2, "next", True, False, 0.0, 10.0, 30.0, "f", 12.0)], "doc_id string, page int, ord int, text string, line_end boolean, rotated boolean, x double, width double, baseline double, font string, size double")
    runs = spark.createDataFrame([("d", 1, 0, "onto­", c["mode"], c["char_spacing"], 0.0), ("d", 1, 1, "next", 0, 0.0, 0.0)], "doc_id string, page int, i int, text string, mode int, char_spacing double, word_spacing double")
    glyphs = [("d", 1, 0, k, t, 250.0, True) for k, t in enumerate("onto")] + [("d", 1, 0, 4, None, 50.0, None), ("d", 1, 0, 5, "­", c["hyphen"], c["in_font"])] + [("d", 1, 1, k, t, 250.0, True) for k, t in enumerate("next")]
    matched = D.aligned(spans, runs)
    assert matched.count() == 3
    got = D.hyphenated(spans, matched, runs, spark.createDataFrame(glyphs, GLYPH)).collect()
    assert [(r.ord, round(r.ratio, 4)) for r in got] == ([(1, round(100 / 450, 4))] if found else [])
