"""Slanted lines in reading order, and plots in frames against a plain search."""

from __future__ import annotations

import math
import random

import pytest
from leafmill.operators import frames as A

SPAN = "doc_id string, page int, line int, ord int, x double, y double, width double, baseline double, size double, font string, source string, angle double, baseline_x double"


def slanted(doc, index, width, angle=-30.0, step=20.0, **change):
    a = math.radians(angle)
    x, base = 50 - index * step * math.sin(a), 100 + index * step * math.cos(a)
    top = base + min(0, width * math.sin(a)) - 10
    row = {"doc": doc, "page": 1, "line": index, "ord": 0, "x": x, "y": top, "width": width * math.cos(a), "baseline": base, "size": 14.0, "font": "F", "source": "pdf", "angle": angle, "baseline_x": x} | change
    return tuple(row.values())


def order(spark, rows):
    out = {}
    for r in A.slanted_order(spark.createDataFrame(rows, SPAN)).orderBy("doc_id", "place").collect():
        out.setdefault(r.doc_id, []).append(r.line)
    return out


def test_lines_along_one_axis_are_read_across_it(spark):
    widths = (50.0, 160.0, 60.0)
    plain = {"ok": {}, "level": {"angle": None}, "ocr": {"source": "ocr", "angle": None}}
    rows = [slanted(d, i, w, **c) if d == "ok" else slanted(d, i, w)[:9] + ("F", c.get("source", "pdf"), None, None) for d, c in plain.items() for i, w in enumerate(widths)]
    rows += [slanted("font", i, w, font="Other" if i == 1 else "F") for i, w in enumerate(widths)]
    rows += [slanted("far", i, w) for i, w in enumerate(widths[:2])] + [slanted("far", 2, 60.0, baseline_x=slanted("far", 2, 60.0)[-1] + 300)]
    got = order(spark, rows)
    assert got == {"ok": [0, 1, 2], "level": [1, 0, 2], "ocr": [1, 0, 2], "font": [1, 0, 2], "far": [1, 0, 2]}


@pytest.mark.parametrize("angle", [-60.0, -30.0, -10.0])
def test_planted_lines_come_out_in_order(spark, angle):
    rnd = random.Random(int(angle))
    rows = [slanted(f"d{d}", i, rnd.choice([30.0, 60.0, 110.0]), angle) for d in range(6) for i in range(12)]
    rnd.shuffle(rows)
    assert order(spark, rows) == {f"d{d}": list(range(12)) for d in range(6)}


PAGES = "doc_id string, page int, width double, height double"
RULE = "doc_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double"
TEXT = "doc_id string, page int, ord int, text string, x double, y double, width double, height double, size double"
BOX = "doc_id string, page int, ord int, x double, y double, width double, height double"


def frame(x, y, w, h):
    return [(x, y, x, y + h), (x + w, y, x + w, y + h), (x, y, x + w, y), (x, y + h, x + w, y + h)]


def plots(spark, pages):
    """pages: doc -> (rules, texts, artwork, tables), without ids."""
    row = lambda part: [(d, 1, i, *(float(v) if not isinstance(v, str) else v for v in r)) for d, p in pages.items() for i, r in enumerate(p[part])]
    texts = [(*r, 10.0) for r in row(1)]
    made = A.framed_plots(spark.createDataFrame([(d, 1, 600.0, 800.0) for d in pages], PAGES), spark.createDataFrame(row(0), RULE), spark.createDataFrame(texts, TEXT), spark.createDataFrame(row(2), BOX), spark.createDataFrame(row(3), BOX))
    out = {d: [] for d in pages}
    for r in made.orderBy("doc_id", "frame").collect():
        out[r.doc_id].append((r.x, r.y, r.width, r.height))
    return out


def test_a_plot_and_what_is_none(spark):
    box, labels, art = frame(100, 100, 300, 200), [(str(k), 110 + 40 * k, 280, 10, 10) for k in range(4)], [(150, 120, 200, 100)]
    outer = frame(60, 60, 420, 280)
    got = plots(spark, {
        "ok": (box, labels, art, []), "open": (box[:3], labels, art, []), "mute": (box, labels[:2], art, []), "bare": (box, labels, [], []), "grid": (box, labels, art, [(150, 150, 90, 90)]), "wide": (box, [*labels, ("a long line of text", 120, 200, 250, 10)], art, []),
        "cut": (box, [*labels, ("out", 95, 200, 30, 10)], art, []), "mask": (box, labels, [*art, (95, 150, 200, 60)], []), "near": (box, [*labels, ("7", 96, 150, 2, 10)], [*art, (92, 150, 200, 60)], []),
        "nested": (outer + frame(90, 90, 200, 150), labels + [("5", 400, 320, 10, 10)], [(100, 100, 180, 130)], []),
    })
    one = [(100.0, 100.0, 300.0, 200.0)]
    assert got == {"ok": one, "open": [], "mute": [], "bare": [], "grid": [], "wide": [], "cut": [], "mask": [(95.0, 100.0, 305.0, 200.0)], "near": [], "nested": [(60.0, 60.0, 420.0, 280.0)]}


def brute(rules, texts, artwork, tables):
    """Every pair of uprights, in order."""
    end = lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3])
    holds = lambda o, i: o[0] <= (i[0] + i[2]) / 2 <= o[2] and o[1] <= (i[1] + i[3]) / 2 <= o[3]
    within = lambda o, i, by: i[0] >= o[0] - by and i[1] >= o[1] - by and i[2] <= o[2] + by and i[3] <= o[3] + by
    ups, flats = [r for r in rules if abs(r[0] - r[2]) < 1.5], [r for r in rules if abs(r[1] - r[3]) < 1.5]
    text, art, tab, out = [(t[0], end(t[1:])) for t in texts], [end(b) for b in artwork], [end(b) for b in tables], []
    for a in ups:
        for b in ups:
            h = abs(a[3] - a[1])
            o = (a[0], min(a[1], a[3]), b[0], min(a[1], a[3]) + h)
            if h < 70 or o[2] - o[0] < 150 or abs(min(b[1], b[3]) - o[1]) > 2 or abs(abs(b[3] - b[1]) - h) > 2 or (o[2] - o[0]) * h > 0.7 * 480_000:
                continue
            if not all(any(abs(r[1] - at) < 2 and min(r[0], r[2]) <= o[0] + 2 and max(r[0], r[2]) >= o[2] - 2 for r in flats) for at in (o[1], o[3])):
                continue
            mine = [(t, c) for t, c in text if holds(o, c)]
            if any(holds(o, t) or holds(t, o) for t in tab) or any(not within(o, c, 1) or c[2] - c[0] > 0.7 * (o[2] - o[0]) for _, c in mine) or sum(any(x.isdigit() for x in t) for t, _ in mine) < 3:
                continue
            if not any(within(o, c, 2) and c[2] - c[0] > 0.15 * (o[2] - o[0]) and c[3] - c[1] > 0.1 * h for c in art):
                continue
            more = [c for c in art if within(o, c, 12) and max(0, min(o[2], c[2]) - max(o[0], c[0])) * max(0, min(o[3], c[3]) - max(o[1], c[1])) >= 0.9 * (c[2] - c[0]) * (c[3] - c[1])]
            e = tuple(f(c[k] for c in [o, *more]) for k, f in enumerate((min, min, max, max)))
            if any(holds(e, c) and not holds(o, c) for _, c in text) or any(holds(x, o) for x in out):
                continue
            out.append(e)
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return [(e[0], e[1], e[2] - e[0], e[3] - e[1]) for e in out if not any(area(x) > area(e) and holds(x, e) for x in out)]


def test_random_frames_against_brute_force(spark):
    rnd, pages = random.Random(3), {}
    for d in range(40):
        rules, texts, art, tables = [], [], [], []
        for _ in range(rnd.randint(1, 4)):
            x, y, w, h = rnd.choice([40, 60, 300]), rnd.choice([50, 80, 400]), rnd.choice([160, 220, 260, 500]), rnd.choice([80, 200, 300])
            rules += [tuple(v + rnd.choice([0, 0, 0, 1]) for v in r) if rnd.random() < 0.3 else r for r in frame(x, y, w, h)]
            texts += [(rnd.choice(["1", "20", "x"]), x + rnd.randint(0, w - 12), y + rnd.randint(2, h - 14), 10, 10) for _ in range(rnd.randint(2, 6))]
            art += [(x + rnd.choice([-8, 5, 10]), y + 10, rnd.choice([20, w // 2]), rnd.choice([5, h // 2])) for _ in range(rnd.randint(0, 2))]
        if rnd.random() < 0.15:
            tables.append((rnd.randint(0, 300), rnd.randint(0, 500), 100, 60))
        pages[f"d{d}"] = (rules, texts, art, tables)
    want = {d: brute(*p) for d, p in pages.items()}
    assert plots(spark, pages) == want and sum(map(bool, want.values())) > 8
