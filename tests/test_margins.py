"""Margins: cases with known answers, and random pages against plain arithmetic."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from leafmill.operators import margins as M

PAGE = "doc_id string, page int, width double, height double, source string, flow_bottom double"
BLOCK = "doc_id string, page int, ord int, kind string, role string, align string, x double, y double, width double, height double, lines int, line_height double, columns int"
A4 = (595.0, 842.0)


def page(doc="d", number=1, size=(600.0, 800.0), source="pdf", flow=None):
    return (doc, number, *size, source, flow)


def block(x, y, width, height=12.0, kind="paragraph", role="body", align="left", lines=1, doc="d", number=1, columns=1, ord_=0):
    return (doc, number, ord_, kind, role, align, float(x), float(y), float(width), float(height), lines, 15.0, columns)


def choose(spark, pages, blocks):
    made = M.chosen_margins(spark.createDataFrame(pages, PAGE), spark.createDataFrame(blocks, BLOCK))
    return sorted((r.doc_id, r.paper, r.kw, r.kh, r.pages, r.preset, r.left, r.right, r.top, r.bottom) for r in made.collect())


STANDARD, NARROW = (90.0, 90.0, 72.0, 72.0), (36.0, 36.0, 36.0, 36.0)


def test_presets_and_margins_of_their_own(spark):
    pages = [page("sparse", 1, A4), page("sparse", 2, A4), page("short"), page("short", 2), page("own"), page("grid"), page("poster"), page("cols")]
    blocks = [
        block(36, 36, 520, 28, lines=2, doc="sparse"), block(120, 100, 150, doc="sparse", number=2),  # a full page speaks for the short one
        block(90, 72, 100, doc="short"),  # short lines say nothing about the right edge
        block(12, 12, 576, 28, lines=2, doc="own"),
        block(25, 50, 550, 60, kind="table", role=None, align=None, doc="grid"),
        block(200, 20, 200, role="heading", align="center", doc="poster"), block(250, 700, 100, align="center", doc="poster"),
        block(36, 40, 240, doc="cols", columns=2), block(320, 40, 244, doc="cols", columns=2),
    ]
    got = {r[0]: r[1:] for r in choose(spark, pages, blocks)}
    assert got["sparse"] == ("A4", 595, 842, 2, "narrow", *NARROW)
    assert got["short"] == ("source", 600, 800, 2, "standard", *STANDARD)
    assert got["own"] == ("source", 600, 800, 1, "detected", 12.0, 12.0, 12.0, 36.0)
    assert got["grid"] == ("source", 600, 800, 1, "detected", 25.0, 25.0, 36.0, 36.0)
    assert got["poster"][4:] == ("detected", 36.0, 36.0, 17.0, 36.0)  # nothing known but the top, 20 pt down
    assert got["cols"][4:] == ("narrow", *NARROW)


def test_a_page_on_its_side_is_its_own_section(spark):
    pages = [page("d", 1, (595.0, 842.0)), page("d", 2, (1191.0, 842.0)), page("d", 3, (210.0, 297.0))]
    blocks = [block(90, 72, 100, number=k) for k in (1, 2, 3)]
    assert [r[1:5] for r in choose(spark, pages, blocks)] == [("A3", 1191, 842, 1), ("A4", 595, 842, 1), ("source", 210, 297, 1)]


def plain(pages, blocks):
    """One size, one document."""
    seen = []
    for _, number, w, h, source, flow in pages:
        own = [b for b in blocks if b[1] == number]
        para, tables = [b for b in own if b[3] == "paragraph"], [b for b in own if b[3] == "table"]
        body = [b for b in para if b[4] != "heading" and b[5] not in ("center", "right")]
        e = dict.fromkeys(M.EDGES)
        if not para and not tables:
            seen.append((e, False))
            continue
        xs = sorted(b[6] for b in body + tables + [b for b in para if b[4] == "heading" and b[5] == "left"])
        ends = [b[6] + b[8] for b in body + tables if b[8] >= w / 2 and (b[3] == "table" or b[9] > 1.5 * b[11] or b[5] == "justify")] + [b[6] + b[8] for b in para + tables if b[12] > 1]
        low = max([b[7] + 4 + max(b[9], b[10] * b[11]) if b[3] == "paragraph" else b[7] + b[9] for b in own] + ([flow + 4] if source == "ocr" or tables else []))
        top = min(b[7] for b in own)
        e |= {"left": xs[int((len(xs) - 1) * 0.05)] if xs else None, "right": max(0, w - max(ends)) if ends else None, "top": top if top <= 0.18 * h else None, "bottom": max(0, h - low) if h - low <= 0.18 * h else None}
        seen.append((e, bool(ends)))
    value = {}
    for c in M.EDGES:
        v = sorted(e[c] for e, ok in seen if ok and e[c] is not None) or sorted(e[c] for e, _ in seen if e[c] is not None)
        if v:
            value[c] = statistics.median(v) if c in ("left", "right") else v[int((len(v) - 1) * 0.2)]
    costs = []
    for name, preset in M.PRESETS:
        deltas = [(value[c] - p, wt) for c, p, wt in zip(M.EDGES, preset, M.WEIGHTS, strict=True) if c in value]
        costs.append((sum((3 + (-d - 20) / 12 if d < -20 else min(abs(d), 60) / 20) * wt for d, wt in deltas) / sum(wt for _, wt in deltas) if deltas else 0, name, preset))
    cost, name, preset = min(costs, key=lambda c: c[0])
    out = dict(zip(M.EDGES, preset, strict=True))
    if cost <= 1.5 or not any(ok for _, ok in seen):
        size = {n: (w, h) for _, n, w, h, _, _ in pages}
        tables = [b for b in blocks if b[3] == "table"]
        limit = {"left": min([b[6] for b in tables], default=math.inf), "right": min([size[b[1]][0] - b[6] - b[8] for b in tables], default=math.inf)}
        changed = {c: math.floor(v) for c, v in limit.items() if v < out[c]}
        for c in ("top", "bottom"):
            least = min([e[c] for e, _ in seen if e[c] is not None], default=math.inf)
            if least < out[c] - 3 or (least < math.inf and c == "bottom" and any(size[b[1]][1] - b[7] - b[9] < out[c] + 3 for b in tables)):
                changed[c] = math.floor(least - 3)
        return "detected" if changed else name, *(float(max(0, changed[c])) if c in changed else out[c] for c in M.EDGES)
    w, h = statistics.median(p[2] for p in pages), statistics.median(p[3] for p in pages)
    for c, v in value.items():
        out[c] = math.floor(2 * min(max(0, v - 3 * (c == "bottom")), 0.35 * w if c in ("left", "right") else 0.2 * h) + 0.5) / 2
    return "detected", *(out[c] for c in M.EDGES)


def test_random_pages_against_plain_arithmetic(spark):
    rnd, pages, blocks, want = random.Random(9), [], [], {}
    for d in range(120):
        doc, kind = f"d{d}", rnd.choice(["std", "nar", "own", "any"])
        x0, y0 = {"std": (90, 72), "nar": (36, 36), "own": (14, 10), "any": (rnd.randint(0, 200), rnd.randint(0, 200))}[kind]
        mine = [page(doc, n, source=rnd.choice(["pdf", "pdf", "ocr"]), flow=float(rnd.randint(500, 800))) for n in range(1, rnd.randint(2, 5))]
        own = []
        for p in mine:
            for k in range(rnd.randint(0, 6)):
                tall = rnd.choice([12, 30, 60])
                own.append(block(x0 + rnd.choice([0, 0, 0, 18, -4]), y0 + 110 * k + rnd.choice([0, 7]), rnd.choice([600 - 2 * x0, 600 - 2 * x0, 100, 40]) if x0 < 280 else 90, tall, rnd.choice(["paragraph"] * 6 + ["table", "image"]), rnd.choice(["body", "body", "heading"]), rnd.choice(["left", "left", "center", "right", "justify"]), tall // 12, doc, p[1], rnd.choice([1, 1, 1, 2]), k))
        pages, blocks = pages + mine, blocks + own
        want[doc] = plain(mine, own)
    got = {r[0]: r[5:] for r in choose(spark, pages, blocks)}
    assert {d: (v[0], *map(float, v[1:])) for d, v in got.items()} == want
    assert len({v[0] for v in want.values()}) == 3


def test_flow_bottom(spark):
    pages = spark.createDataFrame([("d", 1, 50.0), ("e", 1, 50.0)], "doc_id string, page int, top double")
    rows = [("d", 1, 0, 0, "paragraph", 10.0, 20.0, 2, 15.0, 12.0, None), ("d", 1, 1, 0, "rule", 5.0, 1.0, None, None, None, 2.0), ("d", 1, 1, 0, "table", 0.0, 40.0, None, None, None, None), ("d", 1, 1, 1, "paragraph", 0.0, 10.0, 1, 11.0, 14.0, None)]
    blocks = spark.createDataFrame(rows, "doc_id string, page int, band int, column int, kind string, before double, height double, lines int, line_height double, size double, thickness double")
    assert {r.doc_id: round(r.flow_bottom, 6) for r in M.flow_bottom(pages, blocks).collect()} == {"d": 50 + 40 + 5 + 2.05 + 40.1 + 13, "e": 54.0}


TO = "doc_id string, page int, width double, height double, left double, right double, paper_width double, paper_height double, to_left double, to_right double, to_top double, to_bottom double"
FRAME = "doc_id string, page int, band int, column int, columns int, width double, gap double"
FLOW = "doc_id string, page int, band int, column int, ord int, kind string, x double, y double, width double, height double, before double, indent double, first_indent double, columns_at array<double>, rows_at array<double>"


def test_mapping_keeps_gutters_and_only_shrinks_images(spark):
    pages = spark.createDataFrame([("d", 1, 500.0, 800.0, 20.0, 30.0, 600.0, 1000.0, 90.0, 90.0, 72.0, 72.0)], TO)
    frames = spark.createDataFrame([("d", 1, 0, 0, 2, 190.0, 20.0), ("d", 1, 0, 1, 2, 240.0, 20.0), ("d", 1, 1, 0, 1, None, None)], FRAME)
    b = lambda band, column, ord_, kind, x, y, w, h, *more: ("d", 1, band, column, ord_, kind, float(x), float(y), float(w), float(h), 10.0, *(list(more) + [None] * 4)[:4])
    rows = [b(0, 0, 0, "paragraph", 20, 100, 190, 20, 0.0, 12.0), b(0, 1, 1, "paragraph", 230, 40, 240, 20, 5.0, 0.0), b(1, 0, 2, "table", 20, 300, 450, 40, None, None, [50.0, 400.0], [20.0, 20.0]), b(1, 0, 3, "image", 20, 400, 450, 100), b(1, 0, 4, "image", 20, 400, 45, 100)]
    got = {r.ord: r for r in M.mapped(spark.createDataFrame(rows, FLOW), frames, pages).collect()}
    one, two = got[0], got[1]
    assert (one.x, one.y, one.width, one.before) == pytest.approx((24, 125, 228, 125 - 72)) and (two.before, two.y) == (0, 50)
    # Widths: 190 * 1.2 + 20 * 1.2 - 90 and 240 * 1.2 + 30 * 1.2 - 90; the second column's text stays at 230 * 1.2.
    assert (one.column_width, two.column_width) == pytest.approx((162, 234))
    assert one.indent == pytest.approx(24 - 90) and 90 + 162 + 24 + two.indent == pytest.approx(235 * 1.2) and one.first_indent == pytest.approx(14.4)
    assert one.right_indent == pytest.approx(90 + 162 - 210 * 1.2) and two.right_indent == pytest.approx(276 + 234 - 470 * 1.2)
    assert got[2].columns_at == pytest.approx([60, 480]) and got[2].rows_at == [25, 25] and got[2].indent is None
    assert (got[3].width, got[3].height) == pytest.approx((420, 125 * 420 / 540)) and (got[4].width, got[4].height) == pytest.approx((54, 125))
