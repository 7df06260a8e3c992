"""Gutters, bands and columns on hand-built pages and against a plain walk down random pages."""

from __future__ import annotations

import random

from leafmill.operators import bands as B

SPAN = "doc_id string, page int, line int, ord int, x double, y double, width double, height double, baseline double, size double, text string"
BLOCK = "doc_id string, page int, ord int, kind string, x double, y double, width double, height double"
REGION = "doc_id string, page int, x double, y double, width double, height double, body double"


def word(line, ord_, x, y, width, text="w", doc="d"):
    return (doc, 1, line, ord_, float(x), float(y), float(width), 12.0, float(y) + 10, 12.0, text)


def region(doc="d", x=50.0, y=100.0, width=500.0, height=600.0):
    return (doc, 1, x, y, width, height, 12.0)


def read(spark, spans, blocks=(), regions=(region(),)):
    make = lambda rows, ddl: spark.createDataFrame(list(rows), ddl)
    return B.bands(make(spans, SPAN), make(blocks, BLOCK), make(regions, REGION)).orderBy("doc_id", "place").collect()


def two(doc, rows=6, y=100, start=0):
    """Left and right lines on one baseline, as two spans of one line."""
    out = []
    for i in range(rows):
        out += [word(start + i, 0, 50, y + 16 * i, 180, f"L{i}", doc), word(start + i, 1, 310, y + 16 * i, 240, f"R{i}", doc)]
    return out


def test_two_columns_are_read_one_after_the_other(spark):
    got = read(spark, two("d", 2))
    assert [r.text for r in got] == ["L0", "L1", "R0", "R1"] and {r.columns for r in got} == {2}
    assert [(r.column, r.column_x, r.column_width) for r in got if r.text in ("L0", "R1")] == [(0, 50.0, 180.0), (1, 310.0, 240.0)]


def test_what_spans_the_gutter_makes_bands(spark):
    spans = [word(90, 0, 60, 100, 460, "Title"), *two("d", 4, 130), word(91, 0, 60, 210, 460, "Middle"), *two("d", 4, 240, 50), word(92, 0, 60, 310, 200, "Name"), word(92, 1, 262, 310, 200, "....")]
    got = read(spark, spans, [("d", 1, 0, "rule", 50.0, 228.0, 500.0, 1.0)])
    assert [r.text for r in got] == ["Title", "L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3", "Middle", None, "L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3", "Name ...."]
    assert [r.band for r in got] == [0] + [1] * 8 + [2] * 2 + [3] * 8 + [4] and [r.columns for r in got] == [1] + [2] * 8 + [1] * 2 + [2] * 8 + [1]
    assert [got[i].top for i in (0, 9, 11, 19)] == [100.0, 193.0, 229.0, 303.0]  # the top of the region, then what is below the row, rule or row before


def test_three_columns_with_unequal_gutters(spark):
    spans = [word(50, 0, 50, 100, 450, "Heading")]
    for i in range(6):
        spans += [word(i, k, x, 140 + 16 * i, w, f"{'ABC'[k]}{i}") for k, (x, w) in enumerate([(50, 120), (195, 130), (360, 140)])]
    got = read(spark, spans, regions=[region(width=450.0)])
    assert [r.text for r in got] == ["Heading", *[f"{c}{i}" for c in "ABC" for i in range(6)]]
    assert {(r.column, r.column_x, r.column_width) for r in got if r.columns == 3} == {(0, 50.0, 120.0), (1, 195.0, 130.0), (2, 360.0, 140.0)}


def test_fields_bridged_gaps_and_single_columns_stay_whole(spark):
    labels = [word(i, k, (60, 320)[k], 100 + 30 * i, 60, f"{'LR'[k]}{i}", "labels") for i in range(6) for k in (0, 1)]
    bridged = two("bridged", 6)
    plain = [word(i, 0, 50, 100 + 16 * i, 480, f"P{i}", "plain") for i in range(6)]
    blocks = [("bridged", 1, 0, "rule", 150.0, 105.0, 200.0, 1.0)]
    got = read(spark, labels + bridged + plain, blocks, [region(d) for d in ("labels", "bridged", "plain")])
    assert {r.columns for r in got} == {1} and {r.band for r in got} == {0}
    assert [r.text for r in got if r.doc_id == "bridged"][:3] == ["L0 R0", None, "L1 R1"]


# A plain walk down a page, node by node.


def walk_gap(nodes, box, body):
    """nodes: dicts from the top; box: (x, y, width, height)."""
    x0, _, w, h = box
    end = lambda n: n["x"] + n["w"]
    low = lambda n: n["y"] + n["h"]
    lines = [n for n in nodes if n["kind"] == "line"]
    slim = [n for n in lines if n["w"] < 0.62 * w]
    if len(slim) < 4 or len(lines) - len(slim) > 0.4 * len(slim) or any(n["kind"] == "table" and n["w"] > 0.8 * w and n["h"] > 0.5 * h for n in nodes):
        return None
    seen = {}
    for i, p in enumerate(slim):
        for q in slim[i + 1 :]:
            if q["y"] - low(p) <= 1.5 * body and abs(p["b"] - q["b"]) <= 1.5 * body:
                a, z = (end(p), q["x"]) if p["x"] < q["x"] else (end(q), p["x"])
                if z - a >= max(3, body / 4) and a > x0 + 0.2 * w and z < x0 + 0.8 * w:
                    seen[int(a + 0.5), int(z + 0.5)] = (a, z)
    prose = [(p, q) for i, p in enumerate(slim) for q in slim[i + 1 :] if min(p["w"], q["w"]) > 0.2 * w and abs(p["x"] - q["x"]) < body and 0.6 * body < q["b"] - p["b"] < body * (5 if min(p["w"], q["w"]) > 0.32 * w else 1.8)]
    best = None
    for a, z in seen.values():
        left, right = [n for n in slim if end(n) <= a + 1], [n for n in slim if n["x"] >= z - 1]
        if any(n["kind"] == "rule" and n["w"] < 0.65 * w and n["x"] <= a + 2 and end(n) >= z - 2 for n in nodes) or min(len(left), len(right)) < 2:
            continue
        if not all(any(p in side and q in side for p, q in prose) for side in (left, right)):
            continue
        span = [(min(n["y"] for n in side), max(map(low, side))) for side in (left, right)]
        top, bottom = max(s[0] for s in span), min(s[1] for s in span)
        over = sum(n["y"] >= top and low(n) <= bottom and n["x"] < z - 1 and end(n) > a + 1 for n in lines)
        if bottom - top <= 0.4 * min(s[1] - s[0] for s in span) or over > max(2, 0.15 * (len(left) + len(right))):
            continue
        rank = (4 * min(len(left), len(right)) + len(left) + len(right) - 8 * over, a - z)
        if best is None or rank > best[0]:
            best = rank, max(map(end, left)), min(n["x"] for n in right)
    return best and best[1:]


def test_gutters_against_a_plain_search(spark):
    rnd, nodes, regions, want = random.Random(8), [], [], {}
    for d in range(60):
        doc, page, y = f"d{d}", [], 100.0
        for i in range(rnd.randint(3, 16)):
            for x, most in ((50, rnd.choice([180, 200, 230])), (rnd.choice([270, 290, 300]), 240)):
                if rnd.random() < 0.85:
                    page.append({"kind": "line", "x": x + rnd.choice([0, 0, 0, 14]), "y": y + rnd.choice([0, 0, 1, 5]), "w": rnd.choice([most, most, most - 20, 90, 30]), "h": 12.0})
            if rnd.random() < 0.12:
                page.append({"kind": rnd.choice(["line", "rule", "table"]), "x": rnd.choice([50, 200]), "y": y, "w": rnd.choice([420, 120]), "h": 12.0})
            y += rnd.choice([14, 16, 16, 24])
        for i, n in enumerate(page):
            n |= {"b": n["y"] + 10, "i": i}
        page.sort(key=lambda n: (n["y"], n["x"], n["i"]))
        nodes += [(doc, 1, n["i"], n["kind"], float(n["x"]), float(n["y"]), float(n["w"]), n["h"], float(n["b"]), 12.0) for n in page]
        regions.append((doc, 1, 50.0, 100.0, 500.0, y - 100, 12.0))
        if found := walk_gap(page, (50.0, 100.0, 500.0, y - 100), 12.0):
            want[doc] = found
    made = spark.createDataFrame(nodes, "doc_id string, page int, ord int, kind string, x double, y double, width double, height double, baseline double, size double")
    got = B.gutters(made, B._regions(spark.createDataFrame(regions, REGION)))
    assert {r.doc_id: (r.left_end, r.right_start) for r in got.collect()} == want
    assert 15 < len(want) < 60


def test_empty_pages(spark):
    assert read(spark, [], [], []) == []
    got = read(spark, [], [("d", 1, 0, "image", 60.0, 110.0, 50.0, 50.0)])
    assert [(r.kind, r.band, r.top) for r in got] == [("image", 0, 100.0)]


def test_nothing_of_a_page_is_broadcast(spark, monkeypatch):
    plans = []

    def settled(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return kept(df)

    kept = B.settled
    monkeypatch.setattr(B, "settled", settled)
    got = read(spark, two("d", 2))
    assert [r.text for r in got] == ["L0", "L1", "R0", "R1"]
    assert len(plans) > 8 and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
