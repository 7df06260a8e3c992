"""Residual ink: components against a flood fill, and the pictures of a page."""

from __future__ import annotations

import random

from leafmill.operators import ink as I  # noqa: E741

RUN = "doc_id string, page int, y int, x0 int, x1 int"
PAGES = "doc_id string, page int, width int, height int, scale double"
SPAN = "doc_id string, page int, ord int, text string, x double, y double, width double, height double, size double"
RULE = "doc_id string, page int, x1 double, y1 double, x2 double, y2 double"


def runs(doc, dark):
    """Runs of a set of dark (x, y)."""
    return [(doc, 1, y, x, x + 1) for x, y in dark]


def flood(cells):
    todo, out = set(cells), []
    while todo:
        stack, seen = [todo.pop()], set()
        while stack:
            y, x = stack.pop()
            seen.add((y, x))
            for c in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if c in todo:
                    todo.discard(c)
                    stack.append(c)
        out.append((min(x for _, x in seen), min(y for y, _ in seen), max(x for _, x in seen), max(y for y, _ in seen), len(seen), min(seen)))
    return sorted(out)


def test_components_are_those_of_a_flood_fill(spark):
    rnd, cells = random.Random(4), {}
    for d in range(12):
        share = rnd.choice([0.2, 0.45, 0.6, 0.8])
        cells[f"d{d}"] = [(y, x) for y in range(18) for x in range(25) if rnd.random() < share]
    made = I.components(spark.createDataFrame([(d, 1, *c) for d, v in cells.items() for c in v], "doc_id string, page int, ty int, tx int"))
    got = {d: [] for d in cells}
    for r in made.collect():
        got[r.doc_id].append((r.x0, r.y0, r.x1, r.y1, r.cells, tuple(r.first)))
    assert {d: sorted(v) for d, v in got.items()} == {d: flood(v) for d, v in cells.items()}


def tiles(dark, w, h, step, covers):
    columns, rows = -(-w // step), -(-h // step)
    mask = {(ty, tx) for x, y, bw, bh in covers for ty in range(max(0, int(y // step)), min(rows, int(-(-(y + bh) // step)))) for tx in range(max(0, int(x // step)), min(columns, int(-(-(x + bw) // step))))}
    count: dict = {}
    for x, y in dark:
        count[y // step, x // step] = count.get((y // step, x // step), 0) + 1
    hit = [c for c, n in count.items() if c not in mask and n >= max(2, step * step * 0.015) and 1 <= c[0] < rows - 1 and 1 <= c[1] < columns - 1]
    return {(y + a, x + b) for y, x in hit for a in (-1, 0, 1) for b in (-1, 0, 1)}


def test_tiles_against_plain_counting(spark):
    rnd = random.Random(2)
    dark = {(rnd.randrange(90), rnd.randrange(70)) for _ in range(500)}
    dark |= {(x, 40) for x in range(20, 80)}
    covers = [(10.0, 10.0, 22.0, 7.0), (-5.0, 60.0, 30.0, 50.0)]
    by_row: dict = {}
    for x, y in sorted(dark):
        row = by_row.setdefault(y, [])
        if row and row[-1][1] == x:
            row[-1][1] = x + 1
        else:
            row.append([x, x + 1])
    rows = [("d", 1, y, a, z) for y, v in by_row.items() for a, z in v]
    made = I.occupied(spark.createDataFrame(rows, RUN), spark.createDataFrame([("d", 1, 90, 70, 1.0)], PAGES), spark.createDataFrame([("d", 1, *c) for c in covers], "doc_id string, page int, x double, y double, width double, height double"))
    assert {(r.ty, r.tx) for r in made.collect()} == tiles(dark, 90, 70, 4, covers)


def test_a_diagram_beside_text(spark):
    diagram = lambda x0, x1, y0, y1: [(y, x, x + 3) for y in range(y0, y1) for x in range(x0 - (y + x0) % 12, x1, 12)]
    body = [(y, 50, 350) for y in range(60, 70)]
    docs = {"body": body + diagram(112, 500, 200, 500), "labels": diagram(112, 500, 200, 500), "map": diagram(112, 500, 200, 420) + diagram(112, 300, 500, 600), "small": diagram(112, 200, 200, 270)}
    ink = spark.createDataFrame([(d, 1, *r) for d, v in docs.items() for r in v], RUN)
    pages = spark.createDataFrame([(d, 1, 600, 800, 1.0) for d in docs], PAGES)
    spans = [(d, 1, 0, "Body text of a page " * 6, 50.0, 60.0, 300.0, 10.0, 10.0) for d in ("body", "labels", "small")] + [("labels", 1, k, "label", 120.0, 210.0 + 20 * k, 300.0, 18.0, 12.0) for k in range(1, 15)] + [("map", 1, 0, "Map", 50.0, 60.0, 30.0, 10.0, 10.0)]
    got = {}
    for r in I.residual_graphics(ink, pages, spark.createDataFrame(spans, SPAN), spark.createDataFrame([], RULE)).collect():
        got.setdefault(r.doc_id, []).append((r.x, r.y, r.width, r.height))
    assert set(got) == {"body", "map"} and len(got["body"]) == len(got["map"]) == 1
    x, y, w, h = got["body"][0]
    assert y > 150 and 95 <= x <= 112 and 380 <= w <= 420 and 295 <= h <= 310
    assert got["map"][0][3] > 390


def test_pixels(spark):
    made = I.runs_of_pixels(spark.createDataFrame([("d", 1, 0, x, c, c, c) for x, c in enumerate((0, 224, 225, 10, 10))], "doc_id string, page int, y int, x int, r int, g int, b int"))
    assert sorted((r.x0, r.x1) for r in made.collect()) == [(0, 2), (3, 5)]


def test_ink_is_dealt_out_by_page_and_tiles_are_no_rows(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    runs_ = I._tile_runs(empty(RUN), empty(PAGES), empty("doc_id string, page int, x double, y double, width double, height double"))
    plan = runs_._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") == 2  # ink with covers, and the pages
    made = I._tile_runs(spark.createDataFrame([("d", 1, y, 8, 4008) for y in range(8, 408)], RUN), spark.createDataFrame([("d", 1, 5000, 500, 1.0)], PAGES), empty("doc_id string, page int, x double, y double, width double, height double"))
    assert sorted((r.ty, r.a, r.z) for r in made.collect()) == [(ty, 1, 1002) for ty in range(1, 103)]
