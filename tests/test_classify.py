"""Footers, drawn rules, overlays, page classification, row tests, resources and anchors on hand-built records."""

from __future__ import annotations

from leafmill.operators import classify as Y
from leafmill.operators import forms, setup
from leafmill.operators import lines as L
from leafmill.operators import pages as P
from leafmill.operators import spans as S
from pyspark.sql import functions as F

SPAN = "doc_id string, page int, ord int, text string, x double, y double, width double, height double, baseline double, size double, source string"
RULE = "doc_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double"
BOX = "doc_id string, page int, ord int, x double, y double, width double, height double"
PAGES = "doc_id string, page int, width double, height double, body_size double, source string"


def span(ord_, text, x, y, width=40.0, size=12.0, doc="d", page=1, source="pdf", height=12.0):
    return (doc, page, ord_, text, float(x), float(y), float(width), float(height), float(y) + 10, float(size), source)


def test_footers(spark):
    rows = [span(0, "Body", 50, 100), span(1, "Page 3 of 9", 280, 780), span(0, "May", 280, 770, doc="e"), span(1, "2024", 280, 783, doc="e"), span(0, "12", 290, 760, doc="f", source="ocr"), span(0, "12", 290, 700, doc="g")]
    rows += [span(0, "Title", 50, 781, doc="h"), span(1, "7", 300, 781, 10, doc="h"), span(0, "9", 300, 781, 10, 30, doc="i")]
    pages = spark.createDataFrame([(d, 1, 600.0, 800.0, 12.0, "ocr" if d == "f" else "pdf") for d in "defghi"], PAGES)
    again = spark.createDataFrame([("h", 1, 0)], "doc_id string, page int, ord int")
    got = {(r.doc_id, r.ord) for r in Y.footers(spark.createDataFrame(rows, SPAN), pages, again).collect()}
    assert got == {("d", 1), ("f", 0), ("h", 0), ("h", 1)}  # a date's year, a number too high up and one too large are none


def test_drawn_rules(spark):
    rules = [("d", 1, 0, 50.0, 100.0, 150.0, 100.0), ("d", 1, 1, 51.0, 101.0, 151.0, 101.0), ("d", 1, 2, 50.0, 200.0, 60.0, 200.0), ("d", 1, 3, 50.0, 790.0, 150.0, 790.0), ("d", 1, 4, 50.0, 300.0, 50.0, 400.0), ("d", 1, 5, 310.0, 300.0, 350.0, 300.0), ("d", 1, 6, 50.0, 500.0, 150.0, 500.0), ("d", 1, 7, 50.0, 104.0, 150.0, 104.0)]
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0, 12.0, "pdf")], PAGES)
    tables = spark.createDataFrame([("d", 1, 0, 300.0, 290.0, 100.0, 50.0)], BOX)
    under = spark.createDataFrame([("d", 1, 6)], "doc_id string, page int, ord int")
    assert {r.ord for r in Y.drawn_rules(spark.createDataFrame(rules, RULE), pages, tables, under).collect()} == {0, 7}


def test_overlays(spark):
    figures = spark.createDataFrame([("d", 1, 0, 5.0, 100.0, 20.0, 90.0), ("d", 1, 1, 320.0, 300.0, 40.0, 40.0), ("d", 1, 2, 0.0, 400.0, 500.0, 200.0), ("d", 1, 3, 100.0, 650.0, 90.0, 60.0), ("d", 1, 4, 400.0, 20.0, 60.0, 60.0), ("e", 1, 0, 5.0, 100.0, 20.0, 90.0)], BOX)
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0, 12.0, "pdf"), ("e", 1, 600.0, 800.0, 12.0, "ocr")], PAGES)
    tables = spark.createDataFrame([("d", 1, 0, 300.0, 290.0, 100.0, 60.0)], BOX)
    text = spark.createDataFrame([span(0, "beside", 50, 450), span(1, "Title", 50, 30, size=20)], SPAN)
    assert {(r.doc_id, r.ord): r.overlay for r in Y.overlays(figures, pages, tables, text).collect()} == {("d", 0): True, ("d", 1): True, ("d", 2): True, ("d", 3): False, ("d", 4): True, ("e", 0): False}


def test_classified(spark):
    grid = [("d", 1, i, 10.0, 10.0 + 20 * i, 110.0, 10.0 + 20 * i) for i in range(3)] + [("d", 1, 5 + i, 10.0 + 50 * i, 10.0, 10.0 + 50 * i, 50.0) for i in range(3)]
    rules = spark.createDataFrame([*grid, ("d", 1, 20, 200.0, 321.0, 240.0, 321.0), ("d", 1, 21, 100.0, 600.0, 400.0, 600.0)], RULE)
    rows = [span(0, "3", 20, 15, 20, 8), span(1, "b", 70, 15, 20, 8), span(2, "Text", 100, 310), span(3, "under", 200, 310), span(4, "12", 295, 780, 12), span(5, " ", 1, 1)]
    figures = spark.createDataFrame([("d", 1, 0, 100.0, 650.0, 90.0, 60.0)], BOX)
    parts = Y.classified(spark.createDataFrame(rows, SPAN), rules, figures, spark.createDataFrame([("d", 1, 600.0, 800.0, "pdf")], "doc_id string, page int, width double, height double, source string"))
    ords = lambda name: sorted(r.ord for r in parts[name].collect())
    assert parts["tables"].count() == 1 and ords("cells") == [0, 1] and ords("open_cells") == [] and ords("footer") == [4] and ords("rules") == [21] and ords("figures") == [0]
    assert {r.ord: r.underline for r in parts["text"].collect()} == {2: False, 3: True}


def test_pairs_of_a_row(spark):
    word = span(0, "Word", 10, 100, 40)
    marks = [span(1, "2", 51, 96, 5, 8, height=8), span(2, "2", 90, 96, 5, 8, height=8), span(3, "2", 51, 100, 5, 12), span(4, "title that is long", 51, 96, 100, 8, height=8)]
    left, right = (spark.createDataFrame(x, SPAN).alias(n) for n, x in (("a", [word]), ("b", marks)))
    assert {r.ord for r in left.join(right, L.script_pair("a", "b")).select("b.ord").collect()} == {1}
    assert {r.ord for r in right.join(left, L.script_pair("b", "a")).select("b.ord").collect()} == {1}  # in either order
    scans = [span(1, "、", 51, 106, 5, 12, height=5, source="ocr"), span(2, "long", 51, 106, 5, 12, height=5, source="ocr"), span(3, "、", 90, 106, 5, 12, height=5, source="ocr")]
    left, right = (spark.createDataFrame(x, SPAN).alias(n) for n, x in (("a", [span(0, "字", 10, 100, 40, source="ocr")]), ("b", scans)))
    assert {r.ord for r in left.join(right, L.fragment_pair("a", "b")).select("b.ord").collect()} == {1}


def test_aligned_fields(spark):
    rows = []
    for d, shift in (("left", 0.0), ("ragged", 9.0)):
        for r in range(4):
            rows += [(d, r, *span(c, "x" * (c + r + 1), 100 * c + (shift * r if c else 0), 100 + 14 * r, 10.0 * (r + 1) if c < 2 else 20.0)[2:]) for c in range(3)]
    fields = spark.createDataFrame(rows, "grp string, row int, ord int, text string, x double, y double, width double, height double, baseline double, size double, source string")
    assert {r.grp: r.aligned for r in L.aligned_fields(fields, ["grp"]).collect()} == {"left": True, "ragged": False}
    assert not L.aligned_fields(fields.where("grp = 'left' and row < 2"), ["grp"]).first().aligned


def test_wrapped_and_tightened(spark):
    images = spark.createDataFrame([("d", 1, 0, 300.0, 100.0, 80.0, 60.0), ("d", 1, 1, 300.0, 102.0, 80.0, 60.0), ("d", 1, 2, 20.0, 400.0, 80.0, 60.0)], BOX)
    paragraphs = spark.createDataFrame([("d", 1, 4, "body", 12.0, 20.0, 100.0, 200.0, 60.0), ("d", 1, 5, "body", 12.0, 20.0, 105.0, 200.0, 60.0), ("d", 1, 6, "heading", 12.0, 150.0, 400.0, 200.0, 60.0)], "doc_id string, page int, paragraph long, role string, size double, x double, y double, width double, height double")
    assert {r.ord: r.paragraph for r in Y.wrapped_images(images, paragraphs).collect()} == {0: 4, 1: 5}
    blocks = spark.createDataFrame([("d", 1, 0, "paragraph", 0.0, 1, 15.0, 12.0), ("d", 1, 1, "paragraph", 13.0, 2, 15.0, 12.0), ("d", 1, 2, "image", 30.0, None, None, None)], "doc_id string, page int, ord int, kind string, y double, lines int, line_height double, size double")
    assert [r.line_height for r in Y.tightened(blocks).orderBy("ord").collect()] == [13.0, 15.0, None]


def test_anchors(spark):
    item = lambda d, k, t, x, y=10.0, w=10.0: (d, 1, k, t, float(x), float(y), float(w), 10.0, True)
    rows = [item("d", 0, "The total sum", 5), item("d", 1, "other", 100), item("e", 0, "to", 5), item("e", 1, "tal", 15.5, w=12.0), item("e", 2, "ly", 90), item("f", 0, "to", 5), item("f", 1, "tal", 15.5, 40.0), item("g", 0, "ｔｏｔａｌ", 5), item("e", 3, "to", 200), item("e", 4, "tal", 210)]
    items = spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, x double, y double, width double, height double, ltr boolean")
    targets = spark.createDataFrame([(1, "total"), (2, "nowhere"), (3, " ")], "target int, text string")
    assert sorted((r.target, r.doc_id, r.x) for r in Y.anchors(items, targets).collect()) == [(1, "d", 5.0), (1, "e", 5.0), (1, "e", 200.0), (1, "g", 5.0)]


def test_resources_and_order(spark):
    schema = "doc_id string, category string, name string, value string"
    target = spark.createDataFrame([("d", "Font", "F1", "a"), ("d", "XObject", "F1-2", "b")], schema)
    source = spark.createDataFrame([("d", "Font", "F1", "c", 0), ("d", "Font", "F2", "d", 1), ("d", "XObject", "F1", "e", 2), ("d", "Font", "F1-3", "f", 3)], schema + ", ord int")
    got = {(r.category, r.name, r.value, r.old) for r in forms.merged_resources(target, source).collect()}
    assert got == {("Font", "F1", "a", "F1"), ("XObject", "F1-2", "b", "F1-2"), ("Font", "F1-4", "c", "F1"), ("XObject", "F1-4", "e", "F1"), ("Font", "F2", "d", "F2"), ("Font", "F1-3", "f", "F1-3")}
    order = spark.createDataFrame([("d", 0, 7), ("d", 1, 8), ("d", 2, 9)], "doc_id string, pos int, node int")
    assert [(r.pos, r.node) for r in forms.calculation_order(order, order.where("node <> 8").select("doc_id", "node")).orderBy("pos").collect()] == [(0, 7), (1, 9)]


def test_totals(spark):
    files = spark.createDataFrame([("a", True, False, 3, 10, 1.5), ("a", True, False, 4, 10, 0.7), ("b", True, False, 3, 10, None), ("c", True, True, 1, 1, 1.0), ("c", True, False, 1, 1, 1.0), ("d", True, False, 500, 1, 2.0), ("d", True, False, 500, 1, None)], "k string, loaded boolean, failed boolean, pages int, bytes int, aspect double")
    assert {r.k: (r.pages, r.ready, r.mixed) for r in P.merge_state(files, ["k"]).collect()} == {"a": (7, True, True), "b": (3, False, False), "c": (2, False, False), "d": (1000, False, False)}
    assert {r.k: r.error for r in P.merge_error(files, ["k"]).collect()} == {"a": None, "b": None, "c": None, "d": "too many pages"}
    read = spark.createDataFrame([("p", 74.0), ("p", 75.0), ("p", None)], "page string, confidence double")
    assert S.low_confidence(read, ["page"]).first().low == 2
    images = spark.createDataFrame([("a", 10, 10, False), ("a", 20, 10, False), ("b", 10, 10, True), ("c", 9000, 1, False), ("e", None, 1, False)], "k string, width int, height int, mismatch boolean")
    assert {r.k: r.pixels for r in setup.pixel_sum(images, ["k"]).collect()} == {"a": 300, "b": None, "c": None, "e": None}
    embedded = spark.createDataFrame([(0, ["DCTDecode"], 8, "DeviceRGB", 3, 20000, False), (1, ["DCTDecode"], 8, "ICCBased", 4, 20000, False), (2, ["FlateDecode", "DCTDecode"], 8, "DeviceRGB", 3, 20000, False), (3, ["DCTDecode"], 8, "ICCBased", 1, 16384, None), (4, ["DCTDecode"], 8, "DeviceRGB", 3, 20000, True)], "i int, filters array<string>, bits int, space string, components int, length int, masked boolean").withColumn("decoded", F.lit(None).cast("boolean"))
    assert {r.i for r in setup.recompressible(embedded).collect()} == {0, 3}
