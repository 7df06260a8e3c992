"""OCR readings and figures on hand-built records."""

from __future__ import annotations

import random

import pytest
from leafmill.functions import text as X
from leafmill.operators import figures as Fig
from leafmill.operators import forms, ocr, setup
from pyspark.sql import functions as F

BOX = "doc_id string, page int, ord int, x double, y double, width double, height double"


def test_words(spark):
    w = lambda t, x0, x1, h=10.0: {"text": t, "confidence": 90.0, "bbox": {"x0": x0, "y0": 0.0, "x1": x1, "y1": h}}
    line = lambda words, h=10.0: {"bbox": {"x0": 0.0, "y0": 0.0, "x1": 100.0, "y1": h}, "words": words}
    schema = f"doc_id string, page int, blocks array<struct<paragraphs:array<struct<lines:array<struct<bbox:struct<x0:double,y0:double,x1:double,y1:double>,words:array<struct<{ocr.WORD.replace(' string', ':string').replace(' double', ':double').replace('bbox struct', 'bbox:struct')}>>>>>>>>"
    rows = [("d", 1, [{"paragraphs": [{"lines": [line([w("a", 0.0, 20.0), w("b", 30.0, 50.0, 11.0), w("c", 60.0, 80.0, 30.0)]), line([w("down", 0.0, 9.0)], 500.0)]}]}])]
    found = ocr.words(spark.createDataFrame(rows, schema), scale=2.0)
    assert [(r.text, r.x, r.width) for r in found.orderBy("word").collect()] == [("a", 0.0, 10.0), ("b", 15.0, 10.0), ("c", 30.0, 10.0)]
    assert ocr.type_size(found, ["doc_id", "page", "line_id"]).first()["size"] == 5.25


def brute(before, sure, after, now):
    """Plain dynamic programming with the same ways back."""
    a, b = list(zip(before, sure, strict=True)), list(zip(after, now, strict=True))
    d = [[max(i, j) if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1][0] != b[j - 1][0]))
    out, i, j = list(after), len(a), len(b)
    while i and j:
        if d[i][j] == d[i - 1][j - 1] + (a[i - 1][0] != b[j - 1][0]):
            if a[i - 1][0] != b[j - 1][0] and a[i - 1][1] >= max(60, b[j - 1][1] + 12):
                out[j - 1] = a[i - 1][0]
            i, j = i - 1, j - 1
        elif d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return "".join(out)


def test_consensus(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(60):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        rows.append((k, a, [float(rnd.choice((50, 70, 90))) for _ in a], b, [float(rnd.choice((40, 60, 80))) for _ in b]))
    got = {r.id: r.text for r in ocr.consensus(spark.createDataFrame(rows, "id int, before string, before_confidence array<double>, after string, after_confidence array<double>")).collect()}
    assert got == {k: brute(a, s, b, t) if a and b else b for k, a, s, b, t in rows}


def test_readings(spark):
    rows = spark.createDataFrame([("12", "12", 80.0, 95.0), ("12", "l2", 80.0, 95.0), ("12", "13", 92.0, 96.0), ("word", "words", 60.0, 76.0), ("word", "", 10.0, 99.0), ("word", "word and much more", 80.0, 99.0), ("", "x", 0.0, 70.0)], "a string, b string, was double, now double")
    assert [r.p for r in rows.select(ocr.prefer_cell(*(F.col(c) for c in ("a", "b", "was", "now"))).alias("p")).collect()] == [True, False, False, True, False, False, True]
    line = "doc_id string, page int, x double, width double, baseline double, size double"
    sizes = lambda base: [r["size"] for r in ocr.even_sizes(spark.createDataFrame([("d", 1, 0.0, 50.0, float(b), float(s)) for b, s in zip(base, (10, 18, 10), strict=True)], line)).orderBy("baseline").collect()]
    assert sizes((100, 112, 124)) == [10, 10, 10] and sizes((100, 180, 265)) == [10, 18, 10]
    page = spark.createDataFrame([("d", 1, 10.0, 400.0, 15.0 * i, 10.0) for i in range(30)], line)
    assert {r.leading for r in ocr.leading(page).collect()} == {1.5}


def test_line_retry(spark):
    cases = [
        ([("三、同意參與土過必建販權利範圍:", 64.0)], "三、同意參與土地及建物權利範圍:", 91.0, True), ([("請核對文件全部內容及附件", 72.0)], "請核對文件", 99.0, False), ([("土地面積", 65.0), ("34.25", 95.0)], "土地面積34.29", 99.0, False),
        ([("請核對文件全部內容及附件", 70.0)], "這是完全不同的文字與其他句子", 99.0, False), ([("", 10.0)], "", 99.0, False), ([("a b c d e", 70.0)], "abcde", 90.0, True), ([("12", 80.0), ("total", 60.0)], "13total", 90.0, True),
        ([("x" * 401, 10.0)], "x" * 401, 99.0, False), ([("surer", 90.0)], "surer", 92.0, False),
    ]
    rows = spark.createDataFrame([(i, [{"text": t, "confidence": c} for t, c in before], after, now) for i, (before, after, now, _) in enumerate(cases)], "id int, spans array<struct<text:string,confidence:double>>, after string, now double")
    was = F.expr("aggregate(spans, 0D, (a, s) -> a + s.confidence * length(s.text)) / greatest(1, aggregate(spans, 0, (a, s) -> a + length(s.text)))")
    got = rows.select("id", X.edit_accept(F.array_join("spans.text", ""), F.col("after"), was, F.col("now"), X.sure_numbers(F.col("spans"))).alias("ok")).orderBy("id").collect()
    assert [r.ok for r in got] == [c[-1] for c in cases]


def test_horizontal_pages(spark):
    prose = lambda width=420, count=30: [(80.0, 60.0 + i * 18, 80.0 + width, 72.0 + i * 18) for i in range(count)]
    columns = [(300.0 if i % 2 else 0.0, b, (300.0 if i % 2 else 0.0) + 300, d) for i, (_, b, _, d) in enumerate(prose(300))]
    halves = prose(210)
    cases = {
        "dense": (prose(), True), "narrow": (prose(240), False), "wide": (prose(320), True), "columns": (columns, False), "few": (prose(420, 10), False), "grid": (prose(), False),
        "split": (halves + [(296.0, b, 430.0, d) for _, b, _, d in halves], True), "gutter": (halves + [(320.0, b, 430.0, d) for _, b, _, d in halves], False),
    }
    lines = spark.createDataFrame([(k, 1, *b) for k, (rows, _) in cases.items() for b in rows], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(k, 1, 600.0) for k in cases], "doc_id string, page int, width double")
    rules = spark.createDataFrame([("grid", 1, 50.0, 50.0, 550.0, 50.0), ("grid", 1, 50.0, 100.0, 550.0, 100.0), ("grid", 1, 50.0, 50.0, 50.0, 100.0), ("grid", 1, 550.0, 50.0, 550.0, 100.0)], "doc_id string, page int, x1 double, y1 double, x2 double, y2 double")
    assert {r.doc_id: r.prose for r in ocr.horizontal_prose(lines, pages, rules).collect()} == {k: want for k, (_, want) in cases.items()}
    text = "第一條：文件內容需要逐字核對。第二條：所有資料在瀏覽器內處理。"
    pairs = [(0, text, text.replace("核對", "校對"), 85, 90), (1, text, text[:15], 85, 99), (2, text, text, 85, 80), (3, text, "無關文字" * 8, 85, 99), (4, "", "", 1, 1), (5, "a😀 b", "a😀b", 1, 1)]
    got = ocr.prefer_horizontal(spark.createDataFrame(pairs, "id int, a string, b string, was int, now int"), ["id"], "a", "b", "was", "now").orderBy("id").collect()
    assert [r.accepted for r in got] == [True, False, False, False, False, False] and got[2].dice == 1.0 and abs(got[5].dice - 4 / 6) < 1e-9


def test_figures(spark):
    pieces = [("d", -10.0, 20.0, 60.0, 40.0), ("d", 40.0, 20.0, 60.0, 40.0), ("d", 100.0, 20.0, 40.0, 40.0), ("d", 180.0, 80.0, 50.0, 30.0), ("d", 0.0, 0.0, 300.0, 400.0), ("e", 20.0, 30.0, 50.0, 50.0), ("e", 69.0, 30.0, 50.0, 50.0)]
    pieces += [("f", 0.0, 0.0, 200.0, 10.0), ("f", 150.0, 5.0, 40.0, 100.0), ("f", float("nan"), 0.0, 9.0, 9.0), ("f", 5.0, 300.0, 2.0, 9.0)]  # an edge stamp on a thin strip stays apart
    boxes = spark.createDataFrame([(d, 1, i, *b) for i, (d, *b) in enumerate(pieces)], BOX)
    sides = spark.createDataFrame([(d, 1, 300.0, 400.0) for d in "def"], "doc_id string, page int, width double, height double")
    whole = {(r.doc_id, r.x, r.y, r.width, r.height) for r in Fig.tiles(boxes, sides).collect()}
    assert whole == {("d", 0.0, 20.0, 140.0, 40.0), ("d", 180.0, 80.0, 50.0, 30.0), ("e", 20.0, 30.0, 99.0, 50.0), ("f", 0.0, 0.0, 200.0, 10.0), ("f", 150.0, 5.0, 40.0, 100.0)}
    images = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 50.0, 50.0), ("d", 1, 1, 80.0, 2.0, 50.0, 50.0), ("d", 1, 2, 200.0, 3.0, 50.0, 50.0), ("d", 1, 3, 0.0, 200.0, 50.0, 50.0)], BOX)
    texts = spark.createDataFrame([("d", 1, 9, 150.0, 10.0, 30.0, 10.0)], BOX)
    assert {r.ord: r.row for r in Fig.image_rows(images, texts).collect()} == {0: 1, 1: 1, 2: 2, 3: 3}
    tables = spark.createDataFrame([("d", 1, 5, 300.0, 0.0, 100.0, 60.0)], BOX)
    assert [r.ord for r in Fig.beside_tables(images.where("ord in (1, 2)"), tables, texts).collect()] == [2]


def test_backgrounds_and_controls(spark):
    fills = spark.createDataFrame([("d", 1, 0, 10.0, 10.0, 36.0, 12.0, "000000", 10, True), ("d", 1, 1, 100.0, 10.0, 36.0, 12.0, "ffff00", 10, True)], f"{BOX}, color string, paint_order int, opaque boolean")
    spans = spark.createDataFrame([("d", 1, 7, 12.0, 11.0, 20.0, 10.0, "ffffff", 19.0, 11), ("d", 1, 8, 102.0, 11.0, 20.0, 10.0, "ffffff", 19.0, 11)], f"{BOX}, color string, baseline double, paint_order int")
    found = Fig.label_backgrounds(fills, spans)
    assert [(r.ord, r.ids) for r in found.collect()] == [(0, [7])]
    paragraphs = spark.createDataFrame([("d", 1, 3, [6, 7]), ("d", 1, 4, [8])], "doc_id string, page int, paragraph int, ids array<int>")
    assert [(r.ord, r.paragraph) for r in Fig.background_owner(found, paragraphs).collect()] == [(0, 3)]
    controls = spark.createDataFrame([("d", 1, 0, 10.0, 10.0, 10.0, 10.0), ("d", 1, 1, 200.0, 10.0, 10.0, 10.0)], BOX)
    labels = spark.createDataFrame([("d", 1, 1, 25.0, 10.0, 60.0, 10.0), ("d", 1, 2, 215.0, 9.0, 60.0, 10.0), ("d", 1, 3, 215.0, 12.0, 60.0, 10.0)], BOX).withColumnRenamed("ord", "paragraph")
    assert [(r.ord, r.paragraph) for r in Fig.control_labels(controls, labels).collect()] == [(0, 1)]


def test_setup_and_forms(spark):
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0, 200, 50.0, 60.0), ("d", 2, 601.0, 800.0, 20, 90.0, 40.0), ("d", 3, 300.0, 800.0, 20, 90.0, 40.0)], "doc_id string, page int, width double, height double, spans int, left double, right double")
    assert {r.page: (r.left, r.right) for r in setup.borrowed_margins(pages).collect()} == {1: (50.0, 60.0), 2: (50.0, 40.0), 3: (90.0, 40.0)}
    fields = spark.createDataFrame([("d", 1, None, None), ("d", 2, 1, 1), ("d", 3, 1, 2), ("d", 4, None, None)], "doc_id string, node int, parent int, page int")
    one = spark.createDataFrame([("d", 1)], "doc_id string, page int")
    assert {r.node for r in forms.retained(fields, one).collect()} == {1, 2}
    assert {r.node for r in forms.retained(fields, one, all_pages=True).collect()} == {1, 2, 4}
    chain = spark.createDataFrame([("d", i, i - 1 if i else None, 1 if i == 30 else None) for i in range(31)], "doc_id string, node int, parent int, page int")
    assert forms.retained(chain, one).count() == 31
    for bad in ([("d", 1, 2, 1), ("d", 2, 1, None)], [("d", 1, 3, 1), ("d", 1, 4, 1)], [("d", i, i - 1 if i else None, 1) for i in range(70)]):
        with pytest.raises(ValueError, match="circle|several"):
            forms.retained(spark.createDataFrame(bad, chain.schema), one)


def test_pages_of_tiles_are_no_groups_of_pandas(spark):
    rnd = random.Random(7)
    for _ in range(200):
        n = rnd.randint(0, Fig.FEW)
        corners = Fig.np.array([(x, y, x + rnd.choice((10, 10.5, 20)), y + rnd.choice((10, 10.9, 30))) for x, y in ((rnd.randrange(0, 60, 5), rnd.randrange(0, 60, 5)) for _ in range(n))], dtype=float).reshape(-1, 4)
        few = Fig._figures(corners, 1.15)
        Fig.FEW, kept = -1, Fig.FEW
        many = Fig._figures(corners, 1.15)
        Fig.FEW = kept
        assert few == many
    rows = [(f"d{d}", 1, k, 10.0, 10.0 + 20 * k, 30.0, 20.0) for d in range(700) for k in range(1 + d % 40)]
    sides = spark.createDataFrame([(f"d{d}", 1, 600.0, 900.0) for d in range(700)], "doc_id string, page int, width double, height double")
    whole = Fig.tiles(spark.createDataFrame(rows, BOX).repartition(3), sides)
    assert "FlatMapGroupsInPandas" not in whole._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.y, r.height) for r in whole.coalesce(1).collect()) == sorted((f"d{d}", 10.0, 20.0 * (1 + d % 40)) for d in range(700))
