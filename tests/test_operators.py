"""Operators on hand-built records: what they must do, and what they must leave alone."""

from __future__ import annotations

import io
import math
import random
import struct
import zipfile
import zlib

import pytest
from leafmill import constants as C
from leafmill.functions import geometry as G
from leafmill.functions import text as X
from leafmill.operators import lines as L
from leafmill.operators import pages as P
from leafmill.operators import spans as S
from leafmill.operators import tables as B
from leafmill.sources import archives, images
from pyspark.sql import functions as F

SPAN = "doc_id string, page int, ord int, text string, x double, y double, width double, height double, baseline double, size double"


def span(ord_, text, x, y, width=200.0, size=12.0, page=1, doc="d"):
    return (doc, page, ord_, text, float(x), float(y), float(width), float(size), float(y) + size - 2, float(size))


@pytest.mark.parametrize(
    ("text", "count", "want"),
    [("5, 1-3, 3，8", 8, [1, 2, 3, 5, 8]), ("1、2", 3, [1, 2]), ("007", 9, [7]), ("2 – 4", 5, [2, 3, 4]), ("0, 2", 5, None), ("4-8", 5, None), ("3-1", 5, None), ("1,,3", 5, None), ("", 5, None), ("x", 5, None), (None, 5, None)],
)
def test_page_range(spark, text, count, want):
    got = spark.createDataFrame([(text, count)], "t string, n int").select(P.page_range(F.col("t"), F.col("n")).alias("r")).first()["r"]
    assert got["pages"] == want and (got["error"] is None) == (want is not None)


def test_plans(spark):
    plan = spark.createDataFrame([(1, [2, 1, 2]), (2, [3])], "group_id int, pages array<int>")
    pages = spark.createDataFrame([(i, 100 + i) for i in range(1, 5)], "page int, width int")
    rows = P.plan_pages(plan, pages).orderBy("group_id", "pos").collect()
    assert [(r.group_id, r.page, r.width) for r in rows] == [(1, 2, 102), (1, 1, 101), (1, 2, 102), (2, 3, 103)]
    assert {r.page: r.times for r in P.multiplicity(plan).collect()} == {1: 1, 2: 2, 3: 1}
    one = spark.range(1).select(P.page_batches(F.array(*[F.lit(i) for i in (1, 2, 1, 3, 3)])).alias("b"), P.every_page_plan(3).alias("e"), P.toggled(F.array(F.lit(1), F.lit(3)), F.lit(2)).alias("t"), P.toggled(F.array(F.lit(1), F.lit(3)), F.lit(3)).alias("u")).first()
    assert one.b == [[1, 2], [1, 3], [3]] and [x.name for x in one.e] == ["01", "02", "03"] and one.t == [1, 2, 3] and one.u == [1]


def test_ordered_union(spark):
    pages = spark.createDataFrame([(2, 1, 200), (1, 2, 102), (1, 1, 101), (2, 2, 201)], "file int, page int, width int")
    assert [r.width for r in P.ordered_union(pages, "file", "page").orderBy("position").collect()] == [101, 102, 200, 201]


def test_greedy_intake_passes_over(spark):
    px = 2200 * 2200
    rows = spark.createDataFrame([("d", i, px) for i in range(3)] + [("d", 3, 10)], "doc string, ord int, pixels long")
    got = P.greedy_intake(rows, ["doc"], "ord", "pixels", 2 * px).orderBy("ord").collect()
    assert [r.accepted for r in got] == [True, True, False, False]
    got = P.greedy_intake(rows, ["doc"], "ord", "pixels", 2 * px + 50).orderBy("ord").collect()
    assert [r.accepted for r in got] == [True, True, False, True]


def test_names(spark):
    rows = spark.createDataFrame([("p", i, n) for i, n in enumerate(["name", "Name", "name-1", "name"])], "plan string, ord int, name string")
    assert [r.filename for r in P.unique_names(rows, ["plan"], "ord", "name").orderBy("ord").collect()] == ["name", "Name-2", "name-1", "name-3"]
    got = spark.createDataFrame([("a/b.PDF",), (".pdf",), ("x?.pdf.pdf",)], "n string").select(X.file_stem(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["a_b", "document", "x_.pdf"]
    got = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 * 1024 * 1024 + 52429,)], "n long").select(X.human_bytes(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.1 MB"]


def test_errors(spark):
    got = spark.createDataFrame([("a.pdf", 1, 1), ("a.txt", 1, 1), ("a.PDF", 0, 1), ("a.pdf", C.FILE_BYTES + 1, 1), ("a.pdf", 1, 0), ("a.pdf", 1, 601)], "n string, s long, p int")
    assert [r.e for r in got.select(P.file_error(F.col("n"), F.col("s"), F.col("p")).alias("e")).collect()] == [None, "not a pdf", "empty", "too large", "no pages", "too many pages"]


def test_geometry(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 5.0, 5.0)], "ax double, ay double, aw double, ah double, bx double, by double, bw double, bh double")
    a, b = G.Box(*(F.col(f"a{c}") for c in "xywh")), G.Box(*(F.col(f"b{c}") for c in "xywh"))
    got = rows.select(G.overlaps(a, b).alias("o"), G.touches(a, b).alias("t"), G.intersects(a, b).alias("i"), G.contains_box(a, b, 5.0).alias("c"), G.twips(F.lit(-0.125)).alias("w"), G.emu(F.lit(1.0)).alias("e")).first()
    assert tuple(got) == (False, True, False, True, -2, 12700)


def test_aggregates(spark):
    rows = spark.createDataFrame([span(0, "a", 10, 10, size=10), span(1, "bb", 30, 5, size=14), span(2, " ", 1, 1), span(3, "c", float("nan"), 1)], SPAN)
    live = S.live(rows)
    assert live.count() == 2 and S.body_size(live).first().body_size == 12.0
    assert tuple(S.line_bounds(live, ["page"]).first())[1:] == (10.0, 5.0, 220.0, 15.0)
    assert live.limit(0).agg(G.median(F.col("size")).alias("m")).first().m == 12.0
    values = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2, 3, 9)], "v double")
    assert values.agg(G.lower_quantile(F.col("v"), 0.2).alias("q")).first().q == 2.0


def test_clusters_are_anchored(spark):
    got = spark.range(1).select(S.clusters(F.array(*[F.lit(v) for v in (9.0, 1.0, 3.5, 2.5)]), 2.0).alias("c")).first().c
    assert got == [[1.0, 2.5], [3.5], [9.0]]


def test_intervals_and_coverage(spark):
    rows = spark.createDataFrame([("p", 0.0, 10.0), ("p", 5.0, 8.0), ("p", 11.0, 20.0), ("p", 40.0, 50.0)], "p string, a double, z double")
    assert sorted((r.a, r.z) for r in S.merged_intervals(rows, ["p"], "a", "z", 6.0).collect()) == [(0.0, 20.0), (40.0, 50.0)]
    cover = lambda hi: S.covered(rows, ["p"], "a", "z", F.lit(0.0), F.lit(hi)).first().covered
    assert cover(20.0) and cover(21.5) and not cover(50.0)


def test_occlusion_underline_nearest(spark):
    spans = spark.createDataFrame([span(0, "under", 10, 10, 40), span(1, "free", 10, 100, 40)], SPAN).withColumn("paint_order", F.lit(5))
    fill = "doc_id string, page int, x double, y double, width double, height double, paint_order int, opaque boolean"
    later = spark.createDataFrame([("d", 1, 9.0, 9.0, 50.0, 20.0, 9, True), ("d", 1, 9.0, 90.0, 50.0, 30.0, 1, True), ("d", 1, 9.0, 90.0, 50.0, 30.0, 9, False)], fill)
    assert [r.text for r in S.occluded(spans, later).collect()] == ["under"]
    rules = spark.createDataFrame([("d", 1, 0, 10.0, 21.0, 50.0, 21.0), ("d", 1, 1, 10.0, 300.0, 50.0, 300.0)], "doc_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double")
    line = spark.createDataFrame([span(i, t, 10 + 25 * i, 200, 20) for i, t in enumerate("abc")] + [span(3, "d", 100, 200, 20)], SPAN)
    long = spark.createDataFrame([("d", 1, 0, 9.0, 211.0, 81.0, 211.0), ("d", 1, 1, 100.0, 212.0, 106.0, 212.0)], rules.schema)
    marked, free = S.underlined(line, long)
    assert sorted(r.text for r in marked.collect()) == ["a", "b", "c"] and [r.ord for r in free.collect()] == [1]  # one rule under three words; a stub under a word is none
    marked, free = S.underlined(spans, rules)
    assert [r.text for r in marked.collect()] == ["under"] and [r.ord for r in free.collect()] == [1]
    left, right = spark.createDataFrame([("k", 1, 10)], "k string, id int, at int"), spark.createDataFrame([("k", 0, 13, "a"), ("k", 1, 7, "b"), ("k", 2, 30, "c")], "k string, ord int, other int, v string")
    assert S.nearest(left, right, ["k"], "id", "at", "other", 5, "v").first().v == "a"


def test_footer_needs_two_pages(spark):
    rows = [span(0, "Page", 50, 780, page=1), span(1, "Page", 50, 781, page=2), span(2, "Once", 300, 780, page=1), span(3, "Page", 50, 100, page=3)]
    pages = spark.createDataFrame([("d", i, 600.0, 800.0) for i in (1, 2, 3)], "doc_id string, page int, width double, height double")
    assert {r.ord for r in S.recurring_footer(spark.createDataFrame(rows, SPAN), pages).collect()} == {0, 1}


def test_lines(spark):
    rows = [span(0, "Left", 10, 100, 40), span(1, "next", 54, 100.4, 40), span(2, "far", 200, 100, 40), span(3, "below", 10, 120, 40), span(4, "tall", 96, 98, 30, size=14)]
    got = {(r.text, r.n) for r in L.lines(spark.createDataFrame(rows, SPAN)).collect()}
    assert got == {("Left next tall", 3), ("far", 1), ("below", 1)}
    joined = {r.text for r in L.lines(spark.createDataFrame(rows, SPAN), join_wide_gaps=True).collect()}
    assert joined == {"Left next tall\tfar", "below"}


def test_paragraphs(spark):
    rows = [span(i, t, x, y, w) for i, (t, x, y, w) in enumerate([("A first line that is wide", 10, 100, 400), ("and goes on to its end.", 10, 115, 150), ("A new one begins here now", 10, 130, 400), ("• an item of a list", 10, 145, 300), ("that hangs", 25, 160, 300), ("Far below, apart from all", 10, 240, 400)])]
    rows.append(span(9, "Title", 10, 60, 90, size=20))
    got = L.paragraphs(L.lines(spark.createDataFrame(rows, SPAN))).orderBy("paragraph").collect()
    assert [(r.lines, r.role) for r in got] == [(1, "heading"), (2, "body"), (1, "body"), (2, "list"), (1, "body")]
    assert [r.text for r in got][1:4] == ["A first line that is wide and goes on to its end.", "A new one begins here now", "• an item of a list that hangs"]
    assert [(r.indent, r.first_indent, r.last_width) for r in got][3] == (0.0, 0.0, 300.0)
    assert archives.docx(L.paragraphs(L.lines(spark.createDataFrame(rows, SPAN)))).count() == 1
    data = archives.docx(L.paragraphs(L.lines(spark.createDataFrame(rows, SPAN)))).first().docx
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        assert "Title" in z.read("word/document.xml").decode()


def test_paragraph_breaks(spark):
    """Pages of two lines each and more: which of them begin a paragraph."""
    wide = ("a wide line of text", 10, 400)
    pages = {
        "chinese": [wide, ("一、第一項", 10, 200), ("接著的內容", 20, 200)], "article": [("第一條", 10, 400), ("內容", 10, 400)], "hyphen": [("a hyphen-", 10, 400), ("ated word", 10, 400)], "leaves": [("1. item", 40, 370), ("body again", 10, 400)],
        "indent": [wide, ("indented", 30, 380)], "jump": [wide, wide, ("far", 90, 300), ("farther", 140, 250)], "ended": [("Short end.", 10, 100), wide], "ids": [wide, wide],
    }
    want = {"chinese": [1, 2], "article": [1, 1], "hyphen": [2], "leaves": [1, 1], "indent": [1, 1], "jump": [2, 1, 1], "ended": [1, 1], "ids": [1, 1]}
    rows = [(d, 1, i, t, float(x), 100.0 + 15 * i, float(w), 12.0, 110.0 + 15 * i, 12.0) for d, p in pages.items() for i, (t, x, w) in enumerate(p)]
    lines = L.lines(spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, x double, y double, width double, height double, baseline double, size double"))
    lines = lines.withColumn("paragraph_id", F.when(F.col("doc_id") == "ids", F.col("row")))
    got = {}
    for r in L.paragraphs(lines).orderBy("doc_id", "paragraph").collect():
        got.setdefault(r.doc_id, []).append((r.lines, r.text))
    assert {d: [n for n, _ in v] for d, v in got.items()} == want
    assert got["hyphen"][0][1] == "a hyphen-ated word" and got["chinese"][1][1] == "一、第一項接著的內容"


def test_ruled_and_open_tables(spark):
    rule = "doc_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double"
    grid = [("d", 1, i, 10.0, 10.0 + 20 * i, 110.0, 10.0 + 20 * i) for i in range(3)] + [("d", 1, 5 + i, 10.0 + 50 * i, 10.0, 10.0 + 50 * i, 50.0) for i in range(3)]
    words = [span(0, "a", 20, 15, 20, 8), span(1, "b", 70, 15, 20, 8), span(2, "c", 20, 35, 20, 8), span(3, "out", 300, 300, 20, 8)]
    tables, cells = B.ruled(spark.createDataFrame(words, SPAN), spark.createDataFrame(grid, rule))
    assert tables.count() == 1 and {(r.ord, r.row, r.column) for r in cells.collect()} == {(0, 0, 0), (1, 0, 1), (2, 1, 0)}
    register = spark.createDataFrame([*grid, *[("d", 1, 20 + i, 110.0, 10.0 + 20 * i, 160.0, 10.0 + 20 * i) for i in range(3)]], rule)
    side = [*words, span(4, "12", 120, 15, 30, 8)]
    wide, inside = B.ruled(spark.createDataFrame(side, SPAN), register)
    assert wide.first().xs == [10.0, 60.0, 110.0, 160.0] and {(r.ord, r.column) for r in inside.collect()} == {(0, 0), (1, 1), (2, 0), (4, 2)}
    assert B.ruled(spark.createDataFrame(words, SPAN), register)[0].first().xs == [10.0, 60.0, 110.0]  # no text in the strip
    border, _ = B.ruled(spark.createDataFrame(words, SPAN), spark.createDataFrame([g for g in grid if g[2] in (0, 2, 5, 7)], rule))
    assert border.count() == 0  # a border alone is no table
    title = [span(90 + c, name, 20 + 80 * c, 186, 20, 10) for c, name in enumerate(("one", "two", "three"))]
    body = [span(10 * r + c, str(100 * r + c), 20 + 80 * c, 205 + 15 * r, 20, 10) for r in range(4) for c in range(3)]
    numbers = [*title, *body]
    bars = spark.createDataFrame([("d", 1, 0, 10.0, 200.0, 260.0, 200.0), ("d", 1, 1, 10.0, 270.0, 260.0, 270.0)], rule)
    got = {(r.ord, r.row, r.column) for r in B.open_numeric(spark.createDataFrame(numbers, SPAN), bars).collect()}
    assert got == {(10 * r + c, r + 1, c) for r in range(4) for c in range(3)} | {(90 + c, 0, c) for c in range(3)}
    assert B.open_numeric(spark.createDataFrame(body, SPAN), bars).count() == 0  # no header row
    close = [*title, *[span(10 * r + c, str(100 * r + c), 20 + 23 * c, 205 + 15 * r, 20, 10) for r in range(4) for c in range(3)]]
    assert B.open_numeric(spark.createDataFrame(close, SPAN), bars).count() == 0  # gaps under half a size merge
    prose = title + [span(10 * r + c, "word", 20 + 80 * c, 205 + 15 * r, 20, 10) for r in range(4) for c in range(3)]
    assert B.open_numeric(spark.createDataFrame(prose, SPAN), bars).count() == 0


def test_components(spark):
    boxes = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 10.0, 10.0), ("d", 1, 1, 15.0, 0.0, 10.0, 10.0), ("d", 1, 2, 100.0, 0.0, 10.0, 10.0), ("d", 1, 3, 27.0, 5.0, 5.0, 5.0)], "doc_id string, page int, ord int, x double, y double, width double, height double")
    assert {r.ord: r.component for r in B.touching(boxes, 8.0).collect()} == {0: 0, 1: 0, 2: 2, 3: 0}
    assert {r.node: r.component for r in B.linked(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41)], "a long, b long")).collect()} == {**{i: 0 for i in range(21)}, 40: 40, 41: 40}


def jpeg(width, height, orientation=None, comment=False):
    out = b"\xff\xd8"
    if orientation:
        exif = b"Exif\0\0MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0"
        out += b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif
    if comment:
        out += b"\xff\xfe" + struct.pack(">H", 7) + b"hello"
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\0" + b"\xff\xda\0\x03x"


def webp(width, height):
    body = b"VP8L" + struct.pack("<I", 5) + b"\x2f" + ((width - 1) | (height - 1) << 14).to_bytes(4, "little") + b"\0"
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def test_images(spark):
    pixels = bytes(range(12))
    files = {"a": images.png(4, 3, pixels), "b": jpeg(640, 480, 6), "c": webp(33, 44), "d": b"junk", "e": images.png(4, 3, pixels)[:-6], "f": jpeg(20000, 1), "g": b""}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r.path: (r.format, r.width, r.height, r.orientation, r.error is None) for r in images.inspected(rows).collect()}
    assert got["a"] == ("png", 4, 3, 1, True) and got["b"] == ("jpg", 640, 480, 6, True) and got["c"] == ("webp", 33, 44, 1, True)
    assert not any(got[k][-1] for k in "defg")
    kinds = {r.path: r.k for r in rows.select("path", images.source_type(F.col("content")).alias("k")).collect()}
    assert kinds == {"a": "png", "b": "jpg", "c": "webp", "d": None, "e": "png", "f": "jpg", "g": None}
    assert images.stripped(images.png(4, 3, pixels, b"k\0v")) == images.png(4, 3, pixels) and images.stripped(jpeg(9, 9, 3, True)) == jpeg(9, 9, 3)
    profile = bytearray(200)
    profile[:4], profile[16:20], profile[36:40] = struct.pack(">I", 200), b"RGB ", b"acsp"
    long = bytearray(150_000)
    long[:4], long[16:20], long[36:40] = struct.pack(">I", 150_000), b"RGB ", b"acsp"
    for plain in (images.png(4, 3, pixels), jpeg(7, 5, 6)):
        assert images.profile_of(plain) is None and images.with_profile(plain, None) == plain
        for p in (bytes(profile), bytes(long)):
            assert images.profile_of(images.with_profile(plain, p)) == p and images.profile_of(images.with_profile(images.with_profile(plain, bytes(profile)), p)) == p
    cut = images.with_profile(jpeg(7, 5), bytes(long))
    (_, a, z, _) = images.jpeg_segments(cut)[1]
    broken = {"ok": cut, "lost": cut[:a] + cut[z:], "none": jpeg(7, 5), "bad": images.with_profile(jpeg(7, 5), bytes(profile[:190]))}
    told = {r.path: (r.space, r.length, r.error is None) for r in images.profiles(spark.createDataFrame([(k, bytearray(v)) for k, v in broken.items()], "path string, content binary")).collect()}
    assert told == {"ok": ("RGB ", 150_000, True), "lost": (None, None, False), "none": (None, None, True), "bad": (None, None, False)}
    assert images.upright(jpeg(640, 480, 6)) == jpeg(640, 480) and images.upright(images.png(4, 3, pixels)) == images.png(4, 3, pixels) and images.upright(webp(33, 44)) == webp(33, 44)
    named = images.chunked(spark.createDataFrame([("p", bytearray(images.with_profile(images.png(4, 3, pixels, b"k\0v"), bytes(profile))))], "path string, content binary"))
    assert [r.type for r in images.colour_chunks(named).collect()] == ["iCCP"]
    chunks = images.png_chunks(images.png(4, 3, pixels))
    (start, end) = next((a, z) for k, a, z, _ in chunks if k == "IDAT")
    assert len(zlib.decompress(images.png(4, 3, pixels)[start + 8 : end - 4])) == 3 * 5 and all(c[3] for c in chunks)


def test_batches_of_sources(spark):
    rows = spark.createDataFrame([("a", "pdf", 9), ("b", "pdf", 9), ("b", "png", 9), ("c", "png", 9), ("c", "jpg", 9), ("d", "pdf", 9), ("d", "pdf", 9), ("e", "png", 0), ("f", None, 4)], "batch string, kind string, length long")
    got = {r.batch: (r.error, r.kind) for r in images.batch_error(rows, ["batch"]).collect()}
    assert got == {"a": (None, "pdf"), "b": ("mixed", None), "c": (None, "images"), "d": ("one pdf only", None), "e": ("empty", None), "f": ("unsupported", None)}


def test_archives_and_stream(spark, tmp_path):
    members = spark.createDataFrame([("g", 1, "b.txt", bytearray(b"two")), ("g", 0, "a.txt", bytearray(b"one"))], "grp string, ord int, name string, data binary")
    with zipfile.ZipFile(io.BytesIO(bytes(archives.zipped(members, "grp").first().archive))) as z:
        assert z.namelist() == ["a.txt", "b.txt"] and z.read("b.txt") == b"two"
    from leafmill.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.png").write_bytes(images.png(4, 3, bytes(12)))
    (tmp_path / "in" / "y.jpg").write_bytes(jpeg(7, 5))
    for _ in range(2):  # the second run finds nothing new
        ingest.inspect_into(ingest.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {(r.format, r.width) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("png", 4), ("jpg", 7)}


def test_text(spark):
    rows = spark.createDataFrame([("漢字", "かな"), ("word", "next"), ("hyphen-", "ated"), ("(", "in"), ("end", ", more"), ("", "x"), ("前一句。", "下一句"), ("soft\u00ad", "ly"), ("Ä-", "ß"), ("3-", "ated"), ("x\u3000", "y"), ("字", "「引"), ("。", "word"), ("50", "%")], "a string, b string")
    assert [r.s for r in rows.select(X.join_separator(F.col("a"), F.col("b")).alias("s")).collect()] == ["", " ", "", "", "", "", "", "", "", " ", "", "", " ", " "]
    marks = spark.createDataFrame([("1. One",), ("• Two",), ("(3)Three",), ("Plain",), ("3.14 is",), ("（12） x",), ("a) x",), ("一、甲",), ("（二十）乙",), ("第三條 丙",), ("第3條",), ("1234. x",)], "t string")
    marks = marks.select(X.list_marker(F.col("t")).alias("m"), X.line_marker(F.col("t")).alias("k")).collect()
    assert [bool(r.m) for r in marks] == [True, True, True, False, False, True, False, False, False, False, False, False]
    assert [r.k for r in marks] == ["list", "list", "list", None, None, "list", None, "chinese", "chinese", "article", "article", None]
    tokens = spark.createDataFrame([(t,) for t in ("-", "5×", "+1,234.5%", "−3", "(3)", "1a", "--1", " 7 ", "")], "t string").select(X.numeric_token(F.col("t")).alias("n")).collect()
    assert [r.n for r in tokens] == [True, True, True, True, False, False, False, True, False]
    numbers = spark.createDataFrame([("Page 3 of 9",), ("第 12 頁",), ("4/7",), ("- 5 -",), ("Chapter 5",)], "t string").select(X.page_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in numbers] == [3, 12, 4, 5, None]
    fonts = spark.createDataFrame([(t,) for t in ("ABCDEF+Arial-Bold", "Times", "CMR10", "DejaVuSerif-Sans", "ABCDEF+Cousine-BoldItalic", "CMTT9", "Noto Sans CJK TC", "Bold")], "t string").select(X.font_name(F.col("t")).alias("n"), X.font_family(F.col("t")).alias("f")).collect()
    assert fonts[0].n == "Arial-Bold" and [r.f for r in fonts] == ["Arial", "Times New Roman", "Times New Roman", "DejaVuSerif-Sans", "Cousine", "Courier New", "Arial", "Arial"]
    assert spark.createDataFrame([("ｆｏｏ　bar",), (None,)], "t string").select(X.nfkc("t").alias("n")).collect()[0].n == "foobar"


def test_skew(spark):
    rnd = random.Random(17)
    points = [(g, float(x), float(12 * k) + 0.5 + x * {0: 0.0, 1: math.tan(math.radians(1.5)), 2: math.tan(math.radians(-3))}[g]) for g in range(3) for k in range(40) for x in (rnd.randrange(500) for _ in range(60))]
    got = {r.g: math.degrees(math.atan(r.slope)) for r in S.skew(spark.createDataFrame(points, "g int, px double, py double"), ["g"]).collect()}
    assert got[0] == 0 and abs(got[1] - 1.5) < 0.3 and abs(got[2] + 3) < 0.3
