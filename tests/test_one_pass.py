"""Queries that read a page in one pass: what they find equals the plainer operators, and nothing is dealt out where documents are whole."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import test_bands
from leafmill.operators import bands as B
from leafmill.operators import drawing as Z
from leafmill.operators import fractions as A
from leafmill.operators import lines as L
from leafmill.plans import harness
from pyspark.sql import functions as F


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ")


@pytest.fixture()
def documents(spark, tmp_path):
    rng = random.Random(5)
    words = ["a", "bb", "ccc", "dddd", "12", "eeeee.", "=x", "f" * 9, "1/2"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_drawn_paths_equal_segments_and_paint(spark):
    rng = random.Random(2)
    ops, commands, views = [], [], []
    for page in range(6):
        views.append(("d", page, [rng.choice([1.0, 2.0]), 0.0, rng.choice([0.0, 0.5]), 1.0, 3.0, 4.0]))
        for i in range(60):
            if rng.random() < 0.3:
                ops.append(("d", page, i, *rng.choice([("transform", [1.0, 0.0, 0.0, 2.0, 5.0, 0.0], None), ("save", None, None), ("restore", None, None), ("line_width", [3.0], None), ("fill_color", None, "#ab12ef"), ("opacity", [0.5], None), ("show_text", None, "x")]), None, None, None))
                continue
            path = []
            for _ in range(rng.randint(0, 3)):
                if rng.random() < 0.5:
                    x, y, w, h = (float(rng.randint(1, 40)) for _ in range(4))
                    path += [("M", x, y), ("L", x + w, y), ("L", x + w, y + h), ("L", x, y + h), ("Z", None, None)]
                else:
                    path += [(c, *((None, None) if c == "Z" else (float(rng.randint(0, 9)), float(rng.randint(0, 99))))) for c in rng.choices("MLLLCZ", k=rng.randint(1, 5))]
            ops.append(("d", page, i, "path", None, rng.choice([*Z.STROKES, *Z.FILLS, "end"]), "".join(c[0] for c in path), [c[1] for c in path], [c[2] for c in path]))
            commands += [("d", page, i, k, {"M": "move", "L": "line", "C": "curve", "Z": "close"}[c], x, y) for k, (c, x, y) in enumerate(path)]
    rng.shuffle(ops)
    rows = spark.createDataFrame(ops, "doc_id string, page int, i int, op string, nums array<double>, text string, commands string, xs array<double>, ys array<double>")
    view = spark.createDataFrame(views, "doc_id string, page int, view array<double>")
    made, state = spark.createDataFrame(commands, "doc_id string, page int, i int, k int, command string, x double, y double"), Z.replayed(rows)
    rules, fills = Z.painted(Z.segments(made, state, view), made, state)
    key = lambda rows: sorted(map(repr, rows))
    want = [(r.page, r.i, r.k, "line" if r.k is None else "stroke", r.x1, r.y1, r.x2, r.y2, r.color, r.thickness, None) for r in rules.collect()]
    want += [(r.page, r.i, None, "fill", r.x, r.y, r.x + r.width, r.y + r.height, r.color, None, r.opaque) for r in fills.collect()]
    found = Z.drawn(rows.join(view, ["doc_id", "page"]))
    assert {w[3] for w in want} == {"stroke", "line", "fill"} and key(tuple(r)[1:] for r in found.collect()) == key(want)
    ordered = rows.join(F.broadcast(view), ["doc_id", "page"]).orderBy("page", "i").coalesce(1)
    assert key(tuple(r)[1:] for r in Z.drawn(ordered, together=True).collect()) == key(want)


def test_drawn_paths_deal_nothing_out(spark, documents):
    assert exchanges(harness.drawn_paths(spark, documents)) == 0
    twice = spark.read.parquet(f"{documents}/documents.parquet")
    twice.union(twice.limit(1)).write.parquet(f"{documents}/twice/documents.parquet")
    assert exchanges(harness.drawn_paths(spark, f"{documents}/twice")) == 1


def test_framed_figures_broadcast_nothing(spark, documents):
    found = harness.framed_figures(spark, documents)
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and "Join" not in text


SPAN = "doc_id long, page int, ord long, text string, x double, y double, width double, height double, baseline double, size double"


def test_rows_of_like_neighbours_equal_the_fold(spark):
    rng, rows = random.Random(8), []
    for doc in range(8):
        for k in range(120):
            base = rng.choice([10.0, 11.0, 12.5, 14.0, 20.0, 33.0])
            rows.append((doc, 1, k, rng.choice(["a", "", " ", "b ", " c", "word"]), float(rng.randint(0, 300)), base - 10, float(rng.randint(0, 60)), 12.0, base, rng.choice([6.0, 12.0, 12.0, 20.0])))
    want = []
    for doc in range(8):
        step = L.Rows()
        want += [(doc, r[2], step(r[8], r[9], None)) for r in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[8], r[4], r[2]))]
    spans = spark.createDataFrame(rows, SPAN)
    assert sorted((r.doc_id, r.ord, r.row) for r in L.rows_of(spans).collect()) == sorted(want)
    # Lines and their texts, span by span.
    number, made = {w[:2]: w[2] for w in want}, {}
    for r in sorted(rows, key=lambda r: (r[0], number[r[0], r[2]], r[4], r[2])):
        made.setdefault((r[0], number[r[0], r[2]]), []).append(r)
    texts = []
    for key, spans_ in made.items():
        part, text, tail, end, last = 0, "", " ", None, None
        for _, _, _, t, x, _, width, _, _, size in spans_:
            if end is not None and x - end > max(18.0, 2.5 * min(last, size)):
                texts.append((*key, part, text))
                part, text, tail, end = part + 1, "", " ", None
            if end is not None and x - end > 0.16 * min(last, size) and tail != " " and not t.startswith(" "):
                text += " "
            text += t
            tail, end, last = (text or tail)[-1], x + width, size
        texts.append((*key, part, text))
    for found in (L.lines(spans), L.lines(spans.orderBy("doc_id", "baseline", "x", "ord").coalesce(1), together=True), L.lines(spans.orderBy("doc_id", "ord").coalesce(1), together=True)):
        assert sorted((r.doc_id, r.row, r.part, r.text) for r in found.collect()) == sorted(texts)


def test_lines_of_documents_deal_nothing_out(spark, documents):
    assert exchanges(harness.lines_grouped_map(spark, documents)) == 0


def test_paragraphs_deal_lines_out_twice(spark, documents):
    assert exchanges(harness.paragraphs_grouped_map(spark, documents)) == 2


def test_footers_read_documents_once(spark, documents):
    """As dealt out, where a document comes twice under other ids."""
    found = harness.footer_lines(spark, documents)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # what can stand in a footer is settled
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    docs.union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(99).cast("long")).union(docs.where("doc_id = 3").selectExpr("99L", "text"))).write.parquet(f"{documents}/more/documents.parquet")
    dealt = harness.footer_lines(spark, f"{documents}/more").where("doc_id < 99")
    got = sorted(tuple(r) for r in found.collect())
    assert got and got == sorted(tuple(r) for r in dealt.collect())


def test_appearance_where_documents_are_read(spark, documents):
    """Nothing is dealt out; as dealt out once, where a document comes twice under other ids."""
    found = harness.text_appearance(spark, documents)
    assert exchanges(found) == 0
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    docs.union(docs.where("doc_id = 3").selectExpr("99L", "text").union(docs.where("doc_id = 3").selectExpr("99L", "text"))).write.parquet(f"{documents}/more/documents.parquet")
    dealt = harness.text_appearance(spark, f"{documents}/more").where("doc_id < 99")
    assert exchanges(dealt) == 1
    got = sorted(map(repr, map(tuple, found.collect())))
    assert got and got == sorted(map(repr, map(tuple, dealt.collect())))


@pytest.mark.parametrize("name", [n for n in dir(test_bands) if n.startswith("test_") and "broadcast" not in n and "gutter_" not in n])
def test_pages_are_read_in_bands_as_the_joins_read_them(spark, monkeypatch, name):
    monkeypatch.setattr(B, "bands", B.read_in_bands)
    getattr(test_bands, name)(spark)


def test_reading_order_deals_nothing_out(spark, documents):
    assert exchanges(harness.reading_order(spark, documents)) == 0


def test_fractions_where_documents_are_read(spark, documents):
    """Nothing is dealt out; as the operator finds them, where a document comes twice under other ids."""
    found = harness.stacked_fractions(spark, documents)
    assert exchanges(found) == 0
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    docs.union(docs.where("doc_id = 3").selectExpr("99L", "text").union(docs.where("doc_id = 3").selectExpr("99L", "text"))).write.parquet(f"{documents}/more/documents.parquet")
    dealt = harness.stacked_fractions(spark, f"{documents}/more").where("doc_id < 99")
    got = sorted(tuple(r) for r in found.collect())
    assert got and got == sorted(tuple(r) for r in dealt.collect())


def test_stacked_equals_fractions_on_random_pages(spark):
    rng, spans, rules = random.Random(6), [], []
    texts = ["x", "2", "=", "a=", "y,", "∑+b", "c × &", "'d", "∑+e,"]
    for page in range(120):
        for k in range(rng.choice([12, 20, 45])):
            y, place = 20.0 * (1 + k // 3 % 12), rng.choice(["over", "over", "side", "side", "left"])
            base = y - 5 if place == "over" else y + rng.choice([0, 1])
            x, width = {"over": (rng.choice([100, 110, 120]), rng.choice([15, 20, 40])), "side": (162, 20), "left": (76, 20)}[place]
            spans.append(("d", page, k, rng.choice(texts), float(x), base - 10, float(width), 12.0, base, rng.choice([8.0, 12.0, 12.0, 12.0]), "pdf", rng.choice(["CambriaMath", "Serif"])))
        rules += [("d", page, k, 100.0, 20.0 * y, float(rng.choice([140, 150, 160])), 20.0 * y) for k, y in enumerate(rng.sample(range(1, 13), 8))]
    made = A.fractions(
        spark.createDataFrame(spans, "doc_id string, page int, ord int, text string, x double, y double, width double, height double, baseline double, size double, source string, font string"),
        spark.createDataFrame(rules, "doc_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double"),
    )[0]
    want = sorted((r.page, r.bar, r.size, r.numerator, r.denominator) for r in made.collect())
    column = lambda rows, k: np.array([r[k] for r in rows])
    span = {c: column(spans, k) for c, k in (("ord", 2), ("x", 4), ("y", 5), ("width", 6), ("baseline", 8), ("size", 9))}
    found = A.stacked(column(spans, 1), span, pa.array([r[3] for r in spans]), column(spans, 11) == "CambriaMath", column(rules, 1), {"x": column(rules, 3), "end": column(rules, 5), "y": column(rules, 4)})
    assert len(want) > 8 and sorted((rules[f[0]][1], rules[f[0]][2], *f[1:]) for f in found) == want
