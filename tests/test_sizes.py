"""What queries shuffle: plans that must not deal large rows out again and again."""

from __future__ import annotations

import random
import statistics

import pandas as pd
import pyarrow as pa
import pytest
from leafmill.functions import text as X
from leafmill.operators import classify as Y
from leafmill.operators import drawing as Z
from leafmill.operators import folds as H
from leafmill.operators import fractions as A
from leafmill.operators import lines as L
from leafmill.operators import margins as N
from leafmill.operators import spans as S
from leafmill.operators import tables as B
from leafmill.plans import synth
from leafmill.shared import settled

SPAN = "doc_id long, page int, ord long, text string, x double, y double, width double, height double, baseline double, size double"
SHEET = "doc_id long, page int, width double, height double, body_size double, source string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(df) -> int:
    return plan(df).count("Exchange ")


def scattered(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 3), 1, k, rng.choice(["a", "", "b ", " c", "word"]), rng.uniform(0, 400), 0.0, rng.uniform(5, 60), 12.0, rng.choice([rng.uniform(0, 200), 12.0 * rng.randint(1, 12)]), rng.choice([6.0, 9.0, 12.0, 20.0])) for k in range(n)]
    return spark.createDataFrame([(*r[:5], r[8] - 10, *r[6:]) for r in rows], SPAN)


@pytest.fixture()
def documents(spark, tmp_path):
    texts = ["one two  three\nfour\n\n five ", "", None, "é 漢字 x\r\ny"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_spans_are_cut_where_documents_are_read(spark, documents):
    spans = synth.spans(spark, documents)
    assert exchanges(spans) == 0
    got = [(r.doc_id, r.line_no, r.ord, r.text, r.x, r.width) for r in spans.orderBy("doc_id", "line_no", "ord").collect()]
    want = []
    for k, text in enumerate(["one two  three\nfour\n\n five ", "", None, "é 漢字 x\r\ny"]):
        for i, line in enumerate(text.split("\n") if text is not None else []):
            at = 0
            for j, word in enumerate(line.split(" ")):
                want.append((k, i, j, word, 6.0 * at, 6.0 * len(word)))
                at += len(word) + 1
    assert got == want


def test_lines_are_dealt_out_once(spark):
    assert exchanges(L.rows_of(scattered(spark))) == 1
    assert exchanges(L.lines(scattered(spark))) == 1


def test_lines_equal_windows_over_their_rows(spark):
    spans = scattered(spark)
    parts = L.split_at_gaps(L.rows_of(spans)).toPandas().sort_values(["doc_id", "row", "x", "ord"])
    got = L.lines(spans).toPandas().sort_values(["doc_id", "row", "part"]).reset_index(drop=True)
    want = []
    for key, s in parts.groupby(["doc_id", "row", "part"]):
        main = s[s["size"] >= 0.85 * s["size"].max()]
        want.append((*key, s.x.min(), s.y.min(), (s.x + s.width).max() - s.x.min(), (s.y + s.height).max() - s.y.min(), main["size"].median(), main.baseline.median(), len(s)))
    want = pd.DataFrame(want, columns=["doc_id", "row", "part", "x", "y", "width", "height", "size", "baseline", "n"])
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    held = L.split_at_gaps(L.rows_of(spans)).groupBy("doc_id", "row", "part").agg(L._text(L.F.array_sort(L.F.collect_list(L.F.struct("x", "ord", "width", "size", "text")))).alias("text"))
    assert got.text.tolist() == [r.text for r in held.orderBy("doc_id", "row", "part").collect()]


def test_paragraphs_are_not_joined_back(spark):
    assert "Join" not in plan(L.paragraphs(L.lines(scattered(spark))))


def test_footers_carry_texts_of_low_spans_only(spark):
    rows = [(1, 1, k, f"w{k}", 10.0 * k, 12.0 * k, 8.0, 10.0, 12.0 * k + 10, 12.0) for k in range(5)] + [(1, 1, 9, "7", 300.0, 960.0, 6.0, 10.0, 970.0, 12.0)]
    found = Y.footers(spark.createDataFrame(rows, SPAN), spark.createDataFrame([(1, 1, 600.0, 1000.0, 12.0, "pdf")], SHEET))
    assert [(r.ord, r.text) for r in found.collect()] == [(9, "7")]
    deals = [x for x in plan(found).splitlines() if "Exchange hashpartitioning(_group" in x]
    assert len(deals) == 1


def test_settled_tables_are_not_broadcast(spark):
    small = settled(spark.range(1000).selectExpr("id % 3 as k", "id"))
    joined = spark.range(10).withColumnRenamed("id", "k").join(small, "k")
    assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)


def test_paint_and_text_are_dealt_out_once(spark):
    spans = spark.createDataFrame([(1, 1, 0, "ab"), (1, 1, 1, " "), (1, 1, 2, "cd"), (2, 1, 0, "x")], "doc_id long, page int, ord long, text string")
    runs = spark.createDataFrame([(1, 1, 0, "abc"), (1, 1, 1, "d"), (2, 1, 5, "yx")], "doc_id long, page int, i int, text string")
    found = Z.aligned(spans, runs)
    assert exchanges(found) == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 0, 0, 2), (1, 1, 2, 2, 4), (2, 1, 0, 1, 2)]


def test_pages_of_words_are_cut_where_documents_are_read(spark, documents):
    pages = synth.page_words(spark, documents, 2)
    assert exchanges(pages) == 0
    want = {}
    for r in synth.words(spark, documents, 2).collect():
        want.setdefault((r.doc_id, r.page), {})[r.k] = r.text
    assert {(r.doc_id, r.page): dict(enumerate(r.words)) for r in pages.collect()} == want


def test_replay_returns_what_is_wanted(spark):
    ops = spark.createDataFrame([(1, 1, 0, "fill_color", None, "ff0000"), (1, 1, 1, "show_text", None, "a"), (2, 1, 0, "show_text", None, "b")], "doc_id long, page int, i int, op string, nums array<double>, text string")
    found = Z.replayed(ops, ["fill"])
    assert found.columns == ["doc_id", "page", "i", "op", "nums", "text", "fill"]
    assert sorted((r.doc_id, r.i, r.fill) for r in found.collect()) == [(1, 0, "FF0000"), (1, 1, "FF0000"), (2, 0, "000000")]


def test_touching_boxes_are_no_groups_of_pandas(spark):
    rng = random.Random(5)
    rows = [(d, 1, k, rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(1, 30), rng.uniform(1, 30)) for d in range(300) for k in range(d % 60)]
    got = B.touching(spark.createDataFrame(rows, "doc_id long, page int, ord long, x double, y double, width double, height double").repartition(3), 2.0)
    assert "FlatMapGroupsInPandas" not in plan(got)
    want, pages = {}, {}
    for r in rows:
        pages.setdefault(r[0], []).append(r[2:])
    for d, boxes in pages.items():
        root = list(range(len(boxes)))
        for i, (_, x, y, w, h) in enumerate(boxes):
            hit = {root[k] for k, (_, p, q, v, u) in enumerate(boxes[: i + 1]) if p <= x + w + 2 and x <= p + v + 2 and q <= y + h + 2 and y <= q + u + 2}
            root = [min(hit) if c in hit else c for c in root]
        want |= {(d, k): root[k] for k in range(len(boxes))}
    assert {(r.doc_id, r.ord): r.component for r in got.collect()} == want


def test_links_end_as_stars_in_settled_tables(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(2000 + k, 2001 + k) for k in range(70)] + [(5000, 5000), (2000, 2000)]
    got = B.linked(settled(spark.createDataFrame(edges, "a long, b long")))
    assert "ExistingRDD" not in plan(got)  # checkpoints are made twice
    root: dict = {}
    for a, b in edges:
        x, y = (root.setdefault(c, c) for c in (a, b))
        root = {c: min(x, y) if r in (x, y) else r for c, r in root.items()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(root) and dict(rows) == root


def test_only_slanted_spans_meet_the_body_size(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), 1, k, rng.choice(["a", "", "word", None]), rng.choice([0.0, 0.5, 20.0, 45.0, -30.0, 70.0, None]), rng.choice([8.0, 9.5, 12.0, 20.0, 40.0, None])) for k in range(4000)]
    spans = settled(spark.createDataFrame(rows, "doc_id long, page int, ord long, text string, angle double, size double"))
    got = S.decorative(spans)
    only = plan(got.where("decorative"))
    assert "ObjectHashAggregate" not in only and "Union" not in only
    want = {}
    for d in {r[0] for r in rows}:
        flat = [r for r in rows if r[0] == d and r[4] is not None and abs(r[4]) < 1]
        sizes = [r[5] for r in flat if r[5] is not None]
        body, chars = statistics.median(sizes) if sizes else 12.0, sum(len(r[3]) for r in flat if r[3] is not None)
        want |= {r[2]: chars > 50 and r[4] is not None and 20 < abs(r[4]) < 70 and r[5] is not None and r[5] > 2 * body for r in rows if r[0] == d}
    assert got.columns == [*spans.columns, "decorative"] and {r.ord: r.decorative for r in got.collect()} == want


def test_texts_are_normalised_in_small_slices(spark):
    texts = ["ｆｏｏ　bar", None, "", "é  x"] * 40
    assert X.nfkc.func(pa.array(texts)).to_pylist() == ["foobar", None, "", "éx"] * 40
    assert X.nfkc.func(pa.array([], pa.string())).to_pylist() == []


def test_fractions_are_dealt_out_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(A, "settled", lambda df: calls.append(exchanges(df)) or settled(df))
    word = lambda k, text, x, base: (1, 1, k, text, x, base - 10, 40.0, 12.0, base, 12.0, "pdf", "F")
    # A chain of bars, each under the last one's denominator.
    spans = [word(k, f"w{k}", 110.0, 20.0 + 17 * k) for k in range(9)] + [word(20 + k, "x =", 55.0, 27.0 + 17 * k) for k in range(8)]
    bars = [(1, 1, k, 100.0, 26.0 + 17 * k, 160.0, 26.0 + 17 * k) for k in range(8)]
    out, members, texts = A.fractions(spark.createDataFrame(spans, "doc_id long, page int, ord long, text string, x double, y double, width double, height double, baseline double, size double, source string, font string"), spark.createDataFrame(bars, "doc_id long, page int, ord long, x1 double, y1 double, x2 double, y2 double"))
    assert calls == [1]
    assert sorted((r.bar, r.text) for r in out.collect()) == [(k, f"w{k}/w{k + 1}") for k in range(0, 8, 2)]
    assert members.count() == 8 and texts.count() == 0


def test_underlined_spans_are_not_sorted(spark):
    rng = random.Random(4)
    spans = scattered(spark, 600).withColumn("doc_id", H.F.when(H.F.col("ord") % 50 == 0, None).otherwise(H.F.col("doc_id")))
    flat = [(rng.choice([1, 2, 3, 4, None]), 1, rng.choice([0.0, 100.0, 250.0]), rng.choice([rng.uniform(0, 200), 12.0 * rng.randint(1, 12) + 1, None]), rng.choice([90.0, 300.0, 500.0])) for _ in range(80)]
    rules = [(d, p, k, a, y, z, y) for k, (d, p, a, y, z) in enumerate(flat)] + [(1, 1, 100, 0.0, 13.0, 500.0, 40.0), flat[0][:2] + (101, flat[0][2], flat[0][3], flat[0][4], flat[0][3])]
    lines = settled(spark.createDataFrame(rules, "doc_id long, page int, ord int, x1 double, y1 double, x2 double, y2 double"))
    marked, free = S.underlined(spans, lines)
    assert exchanges(marked) == 2 and "Sort [" not in plan(marked) and "BuildRight" in plan(marked)
    # Nor is it spans that a rule is looked up among.
    found = plan(free)[plan(free).index("ShuffledHashJoin") :]
    assert "Sort [" not in found and "BuildRight" in found.splitlines()[0]
    held = [(s.ord, r[2]) for s in spans.collect() for r in rules if None not in (s.doc_id, r[0], r[4]) and s.doc_id == r[0] and abs(r[4] - r[6]) < 1.5 and -1 < (r[4] + r[6]) / 2 - s.baseline < 0.25 * s["size"] and s.x >= min(r[3], r[5]) - 2 and s.x + s.width <= max(r[3], r[5]) + 2]
    assert sorted(r.ord for r in marked.collect()) == sorted({a for a, _ in held}) and held
    assert sorted(r.ord for r in free.collect()) == sorted({r[2] for r in rules} - {b for _, b in held})


def test_margins_are_one_deal_and_one_aggregate(spark):
    # Each sort, join, window and aggregate of one stage holds memory of its own until the task ends.
    pages = settled(spark.createDataFrame([("d", k, 600.0, 800.0, "pdf", None) for k in range(1, 48)] + [("d", None, 600.0, 800.0, "pdf", None)], "doc_id string, page int, width double, height double, source string, flow_bottom double"))
    blocks = [("d", k, "paragraph", "body", "left", 90.0, 3.0 * k, 420.0, 30.0, 2, 15.0, 1) for k in range(1, 47)] + [("d", None, "table", None, None, 1.0, 1.0, 500.0, 30.0, 1, 15.0, 1), ("d", 99, "table", None, None, 1.0, 1.0, 500.0, 30.0, 1, 15.0, 1), ("d", 47, None, None, None, 1.0, 1.0, 1.0, 1.0, 1, 1.0, 1)]
    blocks = settled(spark.createDataFrame(blocks, "doc_id string, page int, kind string, role string, align string, x double, y double, width double, height double, lines int, line_height double, columns int"))
    evidence, chosen = N.margin_evidence(pages, blocks), N.chosen_margins(pages, blocks)
    assert exchanges(evidence) == 1 and plan(evidence).count("Sort [") == 1
    assert exchanges(chosen) == 2 and not any(x in plan(chosen) for x in ("Join", "Window", "Generate"))
    said = {r.page: (r.left, r.right, r.top, r.bottom, r.reliable) for r in evidence.collect()}
    assert said == {k: (90.0, 90.0, 3.0 * k, None, True) for k in range(1, 47)} | {47: (None, None, None, None, False), None: (None, None, None, None, False)}
    # Neither blocks without a page nor those without a kind count; content that is near the top holds the preset back.
    assert [(r.pages, r.preset, r.left, r.right, r.top, r.bottom) for r in chosen.collect()] == [(48, "detected", 90.0, 90.0, 0.0, 72.0)]


def test_the_value_a_fifth_reaches(spark):
    rows = spark.createDataFrame([(n, float(k * k % n)) for n in range(1, 120) for k in range(n)], "n int, v double")
    got = rows.groupBy("n").agg(H.F.expr("percentile_disc(0.2) WITHIN GROUP (ORDER BY v)").alias("q"))
    assert {r.n: r.q for r in got.collect()} == {n: sorted(float(k * k % n) for k in range(n))[int((n - 1) * 0.2)] for n in range(1, 120)}


def test_groups_stay_whole_over_batches():
    rng = random.Random(2)
    keys = sorted(((rng.choice(["a", "b"]), rng.choice([None, 1, 2, 3, 4])) for _ in range(60)), key=str)
    rows = pa.table({"k": [a for a, _ in keys], "j": pa.array([b for _, b in keys], pa.int32())})
    for size in (1, 2, 7, 13, 60):
        found = [[(r["k"], r["j"]) for r in part.slice(a, b - a).to_pylist()] for part, starts in H.whole_rows(iter(rows.to_batches(size)), ["k", "j"]) for a, b in zip(starts, [*starts[1:], part.num_rows], strict=True)]
        assert [g[0] for g in found] == list(dict.fromkeys(keys)) and all(len(set(g)) == 1 for g in found) and sum(found, []) == keys
