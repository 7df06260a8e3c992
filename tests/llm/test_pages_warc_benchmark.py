"""Main text, fixity audits and benchmark passages."""

from __future__ import annotations

import gzip
import random
import re
from collections import Counter

import pytest
from leafmill.llm import decontaminate, main_text, warc
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header class="site">Site name</header>
<nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad --><div class="cookie-notice"><p>We use cookies, and more, and more.</p></div>
{body}<aside><p>Also, see, this, long, list, of, things.</p></aside><form><p>Sign up, now, please.</p><input></form>
<div id="comments"><p>First, I say, and I say it, loudly.</p></div><footer>&copy; Us</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head</h1><p>One,  two\n three &amp; four&nbsp;five.<p>Next <b>bold</b> <a href=x>link</a> text.</article>", "Head\nOne, two three & four five.\nNext bold link text."),
        ("<div class='post-content'><h2>Head</h2><p>A short one.</p><p>Another, longer one, with commas, and words enough to count.</p><div class='share'>Share it</div></div>", "Head\nA short one.\nAnother, longer one, with commas, and words enough to count."),
        ("<div><div><p>Deep, text, here, and more of it to read.</p></div><div><p>Its sibling, too, with quite some words.</p></div></div>", "Deep, text, here, and more of it to read.\nIts sibling, too, with quite some words."),
        ("<main><p>Tiny</main>", "Tiny"),
        ("", ""),
    ],
)
def test_main_text(body, want):
    assert main_text.main_text(PAGE.format(body=body)) == want


ARTICLE = "<h1>Head</h1><p>One sentence, and another, long enough to be read as prose by anyone.</p><p>A second paragraph, with commas, and more words to count.</p>"


@pytest.mark.parametrize(
    "around",
    ["<div class='post has-sidebar'>%s</div>", "<div class='layout-sidebar-right'>%s</div>", "<div class='no-comments'>%s</div>", "<section class='related-work'>%s</section>", "<div id='notice'>%s</div>", "<div class='shares-and-bonds'>%s<div class='social-share'><a href=x>Share</a></div></div>"],
)
def test_names_do_not_lose_articles(around):
    assert main_text.main_text(PAGE.format(body=around % ARTICLE)).split("\n") == ["Head", "One sentence, and another, long enough to be read as prose by anyone.", "A second paragraph, with commas, and more words to count."]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><p>Press <button>Save</button> now, or <label>tick</label> it, if <math><mi>x</mi></math> is 1.</p><button>Share</button><p>An <b title='>open</b> quote.</p></article>", "Press Save now, or tick it, if x is 1.\nAn open quote."),
        ("<article><p>Text, here.</p><div class='comment-list'><p>First, I say, and a lot of other things, as readers do.</p></div><div class='user-comments'><p>More, and more.</p></div></article>", "Text, here."),
        ("<article><p>Text, here.</p><div hidden><p>Not shown.</p></div><section class='related-work'><p>Others have written on this at length, too, and are quoted here in whole sentences.</p></section></article>", "Text, here.\nOthers have written on this at length, too, and are quoted here in whole sentences."),
    ],
)
def test_controls_comments_and_sections(body, want):
    assert main_text.main_text(PAGE.format(body=body)) == want


def test_points_of_ancestors():
    """The one pass over the tree against sums over every pair of an element and a block below it."""
    rnd = random.Random(31)
    for _ in range(60):
        page, open_ = [], []
        for _ in range(60):
            if open_ and rnd.random() < 0.4:
                page.append(f"</{open_.pop()}>")
            elif rnd.random() < 0.5:
                open_.append(rnd.choice(["div", "section", "ul", "b", "a"]))
                page.append(f"<{open_[-1]}>")
            else:
                page.append(rnd.choice(["<p>", "<h2>", "<li>", ""]) + ", ".join("word" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 30))))
        nodes, texts = main_text._tree("".join(page))
        found = list(main_text._read(texts))
        main_text.gather(nodes, found)
        for x in nodes:
            score = size = held = 0
            for owner, text, density in found:
                line, up = [], owner
                while up is not None:
                    line.append(up)
                    up = up.parent
                if x not in line:
                    continue
                size += len(text)
                if owner.tag in main_text.HEADINGS:
                    continue
                held += main_text.points(text, density)
                first = 1 if owner.tag in main_text.PARAGRAPHS and owner.parent is not None else 0
                if line.index(x) >= first:
                    score += main_text.points(text, density) * main_text.FADE ** (line.index(x) - first)
            assert abs(x.score - score) < 1e-6 and x.size == size and abs(x.held - held) < 1e-6


def test_very_deep_and_long_pages():
    deep = "<div>x" * 100_000
    assert main_text.main_text(deep).count("\n") >= 0
    assert main_text.main_text("<p>" + "<b>" * 30_000 + "<div>x</div>" * 30_000)
    assert len(main_text.main_text("<article>" + "<p>word, " * 100_000)) > 500_000


@pytest.mark.parametrize("page", ["", "plain", "<", "<p", "<p>a<p>b</div></p></html>x", "<table><tr><td>a<td>b<tr><td>c</table>", "<" * 500, "<div>" * 3000 + "x", "<script>never closed <p>x", "a&#0;&#xD800;&bogus;&lt"])
def test_broken_pages(page):
    main_text.main_text(page)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE.format(body="<article><p>Hé!</p></article>"), "x"), (None, None, None, "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(str, main_text.extracted(pages).collect())) == sorted(["Row(page_id=1, url='u', text='Hé!', n_chars=3)", "Row(page_id=None, url=None, text='', n_chars=0)", "Row(page_id=1, url='u', text='', n_chars=0)"])
    assert main_text.extracted(pages.limit(0)).count() == 0
    odd = spark.sql("select 1L as page_id, 'u' as url, cast(unhex('3c703e61ff62') as string) as html")
    assert [r.text for r in main_text.extracted(odd).collect()] == ["a\ufffdb"]


def test_audit(spark):
    rnd = random.Random(9)
    rows = [(w, i * 500, 500, f"{rnd.getrandbits(64):x}") for w in range(3) for i in range(2000)]
    one = spark.createDataFrame(rows, "warc long, offset long, length long, digest string")
    bad = dict.fromkeys(rnd.sample(range(len(rows)), 12))
    two, want = [], set()
    for k, (w, o, n, d) in enumerate(rows):
        if k in bad:
            if k % 2:
                two.append((w, o, n, "rot"))
            want.add((w, o, "altered" if k % 2 else "missing"))
        else:
            two.append((w, o, n, d))
    two.append((2, 5_000_000, 10, "new"))
    want.add((2, 5_000_000, "extra"))
    assert {tuple(r) for r in warc.audit(one, spark.createDataFrame(two, one.schema)).collect()} == want
    assert warc.audit(one, one).count() == 0 == warc.audit(one.limit(0), one.limit(0)).count()
    assert warc.audit(one, one.where("warc <> 1")).count() == 2000


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>é" * i) for i in range(5)] + [(None, None, None)], "page_id long, url string, html string")
    records = [r.record.encode() for r in warc.archived(pages).orderBy("page_id").collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.parsed(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    for name in ("a.warc", "b.warc.gz"):
        mine = sorted((r for r in got if r.warc.endswith(name)), key=lambda r: r.offset)
        assert [bytes(r.record) for r in mine] == records
    placed = {r.offset: (r.length, r.digest) for r in warc.placed(warc.archived(pages.where("page_id is not null"))).collect()}
    plain = [r for r in got if r.warc.endswith("a.warc")]
    assert sum(placed.get(r.offset, (None,))[0] == r.length for r in plain) >= 4


def test_replica_of_pages(spark, tmp_path):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("x"), (F.col("id") * 7).cast("int")).alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.status for r in warc.op3_warc_fixity(spark, str(tmp_path)).collect()}
    assert got == {i: "missing" if i % 211 == 7 else "altered" if i % 97 == 13 else "ok" for i in range(500)}


def test_replica_of_repeated_and_empty_pages(spark, tmp_path):
    rows = [(5, "u", "one"), (5, "u", "two"), (5, "u", "two"), (13, "u", None), (13, "v", "x"), (7, "u", "gone"), (6, None, "y"), (None, "w", "z"), (1500, "u", "é" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.withColumn("status", F.lit("mine")).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op3_warc_fixity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len({(r.warc, r.offset) for r in got}) == len(rows)
    for r in got:
        assert r.page_id > 2000 or r.status == {13: "altered", 7: "missing"}.get(r.page_id, "ok")
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op3_warc_fixity(spark, f"{tmp_path}/none").count() == 0


def test_passages(spark):
    rnd = random.Random(10)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(rnd.randint(20, 50))) for i in range(30)] + [(40, "one two three"), (41, ""), (42, None)]
    docs = []
    for i in range(120):
        t = say(rnd.randint(0, 300))
        if i % 4 == 0:
            item = items[i % 30][1].split()
            if i % 8 == 0:
                item[-1] = "changed"
            t = f"{say(9)}\n{' '.join(item).upper() if i % 3 else ' '.join(item)}, {t}"
        docs.append((i, t))
    docs += [(200, "so one, two three."), (201, None), (None, items[0][1]), (202, items[1][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.contaminated(frame, bench).collect()}

    def split(t):
        return re.findall(r"[0-9a-z]+", (t or "").lower())

    want = set()
    for d, t in docs:
        w = split(t)
        for i, x in items:
            q = split(x)
            if not q:
                continue
            k = min(5, len(q))
            counts = Counter(tuple(q[j : j + k]) for j in range(len(q) - k + 1))
            best = max((decontaminate.weighted_jaccard(Counter(tuple(w[s + j : s + j + k]) for j in range(len(q) - k + 1)), counts) for s in range(len(w) - len(q) + 1)), default=0)
            if best >= 0.8:
                want.add((d, i, round(best, 9)))
    assert got == want and len(want) > 20
    clean = decontaminate.without_passages(frame, bench)
    assert clean.columns == frame.columns and clean.count() == len(docs) - len({d for d, *_ in want})
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0 == decontaminate.contaminated(frame, bench.limit(0)).count()


def test_passages_in_shorter_texts(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    long = [rnd.choice(words) for _ in range(59)]
    items = [(1, " ".join(long)), (2, " ".join(rnd.choice(words) for _ in range(40))), (3, "one two three")]
    docs = [(1, " ".join(long[:-1])), (2, " ".join(long[4:-2])), (3, " ".join(long[:46])), (4, " ".join(long[:40])), (5, "one two"), (6, "of four words only"), (7, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4]: round(r.similarity, 9) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == {(1, 1, 0, 58): round(54 / 55, 9), (2, 1, 0, 53): round(49 / 55, 9)}
    assert {r.doc_id for r in decontaminate.without_passages(frame, bench).collect()} == {3, 4, 5, 6, 7}


def test_similar_windows_lie_within_the_radius():
    """Random items and copies of a similarity from 0.8 on: their fingerprints differ in no more bits than RADIUS."""
    import numpy as np

    rnd, far, n = random.Random(14), 0, 0
    for _ in range(4000):
        item = [rnd.randrange(5000) for _ in range(rnd.randint(15, 60))]
        copy = list(item)
        for k in rnd.sample(range(len(copy)), rnd.randint(1, 2)):
            copy[k] = rnd.randrange(5000)
        prints, counts = [], []
        for words in (item, copy):
            raw = " ".join(f"w{x}" for x in words).encode()
            units, _ = decontaminate._units(raw, np.array([0, len(raw)]))
            hashes = decontaminate._shingles(units, 5)
            prints.append(int(decontaminate._windows(hashes, np.array([0]), len(hashes))[0]))
            counts.append(Counter(hashes.tolist()))
        if decontaminate.weighted_jaccard(*counts) >= 0.8:
            n += 1
            far += (prints[0] ^ prints[1]).bit_count() > decontaminate.RADIUS
    assert n > 500 and far == 0
