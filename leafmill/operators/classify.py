"""What stands on a page: footers, drawn rules, overlays, and the order in which steps claim spans.

Each step sees only what earlier ones left: ruled tables, open tables, the
footer, underlines and rules, figures and overlays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import geometry as G
from leafmill.functions.text import SPACE, trimmed
from leafmill.operators import lines as L
from leafmill.operators import spans as S
from leafmill.operators import tables as B
from leafmill.operators.folds import folded, whole_rows
from leafmill.operators.fractions import with_fractions
from leafmill.operators.spans import PAGE
from leafmill.shared import reliable

# Fixed values.
MONTH = r"(?i)^(?:January|February|March|April|May|June|July|August|September|October|November|December)$"
MONTHS = MONTH.strip("^$").removeprefix("(?i)^")
FOOTER = rf"(?i)^{SPACE}*(?:第{SPACE}*\d{{1,4}}{SPACE}*頁(?:[，,]?{SPACE}*共{SPACE}*\d{{1,4}}{SPACE}*頁)?|page{SPACE}+\d{{1,4}}(?:{SPACE}+of{SPACE}+\d{{1,4}})?|\d{{1,4}}{SPACE}*[/／]{SPACE}*\d{{1,4}}){SPACE}*$"
NUMBER = r"^\d{1,4}$"


def _same_page(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.page") == F.col(f"{b}.page"))


def date_years(spans: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Spans of four digits right under a month's name (of ``months``, if given): the year of a date, no page number."""
    m, y = (spans if months is None else months).where(trimmed(F.col("text")).rlike(MONTH)).alias("m"), spans.where(trimmed(F.col("text")).rlike(r"^\d{4}$")).alias("y")
    below = F.col("y.y") - (F.col("m.y") + F.col("m.height"))
    across = F.least(F.col("m.x") + F.col("m.width"), F.col("y.x") + F.col("y.width")) > F.greatest("m.x", "y.x")
    return y.join(m, _same_page("m", "y") & (below >= -0.5) & (below <= F.col("y.size")) & across, "left_semi")


def footers(spans: DataFrame, pages: DataFrame, recurring: DataFrame | None = None) -> DataFrame:
    """Spans of each page's footer: its first line in the lowest 8 % that reads as a page number or only recurs.

    spans: those that no table took.  pages: width, height, body_size, and
    source (pdf or ocr).  recurring: doc_id, page, ord of spans that come on
    several pages.  On scanned pages the line is a short number in the middle of
    the lowest 12 %.  Years of dates are no page numbers.
    """
    sheet = pages.select(*PAGE, F.col("width").alias("pw"), F.col("height").alias("ph"), "body_size", F.col("source").alias("origin"))
    at = spans.join(sheet, PAGE)
    # All spans tell the rows; what else they hold goes along only where a footer can stand.
    low = F.coalesce(F.col("y") > F.when(F.col("origin") == "ocr", 0.88).otherwise(C.FOOTER_FROM) * F.col("ph"), F.lit(False))
    narrow = at.select(*PAGE, "ord", "x", "baseline", "size", *(["line_id"] if "line_id" in spans.columns else []), F.when(low, F.struct("pw", "ph", "body_size", "origin", F.struct(*spans.columns).alias("span"))).alias("low"))
    held = L.rows_of(narrow).groupBy(*PAGE, "row").agg(F.bool_and(F.col("low").isNotNull()).alias("all"), F.collect_list("low").alias("spans")).where("all")
    rows = held.select("row", F.explode("spans").alias("s")).select("row", "s.pw", "s.ph", "s.body_size", "s.origin", "s.span.*")
    return footers_of(rows, spans.columns, date_years(spans), recurring)


#: What ``low_spans`` adds to spans.
LOW = {"pw": "double", "ph": "double", "body_size": "double", "origin": "string", "row": "bigint", "low": "boolean"}


def low_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``footers_of``: of spans (with pw, ph, body_size and origin of their page) whose pages follow each other, those in rows that lie low altogether, and where one of them may be a year the names of months."""
    for held, starts in whole_rows(batches, PAGE):
        page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, held.num_rows)))
        value = {c: held.column(c).to_numpy() for c in ("ord", "x", "baseline")}
        held, page, value = L._sorted(held, page, value, [value["ord"], value["x"], value["baseline"], page])
        row = L._Numbered(PAGE, "line_id" in held.schema.names)(held)
        reach = np.where(np.asarray(pc.fill_null(pc.equal(held.column("origin"), "ocr"), False)), 0.88, C.FOOTER_FROM)
        high = ~(held.column("y").to_numpy() > reach * held.column("ph").to_numpy())
        most = np.maximum.reduceat(row, starts) + 1
        group = (np.cumsum(most) - most)[page] + row
        low = np.bincount(group, high)[group] == 0
        # Months matter where a number may be a year.
        lows = np.flatnonzero(low)
        numbers = np.asarray(pc.match_substring_regex(held.column("text").take(pa.array(lows)), r"\d{4}"))
        dated = np.flatnonzero(np.isin(page, page[lows[numbers]]))
        keep = np.union1d(lows, dated[np.asarray(pc.match_substring_regex(held.column("text").take(pa.array(dated)), MONTHS, ignore_case=True))])
        found = held.take(pa.array(keep)).append_column("row", pa.array(row[keep])).append_column("low", pa.array(low[keep]))
        yield from found.combine_chunks().to_batches()


def footers_of(rows: DataFrame, columns: list[str], dated: DataFrame, recurring: DataFrame | None = None) -> DataFrame:
    """``footers`` among spans (columns) of rows that lie low altogether, with row and with pw, ph, body_size and origin of their page; dated: spans that are years."""
    key = [*PAGE, "row"]
    years = dated.select(*PAGE, "ord").withColumn("dated", F.lit(True))
    rows = rows.join(years, [*PAGE, "ord"], "left")
    if recurring is not None:
        rows = rows.join(recurring.select(*PAGE, "ord").distinct().withColumn("again", F.lit(True)), [*PAGE, "ord"], "left")
    else:
        rows = rows.withColumn("again", F.lit(None).cast("boolean"))
    small = trimmed(F.col("text")).rlike(NUMBER) & (F.col("width") < 0.08 * F.col("pw")) & (F.col("size") <= 1.4 * F.col("body_size"))
    held = rows.groupBy(*key, "pw", "ph", "origin").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda s: s["text"]), "").alias("line"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        F.bool_and(F.coalesce("again", F.lit(False)) | small).alias("all"), F.bool_or(F.coalesce("dated", F.lit(False))).alias("dated"), F.collect_list(F.struct(*columns)).alias("spans"),
    )
    centred = F.abs(F.col("x") + F.col("width") / 2 - F.col("pw") / 2) < 0.08 * F.col("pw")
    scanned = trimmed(F.col("line")).rlike(NUMBER) & (F.col("y") > 0.88 * F.col("ph")) & (F.col("width") < 0.08 * F.col("pw")) & centred
    native = (F.col("y") > C.FOOTER_FROM * F.col("ph")) & (F.col("line").rlike(FOOTER) | F.col("all"))
    found = held.where(~F.col("dated") & F.when(F.col("origin") == "ocr", scanned).otherwise(native))
    first = found.groupBy(*PAGE).agg(F.min_by("spans", F.struct("y", "x", "row")).alias("spans"))
    return first.select(F.explode("spans").alias("s")).select("s.*")


def drawn_rules(rules: DataFrame, pages: DataFrame, tables: DataFrame, underlining: DataFrame) -> DataFrame:
    """Horizontal rules that stay as lines of their own: doc_id, page, ord, x, y, width.

    Those in tables (by 4 pt), in a native page's footer and under text are left
    out, and so are ones under 24 pt and ones like an earlier one (2 pt apart,
    4 pt in width).  rules: ord, x1, y1, x2, y2.  underlining: doc_id, page, ord.
    """
    at = G.rule_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    flat = rules.where(G.horizontal(F.col("y1"), F.col("y2"))).select(*PAGE, "ord", at.x.alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), at.width.alias("width"), F.col("y1").alias("top"))
    flat = flat.join(pages.select(*PAGE, F.col("height").alias("ph"), "source"), PAGE).where(~((F.col("source") == "pdf") & (F.col("top") > C.FOOTER_FROM * F.col("ph"))))
    r, t = flat.alias("r"), tables.alias("t")
    middle = F.col("r.x") + F.col("r.width") / 2
    inside = (middle >= F.col("t.x") - 4) & (middle <= F.col("t.x") + F.col("t.width") + 4) & (F.col("r.y") >= F.col("t.y") - 4) & (F.col("r.y") <= F.col("t.y") + F.col("t.height") + 4)
    free = r.join(t, _same_page("r", "t") & inside, "left_anti").join(underlining.select(*PAGE, "ord").distinct(), [*PAGE, "ord"], "left_anti").where("width >= 24")

    class Kept:
        def __init__(self):
            self.lines: list[tuple] = []

        def __call__(self, v) -> tuple[bool]:
            x, y, width = (float(z) for z in v.split("|"))
            if any(abs(y - b) < 2 and abs(x - a) < 2 and abs(width - c) < 4 for a, b, c in self.lines):
                return (False,)
            self.lines.append((x, y, width))
            return (True,)

    told = folded(free.withColumn("_v", F.concat_ws("|", "x", "y", "width")), PAGE, ["ord"], "_v", Kept, {"kept": "boolean"})
    return free.join(told.where("kept").drop("kept"), [*PAGE, "ord"], "left_semi").select(*PAGE, "ord", "x", "y", "width")


def overlays(figures: DataFrame, pages: DataFrame, tables: DataFrame, text: DataFrame) -> DataFrame:
    """figures with overlay: those that float over the text instead of standing in its flow.

    On native pages these are narrow upright ones at the side edges, ones in
    tables, ones of over 15 % of the page beside any text, and small ones at the
    top beside a title.  A figure's own flag ``overlay`` counts everywhere.
    """
    at = figures.join(pages.select(*PAGE, F.col("width").alias("pw"), F.col("height").alias("ph"), "body_size", "source"), PAGE)
    a, s, t = at.alias("a"), text.alias("s"), tables.alias("t")
    level = _same_page("a", "s") & (F.col("s.y") < F.col("a.y") + F.col("a.height")) & (F.col("s.y") + F.col("s.height") > F.col("a.y"))
    beside = a.join(s, level).groupBy("a.doc_id", "a.page", "a.ord").agg(F.lit(True).alias("level"), F.bool_or(F.col("s.size") > 1.2 * F.col("a.body_size")).alias("titled"))
    held = a.join(t, _same_page("a", "t") & G.contains_center(G.box("t"), G.box("a"))).select("a.doc_id", "a.page", "a.ord").distinct().withColumn("held", F.lit(True))
    known = at.join(beside, [*PAGE, "ord"], "left").join(held, [*PAGE, "ord"], "left")
    edge = (F.col("width") < 0.1 * F.col("pw")) & (F.col("height") > 1.5 * F.col("width")) & ((F.col("x") < 0.035 * F.col("pw")) | (F.col("x") + F.col("width") > 0.965 * F.col("pw")))
    wide = (F.col("width") * F.col("height") > 0.15 * F.col("pw") * F.col("ph")) & F.col("level")
    top = (F.col("y") < 0.15 * F.col("ph")) & (F.col("width") < 0.2 * F.col("pw")) & F.col("titled")
    native = (F.col("source") == "pdf") & (edge | F.coalesce("held", F.lit(False)) | F.coalesce(wide, F.lit(False)) | F.coalesce(top, F.lit(False)))
    own = F.coalesce(F.col("overlay"), F.lit(False)) if "overlay" in figures.columns else F.lit(False)
    return known.withColumn("overlay", own | native).select(*figures.columns, *([] if "overlay" in figures.columns else ["overlay"]))


def outside(rules: DataFrame, tables: DataFrame, by: float = 4.0) -> DataFrame:
    """Rules whose middle lies in no table, by 4 pt."""
    r, t = rules.alias("r"), tables.alias("t")
    mx, my = (F.col("r.x1") + F.col("r.x2")) / 2, (F.col("r.y1") + F.col("r.y2")) / 2
    inside = (mx >= F.col("t.x") - by) & (mx <= F.col("t.x") + F.col("t.width") + by) & (my >= F.col("t.y") - by) & (my <= F.col("t.y") + F.col("t.height") + by)
    return r.join(t, _same_page("r", "t") & inside, "left_anti")


def classified(spans: DataFrame, rules: DataFrame, figures: DataFrame, pages: DataFrame, recurring: DataFrame | None = None) -> dict[str, DataFrame]:
    """The pages' parts, each step claiming what the ones before left: tables, cells, open_cells, footer, rules, figures, text.

    Fractions are made of what tables and footer leave, and their bars are no rules.
    Underlines and overlays look at all text but the footer's.
    pages: doc_id, page, width, height, source.
    """
    # Each step's claims are kept: the later ones look at them again and again.
    live = reliable(S.live(spans))
    pages = reliable(pages.join(S.body_size(live), PAGE, "left").withColumn("body_size", F.coalesce("body_size", F.lit(12.0))))
    tables, cells = (reliable(x) for x in B.ruled(live, rules))
    left = reliable(S.unclaimed(live, cells.select(*PAGE, "ord")))
    open_cells = reliable(B.open_numeric(left, rules))
    left = reliable(S.unclaimed(left, open_cells.select(*PAGE, "ord")))
    footer = reliable(footers(left, pages, recurring))
    left = reliable(S.unclaimed(left, footer.select(*PAGE, "ord")))
    boxes = reliable(tables.select(*PAGE, F.col("xs")[0].alias("x"), F.col("ys")[0].alias("y"), (F.element_at("xs", -1) - F.col("xs")[0]).alias("width"), (F.element_at("ys", -1) - F.col("ys")[0]).alias("height")))
    left, bars = with_fractions(left if "font" in left.columns else left.withColumn("font", F.lit(None).cast("string")), outside(rules, boxes))
    left, bars = reliable(left), reliable(bars)
    ruled = S.unclaimed(rules, bars)
    held = cells.select(*PAGE, "ord").union(open_cells.select(*PAGE, "ord")).distinct()
    body = reliable(left.unionByName(live.join(held, [*PAGE, "ord"], "left_semi"), allowMissingColumns=True))
    marked, free = (reliable(x) for x in S.underlined(body, ruled))
    under = S.unclaimed(ruled, free.select(*PAGE, "ord")).select(*PAGE, "ord")
    lines = drawn_rules(ruled, pages, boxes, under)
    text = left.join(marked.select(*PAGE, "ord").distinct().withColumn("underline", F.lit(True)), [*PAGE, "ord"], "left").withColumn("underline", F.coalesce("underline", F.lit(False)))
    return {"tables": tables, "cells": cells, "open_cells": open_cells, "footer": footer, "rules": lines, "figures": overlays(figures, pages, boxes, body), "text": text}


def wrapped_images(images: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Images with the paragraph that flows around them: doc_id, page, ord, paragraph.

    The first body paragraph in order with its top within max(6, 0.6 sizes) of
    the image's, 70 % of the lower height shared, and 6 pt between them at the
    side.  Images choose in order, and a paragraph takes one.
    images: ord, box.  paragraphs: paragraph, role, size, box.
    """
    i, p = images.alias("i"), paragraphs.where("role = 'body'").alias("p")
    a, b = G.box("i"), G.box("p")
    on = (
        _same_page("i", "p") & (F.abs(b.y - a.y) <= F.greatest(F.lit(6.0), 0.6 * F.col("p.size"))) & (F.least(b.bottom, a.bottom) - F.greatest(b.y, a.y) >= 0.7 * F.least(b.height, a.height))
        & ((b.right + 6 <= a.x) | (a.right + 6 <= b.x))
    )
    wishes = i.join(p, on).groupBy("i.doc_id", "i.page", "i.ord").agg(F.array_join(F.array_sort(F.collect_list("p.paragraph")), ",").alias("wishes"))

    class Claims:
        def __init__(self):
            self.taken: set[int] = set()

        def __call__(self, v) -> tuple[int | None]:
            free = next((k for k in map(int, v.split(",")) if k not in self.taken), None)
            self.taken.add(free)
            return (free,)

    return folded(wishes, PAGE, ["ord"], "wishes", Claims, {"paragraph": "bigint"}).where("paragraph is not null")


def tightened(blocks: DataFrame) -> DataFrame:
    """blocks with line_height cut to what is left before the next block.

    blocks: doc_id, page, ord, kind, y, lines, line_height, size.  Only
    paragraphs that have a lower block after them, and no less than their size.
    """
    after = W.partitionBy(*PAGE).orderBy("ord")
    room = (F.lead("y").over(after) - F.col("y")) / F.greatest(F.lit(1), F.coalesce("lines", F.lit(1)))
    fits = (F.col("kind") == "paragraph") & (room > 0) & (room >= F.col("size")) & (room < F.col("line_height"))
    return blocks.withColumn("line_height", F.when(fits, room).otherwise(F.col("line_height")))


def anchors(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Where texts stand: target, doc_id, page, x, y.

    items: doc_id, page, ord, text, x, y, width, height, ltr.  targets: target,
    text.  Items that hold the text themselves count; only where a document's
    page has none, runs of neighbouring pieces on one row that spell a plain
    ASCII text do.  Texts are compared in NFKC form without white space.
    """
    from leafmill.functions.text import nfkc

    known = items.withColumn("bare", nfkc("text"))
    wanted = targets.select("target", nfkc("text").alias("want"), F.col("text").rlike(r"^[\x20-\x7e]+$").alias("plain")).where("want <> ''")
    direct = known.join(F.broadcast(wanted), F.contains(F.col("bare"), F.col("want"))).select("target", *PAGE, "x", "y")
    parts = known.where("bare <> '' and coalesce(ltr, true)")
    w = W.partitionBy(*PAGE).orderBy("ord")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    near = (gap >= -0.5) & (gap <= F.greatest(F.lit(1.0), 1.5 * F.least("height", F.lag("height").over(w))))
    chained = parts.withColumns({"i": F.row_number().over(w), "new": (~F.coalesce(near, F.lit(False))).cast("int")})
    chained = chained.withColumn("chain", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    # Every start of a chain with the pieces after it, no further than the longest text can reach.
    longest = wanted.where("plain").agg(F.max(F.char_length("want")).alias("longest"))
    a, b = chained.alias("a"), chained.alias("b")
    spelled = a.join(F.broadcast(longest)).join(b, _same_page("a", "b") & (F.col("a.chain") == F.col("b.chain")) & (F.col("b.i") >= F.col("a.i")) & (F.col("b.i") < F.col("a.i") + F.col("longest")) & (F.abs(F.col("b.y") - F.col("a.y")) <= 0.5))
    spelled = spelled.groupBy("a.doc_id", "a.page", "a.i", "a.x", "a.y").agg(F.array_sort(F.collect_list(F.struct("b.i", "b.bare"))).alias("p"))
    # A piece on another row ends what a start can spell.
    whole = F.filter("p", lambda s, k: s["i"] == F.col("i") + k)
    ends = F.transform(F.sequence(F.lit(1), F.size(whole)), lambda n: F.array_join(F.transform(F.slice(whole, F.lit(1), n), lambda s: s["bare"]), ""))
    spelled = spelled.select(*PAGE, "i", "x", "y", F.explode(ends).alias("want")).join(F.broadcast(wanted.where("plain")), "want").select("target", *PAGE, "x", "y")
    return direct.unionByName(spelled.join(direct.select("target", *PAGE).distinct(), ["target", *PAGE], "left_anti"))
