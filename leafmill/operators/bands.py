"""Bands and columns: the reading order of pages that are set in several columns.

A page's region is searched for a gutter, and so is each side of it; what spans a
gutter cuts the page into bands, which are read column by column.  Everything is
joins, aggregates and windows on (doc_id, page): near rows meet in slots of their
baselines, and no step holds a page as one value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby, pairwise
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import geometry as G
from leafmill.operators.folds import ARROW, dealt, whole_rows
from leafmill.operators.spans import PAGE, islands
from leafmill.shared import settled

LEADERS = r"(?:\.\s*){4}"


def _right() -> Column:
    return G.box().right


def _bottom() -> Column:
    return G.box().bottom


def _least_gap() -> Column:
    return F.greatest(F.lit(C.GUTTER_MIN), C.GUTTER_SHARE * F.col("body"))


def _sorted(df: DataFrame) -> DataFrame:
    """df for a join that sorts: tables of a row for each page pass for small at run time and would come to the driver, one after the other."""
    return df.hint("merge")


def _near(rows: DataFrame, by: list[str], reach: Column, on: Column) -> DataFrame:
    """Pairs (a, b) of rows whose baselines are at most ``reach`` apart and for which ``on`` holds; reach is one value for each key."""
    slot = F.floor(F.col("baseline") / reach)
    a = rows.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1))).alias("a")
    b = _sorted(rows.withColumn("_slot", slot)).alias("b")
    key = F.col("a._slot") == F.col("b._slot")
    for c in by:
        key &= F.col(f"a.{c}") == F.col(f"b.{c}")
    return a.join(b, key & on)


def gutters(nodes: DataFrame, regions: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """by, left_end, right_start, score: the best supported gutter of each region; regions without one are left out.

    nodes: by, ord, kind (line, rule, table, ...), x, y, width, height, baseline,
    size; ord is unique.  regions: by, rx, ry, rw, rh, body.

    Candidates lie between narrow lines (under 62 % of the region) that stand
    beside each other.  One falls if a short rule bridges it, a side has under
    two lines or no prose (two lines under each other with one left edge), the
    sides share less than 40 % of the lower one's height, or too many lines cross
    it.  4 * the smaller side + both sides - 8 * crossing lines counts; of equals
    the narrower gap, then the one whose lines come first.  Regions with a table
    over 80 % wide and 50 % high, under four narrow lines, or with more than 40 %
    as many wide ones have none.
    """
    known = nodes.join(_sorted(regions), by)
    lines = known.where("kind = 'line'").withColumn("narrow", F.col("width") < 0.62 * F.col("rw"))
    fit = lines.groupBy(*by).agg(F.count_if("narrow").alias("n"), F.count_if(~F.col("narrow")).alias("wide")).where("n >= 4 and wide <= 0.4 * n")
    barred = known.where((F.col("kind") == "table") & (F.col("width") > 0.8 * F.col("rw")) & (F.col("height") > 0.5 * F.col("rh")))
    searched = fit.join(_sorted(barred), by, "left_anti").select(*by)
    narrow = lines.where("narrow").join(_sorted(searched), by, "left_semi").withColumns({"i": F.row_number().over(W.partitionBy(*by).orderBy("y", "x", "ord")), "right": _right(), "bottom": _bottom()})
    narrow = settled(narrow)  # four joins read it

    before = F.col("a.i") < F.col("b.i")
    reach = 1.5 * F.col("body")
    level = before & (F.col("b.y") - F.col("a.bottom") <= 1.5 * F.col("a.body")) & (F.abs(F.col("a.baseline") - F.col("b.baseline")) <= 1.5 * F.col("a.body"))
    first = F.col("a.x") < F.col("b.x")
    pairs = _near(narrow, by, reach, level).select(
        *[F.col(f"a.{c}").alias(c) for c in by], F.col("a.i").alias("i"), F.col("b.i").alias("j"), *[F.col(f"a.{c}").alias(c) for c in ("body", "rx", "rw")],
        F.when(first, F.col("a.right")).otherwise(F.col("b.right")).alias("from"), F.when(first, F.col("b.x")).otherwise(F.col("a.x")).alias("to"),
    )
    inside = (F.col("to") - F.col("from") >= _least_gap()) & (F.col("from") > F.col("rx") + 0.2 * F.col("rw")) & (F.col("to") < F.col("rx") + 0.8 * F.col("rw"))
    # Of pairs with one rounded gap the last one names it, the first one its rank.
    gaps = pairs.where(inside).groupBy(*by, G.rounded(F.col("from")).alias("a"), G.rounded(F.col("to")).alias("z")).agg(F.max(F.struct("i", "j", "from", "to")).alias("last"), F.min(F.struct("i", "j")).alias("rank"))
    gaps = gaps.select(*by, "a", "z", "rank", "last.from", "last.to")

    # Prose: a pair lies left of a gap if its further right end does, so one number a side and region says it.
    drop, wide = F.col("b.baseline") - F.col("a.baseline"), lambda c: F.col(f"{c}.width") > 0.32 * F.col("a.rw")
    under = (
        before & (drop > 0.6 * F.col("a.body")) & (drop < F.col("a.body") * F.when(wide("a") & wide("b"), 5.0).otherwise(1.8)) & (F.abs(F.col("b.x") - F.col("a.x")) < F.col("a.body"))
        & (F.col("a.width") > 0.2 * F.col("a.rw")) & (F.col("b.width") > 0.2 * F.col("a.rw"))
    )
    prose = _near(narrow, by, 5 * F.col("body"), under).groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.min(F.greatest("a.right", "b.right")).alias("prose_right"), F.max(F.least("a.x", "b.x")).alias("prose_x"))

    there = known.where("kind in ('line', 'rule')").withColumn("narrow", (F.col("kind") == "line") & (F.col("width") < 0.62 * F.col("rw")))
    at = _sorted(gaps).join(there.select(*by, "kind", "narrow", "x", "y", _right().alias("right"), _bottom().alias("bottom"), "width", "rw"), by)
    left, right = F.col("narrow") & (F.col("right") <= F.col("from") + 1), F.col("narrow") & (F.col("x") >= F.col("to") - 1)
    bridge = (F.col("kind") == "rule") & (F.col("width") < 0.65 * F.col("rw")) & (F.col("x") <= F.col("from") + 2) & (F.col("right") >= F.col("to") - 2)
    key = [*by, "a", "z"]
    sides = at.groupBy(*key, "from", "to", "rank").agg(
        F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), F.bool_or(bridge).alias("bridged"), F.max(F.when(left, F.col("right"))).alias("left_end"), F.min(F.when(right, F.col("x"))).alias("right_start"),
        *[f(F.when(s, F.col(c))).alias(n + c) for n, s in (("l", left), ("r", right)) for c, f in (("y", F.min), ("bottom", F.max))],
    ).where("nl >= 2 and nr >= 2 and not bridged")
    sides = sides.join(_sorted(prose), by).where("prose_right <= from + 1 and prose_x >= to - 1").withColumns({"top": F.greatest("ly", "ry"), "end": F.least("lbottom", "rbottom")})
    sides = sides.where(F.col("end") - F.col("top") > 0.4 * F.least(F.col("lbottom") - F.col("ly"), F.col("rbottom") - F.col("ry")))
    s, n = sides.alias("s"), lines.select(*by, "x", "y", _right().alias("right"), _bottom().alias("bottom")).alias("n")
    across = (F.col("n.y") >= F.col("s.top")) & (F.col("n.bottom") <= F.col("s.end")) & (F.col("n.x") < F.col("s.to") - 1) & (F.col("n.right") > F.col("s.from") + 1)
    same = F.lit(True)
    for c in by:
        same &= F.col(f"s.{c}") == F.col(f"n.{c}")
    crossed = _sorted(s).join(n, same & across).groupBy(*[F.col(f"s.{c}").alias(c) for c in key]).agg(F.count("*").alias("crossing"))
    scored = sides.join(_sorted(crossed), key, "left").withColumn("crossing", F.coalesce("crossing", F.lit(0))).where(F.col("crossing") <= F.greatest(F.lit(2.0), 0.15 * (F.col("nl") + F.col("nr"))))
    score = 4 * F.least("nl", "nr") + F.col("nl") + F.col("nr") - 8 * F.col("crossing")
    best = scored.groupBy(*by).agg(F.max(F.struct(score.alias("score"), (F.col("from") - F.col("to")).alias("w"), (-F.col("rank.i")).alias("i"), (-F.col("rank.j")).alias("j"), "left_end", "right_start")).alias("b"))
    return settled(best.select(*by, "b.left_end", "b.right_start", "b.score"))


def _boxes(spans: DataFrame, by: list[str]) -> DataFrame:
    """Pieces of lines as nodes: by, box, baseline and size (medians over the larger spans), text."""
    main = spans.withColumn("_main", F.col("size") >= C.MAIN_SIZE_SHARE * F.max("size").over(W.partitionBy(*by)))
    medians = [F.percentile(F.when(F.col("_main"), F.col(c)), F.lit(0.5)).alias(c) for c in ("baseline", "size")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda s: s["text"]), " ")
    return main.groupBy(*by).agg(*G.bounds(G.box()), *medians, text.alias("text"))


def _node(kind: str | Column, ord_: str) -> list[Column]:
    return [F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.col(ord_).cast("long").alias("ord")]


NODE = [*PAGE, "kind", "ord", "piece", "x", "y", "width", "height", "baseline", "size", "text"]


def _nodes(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """spans (with line and piece) and blocks as one table of nodes."""
    lines = _boxes(spans, [*PAGE, "line", "piece"]).select(*PAGE, *_node("line", "line"), F.col("piece").cast("long").alias("piece"), *NODE[5:])
    void = [F.lit(None).cast(t).alias(c) for c, t in (("baseline", "double"), ("size", "double"), ("text", "string"))]
    return lines.unionByName(blocks.select(*PAGE, *_node(F.col("kind"), "ord"), F.lit(0).cast("long").alias("piece"), "x", "y", "width", "height", *void))


def _numbered(nodes: DataFrame, by: list[str]) -> DataFrame:
    """For ``gutters``: ord unique among all pieces of a region."""
    return nodes.select(*by, (F.col("ord") * 1_000_000 + F.col("piece")).alias("ord"), "kind", "x", "y", "width", "height", "baseline", "size")


def _regions(regions: DataFrame) -> DataFrame:
    return regions.select(*PAGE, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("width").alias("rw"), F.col("height").alias("rh"), "body")


def page_gutters(spans: DataFrame, blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, page, gap (from the left, counted from 0), gaps, left_end, right_start: up to three gutters of a page.

    Lines are cut where spans stand ``body`` / 4 (3 pt at least) apart; after the
    best gutter each side is searched once more.
    """
    region = _regions(regions)
    over = W.partitionBy(*PAGE, "line").orderBy("ord")
    edge = F.max(_right()).over(over.rowsBetween(W.unboundedPreceding, -1))
    # The edge starts anew with each piece; before a wide gap nothing reaches beyond it, so the running maximum is the same.
    cut = spans.join(region.select(*PAGE, "body"), PAGE).withColumn("_new", F.coalesce((F.col("x") - edge >= _least_gap()).cast("int"), F.lit(0)))
    nodes = settled(_nodes(cut.withColumn("piece", F.sum("_new").over(over.rowsBetween(W.unboundedPreceding, 0))), blocks))
    first = gutters(_numbered(nodes, PAGE), region).drop("score")
    sides = nodes.join(first, PAGE)
    side = F.when(_right() <= F.col("left_end") + 1, 0).when(F.col("x") >= F.col("right_start") - 1, 2)
    part = [*PAGE, "side"]
    halves = region.join(first, PAGE).select(*PAGE, "ry", "rh", "body", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("rx").alias("rx"), (F.col("left_end") - F.col("rx")).alias("rw")),
        F.struct(F.lit(2).alias("side"), F.col("right_start").alias("rx"), (F.col("rx") + F.col("rw") - F.col("right_start")).alias("rw")),
    )).alias("h")).select(*PAGE, "h.*", "ry", "rh", "body")
    more = gutters(_numbered(sides.withColumn("side", side).where("side is not null"), part), halves, part)
    all_ = first.withColumn("side", F.lit(1)).unionByName(more.drop("score"))
    page = W.partitionBy(*PAGE)
    return all_.select(*PAGE, (F.row_number().over(page.orderBy("side")) - 1).alias("gap"), F.count("*").over(page).alias("gaps"), "left_end", "right_start")


def _two(spans: DataFrame, blocks: DataFrame, region: DataFrame, gaps: DataFrame) -> DataFrame:
    """Nodes of pages with one gutter: spanning, column, and the columns' edges."""
    one = gaps.where("gaps = 1").select(*PAGE, "left_end", "right_start")
    mine = spans.join(one, PAGE).join(region.select(*PAGE, "body"), PAGE)
    late = F.col("x") >= F.col("right_start") - 2
    line = W.partitionBy(*PAGE, "line")
    apart = F.max(F.when(~late, _right())).over(line) + _least_gap() <= F.min(F.when(late, F.col("x"))).over(line)
    cut = mine.withColumn("piece", F.when(F.coalesce(apart, F.lit(False)) & late, 1).otherwise(0)).drop("left_end", "right_start")
    nodes = settled(_nodes(cut, blocks.join(_sorted(one), PAGE, "left_semi")))
    again = gutters(_numbered(nodes, PAGE), region).select(*PAGE, F.col("left_end").alias("l2"), F.col("right_start").alias("r2"))
    edges = one.join(_sorted(again), PAGE, "left").select(*PAGE, F.coalesce("l2", "left_end").alias("left_end"), F.coalesce("r2", "right_start").alias("right_start"))
    known = nodes.join(_sorted(edges), PAGE).join(_sorted(region), PAGE)
    slack = F.greatest(F.lit(2.0), 0.3 * F.col("body"))
    across = (F.col("x") < F.col("right_start") - slack) & (_right() > F.col("left_end") + slack)
    known = known.withColumns({"across": across, "row": (F.col("kind") == "line") & (across | F.coalesce(F.col("text").rlike(LEADERS), F.lit(False)))})
    # Lines on the baseline of one that crosses go with it.
    rows = known.where("kind = 'line'").withColumn("most", F.max("size").over(W.partitionBy(*PAGE)))
    beside = F.col("a.row") & (F.abs(F.col("a.baseline") - F.col("b.baseline")) < 0.4 * F.greatest("a.size", "b.size"))
    drawn = _near(rows, PAGE, F.col("most"), beside).select(*[F.col(f"b.{c}").alias(c) for c in (*PAGE, "kind", "ord", "piece")]).distinct().withColumn("drawn", F.lit(True))
    known = known.join(_sorted(drawn), [*PAGE, "kind", "ord", "piece"], "left").withColumn("spanning", F.col("across") | F.coalesce("drawn", F.lit(False)))
    side = F.when(F.col("x") + F.col("width") / 2 < (F.col("left_end") + F.col("right_start")) / 2, 0).otherwise(1)
    far = F.col("rx") + F.col("rw")
    edges_ = F.array(F.struct(F.col("rx").alias("x"), F.col("left_end").alias("end")), F.struct(F.col("right_start").alias("x"), far.alias("end")))
    return settled(known.select(*NODE, "spanning", side.alias("side"), edges_.alias("edges"), F.lit(False).alias("many")))


def _many(spans: DataFrame, blocks: DataFrame, region: DataFrame, gaps: DataFrame) -> DataFrame:
    """The same for pages with several gutters."""
    many = gaps.where("gaps > 1")
    # Pictures may stand out into the gutter.
    p, g = blocks.where("kind = 'image'").alias("p"), many.alias("g")
    out = (F.col("p.doc_id") == F.col("g.doc_id")) & (F.col("p.page") == F.col("g.page")) & (F.col("p.x") < F.col("g.left_end")) & (F.col("p.x") + F.col("p.width") < F.col("g.right_start") - 3)
    widened = _sorted(g).join(p, out, "left").groupBy("g.doc_id", "g.page", "g.gap", "g.left_end", "g.right_start").agg(F.max(F.col("p.x") + F.col("p.width")).alias("reach"))
    listed = widened.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("gap", F.greatest("left_end", "reach").alias("a"), F.col("right_start").alias("z")))).alias("g"))
    listed = listed.join(_sorted(region), PAGE)
    starts = F.concat(F.array("rx"), F.transform("g", lambda v: v["z"]))
    ends = F.concat(F.transform("g", lambda v: v["a"]), F.array(F.col("rx") + F.col("rw")))
    listed = listed.select(*PAGE, "g", F.arrays_zip(starts.alias("x"), ends.alias("end")).alias("edges"))
    mine = spans.join(_sorted(listed), PAGE)
    # A span is in the last column that starts at most 2 pt after it.
    part = F.greatest(F.lit(0), F.size(F.filter("edges", lambda e: F.col("x") >= e["x"] - 2)) - 1)
    mine = mine.withColumn("part", part)
    bound = F.when(F.col("part") < F.size("g"), F.get(F.col("g"), F.col("part"))["z"] - 3)
    past = F.coalesce(F.max(_right()).over(W.partitionBy(*PAGE, "line", "part")) > bound, F.lit(False))
    whole = F.bool_or("past").over(W.partitionBy(*PAGE, "line"))
    cut = mine.withColumn("past", past).withColumn("piece", F.when(whole, 0).otherwise(F.col("part"))).drop("g", "edges", "part", "past")
    known = _nodes(cut, blocks.join(_sorted(listed), PAGE, "left_semi")).join(_sorted(listed), PAGE)
    over = F.exists("g", lambda v: (F.col("x") < v["z"] - 2) & (_right() > v["a"] + 2))
    side = F.size(F.filter("g", lambda v: F.col("x") + F.col("width") / 2 >= (v["a"] + v["z"]) / 2))
    return known.select(*NODE, over.alias("spanning"), side.alias("side"), "edges", F.lit(True).alias("many"))


def bands(spans: DataFrame, blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """The reading order of every page, a row for each line, piece of a line or block.

    spans: doc_id, page, line, ord (order in its line), x, y, width, height,
    baseline, size, text.  blocks: doc_id, page, ord, kind (rule, image, table),
    x, y, width, height.  regions: doc_id, page, x, y, width, height, body (size).

    Returns doc_id, page, place (reading order), band, columns (of the band),
    column, column_x, column_width, top (where the band begins: below all that was
    set before it), kind, ord (line or block), piece, box and text.

    Nodes are taken from the top; those that span a gutter, and lines on the
    baseline of one that does or that have dotted leaders (with one gutter), are
    bands of one column.  With one gutter neighbouring bands of one column are
    one.  Lines are cut at gutters where no span crosses them.  A page without a
    gutter is one band.
    """
    spans, blocks, regions = settled(spans), settled(blocks), settled(regions)
    region, gaps = _regions(regions), settled(page_gutters(spans, blocks, regions))
    flat = _nodes(spans.join(gaps, PAGE, "left_anti").withColumn("piece", F.lit(0)), blocks.join(gaps, PAGE, "left_anti")).join(_sorted(region), PAGE)
    flat = flat.select(*NODE, F.lit(True).alias("spanning"), F.lit(0).alias("side"), F.array(F.struct(F.col("rx").alias("x"), (F.col("rx") + F.col("rw")).alias("end"))).alias("edges"), F.lit(False).alias("many"))
    nodes = flat.unionByName(_two(spans, blocks, region, gaps)).unionByName(_many(spans, blocks, region, gaps))

    # Bands are the islands of spanning and other nodes from the top; at one height spanning nodes come first.
    nodes = nodes.withColumn("_after", (~F.col("spanning")).cast("int"))
    down = W.partitionBy(*PAGE).orderBy("y", "_after", "x", "kind", "ord", "piece")
    so_far = down.rowsBetween(W.unboundedPreceding, 0)
    new = F.coalesce((F.lag("spanning").over(down) != F.col("spanning")).cast("int"), F.lit(0))
    nodes = settled(nodes.withColumn("_new", new).withColumn("_band", F.sum("_new").over(so_far)).withColumn("_i", F.row_number().over(down)))
    foot = F.when(F.col("kind") == "line", F.col("y") + F.greatest(F.col("height"), 1.25 * F.col("size"))).otherwise(_bottom())
    one = F.col("spanning") | (~F.col("many") & (F.col("sides") < 2))
    held = nodes.groupBy(*PAGE, "_band", "spanning", "many").agg(F.count_distinct("side").alias("sides"), F.max(foot).alias("lowest"), F.max_by(foot, "_i").alias("last"), F.first("edges").alias("edges"))
    held = held.join(_sorted(region.select(*PAGE, "ry")), PAGE).withColumn("columns", F.when(one, 1).otherwise(F.size("edges")))
    order = W.partitionBy(*PAGE).orderBy("_band")
    # After a spanning band the cursor is its last node's foot; after another one it is the lowest so far since then.
    start = F.coalesce(F.lag("last").over(order), F.col("ry"))
    held = held.withColumn("_start", F.when(~F.col("spanning"), start))
    top = F.when(~F.col("spanning"), F.col("_start")).otherwise(F.coalesce(F.greatest(F.lag("_start").over(order), F.lag("lowest").over(order)), F.col("ry")))
    held = held.withColumn("_top", top)
    joins = F.coalesce(~F.col("many") & (F.col("columns") == 1) & (F.lag("columns").over(order) == 1), F.lit(False))
    held = held.withColumn("band", F.sum((~joins).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    held = held.withColumn("top", F.first("_top").over(W.partitionBy(*PAGE, "band").orderBy("_band")))
    placed = nodes.drop("edges", "many", "spanning").join(held.select(*PAGE, "_band", "band", "columns", "top", "edges"), [*PAGE, "_band"])
    column = F.when(F.col("columns") == 1, 0).otherwise(F.col("side"))
    edge = F.when(F.col("columns") == 1, F.struct(F.col("edges")[0]["x"].alias("x"), F.element_at("edges", -1)["end"].alias("end"))).otherwise(F.get("edges", F.col("side")))
    placed = placed.withColumns({"column": column, "column_x": edge["x"], "column_width": edge["end"] - edge["x"]})
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("band", "column", "_band", "y", "x", "kind", "ord", "piece"))
    return placed.select(*PAGE, place.alias("place"), "band", "columns", "column", "column_x", "column_width", "top", "kind", "ord", "piece", "x", "y", "width", "height", "text")


# Page by page

#: Of a page: nodes and spans as tuples (kind, ord, piece, x, y, width, height, baseline, size, text), the latter with their line and order instead of the first three.
BLOCK_ROWS = 256


def _gutter(nodes: list[tuple], rx: float, rw: float, rh: float, body: float) -> tuple[float, float] | None:
    """(left_end, right_start) of the best gutter of a region, as ``gutters`` finds it."""
    lines = [n for n in nodes if n[0] == "line"]
    narrow = sorted((n for n in lines if n[5] < 0.62 * rw), key=lambda n: (n[4], n[3], n[1], n[2]))
    if len(narrow) < 4 or len(lines) - len(narrow) > 0.4 * len(narrow) or any(n[0] == "table" and n[5] > 0.8 * rw and n[6] > 0.5 * rh for n in nodes):
        return None
    x, y, w, h, base = np.array([n[3:8] for n in narrow], float).T
    right, bottom, n = x + w, y + h, len(narrow)
    least, gaps, prose_right, prose_x = max(C.GUTTER_MIN, C.GUTTER_SHARE * body), {}, math.inf, -math.inf
    wide, broad = w > 0.32 * rw, w > 0.2 * rw
    for k in range(0, n, BLOCK_ROWS):
        # Neighbours (a, b) of which a comes first.
        a, b = slice(k, min(n, k + BLOCK_ROWS)), slice(k, n)
        col = lambda v: v[a, None]  # noqa: E731, B023
        before = np.arange(n)[b] > col(np.arange(n))
        drop, apart = base[b] - col(base), x[b] - col(x)
        first = apart > 0
        start, end = np.where(first, col(right), right[b]), np.where(first, x[b], col(x))
        level = before & (y[b] - col(bottom) <= 1.5 * body) & (np.abs(drop) <= 1.5 * body) & (end - start >= least) & (start > rx + 0.2 * rw) & (end < rx + 0.8 * rw)
        # Of pairs with one rounded gap the last one names it, the first one its rank.
        for i, j in np.argwhere(level).tolist():
            at = (start[i, j], end[i, j])
            key = (math.floor(at[0] + 0.5), math.floor(at[1] + 0.5))
            gaps[key] = (gaps[key][0] if key in gaps else (k + i, k + j), *at)
        under = before & (drop > 0.6 * body) & (drop < body * np.where(col(wide) & wide[b], 5.0, 1.8)) & (np.abs(apart) < body) & col(broad) & broad[b]
        if under.any():
            prose_right = min(prose_right, np.maximum(col(right), right[b])[under].min())
            prose_x = max(prose_x, np.minimum(col(x), x[b])[under].max())
    rules = [(n[3], n[3] + n[5]) for n in nodes if n[0] == "rule" and n[5] < 0.65 * rw]
    best = None
    for rank, start, end in gaps.values():
        left, late = right <= start + 1, x >= end - 1
        nl, nr = int(left.sum()), int(late.sum())
        if nl < 2 or nr < 2 or prose_right > start + 1 or prose_x < end - 1 or any(p <= start + 2 and q >= end - 2 for p, q in rules):
            continue
        ly, lb, ry, rb = y[left].min(), bottom[left].max(), y[late].min(), bottom[late].max()
        top, low = max(ly, ry), min(lb, rb)
        if not low - top > 0.4 * min(lb - ly, rb - ry):
            continue
        crossing = sum(1 for m in lines if m[4] >= top and m[4] + m[6] <= low and m[3] < end - 1 and m[3] + m[5] > start + 1)
        if crossing <= max(2.0, 0.15 * (nl + nr)):
            found = (4 * min(nl, nr) + nl + nr - 8 * crossing, start - end, -rank[0], -rank[1], float(right[left].max()), float(x[late].min()))
            best = found if best is None else max(best, found)
    return best and best[4:]


def _pieces(spans: list[tuple], piece: list[int], blocks: list[tuple]) -> list[tuple]:
    """The nodes of a page: pieces of its lines, and its blocks."""
    held: dict[tuple, list] = {}
    for s, p in zip(spans, piece, strict=True):
        held.setdefault((s[0], p), []).append(s)
    out = []
    for (line, p), own in held.items():
        x, y = min([s[2] for s in own]), min([s[3] for s in own])
        sizes = [s[7] for s in own]
        size, most = min(sizes), max(sizes)
        main = own if size >= C.MAIN_SIZE_SHARE * most else [s for s in own if s[7] >= C.MAIN_SIZE_SHARE * most]
        bases = [s[6] for s in main]
        base, low = min(bases), max(bases)
        text = " ".join([t for *_, t in sorted([(s[2], s[1], s[8]) for s in own])])
        out.append(("line", line, p, x, y, max([s[2] + s[4] for s in own]) - x, max([s[3] + s[5] for s in own]) - y, base if base == low else median(bases), size if size == most else median([s[7] for s in main]), text))
    return out + blocks


def _page_gaps(spans: list[tuple], blocks: list[tuple], rx: float, rw: float, rh: float, body: float) -> list[tuple[float, float]]:
    """(left_end, right_start) of up to three gutters from the left, as ``page_gutters``."""
    least, piece, line, edge, at = max(C.GUTTER_MIN, C.GUTTER_SHARE * body), [], None, 0.0, 0
    for s in spans:
        if s[0] != line:
            line, edge, at = s[0], -math.inf, 0
        elif s[2] - edge >= least:
            at += 1
        edge = max(edge, s[2] + s[4])
        piece.append(at)
    nodes = _pieces(spans, piece, blocks)
    first = _gutter(nodes, rx, rw, rh, body)
    if first is None:
        return []
    left = [n for n in nodes if n[3] + n[5] <= first[0] + 1]
    right = [n for n in nodes if not n[3] + n[5] <= first[0] + 1 and n[3] >= first[1] - 1]
    return [g for g in (_gutter(left, rx, first[0] - rx, rh, body), first, _gutter(right, first[1], rx + rw - first[1], rh, body)) if g is not None]


def _two_of(spans: list[tuple], blocks: list[tuple], region: tuple, gap: tuple[float, float]) -> tuple[list[tuple], list[tuple]]:
    """(nodes with spanning and side, edges of the columns) of a page with one gutter."""
    rx, _, rw, rh, body = region
    least, ends = max(C.GUTTER_MIN, C.GUTTER_SHARE * body), {}
    late = [s[2] >= gap[1] - 2 for s in spans]
    for s, after in zip(spans, late, strict=True):
        e = ends.setdefault(s[0], [-math.inf, math.inf])
        if after:
            e[1] = min(e[1], s[2])
        else:
            e[0] = max(e[0], s[2] + s[4])
    apart = {k: a > -math.inf and z < math.inf and a + least <= z for k, (a, z) in ends.items()}
    nodes = _pieces(spans, [1 if after and apart[s[0]] else 0 for s, after in zip(spans, late, strict=True)], blocks)
    a, z = _gutter(nodes, rx, rw, rh, body) or gap
    slack = max(2.0, 0.3 * body)
    across = [n[3] < z - slack and n[3] + n[5] > a + slack for n in nodes]
    # Lines on the baseline of one that crosses or has dotted leaders go with it.
    rows = [(n[7], n[8]) for n, over in zip(nodes, across, strict=True) if n[0] == "line" and (over or re.search(LEADERS, n[9], re.ASCII))]
    drawn = [n[0] == "line" and any(abs(b - n[7]) < 0.4 * max(s, n[8]) for b, s in rows) for n in nodes]
    return [(*n, over or d, 0 if n[3] + n[5] / 2 < (a + z) / 2 else 1) for n, over, d in zip(nodes, across, drawn, strict=True)], [(rx, a), (z, rx + rw)]


def _many_of(spans: list[tuple], blocks: list[tuple], region: tuple, gaps: list[tuple[float, float]]) -> tuple[list[tuple], list[tuple]]:
    """The same for pages with several gutters."""
    rx, _, rw, _, _ = region
    # Pictures may stand out into the gutter.
    images = [(b[3], b[3] + b[5]) for b in blocks if b[0] == "image"]
    g = [(max([a, *[q for p, q in images if p < a and q < z - 3]]), z) for a, z in gaps]
    edges = list(zip([rx, *[z for _, z in g]], [*[a for a, _ in g], rx + rw], strict=True))
    # A span is in the last column that starts at most 2 pt after it.
    part = [max(0, sum(s[2] >= x - 2 for x, _ in edges) - 1) for s in spans]
    whole = {s[0] for s, p in zip(spans, part, strict=True) if p < len(g) and s[2] + s[4] > g[p][1] - 3}
    nodes = _pieces(spans, [0 if s[0] in whole else p for s, p in zip(spans, part, strict=True)], blocks)
    return [(*n, any(n[3] < z - 2 and n[3] + n[5] > a + 2 for a, z in g), sum(n[3] + n[5] / 2 >= (a + z) / 2 for a, z in g)) for n in nodes], edges


def page_bands(spans: list[tuple], blocks: list[tuple], region: tuple) -> list[tuple]:
    """(place, band, columns, column, column_x, column_width, top, kind, ord, piece, x, y, width, height, text) of a page; see ``bands``.

    spans: line, ord, x, y, width, height, baseline, size, text, in order.  blocks: nodes.  region: x, y, width, height, body.
    """
    rx, ry, rw, rh, body = region
    gaps = _page_gaps(spans, blocks, rx, rw, rh, body)
    many = len(gaps) > 1
    if not gaps:
        nodes, edges = [(*n, True, 0) for n in _pieces(spans, [0] * len(spans), blocks)], [(rx, rx + rw)]
    else:
        nodes, edges = _many_of(spans, blocks, region, gaps) if many else _two_of(spans, blocks, region, gaps[0])
    # Bands are the islands of spanning and other nodes from the top; at one height spanning nodes come first.
    nodes.sort(key=lambda n: (n[4], not n[10], n[3], n[0], n[1], n[2]))
    out, band, before, shown = [], -1, None, 0.0  # before: columns, start, last and lowest foot of the band before
    for number, (spanning, group) in enumerate(groupby(nodes, key=lambda n: n[10])):
        own = list(group)
        feet = [n[4] + (max(n[6], 1.25 * n[8]) if n[0] == "line" else n[6]) for n in own]
        columns = 1 if spanning or (not many and len({n[11] for n in own}) < 2) else len(edges)
        # After a spanning band the cursor is its last node's foot; after another one it is the lowest so far since then.
        start = None if spanning else before[2] if before else ry
        top = start if not spanning else max(v for v in before[1::2] if v is not None) if before else ry
        if many or columns != 1 or before is None or before[0] != 1:
            band, shown = band + 1, top
        before = (columns, start, feet[-1], max(feet))
        for n in own:
            column = 0 if columns == 1 else n[11]
            x, end = (edges[0][0], edges[-1][1]) if columns == 1 else edges[column]
            out.append(((band, column, number, n[4], n[3], n[0], n[1], n[2]), (band, columns, column, x, end - x, shown, *n[:7], n[9])))
    return [(place, *v) for place, (_, v) in enumerate(sorted(out, key=lambda o: o[0]), 1)]


#: What ``bands`` returns of a page.
BAND = {"place": "int", "band": "bigint", "columns": "int", "column": "int", "column_x": "double", "column_width": "double", "top": "double", "kind": "string", "ord": "bigint", "piece": "bigint", **dict.fromkeys(("x", "y", "width", "height"), "double"), "text": "string"}


def banded(keys: pa.Table | pa.RecordBatch, pages: list[list[tuple]]) -> pa.RecordBatch:
    """Rows of ``page_bands`` under their page's keys, one row of keys for each page."""
    which = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    columns = zip(*[r for p in pages for r in p], strict=True) if len(which) else [()] * len(BAND)
    made = [pa.array(list(v), ARROW[t]) for v, t in zip(columns, BAND.values(), strict=True)]
    at = keys.take(pa.array(which, pa.int64()))
    return pa.RecordBatch.from_arrays([*[c if isinstance(c, pa.Array) else c.combine_chunks() for c in (at.column(k) for k in PAGE)], *made], [*PAGE, *BAND])


def read_in_bands(spans: DataFrame, blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """``bands``, with the same columns: what is on a page is dealt out once and passed through page by page, so a page has to fit a task."""
    types = dict(spans.dtypes)
    measured = ["x", "y", "width", "height", "baseline", "size"]

    def side(df: DataFrame, number: int, line: Column, ord_: Column, kind: Column, baseline: Column, size: Column, text: Column) -> DataFrame:
        page = [F.col(c).cast(types[c]).alias(c) for c in PAGE]
        box = [F.col(c).cast("double").alias(c) for c in measured[:4]]
        return df.select(*page, F.lit(number).alias("side"), line.cast("long").alias("line"), ord_.cast("long").alias("ord"), kind.cast("string").alias("kind"), *box, baseline.cast("double").alias("baseline"), size.cast("double").alias("size"), text.cast("string").alias("text"))

    none = F.lit(None)
    rows = side(regions, 0, none, none, none, none, F.col("body"), none).unionByName(side(blocks, 1, none, F.col("ord"), F.col("kind"), none, none, none))
    rows = rows.unionByName(side(spans, 2, F.col("line"), F.col("ord"), none, F.col("baseline"), F.col("size"), F.col("text"))).where("doc_id is not null and page is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts in whole_rows(batches, PAGE):
            sides = held.column("side").to_numpy()
            values = list(zip(*[held.column(c).to_pylist() for c in ("line", "ord", *measured, "text", "kind")], strict=True))
            first, pages = [], []
            for lo, hi in pairwise(np.append(starts, len(sides)).tolist()):
                a, b = (lo + int(k) for k in np.searchsorted(sides[lo:hi], (1, 2)))
                if a > lo:
                    region = values[lo][2:6] + (values[lo][7],)
                    pages.append(page_bands([v[:9] for v in values[b:hi]], [(v[9], v[1], 0, *v[2:6], None, None, None) for v in values[a:b]], region))
                    first.append(lo)
            yield banded(held.take(pa.array(first, pa.int64())), pages)

    schema = ", ".join([*[f"{c} {types[c]}" for c in PAGE], *[f"{c} {t}" for c, t in BAND.items()]])
    return dealt(rows, PAGE, ["side", "line", "ord"]).mapInArrow(run, schema)
