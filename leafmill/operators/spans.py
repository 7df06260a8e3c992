"""Spans of a page: predicates, aggregates, windows and joins.

spans: doc_id, page, ord, text, x, y, width, height, baseline, size and what an
operator names besides.  Everything is local to (doc_id, page), the key of every
shuffle; range conditions are residuals of an equality on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import geometry as G
from leafmill.operators.folds import folded

PAGE = ["doc_id", "page"]


def live(spans: DataFrame) -> DataFrame:
    """Spans with text, a size and a finite place, neither hidden nor decorative where those columns exist."""
    keep = (F.trim("text") != "") & (F.col("size") > 0)
    for c in ("x", "y"):
        keep &= ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    for flag in ("decorative", "hidden", "rasterized"):
        if flag in spans.columns:
            keep &= ~F.coalesce(F.col(flag), F.lit(False))
    return spans.where(keep)


def space_after(spans: DataFrame) -> DataFrame:
    """Marks a span whose direct follower is a narrow blank one on its baseline."""
    after = W.partitionBy(*PAGE).orderBy("ord")
    nxt = {c: F.lead(c).over(after) for c in ("text", "x", "width", "baseline")}
    mark = (
        (F.trim(nxt["text"]) == "") & (F.abs(nxt["baseline"] - F.col("baseline")) < C.AXIS) & (F.abs(nxt["x"] - F.col("x") - F.col("width")) < C.AXIS)
        & (nxt["width"] < F.greatest(F.lit(C.GAP_MIN), C.GAP_SHARE * F.col("size")))
    )
    return spans.withColumn("space_after", F.coalesce(mark, F.lit(False)))


def body_size(spans: DataFrame, by: list[str] = PAGE) -> DataFrame:
    return spans.groupBy(*by).agg(G.median(F.col("size")).alias("body_size"))


def decorative(spans: DataFrame) -> DataFrame:
    """Slanted oversize text on pages with enough regular text: angle in (20, 70), size over twice the body's.

    Only slanted spans meet their page's body size; the others stay where they are.
    """
    regular = G.medians(spans.where(F.abs("angle") < 1), PAGE, "size", "_body", F.char_length("text"))
    slanted = F.coalesce((F.abs("angle") > 20) & (F.abs("angle") < 70), F.lit(False))
    mark = (F.col("total") > 50) & (F.col("size") > 2 * F.coalesce("_body", F.lit(12.0)))
    out = spans.where(slanted).join(regular, PAGE, "left").withColumn("decorative", F.coalesce(mark, F.lit(False))).drop("_body", "total")
    return out.select(*spans.columns, "decorative").unionByName(spans.where(~slanted).withColumn("decorative", F.lit(False)))


def occluded(spans: DataFrame, fills: DataFrame) -> DataFrame:
    """Spans that an opaque fill painted later covers wholly."""
    a, b = spans.alias("s"), fills.where("opaque").alias("f")
    on = (F.col("s.doc_id") == F.col("f.doc_id")) & (F.col("s.page") == F.col("f.page")) & G.contains_box(G.box("f"), G.box("s"), 0.5) & (F.col("f.paint_order") > F.col("s.paint_order"))
    return a.join(b, on, "left_semi")


def line_bounds(spans: DataFrame, by: list[str]) -> DataFrame:
    return spans.groupBy(*by).agg(*G.bounds(G.box()))


def weighted_confidence(spans: DataFrame, by: list[str], confidence: str, length: str) -> DataFrame:
    return spans.groupBy(*by).agg((F.sum(F.col(confidence) * F.col(length)) / F.greatest(F.lit(1), F.sum(length))).alias("confidence"))


def uncertain(spans: DataFrame, by: list[str]) -> DataFrame:
    """Groups that OCR may have misread: no letters, mean under 84, over a tenth of letters under 60, or any word under 40."""
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    out = spans.groupBy(*by).agg(
        F.sum(letters).alias("letters"), F.sum(letters * F.col("confidence")).alias("weighted"), F.sum(F.when(F.col("confidence") < 60, letters).otherwise(0)).alias("low"), F.min("confidence").alias("least")
    )
    test = (F.col("letters") == 0) | (F.col("weighted") < 84 * F.col("letters")) | (F.col("low") * 10 > F.col("letters")) | (F.col("least") < 40)
    return out.select(*by, test.alias("uncertain"))


def recurring(lines: DataFrame, key: list[str], over: str, least: int = 2) -> DataFrame:
    """Lines whose key comes on ``least`` different pages or documents: counted, then joined back."""
    often = lines.groupBy(*key).agg(F.count_distinct(over).alias("n")).where(F.col("n") >= least)
    return lines.join(often.drop("n"), key, "left_semi")


def recurring_footer(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans in the lowest 8 % of their page that come on two pages at one rounded place with one text."""
    at = spans.join(pages.select(*PAGE, F.col("width").alias("pw"), F.col("height").alias("ph")), PAGE).where(F.col("y") >= C.FOOTER_FROM * F.col("ph"))
    at = at.withColumns({"kw": G.rounded(F.col("pw")), "kh": G.rounded(F.col("ph")), "kx": G.rounded(F.col("x") / 5), "ky": G.rounded(F.col("y") / 5), "kt": F.trim("text")})
    return recurring(at, ["doc_id", "kw", "kh", "kx", "ky", "kt"], "page").drop("pw", "ph", "kw", "kh", "kx", "ky", "kt")


def worst(lines: DataFrame, by: list[str], most: int = C.WORST_LINES) -> DataFrame:
    """The least sure lines of each group: under 88, six characters and more, least first."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy("confidence", "ord"))
    kept = lines.where((F.col("confidence") < C.WORST) & (F.char_length("text") >= C.WORST_CHARS))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most)


def stats(spans: DataFrame, by: list[str]) -> DataFrame:
    return spans.groupBy(*by).agg(F.count_distinct("page").alias("pages"), F.sum(F.char_length(F.regexp_replace("text", r"\s", ""))).alias("characters"), F.count("*").alias("spans"))


def script_histogram(spans: DataFrame, by: list[str]) -> DataFrame:
    """Latin and Han letters, and whether a page reads as English."""
    out = spans.groupBy(*by).agg(F.sum(F.regexp_count("text", F.lit("[A-Za-z]"))).alias("latin"), F.sum(F.regexp_count("text", F.lit(r"\p{IsHan}"))).alias("han"))
    return out.withColumn("english", (F.col("latin") >= 40) & (F.col("han") < F.greatest(F.lit(4), F.col("latin") / 8)))


def islands(rows: DataFrame, by: list[str], order: list[str], start: Column, end: Column, gap: Column) -> DataFrame:
    """Numbers stretches of rows: a new one where a row starts more than ``gap`` after the one before ends."""
    w = W.partitionBy(*by).orderBy(*order)
    new = (start - F.lag(end).over(w) > gap).cast("int")
    marked = rows.withColumn("_new", F.coalesce(new, F.lit(0)))
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merged_intervals(rows: DataFrame, by: list[str], start: str, end: str, gap: float | Column) -> DataFrame:
    """Maximal intervals: one that starts less than ``gap`` after all before have ended goes on."""
    w = W.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) - before >= gap).cast("int"), F.lit(0))
    marked = rows.select(*by, start, end, new.alias("_new"))
    marked = marked.withColumn("_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_id").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_id")


def covered(segments: DataFrame, by: list[str], start: str, end: str, lo: Column, hi: Column, tolerance: float = C.TOUCH) -> DataFrame:
    """Whether segments reach from lo to hi without a hole of more than ``tolerance``."""
    w = W.partitionBy(*by).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    rows = segments.select(*by, start, end, lo.alias("_lo"), hi.alias("_hi"), F.greatest(F.coalesce(F.max(end).over(w), lo), lo).alias("_reach"))
    hole = (F.col(start) > F.col("_reach") + tolerance) & (F.col("_reach") < F.col("_hi") - tolerance)
    return rows.groupBy(*by).agg((~F.bool_or(hole) & (F.max(end) >= F.max("_hi") - tolerance)).alias("covered"))


def clusters(values: Column, tolerance: float) -> Column:
    """Anchored clusters of a bounded array: a sorted value joins while it is within ``tolerance`` of the cluster's first. Array of arrays."""
    start = F.array().cast("array<array<double>>")

    def step(a: Column, v: Column) -> Column:
        last = F.element_at(a, -1)
        return F.when((F.size(a) > 0) & (v - F.element_at(last, 1) <= tolerance), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last, F.array(v))))).otherwise(F.concat(a, F.array(F.array(v))))

    return F.aggregate(F.array_sort(F.transform(values, lambda v: v.cast("double"))), start, step)


def anchored(rows: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """by, value, cluster: anchored clusters of groups of any size, numbered from 1."""

    class Anchor:
        def __init__(self):
            self.first, self.n = None, 0

        def __call__(self, v) -> tuple[int]:
            if self.first is None or v - self.first > tolerance:
                self.first, self.n = v, self.n + 1
            return (self.n,)

    return folded(rows, by, [value], value, Anchor, {"cluster": "int"})


def flow_space(blocks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """blocks (y, height) with before: max(0, y - cursor), where the cursor never goes back.

    The cursor after a block is max(cursor, y) + height; with running sums of
    heights that is the sum so far plus a running maximum of y less the sum
    before, so two windows say it.
    """
    w = W.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    known = blocks.withColumn("_sum", F.sum("height").over(so_far))
    known = known.withColumn("_high", F.greatest(F.lit(0.0), F.max(F.col("y") - (F.col("_sum") - F.col("height"))).over(so_far)))
    cursor = F.coalesce(F.lag(F.col("_sum") + F.col("_high")).over(w), F.lit(0.0))
    return known.withColumn("before", F.greatest(F.lit(0.0), F.col("y") - cursor)).drop("_sum", "_high")


def cells_of(points: DataFrame, cells: DataFrame, key: list[str], bucket: float = 100.0) -> DataFrame:
    """Points (px, py) with every cell (x, y, width, height, cell_ord) that holds them, borders included.

    Both meet in squares of a grid of ``bucket`` points, so a page full of cells is never paired with all its points.
    """

    def squares(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket)))

    at = cells.select("*", squares(F.col("x"), F.col("x") + F.col("width")).alias("_bx")).select("*", squares(F.col("y"), F.col("y") + F.col("height")).alias("_by"))
    here = points.withColumns({"_bx": F.floor(F.col("px") / bucket), "_by": F.floor(F.col("py") / bucket)})
    on = (F.col("px") >= F.col("x")) & (F.col("px") <= F.col("x") + F.col("width")) & (F.col("py") >= F.col("y")) & (F.col("py") <= F.col("y") + F.col("height"))
    return here.join(at, [*key, "_bx", "_by"]).where(on).drop("_bx", "_by")


def first_cell(points: DataFrame, cells: DataFrame, key: list[str], point_id: list[str], bucket: float = 100.0) -> DataFrame:
    """Each point's first cell (least cell_ord) that holds it; points: px, py, cells: x, y, width, height, cell_ord."""
    return cells_of(points, cells, key, bucket).groupBy(*key, *[c for c in point_id if c not in key]).agg(F.min("cell_ord").alias("cell_ord"))


def in_one_interval(rows: DataFrame, columns: DataFrame, key: list[str], row_id: list[str]) -> DataFrame:
    """Rows (x, right) inside exactly one column interval (lo, hi) widened by one point."""
    held = rows.join(columns, key).where((F.col("x") >= F.col("lo") - 1) & (F.col("right") <= F.col("hi") + 1))
    return held.groupBy(*key, *[c for c in row_id if c not in key]).agg(F.count("*").alias("n"), F.min("column").alias("column")).where("n = 1").drop("n")


def underlined(spans: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans that a rule underlines, and the rules that underline none.

    A rule may run under several spans: each lies within it by 2 pt, and the
    rule lies from 1 pt above its baseline to a quarter of its size below.

    A task looks its spans up among its pages' rules, so that spans, which are
    many, are dealt out once and not sorted.
    """
    s, r = spans.alias("s"), rules.alias("r").hint("shuffle_hash")
    at = G.rule_box(F.col("r.x1"), F.col("r.y1"), F.col("r.x2"), F.col("r.y2"))
    below = (F.col("r.y1") + F.col("r.y2")) / 2 - F.col("s.baseline")
    under = (
        (F.col("s.doc_id") == F.col("r.doc_id")) & (F.col("s.page") == F.col("r.page")) & G.horizontal(F.col("r.y1"), F.col("r.y2"))
        & (below > -1) & (below < 0.25 * F.col("s.size")) & (F.col("s.x") >= at.x - 2) & (F.col("s.x") + F.col("s.width") <= at.right + 2)
    )
    line = [*PAGE, "x1", "y1", "x2", "y2"]
    taken = s.join(r, under).select(*[F.col(f"r.{c}").alias(c) for c in line]).distinct()
    return s.join(r, under, "left_semi"), rules.join(taken, line, "left_anti")


def nearest(left: DataFrame, right: DataFrame, key: list[str], left_id: str, at: str, other: str, most: float, value: str) -> DataFrame:
    """The right row nearest to each left row within one key: least |at - other| up to ``most``, then least ord.

    Both are merged in order and each left row looks to the last right one
    before and the first one after it, so no pairs are made.
    """
    first = right.groupBy(*key, other).agg(F.min(F.struct("ord", value)).alias("_r"))
    there = first.select(*key, F.col(other).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(other).alias("t"), F.col("_r.ord").alias("ord"), F.col(f"_r.{value}").alias("value")).alias("_r"), F.lit(None).cast(dict(left.dtypes)[left_id]).alias(left_id))
    here = left.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(there.schema["_r"].dataType).alias("_r"), left_id)
    w = W.partitionBy(*key).orderBy("_t", "_side", left_id)
    both = there.unionByName(here).withColumns({"_b": F.last("_r", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_a": F.first("_r", True).over(w.rowsBetween(0, W.unboundedFollowing))})

    def candidate(c: str) -> Column:
        d = F.abs(F.col("_t") - F.col(f"{c}.t"))
        return F.when(F.col(c).isNotNull() & (d <= most), F.struct(d.alias("d"), F.col(f"{c}.ord").alias("ord"), F.col(f"{c}.value").alias("value")))

    best = both.where("_side = 1").withColumn("_c", F.least(candidate("_b"), candidate("_a"))).where("_c is not null")
    return best.select(*key, left_id, F.col("_c.d").alias("distance"), F.col("_c.value").alias(value))


def unique_match(pairs: DataFrame, left: list[str]) -> DataFrame:
    """Pairs of left rows with exactly one candidate."""
    return pairs.withColumn("_n", F.count("*").over(W.partitionBy(*left))).where("_n = 1").drop("_n")


def holding_all(sets: DataFrame, wanted: DataFrame, key: str, item: str) -> DataFrame:
    """Relational division: keys of ``sets`` that hold every wanted item."""
    n = wanted.agg(F.count_distinct(item).alias("n"))
    held = sets.join(wanted.select(item).distinct(), item, "left_semi").groupBy(key).agg(F.count_distinct(item).alias("held"))
    return held.join(F.broadcast(n), F.col("held") == F.col("n")).select(key)


def unclaimed(spans: DataFrame, *claims: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Spans that no earlier step took."""
    for c in claims:
        spans = spans.join(c, key or [*PAGE, "ord"], "left_anti")
    return spans


def best_candidate(rows: DataFrame, by: list[str], size: str, order: str, most: int) -> DataFrame:
    """The smallest result in range; of equals the one made first."""
    ok = rows.where((F.col(size) > 0) & (F.col(size) <= most))
    return ok.groupBy(*by).agg(F.min(F.struct(size, order)).alias("b")).select(*by, F.col(f"b.{size}").alias(size), F.col(f"b.{order}").alias(order))


def nearest_paper(pages: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """The paper whose sides differ least, relatively, within max(3 pt, 1 %); else 'source'."""
    low, high = F.least(width, height), F.greatest(width, height)
    best = None
    for name, w, h in C.PAPERS:
        fits = (F.abs(low - w) <= max(C.PAPER_MIN, C.PAPER_SHARE * w)) & (F.abs(high - h) <= max(C.PAPER_MIN, C.PAPER_SHARE * h))
        cost = F.when(fits, F.struct(F.greatest(F.abs(low - w) / w, F.abs(high - h) / h).alias("cost"), F.lit(name).alias("paper")))
        best = cost if best is None else F.least(best, cost)
    return pages.withColumn("paper", F.coalesce(best["paper"], F.lit("source")))


def skew_scores(points: DataFrame, by: list[str], slopes: list[float] | None = None) -> DataFrame:
    """by, i, slope, score: the sum of squared row counts of points (px, py) sheared by each slope.

    slopes: by default the tangents of 41 angles, a quarter of a degree apart around zero.
    """
    slopes = slopes if slopes is not None else [math.tan(math.radians(k / 4)) for k in range(-20, 21)]
    at = F.posexplode(F.array(*[F.lit(float(s)) for s in slopes])).alias("i", "slope")
    rows = points.select(*by, "px", "py", at).select(*by, "i", "slope", F.floor(F.col("py") - F.col("px") * F.col("slope")).alias("row"))
    return rows.groupBy(*by, "i", "slope", "row").agg(F.count("*").alias("n")).groupBy(*by, "i", "slope").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


def skew(points: DataFrame, by: list[str], slopes: list[float] | None = None, least: float = math.tan(math.radians(0.2)), gain: float = 1.12) -> DataFrame:
    """by, slope, score: the slope with most score, the first of equals; 0 if it is flatter than ``least`` or not ``gain`` times better than none."""
    scores = skew_scores(points, by, slopes)
    best = scores.groupBy(*by).agg(F.max(F.struct("score", (-F.col("i")).alias("first"), "slope")).alias("b"), F.max(F.when(F.col("slope") == 0, F.col("score"))).alias("base"))
    ok = (F.abs("b.slope") >= least) & (F.col("b.score") > gain * F.col("base"))
    return best.select(*by, F.when(ok, F.col("b.slope")).otherwise(0.0).alias("slope"), F.col("b.score").alias("score"))


def paragraph_joins(pages: DataFrame) -> DataFrame:
    """Numbers chains of page tails that go on in the next page's head.

    pages: doc_id, page, width, height, tail_width (share), tail_text, tail_size, head_size.
    """
    w = W.partitionBy("doc_id").orderBy("page")
    prev = {c: F.lag(c).over(w) for c in ("page", "width", "height", "tail_width", "tail_text", "tail_size")}
    goes_on = (
        (prev["page"] == F.col("page") - 1) & (prev["width"] == F.col("width")) & (prev["height"] == F.col("height")) & (prev["tail_width"] >= 0.82)
        & ~prev["tail_text"].rlike(r"[.!?。！？:：;；]['\"”’)]*\s*$") & (F.abs(prev["tail_size"] - F.col("head_size")) <= 1)
    )
    return pages.withColumn("joins", F.coalesce(goes_on, F.lit(False))).withColumn("chain", F.sum((~F.col("joins")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def numbering(items: DataFrame, by: list[str], order: str, fmt: str, number: str) -> DataFrame:
    """Numbers lists: an item goes on with the one before if format is equal and its number is the next."""
    w = W.partitionBy(*by).orderBy(order)
    new = ~F.coalesce((F.lag(fmt).over(w) == F.col(fmt)) & (F.lag(number).over(w) + 1 == F.col(number)), F.lit(False))
    return items.withColumn("_new", new.cast("int")).withColumn("list_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def low_confidence(spans: DataFrame, by: list[str], least: int = 75) -> DataFrame:
    """by, low: spans read with less than that confidence; a missing one counts as none."""
    return spans.groupBy(*by).agg(F.count_if(F.coalesce("confidence", F.lit(0)) < least).alias("low"))


def review_pages(issues: DataFrame, by: list[str]) -> DataFrame:
    """by, pages: different pages with an issue to review."""
    return issues.where(F.col("page").isNotNull()).groupBy(*by).agg(F.count_distinct("page").alias("pages"))
