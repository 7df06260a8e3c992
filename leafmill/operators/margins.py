"""Margins of a document's pages by evidence and presets, and coordinates on the target paper.

Pages give evidence, pages of one paper size are one group, and the preset that
costs least is taken unless the evidence speaks for margins of its own.  Pages
and blocks are dealt out once and leave a row for each page; one aggregate makes
of these a row for each size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import geometry as G
from leafmill.operators.folds import ARROW, dealt, whole_rows
from leafmill.operators.spans import PAGE, nearest_paper

# Presets in order of preference, weights of the edges.
EDGES = ("left", "right", "top", "bottom")
PRESETS = (("standard", (90.0, 90.0, 72.0, 72.0)), ("narrow", (36.0, 36.0, 36.0, 36.0)))
WEIGHTS = (2.0, 1.5, 0.5, 0.5)
#: A preset of this mean cost or less is taken.
ACCEPTED = 1.5


def flow_bottom(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages with flow_bottom: where the last line ends if all blocks are set one after the other.

    pages: doc_id, page, top.  blocks: band, column, kind, before, height, lines,
    line_height, size, thickness.  A paragraph takes its lines at the larger of
    line height and size, a rule its thickness and 0.05, a table 0.1 more than its
    height; of a band's columns the longest counts.  A last line (median line
    height of the paragraphs, at least 4 pt) is left at the end.
    """
    lines = F.coalesce("lines", F.lit(1)) * F.greatest("line_height", "size")
    extent = F.when(F.col("kind") == "paragraph", lines).when(F.col("kind") == "rule", 0.05 + F.col("thickness")).when(F.col("kind") == "table", F.col("height") + 0.1).otherwise(F.col("height"))
    columns = blocks.groupBy(*PAGE, "band", "column").agg(F.sum(F.col("before") + extent).alias("h"))
    bands = columns.groupBy(*PAGE, "band").agg(F.greatest(F.lit(0.0), F.max("h")).alias("h")).groupBy(*PAGE).agg(F.sum("h").alias("h"))
    leading = blocks.where("kind = 'paragraph'").groupBy(*PAGE).agg(F.percentile("line_height", F.lit(0.5)).alias("leading"))
    at = pages.join(bands, PAGE, "left").join(leading, PAGE, "left")
    end = F.col("top") + F.coalesce("h", F.lit(0.0)) + F.greatest(F.lit(4.0), F.coalesce("leading", F.lit(0.0)))
    return at.withColumn("flow_bottom", end).drop("h", "leading")


#: What a block counts as: in the evidence at all, as a table, at any width (it stands in columns).
SAYS, TABLE, HELD = 1, 2, 4
#: What a page's blocks say together, besides the page's own columns.
SAID = {"l": "double", "r": "double", "first": "double", "last": "double", "tables": "boolean", "left_safe": "double", "right_safe": "double", "table_bottom": "double"}


def _read_pages(keys: list[str], columns: list[str]) -> Callable:
    """Of sorted rows, pages before their blocks: keys, columns (of the page) and what its blocks say; null where none counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_rows(batches, keys):
            flags = rows.column("_flags").to_numpy()
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))  # rows to pages
            own = np.flatnonzero(flags < 0)
            page = dict(zip([f.name for f in rows.schema.field("_page").type], rows.column("_page").combine_chunks().flatten(), strict=True))
            value = lambda c: (rows.column(c).fill_null(np.nan).to_numpy(), rows.column(c).is_valid().to_numpy())
            # A page's own row comes first; blocks without one are left out.
            wide, high = (page[c].fill_null(np.nan).to_numpy(zero_copy_only=False)[starts][of] for c in ("width", "height"))
            block = flags >= 0
            says, table = block & (flags & SAYS > 0), block & (flags & TABLE > 0)

            def most(v: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return np.maximum.reduceat(np.where(ok, v, -np.inf), starts), np.logical_or.reduceat(ok, starts)

            def least(v: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return np.fmin.reduceat(np.where(ok, v, np.nan), starts), np.logical_or.reduceat(ok, starts)

            start, started = value("_start")
            n = np.add.reduceat(started.astype(np.int64), starts)
            ordered = start[started][np.lexsort((start[started], of[started]))]
            at = np.cumsum(n) - n + np.floor((n - 1) * 0.05).astype(np.int64)
            left = np.where(n > 0, ordered[np.minimum(at, len(ordered) - 1)] if len(ordered) else 0.0, 0.0), n > 0
            (x, has_x), (width, has_width), (y, has_y), (foot, has_foot), (bottom, has_bottom) = (value(c) for c in ("_x", "_width", "_y", "_foot", "_bottom"))
            right, has_right = x + width, has_x & has_width
            ends = rows.column("_end").to_numpy(zero_copy_only=False) & ((flags & HELD > 0) | (width >= 0.5 * wide))
            known = page["width"].is_valid().to_numpy(zero_copy_only=False)[starts][of], page["height"].is_valid().to_numpy(zero_copy_only=False)[starts][of]
            counts = np.logical_or.reduceat(says, starts)
            found = {
                "l": left, "r": most(right, block & has_right & ends), "first": least(y, block & has_y), "last": most(foot, block & has_foot), "tables": (np.logical_or.reduceat(table, starts), counts),
                "left_safe": least(x, table & has_x), "right_safe": least(wide - right, table & has_right & known[0]), "table_bottom": least(high - bottom, table & has_bottom & known[1]),
            }
            made = [pa.array(v[of[own]], ARROW[SAID[c]], mask=~(ok & counts)[of[own]]) for c, (v, ok) in found.items()]
            mine = pa.array(own)
            yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks().take(mine) for c in keys], *[page[c].take(mine) for c in columns], *made], [*keys, *columns, *SAID])

    return run


def margin_evidence(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages with left, right, top, bottom (null where a page says nothing), reliable (whether its right edge is known) and what its tables leave: left_safe, right_safe, table_bottom.

    pages: doc_id, page (their key), width, height, source, flow_bottom.  blocks:
    kind, role, align, box, lines, line_height, columns (of its band).

    left: of the starts of body paragraphs, tables and left-aligned headings the
    one at index floor(5 %).  right: what is left of the furthest end of tables
    and body paragraphs of half the page's width (of several lines, or justified)
    and of what stands in columns; short lines say nothing.  top, bottom: within
    18 % of the page; scans and pages with tables need room for all blocks set
    one after the other.

    Pages and blocks are dealt out together and read once, a page after the
    other: joining them and adding blocks up would sort them many times in a task.
    """
    types = dict(pages.dtypes)
    columns = [c for c in pages.columns if c not in PAGE]
    paragraph, table = F.coalesce(F.col("kind") == "paragraph", F.lit(False)), F.coalesce(F.col("kind") == "table", F.lit(False))
    heading = F.coalesce(F.col("role") == "heading", F.lit(False))
    body = paragraph & ~heading & ~F.coalesce(F.col("align").isin("center", "right"), F.lit(False))
    anchor = body | table
    starts = F.when(anchor | (paragraph & heading & (F.col("align") == "left")), F.col("x"))
    long = table | F.coalesce(F.col("height") > 1.5 * F.col("line_height"), F.lit(False)) | F.coalesce(F.col("align").isin("justify", "both"), F.lit(False))
    held = F.coalesce((paragraph | table) & (F.col("columns") > 1), F.lit(False))
    foot = F.when(paragraph, F.col("y") + 4 + F.greatest(F.col("height"), F.coalesce("lines", F.lit(1)) * F.col("line_height"))).otherwise(G.box().bottom)
    bit = lambda test, n: F.when(test, n).otherwise(0)
    numbers = {"_start": starts, "_x": F.col("x"), "_width": F.col("width"), "_y": F.col("y"), "_bottom": G.box().bottom, "_foot": foot}
    there = blocks.where(" and ".join(f"{c} is not null" for c in PAGE)).select(*PAGE, *[v.cast("double").alias(c) for c, v in numbers.items()], ((anchor & long) | held).alias("_end"), (bit(paragraph | table, SAYS) + bit(table, TABLE) + bit(held, HELD)).alias("_flags"))
    here = pages.select(*PAGE, F.struct(*[F.col(c).cast("double").alias(c) if c in ("width", "height") else F.col(c) for c in columns]).alias("_page"), F.lit(False).alias("_end"), F.lit(-1).alias("_flags"))
    rows = here.unionByName(there, allowMissingColumns=True)
    schema = ", ".join([f"`{c}` {types[c]}" for c in PAGE] + [f"`{c}` {'double' if c in ('width', 'height') else types[c]}" for c in columns] + [f"{c} {t}" for c, t in SAID.items()])
    known = dealt(rows, PAGE, ["_flags"]).mapInArrow(_read_pages(PAGE, columns), schema)
    last = F.when((F.col("source") == "ocr") | F.col("tables"), F.greatest("last", F.col("flow_bottom") + 4)).otherwise(F.col("last"))
    low = F.when(F.col("tables").isNotNull(), F.col("height") - last)  # an empty page says nothing
    zero = F.lit(0.0)
    at_least = lambda v: F.when(v.isNotNull(), F.greatest(zero, v))
    return known.select(
        *pages.columns, at_least(F.col("l")).alias("left"), at_least(F.col("width") - F.col("r")).alias("right"), F.when(F.col("first") <= 0.18 * F.col("height"), F.greatest(zero, F.col("first"))).alias("top"),
        F.when(low <= 0.18 * F.col("height"), F.greatest(zero, low)).alias("bottom"), F.col("r").isNotNull().alias("reliable"), "left_safe", "right_safe", "table_bottom",
    )


def target_papers(pages: DataFrame) -> DataFrame:
    """pages with paper, paper_width and paper_height: the paper they are printed on, turned as the page is; unknown sizes are their own."""
    known = nearest_paper(pages)
    low, high = F.least("width", "height"), F.greatest("width", "height")
    for name, w, h in C.PAPERS:
        low, high = (F.when(F.col("paper") == name, F.lit(v)).otherwise(x) for v, x in ((w, low), (h, high)))
    across = F.col("width") > F.col("height")
    return known.withColumns({"paper_width": F.when(across, high).otherwise(low), "paper_height": F.when(across, low).otherwise(high)})


def _loss(delta: Column) -> Column:
    """A preset that would cut over 20 pt into the text costs most."""
    return F.when(delta < -20, 3 + (-delta - 20) / 12).otherwise(F.least(F.abs(delta), F.lit(60.0)) / 20)


def chosen_margins(pages: DataFrame, blocks: DataFrame, by: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """by, paper, kw, kh (rounded size), pages, preset (standard, narrow, detected), left, right, top, bottom.

    pages and blocks as for ``margin_evidence``.  An edge is the median (left,
    right) or the value at index floor(20 %) (top, bottom) over the pages that
    know their right edge, or over all if none does.  Where a preset fits, tables
    hold its sides back to the whole point, and content top and bottom (by 3 pt).
    Otherwise the edges are as observed, to the half point, at most 35 % of the
    width and 20 % of the height; unknown ones are the nearest preset's.
    """
    size = [*by, "paper", "kw", "kh"]
    mine = pages.select(*dict.fromkeys([*by, *PAGE, "width", "height", "source", "flow_bottom"]))
    sized = target_papers(margin_evidence(mine, blocks)).withColumns({"kw": G.rounded(F.col("paper_width")).cast("long"), "kh": G.rounded(F.col("paper_height")).cast("long")})
    # Values are counted where they are, so that a document may have any number of pages.
    half = F.lit(0.5)
    sure = lambda c: F.when(F.col("reliable"), F.col(c))
    edge = {"left": F.coalesce(F.percentile(sure("left"), half), F.percentile("left", half)), "right": F.percentile("right", half)}  # a page that knows its right edge is a reliable one
    # The first value that a fifth of them reach is the one at index floor((n - 1) / 5).
    edge |= {c: F.expr(f"coalesce(percentile_disc(0.2) WITHIN GROUP (ORDER BY CASE WHEN reliable THEN {c} END), percentile_disc(0.2) WITHIN GROUP (ORDER BY {c}))") for c in ("top", "bottom")}
    seen = sized.groupBy(*size).agg(
        F.count("*").alias("pages"), F.bool_or("reliable").alias("reliable"), *[v.alias(c) for c, v in edge.items()], *[F.min(c).alias(f"{c}_least") for c in ("top", "bottom")],
        F.percentile("width", half).alias("mw"), F.percentile("height", half).alias("mh"), *[F.min(c).alias(c) for c in ("left_safe", "right_safe", "table_bottom")],
    )
    weight = [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in zip(EDGES, WEIGHTS, strict=True)]
    total = sum(weight, F.lit(0.0))
    tried = []
    for k, (name, margins) in enumerate(PRESETS):
        cost = sum((F.coalesce(_loss(F.col(c) - v), F.lit(0.0)) * w for c, v, w in zip(EDGES, margins, weight, strict=True)), F.lit(0.0))
        tried.append(F.struct(F.when(total > 0, cost / total).otherwise(0.0).alias("cost"), F.lit(k).alias("rank"), F.lit(name).alias("preset"), *[F.lit(v).alias(f"p_{c}") for c, v in zip(EDGES, margins, strict=True)]))
    best = seen.withColumn("_p", F.least(*tried)).select("*", "_p.*").drop("_p")

    fits = (F.col("cost") <= ACCEPTED) | ~F.col("reliable")
    prior = {c: F.col(f"p_{c}") for c in EDGES}
    near_table = F.coalesce(F.col("table_bottom") < prior["bottom"] + 3, F.lit(False))
    held = {c: F.coalesce(F.col(f"{c}_safe") < prior[c], F.lit(False)) for c in ("left", "right")}
    held |= {c: F.coalesce((F.col(f"{c}_least") < prior[c] - 3) | (near_table if c == "bottom" else F.lit(False)), F.lit(False)) & F.col(f"{c}_least").isNotNull() for c in ("top", "bottom")}
    room = {c: F.col(f"{c}_safe") if c in ("left", "right") else F.col(f"{c}_least") - 3 for c in EDGES}
    out, any_held = [], F.lit(False)
    for c in EDGES:
        most = 0.35 * F.col("mw") if c in ("left", "right") else 0.2 * F.col("mh")
        own = F.when(F.col(c).isNotNull(), G.rounded(2 * F.least(F.greatest(F.lit(0.0), F.col(c) - (3 if c == "bottom" else 0)), most)) / 2)
        any_held |= held[c]
        out.append(F.when(fits, F.when(held[c], F.greatest(F.lit(0.0), F.floor(room[c]).cast("double"))).otherwise(prior[c])).otherwise(F.coalesce(own, prior[c])).alias(c))
    preset = F.when(fits & ~any_held, F.col("preset")).otherwise("detected")
    return best.select(*size, "pages", preset.alias("preset"), *out)


def mapped(blocks: DataFrame, frames: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks with their box, before, indents and column widths on the target paper; text sizes stay.

    pages: doc_id, page, width, height, left, right (margins of the source) and
    paper_width, paper_height, to_left, to_right, to_top, to_bottom.  frames:
    doc_id, page, band, column, columns, width and gap (after it) of the source's
    columns; null for a band of one column.  blocks: band, column, ord, kind, box, before,
    indent, first_indent, columns_at, rows_at (arrays of a table, else null).

    Coordinates are scaled by the paper.  What the target's margins add at the
    outside is taken from the outer columns, so gutters stay where they are.
    Images shrink to their column and to the height less 24 pt, and never grow.
    """
    page = pages.withColumns({"sx": F.col("paper_width") / F.col("width"), "sy": F.col("paper_height") / F.col("height")}).select(
        *PAGE, "sx", "sy", *[F.col(c).alias(f"_{c}") for c in ("width", "left", "right", "paper_width", "paper_height", "to_left", "to_right", "to_top", "to_bottom")]
    )
    whole = F.col("_paper_width") - F.col("_to_left") - F.col("_to_right")
    last = F.col("column") == F.col("columns") - 1
    outer = F.when(F.col("column") == 0, F.col("_left") * F.col("sx") - F.col("_to_left")).otherwise(0.0) + F.when(last, F.col("_right") * F.col("sx") - F.col("_to_right")).otherwise(0.0)
    known = frames.withColumnRenamed("width", "fw").join(page, PAGE)
    known = known.withColumns({"avail": F.coalesce(F.col("fw") * F.col("sx") + outer, whole), "from_width": F.coalesce("fw", F.col("_width") - F.col("_left") - F.col("_right")), "gap": F.coalesce("gap", F.lit(0.0))})
    before = W.partitionBy(*PAGE, "band").orderBy("column").rowsBetween(W.unboundedPreceding, -1)
    known = known.withColumns({
        "from_left": F.col("_left") + F.coalesce(F.sum(F.col("from_width") + F.col("gap")).over(before), F.lit(0.0)),
        "at_left": F.col("_to_left") + F.coalesce(F.sum(F.col("avail") + F.col("gap") * F.col("sx")).over(before), F.lit(0.0)),
    }).drop("fw", "gap", "columns")
    at = blocks.join(known, [*PAGE, "band", "column"])
    sx, sy = F.col("sx"), F.col("sy")
    image = F.col("kind") == "image"
    tall = F.greatest(F.lit(1.0), F.col("_paper_height") - F.col("_to_top") - F.col("_to_bottom") - 24)
    shrink = F.when(image, F.least(F.lit(1.0), F.col("avail") / F.greatest(F.lit(1.0), F.col("width") * sx), tall / F.greatest(F.lit(1.0), F.col("height") * sy))).otherwise(1.0)
    first = F.row_number().over(W.partitionBy(*PAGE, "band", "column").orderBy("ord")) == 1
    gap = F.when((F.col("band") == 0) & first, F.greatest(F.lit(0.0), F.col("y") * sy - F.col("_to_top"))).otherwise(F.col("before") * sy)
    paragraph = F.col("kind") == "paragraph"
    now = {
        "x": F.col("x") * sx, "y": F.col("y") * sy, "width": F.col("width") * sx * shrink, "height": F.col("height") * sy * shrink, "before": gap,
        "indent": F.when(paragraph, (F.col("from_left") + F.col("indent")) * sx - F.col("at_left")), "first_indent": F.when(paragraph, F.col("first_indent") * sx),
        "right_indent": F.when(paragraph, F.col("at_left") + F.col("avail") - (F.col("from_left") + F.col("from_width")) * sx),
        "columns_at": F.transform("columns_at", lambda v: v * sx), "rows_at": F.transform("rows_at", lambda v: v * sy),
    }
    return at.select(*[c for c in blocks.columns if c not in now], *[v.alias(c) for c, v in now.items()], F.col("avail").alias("column_width"))
