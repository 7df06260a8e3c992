"""Ink of scanned pages that no text or rule explains: pictures, found on a coarse grid.

A raster is rows of runs of dark pixels, never one value.  Runs become stretches of
tiles with one count, these become runs of occupied tiles, and a pass over a page's
runs from the top links those of neighbouring rows that share a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators.folds import dealt
from leafmill.operators.regions import _met
from leafmill.operators.spans import PAGE, merged_intervals
from leafmill.shared import settled

#: Regions of a page that are looked at, from the top.
MOST = 24
BOX = ["x", "y", "width", "height"]


def runs_of_pixels(pixels: DataFrame) -> DataFrame:
    """doc_id, page, y, x0, x1 (after the last): runs of dark pixels; pixels: doc_id, page, y, x, r, g, b, dark if they sum up to under 675."""
    dark = pixels.where(F.col("r") + F.col("g") + F.col("b") < 675)
    w = W.partitionBy(*PAGE, "y").orderBy("x")
    held = dark.select(*PAGE, "y", "x", (F.col("x") - F.row_number().over(w)).alias("_run"))
    return held.groupBy(*PAGE, "y", "_run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_run")


def _grid(pages: DataFrame) -> DataFrame:
    step = F.greatest(F.lit(4), G.rounded(4 * F.col("scale"))).cast("int")
    known = pages.select(*PAGE, F.col("width").alias("pw"), F.col("height").alias("ph"), "scale", step.alias("step"))
    return known.withColumns({"columns": F.ceil(F.col("pw") / F.col("step")), "rows": F.ceil(F.col("ph") / F.col("step"))})


def _tile_runs(ink: DataFrame, pages: DataFrame, covers: DataFrame) -> DataFrame:
    """doc_id, page, ty, a, z (last one): the tiles of ``occupied`` as runs.

    A run of ink says by four steps how its dark pixels change from tile to tile,
    and a cover by two; running sums of steps give stretches of tiles with one
    count, so no tile is a row.  All of it is dealt out once, by page.
    """
    grid = settled(_grid(pages))
    box = G.box()
    drawn = ink.where("x1 > x0").select(*PAGE, F.lit(True).alias("ink"), *[F.col(c).cast("double").alias(n) for n, c in (("x0", "x0"), ("x1", "x1"), ("y0", "y"), ("y1", "y"))])
    hidden = covers.select(*PAGE, F.lit(False).alias("ink"), *[v.cast("double").alias(n) for n, v in (("x0", box.x), ("x1", box.right), ("y0", box.y), ("y1", box.bottom))])
    at = drawn.unionByName(hidden).join(grid, PAGE)
    step = F.col("step")
    tile = lambda c: F.col(c) * F.col("scale") / step
    low = lambda c: F.greatest(F.lit(0), F.floor(tile(c)))
    high = lambda c, most: F.least(F.col(most), F.ceil(tile(c))) - 1
    inked = F.col("ink")
    at = at.select(
        *PAGE, "step", "columns", "rows", "ink", "x0", "x1", F.when(inked, F.floor(F.col("x0") / step)).otherwise(low("x0")).alias("a"), F.when(inked, F.floor((F.col("x1") - 1) / step)).otherwise(high("x1", "columns")).alias("z"),
        F.when(inked, F.floor(F.col("y0") / step)).otherwise(low("y0")).alias("t"), F.when(inked, F.floor(F.col("y0") / step)).otherwise(high("y1", "rows")).alias("b"),
    ).where("a <= z and t <= b")
    banded = at.withColumn("ty", F.explode(F.sequence("t", "b"))).where("ty >= 1 and ty < rows - 1")
    change = lambda tx, n, c: F.struct(tx.alias("tx"), n.cast("long").alias("n"), F.lit(c).alias("c"))
    a, z, none = F.col("a"), F.col("z"), F.lit(0)
    head, tail = (a + 1) * step - F.col("x0"), F.col("x1") - z * step
    changes = F.when(inked, F.array(change(a, head, 0), change(a + 1, step - head, 0), change(z, tail - step, 0), change(z + 1, -tail, 0))).otherwise(F.array(change(a, none, 1), change(z + 1, none, -1)))
    kept = [*PAGE, "step", "columns", "ty"]
    steps = banded.select(*kept, F.explode(changes).alias("e")).groupBy(*kept, "e.tx").agg(F.sum("e.n").alias("n"), F.sum("e.c").alias("c"))
    along = W.partitionBy(*PAGE, "ty").orderBy("tx")
    sums = steps.select(*kept, F.col("tx").alias("a"), F.lead("tx").over(along).alias("next"), *[F.sum(c).over(along.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in ("n", "c")])
    dark = sums.where((F.col("n") >= F.greatest(F.lit(2.0), 0.015 * step * step)) & (F.col("c") == 0)).select(*PAGE, "ty", F.greatest(F.lit(1), "a").alias("a"), F.least(F.col("next") - 1, F.col("columns") - 2).alias("z")).where("a <= z")
    around = dark.select(*PAGE, F.explode(F.sequence(F.col("ty") - 1, F.col("ty") + 1)).alias("ty"), (F.col("a") - 1).alias("a"), (F.col("z") + 1).alias("z"))
    return merged_intervals(around, [*PAGE, "ty"], "a", "z", 2)


def occupied(ink: DataFrame, pages: DataFrame, covers: DataFrame) -> DataFrame:
    """doc_id, page, ty, tx: tiles with ink outside the covers (boxes), and those around them.

    Tiles are 4 pt wide, 4 pixels at least; one counts with 1.5 % of its pixels dark,
    2 at least, and not in the outermost rows and columns.
    """
    return _tile_runs(ink, pages, covers).select(*PAGE, "ty", F.explode(F.sequence("a", "z")).alias("tx"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of runs that come by page, row and place; only a page's components and the last two rows are held."""
    page, row, above, here, j = None, None, [], [], 0
    parent: list[int] = []
    held: list[list] = []  # x0, y0, x1, y1, cells, first ty and tx

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    def made(pages: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*[(*p, *c) for p, found in pages for c in found], strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, fields.values(), strict=True)], list(fields))

    fields = None
    done: list[tuple] = []
    for batch in batches:
        fields = {c: batch.schema.field(c).type for c in PAGE} | dict.fromkeys(("x0", "y0", "x1", "y1", "cells", "fy", "fx"), pa.int64())
        for *p, ty, a, z in zip(*[batch.column(c).to_pylist() for c in (*PAGE, "ty", "a", "z")], strict=True):
            if p != page:
                if page is not None:
                    done.append((page, [h for c, h in enumerate(held) if parent[c] == c]))
                page, row, above, here, j, parent, held = p, None, [], [], 0, [], []
            if ty != row:
                above, here, j, row = here if row is not None and ty == row + 1 else [], [], 0, ty
            while j < len(above) and above[j][1] < a:
                j += 1
            own, k = None, j
            while k < len(above) and above[k][0] <= z:
                c = top(above[k][2])
                if own is None:
                    own = c
                elif c != own:
                    own, c = min(own, c), max(own, c)
                    parent[c] = own
                    p_, q = held[own], held[c]
                    held[own] = [min(p_[0], q[0]), min(p_[1], q[1]), max(p_[2], q[2]), max(p_[3], q[3]), p_[4] + q[4], *min((p_[5], p_[6]), (q[5], q[6]))]
                k += 1
            if own is None:
                own = len(parent)
                parent.append(own)
                held.append([a, ty, z, ty, 0, ty, a])
            h = held[own]
            h[0], h[2], h[3], h[4] = min(h[0], a), max(h[2], z), ty, h[4] + z - a + 1
            here.append((a, z, own))
        yield made(done)
        done = []
    if page is not None:
        yield made([(page, [h for c, h in enumerate(held) if parent[c] == c])])


def _components(runs: DataFrame) -> DataFrame:
    types = dict(runs.dtypes)
    schema = f"doc_id {types['doc_id']}, page {types['page']}, " + ", ".join(f"{c} bigint" for c in ("x0", "y0", "x1", "y1", "cells", "fy", "fx"))
    found = dealt(runs.select(*PAGE, "ty", "a", "z"), PAGE, ["ty", "a"]).mapInArrow(_linked, schema)
    return found.select(*PAGE, "x0", "y0", "x1", "y1", "cells", F.struct(F.col("fy").alias("ty"), F.col("fx").alias("tx")).alias("first"))


def components(cells: DataFrame) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1 (last ones), cells, first (ty, tx): 4-connected components of tiles."""
    w = W.partitionBy(*PAGE, "ty").orderBy("tx")
    runs = cells.select(*PAGE, "ty", "tx", (F.col("tx") - F.row_number().over(w)).alias("_run")).groupBy(*PAGE, "ty", "_run").agg(F.min("tx").alias("a"), F.max("tx").alias("z"))
    return _components(runs)


def _text_in(boxes: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    at = _met(boxes.withColumn("id", F.lit(0)), spans.withColumn("id", F.lit(0)), [*[F.col(f"a.{c}").alias(c) for c in key], (F.col("b.width") * F.col("b.height")).alias("area"), F.col("b.size").alias("size")], G.contains_center(G.box("a"), G.box("b")))
    return at.groupBy(*key).agg(F.sum("area").alias("text"), F.max("size").alias("largest"))


def residual_graphics(ink: DataFrame, pages: DataFrame, spans: DataFrame, rules: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """doc_id, page, region (from the top), x, y, width, height: pictures of scanned pages, in points.

    ink: doc_id, page, y, x0, x1 (runs of dark pixels).  pages: width, height (pixels),
    scale (pixels a point).  spans: text, box, size.  rules: x1, y1, x2, y2.  excluded: boxes.

    Ink under text, rules (a point around) and excluded boxes doesn't count.  A
    component is a picture if it is 45 pt wide, 30 high, takes 0.4 % of the page and
    30 tiles, and text in it takes at most 12 % and is at most 20 pt large; the
    first 24 of a page count.  Where a page has under 100 characters and a
    picture over half its width and 23 % of its height, one box holds them all; else
    pictures under 20 % of the width or 10 % of the height are left out.
    """
    one = lambda df, x, y, w, h: df.select(*PAGE, (x - 1).alias("x"), (y - 1).alias("y"), (w + 2).alias("width"), (h + 2).alias("height"))
    rule = G.rule_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    covers = one(spans, *(F.col(c) for c in BOX)).unionByName(one(rules, rule.x, rule.y, rule.width, rule.height))
    if excluded is not None:
        covers = covers.unionByName(excluded.select(*PAGE, *BOX))
    found = _components(_tile_runs(ink, pages, covers)).join(_grid(pages), PAGE)
    size = lambda v: v * F.col("step") / F.col("scale")
    edge = lambda c: F.greatest(F.lit(0.0), size(F.col(c) + 1) - 2)
    wide = lambda a, z: F.greatest(F.lit(1.0), size(F.col(z) - F.col(a) - 1) + 4)
    boxes = found.select(*PAGE, "first", "cells", edge("x0").alias("x"), edge("y0").alias("y"), wide("x0", "x1").alias("width"), wide("y0", "y1").alias("height"), (F.col("pw") / F.col("scale")).alias("pw"), (F.col("ph") / F.col("scale")).alias("ph"))
    area = F.col("width") * F.col("height")
    large = settled(boxes.where((F.col("width") >= 45) & (F.col("height") >= 30) & (area >= 0.004 * F.col("pw") * F.col("ph")) & (F.col("cells") >= 30)))
    told = large.join(_text_in(large, spans, [*PAGE, "first"]), [*PAGE, "first"], "left")
    kept = told.where((F.coalesce("text", F.lit(0.0)) <= 0.12 * area) & (F.coalesce("largest", F.lit(0.0)) <= 20))
    page = W.partitionBy(*PAGE)
    kept = kept.withColumn("_i", F.row_number().over(page.orderBy("first"))).where(F.col("_i") <= MOST)
    said = spans.groupBy(*PAGE).agg(F.sum(F.char_length("text")).alias("chars"))
    kept = kept.join(said, PAGE, "left").withColumn("_map", (F.coalesce("chars", F.lit(0)) < 100) & F.bool_or((F.col("width") > 0.5 * F.col("pw")) & (F.col("height") > 0.23 * F.col("ph"))).over(page))
    kept = settled(kept)
    whole = kept.where("_map").groupBy(*PAGE).agg(F.min("first").alias("first"), *G.bounds(G.box()))
    rest = kept.where(~F.col("_map") & (F.col("width") >= 0.2 * F.col("pw")) & (F.col("height") >= 0.1 * F.col("ph")))
    out = whole.unionByName(rest.select(*PAGE, "first", *BOX))
    return out.select(*PAGE, (F.row_number().over(page.orderBy("first")) - 1).alias("region"), *BOX)
