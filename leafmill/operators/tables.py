"""Tables from rules and spans, and components of touching boxes.

Which rules belong together is a union-find over one page's rules (2 000 at
most); grids, cells and the spans in them are folds and joins.  For edges that
span pages, ``linked`` is the distributed form.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import text as X
from leafmill.operators import lines as L
from leafmill.operators import spans as S
from leafmill.operators.folds import dealt, whole_groups
from leafmill.operators.spans import PAGE
from leafmill.shared import settled


def touching(boxes: DataFrame, pad: float, by: list[str] = PAGE) -> DataFrame:
    """boxes (ord, x, y, width, height) with the column component: the least ord of all that touch within ``pad``."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, groups in whole_groups(batches, by):
            x, y, w, h = (rows.column(c).to_numpy().astype(float) for c in ("x", "y", "width", "height"))
            x1, y1 = x + w, y + h
            right, bottom = x1 + pad, y1 + pad
            least: list[int] = []
            for i, j in groups:
                links = []
                for k in range(i, j):
                    near = (x[i:k] <= right[k]) & (x[k] <= right[i:k]) & (y[i:k] <= bottom[k]) & (y[k] <= bottom[i:k])
                    links += [(m, k - i) for m in np.flatnonzero(near).tolist()]
                least += [i + m for m in _least(range(j - i), links)]
            yield from rows.append_column("component", rows.column("ord").take(pa.array(least, pa.int64()))).combine_chunks().to_batches()

    schema = ", ".join(f"{c} {t}" for c, t in boxes.dtypes) + f", component {dict(boxes.dtypes)['ord']}"
    return dealt(boxes, by, ["ord"]).mapInArrow(label, schema)


def linked(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the least node of each connected component, by alternating stars.

    A round links a node's larger neighbours, then its smaller ones, to the least
    of all, until links are stars around the least nodes; after the first round
    they are about as many as the nodes.  Links are settled after each round.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = settled(ends.where("u <> v").distinct())
    before = None
    while (now := tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before:
        before = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = settled(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = settled(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component")))


def _least(cells: Iterable[int], links: Iterable[tuple[int, int]]) -> list[int]:
    """The least cell that each of some cells is linked with, itself included."""
    root = {c: c for c in cells}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    return [top(c) for c in root]


def _roots(links: DataFrame, key: list[str]) -> DataFrame:
    """key, cell, root: the least cell of each cell that links (key, a, b) link to others of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, groups in whole_groups(batches, key):
            a, b = rows.column("a").to_pylist(), rows.column("b").to_pylist()
            first, cells, roots = [], [], []
            for i, j in groups:
                here = sorted({*a[i:j], *b[i:j]})
                cells += here
                roots += _least(here, zip(a[i:j], b[i:j], strict=True))
                first += [i] * len(here)
            at = pa.array(first, pa.int64())
            yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks().take(at) for c in key], pa.array(cells, pa.int32()), pa.array(roots, pa.int32())], [*key, "cell", "root"])

    types = dict(links.dtypes)
    return dealt(links.select(*key, "a", "b"), key, ["a", "b"]).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in key) + ", cell int, root int")


def _outer_edges(tables: DataFrame, flats: DataFrame, spans: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """tables with xs taken out to where three row strokes and more end, if text stands in the strip."""
    ends = flats.select(*key, F.col("x").alias("left"), (F.col("x") + F.col("width")).alias("right"), "y")
    reach = ends.groupBy(*key).agg(F.min("left").alias("first"), F.max("right").alias("last"))
    row = F.floor(F.col("y") / tolerance + 0.5)
    often = ends.join(reach, key).groupBy(*key, "first", "last").agg(
        F.count_distinct(F.when(F.col("left") - F.col("first") <= tolerance, row)).alias("at_first"), F.count_distinct(F.when(F.col("last") - F.col("right") <= tolerance, row)).alias("at_last")
    )
    known = tables.join(often, key, "left").join(S.body_size(spans), PAGE, "left")
    left = (F.col("at_first") >= 3) & (F.col("xs")[0] - F.col("first") > F.col("body_size"))
    right = (F.col("at_last") >= 3) & (F.col("last") - F.element_at("xs", -1) > F.col("body_size"))
    known = known.withColumns({"_l": F.coalesce(left, F.lit(False)), "_r": F.coalesce(right, F.lit(False)), "_x0": F.col("xs")[0], "_x1": F.element_at("xs", -1), "_y0": F.col("ys")[0], "_y1": F.element_at("ys", -1)})
    s = spans.select(*PAGE, F.col("x").alias("sx"), (F.col("x") + F.col("width")).alias("sr"), F.col("y").alias("sy"))
    at = known.where("_l or _r").join(s, PAGE).where("sy >= _y0 and sy < _y1")
    text = at.groupBy(*key).agg(F.bool_or(F.expr("_l and sx >= first - 1 and sr <= _x0 + 1")).alias("in_first"), F.bool_or(F.expr("_r and sx >= _x1 - 1 and sr <= last + 1")).alias("in_last"))
    out = known.join(text, key, "left")
    none = F.array().cast("array<double>")
    xs = F.concat(F.when(F.col("in_first"), F.array("first")).otherwise(none), "xs", F.when(F.col("in_last"), F.array("last")).otherwise(none))
    return out.select(*key, xs.alias("xs"), "ys")


def ruled(spans: DataFrame, rules: DataFrame, tolerance: float = C.GRID_TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Ruled tables: (tables, cells).

    tables: doc_id, page, component, xs, ys.  cells: doc_id, page, component,
    row, column, row_span, column_span, ord of each span by its centre.  A
    component of touching rules counts with 3-41 column lines and 3-201 row
    lines, open outer columns included, if any span's centre lies in it.  Grid
    cells without a whole stroke between them are one; if these don't make
    rectangles, the component is no table.
    """
    key = [*PAGE, "component"]
    across = F.abs(F.col("y1") - F.col("y2")) < C.AXIS
    axis = rules.where((across | (F.abs(F.col("x1") - F.col("x2")) < C.AXIS)) & (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > C.MIN_RULE))
    boxes = axis.select(*PAGE, "ord", F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), F.abs(F.col("x2") - F.col("x1")).alias("width"), F.abs(F.col("y2") - F.col("y1")).alias("height"))
    parts = settled(touching(boxes, C.TOUCH).withColumn("flat", F.col("height") < C.AXIS))
    held = parts.groupBy(*key).agg(F.collect_list(F.when(~F.col("flat"), F.col("x") + F.col("width") / 2)).alias("vx"), F.collect_list(F.when(F.col("flat"), F.col("y") + F.col("height") / 2)).alias("hy"))

    def middle(c: str) -> Column:
        return F.transform(S.clusters(F.col(c), tolerance), lambda v: (F.element_at(v, F.floor((F.size(v) + 1) / 2).cast("int")) + F.element_at(v, F.floor((F.size(v) + 2) / 2).cast("int"))) / 2)

    tables = held.select(*key, middle("vx").alias("xs"), middle("hy").alias("ys")).where((F.size("xs") >= C.X_LINES[0]) & (F.size("ys") >= C.Y_LINES[0]))
    tables = _outer_edges(tables, parts.where("flat"), spans, key, tolerance).where(F.size("xs").between(*C.X_LINES) & F.size("ys").between(*C.Y_LINES))
    points = spans.select(*PAGE, "ord", (F.col("x") + F.col("width") / 2).alias("px"), (F.col("y") + F.col("height") / 2).alias("py"))
    outer = tables.select(*key, F.col("xs")[0].alias("x0"), F.element_at("xs", -1).alias("x1"), F.col("ys")[0].alias("y0"), F.element_at("ys", -1).alias("y1"))
    filled = outer.join(points, PAGE).where("px between x0 and x1 and py between y0 and y1").select(*key).distinct()
    tables = settled(tables.join(filled, key, "left_semi"))

    # A cell is numbered by row and column; what stands between two is a stretch of a grid line.
    number = F.col("row") * 64 + F.col("column")
    steps = tables.select(*key, "xs", "ys", F.explode(F.sequence(F.lit(0), F.size("ys") - 2)).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.size("xs") - 2)).alias("column"))
    at = {c: F.element_at(v, i + 1) for c, v, i in (("x0", "xs", F.col("column")), ("x1", "xs", F.col("column") + 1), ("y0", "ys", F.col("row")), ("y1", "ys", F.col("row") + 1))}
    grid = steps.select(*key, "row", "column", number.alias("cell"), (F.size("xs") - 1).alias("columns"), (F.size("ys") - 1).alias("rows"), *[v.alias(c) for c, v in at.items()])
    beside = grid.where("column + 1 < columns").select(*key, F.col("cell").alias("a"), (F.col("cell") + 1).alias("b"), F.lit(False).alias("flat"), F.col("x1").alias("place"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))
    below = grid.where("row + 1 < rows").select(*key, F.col("cell").alias("a"), (F.col("cell") + 64).alias("b"), F.lit(True).alias("flat"), F.col("y1").alias("place"), F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    walls = beside.union(below)
    strokes = parts.select(*key, "flat", F.when(F.col("flat"), F.col("y") + F.col("height") / 2).otherwise(F.col("x") + F.col("width") / 2).alias("at"), F.when(F.col("flat"), F.col("x")).otherwise(F.col("y")).alias("start"), F.when(F.col("flat"), F.col("x") + F.col("width")).otherwise(F.col("y") + F.col("height")).alias("end"))
    along = walls.join(strokes, [*key, "flat"]).where("abs(at - place) < 2")
    closed = S.covered(along, [*key, "a", "b"], "start", "end", F.col("lo"), F.col("hi")).where("covered")
    open_ = walls.join(closed.select(*key, "a", "b"), [*key, "a", "b"], "left_anti").select(*key, "a", "b")
    members = grid.join(_roots(open_, key), [*key, "cell"], "left").withColumn("root", F.coalesce("root", "cell"))
    whole = members.groupBy(*key, "root").agg(F.min("row").alias("row"), F.min("column").alias("column"), (F.max("row") - F.min("row") + 1).alias("row_span"), (F.max("column") - F.min("column") + 1).alias("column_span"), F.count("*").alias("n"), F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("y1") - F.min("y0")).alias("height"))
    whole = settled(whole)
    odd = whole.where("row_span * column_span <> n").select(*key).distinct()
    tables, whole = tables.join(odd, key, "left_anti"), whole.join(odd, key, "left_anti")
    boxes = whole.select(*PAGE, F.struct("component", "row", "column", "row_span", "column_span").alias("cell_ord"), "x", "y", "width", "height")
    cells = S.first_cell(points, boxes, PAGE, ["ord"]).select(*PAGE, "cell_ord.component", "cell_ord.row", "cell_ord.column", "cell_ord.row_span", "cell_ord.column_span", "ord")
    return tables, cells


def open_numeric(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Numeric tables between two rules of one width without vertical ones: doc_id, page, top, ord, row, column.

    A rule wider than eight body sizes is matched with the first like it that
    lies two body sizes below.  Between them stand 3 to 100 rows of three spans
    and more, three fifths of each numeric, no further apart than 1.8 sizes;
    above the upper rule one header row of two spans and more (row 0).  Columns
    are the spans' intervals with less than half a size between merged, 3 to 20
    of them; every span stands in one and every row fills all.  Spans belong to
    the highest table that takes them.
    """
    key = [*PAGE, "top"]
    body = S.body_size(spans)
    flat = rules.where(F.abs(F.col("y1") - F.col("y2")) < C.AXIS).join(body, PAGE).select(*PAGE, "ord", F.least("x1", "x2").alias("l"), F.greatest("x1", "x2").alias("r"), "y1", "body_size").where(F.col("r") - F.col("l") > 8 * F.col("body_size"))
    a, b = flat.alias("a"), flat.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("b.y1") > F.col("a.y1") + 2 * F.col("a.body_size")) & (F.abs(F.col("a.l") - F.col("b.l")) < 2 * F.col("a.body_size")) & (F.abs(F.col("a.r") - F.col("b.r")) < 2 * F.col("a.body_size"))
    bands = a.join(b, on).groupBy("a.doc_id", "a.page", F.col("a.ord").alias("top"), F.col("a.l").alias("l"), F.col("a.r").alias("r"), F.col("a.y1").alias("y0")).agg(F.min("b.y1").alias("y1"))
    upright = rules.where(F.abs(F.col("x1") - F.col("x2")) < C.AXIS).select(*PAGE, F.col("x1").alias("vx"), F.least("y1", "y2").alias("v0"), F.greatest("y1", "y2").alias("v1"))
    v, t = upright.alias("v"), bands.alias("t")
    crossed = (F.col("t.doc_id") == F.col("v.doc_id")) & (F.col("t.page") == F.col("v.page")) & F.col("v.vx").between(F.col("t.l") - 2, F.col("t.r") + 2) & (F.col("v.v0") < F.col("t.y1")) & (F.col("v.v1") > F.col("t.y0"))
    bands = t.join(v, crossed, "left_anti")
    beside = spans.join(bands, PAGE).where((F.col("x") >= F.col("l") - 1) & (F.col("x") + F.col("width") <= F.col("r") + 1))
    inside = beside.where((F.col("y") >= F.col("y0") - 1) & (F.col("y") + F.col("height") <= F.col("y1") + 1))
    sizes = inside.groupBy(*key).agg(F.percentile("size", F.lit(0.5)).alias("typical"))
    above = beside.join(sizes, key).where((F.col("y") + F.col("height") <= F.col("y0") + 1) & (F.col("y") >= F.col("y0") - 1.8 * F.col("typical")))

    rows, header = (L.rows_of(part.drop("l", "r", "y0", "y1", "typical"), key) for part in (inside, above))
    typical = rows.groupBy(*key, "row").agg(F.count("*").alias("n"), F.count_if(X.numeric_token(F.col("text"))).alias("digits"), F.max("baseline").alias("line"))
    step = F.col("line") - F.lag("line").over(W.partitionBy(*key).orderBy("row"))
    good = typical.withColumn("step", step).join(sizes, key).groupBy(*key).agg(
        F.count("*").alias("rows"), F.bool_and((F.col("n") >= 3) & (F.col("digits") >= F.greatest(F.lit(2), 0.6 * F.col("n"))) & F.coalesce(F.col("step") <= 1.8 * F.col("typical"), F.lit(True))).alias("ok")
    ).where("ok and rows between 3 and 100")
    titled = header.groupBy(*key).agg(F.max("row").alias("last"), F.count("*").alias("n")).where("last = 0 and n >= 2")
    rows = rows.withColumn("row", F.col("row") + 1).unionByName(header).join(good.select(*key), key, "left_semi").join(titled.select(*key), key, "left_semi")
    taken = rows.withColumn("first", F.min("top").over(W.partitionBy(*PAGE, "ord"))).where("first = top").drop("first")
    columns = S.merged_intervals(taken.join(sizes, key).select(*key, "typical", F.col("x").alias("lo"), (F.col("x") + F.col("width")).alias("hi")), [*key, "typical"], "lo", "hi", F.col("typical") * 0.5)
    columns = columns.withColumn("column", F.row_number().over(W.partitionBy(*key).orderBy("lo")) - 1)
    edge = W.partitionBy(*key).orderBy("lo")
    left, right = (F.lag("hi").over(edge) + F.col("lo")) / 2, (F.col("hi") + F.lead("lo").over(edge)) / 2
    cells = columns.join(bands.select(*key, "l", "r"), key).select(*key, "column", F.coalesce(left, "l").alias("lo"), F.coalesce(right, "r").alias("hi"))
    placed = taken.select(*key, "ord", "row", "x", (F.col("x") + F.col("width")).alias("right")).join(cells, key).where((F.col("x") >= F.col("lo") - 1) & (F.col("right") <= F.col("hi") + 1))
    placed = placed.groupBy(*key, "ord", "row").agg(F.min("column").alias("column"))
    all_ = columns.groupBy(*key).agg(F.count("*").alias("all")).join(taken.groupBy(*key).agg(F.count("*").alias("members")), key)
    full = placed.groupBy(*key, "row").agg(F.count_distinct("column").alias("filled"), F.count("*").alias("n")).join(all_, key).groupBy(*key).agg(
        F.bool_and((F.col("filled") == F.col("all")) | (F.col("row") == 0)).alias("ok"), F.sum("n").alias("n"), F.max("all").alias("all"), F.max("members").alias("members")
    ).where("ok and n = members and all between 3 and 20")
    return placed.join(full.select(*key), key, "left_semi").select(*key, "ord", "row", "column")


def diagrams(boxes: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Drawings: components of boxes within 8 pt with three members, 100 x 70 pt, under 45 % of the page, eight small labels."""
    parts = touching(boxes, 8.0)
    held = parts.groupBy(*PAGE, "component").agg(F.count("*").alias("members"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom")).where("members >= 3 and right - x >= 100 and bottom - y >= 70")
    held = held.join(pages.select(*PAGE, (F.col("width") * F.col("height")).alias("area")), PAGE).where("(right - x) * (bottom - y) <= 0.45 * area")
    s = labels.select(*PAGE, (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy")).where(F.char_length("text") <= 40)
    inside = held.join(s, PAGE).where("cx between x and right and cy between y and bottom")
    return inside.groupBy(*PAGE, "component", "x", "y", "right", "bottom").agg(F.count("*").alias("labels")).where("labels >= 8")
