"""Frames: lines along a slanted axis in their reading order, and plots within drawn frames."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.operators.folds import dealt, folded, whole_rows
from leafmill.operators.spans import PAGE, live

#: How much lines of one axis may differ in angle and size, and how far apart (in sizes) their baselines lie.
ALIKE, CLOSE, APART = 0.1, 0.55, 2.0


def reading_baseline(angle: Column, x: Column, baseline: Column) -> Column:
    """Where a span's baseline lies across its own axis; angle in degrees, x where its baseline begins."""
    a = F.radians(angle)
    return -F.sin(a) * x + F.cos(a) * baseline


class _Axis:
    """Numbers runs of lines that lie like the run's first line."""

    def __init__(self):
        self.run, self.first = -1, None

    def __call__(self, v: dict) -> tuple[int]:
        f = self.first
        if f is None or not f["even"] or not v["even"] or v["font"] != f["font"] or not self.like("angle", v) or not self.like("size", v):
            self.run, self.first = self.run + 1, v
            self.first["even"] = v["even"] and self.like("angle", v) and self.like("size", v)
        return (self.run,)

    def like(self, c: str, v: dict) -> bool:
        own = self.first[c]
        return abs(v[f"{c}_least"] - own) < ALIKE and abs(v[f"{c}_most"] - own) < ALIKE


def slanted_order(spans: DataFrame) -> DataFrame:
    """doc_id, page, line, place, run, axis_baseline, slanted: the lines of every page in reading order.

    spans: line, ord, x, y, width, baseline, size, font, source, angle (degrees; null if
    level), baseline_x.  Lines come from the top, then from the left.  Neighbours that
    lie like the first of their run (native, angle and size within 0.1, one font) and
    whose baselines across the axis are 0.55 to 2 sizes apart are put in the
    order of these; other runs stay as they are.
    """
    own = F.when(F.col("angle").isNull(), F.col("baseline")).otherwise(reading_baseline(F.col("angle"), F.col("baseline_x"), F.col("baseline")))
    first = lambda c: F.min_by(c, F.struct("x", "ord"))
    lines = spans.withColumn("_b", own).groupBy(*PAGE, "line").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.percentile("baseline", F.lit(0.5)).alias("baseline"), F.percentile("_b", F.lit(0.5)).alias("axis"), F.percentile("size", F.lit(0.5)).alias("line_size"),
        F.bool_and((F.col("source") == "pdf") & F.col("angle").isNotNull()).alias("pdf"), (F.count_distinct("font") == 1).alias("one"), first("font").alias("font"),
        *[f(c).alias(n) for c in ("angle", "size") for f, n in ((first, c), (F.min, f"{c}_least"), (F.max, f"{c}_most"))],
    )
    lines = lines.withColumns({"even": F.coalesce(F.col("pdf") & F.col("one"), F.lit(False)), "axis": F.when(F.col("angle_least").isNotNull() & F.col("pdf"), F.col("axis")).otherwise(F.col("baseline"))})
    value = F.struct("even", "font", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("angle", "angle_least", "angle_most", "size", "size_least", "size_most")])
    order = ["y", "x", "line"]
    told = lines.join(folded(lines.withColumn("_v", value), PAGE, order, "_v", _Axis, {"run": "bigint"}), [*PAGE, *order])
    along = W.partitionBy(*PAGE, "run").orderBy("axis", *order)
    step = F.col("axis") - F.lag("axis").over(along)
    told = told.withColumn("_ok", F.coalesce((step >= CLOSE * F.col("line_size")) & (step <= APART * F.col("line_size")), F.lit(True)))
    run = W.partitionBy(*PAGE, "run")
    told = told.withColumn("slanted", F.bool_and("_ok").over(run) & (F.count("*").over(run) > 1))
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("run", F.when(F.col("slanted"), F.col("axis")), *order))
    return told.select(*PAGE, "line", place.alias("place"), "run", F.col("axis").alias("axis_baseline"), "slanted")


PAGE_ROW, RULE, TEXT, ART, TABLE = range(5)


def _plots(sheet: np.ndarray, rules: np.ndarray, ords: list, text: np.ndarray, digit: np.ndarray, art: np.ndarray, tables: np.ndarray) -> list[tuple]:
    """The plots of a page (x, y, width, height) in the order of their frames; see ``framed_plots``.

    rules: x1, y1, x2, y2 in the order of ords; text, art, tables: boxes.
    """
    boxed = lambda b: (b[:, 0], b[:, 1], b[:, 0] + b[:, 2], b[:, 1] + b[:, 3])
    ups = [(o, r[0], min(r[1], r[3]), abs(r[3] - r[1])) for o, r in zip(ords, rules.tolist(), strict=True) if abs(r[0] - r[2]) < C.AXIS and abs(r[3] - r[1]) >= 70]
    if len(ups) < 2:
        return []
    slots: dict[tuple, list] = {}
    for u in ups:
        slots.setdefault((u[2] // 2, u[3] // 2), []).append(u)
    frames = []
    for i, x, y, height in ups:
        for u, v in product((-1, 0, 1), repeat=2):
            for j, bx, by, bh in slots.get((y // 2 + u, height // 2 + v), ()):
                if bx - x >= 150 and abs(by - y) <= 2 and abs(bh - height) <= 2 and (bx - x) * height <= 0.7 * (sheet[0] * sheet[1]):
                    frames.append((i, j, x, y, bx - x, height))
    if not frames:
        return []
    flat = rules[np.abs(rules[:, 1] - rules[:, 3]) < C.AXIS]
    fx, fr, fy = np.minimum(flat[:, 0], flat[:, 2]), np.minimum(flat[:, 0], flat[:, 2]) + np.abs(flat[:, 2] - flat[:, 0]), flat[:, 1]
    tx, ty, tr, tb = boxed(text)
    ax, ay, ar, ab = boxed(art)
    gx, gy, gr, gb = boxed(tables)
    mid = lambda b: (b[:, 0] + b[:, 2] / 2, b[:, 1] + b[:, 3] / 2)
    (mx, my), (hx, hy) = mid(text), mid(tables)
    kept: list[tuple] = []
    for _, _, x, y, w, h in sorted(frames, key=lambda f: f[:2]):
        right, bottom, cx, cy = x + w, y + h, x + w / 2, y + h / 2
        across = fy[(fx <= x + 2) & (fr >= right - 2)]
        if not ((np.abs(across - y) < 2).any() and (np.abs(across - bottom) < 2).any()):
            continue
        if (((hx >= x) & (hx <= right) & (hy >= y) & (hy <= bottom)) | ((cx >= gx) & (cx <= gr) & (cy >= gy) & (cy <= gb))).any():
            continue
        held = (mx >= x) & (mx <= right) & (my >= y) & (my <= bottom)
        out = (tx < x - 1) | (ty < y - 1) | (tr > right + 1) | (tb > bottom + 1) | (text[:, 2] > 0.7 * w)
        if (held & digit).sum() < 3 or (held & out).any():
            continue
        if not ((ax >= x - 2) & (ay >= y - 2) & (ar <= right + 2) & (ab <= bottom + 2) & (art[:, 2] > 0.15 * w) & (art[:, 3] > 0.1 * h)).any():
            continue
        shared = np.maximum(0.0, np.minimum(right, ar) - np.maximum(x, ax)) * np.maximum(0.0, np.minimum(bottom, ab) - np.maximum(y, ay))
        own = (ax >= x - 12) & (ay >= y - 12) & (ar <= right + 12) & (ab <= bottom + 12) & (shared >= 0.9 * art[:, 2] * art[:, 3])
        ex, ey = min([x, *ax[own].tolist()]), min([y, *ay[own].tolist()])
        ew, eh = max([right, *ar[own].tolist()]) - ex, max([bottom, *ab[own].tolist()]) - ey
        if ((mx >= ex) & (mx <= ex + ew) & (my >= ey) & (my <= ey + eh) & ~held).any():
            continue
        # One whose middle lies in an earlier one is passed over.
        if not any(a <= cx <= a + c and b <= cy <= b + d for a, b, c, d in kept):
            kept.append((ex, ey, ew, eh))
    middle = lambda o, b: o[0] <= b[0] + b[2] / 2 <= o[0] + o[2] and o[1] <= b[1] + b[3] / 2 <= o[1] + o[3]
    return [b for b in kept if not any(o[2] * o[3] > b[2] * b[3] and middle(o, b) for o in kept)]


def framed_plots(pages: DataFrame, rules: DataFrame, spans: DataFrame, artwork: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page, frame, x, y, width, height: plots in drawn frames, which stay one figure.

    pages: width, height.  rules: ord, x1, y1, x2, y2.  spans: ord, text, box and
    what ``live`` looks at.  artwork, tables: ord, box.

    A frame is two uprights of one top and height (2 pt, 70 pt at least), 150 pt
    and more apart, with level rules along top and bottom, of at most 70 % of the
    page.  It holds no table's middle and lies in none; no text crosses it (1 pt)
    or is over 70 % of its width; three texts have digits; and a piece of artwork
    within it (2 pt) is over 15 % wide and 10 % high.  Artwork up to 12 pt outside
    with 90 % of its area inside belongs to it, unless text would be taken in.  Of
    frames in frames the largest stays.

    What is on a page is dealt out once and looked at together; texts stay behind,
    only whether they have digits goes along.  Uprights meet under equal rounded
    tops and heights, so not all pairs are made.
    """
    box, ends = ["x", "y", "width", "height"], ["x1", "y1", "x2", "y2"]
    type_ = dict(rules.dtypes)["ord"]
    none, no = F.lit(None).cast(type_), F.lit(False)

    def side(df: DataFrame, number: int, values: list[Column | str], ord_: Column = none, digit: Column = no) -> DataFrame:
        return df.select(*PAGE, F.lit(number).alias("side"), ord_.cast(type_).alias("ord"), *[(F.col(v) if isinstance(v, str) else v).cast("double").alias(c) for c, v in zip("abcd", values, strict=True)], digit.alias("digit"))

    text = live(spans)
    rows = side(pages, PAGE_ROW, ["width", "height", F.lit(0), F.lit(0)]).unionByName(side(rules, RULE, ends, F.col("ord"))).unionByName(side(text, TEXT, box, digit=F.col("text").rlike(r"\d")))
    rows = rows.unionByName(side(artwork, ART, box)).unionByName(side(tables, TABLE, box)).where("doc_id is not null and page is not null")
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page_rows, starts in whole_rows(batches, PAGE):
            sides, digits = page_rows.column("side").to_numpy(), np.asarray(page_rows.column("digit"))
            values, ords = np.column_stack([page_rows.column(c).to_numpy() for c in "abcd"]), page_rows.column("ord").to_pylist()
            cuts = np.append(starts, len(sides)).tolist()
            which, found = [], []
            for lo, hi in pairwise(cuts):
                a, b, c, d, e = (lo + np.searchsorted(sides[lo:hi], range(PAGE_ROW + 1, TABLE + 2))).tolist()
                if a > lo:
                    plots = _plots(values[lo], values[a:b], ords[a:b], values[b:c], digits[b:c], values[c:d], values[d:e])
                    which += [lo] * len(plots)
                    found += [(k, *p) for k, p in enumerate(plots)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate([pa.int32(), *[pa.float64()] * 4])]
            at = page_rows.take(pa.array(which, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[pa.concat_arrays(at.column(c).chunks) if at.num_rows else pa.array([], at.schema.field(c).type) for c in PAGE], *columns], [*PAGE, "frame", *box])

    return dealt(rows, PAGE, ["side", "ord"]).mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in PAGE], "frame int", *[f"{c} double" for c in box]]))
