"""Boxes, rules and units as Column expressions.

A box is named by a prefix: ``box("s")`` reads s.x, s.y, s.width and s.height.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import constants as C


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    width: Column
    height: Column

    @property
    def right(self) -> Column:
        return self.x + self.width

    @property
    def bottom(self) -> Column:
        return self.y + self.height


def box(alias: str | None = None) -> Box:
    at = f"{alias}." if alias else ""
    return Box(*(F.col(at + n) for n in ("x", "y", "width", "height")))


def horizontal(y1: Column, y2: Column) -> Column:
    return F.abs(y1 - y2) < C.AXIS


vertical = horizontal


def contains_box(outer: Box, inner: Box, by: float = 0.0) -> Column:
    return (inner.x >= outer.x - by) & (inner.y >= outer.y - by) & (inner.right <= outer.right + by) & (inner.bottom <= outer.bottom + by)


def contains_center(outer: Box, inner: Box) -> Column:
    cx, cy = inner.x + inner.width / 2, inner.y + inner.height / 2
    return (cx >= outer.x) & (cx <= outer.right) & (cy >= outer.y) & (cy <= outer.bottom)


def overlaps(a: Box, b: Box) -> Column:
    """Strictly: borders that touch don't count."""
    return (a.x < b.right) & (b.x < a.right) & (a.y < b.bottom) & (b.y < a.bottom)


def intersects(a: Box, b: Box, more: float = 0.5) -> Column:
    """By more than ``more`` in both directions."""
    return (F.least(a.right, b.right) - F.greatest(a.x, b.x) > more) & (F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y) > more)


def near(a: Box, b: Box, pad: float) -> Column:
    """With ``pad`` around, borders included."""
    return (a.x <= b.right + pad) & (b.x <= a.right + pad) & (a.y <= b.bottom + pad) & (b.y <= a.bottom + pad)


def touches(a: Box, b: Box) -> Column:
    return near(a, b, C.TOUCH)


def rule_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    return Box(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))


def rounded(value: Column) -> Column:
    """Half toward plus infinity."""
    return F.floor(value + 0.5)


def points(mm: Column) -> Column:
    return mm * C.MM


def twips(pt: Column) -> Column:
    return rounded(pt * 20)


def emu(pt: Column) -> Column:
    return rounded(pt * 12_700)


def median(value: Column, empty: float = 12.0) -> Column:
    """Mean of the two middle values for an even number of them."""
    return F.coalesce(F.percentile(value, F.lit(0.5)), F.lit(empty))


def lower_quantile(value: Column, p: float) -> Column:
    """The sorted value at index floor((n - 1) p) of a small group, such as a page's blocks; null without values."""
    held = F.array_sort(F.collect_list(value))
    return F.get(held, F.floor((F.size(held) - 1) * F.lit(p)).cast("int"))


def lower_quantiles(rows: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """by, name: the sorted value at index floor((n - 1) p) of groups of any size: values are counted, and counts summed up."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    group = W.partitionBy(*by)
    known = counts.withColumns({"_up": F.sum("_n").over(group.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(group)})
    return known.where(F.col("_up") > F.floor((F.col("_all") - 1) * F.lit(p))).groupBy(*by).agg(F.min(value).alias(name))


def medians(rows: DataFrame, by: list[str], value: str, name: str, total: Column) -> DataFrame:
    """by, name, total: the median of groups of any size (null without values) and a sum over their rows; values are counted, and counts summed up."""
    counts = rows.groupBy(*by, value).agg(F.count(value).alias("_n"), F.sum(total).alias("_total"))
    group = W.partitionBy(*by)
    known = counts.withColumns({"_up": F.sum("_n").over(group.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(group)})
    at = lambda i: F.min(F.when(F.col("_up") > F.floor(i), F.col(value)))
    return known.groupBy(*by).agg(((at((F.col("_all") - 1) / 2) + at(F.col("_all") / 2)) / 2).alias(name), F.sum("_total").alias("total"))


def bounds(b: Box) -> list[Column]:
    """Aggregates x, y, width and height around a group; zeros for none."""
    x, y = F.min(b.x), F.min(b.y)
    return [F.coalesce(c, F.lit(0.0)).alias(n) for n, c in (("x", x), ("y", y), ("width", F.max(b.right) - x), ("height", F.max(b.bottom) - y))]


def multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """Affine product: b first, then a; six numbers each, columns of a 2 x 3 matrix."""
    out = []
    for i in (0, 2, 4):
        more = (a[4], a[5]) if i == 4 else (F.lit(0.0), F.lit(0.0))
        out += [a[0] * b[i] + a[2] * b[i + 1] + more[0], a[1] * b[i] + a[3] * b[i + 1] + more[1]]
    return out


def transformed_box(m: list[Column], b: Box) -> Box:
    """Bounds of the four corners under an affine map."""
    corners = [(x, y) for x in (b.x, b.right) for y in (b.y, b.bottom)]
    xs = [m[0] * x + m[2] * y + m[4] for x, y in corners]
    ys = [m[1] * x + m[3] * y + m[5] for x, y in corners]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys))


def displayed_size(orientation: Column, rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height after EXIF orientation (1-8) and rotation (0, 90, 180, 270)."""
    turned = (orientation >= 5) != (rotation % 180 == 90)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
