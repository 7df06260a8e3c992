"""OCR readings as tables: flattening, sizes, leading, and which of two readings to keep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.folds import folded
from leafmill.operators.spans import PAGE

WORD = "text string, confidence double, bbox struct<x0:double,y0:double,x1:double,y1:double>"
DIGITS = r"^[\d\s.,/%之分]+$"


def words(pages: DataFrame, scale: float = 1.0, most: int = 25_000) -> DataFrame:
    """The words of nested readings (doc_id, page, blocks > paragraphs > lines > words) as spans in points.

    Lines that run down the page (height at least 1.6 widths) are left out; a
    page of more than ``most`` words is an error.
    """
    blocks = pages.select(*PAGE, F.posexplode("blocks").alias("block", "b"))
    paragraphs = blocks.select(*PAGE, "block", F.posexplode("b.paragraphs").alias("paragraph", "p"))
    lines = paragraphs.select(*PAGE, "block", "paragraph", F.posexplode("p.lines").alias("line", "l"))
    box = F.col("l.bbox")
    lines = lines.where((box["y1"] - box["y0"]) < 1.6 * (box["x1"] - box["x0"]))
    found = lines.select(*PAGE, "block", "paragraph", "line", F.posexplode("l.words").alias("word", "w"))
    n = F.count("*").over(W.partitionBy(*PAGE))
    at = F.col("w.bbox")
    ids = F.concat_ws(":", F.col("page"), "block", "paragraph", "line")
    out = found.select(
        *PAGE, ids.alias("line_id"), "block", "word", F.col("w.text").alias("text"), F.col("w.confidence").alias("confidence"), (at["x0"] / scale).alias("x"), (at["y0"] / scale).alias("y"),
        ((at["x1"] - at["x0"]) / scale).alias("width"), ((at["y1"] - at["y0"]) / scale).alias("height"), n.alias("_n"),
    )
    return out.withColumn("text", F.when(F.col("_n") > most, F.raise_error(F.lit("too many words on a page"))).otherwise(F.col("text"))).drop("_n")


def type_size(words_: DataFrame, by: list[str]) -> DataFrame:
    """The typical height of each line: median of the largest cluster of heights within max(0.75, 18 %), the first of equals."""
    a = words_.select(*by, F.col("word").alias("i"), F.col("height").alias("h"))
    b = words_.select(*by, F.col("height").alias("o"))
    pairs = a.join(b, by).where(F.abs(F.col("o") - F.col("h")) <= F.greatest(F.lit(0.75), 0.18 * F.col("h")))
    clusters = pairs.groupBy(*by, "i").agg(F.count("*").alias("n"), F.percentile("o", F.lit(0.5)).alias("size"))
    return clusters.groupBy(*by).agg(F.max(F.struct("n", (-F.col("i")).alias("first"), "size")).alias("c")).select(*by, F.col("c.size").alias("size"))


def leading(lines: DataFrame) -> DataFrame:
    """Median of plausible baseline steps over sizes (0.8 to 2.5) for each page; 1.5 without any."""
    down = W.partitionBy(*PAGE).orderBy("baseline", "x")
    step = (F.col("baseline") - F.lag("baseline").over(down)) / F.greatest("size", F.lag("size").over(down))
    return lines.select(*PAGE, step.alias("s")).groupBy(*PAGE).agg(F.coalesce(F.percentile(F.when(F.col("s").between(0.8, 2.5), F.col("s")), F.lit(0.5)), F.lit(1.5)).alias("leading"))


def even_sizes(lines: DataFrame) -> DataFrame:
    """Lines of more than 1.4 times the mean size of their nearest overlapping neighbours take that mean; later lines see it.

    Neighbours are the nearest line before and after, within six lines.
    """

    def mend(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["baseline", "x"], kind="stable").reset_index(drop=True)
        size, x0 = page["size"].to_numpy(copy=True), page["x"].to_numpy()
        x1 = x0 + page["width"].to_numpy()
        for i in range(len(page)):
            near = []
            for side in (range(i - 1, max(-1, i - 7), -1), range(i + 1, min(len(page), i + 7))):
                hit = next((j for j in side if x0[j] < x1[i] and x0[i] < x1[j] and abs(page["baseline"][j] - page["baseline"][i]) <= 2.5 * size[i]), None)
                if hit is not None:
                    near.append(size[hit])
            if len(near) == 2 and size[i] > 1.4 * np.mean(near):
                size[i] = np.mean(near)
        return page.assign(size=size)

    return lines.groupBy(*PAGE).applyInPandas(mend, ", ".join(f"{c} {t}" for c, t in lines.dtypes))


def prefer_cell(before: Column, after: Column, was: Column, now: Column) -> Column:
    """Whether a re-read cell may replace the old text: surer, no wild change of length, numbers only by sure numbers."""
    a, b = (F.char_length(F.regexp_replace(t, r"\s", "")) for t in (before, after))
    sure = (b > 0) & (now >= F.when(was < 50, 65).otherwise(75)) & (now >= was + 3)
    longer = b > F.when(was < 65, F.greatest(F.lit(2.0), a * 2.5)).otherwise(a * 1.6 + 2)
    length = (a == 0) | ~(longer | ((was >= 65) & (b < a * 0.5)))
    same = F.regexp_replace(before, r"\s", "") == F.regexp_replace(after, r"\s", "")
    digits = ~(before.rlike(DIGITS) & (a > 0)) | ((now >= 90) & after.rlike(DIGITS) & ((was < 90) | same))
    return sure & length & digits


def _ways(old: list[str], new: np.ndarray) -> Iterator[np.ndarray]:
    """For each character of old, by characters of new up to each place: how the alignment of least edits gets there.

    0 pairs the two, 1 leaves the old one out, 2 the new one; of equals the
    smaller number.
    """
    at = np.arange(len(new) + 1)
    above = at
    for i, c in enumerate(old, 1):
        pair, drop = above[:-1] + (new != c), above[1:] + 1
        # Leaving new ones out: the least over places k <= j of what is there plus j - k.
        here = np.append(i, np.minimum.accumulate(np.minimum(np.minimum(pair, drop) - at[1:], i)) + at[1:])
        yield np.append(1, np.argmin([pair, drop, here[:-1] + 1], axis=0))
        above = here


def consensus_text(before: str, sure: list[float], after: str, now: list[float], most: int = 400) -> str:
    """``after``, with characters of ``before`` where these are surer: at least 60, and 12 more than the new one.

    One alignment of least edits says which characters stand for each other.
    From the end on it pairs characters where that is among the best, else
    leaves one of ``before`` out, else one of ``after``.
    """
    old = [(c, s) for c, s in zip(before, sure, strict=True) if not c.isspace()]
    place = [k for k, c in enumerate(after) if not c.isspace()]
    if not old or not place or max(len(old), len(place)) > most:
        return after
    out, j = list(after), len(place)
    ways = list(_ways([c for c, _ in old], np.array([after[k] for k in place])))
    for (c, s), way in zip(reversed(old), reversed(ways), strict=True):
        # From each place, the nearest one before it where no new character is left out; place 0 is one.
        j = int(np.maximum.accumulate(np.where(way == 2, 0, np.arange(len(way))))[j])
        if j and way[j] == 0:
            j -= 1
            if s >= max(60, now[place[j]] + 12):
                out[place[j]] = c
    return "".join(out)


def consensus(pairs: DataFrame) -> DataFrame:
    """pairs (id, before, before_confidence, after, after_confidence; one confidence for each character) -> (id, text)."""

    def run(parts):
        for p in parts:
            rows = zip(p["before"], p["before_confidence"], p["after"], p["after_confidence"], strict=True)
            yield pd.DataFrame({"id": p["id"], "text": [consensus_text(b, list(s), a, list(t)) for b, s, a, t in rows]})

    return pairs.select("id", "before", "before_confidence", "after", "after_confidence").mapInPandas(run, f"id {dict(pairs.dtypes)['id']}, text string")


class _Row:
    """Numbers a page's rows: a line joins the newest one if 70 % of the higher of it and the row's first line are shared."""

    def __init__(self):
        self.row, self.span = -1, (0.0, 0.0)

    def __call__(self, v: dict) -> tuple[int]:
        low, high = self.span
        if self.row < 0 or min(high, v["y1"]) - max(low, v["y0"]) < 0.7 * max(high - low, v["y1"] - v["y0"]):
            self.row, self.span = self.row + 1, (v["y0"], v["y1"])
        return (self.row,)


class _Piece:
    """Numbers a row's pieces: a line goes on with one that ends at most 0.8 of the lower height before it."""

    def __init__(self):
        self.piece, self.end, self.span = -1, 0.0, (0.0, 0.0)

    def __call__(self, v: dict) -> tuple[int]:
        low, high = self.span
        if self.piece < 0 or v["x0"] - self.end > 0.8 * min(high - low, v["y1"] - v["y0"]):
            self.piece, self.end, self.span = self.piece + 1, v["x1"], (v["y0"], v["y1"])
        else:
            self.end, self.span = max(self.end, v["x1"]), (min(low, v["y0"]), max(high, v["y1"]))
        return (self.piece,)


def text_rows(lines: DataFrame) -> DataFrame:
    """doc_id, page, row, piece, x0, y0, x1, y1: lines (x0, y0, x1, y1) as rows and what is joined in them."""
    box = ["x0", "y0", "x1", "y1"]
    rows = folded(lines.select(*PAGE, *box, F.struct(*box).alias("_b")), PAGE, ["y0", "x0", "x1", "y1"], "_b", _Row, {"row": "bigint"})
    pieces = folded(rows.withColumn("_b", F.struct(*box)), [*PAGE, "row"], ["x0", "y0", "x1", "y1"], "_b", _Piece, {"piece": "bigint"})
    return pieces.groupBy(*PAGE, "row", "piece").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def horizontal_prose(lines: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, page, prose: whether a page reads as rows of prose.

    lines: doc_id, page, x0, y0, x1, y1.  pages: width.  24 rows, at least six
    and 30 % of the pieces wide (half the page, ten times their height), and
    their left edges within a quarter of the page's width.  Two rules in both
    directions rule a page out.
    """
    at = text_rows(lines).join(pages.select(*PAGE, F.col("width").alias("w")), PAGE)
    wide = (F.col("x1") - F.col("x0") >= 0.5 * F.col("w")) & (F.col("y1") - F.col("y0") < 0.1 * (F.col("x1") - F.col("x0")))
    held = at.groupBy(*PAGE).agg((F.max("row") + 1).alias("rows"), F.count("*").alias("pieces"), F.count_if(wide).alias("wide"), (F.max(F.when(wide, F.col("x0"))) - F.min(F.when(wide, F.col("x0")))).alias("spread"), F.max("w").alias("w"))
    drawn = rules.groupBy(*PAGE).agg(F.count_if(F.abs(F.col("y2") - F.col("y1")) < 2).alias("flat"), F.count_if(F.abs(F.col("x2") - F.col("x1")) < 2).alias("upright")).where("flat >= 2 and upright >= 2")
    test = (F.col("rows") >= 24) & (F.col("wide") >= F.greatest(F.lit(6.0), 0.3 * F.col("pieces"))) & (F.col("spread") <= 0.25 * F.col("w"))
    return held.join(drawn.select(*PAGE, F.lit(True).alias("grid")), PAGE, "left").select(*PAGE, (F.coalesce(test, F.lit(False)) & F.col("grid").isNull()).alias("prose"))


def prefer_horizontal(pairs: DataFrame, key: list[str], first: str, second: str, was: str, now: str) -> DataFrame:
    """key, dice, accepted: whether a second reading of a page's text may replace the first.

    It must be as sure, 0.95 to 1.2 times as long, and share 85 % of the pairs
    of neighbouring characters, repeats counted; white space doesn't count.
    Lengths are in UTF-16 units.  Pairs are counted as rows: no text is held in
    an array and compared with itself.
    """
    a, b = X.bare(F.col(first)), X.bare(F.col(second))

    def units(t: Column) -> Column:
        return F.octet_length(F.encode(t, "UTF-16BE")) / 2

    known = pairs.select(*key, a.alias("a"), b.alias("b"), F.col(was).alias("was"), F.col(now).alias("now"))

    def grams(side: str) -> DataFrame:
        at = known.select(*key, F.explode(F.sequence(F.lit(1), F.greatest(F.char_length(side) - 1, F.lit(1)))).alias("i"), side).where(F.char_length(side) >= 2)
        return at.select(*key, F.substring(F.col(side), F.col("i"), F.lit(2)).alias("pair"), F.lit(int(side == "a")).alias("one"))

    counts = grams("a").union(grams("b")).groupBy(*key, "pair").agg(F.sum("one").alias("n"), F.sum(1 - F.col("one")).alias("m"))
    shared = counts.groupBy(*key).agg(F.sum(F.least("n", "m")).alias("shared"))
    at = known.join(shared, key, "left")
    dice = 2 * F.coalesce("shared", F.lit(0)) / F.greatest(F.lit(1), units(F.col("a")) + units(F.col("b")) - 2)
    guard = (F.col("now") >= F.col("was")) & (units(F.col("b")) >= 0.95 * units(F.col("a"))) & (units(F.col("b")) <= 1.2 * units(F.col("a")))
    return at.select(*key, dice.alias("dice"), (guard & (dice >= 0.85)).alias("accepted"))


def fragments(short: DataFrame, long: DataFrame) -> DataFrame:
    """Fragments (ord, y, height) with the nearest long line (line, y, height) by centre, within 0.75 of its height."""
    pairs = short.select(*PAGE, "ord", (F.col("y") + F.col("height") / 2).alias("c")).join(long.select(*PAGE, "line", (F.col("y") + F.col("height") / 2).alias("o"), F.col("height").alias("h")), PAGE)
    pairs = pairs.withColumn("d", F.abs(F.col("c") - F.col("o"))).where(F.col("d") < 0.75 * F.col("h"))
    return pairs.groupBy(*PAGE, "ord").agg(F.min(F.struct("d", "line")).alias("b")).select(*PAGE, "ord", F.col("b.line").alias("line"))


def replaced(spans: DataFrame, better: DataFrame, key: list[str]) -> DataFrame:
    """spans with those of ``better`` in place of the old ones of the same key."""
    return spans.join(better.select(*key).distinct(), key, "left_anti").unionByName(better)
