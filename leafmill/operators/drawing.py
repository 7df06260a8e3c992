"""Drawing operators of a page: state replay, path flattening, and what paint says about text.

ops: doc_id, page, i (order), op, nums (array of doubles), text.  op is one of
save, restore, form_begin (nums: matrix, may be empty), form_end, transform
(matrix), fill_color, stroke_color (text: RRGGBB with or without #), line_width,
opacity, text_mode, char_spacing, word_spacing, font (size), text_matrix (nums),
blend (text), show_text, image and path.

Only the replay is a fold, and its state is one stack; segments, rules, fills
and appearance are windows, aggregates and joins on (doc_id, page).  Text and
paint are aligned by a fold over both in the order of their characters, which
holds what one stream is ahead of the other.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators.folds import ARROW, changes, dealt, whole_rows
from leafmill.operators.spans import PAGE

#: What a page begins with, and what a restore without a save brings back.
START = {"fill": "000000", "stroke": "000000", "width": 1.0, "blend": "source-over", "opacity": 1.0, "mode": 0, "char_spacing": 0.0, "word_spacing": 0.0, "matrix": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)}
NEUTRAL = ("show_text", "image", "path")
SETS = {"line_width": "width", "opacity": "opacity", "text_mode": "mode", "char_spacing": "char_spacing", "word_spacing": "word_spacing"}
STATE = {"fill": "string", "stroke": "string", "width": "double", "blend": "string", "opacity": "double", "mode": "int", "char_spacing": "double", "word_spacing": "double", "matrix": "array<double>", "text_matrix": "array<double>", "font_size": "double"}


def product(m: tuple, n: tuple) -> tuple:
    """The matrix that applies n first, then m."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f)


class Replay:
    """The state after each operator; text matrix and font are not saved.  A state is never changed, only replaced."""

    def __init__(self):
        self.now, self.saved = START, []
        self.text_matrix, self.size = START["matrix"], 0.0

    def __call__(self, op: str, nums: list | None, text: str | None) -> bool:
        """Whether the operator is one that can change the state."""
        if op in NEUTRAL:
            return False
        nums = [float(x) for x in nums] if nums is not None else []
        if op in ("save", "form_begin"):
            self.saved.append(self.now)
        elif op in ("restore", "form_end"):
            self.now = self.saved.pop() if self.saved else START
        if op in ("transform", "form_begin") and len(nums) == 6:
            self.now = {**self.now, "matrix": product(self.now["matrix"], nums)}
        elif op in ("fill_color", "stroke_color") and text is not None:
            self.now = {**self.now, op[:-6]: text.replace("#", "", 1).upper()}
        elif op == "blend" and text is not None:
            self.now = {**self.now, "blend": text}
        elif op in SETS and nums:
            self.now = {**self.now, SETS[op]: int(nums[0]) if op == "text_mode" else nums[0]}
        elif op == "text_matrix" and len(nums) == 6:
            self.text_matrix = tuple(nums)
        elif op == "font" and nums:
            self.size = abs(nums[0])
        return op != "save"

    def get(self, name: str) -> object:
        return self.text_matrix if name == "text_matrix" else self.size if name == "font_size" else self.now[name]


class _Replaying:
    """States of the rows of sorted batches: only operators that can change one are looked at one by one."""

    def __init__(self, names: list[str]):
        self.names, self.at, self.state = names, None, Replay()

    def __call__(self, batch: pa.RecordBatch) -> tuple[list[list], np.ndarray]:
        """(states, which of them each row has)."""
        new, change = np.zeros(batch.num_rows, bool), ~np.asarray(pc.fill_null(pc.is_in(batch.column("op"), pa.array(NEUTRAL)), False))
        new[changes(batch, PAGE)] = True
        new[0] = [batch.column(c)[0].as_py() for c in PAGE] != self.at
        self.at = [batch.column(c)[-1].as_py() for c in PAGE]
        change[0] = True
        rows = np.flatnonzero(change | new)
        states, starts = [], []
        for row, fresh, op, nums, text in zip(rows.tolist(), new[rows].tolist(), *[batch.column(c).take(pa.array(rows)).to_pylist() for c in ("op", "nums", "text")], strict=True):
            if fresh:
                self.state = Replay()
            if self.state(op, nums, text) or fresh or not states:
                states.append([self.state.get(c) for c in self.names])
                starts.append(row)
        which = np.zeros(batch.num_rows, np.int32)
        which[starts] = 1
        return states, np.cumsum(which, dtype=np.int32) - 1


def replayed(ops: DataFrame, wanted: list[str] | None = None, together: bool = False) -> DataFrame:
    """ops with the state that holds after each of them: the columns of STATE, or those of them that are wanted.

    A state is written once for the operators that leave it as it is.  together:
    a page's rows already follow each other by i in one partition; nothing is dealt out then.
    """
    names = [c for c in STATE if wanted is None or c in wanted]
    keep = [*PAGE, "i", "op", "nums", "text"]
    types = dict(ops.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _Replaying(names)
        for batch in batches:
            if batch.num_rows:
                states, which = replay(batch)
                columns = [pa.array([s[k] for s in states], ARROW[STATE[c]]).take(pa.array(which)) for k, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], [*keep, *names])

    schema = ", ".join([*[f"{c} {types[c]}" for c in keep], *[f"{c} {STATE[c]}" for c in names]])
    rows = ops.select(*keep)
    return (rows if together else dealt(rows, PAGE, ["i"])).mapInArrow(run, schema)


def transformed(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return matrix[0] * x + matrix[2] * y + matrix[4], matrix[1] * x + matrix[3] * y + matrix[5]


def _composed(m: Column, n: Column) -> Column:
    """As ``product``, for columns."""
    return F.array(m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def _bounds_of(matrix: Column, x: Column, y: Column, right: Column, bottom: Column) -> dict[str, Column]:
    """The box around a transformed box."""
    corners = [transformed(matrix, a, b) for a in (x, right) for b in (y, bottom)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return {"x": F.least(*xs), "y": F.least(*ys), "width": F.greatest(*xs) - F.least(*xs), "height": F.greatest(*ys) - F.least(*ys)}


def placed_images(state: DataFrame, views: DataFrame) -> DataFrame:
    """doc_id, page, i, box, blend, behind_text: where images are painted; behind: before the page's first text.

    state: of ``replayed``.  views: doc_id, page, view (matrix of the page).
    """
    first = F.min(F.when(F.col("op") == "show_text", F.col("i"))).over(W.partitionBy(*PAGE))
    at = state.withColumn("_first", first).where("op = 'image'").join(views, PAGE)
    box = _bounds_of(_composed(F.col("view"), F.col("matrix")), *[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])
    return at.select(*PAGE, "i", *[v.alias(c) for c, v in box.items()], "blend", F.coalesce(F.col("i") < F.col("_first"), F.lit(False)).alias("behind_text"))


# Paths

STROKES = ["stroke", "close_stroke", "fill_stroke", "eo_fill_stroke", "close_fill_stroke", "close_eo_fill_stroke"]
FILLS = ["fill", "eo_fill", "fill_stroke", "eo_fill_stroke", "close_fill_stroke", "close_eo_fill_stroke"]


def segments(commands: DataFrame, state: DataFrame, views: DataFrame) -> DataFrame:
    """doc_id, page, i, k, subpath, x1, y1, x2, y2, curved, artwork: the straight pieces of paths on the page.

    commands: doc_id, page, i (of the path), k (order), command (move, line,
    curve, close), x, y (end point; null for close).  A line begins where the
    command before it ended, a close goes back to its subpath's first point.
    curved: the subpath has a curve, which is no piece itself.  artwork: the
    subpath is straight but has a piece that is neither level nor upright, by
    1.5 pt or 2 % of its length.
    """
    path = W.partitionBy(*PAGE, "i").orderBy("k")
    so_far = path.rowsBetween(W.unboundedPreceding, 0)
    moved = F.col("command") == "move"
    # Paths get their page's view, commands their path's matrix: what comes after goes by path.
    matrices = state.select(*PAGE, "i", "matrix").join(views, PAGE).select(*PAGE, "i", _composed(F.col("view"), F.col("matrix")).alias("_m"))
    known = commands.join(matrices, [*PAGE, "i"])
    x, y = transformed(F.col("_m"), F.col("x"), F.col("y"))
    known = known.withColumns({"px": x, "py": y, "subpath": F.sum(moved.cast("int")).over(so_far)})
    known = known.withColumns({f"f{c}": F.last(F.when(moved, F.col(f"p{c}")), True).over(so_far) for c in "xy"})
    closes = F.col("command") == "close"
    known = known.withColumns({f"e{c}": F.coalesce(F.when(closes, F.col(f"f{c}")).otherwise(F.col(f"p{c}")), F.lit(0.0)) for c in "xy"})
    known = known.withColumns({f"b{c}": F.coalesce(F.lag(f"e{c}").over(path), F.lit(0.0)) for c in "xy"})
    dx, dy = F.abs(F.col("ex") - F.col("bx")), F.abs(F.col("ey") - F.col("by"))
    piece = F.col("command").isin("line", "close")
    sub = W.partitionBy(*PAGE, "i", "subpath")
    slanted = F.coalesce(piece & (F.least(dx, dy) > F.least(F.lit(1.5), 0.02 * F.greatest(dx, dy))), F.lit(False))
    known = known.withColumn("curved", F.bool_or(F.col("command") == "curve").over(sub))
    known = known.withColumn("artwork", ~F.col("curved") & F.bool_or(slanted).over(sub))
    return known.where(piece).select(*PAGE, "i", "k", "subpath", F.col("bx").alias("x1"), F.col("by").alias("y1"), F.col("ex").alias("x2"), F.col("ey").alias("y2"), "curved", "artwork")


def painted(pieces: DataFrame, commands: DataFrame, state: DataFrame, spans: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules: doc_id, page, i, k, x1, y1, x2, y2, color, thickness; fills: doc_id, page, i, box, color, opaque) that paths paint.

    A path's paint is the text of its operator.  Strokes give a rule for each
    level or upright piece (within 1.5 pt) outside artwork.  A filled path without
    curves and of three pieces and more is a rule if it is at most 3 pt thin and
    over four times as long (k is null then), else a fill if it has four pieces.

    spans: a filled band of up to 3 pt that begins at a span's baseline and is
    as long as it, in another colour and at least 15 % of its size high, is no
    underline but a fill.
    """
    paint = state.where("op = 'path'").select(*PAGE, "i", F.col("text").alias("paint"), "fill", "stroke", "width", "blend", "opacity", "matrix")
    at = pieces.join(paint, [*PAGE, "i"])
    straight = (F.abs(F.col("x1") - F.col("x2")) < 1.5) | (F.abs(F.col("y1") - F.col("y2")) < 1.5)
    scale = F.sqrt(F.col("matrix")[0] ** 2 + F.col("matrix")[1] ** 2)
    stroked = at.where(F.col("paint").isin(STROKES) & ~F.col("artwork") & straight).select(*PAGE, "i", "k", "x1", "y1", "x2", "y2", F.col("stroke").alias("color"), (F.col("width") * scale).alias("thickness"))
    curved = commands.where("command = 'curve'").select(*PAGE, "i").distinct()
    areas = at.where(F.col("paint").isin(FILLS)).join(curved, [*PAGE, "i"], "left_anti").groupBy(*PAGE, "i").agg(
        F.count("*").alias("n"), *[f(F.least(c + "1", c + "2") if f is F.min else F.greatest(c + "1", c + "2")).alias(c + ("a" if f is F.min else "z")) for c in "xy" for f in (F.min, F.max)],
        *[F.first(c).alias(c) for c in ("fill", "blend", "opacity")],
    ).where("n >= 3")
    areas = areas.select(*PAGE, "i", "n", F.col("xa").alias("x"), F.col("ya").alias("y"), (F.col("xz") - F.col("xa")).alias("width"), (F.col("yz") - F.col("ya")).alias("height"), "fill", "blend", "opacity")
    w, h = F.col("width"), F.col("height")
    areas = areas.withColumn("thin", (F.least(w, h) <= 3) & (F.greatest(w, h) > 4 * F.least(w, h)))
    if spans is not None:
        a, s = areas.where((F.col("n") == 4) & (h > 0) & (h <= 3) & (w > 4 * h)).alias("a"), spans.alias("s")
        under = (
            (F.col("a.doc_id") == F.col("s.doc_id")) & (F.col("a.page") == F.col("s.page")) & (F.trim("s.text") != "") & (F.col("a.fill") != F.coalesce("s.color", F.lit("000000"))) & (F.col("a.height") >= 0.15 * F.col("s.size"))
            & (F.abs(F.col("a.y") - F.col("s.baseline")) <= 0.5) & (F.abs(F.col("a.x") - F.col("s.x")) <= 0.5) & (F.abs(G.box("a").right - G.box("s").right) <= 0.5)
        )
        band = a.join(s, under, "left_semi").select(*PAGE, "i").withColumn("band", F.lit(True))
        areas = areas.join(band, [*PAGE, "i"], "left").withColumn("thin", F.col("thin") & F.col("band").isNull()).drop("band")
    level = w > h
    middle_x, middle_y = F.col("x") + w / 2, F.col("y") + h / 2
    lines = areas.where("thin").select(
        *PAGE, "i", F.lit(None).cast(dict(pieces.dtypes)["k"]).alias("k"), F.when(level, F.col("x")).otherwise(middle_x).alias("x1"), F.when(level, middle_y).otherwise(F.col("y")).alias("y1"),
        F.when(level, G.box().right).otherwise(middle_x).alias("x2"), F.when(level, middle_y).otherwise(G.box().bottom).alias("y2"), F.col("fill").alias("color"), F.least(w, h).alias("thickness"),
    )
    fills = areas.where("not thin and n = 4").select(*PAGE, "i", "x", "y", "width", "height", F.col("fill").alias("color"), ((F.col("opacity") == 1) & (F.col("blend") == "source-over")).alias("opaque"))
    return stroked.unionByName(lines), fills


#: Codes of the letters of commands: move, line, curve, close.
LETTERS = np.full(128, -1, np.int8)
LETTERS[[ord(c) for c in "MLCZ"]] = range(4)


def _first_of(runs: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.zeros(0, np.int64)


def _pieces(path: np.ndarray, code: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """(x1, y1, x2, y2, artwork) of commands (move, line, curve, close as 0 to 3) in the order of their paths, as ``segments`` has them; known: with an end point."""
    n, moved = len(path), code == 0
    starts = _first_of(path)
    opens = np.zeros(n, np.int64)
    opens[starts] = starts
    opens = np.maximum.accumulate(opens)
    # A close goes back to the last move of its path that has a point.
    back = np.maximum.accumulate(np.where(moved & known, np.arange(n), -1))
    there = back >= opens
    ends, begins = [], []
    for v in (x, y):
        e = np.where(code == 3, np.where(there, v[back], 0.0), np.where(known, v, 0.0))
        b = np.append(0.0, e[:-1])
        b[starts] = 0.0
        ends.append(e)
        begins.append(b)
    dx, dy = (np.abs(e - b) for e, b in zip(ends, begins, strict=True))
    slanted = ((code == 1) | (code == 3)) & (np.minimum(dx, dy) > np.minimum(1.5, 0.02 * np.maximum(dx, dy)))
    cuts = moved.copy()
    cuts[starts] = True
    first = np.flatnonzero(cuts)
    of = np.cumsum(cuts) - 1
    artwork = (~np.logical_or.reduceat(code == 2, first) & np.logical_or.reduceat(slanted, first))[of]
    return begins[0], begins[1], ends[0], ends[1], artwork


def drawn(ops: DataFrame, together: bool = False) -> DataFrame:
    """doc_id, page, i, k, kind (stroke, line, fill), x1, y1, x2, y2, color, thickness, opaque: what ``segments`` and ``painted`` find, in one pass over a page's operators.

    ops: as for ``replayed``, with a path's commands in their order as a text of
    letters (M move, L line, C curve, Z close) and their end points as arrays xs
    and ys (null for Z), and, where pages are seen through one, view (matrix of
    the page).  k: the command of a stroke; lines and fills are filled areas,
    which spans have no say in here.  Paths carry their commands, so nothing is
    joined; together: see ``replayed``.
    """
    names = ["fill", "stroke", "width", "blend", "opacity", "matrix"]
    viewed = "view" in ops.columns
    keep = [*PAGE, "i", "op", "nums", "text", "commands", "xs", "ys", *(["view"] if viewed else [])]
    types = dict(ops.dtypes)
    out = {**{c: types[c] for c in (*PAGE, "i")}, "k": "int", "kind": "string", **dict.fromkeys(("x1", "y1", "x2", "y2"), "double"), "color": "string", "thickness": "double", "opaque": "boolean"}

    def painted_by(batch: pa.RecordBatch, states: list[list], which: np.ndarray) -> pa.RecordBatch:
        rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(batch.column("op"), "path"), False)))
        at, which = batch.take(pa.array(rows)), which[rows]
        matrix = np.array([s[5] for s in states], float).reshape(-1, 6)[which]
        if viewed:
            m, n = np.asarray(pc.list_flatten(at.column("view"))).reshape(-1, 6).T, matrix.T
            seen = np.array([m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5]]).T
        else:
            seen = matrix
        letters = at.column("commands")
        path = np.repeat(np.arange(len(rows)), np.asarray(pc.fill_null(pc.binary_length(letters), 0)))
        code = LETTERS[np.frombuffer("".join(x or "" for x in letters.to_pylist()).encode("ascii"), np.uint8)]
        x, y = (pc.list_flatten(at.column(c)) for c in ("xs", "ys"))
        known = ~(np.asarray(pc.is_null(x)) | np.asarray(pc.is_null(y)))
        x, y = (np.asarray(pc.fill_null(v, 0.0)) for v in (x, y))
        m = seen[path].T
        x1, y1, x2, y2, artwork = _pieces(path, code, m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5], known)
        starts = _first_of(path)
        number = np.arange(len(path)) - np.repeat(starts, np.diff(np.append(starts, len(path))))
        paint = at.column("text")
        strokes, fills = (np.asarray(pc.fill_null(pc.is_in(paint, pa.array(v)), False)) for v in (STROKES, FILLS))
        piece = (code == 1) | (code == 3)
        line = np.flatnonzero(piece & strokes[path] & ~artwork & ((np.abs(x1 - x2) < 1.5) | (np.abs(y1 - y2) < 1.5)))
        width = np.array([s[2] for s in states], float)[which] * np.sqrt(matrix[:, 0] * matrix[:, 0] + matrix[:, 1] * matrix[:, 1])

        inner = np.flatnonzero(piece & fills[path] & ~np.bincount(path[code == 2], minlength=len(rows)).astype(bool)[path])
        first = _first_of(path[inner])
        own, n = path[inner][first], np.diff(np.append(first, len(inner)))
        low = lambda a, b: np.minimum.reduceat(np.minimum(a, b)[inner], first) if len(first) else np.zeros(0)
        high = lambda a, b: np.maximum.reduceat(np.maximum(a, b)[inner], first) if len(first) else np.zeros(0)
        ax, ay = low(x1, x2), low(y1, y2)
        w, h = high(x1, x2) - ax, high(y1, y2) - ay
        thin = (np.minimum(w, h) <= 3) & (np.maximum(w, h) > 4 * np.minimum(w, h))
        level, bar, box = w > h, np.flatnonzero((n >= 3) & thin), np.flatnonzero((n == 4) & ~thin)
        mid_x, mid_y = ax + w / 2, ay + h / 2
        areas = (np.where(level, ax, mid_x)[bar], np.where(level, mid_y, ay)[bar], np.where(level, ax + w, mid_x)[bar], np.where(level, mid_y, ay + h)[bar])

        taken = np.concatenate([path[line], own[bar], own[box]])
        sizes = (len(line), len(bar), len(box))
        state = pa.array(which)
        value = lambda k: pa.array([s[k] for s in states], pa.string()).take(state)
        opaque = np.array([s[4] == 1 and s[3] == "source-over" for s in states], bool)[which]
        color = pa.concat_arrays([value(1).take(pa.array(path[line])), value(0).take(pa.array(np.concatenate([own[bar], own[box]])))])
        empty = lambda k, t: pa.nulls(sum(sizes[j] for j in k), t)
        columns = [*[at.column(c).take(pa.array(taken)) for c in (*PAGE, "i")], pa.concat_arrays([pa.array(number[line].astype(np.int32)), empty((1, 2), pa.int32())])]
        columns.append(pa.array(["stroke", "line", "fill"]).take(pa.array(np.repeat(np.arange(3), sizes))))
        columns += [pa.array(np.concatenate([a[line], b, c[box]])) for a, b, c in zip((x1, y1, x2, y2), areas, (ax, ay, ax + w, ay + h), strict=True)]
        columns += [color, pa.concat_arrays([pa.array(np.concatenate([width[path[line]], np.minimum(w, h)[bar]])), empty((2,), pa.float64())]), pa.concat_arrays([empty((0, 1), pa.bool_()), pa.array(opaque[own[box]])])]
        return pa.RecordBatch.from_arrays(columns, list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _Replaying(names)
        for batch in batches:
            if batch.num_rows:
                yield painted_by(batch, *replay(batch))

    rows = ops.select(*keep)
    return (rows if together else dealt(rows, PAGE, ["i"])).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in out.items()))


# Text and paint

#: How far ahead in the paint stream a span is looked for, and the character that text leaves out where a line is hyphenated.
AHEAD, SOFT = 64, "\u00ad"


class Aligned:
    """Spans against the stream of painted characters; rows come in the order of their first characters."""

    def __init__(self):
        self.stream, self.base, self.cursor = "", 0, 0
        self.waiting: deque[tuple[int, str]] = deque()

    def paint(self, text: str) -> list[tuple]:
        self.stream += text
        return self.settle(False)

    def span(self, ord_: int, text: str) -> list[tuple]:
        self.waiting.append((ord_, text))
        return self.settle(False)

    def settle(self, last: bool) -> list[tuple]:
        """(ord, start, end) of the spans that what is known decides; last: nothing more is painted."""
        out = []
        while self.waiting:
            ord_, text = self.waiting[0]
            at = self.cursor - self.base
            if not last and len(self.stream) < at + 1 + AHEAD + len(text):
                break
            self.waiting.popleft()
            if self.stream.startswith(SOFT, at) and not text.startswith(SOFT):
                at += 1
            if not self.stream.startswith(text, at):
                near = self.stream[at : at + AHEAD + len(text)]
                ahead = near.find(text)
                if ahead < 0 or near.find(text, ahead + 1) >= 0:
                    continue
                at += ahead
            out.append((ord_, self.base + at, self.base + at + len(text)))
            self.cursor = out[-1][2]
            if self.cursor - self.base > 1 << 16:
                self.stream, self.base = self.stream[self.cursor - self.base :], self.cursor
        return out


def _bare(text: str) -> Column:
    return F.regexp_replace(text, r"\s", "")


def _offsets(rows: DataFrame, order: str) -> DataFrame:
    """Non-blank texts of a page with the place of their first character (from) among all, and of the next (to)."""
    known = rows.withColumn("bare", _bare("text")).where("bare <> ''")
    to = F.sum(F.char_length("bare")).over(W.partitionBy(*PAGE).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return known.withColumn("to", to).withColumn("from", F.col("to") - F.char_length("bare"))


def aligned(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, page, ord, start, end: which characters of the page's paint (blanks left out) each span is.

    Spans (ord, text) are taken in order.  One that doesn't go on where the one
    before it ended is looked for up to 64 characters further, and only a single
    place counts; otherwise it has no row, and the next one is looked for from
    the same place.  A soft hyphen that is next in the paint is passed over.
    Blank spans and runs (i, text) take no part.

    Both streams come sorted by the place of their characters, so what is held
    is by how much one runs ahead of the other.
    """
    type_, step = dict(spans.dtypes)["ord"], dict(runs.dtypes)["i"]
    paint = runs.select(*PAGE, F.lit(0).alias("side"), "i", F.lit(None).cast(type_).alias("ord"), _bare("text").alias("bare"))
    text = spans.select(*PAGE, F.lit(1).alias("side"), F.lit(None).cast(step).alias("i"), "ord", _bare("text").alias("bare"))
    # Both are dealt out by page once: places and the fold are of the same partition.
    both = paint.unionByName(text).where("bare <> ''").withColumn("_group", F.xxhash64(*PAGE)).repartition("_group")
    to = F.sum(F.char_length("bare")).over(W.partitionBy("_group", *PAGE, "side").orderBy("i", "ord").rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("from", to - F.char_length("bare")).select(*PAGE, "from", "side", "ord", "bare").sortWithinPartitions(*PAGE, "from", "side", "ord")
    kinds = dict(placed.dtypes)
    out = {**{c: kinds[c] for c in PAGE}, "ord": type_, "start": "bigint", "end": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, Aligned()
        for batch in batches:
            found = []
            for *page, side, ord_, bare in zip(*[batch.column(c).to_pylist() for c in (*PAGE, "side", "ord", "bare")], strict=True):
                if page != at:
                    found += [(*at, *x) for x in state.settle(True)] if at is not None else []
                    at, state = page, Aligned()
                found += [(*page, *x) for x in (state.span(ord_, bare) if side else state.paint(bare))]
            yield table(found)
        if at is not None:
            yield table([(*at, *x) for x in state.settle(True)])

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], ARROW[t]) for k, t in enumerate(out.values())], list(out))

    return placed.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in out.items()))


def paint_runs(state: DataFrame) -> DataFrame:
    """doc_id, page, i, text, color, bold, invisible: painted texts with their state; bold: outlined besides, invisible: neither filled nor outlined."""
    mode = F.col("mode")
    return state.where("op = 'show_text'").select(*PAGE, "i", "text", F.col("fill").alias("color"), mode.isin(1, 2).alias("bold"), mode.isin(3, 7).alias("invisible"))


def _places(texts: list[str], stream: str) -> list[int]:
    """Where each text of a page begins in the whole stream of its paint, -1 if nowhere; as ``Aligned`` finds it."""
    out, cursor = [], 0
    for text in texts:
        at = cursor
        if stream.startswith(SOFT, at) and not text.startswith(SOFT):
            at += 1
        if not stream.startswith(text, at):
            near = stream[at : at + AHEAD + len(text)]
            ahead = near.find(text)
            if ahead < 0 or near.find(text, ahead + 1) >= 0:
                out.append(-1)
                continue
            at += ahead
        out.append(at)
        cursor = at + len(text)
    return out


#: What spans get from runs.
SEEN = {"color": "string", "bold": "boolean", "invisible": "boolean"}


def appearances(pages: list[tuple[list[str], str]], sizes: np.ndarray, color: pa.Array, flags: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(which texts are found, the last run of each, [color, *flags]) for pages of (texts, stream of paint).

    sizes, color, flags: of all pages' runs, whose texts one after the other are
    the streams.  A colour only if all runs of a text agree on it, a flag if all are.
    """
    chars = np.array([len(stream) for _, stream in pages], np.int64)
    begins = np.cumsum(chars) - chars
    at = np.array([p for texts, stream in pages for p in _places(texts, stream)], np.int64)
    length = np.array([len(t) for texts, _ in pages for t in texts], np.int64)
    found = np.flatnonzero(at >= 0)
    start = at[found] + np.repeat(begins, [len(t) for t, _ in pages])[found]
    ends = np.cumsum(sizes)
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length[found] - 1, "right")
    n = last - first + 1
    at_run = np.cumsum(n) - n
    runs = np.arange(n.sum()) - np.repeat(at_run - first, n)
    coded = color.dictionary_encode()
    code = np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64)[runs]
    over = lambda f, v: f.reduceat(v, at_run) if len(at_run) else np.zeros(0, v.dtype)
    most, least = over(np.maximum, code), over(np.minimum, np.where(code < 0, len(coded.dictionary), code))
    made = [coded.dictionary.take(pa.array(np.where(most == least, most, 0), mask=most != least)) if len(coded.dictionary) else pa.nulls(len(found), pa.string())]
    for flag in flags:
        known = np.asarray(pc.is_valid(flag))[runs]
        all_ = over(np.logical_and, np.asarray(pc.fill_null(flag, True))[runs])
        made.append(pa.array(all_, mask=~over(np.logical_or, known)))
    return found, last, made


def appearance(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, page, ord, color, bold, invisible, paint_order: what spans get from the runs that painted them.

    A colour only if all runs agree on it (null otherwise), bold and invisible
    if all are, and the latest run's number.  Spans and runs are dealt out once;
    a page's text and paint are looked at together, as in ``aligned``.
    """
    type_, step = dict(spans.dtypes)["ord"], dict(runs.dtypes)["i"]
    void = lambda names: [F.lit(None).cast({**SEEN, "ord": type_, "i": step}[c]).alias(c) for c in names]
    paint = runs.select(*PAGE, F.lit(0).alias("side"), "i", *void(["ord"]), _bare("text").alias("bare"), *SEEN)
    text = spans.select(*PAGE, F.lit(1).alias("side"), *void(["i"]), "ord", _bare("text").alias("bare"), *void(SEEN))
    rows = paint.unionByName(text).where("bare <> ''")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts in whole_rows(batches, PAGE):
            side, bare = held.column("side").to_numpy(), held.column("bare").to_pylist()
            pages = []
            for lo, hi in pairwise(np.append(starts, len(side)).tolist()):
                cut = lo + int(np.searchsorted(side[lo:hi], 1))
                pages.append((bare[cut:hi], "".join(bare[lo:cut])))
            drawn_ = held.filter(pa.array(side == 0)).combine_chunks()
            one = lambda t, c: pa.concat_arrays(t.column(c).chunks) if t.num_rows else pa.array([], t.schema.field(c).type)
            found, last, made = appearances(pages, np.asarray(pc.utf8_length(one(drawn_, "bare"))).astype(np.int64), one(drawn_, "color"), [one(drawn_, c) for c in ("bold", "invisible")])
            own = held.take(pa.array(np.flatnonzero(side == 1)[found])).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[one(own, c) for c in (*PAGE, "ord")], *made, one(drawn_, "i").take(pa.array(last))], [*PAGE, "ord", *SEEN, "paint_order"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*PAGE, "ord")], *[f"{c} {t}" for c, t in SEEN.items()], f"paint_order {step}"])
    return dealt(rows, PAGE, ["side", "i", "ord"]).mapInArrow(run, schema)


def advances(spans: DataFrame, glyphs: DataFrame, matched: DataFrame) -> DataFrame:
    """doc_id, page, ord, advances: the width of each character of a matched span, its share by the painted glyphs.

    glyphs: doc_id, page, i (run), k (order), text, width (null: 1000).  A
    glyph's width is shared by its characters; blanks of a span count 250.
    matched: of ``aligned``.  Spans with a negative share, or none above zero,
    have no row.
    """
    chars = glyphs.withColumn("n", F.char_length("text")).select(*PAGE, "i", "k", F.posexplode(F.split("text", "")).alias("c", "char"), (F.coalesce("width", F.lit(1000.0)) / F.greatest(F.lit(1), F.col("n"))).alias("weight"))
    chars = chars.where(~F.col("char").rlike(r"^\s?$"))
    chars = chars.withColumn("at", F.row_number().over(W.partitionBy(*PAGE).orderBy("i", "k", "c")) - 1).select(*PAGE, "at", "weight")
    own = spans.join(matched, [*PAGE, "ord"]).select(*PAGE, "ord", "width", "start", F.posexplode(F.split("text", "")).alias("c", "char")).where("char <> ''")
    blank = F.col("char").rlike(r"^\s$")
    before = W.partitionBy(*PAGE, "ord").orderBy("c").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("at", F.when(~blank, F.col("start") + F.coalesce(F.sum((~blank).cast("int")).over(before), F.lit(0))))
    told = own.join(chars, [*PAGE, "at"], "left").withColumn("weight", F.when(blank, 250.0).otherwise(F.coalesce("weight", F.lit(0.0))))
    held = told.groupBy(*PAGE, "ord", "width").agg(F.array_sort(F.collect_list(F.struct("c", "weight"))).alias("w"), F.sum("weight").alias("total"), F.min("weight").alias("least"))
    return held.where("total > 0 and least >= 0").select(*PAGE, "ord", F.transform("w", lambda v: v["weight"] * F.col("width") / F.col("total")).alias("advances"))


def hyphenated(spans: DataFrame, matched: DataFrame, runs: DataFrame, glyphs: DataFrame) -> DataFrame:
    """doc_id, page, ord, ratio: spans at a line's end whose run goes on with a painted soft hyphen; they read text + "-" and are wider by ratio.

    spans: ord, text, line_end, rotated, x, width, baseline, font, size.  runs:
    also mode, char_spacing, word_spacing.  glyphs: k, text, width, in_font; a
    row without text is a shift back by its width.  The run is filled or outlined
    without extra spacing, its hyphen is in the font and wider than 0, the span
    ends just before it, and from the run's start to the span spans of one font,
    size and baseline (0.1) leave nothing out, in order (0.1).  ratio: the hyphen
    to what is before it in the span, under a quarter.
    """
    tail = glyphs.withColumn("last", F.row_number().over(W.partitionBy(*PAGE, "i").orderBy(F.desc("k"))) == 1).where(F.col("last") & (F.col("text") == SOFT) & F.col("in_font") & (F.col("width") > 0))
    fit = _offsets(runs, "i").where("mode <= 2 and char_spacing = 0 and word_spacing = 0").join(tail.select(*PAGE, "i", F.col("width").alias("hyphen")), [*PAGE, "i"])
    r, s = fit.alias("r"), matched.join(spans, [*PAGE, "ord"]).alias("s")
    within = (F.col("s.doc_id") == F.col("r.doc_id")) & (F.col("s.page") == F.col("r.page")) & (F.col("s.start") >= F.col("r.from")) & (F.col("s.end") <= F.col("r.to"))
    own = s.join(r, within).select("s.*", *[F.col(f"r.{c}").alias(c) for c in ("i", "from", "to", "hyphen")])
    order = W.partitionBy(*PAGE, "i").orderBy("ord")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    even = F.coalesce((F.abs(F.col("baseline") - F.lag("baseline").over(order)) < 0.1) & (F.col("font") == F.lag("font").over(order)) & (F.col("size") == F.lag("size").over(order)) & (F.col("x") >= F.lag(F.col("x") + F.col("width")).over(order) - 0.1), F.col("start") == F.col("from"))
    known = own.withColumn("verified", F.bool_and(even & (F.coalesce(F.lag("end").over(order), F.col("from")) == F.col("start"))).over(so_far))
    ends = known.where("verified and line_end and not rotated and width > 0 and end = to - 1").select(*PAGE, "ord", "i", "text", "hyphen")
    # The glyphs of the span are the last ones that spell it; shifts among them count.
    before = W.partitionBy(*PAGE, "i").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    spelled = glyphs.withColumns({"chars": F.sum(F.char_length(F.coalesce("text", F.lit("")))).over(before), "advance": F.sum(F.when(F.col("text").isNull(), -F.col("width")).otherwise(F.col("width"))).over(before)})
    at = ends.join(spelled.where("text is not null").select(*PAGE, "i", "chars", "advance"), [*PAGE, "i"]).where(F.col("chars") == F.char_length("text") + 1)
    ratio = F.col("hyphen") / (F.col("advance") - F.col("hyphen"))
    return at.where((F.col("advance") > F.col("hyphen")) & (ratio < 0.25)).select(*PAGE, "ord", ratio.alias("ratio"))


def slant(matrix: Column) -> Column:
    """The angle of a matrix in degrees."""
    return F.atan2(matrix[1], matrix[0]) * 180 / math.pi
