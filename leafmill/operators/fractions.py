"""Stacked fractions: a bar, what stands over and under it, and a sign of equation beside it.

A span belongs to one fraction at most, and bars are served in their order.  A
page's spans and bars are dealt out once; bars that may make a fraction carry the
spans around them and are passed through in order, with what earlier ones took.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from leafmill import constants as C
from leafmill.functions import geometry as G
from leafmill.operators import lines as L
from leafmill.operators.spans import PAGE
from leafmill.shared import settled

#: Signs of an equation, and the font whose delimiters come out as other characters.
SIGNS, MATH_FONT = "[=×÷]", "(?i)CambriaMath"

BAR = [*PAGE, "bar"]


def _bars(rules: DataFrame) -> DataFrame:
    at = G.rule_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return rules.where(G.horizontal(F.col("y1"), F.col("y2"))).select(*PAGE, F.col("ord").alias("bar"), at.x.alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), at.width.alias("width"), F.lit(0.0).alias("height"))


def _next_to(s: Column, size: Column) -> Column:
    """On the bar's height and next to one of its ends, for a numerator of ``size``."""
    right = s["x"] + s["width"]
    left = (right <= F.col("bx") + 2) & (F.col("bx") - right < 2 * size)
    return (F.abs(s["baseline"] - F.col("by")) < 0.5 * size) & (left | ((s["x"] >= F.col("be") - 2) & (s["x"] - F.col("be") < size)))


def _candidates(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars (bx, be, by) that may make a fraction, with the native spans over and under them and those beside that are signs or delimiters.

    Spans and bars are dealt out once by page; a bar sees the spans near its height
    through a window.  A bar without both sides, or without a sign for the largest
    numerator, takes nothing and stands in nobody's way.
    """
    # What is alike from span to span comes first, so that it takes no room in the shuffle.
    own = ["height", "size", "math", *(["line_id"] if "line_id" in spans.columns else []), "ord", "x", "width", "y", "baseline", "text"]
    spans = spans.withColumn("math", F.coalesce(F.col("font").rlike(MATH_FONT), F.lit(False)))
    types = dict(spans.dtypes)
    native = spans.where((F.col("source") == "pdf") & (F.trim("text") != "")).select(*PAGE, F.lit(None).cast(dict(bars.dtypes)["bar"]).alias("bar"), *own)
    drawn = bars.select(*PAGE, "bar", *[F.col({"baseline": "y"}.get(c, c)).alias(c) if c in ("x", "width", "baseline") else F.lit(None).cast(types[c]).alias(c) for c in own])
    page = ["_group", *PAGE]
    rows = native.unionByName(drawn).where("doc_id is not null and page is not null").withColumn("_group", F.xxhash64(*PAGE)).repartition("_group")
    rows = rows.withColumn("_m", F.max("size").over(W.partitionBy(*page))).where("_m > 0")
    # Whole thousandths of the reach, so that the frame holds all that is exactly within it.
    rows = rows.withColumn("_z", F.floor(1000 * F.col("baseline") / (1.8 * F.col("_m"))))
    near = F.collect_list(F.when(F.col("bar").isNull(), F.struct(*own))).over(W.partitionBy(*page).orderBy("_z").rangeBetween(-1001, 1001))
    at = rows.withColumn("near", near).where("bar is not null").select(*page, "bar", "_m", F.col("x").alias("bx"), (F.col("x") + F.col("width")).alias("be"), F.col("baseline").alias("by"), "near")
    by = F.col("by")
    low = lambda s: s["baseline"] - 1.8 * F.col("_m")
    at = at.withColumn("near", F.filter("near", lambda s: (low(s) <= by) & (by <= low(s) + 3.6 * F.col("_m"))))
    within = lambda s: (s["x"] >= F.col("bx") - 2) & (s["x"] + s["width"] <= F.col("be") + 2)
    over = lambda s: (s["baseline"] <= by - 0.3 * s["size"]) & (s["baseline"] >= by - 1.8 * s["size"])
    under = lambda s: (s["y"] >= by - 1) & (s["baseline"] > by + 0.3 * s["size"]) & (s["baseline"] <= by + 1.8 * s["size"])
    at = at.withColumns({"n": F.filter("near", lambda s: within(s) & over(s)), "d": F.filter("near", lambda s: within(s) & ~over(s) & under(s))}).where("size(n) > 0 and size(d) > 0")
    at = at.withColumn("beside", F.filter("near", lambda s: (s["x"] + s["width"] <= F.col("bx") + 2) | (s["x"] >= F.col("be") - 2))).drop("near", "_m")
    most = F.array_max(F.transform("n", lambda s: s["size"]))
    at = at.where(F.exists("beside", lambda s: s["text"].rlike(SIGNS) & _next_to(s, most)))
    mended = lambda s, like, pattern, to: F.when(s["math"] & s["text"].rlike(like), F.regexp_replace(s["text"], pattern, to))
    beside = F.transform("beside", lambda s: F.struct(s["ord"].alias("ord"), s["x"].alias("x"), (s["x"] + s["width"]).alias("right"), s["baseline"].alias("baseline"), s["text"].rlike(SIGNS).alias("sign"), mended(s, r"×\s*&$", "&$", "(").alias("opens"), mended(s, "^'", "^'", ")").alias("closes")))
    sums = F.transform("n", lambda s: F.struct(mended(s, r"^∑\+", r"^∑\+", "∑(").alias("opens"), mended(s, ",$", ",$", ")").alias("closes")))
    sums = F.transform(sums, lambda s: F.struct(s["opens"].alias("opens"), s["closes"].alias("closes"), F.when(s["closes"].isNotNull(), F.regexp_replace(s["opens"], ",$", ")")).alias("both")))
    at = at.withColumns({"beside": F.filter(beside, lambda s: s["sign"] | s["opens"].isNotNull() | s["closes"].isNotNull()), "sums": sums})
    return at.sortWithinPartitions(*page, "bar").drop("_group")


class _Page:
    """What the bars of a page take, which come in their order."""

    def __init__(self):
        self.taken, self.texts = set(), {}

    def __call__(self, bx: float, be: float, by: float, over: list[dict], under: list[dict], beside: list[dict], sums: list[dict]) -> tuple | None:
        """(size, ords taken, [(ord, text)] mended by this bar, [(ord, text)] of its parts as mended so far), or None if it is no fraction."""
        sides = [[s for s in side if s["ord"] not in self.taken] for side in (over, under)]
        if not all(sides):
            return None
        size = min(sides[0], key=lambda s: s["ord"])["size"]
        ends = [(min(s["x"] for s in side), max(s["x"] + s["width"] for s in side)) for side in sides]
        if max(abs((a + z) / 2 - (bx + be) / 2) for a, z in ends) > max(3.0, 0.5 * size):
            return None
        close = [s for s in beside if abs(s["baseline"] - by) < 0.5 * size and ((s["right"] <= bx + 2 and bx - s["right"] < 2 * size) or (s["x"] >= be - 2 and s["x"] - be < size))]
        if not any(s["sign"] for s in close):
            return None
        # Two lines on one side are no part of a fraction; one span is one line.
        for side in sides:
            rows = L.Rows()
            if len(side) > 1 and any(rows(s["baseline"], s["size"], s.get("line_id")) for s in sorted(side, key=lambda s: (s["baseline"], s["x"], s["ord"]))):
                return None
        ords = [s["ord"] for side in sides for s in side]
        self.taken.update(ords)
        # Around it a span that ends with × & and one that begins with ', the first of
        # each; over it a first span that begins with ∑+ and a last one that ends with a
        # comma.  Each only as a pair.
        mended = []
        first = [min(((s["ord"], s[c]) for s in close if s[c] is not None), default=None) for c in ("opens", "closes")]
        if all(first):
            mended += first
        told = [(s["x"], s["ord"], m) for s, m in zip(over, sums, strict=True) if s["ord"] in set(ords)]
        (_, a, p), (_, z, q) = min(told, key=lambda t: t[:2]), max(told, key=lambda t: (t[0], -t[1]))
        if p["opens"] is not None and q["closes"] is not None:
            mended += [(a, p["both"])] if a == z else [(a, p["opens"]), (z, q["closes"])]
        self.texts.update(mended)
        return size, ords, mended, [(o, self.texts[o]) for o in ords if o in self.texts]


def _served(candidates: DataFrame, ord_type: str) -> DataFrame:
    """Candidates that are fractions, with size, taken, mended and now: each bar in its turn takes what earlier ones of its page left."""
    ord_ = pa.int64() if ord_type == "bigint" else pa.int32()
    pair = pa.list_(pa.struct([("ord", ord_), ("text", pa.string())]))
    kept = [c for c in candidates.columns if c not in ("beside", "sums")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, page = None, None
        for batch in batches:
            rows, made = [], []
            values = [batch.column(c).to_pylist() for c in (*PAGE, "bx", "be", "by", "n", "d", "beside", "sums")]
            for i, (doc, number, *v) in enumerate(zip(*values, strict=True)):
                if page is None or (doc, number) != at:
                    at, page = (doc, number), _Page()
                if (got := page(*v)) is not None:
                    rows.append(i)
                    made.append(got)
            held = batch.take(pa.array(rows, pa.int64()))
            pairs = lambda k: pa.array([[{"ord": o, "text": t} for o, t in m[k]] for m in made], pair)  # noqa: E731, B023
            new = [pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.list_(ord_)), pairs(2), pairs(3)]
            yield pa.RecordBatch.from_arrays([*[held.column(c) for c in kept], *new], [*kept, "size", "taken", "mended", "now"])

    texts = ArrayType(StructType([StructField("ord", LongType() if ord_type == "bigint" else IntegerType()), StructField("text", StringType())]))
    more = [StructField("size", DoubleType()), StructField("taken", ArrayType(texts.elementType["ord"].dataType)), StructField("mended", texts), StructField("now", texts)]
    return candidates.mapInArrow(run, StructType([*[f for f in candidates.schema.fields if f.name in kept], *more]))


def _mended(text: str, like: str, pattern: str, to: str) -> str | None:
    return re.sub(pattern, to, text) if re.search(like, text) else None


def _read(side: list[dict], texts: dict) -> str:
    """As ``lines._text``, with texts as mended."""
    out, end, last = "", None, 0.0
    for s in sorted(side, key=lambda s: (s["x"], s["ord"])):
        text = texts.get(s["ord"], s["text"])
        if end is not None:
            gap, small = s["x"] - end, min(last, s["size"])
            if gap > max(C.GAP_MIN, C.GAP_SHARE * small):
                out += "\t"
            elif gap > C.SPACE_SHARE * small and out and not out.endswith(" ") and not text.startswith(" "):
                out += " "
        out, end, last = out + text, s["x"] + s["width"], s["size"]
    return out


def stacked(of: np.ndarray, span: dict[str, np.ndarray], text: pa.Array, math: np.ndarray, at: np.ndarray, bar: dict[str, np.ndarray]) -> list[tuple]:
    """(bar, size, numerator, denominator) of the fractions of many pages, as ``fractions`` finds them.

    of: the page of each span, counted from 0; span: ord, x, y, width, baseline, size
    of native spans with text; math: in a mathematical font.  at: the page of each
    bar, which come by page and in their order; bar: x, end, y.  Bars meet the spans
    near their height, and only those with both sides and a sign are served one by one.
    """
    if not len(of) or not len(at):
        return []
    x, y, base, size = (span[c] for c in ("x", "y", "baseline", "size"))
    right, sign = x + span["width"], np.asarray(pc.match_substring_regex(text, SIGNS))
    most = np.zeros(max(of.max(), at.max()) + 1)
    np.maximum.at(most, of, size)
    least = min(base.min(), bar["y"].min())
    page = max(base.max(), bar["y"].max()) - least + 4 * most.max() + 1
    order = np.lexsort((base, of))
    key, middle, reach = (of * page + (base - least))[order], at * page + (bar["y"] - least), 1.8 * most[at] + 0.001
    lo, hi = np.searchsorted(key, middle - reach, "left"), np.searchsorted(key, middle + reach, "right")
    n = hi - lo
    b = np.repeat(np.arange(len(at)), n)
    s = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)]
    bx, be, by, m = bar["x"][b], bar["end"][b], bar["y"][b], most[at][b]
    low = base[s] - 1.8 * m
    near = (of[s] == at[b]) & (m > 0) & (low <= by) & (by <= low + 3.6 * m)
    within = near & (x[s] >= bx - 2) & (right[s] <= be + 2)
    over = within & (base[s] <= by - 0.3 * size[s]) & (base[s] >= by - 1.8 * size[s])
    under = within & ~over & (y[s] >= by - 1) & (base[s] > by + 0.3 * size[s]) & (base[s] <= by + 1.8 * size[s])
    largest = np.zeros(len(at))
    np.maximum.at(largest, b[over], size[s[over]])
    top = largest[b]
    beside = near & ((right[s] <= bx + 2) | (x[s] >= be - 2))
    told = beside & sign[s] & (np.abs(base[s] - by) < 0.5 * top) & (((right[s] <= bx + 2) & (bx - right[s] < 2 * top)) | ((x[s] >= be - 2) & (x[s] - be < top)))
    some = lambda mask: np.bincount(b[mask], minlength=len(at)) > 0
    good = some(over) & some(under) & some(told)
    marks = beside & (sign | math)[s]
    # Bars with one span on each side that no other bar reaches for, and nothing to mend, need no turn.
    part = (over | under) & good[b]
    alone = np.bincount(s[part], minlength=len(of)) == 1
    busy = np.bincount(b[part & ~alone[s] | (part | marks) & math[s]], minlength=len(at)) > 0
    single = good & ~busy & (np.bincount(b[over], minlength=len(at)) == 1) & (np.bincount(b[under], minlength=len(at)) == 1)
    up, down = (s[mask & single[b]] for mask in (over, under))
    own = np.flatnonzero(single)
    off = lambda v: np.abs((x[v] + right[v]) / 2 - (bar["x"][own] + bar["end"][own]) / 2)
    fit = np.maximum(off(up), off(down)) <= np.maximum(3.0, 0.5 * size[up])
    out = list(zip(own[fit].tolist(), size[up[fit]].tolist(), *[text.take(pa.array(v[fit])).to_pylist() for v in (up, down)], strict=True))
    good &= ~single
    keep = np.flatnonzero(good[b] & (over | under | marks))
    used, which = np.unique(s[keep], return_inverse=True)
    values = zip(*[v[used].tolist() for v in (span["ord"], x, right, span["width"], y, base, size, sign, math)], text.take(pa.array(used)).to_pylist(), strict=True)
    none = {"opens": None, "closes": None, "both": None}
    spans = [
        {"ord": o, "x": l_, "right": r, "width": w, "y": t, "baseline": v, "size": z, "sign": g, "text": c, "opens": _mended(c, r"×\s*&$", "&$", "(") if f else None, "closes": _mended(c, "^'", "^'", ")") if f else None, "math": f}
        for o, l_, r, w, t, v, z, g, f, c in values
    ]

    def sums(d: dict) -> dict:
        if not d["math"]:
            return none
        opens, closes = _mended(d["text"], r"^∑\+", r"^∑\+", "∑("), _mended(d["text"], ",$", ",$", ")")
        return {"opens": opens, "closes": closes, "both": re.sub(",$", ")", opens) if opens is not None and closes is not None else None}

    number, state = None, None
    starts = np.flatnonzero(np.append(True, b[keep][1:] != b[keep][:-1])) if len(keep) else np.zeros(0, np.int64)
    bars = b[keep][starts]
    which, role = which.tolist(), (over[keep] * 1 + under[keep] * 2 + marks[keep] * 4).tolist()
    for k, p, i, j, *v in zip(bars.tolist(), at[bars].tolist(), starts.tolist(), np.append(starts[1:], len(keep)).tolist(), *[bar[c][bars].tolist() for c in ("x", "end", "y")], strict=True):
        if p != number:
            number, state = p, _Page()
        n_, d_, m_ = ([spans[w] for w, r in zip(which[i:j], role[i:j], strict=True) if r & f] for f in (1, 2, 4))
        m_ = [x_ for x_ in m_ if x_["sign"] or x_["opens"] is not None or x_["closes"] is not None]
        if (got := state(*v, n_, d_, m_, [sums(x_) for x_ in n_])) is not None:
            taken, now = set(got[1]), dict(got[3])
            out.append((k, got[0], *[_read([x_ for x_ in side if x_["ord"] in taken], now) for side in (n_, d_)]))
    return out


def fractions(spans: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fractions, members, texts) of native pages.

    spans: ord, text, x, y, width, height, baseline, size, source, font.  rules:
    ord (their order), x1, y1, x2, y2.

    A level rule is a bar if free spans within its ends (2 pt) stand over it
    (baseline 0.3 to 1.8 sizes above) and under it (top at most 1 pt above,
    baseline 0.3 to 1.8 sizes below), each side one line and centred within 3 pt
    or half a size, and a span with = × or ÷ stands on its height next to it.

    fractions: doc_id, page, bar, ord and size (of the first numerator span), numerator,
    denominator, text, box, baseline.  members: doc_id, page, bar, ord, role (n, d).
    texts: doc_id, page, ord, text of other spans whose delimiters were mended (a
    mathematical font writes them as & and ').
    """
    found = settled(_served(_candidates(spans, _bars(rules)), dict(spans.dtypes)["ord"]))
    mine = lambda r: F.filter(r, lambda s: F.array_contains("taken", s["ord"]))
    # A part reads as mended by its own or an earlier bar.
    now = lambda s: F.coalesce(F.get(F.filter("now", lambda t: t["ord"] == s["ord"]), F.lit(0))["text"], s["text"])
    known = found.withColumns({"n": mine("n"), "d": mine("d")})
    listed = lambda r: L._text(F.array_sort(F.transform(r, lambda s: F.struct(s["x"].alias("x"), s["ord"].alias("ord"), s["width"].alias("width"), s["size"].alias("size"), now(s).alias("text")))))
    parts = F.concat("n", "d")
    top, bottom = F.array_min(F.transform(parts, lambda s: s["y"])), F.array_max(F.transform(parts, lambda s: s["y"] + s["height"]))
    held = known.select(*BAR, F.array_min(F.transform("n", lambda s: s["ord"])).alias("ord"), "size", listed("n").alias("numerator"), listed("d").alias("denominator"), "bx", "be", "by", top.alias("y"), (bottom - top).alias("height"))
    out = held.select(
        *BAR, "ord", "size", "numerator", "denominator", F.concat_ws("/", "numerator", "denominator").alias("text"), F.col("bx").alias("x"), "y", (F.col("be") - F.col("bx")).alias("width"), "height",
        (F.col("by") + 0.3 * F.col("size")).alias("baseline"),
    )
    role = lambda r: F.transform(r, lambda s: F.struct(s["ord"].alias("ord"), F.lit(r).alias("role")))
    members = known.select(*BAR, F.explode(F.concat(role("n"), role("d"))).alias("s")).select(*BAR, "s.ord", "s.role")
    mended = found.select(*BAR, F.explode("mended").alias("s")).select(*BAR, "s.ord", "s.text")
    last = mended.groupBy(*PAGE, "ord").agg(F.max_by("text", "bar").alias("text"))
    return out, members, last.join(members.select(*PAGE, "ord"), [*PAGE, "ord"], "left_anti")


def with_fractions(spans: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, bars): spans with each fraction as one span in place of its parts, with numerator and denominator; the rules (ord) that are bars."""
    made, members, texts = fractions(spans, rules)
    free = spans.join(members.select(*PAGE, "ord").distinct(), [*PAGE, "ord"], "left_anti").join(texts.withColumnRenamed("text", "_t"), [*PAGE, "ord"], "left")
    free = free.withColumn("text", F.coalesce("_t", "text")).drop("_t").withColumns({c: F.lit(None).cast("string") for c in ("numerator", "denominator")})
    own = ["x", "y", "width", "height", "text", "baseline"]
    rest = spans.drop(*own)
    stacked = rest.join(made.select(*PAGE, "ord", *own, "numerator", "denominator"), [*PAGE, "ord"]).select(*free.columns)
    return free.unionByName(stacked), made.select(*PAGE, F.col("bar").alias("ord"))
