"""Lines, runs and paragraphs.

What depends on the order of spans (which open row takes one, where a row is cut,
whether a line closes the open paragraph) are folds over sorted rows: a page's
spans are dealt out once and come out as lines.  Attributes of paragraphs are
windows and aggregates over lines.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import deque
from collections.abc import Iterator
from itertools import repeat
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leafmill import constants as C
from leafmill.functions import geometry as G
from leafmill.functions.text import join_separator, line_marker
from leafmill.operators.folds import changes, dealt, folded, whole_rows
from leafmill.operators.spans import PAGE


class Rows:
    """Row of each span of a page, which come by baseline, x and ord: the first of the four newest rows on whose typical baseline it stands."""

    def __init__(self):
        self.rows: deque[list] = deque(maxlen=C.ROWS_BACK)  # number, baselines, largest size and its baseline, one size only, line ids
        self.n, self.before = 0, (None, None, None)

    def __call__(self, base: float, size: float, line: object) -> int:
        # Rows that did not take a span like this one just now have not changed since.
        same = line is None and self.before[:2] == (base, size)
        for row in self.rows:
            number, baselines, largest, at, even, ids = row
            if same and number < self.before[2]:
                continue
            typical = (baselines[(len(baselines) - 1) // 2] + baselines[len(baselines) // 2]) / 2 if even and abs(size - largest) < 0.01 else at
            if (line is not None and line in ids) or abs(typical - base) <= max(C.BASELINE_MIN, C.BASELINE_SHARE * min(largest, size)):
                break
        else:
            row = [self.n, [], size, base, True, set()]
            self.n += 1
            self.rows.append(row)
        insort(row[1], base)
        if line is not None:
            row[5].add(line)
        if size > row[2]:
            row[2], row[3] = size, base
        row[4] = row[4] and abs(size - row[2]) < 0.01
        self.before = (base, size, row[0]) if line is None else (None, None, None)
        return row[0]

    def more(self, number: int, base: float, n: int) -> None:
        """n more spans like the one before, which went to row ``number``."""
        baselines = next(row[1] for row in self.rows if row[0] == number)
        at = bisect(baselines, base)
        baselines[at:at] = [base] * n


class _Numbered:
    """Rows of the spans of sorted batches.

    Where two like neighbours (baseline and size) took one row, so do all that
    follow them: that row's median only comes nearer, and older rows have not changed.
    """

    def __init__(self, by: list[str], told: bool):
        self.by, self.told, self.at, self.step = by, told, None, None

    def __call__(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        n = batch.num_rows
        new, like = np.zeros(n, bool), np.ones(n, bool)
        new[changes(batch, self.by)] = True
        new[0] = self.step is None or [batch.column(c)[0].as_py() for c in self.by] != self.at
        self.at = [batch.column(c)[-1].as_py() for c in self.by]
        like[changes(batch, ["baseline", "size"])] = False
        starts = np.flatnonzero(new | ~like | (np.arange(n) == 0)) if not self.told else np.arange(n)
        lines_ = batch.column("line_id").to_pylist() if self.told else repeat(None)
        pick = pa.array(starts)
        out = np.empty(n, np.int64)
        ends = np.append(starts[1:], n)
        for at, end, fresh, base, size, line in zip(starts.tolist(), ends.tolist(), new[starts].tolist(), batch.column("baseline").take(pick).to_pylist(), batch.column("size").take(pick).to_pylist(), lines_):
            if fresh:
                self.step = Rows()
            row = out[at] = self.step(base, size, line)
            while (at := at + 1) < end:
                before, row = row, self.step(base, size, None)
                if row == before:
                    self.step.more(row, base, end - at - 1)
                    out[at:end] = row
                    break
                out[at] = row
        return out


def rows_of(spans: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """spans with the column row, numbered from the top of each page (or of each part of one, by more keys).

    One pass over sorted spans, with all their columns: nothing is joined back
    and no page is held.
    """
    told = "line_id" in spans.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbered(by, told)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number(batch))], [*batch.schema.names, "row"])

    schema = StructType([*spans.schema.fields, StructField("row", LongType())])
    return dealt(spans, by, ["baseline", "x", "ord"]).mapInArrow(run, schema)


def script_pair(a: str, b: str) -> Column:
    """Whether two native spans (aliases) are a word and its raised or lowered mark: sizes, shift and gap fit."""
    size = {k: F.col(f"{k}.size") for k in (a, b)}
    first_small = size[a] < size[b]
    pick = {c: (F.when(first_small, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")), F.when(first_small, F.col(f"{b}.{c}")).otherwise(F.col(f"{a}.{c}"))) for c in ("size", "baseline", "height", "width", "text")}
    small, large = ({c: v[k] for c, v in pick.items()} for k in (0, 1))
    shift = F.abs(small["baseline"] - large["baseline"])
    p, q = G.box(a), G.box(b)
    return (
        (F.col(f"{a}.source") == "pdf") & (F.col(f"{b}.source") == "pdf") & (small["size"] <= 0.82 * large["size"]) & (~large["text"].rlike(r"\p{L}") | (small["width"] <= 2 * large["size"]))
        & (shift >= 0.18 * large["size"]) & (shift <= 0.65 * large["size"]) & (F.least(p.bottom, q.bottom) - F.greatest(p.y, q.y) >= 0.3 * small["height"]) & (F.greatest(p.x, q.x) - F.least(p.right, q.right) <= 0.75 * large["size"])
    )


def fragment_pair(a: str, b: str) -> Column:
    """Whether two OCR spans (aliases) are a word and a thin mark inside its height, three characters at most."""
    p, q = G.box(a), G.box(b)
    first_small = p.height < q.height
    small = {c: F.when(first_small, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")) for c in ("height", "width", "text")}
    large = {c: F.when(first_small, F.col(f"{b}.{c}")).otherwise(F.col(f"{a}.{c}")) for c in ("height", "size")}
    return (
        (F.col(f"{a}.source") == "ocr") & (F.col(f"{b}.source") == "ocr") & (small["height"] <= 0.55 * large["height"]) & (F.char_length(small["text"]) <= 3) & (small["width"] <= 2 * large["size"])
        & (F.least(p.bottom, q.bottom) - F.greatest(p.y, q.y) >= 0.5 * small["height"]) & (F.greatest(p.x, q.x) - F.least(p.right, q.right) <= 1.5 * large["size"])
    )


def aligned_fields(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, aligned: whether groups of rows (row, ord, x, width, baseline, size, text, source) are fields in columns.

    Three rows and more of the same three spans and more, close under each
    other, a size apart, and in each column one edge (left, middle or right)
    within half a point of the first row's in all rows.
    """
    line = W.partitionBy(*by, "row")
    across = line.orderBy("x", "ord")
    known = rows.withColumns({"column": F.row_number().over(across), "line": F.percentile("baseline", F.lit(0.5)).over(line), "typical": F.percentile("size", F.lit(0.5)).over(line), "gap": F.col("x") - F.lag(F.col("x") + F.col("width")).over(across)})
    plain = (
        (F.col("source") == "pdf") & (F.trim("text") != "") & ~F.col("text").rlike(r"[\p{Sm}\p{IsArabic}\p{IsHebrew}]") & (F.abs(F.col("baseline") - F.col("line")) < 0.5)
        & (F.abs(F.col("size") - F.col("typical")) < 0.1) & F.coalesce(F.col("gap") >= F.col("typical"), F.lit(True))
    )
    first = W.partitionBy(*by, "column").orderBy("row")
    near = {f"e{k}": F.abs(F.col("x") + F.col("width") * k / 2 - F.first(F.col("x") + F.col("width") * k / 2).over(first)) < 0.5 for k in range(3)}
    fields = known.withColumns({"plain": plain, **near})
    columns = fields.groupBy(*by, "column").agg(F.bool_and("plain").alias("plain"), (F.bool_and("e0") | F.bool_and("e1") | F.bool_and("e2")).alias("edge"))
    columns = columns.groupBy(*by).agg(F.bool_and(F.col("plain") & F.col("edge")).alias("fits"))
    lines_ = known.groupBy(*by, "row").agg(F.count("*").alias("n"), F.max("line").alias("line"), F.max("typical").alias("typical"))
    step = F.col("line") - F.lag("line").over(W.partitionBy(*by).orderBy("row"))
    held = lines_.withColumn("step", step).groupBy(*by).agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.bool_and(F.coalesce((F.col("step") > 0) & (F.col("step") <= 2 * F.col("typical")), F.lit(True))).alias("close"))
    return held.join(columns, by).select(*by, ((F.col("rows") >= 3) & (F.col("least") >= 3) & (F.col("least") == F.col("most")) & F.col("close") & F.col("fits")).alias("aligned"))


def split_at_gaps(rows: DataFrame, join_wide_gaps: bool = False) -> DataFrame:
    """rows with the column part: a row is cut where a gap is wider than a tab."""
    w = W.partitionBy(*PAGE, "row").orderBy("x", "ord")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    wide = gap > F.greatest(F.lit(C.GAP_MIN), C.GAP_SHARE * F.least(F.lag("size").over(w), F.col("size")))
    cut = F.lit(0) if join_wide_gaps else F.coalesce(wide.cast("int"), F.lit(0))
    marked = rows.withColumn("_cut", cut)
    return marked.withColumn("part", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")


#: What is measured of spans and lines.
PLACE = ["x", "y", "width", "height", "size", "baseline"]


def lines(spans: DataFrame, join_wide_gaps: bool = False, together: bool = False) -> DataFrame:
    """doc_id, page, row, part, x, y, width, height, size, baseline, text, n: the lines of a page.

    Size and baseline are medians over members of at least 85 % of the largest size.
    Pages are passed through many at a time.  together: a page's spans already
    follow each other in one partition; nothing is dealt out then.
    """
    told = ["line_id"] if "line_id" in spans.columns else []
    rows = spans.select(*PAGE, "ord", "text", "x", "y", "width", "height", "baseline", "size", *told)
    types = dict(rows.dtypes)
    return (rows if together else dealt(rows, PAGE, ["baseline", "x", "ord"])).mapInArrow(lambda batches: lines_of(batches, join_wide_gaps), line_schema(types))


def line_schema(types: dict[str, str]) -> str:
    return ", ".join([*[f"{c} {types[c]}" for c in PAGE], "row bigint", "part bigint", *[f"{c} double" for c in PLACE], "text string", "n bigint"])


def lines_of(batches: Iterator[pa.RecordBatch], join_wide_gaps: bool = False) -> Iterator[pa.RecordBatch]:
    """``lines`` of spans whose pages follow each other."""
    for held, starts in whole_rows(batches, PAGE):
        page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, held.num_rows)))
        value = {c: held.column(c).to_numpy().astype(float) for c in PLACE} | {"ord": held.column("ord").to_numpy()}
        held, page, value = _sorted(held, page, value, [value["ord"], value["x"], value["baseline"], page])
        row = _Numbered(PAGE, "line_id" in held.schema.names)(held)
        held, page, value, row = _sorted(held, page, value, [value["ord"], value["x"], row, page], row)
        yield _lines(held, page, row, value, join_wide_gaps)


def _lines(held: pa.Table, page: np.ndarray, row: np.ndarray, value: dict[str, np.ndarray], join_wide_gaps: bool) -> pa.RecordBatch:
    x, width, size = (value[c] for c in ("x", "width", "size"))
    n = len(page)
    gap, small = x[1:] - (x + width)[:-1], np.minimum(size[1:], size[:-1])
    tab = gap > np.maximum(C.GAP_MIN, C.GAP_SHARE * small)
    new_row = (page[1:] != page[:-1]) | (row[1:] != row[:-1])
    cut = new_row if join_wide_gaps else new_row | tab
    first = np.flatnonzero(np.append(True, cut))
    ends = np.append(first[1:], n)
    of = np.repeat(np.arange(len(first)), ends - first)
    # Parts count from 0 in each row.
    opens = np.append(True, new_row)[first]
    part = np.arange(len(first)) - np.maximum.accumulate(np.where(opens, np.arange(len(first)), 0))
    left, top = np.minimum.reduceat(x, first), np.minimum.reduceat(value["y"], first)
    right, bottom = np.maximum.reduceat(x + width, first), np.maximum.reduceat(value["y"] + value["height"], first)
    main = size >= C.MAIN_SIZE_SHARE * np.maximum.reduceat(size, first)[of]
    medians = [_medians(value[c], main, first, ends) for c in ("size", "baseline")]
    texts = _joined(held.column("text"), first, np.append(False, tab & ~cut), np.append(False, ~cut & (gap > C.SPACE_SHARE * small)))
    pick = pa.array(first)
    made = [*[held.column(c).take(pick).combine_chunks() for c in PAGE], pa.array(row[first]), pa.array(part), *[pa.array(v) for v in (left, top, right - left, bottom - top, *medians)], texts, pa.array(ends - first)]
    return pa.RecordBatch.from_arrays([m if isinstance(m, pa.Array) else m.chunk(0) for m in made], [*PAGE, "row", "part", *PLACE, "text", "n"])


def _sorted(held: pa.Table, page: np.ndarray, value: dict[str, np.ndarray], keys: list[np.ndarray], *more: np.ndarray) -> tuple:
    """held, page, value and more sorted by keys, of which the last counts most; as they are if they are sorted already."""
    after, level = np.zeros(len(page) - 1, bool), np.ones(len(page) - 1, bool)
    for k in reversed(keys):
        after |= level & (k[1:] < k[:-1])
        level &= k[1:] == k[:-1]
    if after.any():
        order = np.lexsort(keys)
        held, page, value, more = held.take(pa.array(order)).combine_chunks(), page[order], {c: v[order] for c, v in value.items()}, [m[order] for m in more]
    return held, page, value, *more


def _medians(values: np.ndarray, main: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The median of the main values of each line."""
    least, most = np.minimum.reduceat(np.where(main, values, np.inf), first), np.maximum.reduceat(np.where(main, values, -np.inf), first)
    for k in np.flatnonzero(least != most).tolist():
        own = slice(first[k], ends[k])
        least[k] = median(values[own][main[own]].tolist())
    return least


def _joined(text: pa.Array | pa.ChunkedArray, first: np.ndarray, tab: np.ndarray, gap: np.ndarray) -> pa.Array:
    """The text of each line: a tab or a space goes before a span where tab or gap say so; blanks at hand count as the space.

    An empty span has no last character of its own, what is before it counts.
    """
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks == 1 else pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    n = len(text)
    starts, blank = np.asarray(pc.starts_with(text, " ")), np.asarray(pc.ends_with(text, " "))
    empty = np.asarray(pc.equal(text, ""))
    space = gap & ~tab & ~starts & ~np.append(False, blank[:-1])
    opens = np.zeros(n, bool)
    opens[first] = True
    # After an empty span it hangs on what was written before it.
    for k in np.flatnonzero(np.append(False, empty[:-1]) & gap & ~tab & ~starts).tolist():
        j = k - 1
        while empty[j] and not (tab[j] or space[j] or opens[j]):
            j -= 1
        space[k] = not tab[j] and not space[j] and not opens[j] if empty[j] else not blank[j]
        if empty[j] and tab[j]:
            space[k] = True
    marked = pc.binary_join_element_wise(pa.array(["", " ", "\t"]).take(pa.array(np.where(tab, 2, space.astype(np.int8)).astype(np.int8))), text, "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, n).astype(np.int32)), marked), "")


def _text(spans: Column) -> Column:
    """Texts of sorted spans; a gap over 16 % of the smaller size reads as a space, one wider than a tab as a tab."""
    start = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("double").alias("size"))

    def step(a: Column, s: Column) -> Column:
        gap, small = s["x"] - a["end"], F.least(a["size"], s["size"])
        blank = a["t"].endswith(" ") | s["text"].startswith(" ") | (a["t"] == "")
        mark = F.when(a["end"].isNull(), "").when(gap > F.greatest(F.lit(C.GAP_MIN), C.GAP_SHARE * small), "\t").when((gap > C.SPACE_SHARE * small) & ~blank, " ").otherwise("")
        return F.struct(F.concat(a["t"], mark, s["text"]).alias("t"), (s["x"] + s["width"]).alias("end"), s["size"].alias("size"))

    return F.aggregate(spans, start, step, lambda a: a["t"])


def runs(parts: DataFrame, style: list[str]) -> DataFrame:
    """Neighbouring spans of one style (size within 0.1) as one run: doc_id, page, row, part, run, text, x, width."""
    w = W.partitionBy(*PAGE, "row", "part").orderBy("x", "ord")
    same = F.abs(F.lag("size").over(w) - F.col("size")) <= 0.1
    for c in style:
        same &= F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = parts.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    held = marked.groupBy(*PAGE, "row", "part", "run").agg(F.array_sort(F.collect_list(F.struct("x", "ord", "width", "size", "text"))).alias("s"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"))
    return held.select(*PAGE, "row", "part", "run", _text(F.col("s")).alias("text"), "x", "width")


ENDS = r"[。！？.!?:：;；]$"


class Open:
    """The paragraph that is open while a page's lines come down it: its sizes in order, where it begins, and whether it is a list."""

    def __init__(self):
        self.number, self.sizes, self.x, self.listed = -1, [], 0.0, False

    def ends(self, v: dict) -> bool:
        """Whether a line can't go on with it, by what is measured against its typical size."""
        ref = float(np.median(self.sizes))
        beyond = v["x"] - self.x
        hangs = self.listed and 0 <= beyond <= C.HANGING * ref
        spaced = not C.GAP_TIGHT * ref <= v["gap"] <= C.GAP_WIDE * ref
        indented = v["indent"] > C.INDENT * ref and v["margin"] < 0.5 * ref
        return spaced or abs(v["size"] - ref) > C.SIZE_CHANGE * ref or (self.listed and beyond < -0.5 * ref) or (not hangs and (indented or v["jump"] > C.JUMP * ref))

    def __call__(self, v: dict) -> tuple[int]:
        if v["new"] or self.ends(v):
            self.number, self.sizes, self.x, self.listed = self.number + 1, [], v["x"], v["listed"]
        insort(self.sizes, v["size"])
        return (self.number,)


#: A page, and the hash by which it was dealt out: windows over both need no exchange of their own.
GROUP = ["_group", *PAGE]


def _paged(lines_: DataFrame) -> DataFrame:
    return lines_.withColumn("_group", F.xxhash64(*PAGE)).repartition("_group")


def broken(lines_: DataFrame) -> DataFrame:
    """lines_ (with body, the page's text size) with paragraph, numbered down the page.

    Windows tell what two neighbouring lines decide: another paragraph_id (where
    that column exists), a list or article marker, an article or a larger line
    before, a short line that ends a sentence.  The rest depends on the open
    paragraph: leading, size, indents, leaving a list.
    """
    named = lines_.columns
    lines_ = lines_ if "_group" in named else _paged(lines_)
    page = W.partitionBy(*GROUP)
    down = page.orderBy("y", "x", "row", "part")
    before = {c: F.lag(c).over(down) for c in ("baseline", "size", "width", "x", "text", *(["paragraph_id"] if "paragraph_id" in lines_.columns else []))}
    left = F.min("x").over(page)
    wide = F.max(F.col("x") + F.col("width")).over(page) - left
    marker = line_marker(F.col("text"))
    new = before["size"].isNull() | marker.isNotNull() | (line_marker(before["text"]) == "article") | (before["size"] > C.HEADING * F.col("body")) | ((before["width"] < C.SHORT_LINE * wide) & F.trim(before["text"]).rlike(ENDS))
    if "paragraph_id" in before:
        new |= before["paragraph_id"] != F.col("paragraph_id")
    value = F.struct(
        F.coalesce(new, F.lit(False)).alias("new"), "x", "size", F.coalesce(marker.isin("list", "chinese"), F.lit(False)).alias("listed"), (F.col("baseline") - before["baseline"]).alias("gap"), (F.col("x") - left).alias("indent"),
        F.abs(before["x"] - left).alias("margin"), F.abs(F.col("x") - before["x"]).alias("jump"),
    )
    order = ["y", "x", "row", "part"]
    rest = [c for c in named if c not in (*GROUP, *order)]
    return folded(lines_.withColumn("_v", value), PAGE, order, "_v", Open, {"paragraph": "bigint"}, rest, deal=False).select(*[c for c in named if c != "_group"], "paragraph")


def paragraphs(lines_: DataFrame) -> DataFrame:
    """doc_id, page, paragraph, lines, text, role, align, x, y, width, height, size, line_height, before, indent, first_indent, last_width.

    Lines are joined without a space where their ends belong together (see
    ``join_separator``).  indent: from the page's text to the paragraph, 0 if it
    is centred; first_indent: of its first line; last_width: of its last one.
    """
    size = W.partitionBy(*GROUP)
    marked = _paged(broken(_paged(lines_).withColumn("body", F.percentile("size", F.lit(0.5)).over(size))))
    key = [*PAGE, "paragraph"]
    down = W.partitionBy("_group", *key).orderBy("y", "x")
    steps = marked.withColumn("step", F.col("baseline") - F.lag("baseline").over(down))
    inner = steps.withColumn("last", F.lead("y").over(down).isNull())
    held = inner.groupBy("_group", *key).agg(
        F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("y", "x", "text", "width"))).alias("t"), *G.bounds(G.box()), F.percentile("size", F.lit(0.5)).alias("size"),
        F.percentile("step", F.lit(0.5)).alias("step"), F.first("body").alias("body"), F.min(F.when(~F.col("last"), F.col("x") + F.col("width"))).alias("short"),
    )
    first = F.col("t")[0]["text"]
    role = F.when(line_marker(first).isin("list", "chinese"), "list").when((F.col("size") > C.HEADING * F.col("body")) & (F.col("lines") <= 3), "heading").otherwise("body")
    region = W.partitionBy(*GROUP)
    held = held.withColumns({"left": F.min("x").over(region), "right": F.max(F.col("x") + F.col("width")).over(region), "top": F.min("y").over(region)})
    centred = F.abs((F.col("x") - F.col("left")) - (F.col("right") - F.col("x") - F.col("width"))) <= F.greatest(F.lit(C.CENTRE_MIN), C.CENTRE_SHARE * F.col("size"))
    align = F.when((F.col("x") - F.col("left") > F.col("size")) & centred, "center").when((F.col("lines") > 1) & (F.col("short") >= F.col("x") + 0.97 * F.col("width")), "both").otherwise("left")
    before = F.greatest(F.lit(0.0), F.col("y") - F.coalesce(F.lag(F.col("y") + F.col("height")).over(region.orderBy("paragraph")), F.col("top")))
    held = held.withColumn("align", align)
    joined = F.transform("t", lambda s, i: F.when(i == 0, s["text"]).otherwise(F.concat(join_separator(F.get("t", i - 1)["text"], s["text"]), s["text"])))
    indent = F.when(F.col("align") == "center", 0.0).otherwise(F.col("x") - F.col("left"))
    return held.select(
        *key, "lines", F.array_join(joined, "").alias("text"), role.alias("role"), "align", "x", "y", "width", "height", "size", F.coalesce("step", 1.25 * F.col("size")).alias("line_height"), before.alias("before"), indent.alias("indent"),
        (F.col("t")[0]["x"] - F.col("x")).alias("first_indent"), F.element_at("t", -1)["width"].alias("last_width"),
    )


def column_gutters(lines_: DataFrame, least: int = 4) -> DataFrame:
    """doc_id, page, left_end, right_start: the widest-supported vertical gap between two columns of narrow lines.

    Lines narrower than 62 % of the region on both sides of a gap, at least
    ``least`` each; the score prefers balanced sides and few crossing lines.
    """
    region = W.partitionBy(*PAGE)
    known = lines_.withColumns({"l": F.min("x").over(region), "r": F.max(F.col("x") + F.col("width")).over(region)}).withColumn("narrow", F.col("width") < 0.62 * (F.col("r") - F.col("l")))
    side = known.where("narrow").select(*PAGE, F.floor((F.col("x") + F.col("width")) + 0.5).alias("left_end"), "l", "r").distinct()
    other = known.where("narrow").select(*PAGE, F.floor(F.col("x") + 0.5).alias("right_start")).distinct()
    gaps = side.join(other, PAGE).where((F.col("right_start") - F.col("left_end")).between(3, 200) & (F.col("left_end") - F.col("l") > 0.2 * (F.col("r") - F.col("l"))) & (F.col("r") - F.col("right_start") > 0.2 * (F.col("r") - F.col("l"))))
    at = gaps.join(known.select(*PAGE, "x", (F.col("x") + F.col("width")).alias("e"), "narrow"), PAGE)
    count = at.groupBy(*PAGE, "left_end", "right_start").agg(
        F.count_if(F.col("narrow") & (F.col("e") <= F.col("left_end") + 1)).alias("nl"), F.count_if(F.col("narrow") & (F.col("x") >= F.col("right_start") - 1)).alias("nr"),
        F.count_if((F.col("x") < F.col("left_end") - 1) & (F.col("e") > F.col("right_start") + 1)).alias("crossing"),
    )
    score = 4 * F.least("nl", "nr") + F.col("nl") + F.col("nr") - 8 * F.col("crossing")
    best = count.where((F.col("nl") >= least) & (F.col("nr") >= least)).groupBy(*PAGE).agg(F.max(F.struct(score.alias("score"), (F.col("left_end") - F.col("right_start")).alias("w"), "left_end", "right_start")).alias("b"))
    return best.select(*PAGE, "b.left_end", "b.right_start", "b.score")
