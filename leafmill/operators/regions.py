"""Regions of scanned pages that stay pictures: seeds, their closure, and what they take.

The closure is a fixpoint in rounds.  Only regions that grew in the last round
look for neighbours again, and pages where none grew are done; each round is
settled, so a lost executor costs one round.  Regions meet lines and tables in
slots of their height, so a page's rows are not paired with all its regions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators.spans import PAGE
from leafmill.shared import settled

#: Height of a slot, and how far apart regions are joined.
SLOT, TOUCH = 100.0, 3.0
BOX = ["x", "y", "width", "height"]


def doubtful(spans: DataFrame, by: list[str]) -> DataFrame:
    """by: groups of scanned spans (text, confidence) that may have been misread.

    No characters, a mean confidence under 84, over a tenth of the characters
    under 60, or a span with a letter or digit under 40; without a confidence a
    span counts as 0.  A span with source_mismatch, where that column exists,
    makes its group doubtful.
    """
    chars, sure = F.char_length(F.regexp_replace("text", r"\s", "")), F.coalesce(F.col("confidence"), F.lit(0)).cast("double")
    odd = F.coalesce(F.col("source_mismatch"), F.lit(False)) if "source_mismatch" in spans.columns else F.lit(False)
    held = spans.groupBy(*by).agg(
        F.sum(chars).alias("n"), F.sum(chars * sure).alias("score"), F.sum(F.when(sure < 60, chars).otherwise(0)).alias("low"), F.bool_or(odd | ((sure < 40) & F.col("text").rlike(r"[\p{L}\p{N}]"))).alias("odd")
    )
    return held.where((F.col("n") == 0) | (F.col("score") < 84 * F.col("n")) | (10 * F.col("low") > F.col("n")) | F.col("odd")).select(*by)


def _slots(y: Column, bottom: Column) -> Column:
    return F.explode(F.sequence(F.floor(y / SLOT), F.floor(bottom / SLOT)))


def _met(a: DataFrame, b: DataFrame, keep: list[Column], on: Column) -> DataFrame:
    """Pairs of boxes of one page, each once, for which ``on`` (over a.* and b.*) holds; both with id."""
    p = a.withColumn("_slot", _slots(F.col("y"), G.box().bottom)).alias("a")
    q = b.withColumn("_slot", _slots(F.col("y"), G.box().bottom)).alias("b")
    same = reduce(lambda x, c: x & (F.col(f"a.{c}") == F.col(f"b.{c}")), [*PAGE, "_slot"], F.lit(True))
    # Of the slots that both are in, only the first one makes the pair.
    first = F.col("a._slot") == F.greatest(F.floor(F.col("a.y") / SLOT), F.floor(F.col("b.y") / SLOT))
    return p.join(q, same & first & on).select(*keep)


def _overlap() -> Column:
    return G.overlaps(G.box("a"), G.box("b"))


def art_extents(artwork: DataFrame, strips: DataFrame) -> DataFrame:
    """artwork (ord, box) lengthened over the grey below it.

    strips: doc_id, page, ord (of the artwork), y, wide, grey, dark (pixels of a
    row below it, without those in text).  A piece over 80 wide and 50 high
    reaches to the lowest row that is 5 to 35 % grey, with three times more grey
    than dark.
    """
    grey = (F.col("grey") > 0.05 * F.col("wide")) & (F.col("grey") < 0.35 * F.col("wide")) & (F.col("grey") > 3 * F.col("dark"))
    low = strips.where(grey).groupBy(*PAGE, "ord").agg(F.max("y").alias("low"))
    large = (F.col("width") > 80) & (F.col("height") > 50) & (F.col("low") > G.box().bottom)
    return artwork.join(low, [*PAGE, "ord"], "left").withColumn("height", F.when(large, F.col("low") - F.col("y")).otherwise(F.col("height"))).drop("low")


def seeds(lines: DataFrame, spans: DataFrame, tables: DataFrame, artwork: DataFrame, pages: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, page, x, y, width, height: where a page's text can't be trusted.

    Artwork with the lines that it crosses, artwork shaped like a banner (35 % of
    the page wide, eight times as wide as high), tables that hold doubtful text
    or meet artwork, and lines that are doubtful or marked (underlined numbers).

    lines: line, box, without those of tables.  spans: line or table (the other
    one null), text, confidence.  tables, artwork: ord, box.  pages: doc_id,
    page, width.  marked: doc_id, page, line.
    """
    art = artwork.withColumn("id", F.col("ord"))
    crossed = _met(art, lines.withColumn("id", F.col("line")), [F.col("a.doc_id").alias("doc_id"), F.col("a.page").alias("page"), F.col("a.ord").alias("ord"), *[F.col(f"b.{c}").alias(c) for c in BOX]], _overlap())
    with_lines = art.select(*PAGE, "ord", *BOX).unionByName(crossed).groupBy(*PAGE, "ord").agg(F.count("*").alias("n"), *G.bounds(G.box()))
    banner = art.join(pages.select(*PAGE, F.col("width").alias("pw")), PAGE).where((F.col("width") >= 0.35 * F.col("pw")) & (F.col("width") >= 8 * F.col("height"))).select(*PAGE, "ord").withColumn("banner", F.lit(True))
    pictures = with_lines.join(banner, [*PAGE, "ord"], "left").where("n > 1 or banner")
    met = _met(tables.withColumn("id", F.col("ord")), art, [F.col("a.doc_id").alias("doc_id"), F.col("a.page").alias("page"), F.col("a.ord").alias("ord")], _overlap())
    # A table without spans is doubtful too.
    empty = tables.join(spans.where("table is not null").select(*PAGE, F.col("table").alias("ord")), [*PAGE, "ord"], "left_anti").select(*PAGE, "ord")
    bad_tables = met.union(empty).union(doubtful(spans.where("table is not null"), [*PAGE, "table"])).distinct()
    bad_lines = doubtful(spans.where("line is not null"), [*PAGE, "line"]).union(marked.select(*PAGE, "line")).distinct()
    parts = [pictures, tables.join(bad_tables, [*PAGE, "ord"], "left_semi"), lines.join(bad_lines, [*PAGE, "line"], "left_semi")]
    return reduce(DataFrame.unionByName, [p.select(*PAGE, *[F.col(c).cast("double").alias(c) for c in BOX]) for p in parts])


def closure(seeds: DataFrame, lines: DataFrame, tables: DataFrame) -> tuple[DataFrame, int]:
    """(regions: doc_id, page, x, y, width, height; rounds): the least regions around the seeds that are closed.

    A region takes in every paragraph with the middle of a line inside its height
    and every table that it overlaps, and regions at most 3 pt above each other
    are one.  lines: paragraph, box.  tables: box.  A page without seeds has no
    regions.
    """
    middle = F.col("y") + F.col("height") / 2
    paragraphs = lines.groupBy(*PAGE, "paragraph").agg(*G.bounds(G.box())).select(*PAGE, "paragraph", F.struct(*BOX).alias("box"))
    rows = lines.join(paragraphs, [*PAGE, "paragraph"]).select(*PAGE, F.col("x"), middle.alias("y"), F.col("width"), F.lit(0.0).alias("height"), "box", F.lit(True).alias("line"))
    around = settled(rows.unionByName(tables.select(*PAGE, *[F.col(c).cast("double").alias(c) for c in BOX], F.struct(*[F.col(c).cast("double").alias(c) for c in BOX]).alias("box"), F.lit(False).alias("line"))))
    inside = (F.col("b.y") > F.col("a.y")) & (F.col("b.y") < F.col("a.y") + F.col("a.height"))
    on = F.when(F.col("b.line"), inside).otherwise(_overlap())
    found, done, rounds = settled(seeds.select(*PAGE, *[F.col(c).cast("double").alias(c) for c in BOX]).distinct().withColumns({"id": F.expr("uuid()"), "grew": F.lit(True)})), None, 0
    while not found.isEmpty():
        rounds += 1
        taken = _met(found.where("grew"), around.withColumn("id", F.lit(0)), [*[F.col(f"a.{c}").alias(c) for c in [*PAGE, "id"]], *[F.col(f"b.box.{c}").alias(c) for c in BOX]], on)
        wider = found.select(*PAGE, "id", *BOX).unionByName(taken).groupBy(*PAGE, "id").agg(*G.bounds(G.box()))
        before = found.select("id", *[F.col(c).alias(f"_{c}") for c in BOX])
        changed = reduce(lambda x, c: x | (F.col(c) != F.col(f"_{c}")), BOX, F.lit(False))
        wider = wider.join(before, "id").withColumn("grew", changed)
        down = W.partitionBy(*PAGE).orderBy("y", "id")
        reach = F.max(G.box().bottom).over(down.rowsBetween(W.unboundedPreceding, -1))
        joined = wider.withColumn("_new", F.coalesce((F.col("y") > reach + TOUCH).cast("int"), F.lit(0))).withColumn("_part", F.sum("_new").over(down.rowsBetween(W.unboundedPreceding, 0)))
        merged = joined.groupBy(*PAGE, "_part").agg(*G.bounds(G.box()), F.min("id").alias("id"), (F.bool_or("grew") | (F.count("*") > 1)).alias("grew"))
        now = settled(merged.drop("_part").withColumn("_open", F.bool_or("grew").over(W.partitionBy(*PAGE))))
        part = now.where(~F.col("_open")).select(*PAGE, *BOX)
        done = part if done is None else done.unionByName(part)
        found = now.where("_open").drop("_open")
    return (found.select(*PAGE, *BOX) if done is None else done), rounds


def retained(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, region (from the top), box: regions with 2 pt at the sides and 1 pt above and below, within the page."""
    at = regions.join(pages.select(*PAGE, F.col("width").alias("pw"), F.col("height").alias("ph")), PAGE)
    x, y = F.greatest(F.lit(0.0), F.col("x") - 2), F.greatest(F.lit(0.0), F.col("y") - 1)
    right, bottom = F.least(F.col("pw"), G.box().right + 2), F.least(F.col("ph"), G.box().bottom + 1)
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("y", "x")) - 1
    return at.select(*PAGE, number.alias("region"), x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height"))


def rasterised(boxes: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """key of the boxes (spans, or rules as boxes) whose middle lies in a retained region."""
    held = _met(regions.withColumn("id", F.lit(0)), boxes.withColumn("id", F.lit(0)), [F.col(f"b.{c}").alias(c) for c in key], G.contains_center(G.box("a"), G.box("b")))
    return held.distinct()


def editable_paragraphs(spans: DataFrame, reliable: DataFrame) -> DataFrame:
    """doc_id, page, paragraph: paragraphs all of whose spans (ord) are reliable; where a whole scan stays as the background only these are text."""
    told = spans.join(reliable.select(*PAGE, "ord").distinct().withColumn("_ok", F.lit(True)), [*PAGE, "ord"], "left")
    return told.groupBy(*PAGE, "paragraph").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("ok")).where("ok").drop("ok")
