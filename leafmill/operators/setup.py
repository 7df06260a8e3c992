"""Page setups, resource guards, OCR decisions and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import geometry as G
from leafmill.functions.text import UNCERTAIN
from leafmill.operators.spans import PAGE, nearest_paper


def page_setups(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """What blocks leave free, for each group of pages of one paper and rounded size.

    pages: doc_id, page, width, height.  blocks: doc_id, page, x, y, width,
    height.  left and right are medians over pages of what is left beside all
    blocks, top and bottom the value at index floor(20 %) of what is left above
    and below them, within 18 % of the page.  Returns doc_id, paper, kw, kh, pages
    and the four edges; ``margins.chosen_margins`` weighs the kinds of blocks and
    chooses presets.
    """
    sized = nearest_paper(pages).withColumns({"kw": G.rounded(F.col("width")).cast("long"), "kh": G.rounded(F.col("height")).cast("long")})
    edges = blocks.groupBy(*PAGE).agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("b"))
    at = sized.join(edges, PAGE, "left").select("doc_id", "paper", "kw", "kh", "page", "l", "t", (F.col("width") - F.col("r")).alias("r"), (F.col("height") - F.col("b")).alias("b"), "width", "height")
    near = {c: F.when(F.col(c) <= 0.18 * F.col(side), F.col(c)) for c, side in (("t", "height"), ("b", "height"))}
    held = at.select("doc_id", "paper", "kw", "kh", "page", "l", "r", near["t"].alias("t"), near["b"].alias("b"))
    return held.groupBy("doc_id", "paper", "kw", "kh").agg(
        F.count("*").alias("pages"), F.percentile("l", F.lit(0.5)).alias("left"), F.percentile("r", F.lit(0.5)).alias("right"), G.lower_quantile(F.col("t"), 0.2).alias("top"), G.lower_quantile(F.col("b"), 0.2).alias("bottom")
    )


def borrowed_margins(pages: DataFrame, dense: int = 100) -> DataFrame:
    """Sparse pages take the median left and right margin of dense ones of their size (within 3 pt), if that is less.

    pages: doc_id, page, width, height, spans, left, right.
    """
    a, b = pages.alias("a"), pages.where(F.col("spans") >= dense).alias("b")
    like = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.abs(F.col("a.width") - F.col("b.width")) < 3) & (F.abs(F.col("a.height") - F.col("b.height")) < 3)
    typical = a.where(F.col("a.spans") < dense).join(b, like).groupBy("a.doc_id", "a.page").agg(F.percentile("b.left", F.lit(0.5)).alias("ml"), F.percentile("b.right", F.lit(0.5)).alias("mr"))
    out = pages.join(typical, PAGE, "left")
    return out.withColumns({"left": F.least("left", "ml"), "right": F.least("right", "mr")}).drop("ml", "mr")


def guards(items: DataFrame, by: list[str], limits: dict[str, int]) -> DataFrame:
    """Sums of each limited column by group, and the first limit that a group breaks."""
    held = items.groupBy(*by).agg(*[F.sum(c).alias(c) for c in limits])
    error = F.lit(None).cast("string")
    for c, most in reversed(limits.items()):
        error = F.when(F.col(c) > most, c).otherwise(error)
    return held.withColumn("error", error)


def encoding_regions(spans: DataFrame, cells: DataFrame, pages: DataFrame, chars_left: int = 100) -> DataFrame:
    """Grid cells that hold all spans of uncertain encoding, page by page; none where any span is outside.

    A cell takes 5 % of its page at most, all together 12 %, eight at most, and
    ``chars_left`` characters must stay.  cells: doc_id, page, cell_ord, x, y, width, height.
    """
    odd = spans.withColumn("odd", F.col("text").rlike(UNCERTAIN)).withColumns({"cx": F.col("x") + F.col("width") / 2, "cy": F.col("y") + F.col("height") / 2})
    area = pages.select(*PAGE, (F.col("width") * F.col("height")).alias("area"))
    small = cells.join(area, PAGE).where(F.col("width") * F.col("height") <= 0.05 * F.col("area")).select(*PAGE, "cell_ord", F.col("x").alias("l"), F.col("y").alias("t"), (F.col("x") + F.col("width")).alias("r"), (F.col("y") + F.col("height")).alias("b"), (F.col("width") * F.col("height") / F.col("area")).alias("share"))
    inside = odd.where("odd").join(small, PAGE).where("cx between l and r and cy between t and b")
    first = inside.groupBy(*PAGE, "ord").agg(F.min(F.struct("cell_ord", "share")).alias("c")).select(*PAGE, "ord", "c.cell_ord", "c.share")
    chosen = first.groupBy(*PAGE).agg(F.count("*").alias("covered"), F.collect_set(F.struct("cell_ord", "share")).alias("cells"))
    need = odd.groupBy(*PAGE).agg(F.count_if("odd").alias("odd"), F.sum(F.when(~F.col("odd"), F.char_length("text")).otherwise(0)).alias("chars"))
    ok = chosen.join(need, PAGE).where((F.col("covered") == F.col("odd")) & (F.size("cells") <= 8) & (F.col("chars") >= chars_left) & (F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["share"]) <= 0.12))
    return ok.select(*PAGE, F.explode("cells").alias("c")).select(*PAGE, "c.cell_ord")


def needs_ocr(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """pages (characters, images, outlined, uncertain, searchable_scan, annotation_issue) with needs_ocr."""
    empty = (F.col("characters") == 0) & (F.col("images") > 0)
    auto = F.col("searchable_scan") | empty | F.col("outlined") | F.col("uncertain") | F.col("annotation_issue")
    return pages.withColumn("needs_ocr", F.lit(True) if mode == "always" else auto if mode == "auto" else F.lit(False))


def savings(files: DataFrame, before: str, after: str) -> DataFrame:
    """Bytes saved, zero if the result isn't smaller, and that share in percent."""
    saved = F.greatest(F.col(before) - F.col(after), F.lit(0))
    return files.withColumn("saved", saved).withColumn("saved_percent", F.when(F.col(before) > 0, G.rounded(saved * 100 / F.col(before))).otherwise(0).cast("long"))


def batches(pages: DataFrame, by: str, order: str, size: int = 10) -> DataFrame:
    """Numbers batches of ``size`` pages, after which an OCR worker is replaced."""
    return pages.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size).cast("int"))


def strided_sample(rows: DataFrame, by: list[str], order: str, most: int = 48) -> DataFrame:
    """Evenly strided rows of each group, ``most`` at most: the sample is the feature."""
    w = W.partitionBy(*by)
    marked = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return marked.where(F.col("_i") % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).withColumn("_k", F.row_number().over(w.orderBy(order))).where(F.col("_k") <= most).drop("_i", "_n", "_k")


def oversize(pages: DataFrame) -> DataFrame:
    """Scale for scans whose long edge is over 1584 pt: to 297 mm."""
    longest = F.greatest("width", "height")
    return pages.withColumn("scale", F.when(longest > 1584, 297 * C.MM / longest).otherwise(1.0))


def pixel_sum(images: DataFrame, by: list[str]) -> DataFrame:
    """by, pixels: the sum over a document's images (width, height, mismatch); null if any breaks a limit or its dictionary."""
    n = F.col("width").cast("long") * F.col("height")
    bad = F.coalesce((F.col("width") < 1) | (F.col("height") < 1) | (F.greatest("width", "height") > C.IMAGE_EDGE) | (n > C.IMAGE_PIXELS) | F.coalesce("mismatch", F.lit(False)), F.lit(True))
    return images.groupBy(*by).agg(F.when(~F.bool_or(bad), F.sum(n)).alias("pixels"))


def recompressible(images: DataFrame) -> DataFrame:
    """Embedded images that may be compressed again: one DCT filter, 8 bits, grey or RGB (or ICC with 1 or 3 components), 16 KiB and more, no mask or decode array."""
    space = F.col("space").isin("DeviceGray", "DeviceRGB") | ((F.col("space") == "ICCBased") & F.col("components").isin(1, 3))
    return images.where((F.col("filters") == F.array(F.lit("DCTDecode"))) & (F.col("bits") == 8) & space & (F.col("length") >= 16_384) & ~F.coalesce("masked", F.lit(False)) & ~F.coalesce("decoded", F.lit(False)))
