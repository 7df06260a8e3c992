"""Page algebra: ranges, plans, ordered unions, limits and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.operators.folds import folded
from leafmill.shared import reliable

_PART = r"^([0-9]+)(?:\s*[-–]\s*([0-9]+))?$"


def page_range(text: Column, count: Column) -> Column:
    """struct(pages, error) of a range such as ``5, 1-3, 3，8``: pages are distinct and ascending."""
    parts = F.transform(F.split(text, "[,，、]"), lambda p: F.trim(p))
    spans = F.transform(parts, lambda p: F.struct(F.expr("1").alias("one"), p.alias("p"), F.try_to_number(F.regexp_extract(p, _PART, 1), F.lit("999999999")).cast("long").alias("a"), F.try_to_number(F.nullif(F.regexp_extract(p, _PART, 2), F.lit("")), F.lit("999999999")).cast("long").alias("z")))
    spans = F.transform(spans, lambda s: F.struct(s["p"].alias("p"), s["a"].alias("a"), F.coalesce(s["z"], s["a"]).alias("z")))
    bad = F.coalesce(F.exists(spans, lambda s: ~s["p"].rlike(_PART) | s["a"].isNull() | (s["a"] < 1) | (s["z"] > count) | (s["a"] > s["z"])), F.lit(True))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["z"])))))
    return F.struct(F.when(~bad, pages).alias("pages"), F.when(bad, F.lit("page range")).alias("error"))


def toggled(pages: Column, page: Column) -> Column:
    """The selection with one page added, or taken out, in order."""
    one = F.array(page)
    return F.array_sort(F.array_union(F.array_except(pages, one), F.array_except(one, pages)))


def plan_pages(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages by group and position: plan (group_id, pages) joined with pages (page, ...); order and repeats stay."""
    wanted = plan.select("group_id", F.posexplode("pages").alias("pos", "page"))
    return wanted.join(pages, "page")


def every_page_plan(count: int, digits: int = 2) -> Column:
    """One group for each page, named by its number in at least ``digits`` digits."""
    width = max(digits, len(str(count)))
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.struct(F.lpad(i.cast("string"), width, "0").alias("name"), F.array(i).alias("pages")))


def multiplicity(plan: DataFrame) -> DataFrame:
    """How many times each page is chosen over all groups."""
    return plan.select(F.explode("pages").alias("page")).groupBy("page").agg(F.count("*").alias("times"))


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """rows with their place from 1 in a total order: sorted by ranges, one count for each range gives its offset.

    No row passes through one task; the sorted ranges are kept, as places hang on them.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = reliable(sorted_.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at") % (1 << 33)}))
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = counts.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))
    return sorted_.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def ordered_union(pages: DataFrame, file: str, page: str) -> DataFrame:
    """All pages in file order, then page order, with their position from 1."""
    return numbered(pages, [file, page])


def running_limit(files: DataFrame, order: str, size: str, limit: int) -> DataFrame:
    """Running total in order, and whether it is still within the limit."""
    total = F.sum(size).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return files.withColumn("total", total).withColumn("within", F.col("total") <= limit)


def greedy_intake(files: DataFrame, group: list[str], order: str, size: str, limit: int, most: int | None = None) -> DataFrame:
    """Take files in order while they fit; one that doesn't is passed over and takes nothing.

    One pass over the sorted rows of each partition; only a running total is held.
    """

    class Taker:
        def __init__(self):
            self.used = self.n = 0

        def __call__(self, x) -> tuple[int, bool]:
            n = int(x)
            ok = self.used + n <= limit and (most is None or self.n < most)
            if ok:
                self.used, self.n = self.used + n, self.n + 1
            return n, ok

    return folded(files, group, [order], size, Taker, {size: "bigint", "accepted": "boolean"})


def plan_error(groups: int | Column, pages: int | Column) -> Column:
    return F.when(groups > C.SPLIT_GROUPS, "too many outputs").when(pages > C.SPLIT_PAGES, "too many pages")


def file_error(name: Column, size: Column, pages: Column) -> Column:
    """The first rule that a file breaks, else null."""
    return (
        F.when(~F.lower(name).endswith(".pdf"), "not a pdf").when(size <= 0, "empty").when(size > C.FILE_BYTES, "too large")
        .when(pages < 1, "no pages").when(pages > C.FILE_PAGES, "too many pages")
    )


def page_batches(pages: Column) -> Column:
    """A page list cut wherever a page would come twice in one batch."""
    start = F.struct(F.array().cast("array<array<bigint>>").alias("done"), F.array().cast("array<bigint>").alias("now"))

    def step(a: Column, p: Column) -> Column:
        again = F.array_contains(a["now"], p)
        done = F.when(again, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(again, F.array(p)).otherwise(F.concat(a["now"], F.array(p))).alias("now"))

    return F.aggregate(F.transform(pages, lambda p: p.cast("long")), start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def reordered(ord_: Column, taken: int, put: int) -> Column:
    """New places after the item at ``taken`` moves to ``put``."""
    if taken < put:
        shift = F.when((ord_ > taken) & (ord_ <= put), ord_ - 1)
    else:
        shift = F.when((ord_ >= put) & (ord_ < taken), ord_ + 1)
    return F.when(ord_ == taken, F.lit(put)).otherwise(F.coalesce(shift, ord_))


def unique_names(groups: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """Names told apart without case: a later equal name gets -1, -2, ... that no base name takes either.

    Names of one ``by`` group (a plan) are resolved together, as an array.
    """
    held = groups.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, name))).alias("g"))
    held = held.withColumn("base", F.transform("g", lambda x: F.lower(x[name])))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        low = F.lower(x[name])
        again = F.array_contains(a["seen"], low)
        # Names taken are at most the base names and those given so far, so one of these is free.
        options = F.when(again, F.transform(F.sequence(F.lit(1), F.size("g") + F.size(a["out"]) + 1), lambda i: F.concat(x[name], F.lit("-"), i.cast("string"))))
        free = F.element_at(F.filter(options, lambda o: ~F.array_contains(a["seen"], F.lower(o)) & ~F.array_contains(F.col("base"), F.lower(o))), 1)
        chosen = F.when(again, free).otherwise(x[name])
        return F.struct(F.array_union(a["seen"], F.array(low, F.lower(chosen))).alias("seen"), F.concat(a["out"], F.array(chosen)).alias("out"))

    named = held.select(*by, "g", F.aggregate("g", start, step, lambda a: a["out"]).alias("names"))
    return named.select(*by, F.posexplode("names").alias("i", "filename"), "g").select(*by, F.col("g")[F.col("i")][order].alias(order), "filename")


def merge_state(files: DataFrame, by: list[str]) -> DataFrame:
    """Of each list of files (loaded, failed, pages, bytes, aspect): totals, whether it can be merged, and mixed orientation.

    Ready: two files and more, all loaded, none failed, pages within the limit.
    Mixed: some pages wider than high and some not; unknown aspects don't count.
    """
    held = files.groupBy(*by).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.bool_and(F.coalesce("loaded", F.lit(False))).alias("loaded"),
        F.bool_or(F.coalesce("failed", F.lit(False))).alias("failed"), (F.coalesce(F.bool_or(F.col("aspect") > 1), F.lit(False)) & F.coalesce(F.bool_or(F.col("aspect") <= 1), F.lit(False))).alias("mixed"),
    )
    ready = (F.col("files") >= 2) & F.col("loaded") & ~F.col("failed") & (F.col("pages") <= C.MERGE_PAGES)
    return held.select(*by, "files", "pages", "bytes", ready.alias("ready"), "mixed")


def merge_error(files: DataFrame, by: list[str]) -> DataFrame:
    """The first of the three limits that a list of files (bytes, pages) breaks: how many, their bytes, their pages."""
    held = files.groupBy(*by).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.sum("pages").alias("p"))
    return held.select(*by, F.when(F.col("n") > C.MERGE_FILES, "too many files").when(F.col("b") > C.MERGE_BYTES, "too many bytes").when(F.col("p") > C.MERGE_PAGES, "too many pages").alias("error"))
