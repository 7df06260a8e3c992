"""Form-field trees over selected pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.folds import folded
from leafmill.shared import reliable


def retained(fields: DataFrame, selected: DataFrame, all_pages: bool = False, depth: int = 32) -> DataFrame:
    """Fields that stay when only some pages do, with their ancestors: doc_id, node.

    fields: doc_id, node, parent, page (null for one without a widget).
    selected: doc_id, page.  A field stays if its page is selected or a kid
    stays; a childless field without a widget only if all pages are selected.
    A field with two parents, a circle of fields, and trees deeper than
    ``depth`` are an error.

    Ancestors are reached by doubling: a step of each round joins the ancestors
    that are 1, 2, 4, ... levels up.
    """
    kept = fields.join(selected.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").select("doc_id", "node")
    if all_pages:
        parents = fields.select("doc_id", F.col("parent").alias("node")).where("node is not null").distinct()
        kept = kept.union(fields.where("page is null").join(parents, ["doc_id", "node"], "left_anti").select("doc_id", "node"))
    kept = reliable(kept.distinct())
    up = fields.select("doc_id", "node", F.col("parent").alias("up")).distinct()
    if not up.groupBy("doc_id", "node").count().where("count > 1").isEmpty():
        raise ValueError("a form field has several parents")
    up = reliable(up.where("up is not null"))
    reach = 1
    while not up.isEmpty():
        if reach > depth:
            raise ValueError("form fields run in a circle or too deep")
        kept = reliable(kept.union(kept.join(up, ["doc_id", "node"]).select("doc_id", F.col("up").alias("node"))).distinct())
        far = up.select("doc_id", F.col("node").alias("up"), F.col("up").alias("far"))
        up, reach = reliable(up.join(far, ["doc_id", "up"]).select("doc_id", "node", F.col("far").alias("up"))), 2 * reach
    return kept


def merged_flags(forms: DataFrame) -> DataFrame:
    """Of all sources of one output: NeedAppearances if any needs it, signature flags together."""
    return forms.groupBy("output").agg(F.bool_or("need_appearances").alias("need_appearances"), F.bit_or("signature_flags").alias("signature_flags"))


def merged_resources(target: DataFrame, source: DataFrame) -> DataFrame:
    """Resources of two forms as one dictionary: doc_id, category, name, value, origin, old.

    target and source: doc_id, category, name, value.  A name of the source that
    the target has in any category is changed, in all categories alike, to
    name-2, name-3, ... that neither has.  Names are given in the order of the
    source's (ord).  Renamed ones are what default appearances must be told.
    """
    taken = target.select("doc_id", "name").distinct()
    reserved = taken.union(source.select("doc_id", "name")).distinct().groupBy("doc_id").agg(F.array_join(F.collect_set("name"), "\x00").alias("reserved"))
    clash = source.groupBy("doc_id", "name").agg(F.min("ord").alias("ord")).join(taken, ["doc_id", "name"], "left_semi").join(reserved, "doc_id")

    class Names:
        def __init__(self):
            self.held: set[str] | None = None

        def __call__(self, v) -> tuple[str]:
            name, names = v.split("\x01", 1)
            if self.held is None:
                self.held = set(names.split("\x00"))
            k = 2
            while f"{name}-{k}" in self.held:
                k += 1
            self.held.add(f"{name}-{k}")
            return (f"{name}-{k}",)

    told = folded(clash.withColumn("_v", F.concat_ws("\x01", "name", "reserved")), ["doc_id"], ["ord", "name"], "_v", Names, {"fresh": "string"}).drop("ord")
    mine = target.select("doc_id", "category", "name", "value", F.lit("target").alias("origin"), F.col("name").alias("old"))
    theirs = source.join(told, ["doc_id", "name"], "left").select("doc_id", "category", F.coalesce("fresh", "name").alias("name"), "value", F.lit("source").alias("origin"), F.col("name").alias("old"))
    return mine.union(theirs)


def calculation_order(order: DataFrame, kept: DataFrame) -> DataFrame:
    """Calculated fields (doc_id, pos, node) that stay, numbered anew in their order."""
    from pyspark.sql import Window as W

    left = order.join(kept.select("doc_id", "node").distinct(), ["doc_id", "node"], "left_semi")
    return left.withColumn("pos", (F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1).cast("int"))
