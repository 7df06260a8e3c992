"""Layout tables projected from the supplied ones, the same in Spark and in SQL.

The supplied tables hold no spans.  A document's text is read as one page of
lines and words of six points a character and twelve points a line; numbers are
integers or halves, so doubles compare exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(spark: SparkSession, sf_dir: str) -> bool:
    """Whether no doc_id is missing or comes twice: what is cut out of one row of ``documents`` is all of a document then, and needs no dealing out."""
    return table(spark, sf_dir, "documents").groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


#: Documents that are cut into words together.
TOGETHER = 64


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each line of whole texts, with their number and where they begin (in characters)."""
    for whole in batches:
        for k in range(0, whole.num_rows, TOGETHER):
            batch = whole.slice(k, TOGETHER)
            lines_ = pc.split_pattern(batch.column(1), "\n")
            of_doc, texts = pc.list_parent_indices(lines_), pc.list_flatten(lines_)
            words_ = pc.split_pattern(texts, " ")
            of_line, found = pc.list_parent_indices(words_), pc.list_flatten(words_)
            n, row = len(found), of_line.to_numpy()
            chars = pc.utf8_length(found).to_numpy().astype(np.int64)
            ends = np.cumsum(chars + 1)
            new = np.append(True, row[1:] != row[:-1])[:n]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            start = ends - chars - 1
            doc = of_doc.to_numpy()
            opens = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
            line_no = np.arange(len(doc)) - np.maximum.accumulate(np.where(opens, np.arange(len(doc)), 0))
            columns = [batch.column(0).take(of_doc.take(of_line)), pa.array(line_no[row].astype(np.int32)), pa.array((np.arange(n) - first).astype(np.int32)), found, pa.array(start - start[first]), pa.array(chars)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line_no", "ord", "text", "at", "chars"])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page (1), line_no, ord (word in its line), text, x, y, width, height, baseline, size; each document where it is read, nothing is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    words = docs.mapInArrow(_placed, f"doc_id {dict(docs.dtypes)['doc_id']}, line_no int, ord int, text string, at bigint, chars bigint")
    return words.select(
        "doc_id", F.lit(1).alias("page"), "line_no", "ord", "text", (6.0 * F.col("at")).alias("x"), (12.0 * F.col("line_no")).alias("y"), (6.0 * F.col("chars")).alias("width"),
        F.lit(12.0).alias("height"), (12.0 * F.col("line_no") + 10).alias("baseline"), F.lit(12.0).alias("size"),
    )


def span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``spans`` of whole texts (doc_id, text) that are not blank, for an operator of the same pass; ord is of the document."""
    for words_ in _placed(batches):
        words_ = words_.filter(pc.not_equal(words_.column("text"), ""))
        line, ord_, at, chars = (words_.column(c).to_numpy().astype(np.int64) for c in ("line_no", "ord", "at", "chars"))
        full = lambda v: pa.array(np.full(len(line), v))  # noqa: E731, B023
        made = {"ord": pa.array(line * 100_000 + ord_), "text": words_.column("text"), "x": pa.array(6.0 * at), "y": pa.array(12.0 * line), "width": pa.array(6.0 * chars), "height": full(12.0), "baseline": pa.array(12.0 * line + 10), "size": full(12.0)}
        yield pa.RecordBatch.from_arrays([words_.column("doc_id"), full(np.int32(1)), *made.values()], ["doc_id", "page", *made])


#: Words of a page set in two columns: a heading, then two times thirty rows of four.
COLUMN_WORDS, PAGE_WORDS = 120, 241


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set in two columns under a heading, as spans: doc_id, page, line, ord, x, y, width, height, baseline, size, text.

    Words are 50 wide and 2 apart, rows 16 apart; both columns of a row are one
    line.  A page is full before the next one begins, and so is a column.
    """
    text = F.expr(r"filter(split(text, '[ \\t-\\r]+'), w -> w <> '')")
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text).alias("k", "text"))
    j = F.col("k") % PAGE_WORDS - 1
    column, i = F.floor(j / COLUMN_WORDS), j % COLUMN_WORDS
    head = j < 0
    x, y = 50 + 270 * column + 52 * (i % 4), 130 + 16 * F.floor(i / 4)
    at = {"page": F.floor(F.col("k") / PAGE_WORDS), "line": F.when(head, 0).otherwise(1 + F.floor(i / 4)), "ord": F.when(head, 0).otherwise(4 * column + i % 4)}
    at |= {"x": F.when(head, 50.0).otherwise(x.cast("double")), "y": F.when(head, 100.0).otherwise(y.cast("double")), "width": F.when(head, 480.0).otherwise(50.0), "height": F.lit(12.0)}
    return words.select("doc_id", *[v.alias(c) for c, v in at.items()], (at["y"] + 10).alias("baseline"), F.lit(12.0).alias("size"), F.translate("text", ".", ",").alias("text"))


def words(spark: SparkSession, sf_dir: str, per_page: int = 100) -> DataFrame:
    """doc_id, page, k (place on its page), text: the words of whole documents, ``per_page`` to a page."""
    text = F.expr(r"filter(split(text, '[ \\t-\\r]+'), w -> w <> '')")
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text).alias("n", "text"))
    return found.select("doc_id", F.floor(F.col("n") / per_page).alias("page"), (F.col("n") % per_page).alias("k"), "text")


def page_words(spark: SparkSession, sf_dir: str, per_page: int = 100) -> DataFrame:
    """doc_id, page, words: those of ``words`` as one array a page, cut where documents are read."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.expr(r"filter(split(text, '[ \\t-\\r]+'), w -> w <> '')").alias("w")).where("size(w) > 0")
    pages = found.select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size("w") - 1) / per_page))).alias("page"))
    return pages.select("doc_id", "page", F.slice("w", (F.col("page") * per_page + 1).cast("int"), F.lit(per_page)).alias("words"))


def word_batches(batches: Iterator[pa.RecordBatch], per_page: int = 100) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """``words`` of whole texts (doc_id, text) for an operator of the same pass, with where pages begin."""
    for whole_ in batches:
        for k in range(0, whole_.num_rows, TOGETHER):
            batch = whole_.slice(k, TOGETHER)
            cut = pc.split_pattern_regex(batch.column("text"), r"[ \t-\r]+")
            of, text = pc.list_parent_indices(cut), pc.list_flatten(cut)
            there = pc.not_equal(text, "")
            of, text = of.filter(there), text.filter(there)
            doc, n = of.to_numpy(), len(text)
            first = np.maximum.accumulate(np.where(np.append(True, doc[1:] != doc[:-1])[:n], np.arange(n), 0))
            at = np.arange(n) - first
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), pa.array(at // per_page), pa.array(at % per_page), text], ["doc_id", "page", "k", "text"]), np.flatnonzero(at % per_page == 0)


WORDS_SQL = r"""words AS MATERIALIZED (
  SELECT doc_id, n // 100 AS page, n % 100 AS k, text FROM (
    SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS n FROM (SELECT doc_id, [x for x in regexp_split_to_array(text, '[ \t-\r]+') if x <> ''] AS w FROM documents))
)"""

COLUMNS_SQL = rf"""words AS (
  SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS k FROM (SELECT doc_id, [x for x in regexp_split_to_array(text, '[ \t-\r]+') if x <> ''] AS w FROM documents)
), columns AS (
  SELECT doc_id, k // {PAGE_WORDS} AS page, replace(text, '.', ',') AS text, k % {PAGE_WORDS} - 1 AS j, j // {COLUMN_WORDS} AS side, j % {COLUMN_WORDS} // 4 AS row, j % 4 AS place FROM words
)"""

LINES_SQL = r"""lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM documents
)"""
SPANS_SQL = (
    LINES_SQL
    + r""", words AS (
  SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' '))))::INT AS ord FROM lines
), spans AS (
  SELECT doc_id, 1 AS page, line_no, ord, text,
         6.0::DOUBLE * coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x,
         12.0::DOUBLE * line_no AS y, 6.0::DOUBLE * length(text) AS width, 12.0::DOUBLE AS height, 12.0::DOUBLE * line_no + 10 AS baseline, 12.0::DOUBLE AS size
  FROM words
)"""
)
