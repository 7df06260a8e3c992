"""Merkle fixity audit of WARC replicas (operator 3).

Each record is hashed.  Records are ordered by where they start, and offset
ranges of a file form a tree: the lowest ranges take LEAF bytes, and each range
above takes FANOUT of those below.  A range's hash covers the hashes inside it
in order, so two replicas of a file agree if their roots do.  Where roots differ
the audit descends: only ranges under a differing range are compared, down to
the records that were altered, lost or added.

Files are no larger than FILE records as written here, ranges no larger than
what fits their bytes, so no group grows with the corpus; only hashes are
shuffled, never records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import map_batches, settle, table

LEAF = 1 << 16
FANOUT = 16
FILE = 1024


def record(url: Column, body: Column) -> Column:
    """A page as a WARC response record with the digest of its block; null url or body: empty."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archived(pages: DataFrame, per_file: int = FILE) -> DataFrame:
    """(warc, page_id, record): pages as records of files; a page without an id gets one from its url and html."""
    key = F.coalesce(F.col("page_id").cast("long"), F.abs(F.xxhash64("url", "html")))
    pages = pages.select(key.alias("page_id"), record(F.col("url").cast("string"), F.col("html").cast("string")).alias("record"))
    return pages.select(F.floor(F.col("page_id") / per_file).cast("long").alias("warc"), "page_id", "record")


def placed(records: DataFrame, *more: str) -> DataFrame:
    """(warc, page_id, offset, length, digest) and the columns more of records (warc, page_id, record) written in the order of page_id.

    Records of one page_id stand in the order of their digests; equal ones take a place each.
    """
    from pyspark.sql import Window

    hashed = records.select("warc", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *more)
    order = Window.partitionBy("warc").orderBy("page_id", "digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.select("warc", "page_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"), "length", "digest", *more)


def parsed(files: DataFrame) -> DataFrame:
    """(warc, offset, length, record) of WARC files as the binaryFile source gives them (path, content).

    Plain files and files of one gzip member for each record; offsets are those
    in the file.  What follows a record that can't be read is one last record.
    """

    def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(content):
            if content[at : at + 2] == b"\x1f\x8b":
                unzip = zlib.decompressobj(31)
                try:
                    plain = unzip.decompress(content[at:])
                    end = len(content) - len(unzip.unused_data)
                except zlib.error:
                    plain, end = content[at:], len(content)
            else:
                head = content.find(b"\r\n\r\n", at)
                length = None
                for line in content[at : max(head, at)].split(b"\r\n")[1:]:
                    name, _, value = line.partition(b":")
                    if name.strip().lower() == b"content-length" and value.strip().isdigit():
                        length = int(value)
                end = len(content) if head < 0 or length is None else min(len(content), head + 8 + length)
                plain = content[at:end]
            yield at, end - at, plain
            at = end

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if rows := list(members(content or b"")):
                yield {"warc": [path] * len(rows)} | dict(zip(("offset", "length", "record"), zip(*rows, strict=True), strict=True))

    return map_batches(files.select("path", "content"), "warc string,offset long,length long,record binary", make)


def _lifted(level: DataFrame, fanout: int) -> DataFrame:
    """The level above."""
    up = level.select("warc", F.floor(F.col("range") / fanout).cast("long").alias("up"), "range", "hash")
    up = up.groupBy("warc", "up").agg(F.array_sort(F.collect_list(F.struct("range", "hash"))).alias("e"))
    return up.select("warc", F.col("up").alias("range"), F.sha2(F.expr("array_join(transform(e, x -> concat_ws(':', x.range, x.hash)), '|')"), 256).alias("hash"))


def tree(records: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (warc, range, hash) from the lowest to the roots; records: warc, offset, length, digest."""
    parts = records.groupBy("warc", F.floor(F.col("offset") / leaf).cast("long").alias("range"))
    entry = F.struct("offset", "length", "digest")
    level = parts.agg(F.array_sort(F.collect_list(entry)).alias("e"))
    level = settle(level.select("warc", "range", F.sha2(F.expr("array_join(transform(e, x -> concat_ws(':', x.offset, x.length, x.digest)), '|')"), 256).alias("hash")))
    out = [level]
    last = level.agg(F.max("range")).first()[0] or 0
    while last > 0:
        level = settle(_lifted(level, fanout))
        out.append(level)
        last //= fanout
    return out


def audit(one: DataFrame, two: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(warc, offset, status) of records on which two replicas differ.

    one and two: warc, offset, length, digest.  status: altered, missing (in
    the second), extra (only there).  A file that one replica lacks differs as a
    whole.  Of records that stand at one offset of one file, equal ones count as
    one.
    """
    here, there = tree(one, leaf, fanout), tree(two, leaf, fanout)
    while len(here) < len(there):
        here.append(_lifted(here[-1], fanout))
    while len(there) < len(here):
        there.append(_lifted(there[-1], fanout))
    differing = None
    for a, b in zip(reversed(here), reversed(there), strict=True):
        if differing is not None:
            under = differing.select("warc", F.col("range").alias("up"))
            a, b = (x.withColumn("up", F.floor(F.col("range") / fanout).cast("long")).join(under, ["warc", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.join(b.withColumnRenamed("hash", "other"), ["warc", "range"], "full")
        differing = settle(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("warc", "range"))

    def within(records: DataFrame, name: str) -> DataFrame:
        cut = records.select("warc", "offset", F.concat_ws(":", "length", "digest").alias(name), F.floor(F.col("offset") / leaf).cast("long").alias("range"))
        cut = cut.join(differing, ["warc", "range"], "left_semi")
        return cut.groupBy("warc", "offset").agg(F.array_sort(F.collect_set(name)).alias(name))

    both = within(one, "a").join(within(two, "b"), ["warc", "offset"], "full")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("altered")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("warc", "offset", status.alias("status"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica that lost and altered some.

    Returns page_id, warc, offset, length, digest, status (ok, altered, missing)
    of every record.  Pages that repeat are records of their own, at offsets of
    their own; a null url or html is empty; a null page_id gets one from the
    page's content; an empty table has no records.
    """
    written = archived(table(spark, sf_dir, "pages"))
    # The replica: the same layout with holes and flipped bytes, as bit rot leaves it.
    rotten = F.when(F.col("page_id") % 97 == 13, F.overlay("record", F.lit("~"), 12)).otherwise(F.col("record"))
    written = written.withColumn("there", F.when(F.col("page_id") % 211 != 7, F.struct(F.octet_length(rotten).cast("long").alias("length"), F.sha2(rotten, 256).alias("digest"))))
    both = settle(placed(written, "there"))
    first = both.drop("there")
    second = both.where("there is not null").select("warc", "offset", "there.length", "there.digest")
    found = audit(first.select("warc", "offset", "length", "digest"), second)
    return first.join(found, ["warc", "offset"], "left").select("page_id", "warc", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))


OP3_SQL = r"""
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 1024) AS BIGINT) AS warc,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(html) || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages
)
SELECT page_id, warc,
       CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY warc ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest,
       CASE WHEN page_id % 211 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'altered' ELSE 'ok' END AS status
FROM r
"""
