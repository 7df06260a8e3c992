"""URL filters by a sorted digest array (operator 13).

A rule is a host, the beginning of a path and a verdict.  The index is one file:
the 64-bit xxHash digests of all "host" and "host/path" keys in ascending order,
for each where its full string lies, and the strings.  It is written to the
shared folder, handed to every executor with ``addFile`` and mapped into memory
by the Python workers, which share its pages.  A batch of URLs is probed by
vectorised binary search: first every ending of each host that begins at a label,
then, for hosts that have rules, every beginning of the path whose length a rule
of that host has.  A digest that is found counts only if the stored string is
equal.

The operator is map only, whatever a single host's share of the rows.  The index
grows with the rules and not with the pages; lists of over INDEXED bytes of rules
are joined as tables instead (``joined_verdicts``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from xxhash import xxh64_intdigest

from leafmill.llm.common import map_batches, strings, table
from leafmill.shared import shared_dir

#: The rules of operator 13, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Bytes of hosts and paths, 16 for each rule besides, up to which rules are indexed in one file.
INDEXED = 256 << 20
#: The verdict of a URL that no rule fits.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(_UPPER, _LOWER)


# The index


def _key(host: str, path: str | None = None) -> bytes:
    """No two hosts or rules share a key, whatever characters they hold."""
    return f":{host}".encode() if path is None else f"{len(host)}:{host}{path}".encode()


def index(rules: list[tuple[str, str, str]], digest=xxh64_intdigest) -> bytes:
    """The index of rules (host, path, verdict) as the bytes of a file; hosts are lower-cased (A-Z).

    Of rules with one host and path, block stands before other verdicts and
    then the verdict that is smallest.
    """
    lowered = sorted({(h.translate(_LOWERED), p, v) for h, p, v in rules}, key=lambda r: (*r[:2], r[2] != "block", r[2]))
    first = {(h, p): v for h, p, v in reversed(lowered)}
    verdicts = sorted(set(first.values()))
    by_host: dict[str, set[int]] = {}
    for h, p in first:
        by_host.setdefault(h, set()).add(len(p))
    # a host's value: where its path lengths lie; a rule's value: its verdict
    lengths, entries = [], []
    for h, found in by_host.items():
        entries.append((_key(h), len(lengths)))
        lengths += [len(found), *sorted(found, reverse=True)]
    entries += [(_key(h, p), verdicts.index(v)) for (h, p), v in first.items()]
    entries = sorted((digest(k), k, v) for k, v in entries)
    at = np.cumsum([0, *(len(k) for _, k, _ in entries)])
    blob, names = b"".join(k for _, k, _ in entries), "\n".join(verdicts).encode()
    head = np.array([len(entries), len(lengths), len(blob), len(names), max((h.count(".") + 1 for h in by_host), default=0), 0, 0, 0], np.int64)
    arrays = [head, np.array([d for d, _, _ in entries], np.uint64), at.astype(np.int64), np.array([v for _, _, v in entries], np.int64), np.array(lengths, np.int64)]
    return b"".join(x.tobytes() for x in arrays) + blob + names


class Index:
    """An index file, mapped into memory."""

    def __init__(self, path: str, digest=xxh64_intdigest):
        raw = np.memmap(path, np.uint8, "r")
        n, m, size, named, self.labels = raw[:64].view(np.int64)[:5].tolist()
        cuts = np.cumsum([64, 8 * n, 8 * (n + 1), 8 * n, 8 * m, size, named])
        part = [raw[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        self.keys, (self.at, self.value, self.lengths) = part[0].view(np.uint64), (x.view(np.int64) for x in part[1:4])
        self.blob, self.verdicts, self.digest = part[4], part[5].tobytes().decode().split("\n"), digest

    def __call__(self, probes: list[bytes]) -> np.ndarray:
        """The value of each probe, or -1."""
        wanted = np.array([self.digest(x) for x in probes], np.uint64)
        place = np.searchsorted(self.keys, wanted)
        out = np.full(len(probes), -1, np.int64)
        for i in np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == wanted).tolist() if len(self.keys) else []:
            at = int(place[i])
            while at < len(self.keys) and self.keys[at] == wanted[i]:  # several strings may share a digest
                if self.blob[self.at[at] : self.at[at + 1]].tobytes() == probes[i]:
                    out[i] = self.value[at]
                    break
                at += 1
        return out

    def paths(self, value: int) -> list[int]:
        return self.lengths[value + 1 : value + 1 + self.lengths[value]].tolist()

    def endings(self, host: str) -> list[str]:
        """The endings of a host that begin at a label and have no more labels than a rule's host."""
        out, at = [], len(host)
        for _ in range(self.labels):
            at = host.rfind(".", 0, at)
            out.append(host[at + 1 :])
            if at < 0:
                break
        return out

    def judged(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """(rule, verdict) of each URL: the longest rule that fits, of equally long ones that of the longer host."""
        known: dict[str, list[str]] = {h: self.endings(h) for h in set(hosts)}
        ends = sorted({e for x in known.values() for e in x})
        ruled = {e: self.paths(v) for e, v in zip(ends, self([_key(e) for e in ends]).tolist(), strict=True) if v >= 0}
        fitting = {h: [(e, n) for e in x if e in ruled for n in ruled[e]] for h, x in known.items()}
        probes: dict[tuple[str, str], int] = {}
        for h, p in zip(hosts, paths, strict=True):
            for e, n in fitting[h]:
                if n <= len(p):
                    probes.setdefault((e, p[:n]), len(probes))
        value = self([_key(e, p) for e, p in probes]).tolist()
        rules, verdicts = [], []
        for h, p in zip(hosts, paths, strict=True):
            found = [(len(e) + n, len(e), e, v) for e, n in fitting[h] if n <= len(p) and (v := value[probes[e, p[:n]]]) >= 0]
            longest = max(found, default=None)
            rules.append(longest and f"{longest[2]}{p[: longest[0] - longest[1]]}")
            verdicts.append(DEFAULT if longest is None else self.verdicts[longest[3]])
        return rules, verdicts


def shipped(spark: SparkSession, content: bytes) -> str:
    """Write content to the shared folder and hand it to every executor; returns the name for SparkFiles.get."""
    name = f"leafmill-{uuid.uuid4().hex}.index"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for i in range(0, len(content), 1 << 20):
        out.write(bytearray(content[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


_open: dict[str, Index] = {}


def opened(name: str) -> Index:
    """The worker's mapping of a file that was shipped; kept for its next task."""
    if name not in _open:
        _open.clear()
        _open[name] = Index(SparkFiles.get(name))
    return _open[name]


# The operator


def host_and_path(url: str | Column = "url") -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end.

    Both are empty for a null url or one without "://".
    """
    url = F.col(url) if isinstance(url, str) else url
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _split(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url").cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))


def indexed_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``verdicts`` by the digest array."""
    name = shipped(pages.sparkSession, index(rules))

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        hosts, paths = strings(batch.column("host")), strings(batch.column("path"))
        rule, verdict = opened(name).judged(hosts, paths)
        yield {"page_id": batch.column("page_id"), "host": batch.column("host"), "path": batch.column("path"), "rule": rule, "verdict": verdict}

    return map_batches(_split(pages), "page_id long,host string,path string,rule string,verdict string", make)


def joined_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``verdicts`` by joins, for lists that are too large for one file.

    The distinct hosts and paths are joined with the rules by every ending of the
    host; a host that a third of the pages hold is one row for each of its paths.
    """
    known = rules.select(F.translate("host", _UPPER, _LOWER).alias("e"), F.col("path").alias("b"), "verdict")
    known = known.groupBy("e", "b").agg(F.min_by("verdict", F.struct(F.col("verdict") != "block", "verdict")).alias("v"))
    split = _split(pages)
    ends = F.expr("transform(sequence(1, size(split(host, '[.]'))), k -> array_join(slice(split(host, '[.]'), k, size(split(host, '[.]'))), '.'))")
    found = (
        split.select("host", "path").distinct().withColumn("e", F.explode(ends)).join(known, "e").where(F.expr("startswith(path, b)"))
        .groupBy("host", "path").agg(F.max(F.struct(F.length("e") + F.length("b"), F.length("e"), F.concat("e", "b").alias("rule"), F.col("v").alias("verdict"))).alias("m"))
    )
    joined = split.join(found, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(DEFAULT)).alias("verdict"))


def verdicts(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    rules: host, path, verdict.  A rule fits its host and all subdomains, for
    paths that begin with its own; the longest that fits (host and path
    together, then host) decides, and without one the verdict is "allow" and the
    rule null.  A rule with a null in it is none.  Of rules with one host and
    path, block stands before other verdicts.

    A null url, one without "://" and an empty host fit no rule.  Rows that
    repeat are judged alike; other columns are not read.
    """
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.select("host", "path", "verdict").dropna()
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    if size <= INDEXED:
        return indexed_verdicts(pages, [tuple(r) for r in rules.collect()])
    return joined_verdicts(pages, rules)


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"), RULES)


OP13_SQL = f"""WITH r(rh, rp, rv) AS (VALUES {", ".join(str(r) for r in RULES)}),
    u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT row_number() OVER () AS i, page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    f AS (SELECT i, max((length(rh) + length(rp), length(rh), rh || rp, rv)) AS m FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i)
    SELECT page_id, host, path, struct_extract_at(m, 3) AS rule, coalesce(struct_extract_at(m, 4), '{DEFAULT}') AS verdict FROM p LEFT JOIN f USING (i)"""
