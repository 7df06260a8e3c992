"""Centroid clustering by kd-tree filtering (operator 12).

The vectors, as integers, are dealt into blocks of a bounded number of rows.
Each block is a kd-tree, built once and settled: every node has a count, an
integer sum, a sum of squares and a box.  A round passes the centroids down
each tree (Kanungo et al., 2002): a node's candidates are those that reached
its parent; one that is farther than the candidate nearest to the box's middle
from every point of the box, strictly, is pruned; a node with one candidate is
assigned whole, by its count and sum; in the leaves what is left is resolved by
exact distances.  Everything is integer arithmetic, so results don't depend on
the order of additions.

A round reads the settled blocks once and shuffles one row a cluster and task;
only k sums come to the driver.  Vectors are never shuffled, so a vector that a
third of all rows repeat makes boxes without extent, which are assigned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import ARROW, settle, table

#: Components, clusters, rounds and the seed of operator 12.
DIM, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Vectors of a block and, at most, of a leaf.
BLOCK, LEAF = 4096, 32
#: Integers are below this in size, so that 64 squared differences fit 64 bits.
BOUND = 1 << 27
#: Below this, 64 products are whole numbers in doubles.
FAST = 1 << 22


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id (long) and q (array of dim integers floor(scale * x)) of the vectors that are kept.

    Kept are arrays of exactly ``dim`` components, none null or not finite, and
    none so large that squared distances leave 64 bits (scale * x of 2**27 and
    more in size).  Rows that repeat are vectors of their own, and so are rows
    without a vec_id.
    """
    x = F.col("x")
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(F.size(x) == dim)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < BOUND))
    return some.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


def seeds(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest sha256 of "seed:vec_id", in that order (fewer if there are fewer); rows without an id come last, ties go by components."""
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k)
    return np.array([r["q"] for r in first.collect()], np.int64)


# Trees


def _cuts(n: int, levels: int) -> list[np.ndarray]:
    """Bounds of the nodes of each level over n rows."""
    return [np.arange((1 << d) + 1) * n >> d for d in range(levels + 1)]


def _levels(n: int) -> int:
    d = 0
    while n >> d > LEAF:
        d += 1
    return d


def tree(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the rows, nodes): each node halves its rows by the widest side of its box; nodes level by level, the root first."""
    n, levels = len(x), _levels(len(x))
    order = np.arange(n)
    lo, hi = [], []
    for d, cut in enumerate(_cuts(n, levels)):
        y = x[order]
        lo.append(np.minimum.reduceat(y, cut[:-1], axis=0))
        hi.append(np.maximum.reduceat(y, cut[:-1], axis=0))
        if d == levels:
            break
        wide = np.argmax(hi[-1] - lo[-1], axis=1)
        for a, z, side in zip(cut[:-1].tolist(), cut[1:].tolist(), wide.tolist(), strict=True):
            order[a:z] = order[a:z][np.argpartition(y[a:z, side], (z - a) // 2)]
    y = x[order].astype(np.int64)
    sums, squares = np.zeros((n + 1, x.shape[1]), np.int64), np.zeros(n + 1, object)
    np.cumsum(y, axis=0, out=sums[1:])
    squares[1:] = np.cumsum((y * y).sum(axis=1).astype(object))
    cuts = _cuts(n, levels)
    return order, {
        "lo": np.concatenate(lo), "hi": np.concatenate(hi), "sum": np.concatenate([np.diff(sums[c], axis=0) for c in cuts]),
        "square": np.concatenate([np.diff(squares[c]) for c in cuts]),
    }


BLOCKS = "n long, ids binary, known binary, rows binary, lo binary, hi binary, sums binary, squares array<string>"


def blocks(kept: DataFrame, dim: int = DIM) -> DataFrame:
    """A settled row for each block: ids, vectors in tree order, and nodes."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    schema = pa.schema([(c, pa.int64() if c == "n" else pa.list_(pa.string()) if c == "squares" else pa.binary()) for c in names])

    def row(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order, nodes = tree(x)
        known = ids.is_valid().to_numpy(zero_copy_only=False)[order]
        made = [len(x), ids.fill_null(0).to_numpy()[order].astype(np.int64).tobytes(), np.packbits(known).tobytes(), x[order].tobytes(), nodes["lo"].tobytes(), nodes["hi"].tobytes(), nodes["sum"].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*made, [str(s) for s in nodes["square"]]], schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids.append(part.column("vec_id"))
                rows.append(part.column("q").flatten().to_numpy().reshape(-1, dim).astype(np.int32))
                held += part.num_rows
                if held >= BLOCK:
                    yield row(pa.concat_arrays(ids), np.concatenate(rows))
                    ids, rows, held = [], [], 0
        if held:
            yield row(pa.concat_arrays(ids), np.concatenate(rows))

    return settle(kept.mapInArrow(run, BLOCKS))


def _block(batch: pa.RecordBatch, i: int, dim: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    nodes = {c: get(c, np.int32).reshape(-1, dim).astype(np.int64) for c in ("lo", "hi")}
    nodes["sum"] = get("sums", np.int64).reshape(-1, dim)
    nodes["square"] = np.array([int(s) for s in batch.column("squares")[i].as_py()], object)
    return get("rows", np.int32).reshape(-1, dim), nodes


# Filtering


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < FAST and x.shape[1] <= 64:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(axis=1) for c in centroids.astype(np.int64)], axis=1)


def _pruned(lo: np.ndarray, hi: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The candidates of each node without those that are strictly dominated by the one nearest to its middle."""
    far = np.iinfo(np.int64).max
    near = np.argmin(np.where(alive, distances(lo + hi, 2 * centroids), far), axis=1)
    best = centroids[near]
    kept = alive.copy()
    for z, c in enumerate(centroids):
        open_ = np.flatnonzero(alive[:, z] & (near != z))
        if len(open_):
            b = best[open_]
            corner = np.where(c > b, hi[open_], lo[open_])  # the point of the box that is best for z against the nearest
            kept[open_, z] = ((c - corner) ** 2).sum(axis=1) <= ((b - corner) ** 2).sum(axis=1)
    return kept


def filtered(rows: np.ndarray, nodes: dict[str, np.ndarray], centroids: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """How a block's vectors go to the nearest centroids (of several, that of the smallest number).

    Yields ("whole", nodes, cluster of each) for nodes that are assigned whole and
    ("leaf", rows, cluster of each) for vectors that leaves resolve.  Centroids
    must differ.
    """
    n, levels = len(rows), _levels(len(rows))
    at, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    for d, cut in enumerate(_cuts(n, levels)):
        base = (1 << d) - 1
        alive = _pruned(nodes["lo"][base + at], nodes["hi"][base + at], alive, centroids)
        one = alive.sum(axis=1) == 1
        if one.any():
            yield "whole", base + at[one], np.argmax(alive[one], axis=1)
        at, alive = at[~one], alive[~one]
        if not len(at):
            return
        if d < levels:
            at, alive = np.repeat(2 * at, 2) + np.tile([0, 1], len(at)), np.repeat(alive, 2, axis=0)
            continue
        sizes = cut[at + 1] - cut[at]
        first = np.cumsum(sizes) - sizes
        row = np.arange(sizes.sum()) + np.repeat(cut[at] - first, sizes)
        open_ = np.repeat(alive, sizes, axis=0)
        yield "leaf", row, np.argmin(np.where(open_, distances(rows[row], centroids), np.iinfo(np.int64).max), axis=1)


def _distinct(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids that equal none before them, and their numbers."""
    _, first = np.unique(centroids, axis=0, return_index=True)
    first = np.sort(first)
    return centroids[first], first


def _node_bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    cuts = _cuts(n, _levels(n))
    return np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])


def sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray, int]]:
    """By cluster: how many vectors it has, their sum, and their summed squared distance; clusters without vectors are left out."""
    dim = centroids.shape[1]
    own, number = _distinct(centroids)
    ddl = "cluster int, part int, total decimal(38,0)"
    schema = pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(own), dim + 2), object)
        for batch in batches:
            for i in range(batch.num_rows):
                rows, nodes = _block(batch, i, dim)
                first, last = _node_bounds(len(rows))
                for kind, at, cluster in filtered(rows, nodes, own):
                    for c in np.unique(cluster):
                        some = at[cluster == c]
                        if kind == "whole":
                            count, s, square = int((last - first)[some].sum()), nodes["sum"][some].sum(axis=0), sum(nodes["square"][some])
                        else:
                            x = rows[some].astype(np.int64)
                            count, s, square = len(some), x.sum(axis=0), sum((x * x).sum(axis=1).tolist())
                        s, z = s.astype(object), own[c].astype(object)
                        total[c] += np.array([count, square - 2 * (s * z).sum() + count * (z * z).sum(), *s], object)
        c, p = np.nonzero(np.broadcast_to(total[:, :1] > 0, total.shape))
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(number[c], pa.int32()), pa.array(p, pa.int32()), pa.array([Decimal(int(v)) for v in total[c, p]], pa.decimal128(38, 0))], schema=schema)

    found: dict[int, list] = {}
    for r in trees.select("rows", "lo", "hi", "sums", "squares").mapInArrow(run, ddl).groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect():
        found.setdefault(r["cluster"], [0] * (dim + 2))[r["part"]] = int(r["total"])
    return {c: (v[0], np.array(v[2:], object), v[1]) for c, v in found.items()}


def fitted(trees: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds; the mean of a cluster is rounded down, an empty cluster keeps its centroid."""
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, s, _) in sums(trees, centroids).items():
            centroids[c] = [v // n for v in s]
    return centroids


ASSIGNED = "vec_id long, cluster int, distance long"


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    dim = centroids.shape[1]
    own, number = _distinct(centroids)
    schema = pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in ASSIGNED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, nodes = _block(batch, i, dim)
                cluster = np.zeros(len(rows), np.int64)
                first, last = _node_bounds(len(rows))
                for kind, at, c in filtered(rows, nodes, own):
                    if kind == "leaf":
                        cluster[at] = c
                    else:
                        for a, z, k in zip(first[at].tolist(), last[at].tolist(), c.tolist(), strict=True):
                            cluster[a:z] = k
                far = ((rows.astype(np.int64) - own[cluster]) ** 2).sum(axis=1)
                known = np.unpackbits(np.frombuffer(batch.column("known")[i].as_py(), np.uint8))[: len(rows)].astype(bool)
                ids = pa.array(np.frombuffer(batch.column("ids")[i].as_py(), np.int64), mask=~known)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number[cluster], pa.int32()), pa.array(far)], schema=schema)

    return trees.mapInArrow(run, ASSIGNED)


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """(assignment of every kept vector, final centroids, summed squared distance of each cluster).

    Which vectors are kept is said in ``quantised``, the first centroids in
    ``seeds``; ties of distance go to the smaller number, so of equal centroids
    all but the first stay empty.  Without vectors all three are empty.
    """
    kept = quantised(vectors, dim, scale)
    trees = blocks(kept, dim)
    centroids = seeds(kept, k, seed)
    if not len(centroids):
        return trees.sparkSession.createDataFrame([], ASSIGNED), centroids.reshape(0, dim), {}
    centroids = fitted(trees, centroids, rounds)
    return assigned(trees, centroids), centroids, {c: v[2] for c, v in sums(trees, centroids).items()}


def digests(vectors: DataFrame) -> DataFrame:
    """Operator 12's contract."""
    rows, centroids, inertia = clustered(vectors)
    spark = rows.sparkSession
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(c, v, sum(inertia.values()), sha[c]) for c, v in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds as common table expressions: q has a row for each vector and component, c<r> one for each centroid and component."""
    x = f"[floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding]"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, {x} AS q FROM embeddings WHERE len(embedding) = {DIM} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x) AND abs({SCALE} * x::DOUBLE) < {BOUND}]) = {DIM})",
        "q AS MATERIALIZED (SELECT id, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM v)",
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < {CLUSTERS})",
        "c0 AS MATERIALIZED (SELECT k, unnest(q) AS z, generate_subscripts(q, 1) AS d FROM s)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT id, k, sum((x - z) * (x - z))::BIGINT AS far FROM q JOIN c{r} USING (d) GROUP BY id, k)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT id, min((far, k)) AS best FROM d{r} GROUP BY id)")
        mean = f"(SELECT struct_extract_at(best, 2) AS k, d, sum(x)::HUGEINT AS s, count(*) AS n FROM a{r} JOIN q USING (id) GROUP BY ALL)"
        floor = "CASE WHEN s IS NULL THEN z ELSE ((s - ((s % n + n) % n)) // n)::BIGINT END"
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, {floor} AS z, d FROM c{r} LEFT JOIN {mean} m USING (k, d))")
    last = f"""f AS (SELECT vec_id, struct_extract_at(best, 2)::INT AS cluster, struct_extract_at(best, 1) AS distance FROM a{ROUNDS} JOIN v USING (id)),
        t AS (SELECT k::INT AS cluster, sha256(string_agg(z::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
        SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
        FROM f JOIN t USING (cluster)"""
    return "WITH " + ", ".join([*parts, last])


OP12_SQL = _sql()
