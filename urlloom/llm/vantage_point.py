"""Approximate nearest neighbours with vantage-point trees, one for each shard.

Vectors are scaled to length one; Euclidean distance then orders like cosine and is a metric.
A tree node keeps a vantage point and the distances of its points to it; inner and outer
half are searched only if the triangle inequality allows a point close enough, with the
allowance divided by ``relax``. A factor of 1 gives exact results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlloom.llm.common import materialize

LEAF = 128
#: A shard holds so many points, or fewer of many dimensions.
SHARD_ROWS = 8192
SHARD_BYTES = 32 << 20
#: In the tree cosines are known up to rounding; no point within this margin is pruned.
_MARGIN = 1e-11


def dots(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, summed from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(len(q)):
        total = total + a[:, j] * q[j]
    return total


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component to 0.5 to 1: cosines stay bit by bit, and no square leaves the double range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


def cosines(a: np.ndarray, lengths: np.ndarray, q: np.ndarray) -> np.ndarray:
    return dots(a, q) / (lengths * np.sqrt(dots(q[None, :], q)[0]))


class Tree:
    """A vantage-point tree over distinct vectors."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, seed: int = 1):
        vectors = scaled(vectors)
        self.lengths = np.sqrt(_squares(vectors))
        self.vectors, self.units = vectors, vectors / self.lengths[:, None]
        self.nodes: list[tuple] = []
        self._rng, self._leaf = np.random.default_rng(seed), leaf
        if len(vectors):
            self._build(np.arange(len(vectors)))

    def _build(self, ids: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(ids) <= self._leaf:
            self.nodes[at] = (ids,)
            return at
        point = ids[self._rng.integers(len(ids))]
        d = np.linalg.norm(self.units[ids] - self.units[point], axis=1)
        order = np.argsort(d, kind="stable")
        half = len(ids) // 2
        inner, outer = order[:half], order[half:]
        bounds = (d[inner[0]], d[inner[-1]], d[outer[0]], d[outer[-1]])
        a, b = self._build(ids[inner]), self._build(ids[outer])
        self.nodes[at] = (self.units[point], bounds, a, b)
        return at

    def search(self, q: np.ndarray, k: int, relax: float = 1.0) -> list[tuple[float, int]]:
        """The k nearest as (cosine, row), by falling cosine, then row; those within rounding of the last one included."""
        q = scaled(q[None, :])[0]
        unit = q / np.sqrt(dots(q[None, :], q)[0])
        rows, near = np.empty(0, int), np.empty(0)
        radius = np.inf
        stack = [(0.0, 0)] if self.nodes else []
        while stack:
            bound, at = stack.pop()
            if bound > radius / relax:
                continue
            node = self.nodes[at]
            if len(node) == 1:
                c = self.units[node[0]] @ unit
                hit = c >= 1.0 - radius * radius / 2.0
                if hit.any():
                    rows, near = np.concatenate([rows, node[0][hit]]), np.concatenate([near, c[hit]])
                    if len(near) >= k:
                        least = np.partition(near, len(near) - k)[len(near) - k]
                        keep = near >= least - _MARGIN
                        rows, near = rows[keep], near[keep]
                        radius = np.sqrt(max(0.0, 2.0 - 2.0 * least) + 2 * _MARGIN)
                continue
            point, (a0, a1, b0, b1), a, b = node
            d = float(np.linalg.norm(unit - point))
            sides = [(max(bound, a0 - d, d - a1), a), (max(bound, b0 - d, d - b1), b)]
            stack += sorted(sides, reverse=True)
        best = cosines(self.vectors[rows], self.lengths[rows], q)
        return [(float(best[i]), int(rows[i])) for i in np.lexsort((rows, -best))]


def _squares(vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total = total + vectors[:, j] * vectors[:, j]
    return total


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, without null or non-finite components."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    relax: float = 1.0,
    shard_rows: int = SHARD_ROWS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest others of each query by cosine.

    Every usable row is a candidate; rows of the stated query set ask all shards of their
    dimension. A task gets the points of a shard first, builds its tree once, and lets the queries stream past it one
    by one, so it holds one shard. Equal vectors share one point of the tree: of those in a shard the k + 1 with the smallest
    ids are kept, as no other can be among a query's k nearest. Equal scores go to the smaller id.
    A row is no candidate for itself; rows that repeat an id are candidates and queries each on their own.
    Unusable vectors and null ids take no part; without candidates a query has no row.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v"))
    rows = materialize(rows, "vectors")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    fits = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(shard_bytes) / (8 * F.col("dim")))))
    placed = rows.join(F.broadcast(sizes.select("dim", F.ceil(F.col("n") / fits).cast("int").alias("shards"))), "dim")
    # Equal vectors meet in one shard; a salt by row keeps a hot one from filling it.
    first = placed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id", "row"))).filter(F.col("r") <= k + 1)
    points = ranked.groupBy("dim", "shards", "v").agg(F.slice(F.sort_array(F.collect_list(F.struct("id", "row"))), 1, k + 1).alias("owners"))
    points = points.select("dim", F.pmod(F.xxhash64("v"), "shards").cast("int").alias("shard"), F.lit(0).alias("asks"), "v", F.col("owners.id").alias("ids"), F.col("owners.row").alias("rows"))
    queries = placed.filter("asks").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("asks"), "v", F.array("id").alias("ids"), F.array("row").alias("rows"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("dim", "shard", "asks", "ids", "rows")]
                values, offsets = batch.column("v").values.to_numpy(), batch.column("v").offsets.to_numpy()
                for i, (dim, shard, asks, ids, numbers) in enumerate(zip(*cols, strict=True)):
                    yield (dim, shard), asks, values[offsets[i] : offsets[i + 1]], list(zip(ids, numbers, strict=True))

        out: list[tuple[int, int, int, float]] = []
        for _, group in groupby(flat(), key=lambda x: x[0]):
            kept, owners, tree = [], [], None
            for _, asks, v, who in group:
                if not asks:
                    kept.append(v.copy())
                    owners.append(who)
                    continue
                if tree is None:
                    tree = Tree(np.array(kept).reshape(len(kept), len(v)))
                    kept = []
                query, own = who[0]
                # One point can be the query itself, so ask for one more.
                found = [(-c, i, row) for c, at in tree.search(v, k + 1, relax) for i, row in owners[at] if row != own]
                out += [(query, own, i, -c) for c, i, _ in sorted(found)[:k]]
                if len(out) > 20_000:
                    yield _found(out)
                    out = []
        yield _found(out)

    dealt = points.unionByName(queries).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")
    found = dealt.mapInArrow(search, "query_id long, query_row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(out: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.float64())], ["query_id", "query_row", "vec_id", "score"])
