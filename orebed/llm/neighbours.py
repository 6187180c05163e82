"""Nearest neighbours by collision-counting hashing with query-aware windows.

A hash function is one random projection, kept as a sorted array (after Gan et al., "Collision counting", SIGMOD 2012, and Huang
et al., "Query-aware LSH", VLDB 2015). A query's window on each array is centred on its own projection and covers WIDTH times
the radius on either side; virtual rehashing grows the radius by GROWTH, and each round counts only what the windows gained. A
vector that collides in `threshold` arrays is verified by its true cosine. The search ends when the k-th best verified vector
lies within the radius: each vector within the radius reaches the threshold with probability 1 - MISS at least.

Vectors are dealt to blocks, each of which one task indexes; the queries then stream past it, so memory holds one block and a batch
of queries, and neither side is broadcast. A vector is shuffled once, a query once for each block, and each block gives k rows for
a query at most. Queries that are a fixed share of all rows so cost rows times queries, as far as windows don't spare it: on unit
vectors whose neighbours are far (cosines near 0), windows come to hold most of a block.

Rows: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without vec_id. Vectors of
different lengths aren't neighbours. A vec_id that repeats among queries asks once (with its least vector); no row with the query's
own vec_id is its neighbour. Rows with equal vectors tie and go by vec_id; each repeat of a row is a neighbour. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.llm.frames import pick
from orebed.session import written

#: More than what rounding does to a cosine.
SLACK = 1e-12


@dataclass(frozen=True)
class Search:
    """block_values: components of a block's vectors at most, about. least_rows: a block has no fewer, if it's for more tasks alone."""

    projections: int = 64
    width: float = 1.2
    growth: float = 1.2
    radius: float = 0.3
    miss: float = 0.02
    block_values: int = 1 << 22
    least_rows: int = 4096
    seed: int = 7

    @property
    def threshold(self) -> int:
        """Collisions that a vector on the radius's edge reaches with probability 1 - miss."""
        p, m = erf(self.width / sqrt(2)), self.projections
        tail, n = 0.0, m
        while n > 0 and (tail := tail + comb(m, n) * p**n * (1 - p) ** (m - n)) < 1 - self.miss:
            n -= 1
        return max(n, 1)


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Index:
    """The sorted projections of one block of unit vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, search: Search) -> None:
        self.vectors, self.ids, self.search = vectors, ids, search
        self.lines = np.random.default_rng(search.seed).standard_normal((search.projections, vectors.shape[1]))
        hashes = (vectors @ self.lines.T).T
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """For each query (cosine, id), best first, equal ones by id."""
        out: list[list[tuple[float, int]]] = []
        for at in range(0, len(queries), 64):
            out += self._nearest(queries[at : at + 64], own[at : at + 64], k)
        return out

    def _nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        s, n, m = self.search, len(self.ids), self.search.projections
        centres = queries @ self.lines.T
        low = np.stack([np.searchsorted(self.sorted[i], centres[:, i]) for i in range(m)], axis=1)
        high, counts = low.copy(), np.zeros((len(queries), n), np.int16)
        best: list[list[tuple[float, int]]] = [[] for _ in queries]
        asked = np.zeros((len(queries), n), bool)
        active, radius = np.arange(len(queries)), s.radius
        while len(active):
            half = s.width * radius
            to_low = np.stack([np.searchsorted(self.sorted[i], centres[active, i] - half) for i in range(m)], axis=1)
            to_high = np.stack([np.searchsorted(self.sorted[i], centres[active, i] + half, side="right") for i in range(m)], axis=1)
            left = []
            for row, q in enumerate(active.tolist()):
                gained = [self.order[i, a:b] for i, (a, b) in enumerate(zip(to_low[row].tolist(), low[q].tolist())) if a < b]
                gained += [self.order[i, a:b] for i, (a, b) in enumerate(zip(high[q].tolist(), to_high[row].tolist())) if a < b]
                if gained:
                    counts[q] += np.bincount(np.concatenate(gained), minlength=n).astype(np.int16)
                low[q], high[q] = np.minimum(low[q], to_low[row]), np.maximum(high[q], to_high[row])
                found = np.flatnonzero((counts[q] >= s.threshold) & ~asked[q])
                if len(found):
                    asked[q, found] = True
                    found = found[self.ids[found] != own[q]]
                    cosines = self.vectors[found] @ queries[q]
                    if len(found) > k:  # whatever ties with the k-th stays
                        found = found[cosines >= np.partition(cosines, -k)[-k] - SLACK]
                    # summed row by row: a product of matrices rounds equal vectors differently by their place, which breaks ties
                    cosines = (self.vectors[found] * queries[q]).sum(axis=1)
                    best[q] = sorted([*best[q], *zip((-cosines).tolist(), self.ids[found].tolist())])[:k]
                done = len(best[q]) == k and sqrt(max(0.0, 2 + 2 * best[q][-1][0])) <= radius
                if not done and (low[q].any() or (high[q] < n).any()):  # else the windows cover all
                    left.append(q)
            active, radius = np.array(left, int), radius * s.growth
        return [[(-c, i) for c, i in rows] for rows in best]


def _results(index: Index | None, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """What a block answers to a batch of queries."""
    ids = batch["vec_id"].to_numpy()
    out: list[tuple[int, int, float]] = []
    if index is not None:
        points = unit(batch["embedding"].flatten().to_numpy().reshape(len(ids), -1))
        out = [(q, i, c) for q, found in zip(ids.tolist(), index.nearest(points, ids, k)) for c, i in found]
    q, i, c = zip(*out) if out else ((), (), ())
    return pa.record_batch({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(c, pa.float64())})


def _searched(batches: Iterator[pa.RecordBatch], k: int, search: Search) -> Iterator[pa.RecordBatch]:
    """The answers of all blocks. Batches are sorted by n, block and asks: a block's vectors come before its queries."""
    block, held, index = None, [], None
    for batch in batches:
        places = np.stack([batch["n"].to_numpy(), batch["block"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)], axis=1)
        cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), len(places)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            part, (n, number, asks) = batch.slice(start, end - start), places[start].tolist()
            if (n, number) != block:
                block, held, index = (n, number), [], None
            if not asks:
                held.append((part["vec_id"].to_numpy(), unit(part["embedding"].flatten().to_numpy().reshape(end - start, -1))))
                continue
            if held:
                index = Index(np.concatenate([v for _, v in held]), np.concatenate([i for i, _ in held]), search)
                held = []
            yield _results(index, part, k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: vec_id, embedding."""
    spark = vectors.sparkSession
    typed = F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    kept = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = pick(vectors, "vec_id", "embedding").where(kept).select(*typed)
    asked = pick(queries, "vec_id", "embedding").where(kept).select(*typed)
    asked = written(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.size("embedding")).alias("components")).first()
    for_memory = -(-(size["components"] or 0) // search.block_values)
    for_tasks = min(spark.sparkContext.defaultParallelism, size["rows"] // search.least_rows)
    blocks = max(1, for_memory, for_tasks)
    n = F.size("embedding").alias("n")
    # dealt by place in the input: no key can crowd a block
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")
    held = rows.select(n, block, F.lit(False).alias("asks"), "vec_id", "embedding")
    asking = asked.select(n, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "embedding")
    dealt = held.unionByName(asking).repartitionById(blocks, "block").sortWithinPartitions("n", "block", "asks")
    found = dealt.mapInArrow(lambda batches: _searched(batches, k, search), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
