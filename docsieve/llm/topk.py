"""Exact top-k inner-product search: ball-tree branch and bound in each shard, the k-th score shared between shards.

Vectors are cut into shards by a hash of their id. A task sorts one shard to the front of its rows, builds a ball tree
over it, and then streams the queries of the shard through the tree in blocks, so memory is one shard, its tree and one
block. Nodes are ordered by their upper bound (query times centre plus query norm times radius); a subtree or leaf below
the query's current k-th score is left out. Equal vectors of a shard are one point that holds their k + 1 smallest ids:
more of them can never be in one answer.

Two rounds share the bound: each query first meets one shard, and the k-th score found there goes with it to all others.
Queries are a stated set and meet the shards in blocks; only (query, shard) rows and k results of each are moved.

Vectors that are null or empty, or hold a null or non-finite component, and rows without an id take no part. Rows with one id
and one vector count once. Only vectors with as many components as the query are its candidates. Ties go to the smaller
id. Scores are exact as long as they fit a 64-bit integer. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.text import share
from docsieve.session import materialize

SHARD_ROWS = 16_384  # vectors of a shard
LEAF_ROWS = 256  # points of a leaf
QUERY_BLOCK = 512  # queries that go through a tree together
EXACT = 2.0**53  # up to here a float64 product of integers is exact
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, as integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


class BallTree:
    """A binary tree over distinct points, split at the median of the widest component; leaves hold ``leaf`` points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.points, self.order = points.astype(np.float64), np.arange(len(points))
        self.centre, self.radius, self.child, self.span = [], [], [], []
        self._grow(0, len(points), leaf)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.points = self.points[self.order]

    def _grow(self, start: int, end: int, leaf: int) -> int:
        own, node = self.points[self.order[start:end]], len(self.child)
        centre = own.mean(axis=0)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
        self.span.append((start, end))
        self.child.append(None)
        if end - start > leaf:
            middle = (end - start) // 2
            wide = int(np.argmax(np.ptp(own, axis=0)))
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, wide], middle)]
            self.child[node] = (self._grow(start, start + middle, leaf), self._grow(start + middle, end, leaf))
        return node


class Shard:
    """The distinct vectors of one length in a shard, with the smallest ids of each, ready for search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int):
        distinct, which = np.unique(vectors, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), ids]), axis=1)
        starts = np.searchsorted(pairs[0], np.arange(len(distinct)))
        self.tree = BallTree(distinct)
        self.integers = distinct[self.tree.order]
        self.largest = float(np.abs(distinct).max(initial=0)) * max(1, distinct.shape[1])
        ends = np.minimum(np.append(starts[1:], pairs.shape[1]), starts + keep)
        self.ids = [pairs[1, a:b] for a, b in zip(starts[self.tree.order], ends[self.tree.order], strict=True)]

    def search(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query row, id, score) of the k best of each query that reach its bound."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q**2).sum(axis=1))
        upper = q @ self.tree.centre.T + norm[:, None] * self.tree.radius
        upper += 1e-9 * (np.abs(upper) + norm[:, None]) + 1e-6  # rounding never hides a point
        exact = self.largest * float(np.abs(q).max(initial=0)) < EXACT
        heaps: list[list[tuple[int, int]]] = [[] for _ in queries]
        bound = bound.astype(np.float64).copy()
        # Down the tree: a query goes on to the children of the nodes that can still reach its bound.
        frontier, waiting = [(0, np.flatnonzero(upper[:, 0] >= bound))], []
        while frontier:
            node, rows = frontier.pop()
            if len(rows) == 0:
                continue
            if self.tree.child[node] is None:
                waiting.append((node, rows))
                continue
            for child in self.tree.child[node]:
                frontier.append((child, rows[upper[rows, child] >= bound[rows]]))
        # The leaves of each query by falling bound, in rounds: each query visits its next best leaf.
        if not waiting:
            return
        rows = np.concatenate([r for _, r in waiting])
        leaves = np.concatenate([np.full(len(r), n) for n, r in waiting])
        order = np.lexsort((-upper[rows, leaves], rows))
        rows, leaves = rows[order], leaves[order]
        turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
        for t in range(int(turn.max()) + 1):
            at = turn == t
            r, n = rows[at], leaves[at]
            live = upper[r, n] >= bound[r]
            r, n = r[live], n[live]
            for leaf in np.unique(n):
                self._visit(leaf, r[n == leaf], queries, q, own, bound, heaps, k, exact)
        for row, best in enumerate(heaps):
            for score, negative in best:
                yield row, -negative, score

    def _visit(self, leaf, rows, queries, q, own, bound, heaps, k, exact) -> None:
        start, end = self.tree.span[leaf]
        if exact:
            scores = (q[rows] @ self.tree.points[start:end].T).astype(np.int64)
        else:
            scores = queries[rows] @ self.integers[start:end].T
        for row, line in zip(rows, scores, strict=True):
            # Points under the bound, or under the k + 1 best of this leaf, cannot be among the k best.
            floor = bound[row]
            if len(line) > k + 1:
                floor = max(floor, float(np.partition(line, len(line) - k - 1)[len(line) - k - 1]))
            best = heaps[row]
            for point in np.flatnonzero(line >= floor):
                best.extend((int(line[point]), -int(i)) for i in self.ids[start + point] if i != own[row])
            best.sort(reverse=True)
            del best[k:]
            if len(best) == k:
                bound[row] = max(bound[row], float(best[-1][0]))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _search_partition(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, width and role; vectors (role 0) of a shard are gathered, its queries streamed."""
    group, ids, vectors, shard, waiting = None, [], [], None, []

    def flush(part: list[tuple]) -> Iterator[pa.RecordBatch]:
        if shard is None or not part:
            return
        own, bound = np.array([p[0] for p in part]), np.array([p[2] for p in part], dtype=np.float64)
        found = list(shard.search(np.stack([p[1] for p in part]), own, bound, k))
        if found:
            row, vec, score = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_pydict({"query_id": own[row], "vec_id": vec, "score": score})

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "width", "role")], axis=1)
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1 if len(keys) else []
        for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if start == end:
                continue
            place, width, role = (int(x) for x in keys[start])
            part = batch.slice(start, end - start)
            if group != (place, width):
                yield from flush(waiting)
                group, ids, vectors, shard, waiting = (place, width), [], [], None, []
            rows = _matrix(part.column("v"), width)
            own = part.column("vec_id").to_numpy()
            if role == 0:
                ids.append(own)
                vectors.append(rows)
                continue
            if shard is None and ids:
                shard, ids, vectors = Shard(np.concatenate(ids), np.concatenate(vectors), k + 1), [], []
            waiting.extend(zip(own, rows, part.column("bound").to_numpy(), strict=True))
            while len(waiting) >= QUERY_BLOCK:
                yield from flush(waiting[:QUERY_BLOCK])
                waiting = waiting[QUERY_BLOCK:]
    yield from flush(waiting)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best other rows of each row that meets ``queries``: query_id, rank, vec_id, score.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not used.
    """
    own = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), queries.alias("asks")
    )
    own = materialize(own.withColumn("width", F.size("v")), "vectors")
    shards = share(own, shard_rows)
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    asked = own.filter("asks").select("vec_id", "v", "width").distinct()
    data = own.select(shard.alias("shard"), "width", F.lit(0).alias("role"), "vec_id", "v", F.lit(float("-inf")).alias("bound"))

    def run(asks: DataFrame) -> DataFrame:
        rows = data.unionByName(asks.select("shard", "width", F.lit(1).alias("role"), "vec_id", "v", "bound"))
        placed = rows.repartition("shard").sortWithinPartitions("shard", "width", "role")
        return placed.mapInArrow(lambda batches: _search_partition(batches, k), FOUND)

    first = materialize(run(asked.select("*", shard.alias("shard"), F.lit(float("-inf")).alias("bound"))), "pilot")
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bound = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(float("-inf"))
    others = F.array_remove(F.sequence(F.lit(0), F.lit(shards - 1)), shard)
    rest = asked.join(reached, asked["vec_id"] == reached["query_id"], "left").select(
        "vec_id", "v", "width", bound.alias("bound"), F.explode(others).alias("shard")
    )
    best = _best(first.unionByName(run(rest)), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
