"""Operator 2: approximate nearest neighbours by cosine, after the SRS method (Sun et al., 2014).

Vectors are scaled to length 1, so the squared distance of two is 2 - 2 cos. They are projected to a few dimensions
with entries from the normal distribution, which is 2-stable: a pair's squared projected distance divided by
its squared distance follows the chi-square distribution with as many degrees of freedom. Each block of candidates
has a kd-tree over the projected points. A query takes leaf after leaf in order of projected distance, verifies
their vectors with the exact measure, and stops when a point as near as its k-th best would, with probability
``SURE``, have been projected nearer than the next leaf: the chi-square test. Every row is indexed, nothing is
sampled, and scores are exact cosines of the original vectors in double precision.

Rows with a null id, a vector that is null or zero, or holds null or not finite components take no part. Only
vectors of equal length are compared. A query never gets a row with its own id; queries with equal ids are answered
together. Equal vectors tie exactly and the smaller id wins: the search goes on through all leaves at distance zero.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from featurewatch.llm.vector_cells import CANDIDATE_ROWS, QUERY_ROWS, search

DIMENSIONS = 8
SURE = 0.95
LEAF = 32
#: Squared distances below this are the same point but for rounding.
ROUNDING = 1e-9


def chi_square_quantile(p: float, dimensions: int) -> float:
    """For an even number of dimensions, whose distribution has a closed form."""
    half = dimensions // 2
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class KdTree:
    """Median splits of the widest dimension. ``nodes``: per node its box and either two children or rows [a, b) of
    ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.low, self.high, self.children, self.rows = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = points[self.order[a:b]]
            node = len(self.low)
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            self.rows.append((a, b))
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > leaf:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, (high - low).argmax()], mid)]
                todo += [(a, a + mid, node), (a + mid, b, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def distances(self, point: np.ndarray) -> list[float]:
        """Squared distance from the point to every node's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1).tolist()

    def nearest_leaves(self, point: np.ndarray):
        """Leaves in order of their distance: (squared distance, rows a, b)."""
        far = self.distances(point)
        heap = [(far[0], 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (far[child], child))
            else:
                yield d, *self.rows[node]


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.sort_by("id").combine_chunks()
    column = table["vector"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return table["id"].to_numpy(), column.flatten().to_numpy().astype(np.float64).reshape(len(table), -1)


def cosines(rows: np.ndarray, lengths: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
    """Row by row in one order of summation, so equal vectors get equal scores."""
    return (rows * query).sum(axis=1) / (lengths * length)


def _cell(k: int, dimensions: int, sure: float, seed: int):
    limit = chi_square_quantile(sure, dimensions)

    def run(queries, candidates):
        out = []
        for size in np.unique(queries["size"].to_numpy()).tolist() if len(queries) and len(candidates) else ():
            same = lambda t, s=size: t.filter(pc.equal(t["size"], s))
            if not len(same(candidates)):
                continue
            (q_ids, asked), (ids, rows) = _vectors(same(queries)), _vectors(same(candidates))
            stable = np.random.default_rng([seed, size]).standard_normal((size, dimensions))
            lengths, asked_lengths = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((asked * asked).sum(axis=1))
            tree = KdTree((rows / lengths[:, None]) @ stable)
            ids, rows, lengths = ids[tree.order], rows[tree.order], lengths[tree.order]
            for own, query, length, point in zip(q_ids.tolist(), asked, asked_lengths, (asked / asked_lengths[:, None]) @ stable, strict=True):
                best_ids, best, worst = np.zeros(0, np.int64), np.zeros(0), math.inf
                for near, a, b in tree.nearest_leaves(point):
                    if near > limit * worst:
                        break
                    score = cosines(rows[a:b], lengths[a:b], query, length)
                    take = ids[a:b] != own
                    if len(best) == k:
                        take &= score >= best[-1]
                    if take.any():
                        best_ids, best = np.r_[best_ids, ids[a:b][take]], np.r_[best, score[take]]
                        order = np.lexsort((best_ids, -best))[:k]
                        best_ids, best = best_ids[order], best[order]
                        if len(best) == k:
                            worst = max(2 - 2 * best[-1], ROUNDING)
                out.append((np.full(len(best), own), best_ids, best))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])
    return run


def nearest(df: DataFrame, queries: Column, k: int = 5, id_col: str = "id", vector_col: str = "vector", dimensions: int = DIMENSIONS,
            sure: float = SURE, seed: int = 7, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id`` and ``score`` (cosine) of the k nearest found for each query;
    ``queries`` is a condition on ``id``."""
    x = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("vector")).filter(
        "id is not null and vector is not null and not exists(vector, v -> v is null or isnan(v) or abs(v) = double('infinity')) "
        "and exists(vector, v -> v <> 0)")
    rows = rows.withColumn("size", F.size("vector"))
    return search(rows, queries, _cell(k, dimensions, sure, seed), k, "double", candidate_rows, query_rows)
