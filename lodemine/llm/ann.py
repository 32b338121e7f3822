"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Vectors are projected by a matrix of normal (2-stable) entries to ``dims`` dimensions, in which a
pair's squared distance is its true one times a chi-square variable of ``dims`` degrees of freedom.
A block's projections are kept in a kd-tree, built once; a query goes down from its root by a queue of
boxes in order of distance, takes its projected neighbours leaf by leaf, verifies each on the original
vectors, and stops when the chance that a vector still beyond the frontier is nearer than the k-th
one found in this and all earlier blocks is below 1 - ``confidence``: when chi2cdf(frontier^2 / d_k^2)
>= confidence. So each true neighbour is found with at least that chance, whatever the data.

Largest inner product is turned into nearest distance by one more component, sqrt(M^2 - |x|^2) with
M the largest norm of the block, and by scaling the query to norm M. Zero vectors take no part; for
the rest of the edge cases see ``vectors``. Nothing is fitted on a sample: the projection is random
from a fixed seed, and every row is indexed. Recall at k = 20 is measured in the tests and stated in
the README.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import read
from lodemine.llm.vectors import Best, nothing, search, usable


def chi2_cdf(x: float, even: int) -> float:
    """Of an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, even // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, even: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, even) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, even) < p else (low, mid)
    return high


class KdTree:
    """order holds the points leaf by leaf. levels[0] are the bounding boxes of the leaves, levels[1]
    those of ``fan`` leaves that follow each other, which are a subtree, and so on up to the root."""

    def __init__(self, points: np.ndarray, leaf: int = 64, fan: int = 16):
        order, ends = np.arange(len(points)), []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                ends.append((a, b))
                continue
            part = points[order[a:b]]
            axis = int((part.max(0) - part.min(0)).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.order, self.leaves, self.fan = order, sorted(ends), fan
        low = np.stack([points[order[a:b]].min(0) for a, b in self.leaves])
        high = np.stack([points[order[a:b]].max(0) for a, b in self.leaves])
        self.levels = [(low, high)]
        while len(low) > 1:
            cuts = np.arange(0, len(low), fan)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((low, high))

    def by_distance(self, p: np.ndarray) -> Iterator[tuple[float, int]]:
        """Squared distance from p and number of each leaf, nearest first. Boxes are opened as their
        turn comes."""
        queue = [(0.0, len(self.levels) - 1, 0)]
        while queue:
            distance, level, at = heapq.heappop(queue)
            if not level:
                yield distance, at
                continue
            low, high = self.levels[level - 1]
            first = at * self.fan
            gap = np.maximum(np.maximum(low[first : first + self.fan] - p, p - high[first : first + self.fan]), 0)
            for i, d in enumerate(np.einsum("ij,ij->i", gap, gap).tolist()):
                heapq.heappush(queue, (d, level - 1, first + i))


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, dims: int = 8, confidence: float = 0.97, leaf: int = 64, seed: int = 5, visited: list[float] | None = None, best: Best | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """visited: gets the share of the leaves that each query verified. best: those found in other
    blocks, which are improved in place."""
    best = best if best is not None else nothing(len(query_ids), np.float64)
    kept = (x != 0).any(1)
    ids, x = ids[kept], x[kept]
    if len(ids):
        unit = float(np.abs(x).max())  # keeps squares in range
        y = x / unit
        squares = (y * y).sum(1)
        most = float(squares.max())
        rest = np.sqrt(np.maximum(most - squares, 0))
        r = np.random.default_rng(seed).normal(size=(x.shape[1] + 1, dims))
        tree = KdTree(np.column_stack([y, rest]) @ r, leaf)
        packed, packed_ids, packed_x = np.ascontiguousarray(y[tree.order]), ids[tree.order], x[tree.order]
        stop, slack = chi2_quantile(confidence, dims), 1e-9 * most
    for j, (qid, v) in enumerate(zip(query_ids, q)) if len(ids) else ():
        if not v.any():
            continue
        largest = float(np.abs(v).max())
        w = v / largest
        norm = math.sqrt(float((w * w).sum()))
        w = w * (math.sqrt(most) / norm)
        held_ids, held = best[j]
        found = np.zeros(0, np.int64)
        # scores as of the scaled vectors; those of earlier blocks stand first
        score = held / largest / unit * (math.sqrt(most) / norm)
        leaves, step, taken = tree.by_distance(w @ r[:-1]), 8, 0
        ahead = next(leaves, None)
        while ahead is not None:
            if len(score) >= k:
                kth = float(np.partition(score, len(score) - k)[len(score) - k])
                if ahead[0] >= stop * max(2 * most - 2 * kth, 0.0):
                    break
            rows = []
            while ahead is not None and len(rows) < step:
                rows.append(np.arange(*tree.leaves[ahead[1]]))
                ahead = next(leaves, None)
            taken, step = taken + len(rows), min(2 * step, 32)
            rows = np.concatenate(rows)
            rows = rows[packed_ids[rows] != qid]
            s = packed[rows] @ w
            if len(score) >= k:
                keep = s >= kth - slack
                rows, s = rows[keep], s[keep]
            found, score = np.concatenate([found, rows]), np.concatenate([score, s])
            if len(score) > 2 * k:  # with all that may tie once rounding is undone
                bar = np.partition(score, len(score) - k)[len(score) - k] - slack
                keep = score >= bar
                keep[: len(held)] = True
                found, score = found[keep[len(held) :]], score[keep]
        if visited is not None:
            visited.append(taken / len(tree.leaves))
        all_ids = np.concatenate([held_ids, packed_ids[found]])
        exact = np.concatenate([held, (packed_x[found] * v).sum(1)])
        order = np.lexsort((all_ids, -exact))[:k]
        best[j] = all_ids[order], exact[order]
    counts = [len(i) for i, _ in best]
    return np.repeat(query_ids, counts).astype(np.int64), np.concatenate([i for i, _ in best] or [np.zeros(0, np.int64)]), np.concatenate([s for _, s in best] or [np.zeros(0)])


def nearest_neighbours(queries: DataFrame, candidates: DataFrame, k: int = 20, dims: int = 8, confidence: float = 0.97, block_rows: int = 32_768, group_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank, vec_id, score: the candidates with the largest inner product found."""
    if dims % 2 or dims < 2:
        raise ValueError("dims has to be even")

    def kernel(ids, x, query_ids, q, best):
        nearest(ids, x, query_ids, q, k, dims, confidence, best=best)

    return search(queries, candidates, kernel, k, "double", block_rows, group_bytes)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(read(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return nearest_neighbours(rows.filter(F.pmod("vec_id", F.lit(20)) == 0), rows)
