"""Exact top-k search by Fagin's threshold algorithm.

A block keeps, for each dimension, the list of its vectors sorted by that component. For a query
all lists are read in parallel from the end that its component favours; a vector met for the first
time is scored in full, and the search stops when the score that a vector not met yet could reach
(the sum of query component times the value last read in each list) is below the k-th best score.
That is the k-th of all blocks so far, so that of later blocks little or nothing is read. The search
goes on while the two are equal, so that ties go to the smaller id. Lists are read in steps that
double. What the rows without results, nulls and repeated ids mean: see ``vectors``.

Components are floor(scale * x), as whole numbers; components and scores beyond the range of long are
saturated, scores after the best of a block have been chosen by their exact values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import read
from lodemine.llm.vectors import Best, nothing, search, usable


def threshold_topk(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, first: int = 16, best: Best | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, q: whole numbers. ids ascending. The k best of each query but for its own id; best: those of
    other blocks, which are improved in place."""
    n, d = x.shape
    best = best if best is not None else nothing(len(query_ids), np.int64)
    largest = max(1.0, float(np.abs(x).max(initial=0))) * max(1.0, float(np.abs(q).max(initial=0))) * d
    # a type in which all sums are exact
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64 if largest < 2**62 else object
    whole = (lambda y: np.array([[int(c) for c in row] for row in y], dtype=object).reshape(y.shape)) if kind is object else (lambda y: np.ascontiguousarray(y, dtype=kind))
    lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
    x, q = whole(x), whole(q)
    values = np.take_along_axis(x, lists.T, axis=0).T.copy()
    for j, (qid, v) in enumerate(zip(query_ids, q)):
        up, down = np.flatnonzero(v > 0), np.flatnonzero(v < 0)
        top_i, top_s = best[j]

        def reach(at: int) -> int:
            """What a vector beyond the first at of each list could score."""
            return int((v[up] * values[up, n - 1 - at]).sum()) + int((v[down] * values[down, at]).sum())

        if len(top_s) == k and top_s[-1] > reach(0):
            continue
        seen = ids == qid
        at, to = 0, min(first, n)
        while True:
            if len(up) + len(down):
                fresh = np.zeros(n, bool)
                fresh[lists[up, n - to : n - at]] = True
                fresh[lists[down, at:to]] = True
                fresh &= ~seen
            else:
                fresh = ~seen  # every score is 0
            seen |= fresh
            new = np.flatnonzero(fresh)
            if len(new):
                s = (x @ v)[new] if 3 * len(new) > n else x[new] @ v
                s = s if kind is object else s.astype(np.int64)
                if len(top_s) == k:  # only what is no worse than the k-th
                    keep = s >= top_s[-1]
                    new, s = new[keep], s[keep]
                elif len(s) > 4 * k:
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                    new, s = new[keep], s[keep]
                i, s = np.concatenate([top_i, ids[new]]), np.concatenate([top_s, s])
                order = np.lexsort((i, -s))[:k] if kind is not object else np.array(sorted(range(len(s)), key=lambda r: (-s[r], i[r]))[:k], int)
                top_i, top_s = i[order], s[order]
            if to >= n or not len(up) + len(down):
                break
            if len(top_s) == k and top_s[-1] > reach(to - 1):
                break
            at, to = to, min(2 * to, n)
        if kind is object:
            top_s = np.array([min(max(int(c), -(2**63)), 2**63 - 1) for c in top_s], np.int64)
        best[j] = top_i, top_s
    counts = [len(i) for i, _ in best]
    return np.repeat(query_ids, counts).astype(np.int64), np.concatenate([i for i, _ in best]), np.concatenate([s for _, s in best])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0, block_rows: int = 32_768, group_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank, vec_id, score: the candidates with the largest inner product."""

    def whole(y: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(scale * y), -(2.0**63), 2.0**63 - 1024)

    def kernel(ids, x, query_ids, q, best):
        threshold_topk(ids, whole(x), query_ids, whole(q), k, best=best)

    return search(queries, candidates, kernel, k, "long", block_rows, group_bytes)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(read(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return top_k(rows.filter(F.pmod("vec_id", F.lit(50)) == 0), rows)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] for i in range(1, len(c.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
