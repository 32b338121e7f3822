"""Linear models per cluster: L2-regularised squared hinge with a regularised intercept.

One task fits one cluster by Newton steps on the primal with a line search. Negatives that all
clusters share are sent once to each executor if they fit the given bound. Beyond it a part of that
size is sent, all are scored by the fitted models, those inside a cluster's margin join its rows, and
the fit is repeated until none is left out: rows outside the margin have no part in the loss, so that
the result is the fit on all.

Clusters with more rows than a task should hold are fitted together by Newton steps whose gradients and
products with the second derivative are sums over all rows: each is a pass over the table, of which one
vector a cluster comes back.

Two more kinds of model can be asked for: ``hinge`` (the plain hinge with a free intercept, by sequential
minimal optimisation of the dual) and ``sgd`` (averaged stochastic steps on the regularised hinge).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemine.operators.tiles import crowded
from lodemine.sources.rounds import clear, settle

MODEL = "cluster_id long, w array<double>, rho double, first_label int, n_pos long, n_neg long"


def fit_squared_hinge(x: np.ndarray | list[np.ndarray], y: np.ndarray, c: float = 0.1, steps: int = 50, tol: float = 1e-10, part_mb: int = 8) -> tuple[np.ndarray, float]:
    """Minimises |(w, b)|^2 / 2 + c * sum(max(0, 1 - y (x w + b))^2). With one class only, the zero
    model with an intercept of that class. x: rows, or blocks of them, which are read in parts of
    ``part_mb`` as doubles and never copied whole."""
    blocks = [b for b in (x if isinstance(x, list) else [x]) if len(b)]
    width = blocks[0].shape[1] if blocks else x[0].shape[-1] if isinstance(x, list) and x else x.shape[1]
    if len(set(y.tolist())) < 2:
        return np.zeros(width), float(y[0]) if len(y) else 0.0
    starts = np.cumsum([0, *map(len, blocks)])
    most = max(1, (part_mb << 20) // (8 * (width + 1)))
    parts = [(b, i, min(i + most, len(b)), at + i) for b, at in zip(blocks, starts) for i in range(0, len(b), most)]
    v = np.zeros(width + 1)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        slack = np.empty(len(y))
        for block, i, j, at in parts:
            slack[at : at + j - i] = np.asarray(block[i:j], float) @ v[:-1] + v[-1]
        slack = np.maximum(0, 1 - y * slack)
        return 0.5 * v @ v + c * (slack @ slack), slack

    def live(slack: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows with slack, with a column of ones, and y times their slack."""
        for block, i, j, at in parts:
            own = slack[at : at + j - i] > 0
            rows = np.asarray(block[i:j][own], float)
            yield np.column_stack([rows, np.ones(len(rows))]), (y[at : at + j - i] * slack[at : at + j - i])[own]

    value, slack = loss(v)
    for _ in range(steps):
        grad = v - 2 * c * sum(b.T @ s for b, s in live(slack))
        if np.abs(grad).max() < tol:
            break
        if (slack > 0).sum() < width + 1:  # (I + 2c B'B)^-1 g by the smaller system
            b = np.concatenate([b for b, _ in live(slack)])
            small = np.eye(len(b)) + 2 * c * (b @ b.T)
            step = grad - 2 * c * (b.T @ np.linalg.solve(small, b @ grad))
        else:
            step = np.linalg.solve(np.eye(width + 1) + 2 * c * sum(b.T @ b for b, _ in live(slack)), grad)
        t = 1.0
        while True:
            new, fresh = loss(v - t * step)
            if new <= value - 1e-4 * t * (grad @ step) or t < 1e-8:
                break
            t /= 2
        v, value, slack = v - t * step, new, fresh
    return v[:-1], float(v[-1])


def fit_hinge(x: np.ndarray, y: np.ndarray, c: float = 0.1, tol: float = 1e-6, steps: int = 200_000) -> tuple[np.ndarray, float]:
    """Minimises |w|^2 / 2 + c * sum(max(0, 1 - y (x w + b))), b being free, by its dual: the two
    multipliers that violate the conditions of an optimum most are moved along y'a = 0."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1]), float(y[0]) if len(y) else 0.0
    a, w, square = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(1)
    up, low = y > 0, y < 0  # may y a grow, may it fall
    value = y.copy()  # y times the negative gradient: y - x w
    for _ in range(steps):
        i = int(np.where(up, value, -np.inf).argmax())
        gap = np.where(low, value[i] - value, -np.inf)
        if gap.max() < tol:
            break
        row = x @ x[i]
        j = int(np.where(gap > 0, gap * gap / np.maximum(square[i] + square - 2 * row, 1e-12), -np.inf).argmax())
        most = min(c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        t = min(gap[j] / max(square[i] + square[j] - 2 * row[j], 1e-12), most)
        a[i], a[j] = a[i] + y[i] * t, a[j] - y[j] * t
        w += t * (x[i] - x[j])
        value -= t * (row - x @ x[j])
        for k in (i, j):
            up[k] = a[k] < c - 1e-12 if y[k] > 0 else a[k] > 1e-12
            low[k] = a[k] > 1e-12 if y[k] > 0 else a[k] < c - 1e-12
    return w, float((np.where(up, value, -np.inf).max() + np.where(low, value, np.inf).min()) / 2)


def fit_sgd(x: np.ndarray, y: np.ndarray, c: float = 0.1, epochs: int = 30, alpha: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Averaged steps on alpha |w|^2 / 2 + mean(max(0, 1 - y (x w + b))), at a falling rate; rows in an
    order drawn anew from the seed for each epoch. c isn't used."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1]), float(y[0]) if len(y) else 0.0
    rng, w, b, n = np.random.default_rng(seed), np.zeros(x.shape[1]), 0.0, 0
    mean_w, mean_b = w.copy(), 0.0
    rate = 1 / max(1.0, float((x * x).sum(1).mean()) + 1)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            step = rate / (1 + rate * alpha * n) ** 0.75
            inside = y[i] * (x[i] @ w + b) < 1
            w *= 1 - step * alpha
            if inside:
                w += step * y[i] * x[i]
                b += step * y[i]
            n += 1
            mean_w += (w - mean_w) / n
            mean_b += (b - mean_b) / n
    return mean_w, mean_b


FITS = {"squared_hinge": fit_squared_hinge, "hinge": fit_hinge, "sgd": fit_sgd}


def fit_large(rows: DataFrame, negatives: DataFrame, c: float = 0.1, steps: int = 50, tol: float = 1e-8) -> DataFrame:
    """The squared hinge of fit_squared_hinge() for clusters of any size. rows: cluster_id, feat, y;
    negatives: feat, rows of every cluster with y = -1. Clusters are few, as each has many rows."""
    shared = negatives.select(F.lit(None).cast("long").alias("cluster_id"), "feat", F.lit(-1).alias("y"))
    table = settle(rows.select("cluster_id", "feat", "y").unionByName(shared).select("cluster_id", F.col("feat").cast("array<double>").alias("feat"), F.col("y").cast("int").alias("y")))
    sizes = table.groupBy("cluster_id").agg(F.count(F.when(F.col("y") > 0, 1)).alias("pos"), F.count(F.when(F.col("y") < 0, 1)).alias("neg"), F.max(F.size("feat")).alias("width")).collect()
    counts = {r["cluster_id"]: (r["pos"], r["neg"] + sum(s["neg"] for s in sizes if s["cluster_id"] is None)) for r in sizes if r["cluster_id"] is not None}
    ids, width = sorted(counts), max((r["width"] for r in sizes), default=0) + 1
    place = {k: i for i, k in enumerate(ids)}

    def total(v: np.ndarray, along: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each cluster the squared slack and its derivative's sum at v; or, with a direction, the sum
        of a a' along it over the rows a with slack."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(ids), width + 1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                a = np.column_stack([batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
                y, of = batch.column(2).to_numpy().astype(float), np.array([place.get(k, -1) for k in batch.column(0).to_pylist()])
                for j in range(len(ids)):
                    mine = (of == j) | (of == -1)
                    slack = 1 - y[mine] * (a[mine] @ v[j])
                    b = a[mine][slack > 0]
                    if along is None:
                        out[j, 0] += (slack[slack > 0] ** 2).sum()
                        out[j, 1:] += b.T @ (y[mine] * slack)[slack > 0]
                    else:
                        out[j, 1:] += b.T @ (b @ along[j])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], ["j", "sums"])

        got = table.mapInArrow(sums, "j int, sums array<double>").select("j", F.posexplode("sums")).groupBy("j", "pos").agg(F.sum("col").alias("s")).collect()
        out = np.zeros((len(ids), width + 1))
        for r in got:
            out[r["j"], r["pos"]] = r["s"]
        return out[:, 0], out[:, 1:]

    def loss(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slack, vector = total(v)
        return 0.5 * (v * v).sum(1) + c * slack, v - 2 * c * vector

    v = np.zeros((len(ids), width))
    value, grad = loss(v)
    for _ in range(steps):
        open_ = np.abs(grad).max(1, initial=0) > tol
        if not open_.any():
            break
        # conjugate gradients for all open clusters at once
        step, rest = np.zeros_like(v), np.where(open_[:, None], grad, 0)
        way, square = rest.copy(), (rest * rest).sum(1)
        goal = np.minimum(0.1, np.sqrt(np.sqrt(square))) ** 2 * square
        for _ in range(width):
            if not (square > goal).any():
                break
            turned = way + 2 * c * total(v, way)[1]
            length = np.where(square > goal, square / np.maximum((way * turned).sum(1), 1e-300), 0)[:, None]
            step, rest = step + length * way, rest - length * turned
            after = (rest * rest).sum(1)
            way, square = rest + (after / np.maximum(square, 1e-300))[:, None] * way, after
        t = np.ones(len(ids))
        while True:
            new, after = loss(v - t[:, None] * step)
            bad = (new > value - 1e-4 * t * (grad * step).sum(1)) & (t > 1e-8) & open_
            if not bad.any():
                break
            t[bad] /= 2
        v, value, grad = v - t[:, None] * step, new, after
    clear(table)
    return rows.sparkSession.createDataFrame([(k, v[i, :-1].tolist(), float(-v[i, -1]), 1, *counts[k]) for k, i in place.items()], MODEL)


def fit_clusters(positives: DataFrame, negatives: DataFrame, own_negatives: DataFrame | None = None, c: float = 0.1, shared_mb: int = 64, modeltype: str = "squared_hinge", task_mb: int = 512) -> DataFrame:
    """positives: cluster_id, feat; negatives: feat (of all clusters); own_negatives: cluster_id,
    feat. A row per cluster with positives: its weights, rho = -intercept, counts. Clusters with more
    than ``task_mb`` of rows of their own are fitted by fit_large(); for the other kinds of model they
    are refused, as are shared negatives beyond ``shared_mb``."""
    if modeltype not in FITS:
        raise ValueError(f"unknown kind of model {modeltype}")
    rows = positives.select("cluster_id", "feat", F.lit(1).alias("y"))
    clusters = positives.select("cluster_id").distinct()
    if own_negatives is not None:
        rows = rows.unionByName(own_negatives.join(clusters, "cluster_id", "left_semi").select("cluster_id", "feat", F.lit(-1).alias("y")))
    n, width = negatives.agg(F.count("*"), F.max(F.size("feat"))).first()
    size, bound = n * (width or 0) * 8, shared_mb << 20
    many = crowded(rows.select("cluster_id"), ["cluster_id"], max(1, (task_mb << 20) // (8 * (width or 1))))
    if modeltype != "squared_hinge" and (many is not None or size > bound):
        raise ValueError(f"too many rows for a model of kind {modeltype}")
    if many is not None:
        large = fit_large(rows.join(many, "cluster_id", "left_semi"), negatives, c)
        small = rows.join(many, "cluster_id", "left_anti")
        rest = fit_clusters(small.filter("y > 0").drop("y"), negatives, small.filter("y < 0").drop("y"), c, shared_mb, task_mb=1 << 30)
        return large.unionByName(rest)
    if size <= bound:
        return _fit(rows, negatives, c, 0, modeltype=modeltype)
    numbered = settle(negatives.select(F.monotonically_increasing_id().alias("patch_id"), F.lit(0).alias("imidx"), "feat"))
    dealt = F.pmod(F.xxhash64("patch_id"), F.lit(-(-2 * size // bound))) == 0
    sent, rest = numbered.filter(dealt), numbered.filter(~dealt)
    models, inside = settle(_fit(rows, sent, c, n)), None
    while True:
        found = score(rest, models, -1 + 1e-7).select("det_id", F.col("detector").alias("cluster_id"))
        new = settle(found if inside is None else found.join(inside, ["det_id", "cluster_id"], "left_anti"))
        if not new.limit(1).count():
            return models
        inside = settle(new if inside is None else inside.unionByName(new))
        own = inside.join(rest.select(F.col("patch_id").alias("det_id"), "feat"), "det_id").select("cluster_id", "feat", F.lit(-1).alias("y"))
        models = settle(_fit(rows.unionByName(own), sent, c, n, own))


def _blocks(feat: pa.ChunkedArray) -> list[np.ndarray]:
    """The vectors of each Arrow batch as rows, without a copy."""
    out = []
    for chunk in feat.chunks:
        if len(chunk):
            flat = chunk.flatten().to_numpy(zero_copy_only=False)
            width = len(chunk[0])
            if len(flat) != len(chunk) * width or chunk.null_count:
                raise ValueError("vectors have to be of one length")
            out.append(flat.reshape(len(chunk), width))
    return out


def _fit(rows: DataFrame, negatives: DataFrame, c: float, of: int, counted: DataFrame | None = None, modeltype: str = "squared_hinge") -> DataFrame:
    """rows: cluster_id, feat, y. negatives are sent to all tasks. of: the number of shared negatives, if
    those that are sent (and joined to rows, as counted) are a part of them."""
    got = negatives.select("feat").toPandas()["feat"]
    shared = rows.sparkSession.sparkContext.broadcast(np.stack([np.asarray(f) if getattr(f, "dtype", None) == np.float32 else np.asarray(f, float) for f in got])) if len(got) else None

    def fit(table: pa.Table) -> pa.Table:
        x, y = _blocks(table.column("feat")), table.column("y").to_numpy().astype(float)
        if shared is not None:
            x, y = [*x, shared.value], np.concatenate([y, -np.ones(len(shared.value))])
        w, b = FITS[modeltype](x if modeltype == "squared_hinge" else np.concatenate(x).astype(float), y, c)
        model = {"cluster_id": table.column("cluster_id")[0].as_py(), "w": w.tolist(), "rho": -b, "first_label": 1, "n_pos": int((y > 0).sum()), "n_neg": int((y < 0).sum())}
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(model.items(), (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.int64(), pa.int64()))})

    models = rows.groupBy("cluster_id").applyInArrow(fit, MODEL)
    if not of:
        return models
    joined = F.lit(0)
    if counted is not None:
        models = models.join(counted.groupBy("cluster_id").agg(F.count("*").alias("_joined")), "cluster_id", "left")
        joined = F.coalesce("_joined", F.lit(0))
    return models.withColumn("n_neg", F.col("n_neg") - len(got) - joined + of).select("cluster_id", "w", "rho", "first_label", "n_pos", "n_neg")


def score(rows: DataFrame, detectors: DataFrame, threshold: float, id_: str = "patch_id", chunk: int = 512) -> DataFrame:
    """Rows (id, imidx, feat) against all detectors: one matrix product per batch and chunk of
    detectors, of which only decisions of at least the threshold come out. Detectors are packed
    into chunks of bounded size, each of which is joined to all rows."""
    count = detectors.count()
    chunks = max(1, -(-count // chunk))
    side = detectors.select(F.pmod(F.xxhash64("cluster_id"), F.lit(chunks)).alias("_chunk"), "cluster_id", "w", "rho")
    held = [side.filter(F.col("_chunk") == i) for i in range(chunks)]
    out = None
    for part in held:
        got = part.orderBy("cluster_id").toPandas()
        if not len(got):
            continue
        model = rows.sparkSession.sparkContext.broadcast((got["cluster_id"].to_numpy(), np.stack([np.asarray(w, float) for w in got["w"]]), got["rho"].to_numpy(float)))

        def decide(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            ids, w, rho = model.value
            for pdf in batches:
                if len(pdf):
                    d = np.stack([np.asarray(f, float) for f in pdf["feat"]]) @ w.T - rho
                    i, k = np.nonzero(d >= threshold)
                    yield pd.DataFrame({"det_id": pdf[id_].to_numpy()[i], "detector": ids[k], "imidx": pdf["imidx"].to_numpy()[i], "decision": d[i, k]})

        scored = rows.select(id_, "imidx", "feat").mapInPandas(decide, "det_id long, detector long, imidx int, decision double")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        out = rows.limit(0).select(F.col(id_).cast("long").alias("det_id"), F.lit(0).cast("long").alias("detector"), "imidx", F.lit(0.0).alias("decision"))
    return out


def cull_negatives(negatives: DataFrame, cluster: str = "detector", at: float = -1.02, near: float = -1.0, factor: int = 3, id_: str = "det_id", score_: str = "decision") -> DataFrame:
    """Of each cluster the hardest min(rows at or above ``at``, factor x rows at or above ``near``)."""
    d = F.col(score_)
    most = negatives.groupBy(cluster).agg(F.least(F.count(F.when(d >= at, 1)), factor * F.count(F.when(d >= near, 1))).alias("_most"))
    from lodemine.operators.ranking import by_score, ranked

    hard = negatives.filter(d >= at)  # no other row can be among them
    return ranked(hard, [cluster], by_score(score_, id_), "rank").join(most, cluster).filter("rank <= _most").drop("_most")
