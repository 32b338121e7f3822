"""The nearest patch of each image for each centre, and what follows from it.

Targets are shuffled once, into runs by image and nearest pivot; centres are broadcast in groups of
bounded size. Blocks that the triangle inequality rules out are never multiplied. Results carry ids
and distances only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemine.operators.ranking import global_rank, top
from lodemine.operators.tiles import crowded, with_parts
from lodemine.sources.rounds import clear, settle


def _features(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def standardise_rows(x: np.ndarray) -> np.ndarray:
    """(x - mean) / (population deviation * width + 1e-15) by row."""
    c = x - x.mean(1, keepdims=True)
    return c / (np.sqrt((c * c).mean(1, keepdims=True)) * x.shape[1] + 1e-15)


@dataclass
class Centres:
    """A group of centres by nearest pivot. d: their distances to the pivots."""

    ids: np.ndarray
    x: np.ndarray
    d: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray) -> Centres:
        d = distances(x, pivots)
        order = np.lexsort((ids, d.argmin(1)))
        return cls(ids[order], x[order], d[order])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """By differences: near 0 a product would lose all digits, and the bounds with them."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x far from each other: each the farthest from those before it."""
    chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def nearest_of_image(c: Centres, ids: np.ndarray, y: np.ndarray, pivots: np.ndarray, best: np.ndarray, at: np.ndarray, bound: np.ndarray | None = None, block: int = 512, centres: int = 1024) -> tuple[int, int]:
    """Improves best (squared distance of each centre) and at (its target) by the targets of an image,
    ties to the smaller id, where that is not beyond ``bound``. Returns the number of pairs
    of a centre and a target, and of those that had to be multiplied.

    Targets are taken in blocks by nearest pivot. By the triangle inequality a centre is at least
    d(c, p) - max d(t, p) and min d(t, p) - d(c, p) away from all of a block, whatever the pivot p, and
    at most d(c, p) + min d(t, p) from some target. Blocks are tried from the nearest bound on, each
    with those centres alone that it can still improve."""
    d = distances(y, pivots)
    cell = d.argmin(1)
    order = np.lexsort((ids, cell))
    ids, y, d, cell = ids[order], y[order], d[order], cell[order]
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(ids) > 2 * block // len(pivots) else np.zeros(1, int)
    starts = np.concatenate([np.arange(s, e, block) for s, e in zip(cuts, [*cuts[1:], len(ids)])])
    ends = [*starts[1:], len(ids)]
    low, high = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
    y2 = (y * y).sum(1)
    looked = multiplied = 0
    for a in range(0, len(c.ids), centres):
        x, dx = c.x[a : a + centres], c.d[a : a + centres]
        x2 = (x * x).sum(1)
        slack = 1e-9 * (x2 + y2.max())  # the products' rounding
        mine, found = best[a : a + centres], at[a : a + centres]  # views
        limit = (dx + low.min(0)).min(1) ** 2
        if bound is not None:
            limit = np.minimum(limit, bound[a : a + centres])
        gaps = np.stack([np.maximum(np.maximum(dx - h, lo - dx), 0).max(1) for lo, h in zip(low, high)], 1) ** 2
        for t in np.argsort(gaps.min(0), kind="stable"):
            s, e = starts[t], ends[t]
            looked += len(x) * (e - s)
            alive = np.flatnonzero(gaps[:, t] <= np.minimum(limit, mine) + slack)
            if not len(alive):
                continue
            multiplied += len(alive) * (e - s)
            near = x2[alive, None] - 2 * (x[alive] @ y[s:e].T) + y2[s:e]
            j = near.argmin(1)
            exact, name = ((x[alive] - y[s + j]) ** 2).sum(1), ids[s + j]
            won = (exact < mine[alive]) | (exact == mine[alive]) & (name < found[alive])
            mine[alive[won]], found[alive[won]] = exact[won], name[won]
    return looked, multiplied


def _centre_groups(centers: DataFrame, group_bytes: int) -> list[DataFrame]:
    """Centres dealt by hash into groups of about so many bytes."""
    size = centers.agg(F.count("*").alias("n"), F.max(F.size("feat")).alias("width")).first()
    groups = max(1, math.ceil(8 * (size["n"] or 0) * (size["width"] or 0) / group_bytes))
    if groups == 1:
        return [centers]
    dealt = settle(centers.withColumn("_g", F.pmod(F.xxhash64("patch_id"), F.lit(groups)).cast("int")))
    return [dealt.filter(F.col("_g") == g).drop("_g") for g in range(groups)]


def nearest_per_image(centers: DataFrame, targets: DataFrame, center_rows: int = 1024, target_rows: int = 4096, standardise: bool = True, k: int | None = None, pivots: int = 16, sample: int = 2048, group_bytes: int = 1 << 25, counts: tuple | None = None) -> DataFrame:
    """centers: patch_id, feat; targets: target_id, imidx, feat. Returns patch_id, imidx, dist,
    target_id: of each image the target with the smallest squared distance, ties to the smaller id;
    of the ``k`` nearest images of each centre only, if k is given (ties to the smaller image).

    Targets are dealt once, by ranges of image, nearest pivot and id, so that a large image lies in
    several tasks; centres are a stated set, broadcast in groups of ``group_bytes``, past which each
    task streams its targets, ``target_rows`` of an image at a time. What bounds on the distances to the
    pivots rule out is never multiplied; with k, whole images are, once a task has k nearer ones.
    Pivots are far points among the ``sample`` targets with the smallest hash; they decide the work
    only, never the result. Rows without an id, image or vector take no part. counts: two accumulators, for all pairs and those multiplied."""
    spark = centers.sparkSession
    schema = "patch_id long, imidx int, dist double, target_id long"
    prepared = standardise_rows if standardise else (lambda x: x)
    targets = targets.dropna(subset=["target_id", "imidx", "feat"])
    some = targets.select("feat").orderBy(F.xxhash64("feat")).limit(sample).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], schema)
    far = choose_pivots(prepared(_features(some, "feat")), pivots)

    @F.arrow_udf("int")
    def cell(feat: pa.Array) -> pa.Array:
        flat = feat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.array(distances(prepared(flat.reshape(len(feat), -1)), far).argmin(1) if len(feat) else [], pa.int32())

    keys = ["imidx", "_cell", "target_id"]
    arranged = targets.select("target_id", F.col("imidx").cast("int").alias("imidx"), "feat", cell("feat").alias("_cell"))
    arranged = arranged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("target_id", "imidx", "feat")

    def one_pass(group: DataFrame, table: DataFrame) -> DataFrame:
        got = group.select("patch_id", "feat").dropna().toArrow()
        if not got.num_rows:
            return spark.createDataFrame([], schema)
        shared = spark.sparkContext.broadcast((Centres.of(got.column("patch_id").to_numpy(), prepared(_features(got, "feat")), far), far))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, at_pivots = shared.value
            n = len(c.ids)
            best, at = np.full(n, np.inf), np.full(n, -1, np.int64)
            # of each centre the k nearest images so far, nearest first
            held = (np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int32).max, np.int64), np.full((n, k), -1, np.int64)) if k else None
            image, rows, waiting = None, [], 0

            def flush() -> None:
                nonlocal rows, waiting
                if rows:
                    table = pa.Table.from_batches(rows)
                    looked, multiplied = nearest_of_image(c, table.column("target_id").to_numpy(), prepared(_features(table, "feat")), at_pivots, best, at, held[0][:, -1] if held else None, centres=center_rows)
                    if counts:
                        counts[0].add(int(looked))
                        counts[1].add(int(multiplied))
                rows, waiting = [], 0

            def closed() -> Iterator[pa.RecordBatch]:
                flush()
                found = at >= 0
                if held is None:
                    if found.any():
                        yield batch_of(c.ids[found], np.full(int(found.sum()), image), best[found], at[found])
                else:
                    found &= (best < held[0][:, -1]) | (best == held[0][:, -1]) & (image < held[1][:, -1])
                    r = np.flatnonzero(found)
                    new = [np.column_stack([h[r], v]) for h, v in zip(held, (best[r], np.full(len(r), image), at[r]))]
                    order = np.lexsort((new[1], new[0]), axis=1)[:, :k]
                    for h, v in zip(held, new):
                        h[r] = np.take_along_axis(v, order, 1)
                best.fill(np.inf)
                at.fill(-1)

            for batch in batches:
                images = batch.column(1).to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], images[1:] != images[:-1]])) if len(images) else []
                for a, b in zip(cuts, [*cuts[1:], len(images)]):
                    if image is not None and images[a] != image:
                        yield from closed()
                    image = int(images[a])
                    for lo in range(a, b, target_rows):
                        part = batch.slice(lo, min(target_rows, b - lo))
                        if waiting + part.num_rows > target_rows:
                            flush()
                        rows.append(part)
                        waiting += part.num_rows
            if image is not None:
                yield from closed()
            if held:
                r, j = np.nonzero(held[2] >= 0)
                yield batch_of(c.ids[r], held[1][r, j], held[0][r, j], held[2][r, j])

        def batch_of(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.int64()))], ["patch_id", "imidx", "dist", "target_id"])

        return table.mapInArrow(stream, schema)

    groups = _centre_groups(centers, group_bytes)
    if len(groups) == 1:
        near = one_pass(groups[0], arranged)
    else:
        table = settle(arranged)
        near = reduce(DataFrame.unionByName, [settle(one_pass(g, table)) for g in groups])
        clear(table, groups[0])
    # an image may lie in two tasks
    near = near.groupBy("patch_id", "imidx").agg(F.min(F.struct("dist", "target_id")).alias("m")).select("patch_id", "imidx", "m.dist", "m.target_id")
    return top_images(near, k).drop("nn_rank") if k else near


def top_images(near: DataFrame, k: int) -> DataFrame:
    """The k nearest images of each patch, nn_rank from 1."""
    return top(near, ["patch_id"], ["dist", "imidx"], k, "nn_rank")


def with_labels(topn: DataFrame, images: DataFrame) -> DataFrame:
    return topn.join(images.select("imidx", "is_pos"), "imidx")


def purity_rank(topn: DataFrame, depth: int = 20) -> DataFrame:
    """patch_id, purity (positives among the depth nearest), rank over all patches."""
    counted = topn.filter(F.col("nn_rank") <= depth).groupBy("patch_id").agg(F.sum(F.col("is_pos").cast("long")).alias("purity"))
    ranked = global_rank(counted, [F.col("purity").desc(), F.col("patch_id").asc()])
    return ranked.select("patch_id", "purity", (F.col("rank") + 1).cast("int").alias("rank"))


def squared_distances(x: np.ndarray, y: np.ndarray, rows: int = 32) -> np.ndarray:
    """Between all rows of x and of y; each sum runs over the elements in order, as a fold would."""
    out, columns = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
    for at in range(0, len(x), rows):
        part, total = x[at : at + rows], out[at : at + rows]
        gap = np.empty_like(total)
        with np.errstate(invalid="ignore", over="ignore"):
            for k in range(x.shape[1]):
                np.subtract(part[:, k, None], columns[k], out=gap)
                gap *= gap
                total += gap
    return out


def pair_distances(rows: DataFrame, keys: list[str], id_: str, feature: str, block: int = 1024) -> DataFrame:
    """a, b, d: the squared distance of all pairs of a group's rows with a < b. Null where a vector is null
    or holds a null, or where the lengths differ. Groups are dealt into blocks of about so many rows; a task
    holds two blocks, whose distances are computed together and leave it as columns."""
    known = rows.dropna(subset=[*keys, id_]).select(*keys, F.col(id_).cast("long").alias("_id"), F.col(feature).alias("_feat"))
    dealt = with_parts(known, crowded(known, keys, block), keys).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    met = met.select(*keys, F.least("_block", "_other").alias("_one"), F.greatest("_block", "_other").alias("_two"), "_block", "_id", F.coalesce(F.size("_feat"), F.lit(0)).alias("_width"), (F.col("_feat").isNull() | F.exists("_feat", lambda v: v.isNull())).alias("_none"), "_feat")

    def pairs(cell: pa.Table) -> pa.Table:
        ids, width, none, of, first, second = (cell.column(c).to_numpy() for c in ("_id", "_width", "_none", "_block", "_one", "_two"))
        x = np.zeros((len(ids), int(width.max())))
        x[(np.arange(x.shape[1]) < width[:, None]) & ~none[:, None]] = cell.filter(pa.array(~none)).column("_feat").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        one, two = np.flatnonzero(of == first), np.flatnonzero(of == second)
        # equal ids lie in one block
        wanted = ids[one][:, None] < ids[two] if first[0] == second[0] else np.ones((len(one), len(two)), bool)
        d = squared_distances(x[one], x[two])[wanted]
        i, j = np.nonzero(wanted)
        i, j = one[i], two[j]
        out = [pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(d, mask=none[i] | none[j] | (width[i] != width[j]))]
        return pa.Table.from_arrays(out, ["a", "b", "d"])

    return met.groupBy(*keys, "_one", "_two").applyInArrow(pairs, "a long, b long, d double")
