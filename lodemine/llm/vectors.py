"""A stated query set of vectors against all vectors, in blocks: the frame of both searches.

Candidates are written once to the shared folder, one row for each id and length, dealt by hash into
waves that grow by a factor of four. Queries are taken in groups of at most ``group_bytes``; a group is
broadcast, and a pass streams a wave past it: a task gathers the rows it reads into blocks, builds each
block's index, asks it for the whole group and carries each query's k best from block to block. A pass
starts from each query's k best of all waves before, and passes on only what is better: about so many
rows a query as k times the growth, however many tasks a wave has. So what is shuffled grows with
queries times k times the number of waves, the logarithm of the table's blocks. Every row is read once
for a group; nothing is copied or shuffled again, however many groups there are.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
vectors of different length are never compared. Rows are told apart by their id: repeated rows count
once, and of different vectors of one length under one id the smallest in order counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemine.llm.common import drop_tables, materialize

#: Up to so many repeated ids are broadcast.
BROADCAST_IDS = 250_000
#: Per query ids and scores of the best so far, best first.
Best = list[tuple[np.ndarray, np.ndarray]]
#: (ids ascending, vectors, query ids, query vectors, best so far): improves the last by a block.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Best], None]


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(sound, F.lit(False)))


def once(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vec_id, dim, v: one row for each id and length; and a table to be dropped afterwards. Only ids are
    shuffled to find those that repeat, and only the vectors of these are grouped."""
    rows = vectors.select("vec_id", F.size("v").alias("dim"), "v")
    again = materialize(rows.groupBy("vec_id", "dim").count().filter("count > 1").drop("count"), "repeated")
    n = again.count()
    if not n:
        return rows, again
    side = F.broadcast(again) if n <= BROADCAST_IDS else again
    least = rows.join(side, ["vec_id", "dim"], "left_semi").groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    return rows.join(side, ["vec_id", "dim"], "left_anti").unionByName(least), again


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending and their vectors as double, of rows of one length."""
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def by_length(table: pa.Table) -> dict[int, pa.Table]:
    dims = table.column("dim").to_numpy()
    return {int(d): table.filter(pa.array(dims == d)).select(["vec_id", "v"]) for d in np.unique(dims)}


def nothing(n: int, kind: type) -> Best:
    return [(np.zeros(0, np.int64), np.zeros(0, kind)) for _ in range(n)]


def waves(blocks: int, growth: int = 4) -> list[float]:
    """Up to which share of the rows each pass goes: so many passes that each has about growth times the
    rows of those before, the first of them at least a block."""
    n = 1
    while growth**n <= blocks:
        n += 1
    return [float(growth) ** (i - n + 1) for i in range(n)]


def search(queries: DataFrame, candidates: DataFrame, kernel: Kernel, k: int, score: str, block_rows: int, group_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank, vec_id, score. queries, candidates: vec_id, v. score: the type of the score."""
    spark = queries.sparkSession
    n = candidates.count()
    parts = max(math.ceil(n / block_rows), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / 1024)), 1)
    rows, again = once(candidates)
    shares = waves(parts)
    place = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    wave = sum((place >= share).cast("int") for share in shares[:-1]) if len(shares) > 1 else F.lit(0)
    # each wave in files of about a block
    files = F.array(*[F.lit(math.ceil(parts * (share - before))) for before, share in zip([0.0, *shares], shares)])
    dealt = rows.withColumn("wave", wave).repartition(parts, "wave", F.pmod(F.xxhash64("vec_id"), files[F.col("wave")]))
    table = materialize(dealt, "vectors", partition_by=["wave"])
    asked, asked_again = once(queries)
    volume = asked.agg(F.sum("dim")).first()[0] or 0
    groups = max(1, math.ceil(8 * volume / group_bytes))
    asked = materialize(asked.withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")), "queries")
    kind = np.int64 if score == "long" else np.float64

    def best_of(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def one_pass(sought: dict, part: DataFrame, before: DataFrame | None) -> DataFrame:
        """What a part of the table adds to the best of the parts before."""
        held_before = {d: nothing(len(ids), kind) for d, (ids, _) in sought.items()}
        if before is not None:
            got = before.orderBy("query_id", "rank").toArrow()  # at most k rows for each query of the group
            dims = got.column("dim").to_numpy()
            for d, (ids, _) in sought.items():
                of, name, value = (got.column(c).to_numpy()[dims == d] for c in ("query_id", "vec_id", "score"))
                low, high = np.searchsorted(of, ids, "left"), np.searchsorted(of, ids, "right")
                held_before[d] = [(name[a:b], value[a:b]) for a, b in zip(low, high)]
        shared = spark.sparkContext.broadcast((sought, held_before))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups, first = shared.value
            held: dict[int, list[pa.Table]] = {}
            best = {d: list(rows) for d, rows in first.items()}

            def flush(d: int) -> None:
                ids, x = unpack(pa.concat_tables(held.pop(d)))
                kernel(ids, x, *groups[d], best[d])

            for batch in batches:
                if not batch.num_rows:
                    continue
                for d, t in by_length(pa.Table.from_batches([batch])).items():
                    if d in best:
                        held.setdefault(d, []).append(t)
                        if sum(map(len, held[d])) >= block_rows:
                            flush(d)
            for d in list(held):
                flush(d)
            for d, rows in best.items():
                new = [np.isin(i, f, invert=True) for (i, _), (f, _) in zip(rows, first[d])]
                counts = [int(x.sum()) for x in new]
                if sum(counts):
                    columns = np.repeat(groups[d][0], counts), np.full(sum(counts), d, np.int32), np.concatenate([i[x] for (i, _), x in zip(rows, new)]), np.concatenate([s[x] for (_, s), x in zip(rows, new)])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "dim", "vec_id", "score"])

        return part.mapInArrow(found, f"query_id long, dim int, vec_id long, score {score}")

    out, lengths = [], set()
    for g in range(groups):
        sought = {d: unpack(t) for d, t in by_length(asked.filter(F.col("grp") == g).drop("grp").toArrow()).items()}
        lengths |= set(sought)
        best = None
        for w in range(len(shares)):
            more = one_pass(sought, table.filter(F.col("wave") == w).drop("wave"), best)
            more = more if best is None else best.drop("rank").unionByName(more)
            after = materialize(best_of(more, "query_id", "dim"), "nearest")
            if best is not None:
                drop_tables(spark, best)
            best = after
        out.append(best)
    drop_tables(spark, table, asked, again, asked_again)
    rows = reduce(DataFrame.unionByName, out)
    if len(lengths) > 1:  # an id with vectors of several lengths is one query
        rows = best_of(rows.drop("rank"), "query_id")
    return rows.select("query_id", "rank", "vec_id", "score")
