"""Top-k per group and related prefixes. Every order ends in an id, so that ties are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds the row's position, from 0, in a total order over all rows, without bringing them to one
    task: rows are dealt by range, numbered in each part, and moved on by the sizes of the parts
    before (one row per part)."""
    from lodemine.sources.rounds import settle

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = settle(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"))
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def top(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The filter on row_number reaches below the shuffle as a WindowGroupLimit."""
    return ranked(df, keys, order, name).filter(F.col(name) <= k)


def by_score(score: str = "decision", id_: str = "det_id") -> list[Column]:
    return [F.col(score).desc(), F.col(id_).asc()]


def best_per_image(detections: DataFrame, keys: tuple[str, ...] = ("detector", "imidx")) -> DataFrame:
    return top(detections, list(keys), by_score(), 1, "_first").drop("_first")


def top_n(detections: DataFrame, n: int, cluster: str = "detector", image: str = "imidx") -> DataFrame:
    """The n best detections of a cluster, at most one per image."""
    return top(best_per_image(detections, (cluster, image)), [cluster], by_score(), n)


def at_least(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """The keys with more than so many rows, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("votes")).filter(F.col("votes") > more_than)


def assign_top(detections: DataFrame, n: int, cluster: str = "detector") -> DataFrame:
    """cluster_id: the cluster for its n best rows, null for the others."""
    return ranked(detections, [cluster], by_score(), "_rank").withColumn("cluster_id", F.when(F.col("_rank") <= n, F.col(cluster))).drop("_rank")


def sampled_ranks(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Ranks 1 to 10, and 15, 22, 29 ... up to 100."""
    r = F.col(rank)
    return df.filter((r <= 10) | (r.between(15, 100) & ((r - 15) % 7 == 0)))


def argsort_desc(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    return ranked(df, keys, [F.col(value).desc(), F.col(position).asc()], "order")


def growing_batches(df: DataFrame, order: list, first: int, growth: float, name: str = "step") -> DataFrame:
    """Adds the batch of each row: batch i takes the next floor(first x 2^(growth x i)) rows."""
    starts, i = [0], 0
    while starts[-1] < 1 << 60:
        starts.append(starts[-1] + int(first * 2 ** (growth * i)))
        i += 1
    at = F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= F.col("_place"))
    return global_rank(df, order, "_place").withColumn(name, F.size(at) - 1).drop("_place")
