"""Which clusters repeat which, and greedy acceptance in rank order.

Accepting in rank order whatever conflicts with nothing accepted before is the lexicographically
first independent set of the conflict graph. It is found in rounds over DataFrames: a node without
undecided or accepted earlier neighbours is accepted, its later neighbours are rejected. Nothing is
collected, and a round's state is written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemine.functions.geometry import box, iou
from lodemine.operators.tiles import overlapping
from lodemine.sources.rounds import settle


def _pairs(boxes: DataFrame, cluster: str, rank: str) -> DataFrame:
    """Boxes of a later cluster (b) that overlap one of an earlier cluster (a) on the same image, with
    their IoU."""
    rows = boxes.select("imidx", F.col(cluster).alias("cluster"), F.col(rank).alias("rank"), "det_id", box().alias("_box"))
    met = overlapping(rows, rows, ["imidx"]).filter("a.rank < b.rank")
    return met.select(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b"), F.col("b.det_id").alias("det_b"), iou(F.col("a._box"), F.col("b._box")).alias("iou"))


def duplicate_pairs(boxes: DataFrame, above: float = 0.2, share: float = 0.1, cluster: str = "detector", rank: str = "detector") -> DataFrame:
    """a, b, hits, boxes, duplicate: how many of b's boxes overlap one of a's by more than above
    (bins 3 to 10 of ten), and whether that is more than share of b's boxes. A row for each two clusters
    that have boxes on the same image."""
    best = _pairs(boxes, cluster, rank).groupBy("a", "b", "det_b").agg(F.max("iou").alias("iou"))
    bin_ = F.greatest(F.ceil(F.col("iou") * 10), F.lit(1))
    hits = best.groupBy("a", "b").agg(F.sum(F.when(bin_ >= round(above * 10) + 1, 1).otherwise(0)).alias("hits"))
    side = lambda s: boxes.select("imidx", F.col(cluster).alias(s), F.col(rank).alias(f"rank_{s}")).distinct()
    together = side("a").join(side("b"), "imidx").filter("rank_a < rank_b").select("a", "b").distinct()
    sizes = boxes.groupBy(F.col(cluster).alias("b")).agg(F.count("*").alias("boxes"))
    counted = together.join(hits, ["a", "b"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return counted.join(sizes, "b").select("b", "a", "hits", "boxes").withColumn("duplicate", F.col("hits") > F.lit(share) * F.col("boxes"))


def overlap_counts(boxes: DataFrame, above: float = 0.3, cluster: str = "detector", rank: str = "detector") -> DataFrame:
    """a, b, n: on how many of b's boxes a has one with an IoU above."""
    return _pairs(boxes, cluster, rank).filter(F.col("iou") > above).groupBy("a", "b").agg(F.countDistinct("det_b").alias("n"))


def accept_in_order(ranks: DataFrame, conflicts: DataFrame, cluster: str = "detector", rank: str = "rank", most: int | None = None) -> DataFrame:
    """ranks: cluster, rank; conflicts: a, b with a before b. Returns the accepted clusters with
    their rank; the first ``most`` of them if given."""
    state = settle(ranks.select(F.col(cluster).alias("id"), F.col(rank).alias("rank"), F.lit(None).cast("boolean").alias("accepted")))
    edges = settle(conflicts.select("a", "b").distinct())
    while state.filter("accepted IS NULL").limit(1).count():
        of = state.select(F.col("id").alias("a"), F.col("accepted").alias("of_a"))
        blocked = edges.join(of, "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("of_a", F.lit(False))).alias("hit"), F.max(F.col("of_a").isNull()).alias("open"))
        after = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("hit"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = settle(state.join(blocked, "id", "left").select("id", "rank", after.alias("accepted")))
    out = state.filter("accepted").select(F.col("id").alias(cluster), F.col("rank").alias(rank))
    return out.orderBy(rank).limit(most) if most else out
