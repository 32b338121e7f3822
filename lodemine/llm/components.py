"""Connected components of an edge table, by alternating large and small stars.

Edges and labels stay distributed; each round is written to the shared folder, so that a lost
executor costs no more than that round. A vertex of any degree is handled by aggregations and joins
on keys, never collected. Null ends and loops are dropped, repeated edges count once; an edge table
without rows gives no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemine.llm.common import drop_tables, materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """For each u the smallest of its neighbours v and itself."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_lowest(both), "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """id, label: the smallest vertex of the component, for every vertex but that one itself."""
    now = materialize(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        new = materialize(_small_star(_large_star(now)), "edges")
        after = _state(new)
        drop_tables(now.sparkSession, now)
        now = new
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("label"))
