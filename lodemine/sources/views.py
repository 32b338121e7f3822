"""The tables of the mining pipeline, derived from the general tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, imidx, is_pos, feat (array<float>), label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"), (F.col("label") * 10 + F.col("vec_id") % 10).cast("int").alias("imidx"), (F.col("label") < 5).alias("is_pos"), F.col("embedding").alias("feat"), "label")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """imidx, is_pos, nrows, ncols."""
    return patches(spark, sf_dir).select("imidx", "is_pos", F.lit(160).alias("nrows"), F.lit(240).alias("ncols")).distinct()


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, detector, imidx, decision, x1, y1, x2, y2."""
    e = F.col("event_id")
    side = 39 + (e % 3) * 20
    x, y = (e * 37) % 160, (e * 91) % 120
    named = {"detector": F.col("user_id") % 20, "imidx": e % 100, "x1": x, "y1": y, "x2": x + side, "y2": y + side}
    got = {k: v.cast("int").alias(k) for k, v in named.items()}
    return table(spark, sf_dir, "events").select(e.alias("det_id"), got["detector"], got["imidx"], F.col("value").alias("decision"), got["x1"], got["y1"], got["x2"], got["y2"])


#: The same views for DuckDB, to stand after WITH.
SQL = {
    "patches": """patches AS (SELECT vec_id AS patch_id, CAST(label * 10 + vec_id % 10 AS INT) AS imidx, label < 5 AS is_pos, embedding AS feat, label FROM embeddings)""",
    "images": """images AS (SELECT DISTINCT imidx, is_pos, 160 AS nrows, 240 AS ncols FROM patches)""",
    "detections": """detections AS (SELECT event_id AS det_id, CAST(user_id % 20 AS INT) AS detector, CAST(event_id % 100 AS INT) AS imidx, value AS decision,
  CAST((event_id * 37) % 160 AS INT) AS x1, CAST((event_id * 91) % 120 AS INT) AS y1,
  CAST((event_id * 37) % 160 + 39 + (event_id % 3) * 20 AS INT) AS x2, CAST((event_id * 91) % 120 + 39 + (event_id % 3) * 20 AS INT) AS y2 FROM events)""",
}
