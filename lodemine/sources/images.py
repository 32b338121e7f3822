"""Folders of images as tables: <base>/<set>/cutouts/<bin>/<name>.jpg."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodemine.operators.ranking import global_rank


def scan_folders(spark: SparkSession, base: str, positives: list[str], negatives: list[str], pattern: str = "*.jpg") -> DataFrame:
    """imidx, id, bytes, bin, label, fullname: a row per file of the bins named. Sizes come from the
    listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base).select("path", "length")
    bin_ = F.element_at(F.split("path", "/"), -2)
    rows = files.withColumn("bin", bin_).filter(F.col("bin").isin([*positives, *negatives]))
    label = F.when(F.col("bin").isin(positives), "positive").otherwise("negative")
    name = F.element_at(F.split("path", "/"), -1)
    rows = global_rank(rows, [F.col("bin").asc(), F.col("path").asc()], "imidx")
    return rows.select("imidx", name.alias("id"), F.col("length").alias("bytes"), "bin", label.alias("label"), F.concat_ws("/", "bin", name).alias("fullname"), "path")


def sample_per_folder(rows: DataFrame, n: int, folder: str, label: str, order: list, negative: str = "negative") -> DataFrame:
    """The first n rows of each folder by the given order; the last negative folder makes up for
    what other negative folders lack. Each folder's rows are trimmed before the shuffle but for
    that last one."""
    sizes = rows.groupBy(label, folder).agg(F.count("*").alias("_n"))
    neg = F.col(label) == negative
    last = sizes.filter(neg).agg(F.max(folder).alias("_last"), (F.count("*") * n - F.sum(F.when(F.lit(True), F.least("_n", F.lit(n))))).alias("_lack"))
    rank = F.row_number().over(Window.partitionBy(label, folder).orderBy(*order))
    ranked = rows.withColumn("_rank", rank).crossJoin(F.broadcast(last))  # one row
    most = F.lit(n) + F.when(neg & (F.col(folder) == F.col("_last")), F.col("_lack")).otherwise(0)
    return ranked.filter(F.col("_rank") <= most).drop("_rank", "_last", "_lack")


def decode(images: DataFrame, scale: float = 255.0) -> DataFrame:
    """Rows of Spark's image source (struct image) to nrows, ncols and a raster: float32 RGB from 0
    to 1 in row-major order. A scale of 256 or 255 follows the source that is to be matched."""

    @F.pandas_udf("nrows int, ncols int, raster binary")
    def rgb(image: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"]):
            x = np.frombuffer(data, np.uint8).reshape(h, w, c)[:, :, [0, 0, 0] if c == 1 else [2, 1, 0]]
            out.append((h, w, (x / scale).astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["nrows", "ncols", "raster"])

    return images.withColumn("_r", rgb("image")).select("*", "_r.*").drop("_r", "image")


def image_order(images: DataFrame, key, label: str = "is_pos", idx: str = "imidx") -> DataFrame:
    """ord, imidx: positives first, within a label by key and then id."""
    return global_rank(images.withColumn("_key", key), [F.col(label).desc(), F.col("_key").asc(), F.col(idx).asc()], "ord").drop("_key")


def seeds(ordered: DataFrame, step: int) -> DataFrame:
    return ordered.filter(F.pmod("ord", F.lit(step)) == 0)


def rotation(ordered: DataFrame, j: int, label: str = "is_pos") -> DataFrame:
    """Adds part: train or validate for the images of round j, null for the rest. Positives by
    position mod 3 from j, negatives every 7th position from j (train) or j + 1 (validate). ord has
    the positives first, so that a negative's position is what lies beyond them."""
    positives = ordered.agg(F.count(F.when(F.col(label), 1)).alias("_positives"))  # one row
    at = F.when(F.col(label), F.col("ord")).otherwise(F.col("ord") - F.col("_positives"))
    seventh = F.lit(7)
    part = (
        F.when(F.col(label) & (at % 3 == j % 3), "train")
        .when(F.col(label) & (at % 3 == (j + 1) % 3), "validate")
        .when(~F.col(label) & (at >= j) & (F.pmod(at - j, seventh) == 0), "train")
        .when(~F.col(label) & (at >= j + 1) & (F.pmod(at - j - 1, seventh) == 0), "validate")
    )
    return ordered.crossJoin(F.broadcast(positives)).withColumn("part", part).drop("_positives")
