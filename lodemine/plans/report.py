"""The report: counts, ranks and HTML rows of the detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemine.functions.text import image_cell
from lodemine.operators import ranking as R
from lodemine.operators.relational import laplace


def rows_html(top: DataFrame, positive: Column, cluster: str = "detector", suffix: str = ".jpg") -> DataFrame:
    """cluster, html: a table row per cluster, its counts and its patches in rank order. top has
    one row per shown patch with rank, det_id and decision; a group is no larger than that rank."""
    cell = image_cell(F.col("det_id").cast("string"), F.floor(F.col("decision") * 1000).cast("string"), suffix=suffix)
    pos = F.sum(F.when(positive, 1).otherwise(0))
    got = top.groupBy(cluster).agg(pos.alias("pos"), (F.count("*") - pos).alias("neg"), F.sort_array(F.collect_list(F.struct("rank", cell.alias("cell")))).alias("cells"))
    head = F.concat(F.lit("<tr><td>"), cluster, F.lit("<br/>positive: "), "pos", F.lit(" other: "), "neg", F.lit("</td>"))
    return got.select(cluster, F.concat(head, F.concat_ws("", F.col("cells.cell")), F.lit("</tr>")).alias("html"))


def detector_ranks(detections: DataFrame, images: DataFrame, above: float) -> DataFrame:
    """detector, pos, neg, posterior, rank. Images without detections count as zeros."""
    hits = detections.filter(F.col("decision") > above).join(images.select("imidx", "is_pos"), "imidx")
    pos = F.sum(F.when(F.col("is_pos"), 1).otherwise(0))
    counted = detections.select("detector").distinct().join(hits.groupBy("detector").agg(pos.alias("pos"), (F.count("*") - pos).alias("neg")), "detector", "left").fillna(0, ["pos", "neg"])
    ranked = counted.withColumn("posterior", laplace(F.col("pos"), F.col("neg")))  # a row per detector
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("posterior").desc(), "detector")))


def overall_ranks(detections: DataFrame, images: DataFrame, shown: int = 30) -> DataFrame:
    """detector, pos, neg, rank: by the positives among the best rows of each detector, at most one an
    image."""
    best = R.top_n(detections, shown).join(images.select("imidx", "is_pos"), "imidx")
    pos = F.sum(F.when(F.col("is_pos"), 1).otherwise(0))
    counted = best.groupBy("detector").agg(pos.alias("pos"), (F.count("*") - pos).alias("neg"))  # a row per detector
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.col("pos").desc(), "detector")))


def page(rows: DataFrame, ranks: DataFrame, title: str) -> DataFrame:
    """One row with the report's HTML: the detectors kept, in rank order (at most some hundreds)."""
    ordered = rows.join(ranks, "detector").agg(F.sort_array(F.collect_list(F.struct("rank", "html"))).alias("r"))
    return ordered.select(F.concat(F.lit(f"<html><head><title>{title}</title></head><body><table>"), F.concat_ws("\n", F.col("r.html")), F.lit("</table></body></html>")).alias("value"))


def write_page(html: DataFrame, path: str) -> None:
    html.coalesce(1).write.mode("overwrite").text(path)


def write_pictures(pictures: DataFrame, path: str) -> int:
    """Writes name and png of each row below path, through the file system that the path names. The
    report's pictures are few (its detectors times its patches) and pass one by one."""
    jvm = pictures.sparkSession.sparkContext._jvm
    conf = pictures.sparkSession.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for row in pictures.select("name", "png").toLocalIterator():
        place = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{row.name}")
        out = place.getFileSystem(conf).create(place, True)
        out.write(bytearray(row.png))
        out.close()
        n += 1
    return n
