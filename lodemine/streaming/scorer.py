"""Detectors over a stream of patches. An extension: the batch job has no streaming part.

Scoring and suppression-free filtering need nothing beyond the row, so the stream has no state; the
counts per detector are a windowed aggregation with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemine.operators.svm import score


def score_stream(patches: DataFrame, detectors: DataFrame, threshold: float) -> DataFrame:
    """patches: a streaming frame with patch_id, imidx, feat. Detections at or above threshold."""
    return score(patches, detectors, threshold)


def counts_per_window(detections: DataFrame, time: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Detections per detector and window of event time; rows later than ``late`` are dropped."""
    seen = detections.withWatermark(time, late)
    return seen.groupBy(F.window(time, window), "detector").agg(F.count("*").alias("n"), F.max("decision").alias("best")).select(F.col("window.start").alias("start"), "detector", "n", "best")
