"""Mask metrics per image from long pixels (image, pixel, p, gt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image, dice, iou); both are 1 where neither has any foreground."""
    pred, gt = (F.col("p") >= threshold).cast("long"), F.col("gt").cast("long")
    s = pixels.groupBy("image").agg(F.sum(pred).alias("a"), F.sum(gt).alias("b"), F.sum(pred * gt).alias("both"))
    empty = F.col("a") + F.col("b") == 0
    return s.select("image", F.when(empty, 1.0).otherwise(2 * F.col("both") / (F.col("a") + F.col("b"))).alias("dice"), F.when(empty, 1.0).otherwise(F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("iou"))


def mean_overlap(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return overlap(pixels, threshold).agg(F.avg("dice").alias("dice"), F.avg("iou").alias("miou"))
