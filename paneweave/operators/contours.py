"""Rows of contours: numbers among the kept ones, and the segments that draw them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kept_index(contours: DataFrame, by: str = "image_id", order: str = "contour_id", kept: str = "kept") -> DataFrame:
    """The kept contours with ``kept_index``: their number from 0 within the image."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return contours.where(kept).withColumn("kept_index", place)


def segments(points: DataFrame, by: str, order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, seq, x1, y1, x2, y2) from one point to the next, the last one back to the first; one point has none."""
    w = Window.partitionBy(by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = points.select(by, F.row_number().over(w).cast("long").alias("seq"), point.alias("p"), F.coalesce(F.lead(point).over(w), F.first(point).over(whole)).alias("q"), F.count("*").over(whole).alias("n"))
    return rows.where("n > 1").select(by, "seq", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))
