"""Column expressions over small grey rasters (arrays of 0 to 255, row by row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IconConfig


def upper_median(values: Column) -> Column:
    """The middle value, of two the larger; null if there is none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def background(pixels: Column, width: int, height: int) -> Column:
    """Upper median of the border's pixels, corners once for each side that the walk along rows takes."""
    if not width or not height:
        return F.lit(255)
    edge = [i for x in range(width) for i in (x, (height - 1) * width + x)] + [i for y in range(1, height - 1) for i in (y * width, y * width + width - 1)]
    return upper_median(F.array(*(F.get(pixels, F.lit(i)) for i in edge)))


def adaptive_threshold(pixels: Column, bg: Column) -> Column:
    """Upper median of the differences from the background, from 12 to 48; 24 for a flat raster."""
    differences = F.filter(F.transform(pixels, lambda v: F.abs(v - bg)), lambda d: d > 0)
    median = upper_median(differences)
    return F.when(median.isNull(), F.lit(24)).otherwise(F.least(F.greatest(median, F.lit(12)), F.lit(48)))


def ink(pixels: Column, bg: Column, threshold: Column, dark: bool) -> Column:
    if dark:
        return F.transform(pixels, lambda v: (F.least(v + threshold, F.lit(255)) < bg).cast("int"))
    return F.transform(pixels, lambda v: (F.greatest(v - threshold, F.lit(0)) > bg).cast("int"))


def ink_count(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda v: v > 0))


def ink_ratio_ok(count: Column, total: Column, config: IconConfig = IconConfig()) -> Column:
    return F.when(total == 0, F.lit(False)).otherwise((count / total).between(config.min_ink, config.max_ink))


def takes_dark(dark: Column, light: Column, total: Column, tolerance: int = 8) -> Column:
    """Which polarity's mask stands for the icon, by the numbers of ink pixels."""
    d, g = ink_ratio_ok(dark, total), ink_ratio_ok(light, total)
    neither = (F.abs(dark - light) <= tolerance) | (dark < light)
    return F.when(d & g, dark <= light).when(d, F.lit(True)).when(g, F.lit(False)).otherwise(neither)
