"""Durations of an extraction's stages, as Columns and as a stopwatch."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the stages whose times make up an extraction and a recognition; layout and recognition
# run beside one another and both count, the wall time of the two does not
EXTRACT = ("gray_ms", "layout_ms", "ocr_ms", "attach_ms", "icon_ms")
OCR = ("init_ms", "predict_ms")


def ms_since(began: float) -> float:
    """Milliseconds since a reading of ``time.perf_counter``."""
    return (time.perf_counter() - began) * 1000


def total(*stages: Column) -> Column:
    """The sum of durations; a stage that didn't run counts as 0."""
    out = F.lit(0.0)
    for s in stages:
        out = out + F.coalesce(s, F.lit(0.0))
    return out


def by_stage(timings: DataFrame, names: dict[str, str], by: str = "image_id") -> DataFrame:
    """(by, stages, one column a stage, extract_ms) from long timings (by, stage, ms), each stage's times added up."""
    sums = [F.sum(F.when(F.col("stage") == k, F.col("ms"))).alias(n) for k, n in names.items()]
    wide = timings.groupBy(by).agg(F.count("*").alias("stages"), *sums)
    return wide.select(by, "stages", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names.values()), total(*(F.col(n) for n in names.values())).alias("extract_ms"))
