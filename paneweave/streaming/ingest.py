"""Images as a stream.  An extension: each image is worked on by itself, so batches give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.extractor import Extractor
from ..sources import images


def image_stream(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """(image_id, content) of image files as they arrive below ``path``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", images.NAMES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_each).load(path)
    return rows.select(F.col("path").alias("image_id"), "content")


def extract_stream(extractor: Extractor, source: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append the elements of each batch to a Parquet table, a batch's folder being replaced if it is run again.

    Images that can't be read are listed below ``output`` + "_errors".
    """

    def write(batch: DataFrame, epoch: int) -> None:
        others = [r[0] for r in batch.where(F.substring("content", 1, 4) != F.lit(bytearray(b"\x89PNG"))).select("image_id").collect()]  # no more than a batch's files
        if others:
            batch = images.as_png(batch.withColumnRenamed("image_id", "path"), others).withColumnRenamed("path", "image_id")
        extractor.extract_bytes(batch).write.mode("overwrite").parquet(f"{output}/epoch={epoch}")
        extractor.unread(batch).write.mode("overwrite").parquet(f"{output}_errors/epoch={epoch}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
