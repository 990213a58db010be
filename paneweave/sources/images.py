"""Image files and image bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..imaging import png


#: fixed value: names of files that are taken for images
NAMES = "*.{png,PNG,jpg,JPG,jpeg,JPEG,gif,GIF,bmp,BMP,tif,TIF,tiff,TIFF,webp,WEBP}"


def read_images(spark: SparkSession, path: str | list[str], names: str = "*") -> DataFrame:
    """(image_id, path, width, height, channels, data, error) of image files; pixels run blue, green, red.

    Files that can't be decoded have an error and no pixels, as one bad file mustn't stop the others.
    """
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path).select("image.*")
    bad = F.col("width") < 0
    return rows.select(
        F.col("origin").alias("image_id"), F.col("origin").alias("path"), F.when(~bad, F.col("width")).alias("width"), F.when(~bad, F.col("height")).alias("height"),
        F.when(~bad, F.col("nChannels")).alias("channels"), F.when(~bad, F.col("data")).alias("data"), F.when(bad, F.lit("the image can't be decoded")).alias("error"),
    )


def _place(path: Column) -> Column:
    """A file's path without what the readers write differently."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/(//)?(?=[^/])", "$1:/")


def as_png(files: DataFrame, path: str | list[str], names: str = NAMES) -> DataFrame:
    """Files (path, content, ...) below ``path`` with PNG bytes as content, as far as Spark's image reader knows their format.

    PNG files stay as they are; so do those that can't be read, which get an error when they are decoded.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                pixels = np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width), int(row.channels))
                out.append(png.encode(pixels[:, :, 0] if row.channels == 1 else pixels[:, :, 2::-1]))
            yield pd.DataFrame({"__place": frame["__place"], "__png": out})

    is_png = F.coalesce(F.substring("content", 1, 8) == F.lit(bytearray(png._SIGN)), F.lit(False))
    origin = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    read = read_images(files.sparkSession, path, names).where("error is null").select(_place(origin).alias("__place"), "width", "height", "channels", "data")
    marked = files.withColumn("__place", _place(F.col("path"))).withColumn("__is_png", is_png)
    others = marked.where(~F.col("__is_png"))
    made = read.join(others.select("__place"), "__place", "left_semi").mapInPandas(run, "__place string, __png binary")
    return marked.join(made, "__place", "left").withColumn("content", F.coalesce("__png", "content")).select(files.columns)


def decode_bytes(rows: DataFrame, key: str = "image_id", column: str = "content") -> DataFrame:
    """(key, width, height, gray, error) from PNG bytes; null and empty bytes are an error of their row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, data in zip(frame[key], frame[column], strict=True):
                try:
                    if not data:
                        raise ValueError("no image bytes")
                    rgb = png.decode(bytes(data))
                    out.append((k, rgb.shape[1], rgb.shape[0], png.to_gray(rgb).tobytes(), None))
                except Exception as e:  # whatever is wrong with one image is its own error
                    out.append((k, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "width", "height", "gray", "error"]).astype({"width": "Int32", "height": "Int32"})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, column).mapInPandas(run, f"{key} {kind}, width int, height int, gray binary, error string")
