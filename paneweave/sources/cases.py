"""Folders of cases: one input image each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import as_png

#: fixed values: names of a case's input, the first that exists is taken
INPUTS = ("input.png", "input.jpg", "input.jpeg", "input.webp", "input.gif")


def choose_input(files: DataFrame) -> DataFrame:
    """One row for each case (case, path, ...): the first of INPUTS that it has; other files are passed over."""
    rank = F.array_position(F.array(*map(F.lit, INPUTS)), F.element_at(F.split("path", "/"), -1))
    ranked = files.withColumn("__rank", rank).where("__rank > 0")
    rest = [c for c in files.columns if c != "case"]
    return ranked.groupBy("case").agg(F.min_by(F.struct(*rest), "__rank").alias("__x")).select("case", "__x.*")


def list_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case, path) of each case's input below ``path``, in the order of the cases' names; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "input.*").load(path)
    return choose_input(files.select(F.element_at(F.split("path", "/"), -2).alias("case"), "path")).orderBy("case")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case, path, content) of each case below ``path``; content is PNG bytes where it can be read.

    Inputs are chosen by their paths, and images are read after that, in no order.
    """
    listed = list_cases(spark, path)
    if listed.isEmpty():
        raise FileNotFoundError(f"no case with an input image in {path}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "input.*").load(path)
    return as_png(files.select("path", "content").join(listed, "path").select("case", "path", "content"), path, "input.*")
