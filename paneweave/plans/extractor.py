"""From images to element trees: the whole extraction as one plan."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..imaging import operators as imaging
from ..operators import classify, hierarchy, icons, words
from ..sinks import documents as sinks
from ..sources import cases, images, packs


def settled(df: DataFrame) -> DataFrame:
    """Rows that several later steps read: checkpointed where the session names a folder for it, else cached."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class Extractor:
    """Builds the plan for one configuration; models are back-ends or tables computed before.

    ``words`` (schema.WORDS) or an ``ocr`` back-end give the words; ``icon_index`` (name, embedding)
    with an ``embed`` back-end gives the icons.  What is missing is left out of the plan, as a failed
    recognition leaves a tree without texts.
    """

    def __init__(self, spark: SparkSession, config: ExtractConfig | None = None, words: DataFrame | None = None, ocr: imaging.OcrBackend | None = None, embed: imaging.EmbedBackend | None = None, icon_index: DataFrame | None = None):
        self.spark, self.config = spark, config or ExtractConfig()
        self.words, self.ocr, self.embed, self.icon_index = words, ocr, embed, icon_index

    @classmethod
    def from_packs(cls, spark: SparkSession, config: ExtractConfig, words: DataFrame | None = None, ocr: imaging.OcrBackend | None = None, embed: imaging.EmbedBackend | None = None) -> Extractor:
        """With the icon index that the configuration names, from the packs of its models folder.

        The packs must be there and of their kinds, or PackError is raised; without icons none is opened.
        """
        if not (config.run_icon and embed):
            return cls(spark, config, words, ocr, embed)
        index = packs.Registry(spark, config.models_dir).icon_index(config.icon_index_pack)
        return cls(spark, config, words, ocr, embed, index)

    def reload_icons(self, icon_index: DataFrame) -> None:
        self.icon_index = icon_index

    def contours(self, decoded: DataFrame) -> DataFrame:
        """Contours of images (image_id, width, height, gray) with the reason that keeps or drops each."""
        config = self.config.layout
        return imaging.trace_contours(decoded, config).withColumn("reason", classify.contour_reason(F.col("bounds"), F.col("border_type") == "hole", config))

    def layout(self, decoded: DataFrame) -> DataFrame:
        """Elements of the boxes found in images (image_id, width, height, gray); an empty layout keeps its root."""
        return settled(hierarchy.prune(self._tree(decoded, self.contours(decoded)), config=self.config.layout))

    def _tree(self, decoded: DataFrame, judged: DataFrame) -> DataFrame:
        """The layout before redundant containers are taken out."""
        config = self.config.layout
        nodes = judged.select("image_id", F.col("contour_id").alias("id"), "parent_id", "bounds", (F.col("reason") == "kept").alias("kept"))
        nodes = settled(nodes)
        linked = settled(hierarchy.accept_parents(nodes, hierarchy.nearest_kept_ancestor(nodes), config=config))
        return settled(hierarchy.build_tree(linked, decoded.where("gray is not null").select("image_id", "width", "height")))

    def dump(self, rows: DataFrame) -> DataFrame:
        """(image_id, file, content) that shows each step from images (image_id, content: PNG bytes) to the layout before pruning."""
        decoded = settled(images.decode_bytes(rows))
        judged = settled(self.contours(decoded))
        stats = classify.filter_stats(judged).select("image_id", F.lit("filter_stats.json").alias("file"), F.to_json(F.struct("total", *classify.REASONS)).cast("binary").alias("content"))
        drawn = sinks.annotated(rows, self._tree(decoded, judged)).select("image_id", F.lit("08_layout_before_prune.png").alias("file"), F.col("png").alias("content"))
        listed = decoded.where("gray is not null").select("image_id", F.lit("manifest.json").alias("file"), F.lit(json.dumps([{"file": f} for f in imaging.DUMP_FILES])).cast("binary").alias("content"))
        return imaging.stage_rasters(decoded, judged, self.config.layout).unionByName(stats).unionByName(drawn).unionByName(listed)

    def elements(self, decoded: DataFrame) -> DataFrame:
        """Layout, then words, then icons: a container that got a text is no icon any more."""
        out = self.layout(decoded)
        if self.config.run_ocr:
            found = self.words if self.words is not None else imaging.recognise(decoded, self.ocr, self.config.ocr) if self.ocr else None
            if found is not None:
                out = settled(words.attach_words(out, found))
        if self.config.run_icon and self.embed and self.icon_index is not None:
            wanted = classify.icon_candidates(out, self.config.icon)
            out = icons.attach_icons(out, imaging.embed_candidates(decoded, wanted, self.embed, self.config.icon), self.icon_index, config=self.config.icon)
        return out

    def extract_bytes(self, rows: DataFrame) -> DataFrame:
        """Elements of (image_id, content: PNG bytes); images that can't be read have none."""
        return self.elements(images.decode_bytes(rows))

    def read_files(self, path: str) -> DataFrame:
        """(image_id, content: PNG bytes) of the images below a folder; those that can't be read keep their bytes."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", images.NAMES).load(path)
        return images.as_png(files.select("path", "content"), path).select(F.col("path").alias("image_id"), "content")

    def extract_files(self, path: str) -> DataFrame:
        return self.extract_bytes(self.read_files(path))

    def unread(self, rows: DataFrame) -> DataFrame:
        """(image_id, error) of the images that can't be read and have no elements."""
        return images.decode_bytes(rows).where("error is not null").select("image_id", "error")

    def extract_cases(self, path: str) -> DataFrame:
        """Elements of all cases below a folder, in one job."""
        found = cases.read_cases(self.spark, path)
        return self.extract_bytes(found.select(F.col("case").alias("image_id"), "content"))

    def write_cases(self, path: str, output: str) -> None:
        """JSON, wireframe, drawing and steps of each case, and errors of those that can't be read; results that are there are replaced."""
        found = cases.read_cases(self.spark, path).select(F.col("case").alias("image_id"), "content")
        elements = self.extract_bytes(found).persist()
        try:
            sinks.write_results(elements, f"{output}/json")
            sinks.skeleton_html(elements).select(F.col("image_id").alias("case"), F.col("html").alias("value")).write.mode("overwrite").partitionBy("case").text(f"{output}/skeleton")
            self.unread(found).withColumnRenamed("image_id", "case").write.mode("overwrite").parquet(f"{output}/errors")
            sinks.annotated(found, elements).write.mode("overwrite").parquet(f"{output}/annotated")
            self.dump(found).write.mode("overwrite").partitionBy("file").parquet(f"{output}/pipeline")
        finally:
            elements.unpersist()

    def without_icons(self) -> Extractor:
        return Extractor(self.spark, replace(self.config, run_icon=False), self.words, self.ocr, self.embed, self.icon_index)
