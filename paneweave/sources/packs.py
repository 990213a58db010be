"""Model packs: folders with a manifest, by id and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MANIFEST

KINDS = ("ocr", "embed", "icon_index")


class PackError(ValueError):
    """A pack is missing or of another kind."""


def setup_issues(spark: SparkSession, models: str, wanted: dict[str, str]) -> list[str]:
    """What keeps the wanted packs (id: kind) of a models folder from being used; empty if all is well."""
    try:
        found = {r["pack_id"]: r["kind"] for r in Registry(spark, models).manifests().select("pack_id", "kind").collect()}
    except Exception:  # no folder, or none with a manifest
        return [f"no packs in {models}"]
    missing = [f"pack {p} not found" for p in wanted if p not in found]
    return missing + [f"pack {p} is of kind {found[p]}, not {kind}" for p, kind in wanted.items() if found.get(p, kind) != kind]


class Registry:
    """The packs below a models folder; manifests are read once."""

    def __init__(self, spark: SparkSession, models: str):
        self.spark, self.models = spark, models
        self._manifests: DataFrame | None = None

    def manifests(self) -> DataFrame:
        if self._manifests is None:
            rows = self.spark.read.schema(MANIFEST).option("multiLine", True).json(f"{self.models}/*/manifest.json")
            self._manifests = rows.withColumn("pack_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
        return self._manifests

    def pack_ids(self) -> list[str]:
        return sorted(r[0] for r in self.manifests().select("pack_id").collect())

    def manifest(self, pack_id: str, kind: str | None = None) -> dict:
        found = self.manifests().where(F.col("pack_id") == pack_id).first()
        if found is None:
            raise PackError(f"pack {pack_id} not found")
        if kind and found["kind"] != kind:
            raise PackError(f"pack {pack_id} is of kind {found['kind']}, not {kind}")
        return found.asDict()

    def icon_index(self, pack_id: str) -> DataFrame:
        """(pack_id, name, embedding, embed_model_id) of an icon index; its manifest must name its embed model."""
        manifest = self.manifest(pack_id, "icon_index")
        if not manifest.get("embed_model_id"):
            raise PackError(f"pack {pack_id} names no embed_model_id")
        self.manifest(manifest["embed_model_id"], "embed")
        rows = self.spark.read.parquet(f"{self.models}/{pack_id}/index.parquet")
        return rows.select(F.lit(pack_id).alias("pack_id"), "name", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(manifest["embed_model_id"]).alias("embed_model_id"))
