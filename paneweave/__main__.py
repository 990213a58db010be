"""Command line: ``python -m paneweave extract|cases``."""

from __future__ import annotations

import argparse
import importlib
import sys
from dataclasses import replace
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import ExtractConfig, models_dir, runtime_config
from .plans.extractor import Extractor
from .sinks.documents import annotated, results_json, skeleton_html


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="paneweave")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("extract", "cases"):
        c = commands.add_parser(name)
        c.add_argument("--layout-only", action="store_true", help="without words; icons still run unless --no-icon")
        c.add_argument("--no-icon", action="store_true")
        c.add_argument("--models-dir")
        c.add_argument("--runtime-config", help="a JSON file or JSON itself")
        c.add_argument("--words", help="Parquet of words computed before")
        c.add_argument("--ocr-backend", help="module:name of an OcrBackend")
        c.add_argument("--embed-backend", help="module:name of an EmbedBackend; with it icons are matched")
        c.add_argument("--ocr-pack", default=ExtractConfig.ocr_pack)
        c.add_argument("--icon-index-pack", default=ExtractConfig.icon_index_pack)
        c.add_argument("--min-area", type=int, default=100)
        c.add_argument("--min-cosine", type=float, default=0.72)
    extract, cases = commands.choices["extract"], commands.choices["cases"]
    extract.add_argument("--input", required=True)
    extract.add_argument("--output")
    extract.add_argument("--skeleton")
    extract.add_argument("--annotate", help="Parquet of drawings; written only with --output")
    extract.add_argument("--dump-pipeline", help="Parquet of the steps from image to layout")
    extract.add_argument("--format", choices=("json", "pretty"), default="json")
    cases.add_argument("--dir", default="tests/cases")
    cases.add_argument("--output", required=True)
    return top


def settings(given: argparse.Namespace) -> ExtractConfig:
    base = ExtractConfig(run_ocr=not given.layout_only, run_icon=not given.no_icon, models_dir=models_dir(given.models_dir), ocr_pack=given.ocr_pack, icon_index_pack=given.icon_index_pack, runtime=runtime_config(given.runtime_config))
    return replace(base, layout=replace(base.layout, min_area=given.min_area), icon=replace(base.icon, min_cosine=given.min_cosine))


def backend(name: str | None) -> Any:
    """What ``module:name`` stands for."""
    module, _, attribute = (name or "").partition(":")
    return getattr(importlib.import_module(module), attribute) if module else None


def main(argv: list[str] | None = None) -> None:
    given = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("paneweave").getOrCreate()
    words = spark.read.parquet(given.words) if given.words else None
    made = Extractor.from_packs(spark, settings(given), words, backend(given.ocr_backend), backend(given.embed_backend))
    if given.command == "cases":
        made.write_cases(given.dir, given.output)
        return
    files = made.read_files(given.input)
    for row in made.unread(files).toLocalIterator():
        print(f"{row['image_id']}: {row['error']}", file=sys.stderr)
    elements = made.extract_bytes(files)
    out = results_json(elements, given.format == "pretty")
    if given.output:
        out.select(F.col("json").alias("value")).write.mode("overwrite").text(given.output)
        if given.annotate:
            annotated(files, elements).write.mode("overwrite").parquet(given.annotate)
    else:
        for row in out.toLocalIterator():
            print(row["json"])
    if given.dump_pipeline:
        made.dump(files).write.mode("overwrite").partitionBy("file").parquet(given.dump_pipeline)
    if given.skeleton:
        skeleton_html(elements).select(F.col("html").alias("value")).write.mode("overwrite").text(given.skeleton)


if __name__ == "__main__":
    main()
