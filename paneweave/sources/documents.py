"""JSON documents: recognised words, icon matches, timings and whole results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ELEMENTS, HITS_JSON, OCR_JSON

OCR_TIMINGS = ("init_ms", "predict_ms", "det_ms", "rec_ms", "post_ms")
# fixed values: fields of the timings documents
EMBED_DETAIL = ("session_ms", "tensor_ms", "run_ms", "copy_ms", "normalize_ms", "total_ms")
ICON_TIMINGS = ("load_ms", "gray_ms", "crop_ms", "preprocess_ms", "embed_ms", "index_ms", "match_ms")
STAGES = ("gray_ms", "layout_ms", "pipeline_dump_ms", "parallel_ms", "attach_words_ms")


def _required(value: Column, what: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(f"missing field: {what}"))).otherwise(value)


def ocr_words(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, word_id, text, bounds, confidence) from OCR documents.

    ``words``, ``timings`` and each word's ``bounds`` are required; all else defaults to 0 or "".
    """
    parsed = rows.select(key, F.from_json(column, OCR_JSON).alias("__j"))
    listed = F.when(F.col("__j.timings").isNull(), F.raise_error(F.lit("missing field: timings")).cast(OCR_JSON[len("struct<words: ") : OCR_JSON.index(", timings")])).otherwise(_required(F.col("__j.words"), "words"))
    each = parsed.select(key, F.posexplode(listed).alias("word_id", "__w"))
    zero = lambda c, kind: F.coalesce(F.col(f"__w.bounds.{c}"), F.lit(0)).cast(kind).alias(c)
    box = F.when(F.col("__w.bounds").isNull(), F.raise_error(F.lit("missing field: bounds")).cast("struct<x: int, y: int, width: int, height: int>")).otherwise(F.struct(*(zero(c, "int") for c in ("x", "y", "width", "height"))))
    return each.select(key, "word_id", F.coalesce("__w.text", F.lit("")).alias("text"), box.alias("bounds"), F.coalesce("__w.confidence", F.lit(0.0)).alias("confidence"))


def ocr_timings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, init_ms, ...) with every missing duration as 0."""
    return rows.select(key, F.from_json(column, OCR_JSON)["timings"].alias("__t")).select(key, *(F.coalesce(F.col(f"__t.{c}"), F.lit(0.0)).alias(c) for c in OCR_TIMINGS))


def icon_matches(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, position, name, score) from a match document: null, one object, or an array with nulls."""
    text = F.trim(column)
    as_array = F.when(text.startswith("["), text).when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(F.lit("[]"))
    each = rows.select(key, F.posexplode(F.from_json(as_array, HITS_JSON)).alias("position", "__h"))
    return each.where(F.col("__h").isNotNull()).select(key, "position", "__h.name", "__h.score")


def embed_timings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, session_ms, ...) of an embedding run; whatever can't be parsed counts as a run of no time."""
    schema = "struct<" + ", ".join(f"{c}: double" for c in EMBED_DETAIL) + ", images: int, batches: int>"
    parsed = rows.select(key, F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("__t"))
    return parsed.select(key, *(F.coalesce(F.col(f"__t.{c}"), F.lit(0.0)).alias(c) for c in EMBED_DETAIL), *(F.coalesce(F.col(f"__t.{c}"), F.lit(0)).alias(c) for c in ("images", "batches")))


def icon_counts(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, candidates, matched) from a result's ``timings``; 0 where they are missing."""
    got = rows.select(key, F.from_json(F.get_json_object(column, "$.timings.icon"), "struct<candidates: int, matched: int>").alias("__i"))
    return got.select(key, *(F.coalesce(F.col(f"__i.{c}"), F.lit(0)).alias(c) for c in ("candidates", "matched")))


def extract_timings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, stage, ms) in long form from a result's ``timings``; missing fields count as 0."""
    ocr = ", ".join(f"{c}: double" for c in OCR_TIMINGS)
    icon = ", ".join(f"{c}: double" for c in ICON_TIMINGS)
    detail = ", ".join(f"{c}: double" for c in EMBED_DETAIL)
    schema = "struct<" + ", ".join(f"{c}: double" for c in STAGES) + f", ocr: struct<{ocr}>, icon: struct<timings: struct<{icon}, embed_detail: struct<{detail}>>>>"
    got = rows.select(key, F.from_json(F.get_json_object(column, "$.timings"), schema).alias("t"))
    pairs = [("t." + c, c) for c in STAGES] + [("t.ocr." + c, "ocr." + c) for c in OCR_TIMINGS] + [("t.icon.timings." + c, "icon." + c) for c in ICON_TIMINGS]
    pairs += [("t.icon.timings.embed_detail." + c, "embed." + c) for c in EMBED_DETAIL]
    each = F.array(*(F.struct(F.lit(name).alias("stage"), F.coalesce(F.col(path), F.lit(0.0)).alias("ms")) for path, name in pairs))
    return got.select(key, F.explode(each).alias("s")).select(key, "s.stage", "s.ms")


def _rows(image_id: str, element: dict[str, Any], path: list[int]) -> Iterator[tuple]:
    stack = [(element, path)]
    while stack:
        at, where = stack.pop()
        b = at["bounds"]
        yield image_id, where, len(where), at["kind"], {k: int(b[k]) for k in ("x", "y", "width", "height")}, at.get("content"), at.get("name"), at.get("confidence")
        stack += [(c, [*where, i]) for i, c in enumerate(at.get("children") or ())][::-1]


def flatten_results(documents: DataFrame, key: str = "image_id", column: str = "json") -> DataFrame:
    """``schema.ELEMENTS`` from nested result documents; the recursion has no Spark type, so Python walks it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(":")[0].split(" ")[0] for f in ("image_id", "path", "depth", "kind", "bounds", "content", "name", "confidence")]
        for frame in frames:
            yield pd.DataFrame([r for i, text in zip(frame[key], frame[column], strict=True) for r in _rows(i, json.loads(text)["root"], [])], columns=names)

    return documents.select(key, column).mapInPandas(run, ELEMENTS)


def read_results(spark, path: str) -> DataFrame:
    """Elements of all result files below a folder; the image's id is its folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    name = F.element_at(F.split("path", "/"), -2)
    return flatten_results(files.select(name.alias("image_id"), F.decode("content", "UTF-8").alias("json")))
