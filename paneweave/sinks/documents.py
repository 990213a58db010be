"""Nested JSON results, HTML wireframes, drawings and log lines."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.text import KIND_COLORS
from ..imaging import png

_ENTRY = ("path", "kind", "bounds", "content", "name", "confidence")


def _single(value: float) -> float:
    """The shortest number that is the same 32-bit float."""
    return float(str(np.float32(value)))


def nest(entries: list[Any]) -> dict[str, Any]:
    """The element tree of one image from its rows; ordinals may have gaps."""
    root: dict[str, Any] | None = None
    known: dict[tuple[int, ...], dict[str, Any]] = {}
    for e in sorted(entries, key=lambda e: list(e["path"])):
        b = e["bounds"]
        node: dict[str, Any] = {"bounds": {k: int(b[k]) for k in ("x", "y", "width", "height")}, "kind": e["kind"]}
        for field in ("content", "name"):
            if e[field] is not None:
                node[field] = e[field]
        if e["confidence"] is not None and not np.isnan(e["confidence"]):
            node["confidence"] = _single(e["confidence"])
        path = tuple(e["path"])
        known[path] = node
        if not path:
            root = node
        elif path[:-1] in known:
            known[path[:-1]].setdefault("children", []).append(node)
    if root is None:
        raise ValueError("a result needs a root element")
    return root


def results_json(elements: DataFrame, pretty: bool = False, timings: DataFrame | None = None) -> DataFrame:
    """(image_id, json): one nested document per image, width and height from the root.

    The rows of one image are one screen's elements; they meet in one cell, not in one task.  With
    ``timings`` (image_id, timings: a JSON object) the document carries them too.
    """
    rows = elements.groupBy("image_id").agg(F.collect_list(F.struct(*_ENTRY)).alias("entries"))
    if timings is not None:
        rows = rows.join(timings.select("image_id", "timings"), "image_id", "left")
    else:
        rows = rows.withColumn("timings", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for entries, extra in zip(frame["entries"], frame["timings"], strict=True):
                root = nest(list(entries))
                document = {"width": root["bounds"]["width"], "height": root["bounds"]["height"], "root": root}
                if extra:
                    document["timings"] = json.loads(extra)
                out.append(json.dumps(document, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")))
            yield pd.DataFrame({"image_id": frame["image_id"], "json": out})

    kind = dict(elements.dtypes)["image_id"]
    return rows.mapInPandas(run, f"image_id {kind}, json string")


def write_results(elements: DataFrame, path: str, pretty: bool = True) -> None:
    """One text file of documents per case folder; earlier results are replaced."""
    out = results_json(elements, pretty).select(F.col("image_id").alias("case"), F.col("json").alias("value"))
    out.write.mode("overwrite").partitionBy("case").text(path)


def skeleton_nodes(elements: DataFrame) -> DataFrame:
    """(image_id, path, html): the box of every element but the root."""
    # fixed values: the markup of a box, its classes and its title are an output format
    b = F.col("bounds")
    label = F.coalesce("content", "name")
    named = label.isNotNull()
    style = F.format_string("left:%dpx;top:%dpx;width:%dpx;height:%dpx;border-color:%s", b["x"], b["y"], b["width"], b["height"], t.depth_color(F.col("depth")))
    title = F.when(named, F.concat(F.lit(' title="'), t.html_escape(label), t.percent(F.col("kind"), F.col("confidence")), F.lit('"'))).otherwise(F.lit(""))
    inner = F.when(named, F.concat(F.lit('<span class="text-content" style="--fs:'), t.font_size(b["height"]).cast("string"), F.lit('px">'), t.html_escape(label), F.lit("</span>"))).otherwise(F.lit(""))
    box = F.concat(F.lit('<div class="node kind-'), "kind", F.lit('" style="'), style, F.lit('"'), title, F.lit('><span class="badge">'), t.badge(F.col("depth"), F.col("kind")), F.lit("</span>"), inner, F.lit("</div>"))
    return elements.where(F.col("kind") != "root").select("image_id", "path", box.alias("html"))


#: The look of the page; the class names are those of ``skeleton_nodes``.
_STYLE = """
body { margin: 2rem auto; max-width: max-content; font: 15px/1.5 Georgia, serif; color: #333; background: #f6f4ef }
h1 { font-size: 1.4em } h1 + p { color: #777 }
ul.depths { display: flex; gap: 1em; padding: 0; list-style: none }
ul.depths li::before { content: "\\25A0\\00A0"; color: var(--c) }
main { position: relative; background: #fff; box-shadow: 0 1px 6px #0003 }
.node { position: absolute; border: 1px solid; overflow: clip }
.kind-text { border-style: dotted; background: #0000000a } .kind-icon { border-radius: 4px }
.badge { float: right; padding: 0 2px; font: 8px monospace; opacity: .6 }
.text-content { font-size: var(--fs) }
"""


def skeleton_html(elements: DataFrame, title: str | None = None) -> DataFrame:
    """(image_id, html): a wireframe page per image, boxes in the order of a walk from the root."""
    nodes = skeleton_nodes(elements).groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "html"))), lambda n: n["html"]), "\n").alias("nodes"))
    roots = elements.where(F.col("kind") == "root").select("image_id", F.col("bounds.width").cast("string").alias("w"), F.col("bounds.height").cast("string").alias("h"))
    legend = "".join(f'<li style="--c:{c}">depth {i + 1}</li>' for i, c in enumerate(t.DEPTH_COLORS))
    name = t.html_escape(F.lit(title) if title else F.col("image_id").cast("string"))
    page = F.concat(
        F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), name, F.lit(f"</title><style>{_STYLE}</style></head><body><h1>"), name, F.lit('</h1><p>'), "w", F.lit(" by "), "h",
        F.lit(f' pixels</p><ul class="depths">{legend}</ul><main style="width:'), "w", F.lit("px;height:"), "h", F.lit('px">\n'), F.coalesce("nodes", F.lit("")), F.lit("\n</main></body></html>\n"),
    )
    return roots.join(nodes, "image_id", "left").select("image_id", page.alias("html"))


def draw(rgb: np.ndarray, entries: list[Any]) -> np.ndarray:
    """Boxes two pixels wide on a copy of the image, from the root down."""
    out = rgb.copy()
    height, width = out.shape[:2]
    for e in sorted(entries, key=lambda e: list(e["path"])):
        if (color := KIND_COLORS.get(e["kind"])) is None:
            continue
        b = e["bounds"]
        for inset in range(2):
            x0, y0 = b["x"] + inset, b["y"] + inset
            x1, y1 = x0 + max(b["width"] - 2 * inset, 1) - 1, y0 + max(b["height"] - 2 * inset, 1) - 1
            xs, ys = slice(max(x0, 0), max(x1 + 1, 0)), slice(max(y0, 0), max(y1 + 1, 0))
            for y in (y0, y1):
                if 0 <= y < height:
                    out[y, xs] = color
            for x in (x0, x1):
                if 0 <= x < width:
                    out[ys, x] = color
    return out


def annotated(images: DataFrame, elements: DataFrame) -> DataFrame:
    """(image_id, png) from images (image_id, content: PNG bytes) with their elements drawn on them."""
    rows = elements.groupBy("image_id").agg(F.collect_list(F.struct("path", "kind", "bounds")).alias("entries"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"image_id": frame["image_id"], "png": [png.encode(draw(png.decode(bytes(c)), list(e))) for c, e in zip(frame["content"], frame["entries"], strict=True)]})

    kind = dict(elements.dtypes)["image_id"]
    return images.select("image_id", "content").join(rows, "image_id").mapInPandas(run, f"image_id {kind}, png binary")


def stage_line(row: dict[str, Column]) -> Column:
    """The log line of one case; parts that didn't run are left out."""
    # fixed values: the labels and their order are an output format
    get = lambda k: row.get(k, F.lit(0.0))
    part = lambda label, k: F.concat(F.lit(label + " "), t.format_ms(get(k)))
    some = lambda label, k, *also: F.when(F.greatest(F.lit(0.0), get(k)) > 0, part(label, k)) if not also else F.when((get(k) > 0) & (get(also[0]) > 0), part(label, k))
    ran = get("ocr_init_ms") + get("ocr_ms") > 0
    icon = F.when(
        get("icon_embed_ms") > 0,
        F.concat(part("icon", "icon_match_ms"), F.lit(" ("), F.concat_ws(" ", part("gray", "icon_gray_ms"), part("crop", "icon_crop_ms"), part("pre", "icon_preprocess_ms"), part("embed", "icon_embed_ms"), part("idx", "icon_index_ms")), F.lit(")")),
    ).otherwise(F.concat(part("icon", "icon_load_ms"), F.lit("+"), t.format_ms(get("icon_match_ms"))))
    return F.concat_ws(
        " | ", part("load", "load_ms"), part("gray", "gray_ms"), part("layout", "layout_ms"), some("pipeline_dump", "pipeline_dump_ms"),
        F.when(ran, some("parallel_wall", "parallel_ms")), F.when(ran, some("ocr_init", "ocr_init_ms")), F.when(ran, part("ocr", "ocr_ms")), some("attach", "attach_words_ms"),
        F.when((get("icon_load_ms") > 0) | (get("icon_match_ms") > 0), icon), part("json", "write_json_ms"), part("annotate", "write_annotation_ms"), part("total", "total_ms"),
    )


def batch_totals(timings: DataFrame) -> DataFrame:
    """One row (cases, and each stage's sum) from long timings (image_id, stage, ms)."""
    return timings.groupBy("stage").agg(F.count_distinct("image_id").alias("cases"), F.sum("ms").alias("ms"))
