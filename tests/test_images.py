"""Image kernels, contours, documents and the whole extraction on drawn screens."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneweave import __main__
from paneweave.config import ExtractConfig, OcrConfig
from paneweave.imaging import contours, kernels, png
from paneweave.plans.extractor import Extractor
from paneweave.schema import ELEMENTS, WORDS
from paneweave.sinks import documents as sinks
from paneweave.sources import cases, documents, images, packs
from paneweave.streaming.ingest import extract_stream, image_stream


def screen(size=200, boxes=((40, 40, 80, 60),)):
    out = np.full((size, size), 255, np.uint8)
    for x, y, w, h in boxes:
        out[y, x : x + w] = out[y + h - 1, x : x + w] = out[y : y + h, x] = out[y : y + h, x + w - 1] = 0
    return out


def test_png_round_trip():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (13, 7, 3), dtype=np.uint8)
    assert (png.decode(png.encode(rgb)) == rgb).all()
    gray = rng.integers(0, 256, (5, 9), dtype=np.uint8)
    assert (png.decode(png.encode(gray))[:, :, 0] == gray).all()
    with pytest.raises(ValueError, match="not a PNG"):
        png.decode(b"nothing")


def test_kernels():
    flat = np.full((20, 20), 77, np.uint8)
    assert (kernels.blur3(flat) == 77).all() and not kernels.canny(flat).any()
    dot = np.zeros((9, 9), np.uint8)
    dot[4, 4] = 255
    assert kernels.dilate(dot, 1).sum() == 9 * 255 and kernels.close(dot, 1) is dot
    assert (kernels.erode(kernels.dilate(dot, 2), 2) == dot).all()
    assert kernels.crop(flat, -5, -5, 8, 8).shape == (3, 3) and kernels.crop(flat, 30, 0, 5, 5) is None
    assert (kernels.resize(flat, 48, 48) == 77).all()
    icon = np.full((32, 32), 255, np.uint8)
    icon[8:24, 8:24] = 0
    mask, dark = kernels.ink_mask(icon)
    assert dark and mask.sum() > 20 and mask[24, 24]
    assert (kernels.model_input(icon)[128, 128] == 0).all() and kernels.to_nchw(kernels.model_input(icon)).shape == (3, 256, 256)


def test_contours_know_their_parents():
    image = np.zeros((30, 30), np.uint8)
    image[2:28, 2:28] = 1
    image[5:25, 5:25] = 0  # a hole
    image[8:20, 8:20] = 1  # a box in it
    image[26, 29] = 1  # a single pixel
    found = contours.trace(image)
    assert [(c.is_hole, c.parent) for c in found] == [(False, None), (True, 0), (False, 1), (False, None)]
    box = [(min(p[i] for p in c.points), max(p[i] for p in c.points)) for c in found for i in (0,)]
    assert box == [(2, 27), (4, 25), (8, 19), (29, 29)]


def test_extraction_finds_the_box_and_its_word(spark, tmp_path):
    good, empty = png.encode(screen()), png.encode(np.full((50, 60), 255, np.uint8))
    rows = spark.createDataFrame([("a", bytearray(good)), ("none", None), ("bad", bytearray(b"x")), ("blank", bytearray(empty))], "image_id string, content binary")
    decoded = images.decode_bytes(rows)
    assert {r["image_id"] for r in decoded.where("error is not null").collect()} == {"none", "bad"}
    found = spark.createDataFrame([("a", 0, "OK", {"x": 60, "y": 60, "width": 20, "height": 10}, 90.0)], WORDS)
    out = Extractor(spark, ExtractConfig(), words=found).extract_bytes(rows).persist()
    boxes = out.where("kind = 'container'").collect()
    assert any(abs(b["bounds"]["x"] - 40) <= 8 and abs(b["bounds"]["width"] - 80) <= 16 for b in boxes)
    assert all(b["bounds"]["width"] * b["bounds"]["height"] >= 100 for b in boxes)
    text = out.where("kind = 'text'").first()
    assert text["content"] == "OK" and len(text["path"]) >= 2
    assert out.where("image_id = 'blank'").count() == 1  # the root
    document = {r["image_id"]: json.loads(r["json"]) for r in sinks.results_json(out).collect()}
    assert document["a"]["width"] == 200 and document["blank"]["root"] == {"bounds": {"x": 0, "y": 0, "width": 60, "height": 50}, "kind": "root"}
    page = {r["image_id"]: r["html"] for r in sinks.skeleton_html(out).collect()}
    assert "L2 · text" in page["a"] and "200 by 200 pixels" in page["a"] and 'title="OK · 90%"' in page["a"]
    drawn = sinks.annotated(rows.where("image_id = 'a'"), out).first()["png"]
    assert (png.decode(bytes(drawn)) != 255).any(2).sum() > (screen() != 255).sum()


def test_results_round_trip(spark, tmp_path):
    rows = [
        ("a", [], 0, "root", {"x": 0, "y": 0, "width": 10, "height": 20}, None, None, None),
        ("a", [0], 1, "container", {"x": 1, "y": 1, "width": 5, "height": 5}, None, None, None),
        ("a", [0, 0], 2, "text", {"x": 1, "y": 1, "width": 2, "height": 2}, "é\"", None, 99.5),
        ("a", [0, 4], 2, "icon", {"x": 3, "y": 1, "width": 2, "height": 2}, None, "mdi:x", 0.75),
    ]
    elements = spark.createDataFrame(rows, ELEMENTS)
    as_json = sinks.results_json(elements, pretty=True)
    assert list(json.loads(as_json.first()["json"])["root"]["children"][0]["children"][0]) == ["bounds", "kind", "content", "confidence"]
    back = {tuple(r["path"]): r for r in documents.flatten_results(as_json).collect()}
    assert set(back) == {(), (0,), (0, 0), (0, 1)} and back[0, 1]["name"] == "mdi:x" and back[0, 0]["confidence"] == 99.5
    sinks.write_results(elements, str(tmp_path / "out"))
    (tmp_path / "cases/a").mkdir(parents=True)
    (tmp_path / "cases/a/output.json").write_text(as_json.first()["json"])
    assert documents.read_results(spark, str(tmp_path / "cases")).count() == 4


def test_ocr_documents(spark):
    good = {"words": [{"text": "hi", "bounds": {"x": 1, "y": 2, "width": 3}, "confidence": 99.0}, {"bounds": {}}], "timings": {"predict_ms": 5}}
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, '{"words": [], "timings": {}}')], "k int, j string")
    got = documents.ocr_words(rows, "k", "j").collect()
    assert [(r["word_id"], r["text"], r["bounds"]["height"], r["confidence"]) for r in got] == [(0, "hi", 0, 99.0), (1, "", 0, 0.0)]
    assert documents.ocr_timings(rows, "k", "j").where("k = 1").first()["predict_ms"] == 5
    for bad in ('{"timings": {}}', '{"words": []}', '{"words": [{"text": "x"}], "timings": {}}'):
        with pytest.raises(Exception, match="missing field"):
            documents.ocr_words(spark.createDataFrame([(1, bad)], "k int, j string"), "k", "j").collect()
    hits = spark.createDataFrame([(1, "null"), (2, '{"name": "a", "score": 0.5}'), (3, '[null, {"name": "b", "score": 0.25}]')], "k int, j string")
    assert [(r["k"], r["position"], r["name"]) for r in documents.icon_matches(hits, "k", "j").orderBy("k").collect()] == [(2, 0, "a"), (3, 1, "b")]
    timed = spark.createDataFrame([(1, '{"timings": {"gray_ms": 2.5, "ocr": {"det_ms": 1}}}'), (2, "{}")], "k int, j string")
    got = {(r["k"], r["stage"]): r["ms"] for r in documents.extract_timings(timed, "k", "j").collect()}
    assert got[1, "gray_ms"] == 2.5 and got[1, "ocr.det_ms"] == 1 and got[2, "layout_ms"] == 0


def test_cases_and_packs(spark, tmp_path):
    for name, files in {"b": ["input.gif", "input.jpg"], "a": ["input.png", "output.json"]}.items():
        (tmp_path / "cases" / name).mkdir(parents=True)
        for f in files:
            (tmp_path / "cases" / name / f).write_bytes(png.encode(screen(60, ((10, 10, 30, 30),))))
    assert [r["case"] for r in cases.list_cases(spark, str(tmp_path / "cases")).collect()] == ["a", "b"]
    got = cases.read_cases(spark, str(tmp_path / "cases")).collect()
    got.sort(key=lambda r: r["case"])
    assert [(r["case"], r["path"].rsplit("/", 1)[1]) for r in got] == [("a", "input.png"), ("b", "input.jpg")]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        cases.read_cases(spark, str(tmp_path / "none"))
    Extractor(spark).write_cases(str(tmp_path / "cases"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/json"), wholetext=True).count() == 2

    for pack, manifest in {"e": {"id": "e", "kind": "embed"}, "i": {"id": "i", "kind": "icon_index", "embed_model_id": "e"}, "j": {"id": "j", "kind": "icon_index"}}.items():
        (tmp_path / "models" / pack).mkdir(parents=True)
        (tmp_path / "models" / pack / "manifest.json").write_text(json.dumps(manifest))
    spark.createDataFrame([("up", [1.0])], "name string, embedding array<float>").write.parquet(str(tmp_path / "models/i/index.parquet"))
    registry = packs.Registry(spark, str(tmp_path / "models"))
    assert registry.pack_ids() == ["e", "i", "j"] and registry.icon_index("i").first()["embed_model_id"] == "e"
    for pack, kind in (("x", None), ("e", "ocr")):
        with pytest.raises(packs.PackError):
            registry.manifest(pack, kind)
    with pytest.raises(packs.PackError, match="embed_model_id"):
        registry.icon_index("j")
    models = str(tmp_path / "models")
    assert packs.setup_issues(spark, models, {"i": "icon_index", "e": "embed"}) == []
    assert packs.setup_issues(spark, models, {"x": "ocr", "e": "ocr"}) == ["pack x not found", "pack e is of kind embed, not ocr"]
    assert packs.setup_issues(spark, str(tmp_path / "nothing"), {"i": "icon_index"}) == [f"no packs in {tmp_path / 'nothing'}"]
    config = replace(ExtractConfig(), models_dir=models, icon_index_pack="i")
    assert Extractor.from_packs(spark, config, embed=lambda x: x).icon_index is not None and Extractor.from_packs(spark, config).icon_index is None
    with pytest.raises(packs.PackError):
        Extractor.from_packs(spark, replace(config, icon_index_pack="j"), embed=lambda x: x)
    given = __main__.arguments().parse_args(["extract", "--input", "a", "--icon-index-pack", "i", "--embed-backend", "math:sqrt", "--annotate", "x"])
    assert __main__.settings(given).icon_index_pack == "i" and __main__.backend(given.embed_backend)(4) == 2 and __main__.backend(None) is None
    counted = spark.createDataFrame([(1, '{"timings": {"icon": {"candidates": 4, "matched": 2}}}'), (2, "{}")], "k int, j string")
    assert [tuple(r) for r in documents.icon_counts(counted, "k", "j").orderBy("k").collect()] == [(1, 4, 2), (2, 0, 0)]


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.png").write_bytes(png.encode(screen(80, ((10, 10 + i, 40, 30),))))
    made = Extractor(spark)
    extract_stream(made, image_stream(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(300)
    key = lambda df: sorted((r["image_id"].rsplit("/", 1)[1], r["path"], r["bounds"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(made.extract_files(str(tmp_path / "in")))


def test_stage_line(spark):
    c = {k: F.lit(x) for k, x in {"load_ms": 1.0, "gray_ms": 2.0, "layout_ms": 42.0, "total_ms": 1500.0, "write_json_ms": 1.0, "write_annotation_ms": 0.0, "ocr_ms": 80.0, "parallel_ms": 120.0, "icon_match_ms": 25.0}.items()}
    got = spark.range(1).select(sinks.stage_line(c)).first()[0]
    assert got == "load 1.0ms | gray 2.0ms | layout 42ms | parallel_wall 120ms | ocr 80ms | icon 0.0ms+25ms | json 1.0ms | annotate 0.0ms | total 1.50s"
    rows = spark.createDataFrame([("a", "gray_ms", 1.0), ("b", "gray_ms", 2.0)], "image_id string, stage string, ms double")
    assert sinks.batch_totals(rows).first().asDict() == {"stage": "gray_ms", "cases": 2, "ms": 3.0}


def written(spark, gray, kind, form, progressive=False):
    """An image file of gray pixels by the JVM's writers."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(gray.shape[1], gray.shape[0], getattr(jvm.java.awt.image.BufferedImage, kind))
    for y in range(gray.shape[0]):
        for x in range(gray.shape[1]):
            v = int(gray[y, x])
            image.setRGB(x, y, (v << 16 | v << 8 | v) - (1 << 24))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(form).next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)  # MODE_DEFAULT
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


def test_png_of_other_depths_and_interlaced(spark):
    gray = screen(29, ((5, 6, 15, 12),))
    for kind in ("TYPE_USHORT_GRAY", "TYPE_BYTE_BINARY", "TYPE_INT_RGB"):
        for progressive in (False, True):
            assert (png.decode(written(spark, gray, kind, "png", progressive)) == gray[:, :, None]).all(), (kind, progressive)


def test_other_formats_and_unreadable_cases(spark, tmp_path):
    gray = screen(60, ((10, 10, 30, 30),))
    for name, data in {"j j+é/input.jpg": written(spark, gray, "TYPE_INT_RGB", "jpeg"), "g/input.gif": written(spark, gray, "TYPE_INT_RGB", "gif"), "w/input.webp": b"RIFF....WEBP"}.items():
        (tmp_path / "cases" / name).parent.mkdir(parents=True)
        (tmp_path / "cases" / name).write_bytes(data)
    made = Extractor(spark)
    made.write_cases(str(tmp_path / "cases"), str(tmp_path / "out"))
    assert {r["case"] for r in spark.read.text(str(tmp_path / "out/json"), wholetext=True).collect()} == {"j j+é", "g"}
    assert {r["image_id"] for r in spark.read.parquet(str(tmp_path / "out/annotated")).collect()} == {"j j+é", "g"}
    assert [r["case"] for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()] == ["w"]
    assert made.extract_files(str(tmp_path / "cases")).select("image_id").distinct().count() == 2
    extract_stream(made, image_stream(spark, str(tmp_path / "cases")), str(tmp_path / "s"), str(tmp_path / "check")).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "s")).select("image_id").distinct().count() == 2
    assert spark.read.parquet(str(tmp_path / "s_errors")).count() == 1


def test_ocr_settings_reach_the_back_end(spark):
    def backend(gray, config):
        return [{"text": f"{config.max_side} {config.min_confidence}", "x": 60, "y": 60, "width": 20, "height": 10, "confidence": 90.0}]

    rows = spark.createDataFrame([("a", bytearray(png.encode(screen())))], "image_id string, content binary")
    out = Extractor(spark, ExtractConfig(ocr=OcrConfig(min_confidence=0.25, max_side=123)), ocr=backend).extract_bytes(rows)
    assert [r["content"] for r in out.where("kind = 'text'").collect()] == ["123 0.25"]


def test_png_filters(monkeypatch):
    """All filters, mixed, over several bands, against byte-by-byte sums."""
    monkeypatch.setattr(png, "_BAND", 4)
    rng = np.random.default_rng(3)
    for step in (1, 3, 6):
        for kinds in ([0, 1, 2], [0, 1, 2, 3, 4], [3], [4]):
            how, data = rng.choice(kinds, 11).astype(np.uint8), rng.integers(0, 256, (11, 5 * step), dtype=np.uint8)
            want = np.zeros(data.shape, int)
            for y in range(11):
                for i in range(data.shape[1]):
                    left = want[y, i - step] if i >= step else 0
                    above = want[y - 1, i] if y else 0
                    corner = want[y - 1, i - step] if y and i >= step else 0
                    near = min((left, above, corner), key=lambda v, p=left + above - corner: abs(p - v))
                    want[y, i] = (data[y, i] + (0, left, above, (left + above) // 2, near)[how[y]]) & 255
            assert (png._unfiltered(how, data, step) == want).all()


def test_matching_without_a_layout(spark):
    from paneweave.operators import icons

    gray = np.full((40, 40), 255, np.uint8)
    gray[10:30, 18:22] = 0
    crops = spark.createDataFrame([("c", 40, 40, bytearray(gray.tobytes()))], "query string, width int, height int, gray binary")
    one = [1.0] + [0.0] * 511
    index = spark.createDataFrame([("bar", one), ("other", one[::-1])], "name string, embedding array<float>")
    embed = lambda x: np.tile(np.array(one, np.float32), (len(x), 1))
    got = icons.match_crops(crops, embed, index).collect()
    assert [(r["query"], r["name"], round(r["score"], 5), r["rank"]) for r in got] == [("c", "bar", 1.0, 1)]
    box = "named_struct('x', 5, 'y', 5, 'width', 30, 'height', 30)"
    regions = crops.selectExpr("query as image_id", "array(0, 1) as path", f"{box} as bounds")
    got = icons.match_regions(crops.withColumnRenamed("query", "image_id"), regions, embed, index, 2).collect()
    assert [(r["image_id"], r["path"], r["name"]) for r in got] == [("c", [0, 1], "bar")]


def test_dump_shows_each_step(spark):
    rows = spark.createDataFrame([("a", bytearray(png.encode(screen()))), ("bad", bytearray(b"x"))], "image_id string, content binary")
    got = {r["file"]: bytes(r["content"]) for r in Extractor(spark).dump(rows).collect()}
    assert [m["file"] for m in json.loads(got["manifest.json"])] == sorted(got, key=lambda f: [m["file"] for m in json.loads(got["manifest.json"])].index(f))
    stats = json.loads(got["filter_stats.json"])
    assert stats["total"] == sum(v for k, v in stats.items() if k != "total") > 0 and stats["kept"] > 0
    every, kept = (png.decode(got[f])[:, :, 0] > 0 for f in ("06_contours_all.png", "07_contours_kept.png"))
    assert kept.any() and (every | ~kept).all()
    dropped = png.decode(got["07_contours_dropped.png"])
    assert not dropped[:, :, 1:].any() and ((dropped[:, :, 0] > 0) | kept == every).all()


def test_screens_are_dealt_out_to_all_cores(spark):
    from paneweave.plans import queries

    drawn = queries._screens(spark, "/root/testdata/sf0.01")
    assert spark.read.parquet("/root/testdata/sf0.01/part.parquet").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism <= drawn.rdd.getNumPartitions()
    assert queries.canny_contours(spark, "/root/testdata/sf0.001").count() > 0
