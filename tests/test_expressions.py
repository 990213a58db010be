"""Column expressions at their boundaries."""

import pytest
from pyspark.sql import functions as F

from paneweave.config import ExtractConfig, annotated_path, dump_dir, models_dir, runtime_config
from paneweave.functions import geometry as g
from paneweave.functions import raster, text
from paneweave.functions import vectors as v
from paneweave.operators import classify


def box(x, y, w, h):
    return g.bounds(F.lit(x), F.lit(y), F.lit(w), F.lit(h))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_geometry(spark):
    a, b = box(0, 0, 10, 10), box(5, 5, 10, 10)
    assert value(spark, g.right(b)) == 15
    assert value(spark, g.area(box(0, 0, 100_000, 100_000))) == 10_000_000_000
    assert value(spark, g.intersection_area(a, b)) == 25
    assert value(spark, g.iou(a, b)) == pytest.approx(25 / 175)
    assert value(spark, g.iou(a, box(10, 0, 5, 5))) == 0
    assert value(spark, g.contains(a, a)) and not value(spark, g.contains(a, b))
    assert value(spark, g.holds_point(a, F.lit(9), F.lit(0))) and not value(spark, g.holds_point(a, F.lit(10), F.lit(0)))
    assert value(spark, g.center_x(box(1, 0, 5, 1))) == 3


def test_bounds_of_points_include_both_ends(spark):
    points = F.array(F.struct(F.lit(3).alias("x"), F.lit(4).alias("y")), F.struct(F.lit(7).alias("x"), F.lit(4).alias("y")))
    assert value(spark, g.bounds_of_points(points)).asDict() == {"x": 3, "y": 4, "width": 5, "height": 1}


@pytest.mark.parametrize(
    ("w", "h", "hole", "want"),
    [(1, 500, False, "dropped_thin"), (2, 50, False, "kept"), (9, 11, False, "dropped_area"), (10, 10, False, "kept"), (39, 500, True, "dropped_hole"), (40, 50, True, "kept"), (40, 49, True, "dropped_hole")],
)
def test_contour_reason(spark, w, h, hole, want):
    assert value(spark, classify.contour_reason(box(0, 0, w, h), F.lit(hole))) == want


@pytest.mark.parametrize(
    ("parent", "child", "want"),
    [
        ((0, 0, 100, 100), (0, 0, 82, 100), True),  # ratio of exactly 0.82
        ((0, 0, 100, 100), (15, 15, 70, 70), True),  # uniform within 20, ratio 0.49
        ((0, 0, 100, 100), (11, 18, 70, 71), False),  # margins differ by 8
        ((0, 0, 40, 40), (10, 10, 20, 20), True),  # tight
        ((0, 0, 100, 100), (-1, 0, 90, 100), False),  # not inside
        ((0, 0, 100, 100), (50, 50, 10, 10), False),
    ],
)
def test_redundant(spark, parent, child, want):
    assert value(spark, classify.is_redundant(box(*parent), box(*child))) is want
    assert value(spark, classify.is_redundant(box(*parent), box(*child), F.lit("text"))) is False


@pytest.mark.parametrize(("w", "h", "want"), [(12, 12, True), (11, 12, False), (96, 96, True), (97, 96, False), (22, 40, True), (21, 40, False), (37, 20, True), (38, 20, False)])
def test_icon_shape(spark, w, h, want):
    assert value(spark, classify.icon_shape(box(0, 0, w, h))) is want


@pytest.mark.parametrize(("ms", "want"), [(1500.0, "1.50s"), (42.0, "42ms"), (9.96, "10.0ms"), (0.25, "0.2ms"), (42.5, "42ms"), (999.6, "1000ms")])
def test_format_ms(spark, ms, want):
    assert value(spark, text.format_ms(F.lit(ms))) == want


def test_labels_and_escapes(spark):
    assert value(spark, text.truncate_label(F.lit("  " + "é" * 24 + " "))) == "é" * 24
    assert value(spark, text.truncate_label(F.lit("x" * 25))) == "x" * 24 + "…"
    assert value(spark, text.html_escape(F.lit("<a href='x'>\"&\""))) == "&lt;a href=&#39;x&#39;&gt;&quot;&amp;&quot;"
    assert value(spark, text.depth_color(F.lit(9))) == text.DEPTH_COLORS[0]
    assert [value(spark, text.font_size(F.lit(h))) for h in (1, 18, 100)] == [8, 12, 16]


def test_vectors(spark):
    u = F.array(*(F.lit(x).cast("float") for x in (3.0, 4.0)))
    assert value(spark, v.l2_normalize(u)) == pytest.approx([0.6, 0.8])
    assert value(spark, v.l2_normalize(F.array(F.lit(0.0)))) == [0.0]
    assert value(spark, v.dot(u, u)) == 25
    with pytest.raises(Exception, match="512 wanted"):
        value(spark, v.finalize(u))
    assert value(spark, v.planes(F.array(*map(F.lit, (255, 0, 51, 0, 255, 102))))) == pytest.approx([1, 0, 0, 1, 0.2, 0.4])


def test_raster(spark):
    assert value(spark, raster.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    flat = F.array(*[F.lit(9)] * 4)
    assert value(spark, raster.adaptive_threshold(flat, F.lit(9))) == 24
    assert value(spark, raster.takes_dark(F.lit(3), F.lit(20), F.lit(64))) is True
    assert value(spark, raster.takes_dark(F.lit(60), F.lit(50), F.lit(64))) is False
    assert value(spark, raster.takes_dark(F.lit(60), F.lit(52), F.lit(64))) is True


def test_config(monkeypatch, tmp_path):
    got = ExtractConfig.from_json('{"run_ocr": false, "layout": {"min_area": 7}, "icon": {"min_cosine": 0.5}, "unknown": 1, "models_dir": "m"}')
    assert not got.run_ocr and got.layout.min_area == 7 and got.layout.min_hole_area == 2000 and got.icon.min_cosine == 0.5 and got.models_dir == "m"
    assert ExtractConfig.from_json('{"models_dir": "m"}', borrowed=True).models_dir == "."
    assert ExtractConfig.from_json(None) == ExtractConfig()
    monkeypatch.delenv("LOCAL_INFER_ROOT", raising=False)
    assert models_dir() == "./models" and models_dir("a") == "a"
    monkeypatch.setenv("LOCAL_INFER_ROOT", "env")
    assert models_dir("a") == "env"
    (tmp_path / "r.json").write_text('{"threads": 2}')
    assert runtime_config(str(tmp_path / "r.json")) == {"threads": 2} == runtime_config('{"threads": 2}')
    assert dump_dir("a/b.png") == "a/pipeline" and dump_dir("b.png") == "pipeline" and dump_dir("a/b.png", "c/d.json") == "c/pipeline"
    assert annotated_path("x.JSON") == "x.png"
