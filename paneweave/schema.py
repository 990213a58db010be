"""Schemas of the flat tables.  Text confidence runs from 0 to 100, icon confidence from 0 to 1."""

from __future__ import annotations

BOUNDS = "struct<x: int, y: int, width: int, height: int>"
POINT = "struct<x: int, y: int>"
IMAGES = "image_id string, path string, width int, height int"
CONTOURS = f"image_id string, contour_id int, parent_id int, border_type string, bounds {BOUNDS}, points array<{POINT}>"
ELEMENTS = f"image_id string, path array<int>, depth int, kind string, bounds {BOUNDS}, content string, name string, confidence float"
WORDS = f"image_id string, word_id int, text string, bounds {BOUNDS}, confidence float"
ICON_INDEX = "pack_id string, name string, embedding array<float>"
TIMINGS = "image_id string, stage string, ms double"
MANIFEST = "id string, kind string, embed_model_id string"
OCR_JSON = f"struct<words: array<struct<text: string, bounds: {BOUNDS}, confidence: double>>, timings: struct<init_ms: double, predict_ms: double, det_ms: double, rec_ms: double, post_ms: double>>"
HITS_JSON = "array<struct<name: string, score: double>>"
