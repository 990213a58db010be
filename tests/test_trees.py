"""Tree, word and icon operators against plain Python models on random data."""

import random

import pytest
from pyspark.sql import functions as F

from paneweave.functions import geometry as g
from paneweave.operators import classify, hierarchy, icons, words
from paneweave.schema import BOUNDS, ELEMENTS, WORDS


def bounds(rng, size=200):
    return {"x": rng.randint(0, size), "y": rng.randint(0, size), "width": rng.randint(2, size), "height": rng.randint(2, size)}


def redundant(p, c):
    m = [c["x"] - p["x"], c["y"] - p["y"], p["x"] + p["width"] - c["x"] - c["width"], p["y"] + p["height"] - c["y"] - c["height"]]
    ratio = c["width"] * c["height"] / max(1, p["width"] * p["height"])
    return min(m) >= 0 and (ratio >= 0.82 or max(m) <= 10 or (ratio <= 0.65 and max(m) <= 20 and max(m) - min(m) <= 6))


def random_tree(rng, image):
    out = [(image, [], 0, "root", {"x": 0, "y": 0, "width": 300, "height": 300}, None, None, None)]
    for _ in range(40):
        parent = rng.choice(out)
        p = parent[4]
        inset = [rng.randint(0, 25) for _ in range(4)]
        b = {"x": p["x"] + inset[0], "y": p["y"] + inset[1], "width": max(1, p["width"] - inset[0] - inset[2]), "height": max(1, p["height"] - inset[1] - inset[3])}
        n = sum(e[1][:-1] == parent[1] and len(e[1]) == len(parent[1]) + 1 for e in out)
        out.append((image, [*parent[1], n], len(parent[1]) + 1, "container", b, None, None, None))
    return out


def test_prune_removes_whole_subtrees(spark):
    rng = random.Random(1)
    rows = [r for i in range(12) for r in random_tree(rng, f"i{i}")]
    known = {(r[0], tuple(r[1])): r for r in rows}
    want = {k for k, r in known.items() if not any(redundant(known[r[0], tuple(r[1][: d - 1])][4], known[r[0], tuple(r[1][:d])][4]) for d in range(1, len(r[1]) + 1))}
    got = hierarchy.prune(spark.createDataFrame(rows, ELEMENTS))
    assert {(r["image_id"], tuple(r["path"])) for r in got.collect()} == want


def test_link_above_the_limit_goes_to_the_top(spark):
    rows = [
        ("a", 0, None, {"x": 0, "y": 0, "width": 100, "height": 100}, True),
        ("a", 1, 0, {"x": 0, "y": 0, "width": 100, "height": 60}, True),
        ("a", 2, 1, {"x": 0, "y": 0, "width": 100, "height": 30}, False),
        ("a", 3, 2, {"x": 0, "y": 0, "width": 100, "height": 59}, True),  # IoU with 1 beyond 0.92
    ]
    nodes = spark.createDataFrame(rows, f"image_id string, id int, parent_id int, bounds {BOUNDS}, kept boolean")
    up = hierarchy.nearest_kept_ancestor(nodes)
    assert {r["id"]: r["ancestor"] for r in up.collect()} == {0: None, 1: 0, 3: 1}
    linked = hierarchy.accept_parents(nodes, up)
    assert {r["id"]: r["parent"] for r in linked.collect()} == {0: None, 1: 0, 3: None}
    tree = hierarchy.build_tree(linked, spark.createDataFrame([("a", 100, 100), ("empty", 5, 6)], "image_id string, width int, height int"))
    assert {(r["image_id"], tuple(r["path"]), r["kind"]) for r in tree.collect()} == {("a", (), "root"), ("a", (0,), "container"), ("a", (0, 0), "container"), ("a", (1,), "container"), ("empty", (), "root")}


def model_lines(ws):
    ws = sorted(ws, key=lambda w: (w["bounds"]["y"], w["bounds"]["x"], w["word_id"]))
    near = max(sorted(w["bounds"]["height"] for w in ws)[len(ws) // 2] // 2, 4)
    lines = []
    for w in ws:
        if lines and abs(w["bounds"]["y"] - lines[-1][0]["bounds"]["y"]) <= near:
            lines[-1].append(w)
        else:
            lines.append([w])
    return [" ".join(w["text"] for w in sorted(line, key=lambda w: (w["bounds"]["x"], w["bounds"]["y"], w["word_id"]))) for line in lines]


def test_words_go_to_the_smallest_box_and_to_lines(spark):
    rng = random.Random(2)
    rows = [r for i in range(6) for r in random_tree(rng, f"i{i}")]
    ws = [(f"i{i}", k, f"w{k}", {**bounds(rng, 280), "width": rng.randint(1, 20), "height": rng.randint(1, 20)}, 50.0) for i in range(6) for k in range(40)]
    elements, found = spark.createDataFrame(rows, ELEMENTS), spark.createDataFrame(ws, WORDS)
    got = words.attach_words(elements, found).where("kind = 'text'").collect()
    held = {}
    for image, k, text, b, _ in ws:
        cx, cy = b["x"] + b["width"] // 2, b["y"] + b["height"] // 2
        inside = [r for r in rows if r[0] == image and r[4]["x"] <= cx < r[4]["x"] + r[4]["width"] and r[4]["y"] <= cy < r[4]["y"] + r[4]["height"]]
        if inside:
            best = max(inside, key=lambda r: (-r[4]["width"] * r[4]["height"], r[1]))
            held.setdefault((image, tuple(best[1])), []).append({"word_id": k, "text": text, "bounds": b})
    want = {(image, path, line) for (image, path), group in held.items() for line in model_lines(group)}
    assert {(r["image_id"], tuple(r["path"][:-1]), r["content"]) for r in got} == want
    for (image, path), group in held.items():  # texts stand after the children that were there
        had = sum(r[0] == image and tuple(r[1][:-1]) == path and len(r[1]) == len(path) + 1 for r in rows)
        ordinals = sorted(r["path"][-1] for r in got if r["image_id"] == image and tuple(r["path"][:-1]) == path)
        assert ordinals == list(range(had, had + len(model_lines(group))))


def test_the_word_of_the_unit_example(spark):
    elements = spark.createDataFrame([("a", [], 0, "root", {"x": 0, "y": 0, "width": 100, "height": 100}, None, None, None), ("a", [0], 1, "container", {"x": 10, "y": 10, "width": 40, "height": 40}, None, None, None)], ELEMENTS)
    ws = spark.createDataFrame([("a", 0, "OK", {"x": 15, "y": 15, "width": 20, "height": 10}, 90.0)], WORDS)
    got = words.attach_words(elements, ws).where("kind = 'text'").first()
    assert (got["path"], got["content"], got["confidence"]) == ([0, 0], "OK", 90.0)


def test_icons(spark):
    box = lambda w, h: {"x": 0, "y": 0, "width": w, "height": h}
    rows = [("a", [], 0, "root", box(200, 200), None, None, None), ("a", [0], 1, "container", box(24, 24), None, None, None), ("a", [1], 1, "container", box(24, 24), None, None, None), ("a", [1, 0], 2, "text", box(9, 9), "x", None, 1.0), ("a", [2], 1, "container", box(80, 16), None, None, None)]
    elements = spark.createDataFrame(rows, ELEMENTS)
    assert [r["path"] for r in classify.icon_candidates(elements).collect()] == [[0]]
    index = spark.createDataFrame([("up", [1.0, 0.0]), ("down", [0.0, 1.0]), ("also up", [1.0, 0.0])], "name string, embedding array<float>")
    vectors = spark.createDataFrame([("a", [0], [1.0, 0.0]), ("a", [2], [0.0, 1.0])], "image_id string, path array<int>, embedding array<float>")
    got = {tuple(r["path"]): (r["kind"], r["name"]) for r in icons.attach_icons(elements, vectors, index).collect()}
    assert got[0,] == ("icon", "also up") and got[2,] == ("container", None)
    ranks = [icons.top_k(spark.createDataFrame([(1, [0.6, 0.8])], "query int, embedding array<float>"), index, 3, broadcast_rows=n).orderBy("rank").collect() for n in (10, 1)]
    assert [[r["name"] for r in x] for x in ranks] == [["down", "also up", "up"]] * 2
    assert icons.match_stats(icons.attach_icons(elements, vectors, index)).first().asDict() == {"image_id": "a", "candidates": 1, "matched": 1}


@pytest.mark.parametrize("n", [1, 2, 5])
def test_upper_median_threshold(spark, n):
    heights = F.array(*(F.lit(h) for h in range(20, 20 + n)))
    assert spark.range(1).select(words.line_threshold(heights)).first()[0] == (20 + n // 2) // 2


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], ELEMENTS)
    assert hierarchy.prune(empty).count() == 0
    assert words.attach_words(empty, spark.createDataFrame([], WORDS)).count() == 0
    assert g.bounds is not None
