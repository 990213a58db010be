"""Words and the elements that hold them, where very many elements lie upon each other."""

import random

from pyspark.sql import functions as F

from paneweave.operators import words

BOX = "struct<x: int, y: int, width: int, height: int>"


def box(x, y, w, h):
    return {"x": x, "y": y, "width": w, "height": h}


def tables(spark, n_words=200, n_nodes=2000, seed=3):
    """Boxes pile up on few places, some without width; sides from 1 to 2000 pixels, also left of and above 0."""
    rng = random.Random(seed)
    ws = [(rng.randrange(2), i, box(rng.randrange(-60, 300), rng.randrange(-60, 120), rng.randrange(40), rng.randrange(40))) for i in range(n_words)]
    sides = [0, 1, 7, 16, 17, 40, 100, 2000]
    ns = [(rng.randrange(2), i, box(rng.randrange(-3, 12) * 20, rng.randrange(-3, 5) * 20, rng.choice(sides), rng.choice(sides))) for i in range(n_nodes)]
    return ws, ns, spark.createDataFrame(ws, f"layout int, word_id int, bounds {BOX}"), spark.createDataFrame(ns, f"layout int, node int, node_bounds {BOX}")


def test_smallest_enclosing_is_brute_force(spark):
    ws, ns, w, n = tables(spark)
    wanted = {}
    for layout, i, b in ws:
        x, y = b["x"] + b["width"] // 2, b["y"] + b["height"] // 2
        hits = [(-r["width"] * r["height"], k) for at, k, r in ns if at == layout and r["x"] <= x < r["x"] + r["width"] and r["y"] <= y < r["y"] + r["height"]]
        if hits:
            wanted[i] = max(hits)[1]
    for most in (0, 10**6):  # lists joined by their cell, and broadcast
        rows = words.smallest_enclosing(w, n, ["layout"], ["layout", "word_id"], "node", ["node"], broadcast_nodes=most).collect()
        assert {r["word_id"]: r["node"] for r in rows} == wanted and len(rows) == len(wanted)
        assert all(r["node_bounds"].asDict() == ns[r["node"]][2] for r in rows)


def test_a_word_meets_few_of_the_boxes_upon_it(spark):
    """Ten boxes in the place of each leave lists of the same length."""
    _, _, w, n = tables(spark)
    cells = w.select("layout", F.floor(F.col("bounds.x") / 16).alias("__cx"), F.floor(F.col("bounds.y") / 16).alias("__cy")).distinct()
    many = n.withColumn("node", F.explode(F.sequence(F.col("node"), F.col("node") + 9 * 2000, F.lit(2000))))
    once, tenfold = (words.listed_nodes(cells, x, ["layout"], "node", ["node"], 16).agg(F.sum(F.size("__list")), F.max(F.size("__list"))).first() for x in (n, many))
    assert tuple(once) == tuple(tenfold) and once[1] < 100


def test_boxes_and_lines_hold_the_words_once(spark):
    """The words are numbered and joined once for boxes and lines together."""
    from paneweave.plans import queries

    plan = queries.attach_words_ordered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number() windowspecdefinition(l_orderkey") == 1
