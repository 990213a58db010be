"""Search in blocks against sums in the order of the values."""

import numpy as np
from pyspark.sql import functions as F

from paneweave.functions import vectors as v
from paneweave.operators import icons


def test_top_k_is_brute_force(spark):
    """Copies, vectors of other lengths, null, NaN and endless values, no vector at all; blocks of 7 rows."""
    rng = np.random.default_rng(5)
    some = [x.tolist() for x in rng.normal(size=(40, 8)).astype(np.float32)]
    odd = [None, [], [1.0] * 7, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [0.5] * 7, [0.0] * 8]
    rows = [(i, x) for i, x in enumerate(some + some[:20] + [some[0]] * 12 + odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = table.select(F.col("vec_id").alias("name"), "embedding", F.col("vec_id").alias("own"))
    asked = table.select(F.col("vec_id").alias("query"), "embedding", F.col("vec_id").alias("own"))
    pairs = asked.withColumnRenamed("embedding", "q").join(index.select("name", "embedding"), F.col("own") != F.col("name"))
    scored = pairs.select("query", "name", v.dot(F.col("q"), F.col("embedding")).alias("score"))
    for k in (1, 5, 100):
        wanted = {}
        for r in scored.orderBy("query", F.desc("score"), "name").collect():
            wanted.setdefault(r["query"], []).append((r["name"], repr(r["score"])))
        for rows_each in (7, 50_000):
            got = {}
            for r in icons.top_k(asked, index, k, exclude_same="own", broadcast_rows=rows_each).orderBy("query", "rank").collect():
                got.setdefault(r["query"], []).append((r["name"], repr(r["score"])))
            assert got == {q: x[:k] for q, x in wanted.items()}


def test_top_k_makes_no_row_for_each_pair(spark):
    """Pairs of a query and a vector stay inside a block."""
    table = spark.range(50).select(F.col("id").alias("name"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    plan = icons.top_k(table.withColumnRenamed("name", "query"), table, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
