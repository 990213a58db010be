"""Connected components.

Many links go through alternating large-star and small-star steps, which are DataFrame operations and
spread over all executors.  LOCAL_LINKS links or fewer fit one task, which unites them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, map_arrow, stored

LOCAL_LINKS = 500_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes but roots; a root is the least id of its component."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (up := above.get(root, root)) != root:
            root = up
        while x != root:
            above[x], x = root, above[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                above[max(u, v)] = min(u, v)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "root"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large) or the smaller and equal (small) neighbours of each node to the least of all."""
    if large:
        edges = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return edges.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected(edges: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(u, v) links of long ids to (node, root): the least id that can be reached, for all nodes but roots."""
    now = stored(edges.select("u", "v").where("u != v"), "edges")
    if now.count() <= local_links:
        return map_arrow(now.coalesce(1), _unite, "node long, root long")
    mark = None
    while True:
        before, now = now, stored(_star(_star(now, True), False), "edges")
        discard(before)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = found
