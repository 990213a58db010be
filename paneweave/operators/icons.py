"""Icon candidates against an index of embeddings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import IconConfig
from . import blocks
from .classify import icon_candidates

#: Rows of a block of the index, and of queries, at most on average.
INDEX_BLOCK, QUERY_BLOCK = 5_000, 10_000
BROADCAST_ROWS = 50_000


def top_k(queries: DataFrame, index: DataFrame, k: int = 1, min_score: float | None = None, exclude_same: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The ``k`` nearest names of each query by cosine: (query, name, score, rank), ties by name.

    Every query is compared with the whole index, in blocks of queries and of the index: a matrix product
    finds what comes near a query's ``k`` best of a block, those are added up in the order of ``vectors.dot``,
    and the ``k`` best of all blocks meet in the end.  ``broadcast_rows`` bounds a block of the index.
    """
    k = max(1, k)
    of = lambda rows, most: max(1, -(-rows.count() // most))
    n_index, n_asked = of(index, max(1, min(broadcast_rows, INDEX_BLOCK))), of(queries, QUERY_BLOCK)
    own = lambda name: [F.col(exclude_same).alias(name)] if exclude_same else [F.lit(None).cast("int").alias(name)]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = index.select("name", F.col("embedding").cast("array<double>").alias("e"), *own("same"), F.pmod(F.xxhash64("name"), F.lit(n_index)).cast("int").alias("ib"), every(n_asked).alias("qb"))
    asked = queries.select("query", F.col("embedding").cast("array<double>").alias("q"), *own("own"), F.pmod(F.xxhash64("query"), F.lit(n_asked)).cast("int").alias("qb"), every(n_index).alias("ib"))
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, name {named.schema['name'].dataType.simpleString()}, score double"

    def best(q: pa.Table, e: pa.Table) -> pa.Table:
        asked_at, found_at, scores = blocks.best_pairs(q["q"], e["e"], e["name"], q["own"] if exclude_same else None, e["same"], k)
        return pa.table({"query": q["query"].take(pa.array(asked_at, pa.int64())), "name": e["name"].take(pa.array(found_at, pa.int64())), "score": pa.array(scores, pa.float64())})

    scored = asked.groupBy("qb", "ib").cogroup(named.groupBy("qb", "ib")).applyInArrow(best, kinds)
    scored = scored if min_score is None else scored.where(F.col("score") >= min_score)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "name"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def replace_matched(elements: DataFrame, hits: DataFrame, by: str = "image_id") -> DataFrame:
    """Elements whose matched containers have become icons; ``hits`` has by, path, name and score."""
    found = hits.select(by, "path", F.col("name").alias("__name"), F.col("score").alias("__score"))
    hit = F.col("__name").isNotNull()
    return elements.join(found, [by, "path"], "left").select(
        by, "path", "depth", F.when(hit, "icon").otherwise(F.col("kind")).alias("kind"), "bounds", "content",
        F.coalesce("__name", "name").alias("name"), F.coalesce(F.col("__score").cast("float"), "confidence").alias("confidence"),
    )


def attach_icons(elements: DataFrame, embeddings: DataFrame, index: DataFrame, by: str = "image_id", config: IconConfig = IconConfig()) -> DataFrame:
    """Candidates joined with their embeddings (by, path, embedding), matched, and replaced."""
    wanted = icon_candidates(elements, config).select(by, "path").join(embeddings, [by, "path"])
    key = F.struct(by, "path")
    hits = top_k(wanted.select(key.alias("query"), "embedding"), index, 1, config.min_cosine)
    return replace_matched(elements, hits.select(f"query.{by}", "query.path", "name", "score"), by)


def match_stats(elements: DataFrame, config: IconConfig = IconConfig(), by: str = "image_id") -> DataFrame:
    """Candidates before and matches after: (by, candidates, matched)."""
    open_ = icon_candidates(elements, config).groupBy(by).agg(F.count("*").alias("__open"))
    done = elements.groupBy(by).agg(F.count_if(F.col("kind") == "icon").alias("matched"))
    return done.join(open_, by, "left").select(by, (F.coalesce("__open", F.lit(0)) + F.col("matched")).alias("candidates"), "matched")


def match_crops(crops: DataFrame, embed, index: DataFrame, k: int = 1, config: IconConfig = IconConfig()) -> DataFrame:
    """(query, name, score, rank) of crops (query, width, height, gray) by themselves, without a layout."""
    from ..imaging.operators import embed_candidates

    whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), "width", "height").alias("bounds")
    images = crops.select(F.col("query").alias("image_id"), "width", "height", "gray")
    wanted = crops.select(F.col("query").alias("image_id"), F.expr("cast(array() as array<int>)").alias("path"), whole)
    found = embed_candidates(images, wanted, embed, config)
    return top_k(found.select(F.col("image_id").alias("query"), "embedding"), index, k, config.min_cosine)


def match_regions(images: DataFrame, regions: DataFrame, embed, index: DataFrame, k: int = 1, config: IconConfig = IconConfig()) -> DataFrame:
    """(image_id, path, name, score, rank) of regions (image_id, path, bounds) of images (image_id, width, height, gray)."""
    from ..imaging.operators import embed_candidates

    found = embed_candidates(images, regions, embed, config)
    hits = top_k(found.select(F.struct("image_id", "path").alias("query"), "embedding"), index, k, config.min_cosine)
    return hits.select("query.image_id", "query.path", "name", "score", "rank")
