"""Proportional stratified interleaving: shards that all hold the same mixture of sources.

The rows of each source are shuffled by a seeded hash and ranked; row k of n has the fractional rank
(k + 1/2) / n.  All rows in the order of their fractional ranks form one sequence in which every
stretch holds the sources in proportion, and the sequence is cut into shards whose row counts differ
by at most one (law ``rows``).

Ranks are found without one task for a source or for the whole: rows fall into about sqrt(N) buckets
by their hash (then by their fractional rank), only the buckets' counts are added up in order, and
rows are numbered within their bucket.  Texts are never shuffled, only ids, sizes and checksums.

A null source is a source of its own, a null text an empty one; repeated rows get a slot each; ties
are broken by hash, id, checksum and size; an empty table gives an empty one; of further columns only
those named in ``carry`` come along.  Equal texts are not kept together, as rows that must share a
shard would break the law.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 17


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, and 16 more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def assign(docs: DataFrame, shards: int = 40, by: str = "source", id_column: str = "doc_id", carry: dict[str, Column] | None = None, seed: int = SEED) -> DataFrame:
    """``id_column``, the carried columns, shard and slot (from 0, without gaps) of each row."""
    carry = carry or {}
    total = docs.count()
    buckets = 1 << max(0, math.ceil(math.log2(max(total, 1)) / 2))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))).cast("binary"))
    order = ["__hash", "__id", *(f"__c{i}" for i in range(len(carry)))]
    rows = docs.select(
        F.col(id_column).alias("__id"), F.col(by).isNull().alias("__none"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("__by"), hashed.alias("__hash"), *(c.alias(f"__c{i}") for i, c in enumerate(carry.values()))
    ).withColumn("__bucket", F.expr(f"cast(conv(substring(__hash, 1, 8), 16, 10) as bigint) * {buckets} div {1 << 32}"))

    stratum = ["__none", "__by"]
    counts = rows.groupBy(*stratum, "__bucket").agg(F.count("*").alias("__n"))
    within = Window.partitionBy(*stratum)
    counts = counts.select(*stratum, "__bucket", (F.sum("__n").over(within.orderBy("__bucket")) - F.col("__n")).alias("__before"), F.sum("__n").over(within).alias("__all"))
    ranked = rows.join(counts, [*stratum, "__bucket"])
    place = F.row_number().over(Window.partitionBy(*stratum, "__bucket").orderBy(*order)) - 1 + F.col("__before")
    ranked = ranked.withColumn("__rank", place).withColumn("__part", (F.col("__rank") + F.lit(0.5)) / F.col("__all")).withColumn("__range", F.floor(F.col("__part") * buckets))

    ranges = ranked.groupBy("__range").agg(F.count("*").alias("__n"))
    ranges = ranges.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))
    joined = ranked.join(ranges, "__range")
    at = F.row_number().over(Window.partitionBy("__range").orderBy("__part", *stratum, *order)) - 1 + F.col("__start")
    placed = joined.withColumn("__at", at).withColumn("shard", F.expr(f"cast(__at * {shards} div {max(total, 1)} as int)"))
    slot = F.expr(f"__at - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}").cast("long")
    return placed.select(F.col("__id").alias(id_column), *(F.col(f"__c{i}").alias(n) for i, n in enumerate(carry)), "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, by: str = "source", id_column: str = "doc_id") -> None:
    """All columns of ``docs`` as Parquet, one folder a shard, rows in the order of their slots."""
    placed = assign(docs, shards, by, id_column, {c: F.col(c) for c in docs.columns if c != id_column})
    placed.repartition(F.col("shard")).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
