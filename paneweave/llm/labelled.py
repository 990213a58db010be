"""A bounded, repeatable sample of labelled texts to fit a classifier on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the sampled texts of a class; texts are taken whole in the order of their ids' hashes up to this
#: sum, whatever their length, and all texts are scored whole.
SAMPLE_BYTES = 48 << 20


def remainder(modulus: int) -> Column:
    """crc32 of the doc_id's text, modulo ``modulus``; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, per_class: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, labels, weights) of at most ``per_class`` rows and SAMPLE_BYTES bytes a class, by the hash of their ids.

    Rows with the left-out remainder are never read.  Weights restore the share that each class has
    among all labelled rows.  Only the sampled ids, 2 * ``per_class`` at most, are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("__y")).where(F.col("doc_id").isNotNull() & F.col("__y").isin(0, 1))
    known = known.where(remainder(modulus) != left_out)
    totals = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # of equal doc_ids with several texts one, always the same
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "__y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    taken = F.sum(F.octet_length("text")).over(Window.partitionBy("__y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = found.withColumn("__taken", taken).where(F.col("__taken") <= SAMPLE_BYTES).select("doc_id", "__y", "text").collect()
    rows.sort(key=lambda r: r[0])
    y = np.array([r[1] for r in rows], np.int64)
    weights = np.ones(len(y))
    for k in (0, 1):
        if (y == k).any():
            weights[y == k] = totals[k] / (y == k).sum()
    return [r[2] for r in rows], y, weights / max(weights.mean(), 1e-9) if len(y) else weights
