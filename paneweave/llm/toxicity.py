"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (NGRAMS bytes, A-Z lower-cased, a space put before and
after the text), hashed into 2**BITS places.  On labelled texts each place gets the logarithm of the
ratio of its share in toxic texts to that in others; a logistic regression is then fitted on the
features scaled by these ratios, and scores are its probabilities.  The regression has FEATURES places
at most: of those that SEEN texts of the sample hold, the ones with the strongest ratios, weighed by
the root of their counts.  The others have no weight.

Null and empty texts have no n-grams and get the score of the intercept; repeated rows score alike;
texts are read whole; labels, languages, sources and ids are never inputs; without labelled rows of
both classes every score is the share of toxic labels, or 0.5 if there are none; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .labelled import remainder, sample
from .runtime import map_arrow

NGRAMS = (4, 5, 6)
BITS = 20
TRAIN_PER_CLASS = 2500
FEATURES, SEEN = 20_000, 3
THRESHOLD = 0.7

_CODE = np.random.default_rng(71).integers(1, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)


def features(block: bt.Block) -> Iterator[np.ndarray]:
    """The places of the distinct n-grams of each text of the (lower-cased) block, ascending."""
    sizes = np.diff(block.offsets)
    codes = np.full(len(block.data) + 2 * block.n, _CODE[0x20], np.uint32)
    codes[np.arange(len(block.data)) + np.repeat(2 * np.arange(block.n) + 1, sizes)] = _CODE[block.data]
    offsets = block.offsets + 2 * np.arange(block.n + 1)
    places, n = [], len(codes)
    rolled = np.zeros(n, np.uint32)
    for size in range(1, max(NGRAMS) + 1):
        rolled = rolled[: max(0, n - size + 1)] * np.uint32(0x01000193) + codes[size - 1 :]
        if size in NGRAMS:
            h = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * size)
            places.append((h ^ (h >> np.uint32(12))) >> np.uint32(32 - BITS))
    for k in range(block.n):
        a, b = offsets[k], offsets[k + 1]
        own = np.concatenate([p[a : max(a, b - size + 1)] for size, p in zip(NGRAMS, places, strict=True)])
        own.sort()
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


class Model:
    """Weights of all places, ratios and regression in one, and the intercept."""

    def __init__(self, intercept: float = 0.0):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.intercept = intercept

    def fit(self, texts: list[str], y: np.ndarray, weights: np.ndarray, steps: int = 250, decay: float = 2e-3, smooth: float = 1.0) -> Model:
        total = float(weights.sum())
        share = float((weights * y).sum() / total) if total else 0.5
        self.intercept = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        if not 0 < y.sum() < len(y):
            return self

        def each() -> Iterator[np.ndarray]:
            for _, block in bt.blocks(pa.array(texts, pa.large_string()), lower=True):
                yield from features(block)

        seen = np.zeros((2, 1 << BITS), np.int32)
        for label, own in zip(y, each(), strict=True):
            seen[label, own] += 1
        n0, n1 = len(y) - y.sum(), y.sum()
        ratio = np.log((seen[1] + smooth) / (n1 + 2 * smooth)) - np.log((seen[0] + smooth) / (n0 + 2 * smooth))
        strength = np.where(seen.sum(0) >= SEEN, np.abs(ratio) * np.sqrt(np.maximum(seen[0], seen[1])), 0.0)
        chosen = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
        chosen = chosen[strength[chosen] > 0]
        number = np.full(1 << BITS, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        columns, ends = [], []
        for own in each():
            got = number[own]
            columns.append(got[got >= 0])
            ends.append(len(columns[-1]))
        row = np.repeat(np.arange(len(y)), ends)
        column = np.concatenate(columns)
        scale = ratio[chosen]
        v, b = np.zeros(len(chosen)), self.intercept
        m, s, mb, sb = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
        share_of = weights / total
        for step in range(1, steps + 1):  # Adam on all rows at once
            z = b + np.bincount(row, (scale * v)[column], len(y))
            error = share_of * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
            gradient = scale * np.bincount(column, error[row], len(chosen)) + decay * v
            m, s = 0.9 * m + 0.1 * gradient, 0.99 * s + 0.01 * gradient**2
            mb, sb = 0.9 * mb + 0.1 * error.sum(), 0.99 * sb + 0.01 * error.sum() ** 2
            rate = 0.05 * min(1.0, 2.0 * (1 - step / (steps + 1)))
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-8)
        self.weights[chosen] = scale * v
        self.intercept = float(b)
        return self

    def scores(self, block: bt.Block) -> np.ndarray:
        z = np.array([self.intercept + float(self.weights[own].sum(dtype=np.float64)) for own in features(block)])
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, left_out: int = 1, per_class: int = TRAIN_PER_CLASS) -> Model:
    return Model().fit(*sample(docs, labels, "toxic", modulus, left_out, per_class))


def score(docs: DataFrame, model: Model, modulus: int = 3, left_out: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in bt.blocks(batch.column(2), lower=True):
                found = held.value.scores(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, block.n), batch.column(1).slice(at, block.n), pa.array(found), pa.array(found >= THRESHOLD).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(modulus) == left_out).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")
