"""Column expressions over embeddings (arrays of floats)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 512
#: the smallest step of a 32-bit float above one
EPSILON = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    """Products of 32-bit values, added up in 64 bits; the cosine of normalised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unchanged where the norm is no more than EPSILON."""
    n = norm(v)
    return F.when(n > EPSILON, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def finalize(v: Column, dim: int = DIM) -> Column:
    """The first ``dim`` values, normalised; shorter vectors are an error."""
    short = F.raise_error(F.concat(F.lit("embedding of "), F.size(v).cast("string"), F.lit(f" values, {dim} wanted")))
    return F.when(F.size(v) >= dim, l2_normalize(F.slice(v, 1, dim))).otherwise(short.cast("array<double>"))


def planes(rgb: Column) -> Column:
    """Interleaved RGB bytes as planes of reds, greens and blues, from 0 to 1."""
    n = F.floor(F.size(rgb) / 3).cast("int")
    plane = lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(rgb, i * 3 + c) / F.lit(255.0))
    return F.when(n > 0, F.concat(plane(0), plane(1), plane(2))).otherwise(F.expr("cast(array() as array<double>)"))
