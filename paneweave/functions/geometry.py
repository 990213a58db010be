"""Column expressions over ``bounds`` structs (x, y, width, height)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds(x: Column | str, y: Column | str, width: Column | str, height: Column | str) -> Column:
    parts = {"x": x, "y": y, "width": width, "height": height}
    return F.struct(*((F.col(v) if isinstance(v, str) else v).cast("int").alias(k) for k, v in parts.items()))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    """Long, so large boxes don't overflow."""
    return b["width"].cast("long") * b["height"]


def contains(outer: Column, inner: Column) -> Column:
    """Inclusive on all four sides."""
    return (inner["x"] >= outer["x"]) & (inner["y"] >= outer["y"]) & (right(inner) <= right(outer)) & (bottom(inner) <= bottom(outer))


def intersection_area(a: Column, b: Column) -> Column:
    width = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    height = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(width, F.lit(0)).cast("long") * F.greatest(height, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    both = intersection_area(a, b)
    return F.when(both <= 0, F.lit(0.0)).otherwise(both.cast("double") / (area(a) + area(b) - both))


def center_x(b: Column) -> Column:
    return b["x"] + F.floor(b["width"] / 2).cast("int")


def center_y(b: Column) -> Column:
    return b["y"] + F.floor(b["height"] / 2).cast("int")


def holds_point(b: Column, x: Column, y: Column) -> Column:
    """Half-open: the right and bottom edges are outside."""
    return (x >= b["x"]) & (y >= b["y"]) & (x < right(b)) & (y < bottom(b))


def bounds_of_points(points: Column) -> Column:
    """Smallest box around an array of points, both ends included."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return bounds(x, y, F.array_max(xs) - x + 1, F.array_max(ys) - y + 1)


def margins(outer: Column, inner: Column) -> Column:
    """Left, top, right and bottom distance between two boxes."""
    return F.array(inner["x"] - outer["x"], inner["y"] - outer["y"], right(outer) - right(inner), bottom(outer) - bottom(inner))


def is_tight_inset(outer: Column, inner: Column, most: int) -> Column:
    m = margins(outer, inner)
    return (F.array_min(m) >= 0) & (F.array_max(m) <= most)


def is_uniform_inset(outer: Column, inner: Column, most: int, spread: int = 6) -> Column:
    m = margins(outer, inner)
    return is_tight_inset(outer, inner, most) & (F.array_max(m) - F.array_min(m) <= spread)


def area_ratio(child: Column, parent: Column) -> Column:
    return area(child).cast("double") / F.greatest(area(parent), F.lit(1))


def aspect(b: Column) -> Column:
    return b["width"].cast("double") / F.greatest(b["height"], F.lit(1))


def union_of(rows: Column) -> Column:
    """Box around an array of bounds, at least one pixel wide and high."""
    x = F.coalesce(F.array_min(F.transform(rows, lambda b: b["x"])), F.lit(0))
    y = F.coalesce(F.array_min(F.transform(rows, lambda b: b["y"])), F.lit(0))
    far_x = F.coalesce(F.array_max(F.transform(rows, right)), x)
    far_y = F.coalesce(F.array_max(F.transform(rows, bottom)), y)
    return bounds(x, y, F.greatest(far_x - x, F.lit(1)), F.greatest(far_y - y, F.lit(1)))
