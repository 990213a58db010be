"""Words to their smallest enclosing element, and to lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.raster import upper_median

#: Side in pixels of the cells whose nodes are listed; larger nodes are found in cells of 2, 4, 8 ... times that side.
CELL = 16
#: Lists of so many nodes in all may be broadcast, so words aren't moved to them.
BROADCAST_NODES = 1_000_000


def _parts(low: Column, last: Column, level: Column, cell: int) -> Column:
    """Numbers of the cells of a level from one pixel to another."""
    side = cell * F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(low / side), F.floor(last / side))


def listed_nodes(cells: DataFrame, nodes: DataFrame, on: list[str], node_order: str, node: list[str], cell: int = CELL) -> DataFrame:
    """(on, __cx, __cy, __list) the nodes that may be the smallest around a pixel of each cell, best first.

    A node is dealt to four cells at most of the level that fits its side, and each cell asks one cell of
    every level.  Nodes larger than the smallest that covers a whole cell can't win there and are left out,
    and of nodes that cover the same part of a cell only the best stays.  So a list grows with the detail
    inside its cell and not with the number of nodes upon each other.
    """
    b = F.col("node_bounds")
    solid = nodes.where("node_bounds.width > 0 and node_bounds.height > 0").withColumn("__area", g.area(b))
    n = solid.groupBy(*on, "node_bounds", "__area").agg(F.max(F.struct(F.col(node_order).alias("o"), F.struct(*node).alias("n"))).alias("__top"))
    side = F.greatest(b["width"], b["height"])
    n = n.withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2(side / F.lit(float(cell)))).cast("int")))
    spread = n.withColumn("__lx", F.explode(_parts(b["x"], g.right(b) - 1, F.col("__level"), cell))).withColumn("__ly", F.explode(_parts(b["y"], g.bottom(b) - 1, F.col("__level"), cell)))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__level")))
    at = [*on, "__cx", "__cy"]

    def near(asked: DataFrame) -> DataFrame:
        x, y = F.col("__cx") * cell, F.col("__cy") * cell
        levels = asked.join(n.select(*on, "__level").distinct(), on).withColumns({"__lx": up("__cx"), "__ly": up("__cy")})
        pairs = levels.join(spread, [*on, "__level", "__lx", "__ly"])
        covers = (b["x"] <= x) & (b["y"] <= y) & (g.right(b) >= x + cell) & (g.bottom(b) >= y + cell)
        return pairs.where((b["x"] < x + cell) & (b["y"] < y + cell) & (g.right(b) > x) & (g.bottom(b) > y)).withColumn("__covers", covers)

    covered = near(cells).where("__covers").groupBy(*at).agg(F.min("__area").alias("__most"))
    x, y = F.col("__cx") * cell, F.col("__cy") * cell
    part = F.struct(F.greatest(b["x"], x).alias("x0"), F.greatest(b["y"], y).alias("y0"), F.least(g.right(b), x + cell).alias("x1"), F.least(g.bottom(b), y + cell).alias("y1"))
    left = near(cells.join(covered, at, "left")).where("__most is null or __area <= __most").withColumn("__part", part)
    best = left.groupBy(*at, "__part").agg(F.max(F.struct((-F.col("__area")).alias("a"), "__top", "node_bounds")).alias("e"))
    ranked = F.sort_array(F.collect_list("e"), False)
    return best.groupBy(*at).agg(F.transform(ranked, lambda e: F.struct(e["__top"]["n"].alias("n"), e["node_bounds"].alias("b"))).alias("__list"))


def smallest_enclosing(words: DataFrame, nodes: DataFrame, on: list[str], word_key: list[str], node_order: str, node: list[str], cell: int = CELL, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Each word (bounds) with the smallest node (node_bounds) that holds its centre.

    Of equal areas the node that comes last in ``node_order`` wins; words without a node are left out.
    Each word is joined with one row, the list of its cell, and takes the first node that holds it, so no
    word is ever paired with all the nodes around it.  ``word_key`` comes first in the result.
    """
    w = words.withColumns({"__x": g.center_x(F.col("bounds")), "__y": g.center_y(F.col("bounds"))})
    w = w.withColumns({"__cx": F.floor(F.col("__x") / cell), "__cy": F.floor(F.col("__y") / cell)})
    at = [*on, "__cx", "__cy"]
    # kept, as their size is asked for before they are joined
    lists = listed_nodes(w.select(*at).distinct(), nodes, on, node_order, node, cell).persist()
    if (lists.agg(F.sum(F.size("__list"))).first()[0] or 0) <= broadcast_nodes:
        lists = F.broadcast(lists)
    held = F.filter("__list", lambda e: g.holds_point(e["b"], F.col("__x"), F.col("__y")))
    found = w.join(lists, at).withColumn("__best", F.get(held, F.lit(0))).where("__best is not null")
    rest = [c for c in words.columns if c not in word_key]
    return found.select(*word_key, *rest, "__best.n.*", F.col("__best.b").alias("node_bounds"))


def line_threshold(heights: Column) -> Column:
    median = F.coalesce(upper_median(heights), F.lit(12))
    return F.greatest(F.floor(median / 2).cast("int"), F.lit(4))


def merge_lines(words: DataFrame, by: list[str]) -> DataFrame:
    """Lines (by, line_no, text, bounds, confidence, n_words) of the words of each group.

    Words are taken by (y, x, word_id); one joins the line before if its y is near that line's first
    word, else it begins a line.  This is a fold over the group's sorted words, as the anchor of a line
    depends on all before it; a group is the words of one element.
    """
    entry = F.struct(F.col("bounds.y").alias("y"), F.col("bounds.x").alias("x"), "word_id", F.col("bounds.width").alias("w"), F.col("bounds.height").alias("h"), "text", F.col("confidence").cast("double").alias("c"))
    grouped = words.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("ws"))
    grouped = grouped.withColumn("near", line_threshold(F.transform("ws", lambda w: w["h"])))
    # the fold notes where lines begin, so its state grows with the lines alone
    start = F.expr("named_struct('i', 0, 'anchor', 0, 'begins', cast(array() as array<int>))")

    def step(state: Column, w: Column) -> Column:
        joins = (state["i"] > 0) & (F.abs(w["y"] - state["anchor"]) <= F.col("near"))
        begins = F.when(joins, state["begins"]).otherwise(F.concat(state["begins"], F.array(state["i"])))
        return F.struct((state["i"] + 1).alias("i"), F.when(joins, state["anchor"]).otherwise(w["y"]).alias("anchor"), begins.alias("begins"))

    begins = F.aggregate("ws", start, step, lambda s: s["begins"])
    line = lambda at, k: F.slice("ws", at + 1, F.coalesce(F.get("begins", k + 1), F.size("ws")) - at)
    lines = grouped.withColumn("begins", begins).select(*by, F.posexplode(F.transform("begins", line)).alias("line_no", "line"))
    flat = lines.select(*by, "line_no", F.explode("line").alias("w")).select(*by, "line_no", "w.*")
    far_x, far_y = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    merged = flat.groupBy(*by, "line_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y", "word_id", "text"))), lambda w: w["text"]), " ").alias("text"),
        g.bounds(F.min("x"), F.min("y"), F.greatest(far_x - F.min("x"), F.lit(1)), F.greatest(far_y - F.min("y"), F.lit(1))).alias("bounds"),
        F.avg("c").alias("confidence"),
        F.count("*").alias("n_words"),
    )
    return merged.select(*by, "line_no", "text", "bounds", "confidence", "n_words")


def confident(words: DataFrame, least: float, scale: float = 100.0) -> DataFrame:
    """The words whose confidence is at least ``least`` (0 to 1); the words' own scale ends at ``scale``."""
    return words.where(F.col("confidence") >= least * scale)


def plain_text(words: DataFrame, by: str = "image_id") -> DataFrame:
    """The words of each image, one to a line, in their order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_id", "text"))), lambda w: w["text"]), "\n")
    return words.groupBy(by).agg(joined.alias("text"))


def attach_words(elements: DataFrame, words: DataFrame, by: str = "image_id") -> DataFrame:
    """Elements with the text lines of the words that they hold, after the children that they had."""
    nodes = elements.select(by, F.col("path").alias("node_path"), F.col("bounds").alias("node_bounds"))
    held = smallest_enclosing(words.select(by, "word_id", "text", "bounds", "confidence"), nodes, [by], [by, "word_id"], "node_path", ["node_path"])
    lines = merge_lines(held, [by, "node_path"])
    had = elements.where(F.size("path") > 0).groupBy(by, F.expr("slice(path, 1, greatest(size(path) - 1, 0))").alias("node_path")).agg((F.max(F.get("path", F.size("path") - 1)) + 1).alias("__had"))
    place = F.row_number().over(Window.partitionBy(by, "node_path").orderBy("bounds.y", "bounds.x", "line_no")) - 1
    texts = lines.join(had, [by, "node_path"], "left").withColumn("__at", (F.coalesce("__had", F.lit(0)) + place).cast("int"))
    new = texts.select(
        by, F.concat("node_path", F.array("__at")).alias("path"), (F.size("node_path") + 1).alias("depth"), F.lit("text").alias("kind"), "bounds",
        F.col("text").alias("content"), F.lit(None).cast("string").alias("name"), F.col("confidence").cast("float").alias("confidence"),
    )
    return elements.unionByName(new)
