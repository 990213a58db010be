"""From contours with parent pointers to a pruned tree of elements.

Trees are walked one level at a time by recursive queries: a level is a distributed join, and there are
as many as the tree is deep.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LayoutConfig
from ..functions import geometry as g
from .classify import is_redundant


def _recursive(spark: SparkSession, sql: str, max_levels: int, **views: DataFrame) -> DataFrame:
    """Run a recursive query over the given frames; rows aren't limited, levels are."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max_levels))
    return spark.sql(sql, **views)


def nearest_kept_ancestor(nodes: DataFrame, by: str = "image_id", max_levels: int = 100) -> DataFrame:
    """(by, id, ancestor) for each kept node: the first kept one up its chain of parents, or null.

    ``nodes`` has ``by``, id, parent_id (null at the top) and kept.
    """
    sql = f"""
        with recursive up(image, id, at) as (
            select {by}, id, parent_id from {{nodes}} where kept
            union all
            select u.image, u.id, p.parent_id from up u join {{nodes}} p on p.{by} = u.image and p.id = u.at where not p.kept
        )
        select u.image as {by}, u.id, max(case when p.kept then u.at end) as ancestor
        from up u left join {{nodes}} p on p.{by} = u.image and p.id = u.at
        group by u.image, u.id
    """
    return _recursive(nodes.sparkSession, sql, max_levels, nodes=nodes)


def accept_parents(nodes: DataFrame, ancestors: DataFrame, by: str = "image_id", config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Kept nodes with the parent they are linked to.

    A link to the nearest kept ancestor needs an overlap (IoU) of max_parent_iou at most; otherwise the
    node goes to the top, and no ancestor further up is tried.
    """
    kept = nodes.where("kept")
    child = kept.join(ancestors, [by, "id"], "left")
    parent = kept.select(by, F.col("id").alias("ancestor"), F.col("bounds").alias("__parent"))
    linked = child.join(parent, [by, "ancestor"], "left")
    ok = g.iou(F.col("bounds"), F.col("__parent")) <= config.max_parent_iou
    return linked.withColumn("parent", F.when(ok, F.col("ancestor"))).drop("__parent", "ancestor")


def build_tree(nodes: DataFrame, images: DataFrame, by: str = "image_id", max_levels: int = 100) -> DataFrame:
    """``schema.ELEMENTS`` from nodes (by, id, parent, bounds): a root for each image, containers below it.

    Children stand in the order of their ids; ``images`` has ``by``, width and height, and an image
    without nodes keeps its root.
    """
    order = F.row_number().over(Window.partitionBy(by, "parent").orderBy("id")) - 1
    ranked = nodes.select(by, "id", "parent", "bounds", order.cast("int").alias("ordinal"))
    sql = f"""
        with recursive tree(image, id, path) as (
            select {by}, id, array(ordinal) from {{nodes}} where parent is null
            union all
            select t.image, n.id, concat(t.path, array(n.ordinal)) from tree t join {{nodes}} n on n.{by} = t.image and n.parent = t.id
        )
        select image as {by}, id, path from tree
    """
    paths = _recursive(nodes.sparkSession, sql, max_levels, nodes=ranked)
    inner = paths.join(nodes.select(by, "id", "bounds"), [by, "id"]).select(by, "path", F.lit("container").alias("kind"), "bounds")
    roots = images.select(by, F.expr("cast(array() as array<int>)").alias("path"), F.lit("root").alias("kind"), g.bounds(F.lit(0), F.lit(0), "width", "height").alias("bounds"))
    return as_elements(roots.unionByName(inner), by)


def as_elements(rows: DataFrame, by: str = "image_id") -> DataFrame:
    """Rows with (by, path, kind, bounds) in the columns of ``schema.ELEMENTS``, the others null."""
    have = set(rows.columns)
    optional = [(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in (("content", "string"), ("name", "string"), ("confidence", "float"))]
    return rows.select(by, "path", F.size("path").alias("depth"), "kind", "bounds", *optional)


def with_parent_bounds(elements: DataFrame, by: str = "image_id") -> DataFrame:
    """Each element but the root with its parent's bounds."""
    parent = elements.select(F.col(by), F.col("path").alias("__path"), F.col("bounds").alias("parent_bounds"))
    child = elements.where(F.size("path") > 0).withColumn("__path", F.expr("slice(path, 1, greatest(size(path) - 1, 0))"))
    return child.join(parent, [by, "__path"]).drop("__path")


def prune(elements: DataFrame, by: str = "image_id", config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Elements without redundant containers and all that is below them.

    The rule looks at a parent and its child only, so an element stays if no edge on its way up is
    redundant: an anti-join on the prefixes of its path.
    """
    edges = with_parent_bounds(elements, by)
    gone = edges.where(is_redundant(F.col("parent_bounds"), F.col("bounds"), F.col("kind"), config)).select(by, F.col("path").alias("__gone"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    below = elements.where(F.size("path") > 0).select(by, "path", F.explode(prefixes).alias("__gone")).join(gone, [by, "__gone"], "left_semi")
    return elements.join(below.select(by, "path").distinct(), [by, "path"], "left_anti").select(*elements.columns)


def prune_forest(nodes: DataFrame, max_levels: int = 100) -> DataFrame:
    """(id, path, depth) of the nodes (id, parent, redundant) that no redundant edge cuts off."""
    sql = """
        with recursive alive(id, path, depth) as (
            select id, array(id), 1 from {nodes} where parent is null
            union all
            select n.id, concat(a.path, array(n.id)), a.depth + 1 from alive a join {nodes} n on n.parent = a.id where not n.redundant
        )
        select id, path, depth from alive
    """
    return _recursive(nodes.sparkSession, sql, max_levels, nodes=nodes)


def preorder(elements: DataFrame, by: str = "image_id") -> DataFrame:
    """With ``seq``, the place of each element in a walk from the root."""
    return elements.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy("path")) - 1)
