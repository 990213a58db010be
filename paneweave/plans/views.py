"""Layout tables derived from the star schema, in Spark and as SQL for the oracle.

Screens are orders and words are order lines; boxes, nests and trees come from parts.  Every value is
an integer function of the columns, so both engines derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, word_id, text, bounds, confidence)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.row_number().over(order).alias("word_id"),
        F.concat("l_returnflag", "l_linestatus", F.lit("-"), F.col("l_linenumber").cast("string")).alias("text"),
        g.bounds(F.expr("(l_partkey * 37 + l_linenumber * 211) % 1800"), F.expr("(l_suppkey * 53 + l_linenumber * 3) % 90"), F.expr("20 + cast(l_quantity as int) * 3"), F.expr("12 + l_linenumber * 2")).alias("bounds"),
        (50 + F.col("l_discount") * 100).alias("confidence"),
    )


WORDS = """words as (
    select l_orderkey as image_id,
           row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as word_id,
           l_returnflag || l_linestatus || '-' || cast(l_linenumber as varchar) as text,
           cast((l_partkey * 37 + l_linenumber * 211) % 1800 as int) as x, cast((l_suppkey * 53 + l_linenumber * 3) % 90 as int) as y,
           cast(20 + cast(l_quantity as int) * 3 as int) as w, cast(12 + l_linenumber * 2 as int) as h,
           50 + l_discount * 100 as c
    from lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, id, bounds, is_hole)."""
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 100).alias("image_id"),
        F.col("p_partkey").alias("id"),
        g.bounds(F.expr("(p_partkey * 131) % 1700"), F.expr("(p_partkey * 57) % 80"), F.expr("8 + p_size * 2"), F.expr("8 + (p_partkey % 50) * 2")).alias("bounds"),
        (F.col("p_partkey") % 5 == 0).alias("is_hole"),
    )


BOXES = """boxes as (
    select p_partkey % 100 as image_id, p_partkey as id, cast((p_partkey * 131) % 1700 as int) as x, cast((p_partkey * 57) % 80 as int) as y,
           cast(8 + p_size * 2 as int) as w, cast(8 + (p_partkey % 50) * 2 as int) as h, p_partkey % 5 = 0 as is_hole
    from part)"""


def nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, parent, child): a box and one inside it; children below 12 pixels are left out."""
    k = "p_partkey"
    even = f"{k} % 3 = 0"
    rows = table(spark, sf_dir, "part").selectExpr(
        f"{k} as k", f"({k} * 13) % 500 as px", f"({k} * 7) % 300 as py", "40 + p_size * 2 as w1", f"40 + ({k} % 50) * 2 as h1", f"{k} % 24 as l",
        f"if({even}, {k} % 24, ({k} % 24 + 7 * {k}) % 15) as t", f"if({even}, {k} % 24 + {k} % 5, ({k} % 24 + 3 * {k}) % 19) as r", f"if({even}, {k} % 24, (5 * ({k} % 24)) % 17) as b",
    )
    rows = rows.select("k", g.bounds("px", "py", "w1", "h1").alias("parent"), g.bounds(F.expr("px + l"), F.expr("py + t"), F.expr("w1 - l - r"), F.expr("h1 - t - b")).alias("child"))
    return rows.where("child.width >= 12 and child.height >= 12")


NEST = """nest0 as (
    select p_partkey as k, cast((p_partkey * 13) % 500 as int) as x1, cast((p_partkey * 7) % 300 as int) as y1, cast(40 + p_size * 2 as int) as w1, cast(40 + (p_partkey % 50) * 2 as int) as h1,
           cast(p_partkey % 24 as int) as ml,
           cast(case when p_partkey % 3 = 0 then p_partkey % 24 else (p_partkey % 24 + 7 * p_partkey) % 15 end as int) as mt,
           cast(case when p_partkey % 3 = 0 then p_partkey % 24 + p_partkey % 5 else (p_partkey % 24 + 3 * p_partkey) % 19 end as int) as mr,
           cast(case when p_partkey % 3 = 0 then p_partkey % 24 else (5 * (p_partkey % 24)) % 17 end as int) as mb
    from part),
nest as (
    select k, x1, y1, w1, h1, x1 + ml as x2, y1 + mt as y2, w1 - ml - mr as w2, h1 - mt - mb as h2, ml, mt, mr, mb
    from nest0 where w1 - ml - mr >= 12 and h1 - mt - mb >= 12),
judged as (
    select *, (cast(w2 as bigint) * h2) / cast(greatest(cast(w1 as bigint) * h1, 1) as double) as ratio,
           least(ml, mt, mr, mb) as m_least, greatest(ml, mt, mr, mb) as m_most
    from nest)"""

REDUNDANT = "(m_least >= 0 and (ratio >= 0.82 or m_most <= 10 or (ratio <= 0.65 and m_most <= 20 and m_most - m_least <= 6)))"
