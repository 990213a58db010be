"""One query for each operator over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import raster, text
from ..functions import vectors as v
from ..operators import classify, hierarchy, icons, words
from .views import BOXES, NEST, REDUNDANT, WORDS, boxes, nest, table
from .views import words as word_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: the derived vectors are far apart, so the driver's queries use a lower threshold than the default
MIN_COSINE = 0.35


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flat(b: str, prefix: str = "") -> list:
    return [F.col(f"{b}.{c}").alias(prefix + c) for c in ("x", "y", "width", "height")]


@query(f"""
with {NEST},
o as (select *, greatest(0, least(x1 + w1, x2 + w2) - greatest(x1, x2)) * cast(greatest(0, least(y1 + h1, y2 + h2) - greatest(y1, y2)) as bigint) as common from nest)
select k, x2 + w2 as far_x, y2 + h2 as far_y, cast(w2 as bigint) * h2 as area, cast(common as bigint) as common,
       x2 >= x1 and y2 >= y1 and x2 + w2 <= x1 + w1 and y2 + h2 <= y1 + h1 as inside,
       round(case when common <= 0 then 0.0 else common / cast(cast(w1 as bigint) * h1 + cast(w2 as bigint) * h2 - common as double) end, 6) as iou,
       round(cast(w2 as bigint) * h2 / cast(greatest(cast(w1 as bigint) * h1, 1) as double), 6) as ratio,
       round(w2 / cast(greatest(h2, 1) as double), 6) as aspect
from o""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = F.col("parent"), F.col("child")
    return nest(spark, sf_dir).select(
        "k", g.right(c).alias("far_x"), g.bottom(c).alias("far_y"), g.area(c).alias("area"), g.intersection_area(p, c).alias("common"), g.contains(p, c).alias("inside"),
        F.round(g.iou(p, c), 6).alias("iou"), F.round(g.area_ratio(c, p), 6).alias("ratio"), F.round(g.aspect(c), 6).alias("aspect"),
    )


@query(f"""
with {BOXES},
each_box as (select image_id, w, h, is_hole from boxes union all select p_partkey % 100, cast(p_size % 4 as int), cast(8 + (p_partkey % 50) * 2 as int), p_partkey % 5 = 0 from part),
r as (select image_id, case when w < 2 or h < 2 then 'thin'
        when is_hole then case when cast(w as bigint) * h >= 2000 and w >= 40 and h >= 40 then 'kept' else 'hole' end
        when cast(w as bigint) * h >= 100 then 'kept' else 'area' end as reason from each_box)
select image_id, count(*) as total, count(*) filter (where reason = 'kept') as kept, count(*) filter (where reason = 'hole') as dropped_hole,
       count(*) filter (where reason = 'area') as dropped_area, count(*) filter (where reason = 'thin') as dropped_thin
from r group by image_id""")
def contour_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    slim = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 100).alias("image_id"), F.col("p_partkey").alias("id"), g.bounds(F.lit(0), F.lit(0), F.expr("p_size % 4"), F.expr("8 + (p_partkey % 50) * 2")).alias("bounds"), (F.col("p_partkey") % 5 == 0).alias("is_hole")
    )
    return classify.filter_stats(rows.unionByName(slim).withColumn("reason", classify.contour_reason(F.col("bounds"), F.col("is_hole"))))


@query("""
select l_orderkey as image_id, cast(min(l_partkey) as int) as x, cast(min(l_suppkey) as int) as y,
       cast(max(l_partkey) - min(l_partkey) + 1 as int) as width, cast(max(l_suppkey) - min(l_suppkey) + 1 as int) as height
from lineitem group by l_orderkey""")
def aabb_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.collect_list(point).alias("points"))
    return rows.select("image_id", g.bounds_of_points(F.col("points")).alias("b")).select("image_id", *flat("b"))


@query(f"""
with {NEST},
o as (select k, w1, h1, w2, h2, greatest(0, least(x1 + w1, x2 + w2) - greatest(x1, x2)) * cast(greatest(0, least(y1 + h1, y2 + h2) - greatest(y1, y2)) as bigint) as common from nest),
i as (select k, case when common <= 0 then 0.0 else common / cast(cast(w1 as bigint) * h1 + cast(w2 as bigint) * h2 - common as double) end as iou from o)
select k as id, round(iou, 6) as iou, case when iou <= 0.92 then k end as parent from i""")
def parent_link_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nest(spark, sf_dir)
    parents = rows.select(F.lit(0).alias("image_id"), (2 * F.col("k")).alias("id"), F.lit(None).cast("long").alias("up"), F.col("parent").alias("bounds"))
    children = rows.select(F.lit(0).alias("image_id"), (2 * F.col("k") + 1).alias("id"), (2 * F.col("k")).alias("up"), F.col("child").alias("bounds"))
    nodes = parents.unionByName(children).withColumn("kept", F.lit(True))
    linked = hierarchy.accept_parents(nodes, nodes.select("image_id", "id", F.col("up").alias("ancestor")))
    found = linked.where("id % 2 = 1").select(F.expr("id div 2").alias("id"), F.expr("parent div 2").alias("parent"))
    return rows.select(F.col("k").alias("id"), F.round(g.iou(F.col("parent"), F.col("child")), 6).alias("iou")).join(found, "id").select("id", "iou", "parent")


@query("""
with recursive n as (select p_partkey as id, case when p_partkey > 0 then p_partkey // 2 end as parent_id, p_size > 25 as kept from part),
up(id, place) as (
    select id, parent_id from n where kept
    union all
    select u.id, p.parent_id from up u join n p on p.id = u.place where not p.kept)
select u.id, max(case when p.kept then u.place end) as ancestor from up u left join n p on p.id = u.place group by u.id""")
def nearest_kept_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").selectExpr("0 as image_id", "p_partkey as id", "if(p_partkey > 0, p_partkey div 2, null) as parent_id", "p_size > 25 as kept")
    return hierarchy.nearest_kept_ancestor(nodes).select("id", "ancestor")


@query(f"""
with {NEST}
select k, round(ratio, 6) as ratio, m_least >= 0 and m_most <= 10 as tight, m_least >= 0 and m_most <= 20 and m_most - m_least <= 6 as uniform, {REDUNDANT} as redundant
from judged""")
def prune_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = F.col("parent"), F.col("child")
    return nest(spark, sf_dir).select(
        "k", F.round(g.area_ratio(c, p), 6).alias("ratio"), g.is_tight_inset(p, c, 10).alias("tight"), g.is_uniform_inset(p, c, 20).alias("uniform"), classify.is_redundant(p, c).alias("redundant")
    )


@query(f"""
with recursive {NEST},
t as (select p.p_partkey as id, case when p.p_partkey >= 25 then p.p_partkey // 4 end as parent, coalesce({REDUNDANT}, false) as redundant from part p left join judged j on j.k = p.p_partkey),
alive(id, path, depth) as (
    select id, cast(id as varchar), 1 from t where parent is null
    union all
    select t.id, a.path || '/' || cast(t.id as varchar), a.depth + 1 from alive a join t on t.parent = a.id where not t.redundant)
select id, path, depth from alive""")
def prune_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = nest(spark, sf_dir).select("k", classify.is_redundant(F.col("parent"), F.col("child")).alias("flag"))
    nodes = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "if(p_partkey >= 25, p_partkey div 4, null) as parent").join(edges.withColumnRenamed("k", "id"), "id", "left")
    found = hierarchy.prune_forest(nodes.select("id", "parent", F.coalesce("flag", F.lit(False)).alias("redundant")))
    return found.select("id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "depth")


WORD_NODE = f"""{WORDS}, {BOXES},
hits as (select w.image_id, w.word_id, b.id, cast(b.w as bigint) * b.h as area
         from words w join boxes b on w.image_id % 100 = b.image_id
         where w.x + w.w // 2 >= b.x and w.x + w.w // 2 < b.x + b.w and w.y + w.h // 2 >= b.y and w.y + w.h // 2 < b.y + b.h),
best as (select image_id, word_id, id as node, area from (select *, row_number() over (partition by image_id, word_id order by area, id desc) as rn from hits) q where rn = 1)"""


def _held_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the smallest box of their screen's layout that holds their centre."""
    ws = word_rows(spark, sf_dir).withColumn("layout", F.col("image_id") % 100)
    nodes = boxes(spark, sf_dir).select(F.col("image_id").alias("layout"), F.col("id").alias("node"), F.col("bounds").alias("node_bounds"))
    return words.smallest_enclosing(ws, nodes, ["layout"], ["image_id", "word_id"], "node", ["node"])


@query(f"with {WORD_NODE} select image_id, word_id, node, area from best")
def word_to_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_words(spark, sf_dir).select("image_id", F.col("word_id").cast("long").alias("word_id"), "node", g.area(F.col("node_bounds")).alias("area"))


def _lines_sql(source: str, by: str) -> str:
    """Greedy lines of ``source`` (by, word_id, text, x, y, w, h, c) as further CTEs, ending in ``lines``."""
    keys = [k.strip() for k in by.split(",")]
    on = " and ".join(f"s.{k} = r.{k}" for k in keys)
    return f"""
hs as (select {by}, greatest(list_sort(list(h))[len(list(h)) // 2 + 1] // 2, 4) as near from {source} group by {by}),
s as (select q.*, row_number() over (partition by {", ".join("q." + k for k in keys)} order by q.y, q.x, q.word_id) as rn, hs.near from {source} q join hs on {" and ".join(f"hs.{k} = q.{k}" for k in keys)}),
r as (
    select {by}, rn, y as anchor, 0 as line_no from s where rn = 1
    union all
    select {", ".join("s." + k for k in keys)}, s.rn, case when abs(s.y - r.anchor) <= s.near then r.anchor else s.y end, case when abs(s.y - r.anchor) <= s.near then r.line_no else r.line_no + 1 end
    from r join s on {on} and s.rn = r.rn + 1),
lines as (
    select {", ".join("s." + k for k in keys)}, r.line_no, string_agg(s.text, ' ' order by s.x, s.y, s.word_id) as text, min(s.x) as x, min(s.y) as y,
           greatest(max(s.x + s.w) - min(s.x), 1) as width, greatest(max(s.y + s.h) - min(s.y), 1) as height, round(avg(s.c), 4) as confidence, count(*) as n_words
    from s join r on {on} and s.rn = r.rn group by {", ".join("s." + k for k in keys)}, r.line_no)"""


@query(f"with recursive {WORDS}, {_lines_sql('words', 'image_id')} select image_id, line_no, text, x, y, width, height, confidence, n_words from lines")
def line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = words.merge_lines(word_rows(spark, sf_dir), ["image_id"])
    return found.select("image_id", "line_no", "text", *flat("bounds"), F.round("confidence", 4).alias("confidence"), "n_words")


@query(f"""
with recursive {WORD_NODE},
held as (select w.*, b.node from words w join best b on b.image_id = w.image_id and b.word_id = w.word_id), {_lines_sql("held", "image_id, node")},
used as (select distinct image_id, node from held),
rows as (
    select u.image_id, u.node, -1 as place, 'container' as kind, cast(null as varchar) as content, b.x, b.y, b.w as width, b.h as height from used u join boxes b on b.id = u.node
    union all
    select image_id, node, row_number() over (partition by image_id, node order by y, x, line_no) - 1, 'text', text, x, y, width, height from lines)
select image_id, row_number() over (partition by image_id order by node, place) as seq, cast(node as varchar) || case when place < 0 then '' else '/' || cast(place as varchar) end as path,
       kind, content, x, y, width, height from rows""")
def attach_words_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held_words(spark, sf_dir)
    lines = words.merge_lines(held, ["image_id", "node", "node_bounds"])
    place = F.row_number().over(Window.partitionBy("image_id", "node").orderBy("bounds.y", "bounds.x", "line_no")) - 1
    # a box comes with its first line, so the words are held and merged once
    box = F.struct(F.array(F.col("node").cast("int")).alias("path"), F.lit("container").alias("kind"), F.col("node_bounds").alias("bounds"), F.lit(None).cast("string").alias("content"))
    line = F.struct(F.array(F.col("node").cast("int"), F.col("place")).alias("path"), F.lit("text").alias("kind"), "bounds", F.col("text").alias("content"))
    placed = lines.withColumn("place", place.cast("int"))
    both = hierarchy.as_elements(placed.select("image_id", F.explode(F.when(F.col("place") == 0, F.array(box, line)).otherwise(F.array(line))).alias("e")).select("image_id", "e.*"))
    return hierarchy.preorder(both).select("image_id", (F.col("seq") + 1).cast("long").alias("seq"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "kind", "content", *flat("bounds"))


@query(f"with {WORDS} select image_id, cast(list_sort(list(h))[len(list(h)) // 2 + 1] as int) as median, cast(greatest(list_sort(list(h))[len(list(h)) // 2 + 1] // 2, 4) as int) as near from words group by image_id")
def upper_median_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_rows(spark, sf_dir).groupBy("image_id").agg(F.collect_list("bounds.height").alias("hs"))
    return rows.select("image_id", raster.upper_median(F.col("hs")).alias("median"), words.line_threshold(F.col("hs")).alias("near"))


@query(f"with {WORDS} select image_id, min(x) as x, min(y) as y, greatest(max(x + w) - min(x), 1) as width, greatest(max(y + h) - min(y), 1) as height, round(avg(c), 4) as confidence from words group by image_id")
def union_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_rows(spark, sf_dir).groupBy("image_id").agg(F.collect_list("bounds").alias("bs"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return rows.select("image_id", g.union_of(F.col("bs")).alias("b"), "confidence").select("image_id", *flat("b"), "confidence")


CANDIDATES = f"""{BOXES},
cands as (select id, w, h from boxes b where least(w, h) >= 12 and greatest(w, h) <= 96 and w / cast(greatest(h, 1) as double) between 0.55 and 1.85
          and not exists (select 1 from boxes c where c.id > 0 and c.id // 4 = b.id))"""


def _box_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as containers; box k lies in box k div 4, which its path says by two numbers."""
    rows = boxes(spark, sf_dir)
    used = rows.where("id > 0").select(F.expr("id div 4").alias("id")).distinct().withColumn("leaf", F.lit(False))
    own = rows.join(used, "id", "left").select(F.lit(0).alias("image_id"), "id", "leaf", "bounds")
    tops = own.select("image_id", F.array(F.col("id").cast("int")).alias("path"), F.lit("container").alias("kind"), "bounds")
    inner = own.where("not leaf").select("image_id", F.array(F.col("id").cast("int"), F.lit(0)).alias("path"), F.lit("text").alias("kind"), "bounds")
    return hierarchy.as_elements(tops).unionByName(hierarchy.as_elements(inner))


@query(f"with {CANDIDATES} select id, w as width, h as height from cands")
def icon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.icon_candidates(_box_elements(spark, sf_dir)).select(F.col("path")[0].cast("long").alias("id"), "bounds.width", "bounds.height")


SCORES = """scores as (select q.vec_id as query, i.vec_id as hit, list_dot_product(cast(q.embedding as double[]), cast(i.embedding as double[])) as score
           from embeddings q join embeddings i on q.vec_id <> i.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query order by score desc, hit) as rank from scores)"""


def _search(spark: SparkSession, sf_dir: str, k: int, min_score: float | None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding", F.col("vec_id").alias("own"))
    return icons.top_k(queries, vectors.select(F.col("vec_id").alias("name"), "embedding", F.col("vec_id").alias("own")), k, min_score, exclude_same="own")


@query(f"with {SCORES} select query, hit, round(score, 6) as score from ranked where rank = 1 and score >= {MIN_COSINE}")
def cosine_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, 1, MIN_COSINE).select("query", F.col("name").alias("hit"), F.round("score", 6).alias("score"))


@query(f"with {SCORES} select query, cast(rank as int) as rank, hit, round(score, 6) as score from ranked where rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, 5, None).select("query", "rank", F.col("name").alias("hit"), F.round("score", 6).alias("score"))


@query("""
with t as (select vec_id, list_transform(cast(embedding[1:48] as double[]), lambda x: x * 3.0) as e from embeddings),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from t)
select vec_id, round(norm, 5) as norm, round(e[1] / norm, 5) as first, round(e[48] / norm, 5) as last, len(e) as dims from n""")
def embedding_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3.0).alias("e"))
    rows = rows.select("vec_id", v.norm(F.slice("e", 1, 48)).alias("norm"), v.finalize(F.col("e"), 48).alias("u"))
    return rows.select("vec_id", F.round("norm", 5).alias("norm"), F.round(F.element_at("u", 1), 5).alias("first"), F.round(F.element_at("u", 48), 5).alias("last"), F.size("u").cast("long").alias("dims"))


@query(f"""
with {CANDIDATES},
idx as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
asked as (select c.id, e.embedding from cands c join embeddings e on e.vec_id = c.id),
scores as (select a.id, i.vec_id, list_dot_product(cast(a.embedding as double[]), i.e) as score from asked a join idx i on i.vec_id <> a.id),
best as (select id, vec_id, score from (select *, row_number() over (partition by id order by score desc, vec_id) as rn from scores where score >= {MIN_COSINE}) q where rn = 1)
select b.id, case when t.id is null then 'container' else 'icon' end as kind, cast(t.vec_id as varchar) as name, round(t.score, 4) as confidence, b.w as width, b.h as height
from boxes b left join best t on t.id = b.id""")
def icon_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = _box_elements(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    wanted = classify.icon_candidates(elements).select("image_id", "path", F.col("path")[0].cast("long").alias("vec_id")).join(vectors, "vec_id")
    hits = icons.top_k(wanted.select(F.col("path").alias("query"), "embedding", F.col("vec_id").alias("own")), vectors.select(F.col("vec_id").alias("name"), "embedding", F.col("vec_id").alias("own")), 1, MIN_COSINE, exclude_same="own")
    found = icons.replace_matched(elements, hits.select(F.lit(0).alias("image_id"), F.col("query").alias("path"), F.col("name").cast("string").alias("name"), "score"))
    exact = found.where("size(path) = 1").join(hits.select(F.col("query").alias("path"), F.round("score", 4).alias("exact")), "path", "left")
    return exact.select(F.col("path")[0].cast("long").alias("id"), "kind", "name", F.col("exact").alias("confidence"), "bounds.width", "bounds.height")


@query("""
with px as (select vec_id, list_transform(embedding, lambda e: cast(floor((cast(e as double) + 1) * 127.5) as int)) as p from embeddings),
b as (select vec_id, p, list_sort(list_transform([1,57,2,58,3,59,4,60,5,61,6,62,7,63,8,64,9,16,17,24,25,32,33,40,41,48,49,56], lambda i: p[i]))[15] as bg from px),
d as (select vec_id, p, bg, list_sort(list_filter(list_transform(p, lambda v: abs(v - bg)), lambda x: x > 0)) as ds from b),
t as (select vec_id, p, bg, case when len(ds) = 0 then 24 else least(greatest(ds[len(ds) // 2 + 1], 12), 48) end as thr from d),
c as (select vec_id, bg, thr, len(list_filter(p, lambda v: least(v + thr, 255) < bg)) as dark, len(list_filter(p, lambda v: greatest(v - thr, 0) > bg)) as light from t),
k as (select *, dark / 64.0 between 0.03 and 0.72 as d_ok, light / 64.0 between 0.03 and 0.72 as l_ok from c)
select vec_id, cast(bg as int) as bg, cast(thr as int) as threshold, cast(dark as int) as dark, cast(light as int) as light,
       case when d_ok and l_ok then dark <= light when d_ok then true when l_ok then false else abs(dark - light) <= 8 or dark < light end as takes_dark
from k""")
def ink_mask_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("int")).alias("p"))
    rows = rows.withColumn("bg", raster.background(F.col("p"), 8, 8)).withColumn("threshold", raster.adaptive_threshold(F.col("p"), F.col("bg")))
    for name, dark in (("dark", True), ("light", False)):
        rows = rows.withColumn(name, raster.ink_count(raster.ink(F.col("p"), F.col("bg"), F.col("threshold"), dark)))
    return rows.select("vec_id", "bg", "threshold", "dark", "light", raster.takes_dark(F.col("dark"), F.col("light"), F.lit(64)).alias("takes_dark"))


@query("""
with px as (select vec_id, list_transform(embedding[1:63], lambda e: cast(floor((cast(e as double) + 1) * 127.5) as int)) as p from embeddings)
select vec_id, 63 as n, round(p[1] / 255.0, 6) as red_0, round(p[4] / 255.0, 6) as red_1, round(p[2] / 255.0, 6) as green_0, round(p[63] / 255.0, 6) as blue_last from px""")
def nchw_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.planes(F.transform(F.slice("embedding", 1, 63), lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("int"))).alias("t"))
    at = lambda i, name: F.round(F.get("t", F.lit(i)), 6).alias(name)
    return rows.select("vec_id", F.size("t").alias("n"), at(0, "red_0"), at(1, "red_1"), at(21, "green_0"), at(62, "blue_last"))


@query("""
with p as (select l_orderkey as image_id, l_partkey as x, l_suppkey as y,
           row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as i, count(*) over (partition by l_orderkey) as n from lineitem)
select a.image_id, a.i as seq, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from p a join p b on b.image_id = a.image_id and b.i = case when a.i = a.n then 1 else a.i + 1 end where a.n > 1""")
def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.contours import segments

    points = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image_id")
    return segments(points, "image_id", ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], "l_partkey", "l_suppkey")


@query("""
with t as (select user_id as image_id, event_type as stage, sum(value) as ms, count(*) as n from events group by 1, 2)
select image_id, cast(sum(n) as bigint) as stages, round(coalesce(sum(ms) filter (where stage = 'click'), 0), 4) as gray_ms, round(coalesce(sum(ms) filter (where stage = 'view'), 0), 4) as layout_ms,
       round(coalesce(sum(ms) filter (where stage = 'purchase'), 0), 4) as ocr_ms, round(coalesce(sum(ms) filter (where stage = 'signup'), 0), 4) as attach_ms,
       round(coalesce(sum(ms) filter (where stage = 'error'), 0), 4) as icon_ms, round(sum(ms), 4) as extract_ms
from t group by image_id""")
def stage_timings_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.durations import by_stage

    names = {"click": "gray_ms", "view": "layout_ms", "purchase": "ocr_ms", "signup": "attach_ms", "error": "icon_ms"}
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return by_stage(rows, names).select("image_id", "stages", *(F.round(n, 4).alias(n) for n in (*names.values(), "extract_ms")))


@query("""
with t as (select event_id, value * 7 as ms from events)
select event_id, case when ms >= 1000 then cast(cast(round_even(ms / 1000 * 100, 0) as bigint) // 100 as varchar) || '.' || lpad(cast(cast(round_even(ms / 1000 * 100, 0) as bigint) % 100 as varchar), 2, '0') || 's'
       when ms >= 10 then cast(cast(round_even(ms, 0) as bigint) as varchar) || 'ms'
       else cast(cast(round_even(ms * 10, 0) as bigint) // 10 as varchar) || '.' || cast(cast(round_even(ms * 10, 0) as bigint) % 10 as varchar) || 'ms' end as label from t""")
def format_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.format_ms(F.col("value") * 7).alias("label"))


@query("""
with t as (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as s from documents)
select doc_id, case when length(s) <= 24 then s else substr(s, 1, 24) || '…' end as label from t""")
def truncate_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_label(F.col("text")).alias("label"))


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"select 'page' as kind, page_id as id, length({_ESCAPED.format('html')}) as n, md5({_ESCAPED.format('html')}) as digest from pages union all select 'document', doc_id, length({_ESCAPED.format('text')}), md5({_ESCAPED.format('text')}) from documents")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.html_escape(F.col("html")).alias("s"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.html_escape(F.col("text")).alias("s"))
    return pages.unionByName(docs).select("kind", "id", F.char_length("s").cast("long").alias("n"), F.md5(F.col("s").cast("binary")).alias("digest"))


@query("""
with t as (select p_partkey as id, cast(p_partkey % 11 + 1 as int) as depth, case p_partkey % 3 when 0 then 'container' when 1 then 'text' else 'icon' end as kind, cast(8 + p_size as int) as h,
           case p_partkey % 3 when 1 then p_size * 1.5 when 2 then p_size / 64.0 end as c, cast(p_partkey % 40 as int) as y from part)
select id, ['#e63946','#457b9d','#2a9d8f','#e9c46a','#9b5de5','#f72585','#fb8500','#06d6a0'][(depth - 1) % 8 + 1] as color, least(greatest(h * 2 // 3, 8), 16) as font,
       'L' || cast(depth as varchar) || ' · ' || kind as badge,
       case when c is null then '' else ' · ' || cast(cast(round_even(case when kind = 'icon' then c * 100 else c end, 0) as bigint) as varchar) || '%' end as percent, greatest(y - 16, 0) as label_y
from t""")
def depth_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", "cast(p_partkey % 11 + 1 as int) as depth", "element_at(array('container', 'text', 'icon'), cast(p_partkey % 3 + 1 as int)) as kind",
        "named_struct('x', 0, 'y', cast(p_partkey % 40 as int), 'width', 1, 'height', cast(8 + p_size as int)) as b", "case p_partkey % 3 when 1 then p_size * 1.5d when 2 then p_size / 64.0d end as c",
    )
    depth, kind = F.col("depth"), F.col("kind")
    return rows.select(
        "id", text.depth_color(depth).alias("color"), text.font_size(F.col("b.height")).alias("font"), text.badge(depth, kind).alias("badge"), text.percent(kind, F.col("c")).alias("percent"), text.label_anchor(F.col("b"))["y"].alias("label_y")
    )


@query("""
select event_id, coalesce(cast(json_extract(props, '$.k') as int), 100) as min_area, coalesce(cast(json_extract(props, '$.missing') as int), 960) as max_side,
       coalesce(cast(json_extract(props, '$.k') as double), 0) + 0.0 as ms from events""")
def json_config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k: double, missing: int>").alias("j"))
    return rows.select("event_id", F.coalesce(F.col("j.k").cast("int"), F.lit(100)).alias("min_area"), F.coalesce("j.missing", F.lit(960)).alias("max_side"), F.coalesce("j.k", F.lit(0.0)).alias("ms"))


@query("""
with t as (select event_id, user_id, value, event_type from events)
select event_id, cast(i as int) as word_id, event_type || '-' || cast(i as varchar) as text, cast(event_id % 50 + i as int) as x, cast(user_id % 20 as int) as width, round(value, 2) as confidence,
       case when event_id % 3 = 0 then null else event_type end as hit
from t, (select unnest([0, 1, 2]) as i) n where i <= event_id % 3""")
def json_words_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.documents import icon_matches, ocr_words

    i = F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))
    word = F.transform(i, lambda k: F.struct(
        F.concat("event_type", F.lit("-"), k.cast("string")).alias("text"),
        F.struct((F.col("event_id") % 50 + k).cast("int").alias("x"), F.lit(0).alias("y"), (F.col("user_id") % 20).cast("int").alias("width"), F.lit(9).alias("height")).alias("bounds"),
        F.col("value").alias("confidence"),
    ))
    hit = F.when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise(F.to_json(F.struct(F.col("event_type").alias("name"), F.col("value").alias("score"))))
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(word.alias("words"), F.struct(F.lit(1.0).alias("init_ms")).alias("timings"))).alias("ocr"), hit.alias("hits"))
    words_ = ocr_words(rows, "event_id", "ocr")
    return words_.join(icon_matches(rows, "event_id", "hits").select("event_id", F.col("name").alias("hit")), "event_id", "left").select("event_id", "word_id", "text", "bounds.x", "bounds.width", F.round("confidence", 2).alias("confidence"), "hit")


@query("""
with t as (select page_id, page_id // 4 as folder, ['input.gif', 'input.png', 'input.webp', 'input.jpeg', 'notes.txt', 'input.jpg'][page_id % 6 + 1] as name from pages),
r as (select *, list_position(['input.png', 'input.jpg', 'input.jpeg', 'input.webp', 'input.gif'], name) as rank from t)
select folder, 'case-' || cast(folder as varchar) || '/' || name as path from (select *, row_number() over (partition by folder order by rank, page_id) as rn from r where rank > 0) q where rn = 1""")
def case_input_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.cases import choose_input

    names = F.array(*map(F.lit, ("input.gif", "input.png", "input.webp", "input.jpeg", "notes.txt", "input.jpg")))
    rows = table(spark, sf_dir, "pages").select(F.expr("page_id div 4").alias("folder"), F.get(names, (F.col("page_id") % 6).cast("int")).alias("name"))
    rows = rows.withColumn("path", F.concat(F.lit("case-"), F.col("folder").cast("string"), F.lit("/"), "name"))
    return choose_input(rows.select(F.concat(F.lit("case-"), F.col("folder").cast("string")).alias("case"), "folder", "path")).select("folder", "path")


@query("select conv_id as image_id, string_agg(text, chr(10) order by turn, text) as text from conversations group by conv_id")
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.plain_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), F.col("turn").alias("word_id"), "text"))


@query(f"""
with {BOXES}
select id, w as width, h as height from boxes where not coalesce(case when w < 2 or h < 2 then false when is_hole then cast(w as bigint) * h >= 2000 and w >= 40 and h >= 40 else cast(w as bigint) * h >= 100 end, false)""")
def mask_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = classify.contour_reason(F.col("bounds"), F.col("is_hole"))
    return boxes(spark, sf_dir).where(reason != "kept").select("id", "bounds.width", "bounds.height")




def _screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small grey image for each part: two boxes, one in the other (image_id, width, height, gray)."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, size in zip(frame["p_partkey"], frame["p_size"], strict=True):
                gray = np.full((64, 96), 255, np.uint8)
                for x, y, w, h in ((8 + k % 5, 6, 30 + size, 44), (16 + k % 5, 14, 12 + size // 2, 20)):
                    gray[y, x : x + w] = gray[y + h - 1, x : x + w] = gray[y : y + h, x] = gray[y : y + h, x + w - 1] = 0
                out.append((str(k), 96, 64, gray.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "gray"])

    # a small file of keys stands for much work on images, so it is dealt out to all cores
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.mapInPandas(run, "image_id string, width int, height int, gray binary")


@query()
def image_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens through PNG bytes and back."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    from ..imaging import png
    from ..sources.images import decode_bytes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"image_id": frame["image_id"], "content": [png.encode(np.frombuffer(g, np.uint8).reshape(h, w)) for g, h, w in zip(frame["gray"], frame["height"], frame["width"], strict=True)]})

    rows = decode_bytes(_screens(spark, sf_dir).mapInPandas(run, "image_id string, content binary"))
    return rows.select("image_id", "width", "height", F.crc32("gray").alias("digest"), "error")


@query()
def canny_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours of the screens with the reason that keeps or drops each."""
    from ..imaging.operators import trace_contours

    rows = trace_contours(_screens(spark, sf_dir))
    return rows.select("image_id", "contour_id", "parent_id", "border_type", *flat("bounds"), classify.contour_reason(F.col("bounds"), F.col("border_type") == "hole").alias("reason"))


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's words on the layout of its boxes, as elements with a root."""
    ws = word_rows(spark, sf_dir).select(F.col("image_id").cast("string").alias("image_id"), "word_id", "text", "bounds", F.col("confidence").cast("float").alias("confidence"))
    screens = ws.select("image_id").distinct()
    roots = screens.select("image_id", F.expr("cast(array() as array<int>)").alias("path"), F.lit("root").alias("kind"), g.bounds(F.lit(0), F.lit(0), F.lit(1920), F.lit(180)).alias("bounds"))
    return words.attach_words(hierarchy.as_elements(roots), ws)


@query()
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.documents import results_json

    return results_json(_attached(spark, sf_dir))


@query()
def skeleton_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.documents import skeleton_html as page

    return page(_attached(spark, sf_dir))


@query("""
select event_id, case when event_id % 4 = 0 then round(value, 4) else 0 end + 0.0 as session_ms, case when event_id % 4 = 1 then 2.5 else 0 end + 0.0 as run_ms, case when event_id % 4 = 0 then 3 else 0 end as images, 0 as batches from events""")
def embed_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings of an embedding run, with defaults for what is missing or can't be parsed."""
    from ..sources.documents import embed_timings as parsed

    k = F.col("event_id") % 4
    doc = F.when(k == 0, F.concat(F.lit('{"session_ms": '), F.col("value").cast("string"), F.lit(', "images": 3}'))).when(k == 1, '{"run_ms": 2.5, "other": 1}').when(k == 2, "no json")
    rows = parsed(table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "event_id", "doc")
    return rows.select("event_id", F.round("session_ms", 4).alias("session_ms"), "run_ms", "images", "batches")


@query("""
select event_id, row_number() over (partition by user_id order by event_id) - 1 as kept_index, user_id from events where event_type <> 'error'""")
def kept_contour_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.contours import kept_index

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") != "error").alias("kept"))
    return kept_index(rows, "user_id", "event_id").select("event_id", F.col("kept_index").cast("long").alias("kept_index"), "user_id")


@query("select event_id, value from events where value >= 0.5 * 100")
def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the least confidence that the settings ask for; the tables' values end at 100 as words' do."""
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.col("value").alias("confidence"))
    return words.confident(rows, 0.5).select("event_id", "value")


@query("""
select conv_id, turn, '/' || role || ':/a:/b' as path from conversations""")
def distinct_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("/"), "role", F.lit("::/a:/"), "role", F.lit(":/b:/a")).alias("path"))
    return rows.select("conv_id", "turn", text.distinct_parts(F.col("path")).alias("path"))
