"""Queries of linking programmes, objects, boxes around ellipsoids and plain array operations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelet.functions import geometry
from tracelet.operators import features, filters, programme, segment, spatial, trees
from tracelet.plans import carriers as c
from tracelet.plans.catalog import EDGES, TREE, R, _edges, _near, query, rounded
from tracelet.plans.durable import durable

# links as a programme

COLUMNS = f"""{c.POINTS}, {_near(1)}, cand as (select a_id as parent, b_id as child1, d2 from ranked where rank <= 3), cols as (select parent, child1, null::bigint as child2, d2 - 0.02 as cost from cand union all select a.parent, a.child1, b.child1, a.d2 + b.d2 - 0.04 + 0.01 from cand a join cand b on a.parent = b.parent and a.child1 < b.child1)"""


def _columns(spark, d):
    return programme.links(spatial.knn_forward(c.points(spark, d), 3, R), 0.02, 0.01)


@query("link_columns", f"with {COLUMNS} select parent, child1, child2, round(cost, 6) as cost, row_number() over (partition by parent order by cost, child1, child2)::int as rank from cols")
def link_columns(spark, d):
    k = _columns(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy("cost", "child1", F.col("child2").asc_nulls_last())))
    return rounded(k.drop("edge"), "cost")


@query("constraint_rows", f"with {COLUMNS}, n as (select parent * 2 as row, child2 is null as move from cols union all select child1 * 2 + 1, child2 is null from cols union all select child2 * 2 + 1, false from cols where child2 is not null) select row, count(*) as n, count(*) filter (move) as n_moves from n group by row")
def constraint_rows(spark, d):
    k = _columns(spark, d)
    n = programme.constraint_rows(k).join(k.select("edge", F.col("child2").isNull().alias("move")), "edge")
    return n.groupBy("row").agg(F.count("*").alias("n"), F.count_if("move").alias("n_moves"))


@query("edges_of_rows", f"with {COLUMNS} select parent, child1, child2, round(cost, 6) as cost from cols")
def edges_of_rows(spark, d):
    k = _columns(spark, d)
    return rounded(programme.edges_of(programme.constraint_rows(k), k.select("edge", "cost")).drop("edge"), "cost")


FIRSTS = f"{COLUMNS}, pick as (select * from cols where parent % 4 = 0 and child2 is null)"


@query("flow_faults", f"with {FIRSTS}, n as (select parent * 2 as row from pick union all select child1 * 2 + 1 from pick) select row, count(*) as n from n group by row having count(*) > 1")
def flow_faults(spark, d):
    k = _columns(spark, d)
    return programme.flow_faults(k, k.filter("parent % 4 = 0 and child2 is null").select("edge"))


@query("solution_features", f"with {FIRSTS} select feature, round(sum(value), 6) as total from (select 'cost' as feature, cost as value from pick union all select 'one', 1.0::double from pick) group by feature")
def solution_features(spark, d):
    k = _columns(spark, d)
    f = k.select("edge", F.explode(F.array(F.struct(F.lit("cost").alias("feature"), F.col("cost").alias("value")), F.struct(F.lit("one").alias("feature"), F.lit(1.0).alias("value")))).alias("s")).select("edge", "s.*")
    return rounded(programme.solution_features(f, k.filter("parent % 4 = 0 and child2 is null").select("edge")), "total")


@query("best_links", "select 0::bigint as faults, true as not_worse")
def best_links(spark, d):
    """The best choice breaks no constraint and costs no more than a likely one."""
    k = _columns(spark, d)
    cost, faults = [], 0
    for chosen in (programme.best_choice(spatial.knn_forward(c.points(spark, d), 3, R), 0.02, 0.01), programme.likely_choice(k, 1, 0.005)):
        chosen = durable(chosen)
        cost.append(k.join(chosen, "edge").agg(F.sum("cost")).first()[0] or 0.0)
        faults += programme.flow_faults(k, chosen).count()
    return spark.createDataFrame([(faults, cost[0] <= cost[1] + 1e-9 and cost[0] < 0)], "faults long, not_worse boolean")


@query("linked_lineages", f"with {COLUMNS}, best as (select * from cols where child2 is null qualify row_number() over (partition by child1 order by cost, parent) = 1) select p.id, b.parent from points p left join best b on b.child1 = p.id")
def linked_lineages(spark, d):
    k = _columns(spark, d)
    first = F.row_number().over(Window.partitionBy("child1").orderBy("cost", "parent"))
    chosen = k.filter("child2 is null").withColumn("turn", first).filter("turn = 1").select("edge")
    return programme.lineages(k, chosen, c.points(spark, d).select("id"))


MERGES = f"{TREE}, mg as (select id as node, parent as into_ from nodes where parent is not null and score < 0.7), up(id, top) as (select id, id from nodes union all select u.id, m.into_ from up u join mg m on m.node = u.top), fin as (select id, top from up where top not in (select node from mg)), ends as (select distinct top as id from fin join kids using (id) where n_children = 0)"


@query("spatial_candidates", f"{MERGES}, w as (select a.id as node, a.ancestor, a.steps from anc a join ends e on e.id = a.ancestor) select arg_max(ancestor, steps) as top, node from w group by node")
def spatial_candidates(spark, d):
    f = c.forest(spark, d)
    merges = f.filter("parent is not null and score < 0.7").select(F.col("id").alias("node"), F.col("parent").alias("into"), F.lit(1.0).alias("score"))
    return programme.spatial_candidates(f.select(F.col("id").alias("node"), "parent"), merges)


@query("anchored_candidates", f"{MERGES}, w as (select a.id as node, a.ancestor, a.steps from anc a join ends e on e.id = a.ancestor), cd as (select arg_max(ancestor, steps) as top, node from w group by node) select * from cd where top in (select top from cd where node % 11 = 0)")
def anchored_candidates(spark, d):
    return programme.anchored(spatial_candidates(spark, d), c.forest(spark, d).filter("id % 11 = 0").select(F.col("id").alias("node")))


# objects

GRID = f"{c.VOLUME}, g as (select voxel_id, x, y, z from volume where frame = 0 and v > 150)"
STEP = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"


def _grid(spark, d):
    return c.volume(spark, d).filter("frame = 0 and v > 150").select("voxel_id", "x", "y", "z")


@query("objects", f"with recursive {GRID}, st as (select a.voxel_id as u, b.voxel_id as v from g a join g b on {STEP}), re(s, t) as (select voxel_id, voxel_id from g union select re.s, st.v from re join st on st.u = re.t), pt as (select s as voxel_id, min(t) as part from re group by s) select part, count(*) as n, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from pt join g using (voxel_id) group by part")
def objects(spark, d):
    return segment.objects(_grid(spark, d), 6)


@query("flooded_object", f"with recursive {GRID}, st as (select a.voxel_id as u, b.voxel_id as v from g a join g b on {STEP}), re(t) as (select min(voxel_id) from g union select st.v from re join st on st.u = re.t) select voxel_id, x, y, z from g where voxel_id in (select t from re)")
def flooded_object(spark, d):
    g = _grid(spark, d)
    return segment.flood_object(g, g.agg(F.min("voxel_id").alias("voxel_id")), 6)


@query("geodesic_labels", f"with recursive {GRID}, st as (select a.voxel_id as u, b.voxel_id as v from g a join g b on {STEP}), re(label, t, steps) as (select voxel_id, voxel_id, 0 from g where voxel_id % 97 = 3 union select re.label, st.v, re.steps + 1 from re join st on st.u = re.t where re.steps < 12), b as (select t as voxel_id, arg_min(label, (steps, label)) as label, min(steps) as steps from re group by t) select voxel_id, label, steps from g left join b using (voxel_id) where steps <= 12")
def geodesic_labels(spark, d):
    g = _grid(spark, d)
    return segment.geodesic_labels(g, g.filter("voxel_id % 97 = 3").select("voxel_id"), 6).filter("steps <= 12")


@query("collapsed_regions", f"with recursive {EDGES}, on_ as (select u, v from edges where weight < 0.06), bo as (select u, v from on_ union all select v, u from on_), nd as (select u as id from edges union select v from edges), re(s, t) as (select id, id from nd union select re.s, bo.v from re join bo on bo.u = re.t) select s as node, min(t) as into from re group by s".replace("as into from", "as \"into\" from"))
def collapsed_regions(spark, d):
    return segment.collapse_regions(_edges(spark, d), F.col("weight") < 0.06)


@query("merged_partition", "select vec_id, case when label < 4 then label % 2 else label end as label from embeddings")
def merged_partition(spark, d):
    e = c.table(spark, d, "embeddings").select("vec_id", "label")
    mapping = e.select("label").distinct().filter("label < 4").select("label", (F.col("label") % 2).cast("int").alias("into"))
    return segment.merge_partition(e, mapping)


SPLICED = f"{TREE}, sz as (select a.ancestor as id, count(*) as n from anc a group by 1), dup as (select n.id, n.parent from nodes n join sz s on s.id = n.id join sz p on p.id = n.parent where 1 - s.n / p.n < 0.3), way as (select a.id, a.ancestor, a.steps from anc a where a.steps > 0 and a.ancestor not in (select id from dup))"


@query("spliced_duplicates", f"{SPLICED} select n.id, case when n.parent in (select parent from dup) then null else (select arg_min(w.ancestor, w.steps) from way w where w.id = n.id) end as parent from nodes n where n.id not in (select id from dup)")
def spliced_duplicates(spark, d):
    f = c.forest(spark, d)
    sizes = trees.subtree_sizes(f).select("id", F.col("n_nodes").alias("n"))
    return segment.splice_duplicates(f.select("id", "parent", F.lit(0.0).alias("thr")), sizes, 1.0, 0.3).select("id", "parent")


@query("extend_dead_with_halves")
def extend_dead_with_halves(spark, d):
    f = c.forest(spark, d)
    own = f.filter("frame < 7 or id % 2 = 0").select(F.col("id").alias("sv_id"), "id")
    o = spatial.range_join(f, f, 0.6, frame_step=1).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.floor(100 / (1 + F.sqrt("d2"))).alias("n_common"), (1 / (1 + F.sqrt("d2"))).alias("jaccard"))
    halves = o.select(F.col("b").alias("sv_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), "a", "jaccard").withColumn("jaccard", F.col("jaccard") + F.when(F.col("half") == F.col("a") % 2, 0.15).otherwise(-0.1))
    return trees.extend_dead_with_halves(f, own, o, halves, 6)


# boxes around ellipsoids

PICTURE = f"{c.VOLUME}, pic as (select x, y, z, v from volume where frame = 0)"


def _interpolation(x: str, y: str, z: str) -> str:
    terms = []
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                w = " * ".join(f"({p} - floor({p}))" if on else f"(1 - ({p} - floor({p})))" for p, on in ((x, i), (y, j), (z, k)))
                terms.append(f"{w} * coalesce((select v from pic where pic.x = floor({x}) + {i} and pic.y = floor({y}) + {j} and pic.z = floor({z}) + {k}), 0)")
    return " + ".join(terms)


@query("interpolated", f"with {PICTURE}, pt as (select vec_id as id, 10 + 8 * embedding[1]::double as x, 8 + 8 * embedding[2]::double as y, 1 + embedding[3]::double as z from embeddings) select id, round({_interpolation('pt.x', 'pt.y', 'pt.z')}, 4) as v from pt")
def interpolated(spark, d):
    e = F.col("embedding")
    pt = c.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (10 + 8 * e[0].cast("double")).alias("x"), (8 + 8 * e[1].cast("double")).alias("y"), (1 + e[2].cast("double")).alias("z"))
    return rounded(features.interpolated(pt, c.volume(spark, d).filter("frame = 0").withColumn("v", F.col("v").cast("double"))), "v", places=4)


@query("ellipsoid_boxes", f"with {PICTURE}, el as (select vec_id as id, 10 + 6 * embedding[1]::double as ex, 8 + 6 * embedding[2]::double as ey, 1.5 as ez from embeddings where vec_id % 10 = 0), sm as (select id, p, q, r, ex + 1.5 * ((2.0 * p + 1) / 6 - 1) * 2 as x, ey + 1.5 * ((2.0 * q + 1) / 6 - 1) as y, ez + 1.5 * ((2.0 * r + 1) / 6 - 1) * 0.5 as z from el, range(6) a(p), range(6) b(q), range(6) e(r)), iv as (select id, p, q, r, {_interpolation('sm.x', 'sm.y', 'sm.z')} as v from sm), bx as (select id, p // 2 as i, q // 2 as j, r // 2 as k, avg(v) as mean from iv group by 1, 2, 3, 4), lg as (select id, unnest([0, 1, 2]) as axis, unnest([i, j, k]) as at_, mean from bx) select id, axis::int as axis, round(avg(mean) filter (at_ = 1) - avg(mean) filter (at_ <> 1), 4) as contrast from lg group by 1, 2")
def ellipsoid_boxes(spark, d):
    """Half-axes of 2, 1 and 0.5 along x, y and z; the contrast of the middle boxes along each."""
    e = F.col("embedding")
    el = c.table(spark, d, "embeddings").filter("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), (10 + 6 * e[0].cast("double")).alias("x"), (8 + 6 * e[1].cast("double")).alias("y"), F.lit(1.5).alias("z"), F.array(*[F.lit(x) for x in (0.25, 0.0, 0.0, 1.0, 0.0, 4.0)]).alias("w"))
    b = features.ellipsoid_boxes(el, c.volume(spark, d).filter("frame = 0").withColumn("v", F.col("v").cast("double")))
    return rounded(features.box_contrasts(b), "contrast", places=4)


@query("cell_means")
def cell_means(spark, d):
    p = c.points(spark, d).select(F.col("label").alias("id"), "x", "y", "z", "v")
    return rounded(features.mean_by_cell(p), "mean")


# arrays


@query("transposed", f"with {c.VOLUME} select frame, y as x, x as y, z, v from volume")
def transposed(spark, d):
    return filters.transposed(c.volume(spark, d).select("frame", "x", "y", "z", "v"))


@query("converted", f"with {c.VOLUME} select frame, voxel_id, least(v, 255) as small, least(v << 6, 65535) as shifted, v >> 2 as less, v::double as real from volume")
def converted(spark, d):
    v, out = c.volume(spark, d).select("frame", "voxel_id", "v"), None
    for name, kind, shift in (("small", "uint8", 0), ("shifted", "uint16", 6), ("less", "int32", -2), ("real", "float", 0)):
        one = filters.converted(v, kind, shift).withColumnRenamed("v", name)
        out = one if out is None else out.join(one, ["frame", "voxel_id"])
    return out


@query("applied", f"with {c.VOLUME} select frame, voxel_id, v * 2 + x - y as v from volume")
def applied(spark, d):
    v = c.volume(spark, d).select("frame", "voxel_id", "x", "y", "v")
    return filters.applied(v, F.col("v") * 2 + F.col("x") - F.col("y")).drop("x", "y")


@query("stacked", f"with {c.VOLUME} select 0 as layer, frame, voxel_id, v from volume union all select 1, frame, voxel_id, v + 1 from volume")
def stacked(spark, d):
    v = c.volume(spark, d).select("frame", "voxel_id", "v")
    return filters.stacked([v, v.withColumn("v", F.col("v") + 1)])


@query("plane_view", f"with {c.VOLUME} select frame, x, y, v from volume where z = 2")
def plane_view(spark, d):
    return filters.clip(c.volume(spark, d), (0, 0, 2), (c.DX, c.DY, 2)).select("frame", "x", "y", "v")


@query("same_nuclei", f"with {c.POINTS} select a.id as a_id, b.id as b_id from points a join points b on a.frame = b.frame and a.id < b.id where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.001")
def same_nuclei(spark, d):
    p = c.points(spark, d)
    return spatial.range_join(p, p, 0.001**0.5).filter("a_id < b_id").select("a_id", "b_id")


@query("nuclei_by_frame", f"{TREE} select frame, count(*) as n, count(*) filter (n_children = 0) as n_ends, round(avg(score), 4) as mean, round(stddev_samp(score), 4) as deviation from nodes join kids using (id) group by frame")
def nuclei_by_frame(spark, d):
    f = trees.children_count(c.forest(spark, d))
    return rounded(f.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("n_children") == 0).alias("n_ends"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("deviation")), "mean", "deviation", places=4)


@query("blob_distance", f"with {c.POINTS}, m as (select frame, avg(x) as mx, avg(y) as my, avg(z) as mz from points group by frame) select id, round((x - mx) ** 2 + (y - my) ** 2 + 25 * (z - mz) ** 2, 6) as d2 from points join m using (frame)")
def blob_distance(spark, d):
    p = c.points(spark, d)
    m = p.groupBy("frame").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    d2 = geometry.squared_distance([F.col(a) for a in "xyz"], [F.col(f"m{a}") for a in "xyz"], (1.0, 1.0, 5.0))
    return rounded(p.join(m, "frame").select("id", d2.alias("d2")), "d2")
