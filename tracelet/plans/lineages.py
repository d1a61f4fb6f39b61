"""Queries of the rules that look beside a branch, of runs read into forests, and of dendrograms, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelet.operators import regions as rg
from tracelet.operators import rules, segment, spatial, trees
from tracelet.plans import carriers as c
from tracelet.plans.catalog import TREE, TREES, query, rounded
from tracelet.plans.durable import durable

NEAR = 0.6
# nodes of a frame nearer than NEAR touch, in the more voxels the nearer they are
TOUCH = f"""sq as (select a.id as a, b.id as b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2 from nodes a join nodes b on a.frame = b.frame and a.id <> b.id),
touch as (select a, b, floor(20 * ({NEAR} - sqrt(d2)))::bigint as n_border from sq where d2 < {NEAR} * {NEAR}),
nn as (select a as id, b as near from (select *, row_number() over (partition by a order by d2, b) as rank from sq where d2 < {NEAR} * {NEAR}) where rank = 1),
places as (select id, branch, place, n_children, length from branched join summary using (branch))"""


def _neighbours(f):
    return spatial.nearest_in_space(f, NEAR)


def _touches(f):
    met = spatial.range_join(f, f, NEAR).filter("a_id <> b_id")
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.floor(20 * (NEAR - F.sqrt("d2"))).alias("n_border"))


APART = """apart as (select distinct p.l_branch, p.r_branch from {pairs} p join places l on l.branch = p.l_branch and l.n_children = 1 join places r on r.branch = p.r_branch and r.place = l.place and r.n_children = 1
  left join touch t on t.a = l.id and t.b = r.id and t.n_border >= {least} where t.a is null)"""
TOGETHER = f"{TREES}, {TOUCH}, {APART.format(pairs='pairs', least=2)}"


@query("non_separating", f"{TOGETHER} select id, l_branch, r_branch from pairs where (l_branch, r_branch) not in (select (l_branch, r_branch) from apart)")
def non_separating(spark, d):
    f = c.forest(spark, d)
    return rules.non_separating(f, _touches(f), 2)


@query(
    "short_lived_or_close",
    f"""{TOGETHER}, m as (select *, case when l_last_frame - frame > 2 then 1 when l_ends = 'death' then 0 else 2 end + case when r_last_frame - frame > 2 then 1 when r_ends = 'death' then 0 else 2 end as k from pairs where frame < 7)
select id, l_branch, r_branch, case when k <= 1 then 'short-lived' else 'non-separating' end as rule from m where k <= 1 or (l_branch, r_branch) not in (select (l_branch, r_branch) from apart)""",
)
def short_lived_or_close(spark, d):
    f = c.forest(spark, d)
    return rules.short_lived_or_close(f, _touches(f), 2, 7, 2)


@query(
    "parallel_lineages",
    f"""{TREES}, {TOUCH}, cand as (select t.a as l_branch, t.b as r_branch from touch t join nodes l on l.id = t.a and l.parent is null join nodes r on r.id = t.b and r.parent is null where t.a < t.b and t.n_border >= 1), {APART.format(pairs='cand', least=1)}
select l_branch, min(r_branch) as r_branch from cand where (l_branch, r_branch) not in (select (l_branch, r_branch) from apart) group by l_branch""",
)
def parallel_lineages(spark, d):
    f = c.forest(spark, d)
    return rules.parallel_lineages(f, _touches(f))


@query("neighbour_division", f"{TREES}, {TOUCH} select k.id, (case when s.ends = 'death' then -1 else 1 end * (s.length - 1 - p.place))::bigint as steps from kids k left join nn on nn.id = k.id left join branched p on p.id = nn.near left join summary s on s.branch = p.branch where k.n_children = 0")
def neighbour_division(spark, d):
    f = durable(c.forest(spark, d))
    return rules.neighbour_division(f, _neighbours(f))


@query("death_then_division", f"{TREES}, {TOUCH} select n.id from kids k join nodes n using (id) join nn on nn.id = k.id join branched p on p.id = nn.near join summary s on s.branch = p.branch where k.n_children = 0 and s.ends = 'division' and s.last_frame - n.frame <= 1")
def death_then_division(spark, d):
    f = c.forest(spark, d)
    return rules.death_then_division(f, _neighbours(f), 1)


@query(
    "death_ratio",
    f"""{TREES}, {TOUCH}, dd as (select k.id, nn.near from kids k left join nn on nn.id = k.id where k.n_children = 0), j as (select p.id as a, q.id as b, 1 / (1 + sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) as jaccard from nodes p join nodes q on q.frame = p.frame + 1 where (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 < {NEAR} * {NEAR}),
l as (select dd.id, min(1 - coalesce(jn.jaccard, 0)) as jn, min(1 - coalesce(jd.jaccard, 0)) as jd from dd left join nodes ch on ch.parent = dd.near left join j jn on jn.a = dd.near and jn.b = ch.id left join j jd on jd.a = dd.id and jd.b = ch.id where dd.near is not null group by dd.id)
select dd.id, round(coalesce((jn - jd) / (jn + 1e-4), 1.2), 6) as ratio from dd left join l using (id)""",
)
def death_ratio(spark, d):
    f = durable(c.forest(spark, d))
    near = durable(_neighbours(f))
    met = spatial.within_range(rules.asked_overlaps(f, near), f, NEAR, frame_step=1)
    o = met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), (1 / (1 + F.sqrt("d2"))).alias("jaccard"))
    return rounded(rules.death_ratio(f, near, o), "ratio")


@query("displacement_overlap", f"{TREE} select n.id, round(coalesce(case when p.id is not null and n.id % 3 <> 0 then 1 - 1 / (1 + abs(n.score - p.score)) end, 0), 6) as distance from nodes n left join nodes p on p.id = n.parent")
def displacement_overlap(spark, d):
    f = c.forest(spark, d)
    up = f.select(F.col("id").alias("a"), F.col("score").alias("sa"))
    j = f.filter("id % 3 <> 0").join(up, F.col("parent") == F.col("a")).select("a", F.col("id").alias("b"), (1 / (1 + F.abs(F.col("score") - F.col("sa")))).alias("jaccard"))
    return rounded(rules.displacement_overlap(f, j), "distance")


RUN = """run as (select (vec_id + 1) // 40 as frame, (vec_id + 1) % 40 as position, (vec_id * 7 + 3) % 50 as parent, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label % 5 = 3 as dead from embeddings),
alive as (select *, row_number() over (order by frame, position) - 1 as id from run where not dead)"""


@query(
    "chain_frames",
    f"""with recursive {RUN}, linked as (select a.id, p.id as parent, a.frame, a.x, a.y, a.z from alive a left join alive p on p.frame = a.frame - 1 and p.position = a.parent), up(id, top, steps) as (select id, id, 0 from linked union all select u.id, l.parent, u.steps + 1 from up u join linked l on l.id = u.top where l.parent is not null)
select l.*, r.lineage from linked l join (select id, arg_max(top, steps) as lineage from up group by id) r using (id)""",
)
def chain_frames(spark, d):
    i, e = F.col("vec_id"), F.col("embedding")
    run = c.table(spark, d, "embeddings").select(F.floor((i + 1) / 40).alias("frame"), ((i + 1) % 40).alias("position"), ((i * 7 + 3) % 50).alias("parent"), *[e[k].cast("double").alias(a) for k, a in enumerate("xyz")], (F.col("label") % 5 == 3).alias("dead"))
    return rules.chain_frames(run)


@query("regions_of_lineage", f"{TREE}, own as (select distinct l_partkey as sv_id, l_suppkey as id from lineitem), r as (select id, arg_max(ancestor, steps) as root from anc group by id) select root, frame, sv_id from nodes join r using (id) join own using (id) where frame between 2 and 4")
def regions_of_lineage(spark, d):
    own = c.table(spark, d, "lineitem").select(F.col("l_partkey").alias("sv_id"), F.col("l_suppkey").alias("id")).distinct()
    return rules.regions_of_lineage(c.forest(spark, d), own, 2, 4)


@query("near_duplicates", f"with {c.POINTS}, pairs as (select a.id, a.label as na, b.label as nb, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2 from points a join points b on a.frame = b.frame and a.id <> b.id) select id, count(*) as n from pairs where d2 < 0.04 and na = nb group by id")
def near_duplicates(spark, d):
    p = c.points(spark, d)
    return rules.near_duplicates(p.select("id", "frame", F.col("label").alias("n")), spatial.range_join(p, p, 0.2), 0.04)


@query("shared_owners", "select id, n from (select l_partkey as id, count(distinct l_suppkey) as n from lineitem group by 1) where n > 1")
def shared_owners(spark, d):
    return rules.shared_owners(c.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sv_id"), F.col("l_partkey").alias("id")).distinct())


@query(
    "tree_extent",
    f"""{TREE}, r as (select id, arg_max(ancestor, steps) as root from anc group by id), mv as (select n.*, coalesce(sqrt((n.x - p.x) ** 2 + (n.y - p.y) ** 2 + (n.z - p.z) ** 2), 0) as step from nodes n left join nodes p on p.id = n.parent)
select root, count(*) as n, round(sum(step), 6) as path, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from mv join r using (id) group by root""",
)
def tree_extent(spark, d):
    return rounded(rules.tree_extent(c.forest(spark, d)), "path")


@query("clip_trees", f"{TREE}, i as (select * from nodes where x between -0.2 and 0.3 and y between -0.3 and 0.2 and z between -0.3 and 0.3) select i.id, p.id as parent, i.frame from i left join i p on p.id = i.parent")
def clip_trees(spark, d):
    return rules.clip_trees(c.forest(spark, d), (-0.2, -0.3, -0.3), (0.3, 0.2, 0.3)).select("id", "parent", "frame")


@query(
    "touching_nodes",
    "with r as (select distinct l_suppkey as sv_id, l_partkey as voxel from lineitem), own as (select distinct sv_id, sv_id % 7 as id from r), t as (select a.sv_id as a, b.sv_id as b, count(*) as n_border from r a join r b on a.voxel = b.voxel and a.sv_id <> b.sv_id group by 1, 2) select oa.id as a, ob.id as b, max(n_border) as n_border from t join own oa on oa.sv_id = t.a join own ob on ob.sv_id = t.b where oa.id <> ob.id group by 1, 2",
)
def touching_nodes(spark, d):
    r = c.regions(spark, d)
    t = rg.overlap(r, r).filter("a <> b").select("a", "b", F.col("n_common").alias("n_border"))
    return rules.touching_nodes(t, r.select("sv_id", (F.col("sv_id") % 7).alias("id")).distinct())


# dendrograms: the forest of all nodes, whose height is the largest score below

DENDROGRAM = f"{TREE}, size as (select id, 1 + id % 5 as n from kids where n_children = 0), dn as (select a.ancestor as id, max(n.score) as thr, coalesce(sum(s.n), 0)::bigint as n, count(s.n) as n_leaves from anc a join nodes n on n.id = a.id left join size s on s.id = a.id group by 1), dg as (select n.id, n.parent, dn.thr, dn.n, dn.n_leaves, k.n_children from nodes n join dn using (id) join kids k using (id))"


def _dendrogram(spark, d):
    f = c.forest(spark, d)
    thr = trees.subtree_totals(f.select("id", "parent", F.col("score").alias("thr")), tops=("thr",))
    sizes = trees.children_count(f).filter("n_children = 0").select("id", (1 + F.col("id") % 5).alias("n"))
    return f.select("id", "parent").join(thr, "id"), sizes


@query("leaves_below", f"{DENDROGRAM} select id, n_leaves, n from dg")
def leaves_below(spark, d):
    return rules.leaves_below(*_dendrogram(spark, d))


@query("persistent_leaves", f"{DENDROGRAM} select l.id from dg l join dg p on p.id = l.parent where l.n_children = 0 and p.thr >= 0.6")
def persistent_leaves(spark, d):
    return rules.persistent_leaves(_dendrogram(spark, d)[0], 0.6)


@query("realistic_nodes", f"{DENDROGRAM}, big as (select parent as id, max(n) as n from dg where parent is not null group by 1) select dg.id from dg left join big using (id) where thr < 0.8 and coalesce(big.n, dg.n) > 3")
def realistic_nodes(spark, d):
    return rules.realistic_nodes(*_dendrogram(spark, d), 0.8, 3)


@query("dendrogram_faults", f"{DENDROGRAM} select 'further roots' as rule, greatest(count(*) filter (parent is null) - 1, 0)::bigint as n from dg union all select 'not two children', count(*) from dg where n_children not in (0, 2) union all select 'above its parent', count(*) from dg c join dg p on p.id = c.parent where c.thr > p.thr")
def dendrogram_faults(spark, d):
    return rules.dendrogram_faults(_dendrogram(spark, d)[0])


@query("collapse_single_children", f"{TREE}, stay as (select id from kids where n_children <> 1), way as (select a.id, a.ancestor, a.steps from anc a join stay s on s.id = a.ancestor where a.steps > 0) select s.id, arg_min(way.ancestor, way.steps) as parent from stay s left join way using (id) group by s.id")
def collapse_single_children(spark, d):
    return segment.collapse_single_children(c.forest(spark, d).select("id", "parent"))


@query("event_neighbourhoods")
def event_neighbourhoods(spark, d):
    f = c.forest(spark, d)
    return trees.event_neighbourhoods(f, spatial.knn_in_space(f, 1, 0.1), 2)


@query("insert_children", f"{TREE}, fresh as (select vec_id + 1 as id, (vec_id + 1) // 2 as parent from embeddings where label % 5 = 3), taken as (select parent, count(*) as k from nodes where parent is not null group by 1), r as (select f.id, f.parent, coalesce(k, 0) as k, row_number() over (partition by f.parent order by f.id) as turn from fresh f left join taken using (parent)) select id, parent from nodes union all select id, parent from r where k + turn <= 2 or parent is null")
def insert_children(spark, d):
    f = c.forest(spark, d).select("id", "parent")
    fresh = c.table(spark, d, "embeddings").filter("label % 5 = 3").select((F.col("vec_id") + 1).alias("id"), F.floor((F.col("vec_id") + 1) / 2).alias("parent"))
    return trees.insert_children(f, fresh)


@query(
    "paste_sublineages",
    f"""{TREE}, gone as (select a.id, a.ancestor as top from anc a join nodes t on t.id = a.ancestor and t.frame = 3 join nodes n on n.id = a.id where n.frame < 5), edited as (select n.*, g.id is not null as cut from nodes n left join gone g using (id) where g.id is null or n.id % 4 <> 1 or n.id = g.top)
select e.id, p.id as parent, e.frame, round(case when e.cut then e.score + 1 else e.score end, 6) as score from edited e left join edited p on p.id = e.parent""",
)
def paste_sublineages(spark, d):
    """Subtrees of the nodes of frame 3 for two frames, without the nodes with id % 4 = 1 below their tops, and with other scores."""
    f = c.forest(spark, d)
    cut = trees.cut_sublineages(f, f.filter("frame = 3").select("id"), 2)
    edited = cut.filter("id % 4 <> 1 or id = top").withColumn("score", F.col("score") + 1)
    return rounded(trees.paste_sublineages(f, edited, 2).select("id", "parent", "frame", "score"), "score")


@query(
    "extend_dead",
    f"""{TREE}, dead as (select id from kids join nodes using (id) where n_children = 0 and frame = 6), o as (select a.id, b.id as sv_id, floor(100 / (1 + sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))))::bigint as score from dead d join nodes a using (id) join nodes b on b.frame = a.frame + 1 where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < {NEAR} * {NEAR}),
best as (select *, row_number() over (partition by id order by score desc, sv_id) as rn from o), held as (select *, case when sv_id % 2 = 0 then sv_id end as owner, row_number() over (partition by sv_id order by score desc, id) as turn from best where rn = 1)
select id, sv_id, score, owner from held where owner is not null or turn = 1""",
)
def extend_dead(spark, d):
    """A region a node, of its id; regions of odd ids are free from frame 7 on."""
    f = c.forest(spark, d)
    own = f.filter("frame < 7 or id % 2 = 0").select(F.col("id").alias("sv_id"), "id")
    o = spatial.range_join(f, f, NEAR, frame_step=1).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.floor(100 / (1 + F.sqrt("d2"))).alias("n_common"))
    return trees.extend_dead(f, own, o, 6)
