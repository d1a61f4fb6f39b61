"""Queries of the operators over the carriers, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelet.functions import geometry
from tracelet.operators import assign, features, filters, graph, mixture, segment, spatial, trees
from tracelet.operators import regions as rg
from tracelet.plans import carriers as c
from tracelet.sources.config import numbered_path_column
from tracelet.streaming import tracker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
R = 0.2


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(x, places).alias(x) if x in names else F.col(x) for x in df.columns])


def _near(step: int, same: bool = False) -> str:
    return f"""met as (
  select a.id as a_id, b.id as b_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2
  from points a join points b on b.frame = a.frame + {step}{' and a.id <> b.id' if same else ''}
), near as (select * from met where d2 < {R} * {R}), ranked as (
  select *, row_number() over (partition by a_id order by d2, b_id) as rank from near
)"""


def _knn(k: int) -> str:
    return f"select a_id, b_id, round(d2, 6) as d2, rank::int as rank from ranked where rank <= {k}"


@query("knn_space", f"with {c.POINTS}, {_near(0, True)} {_knn(5)}")
def knn_space(spark, d):
    return rounded(spatial.knn_in_space(c.points(spark, d), 5, R), "d2")


@query("knn_forward", f"with {c.POINTS}, {_near(1)} {_knn(10)}")
def knn_forward(spark, d):
    return rounded(spatial.knn_forward(c.points(spark, d), 10, R), "d2")


@query("knn_backward", f"with {c.POINTS}, {_near(-1)} {_knn(10)}")
def knn_backward(spark, d):
    return rounded(spatial.knn_backward(c.points(spark, d), 10, R), "d2")


@query("range_join", f"with {c.POINTS}, {_near(0)} select a_id, count(*) as n, round(max(d2), 6) as farthest from near group by a_id")
def range_join(spark, d):
    p = c.points(spark, d)
    return rounded(spatial.range_join(p, p, R).groupBy("a_id").agg(F.count("*").alias("n"), F.max("d2").alias("farthest")), "farthest")


SEEDED = """seeded as (
  select p.id, s.id as seed_id, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) + (p.z - s.z) * (p.z - s.z) as d2,
    row_number() over (partition by p.id order by (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) + (p.z - s.z) * (p.z - s.z), s.id) as rn
  from points p cross join (select * from points where id in (select min(id) from points group by frame, label)) s
)"""


def _labelled(p):
    """Of each label and frame the point with the least id."""
    return p.withColumn("least", F.min("id").over(Window.partitionBy("frame", "label"))).filter("id = least").drop("least")


def _seeds(p):
    return _labelled(p).withColumnRenamed("id", "seed_id")


@query("nearest_seed", f"with {c.POINTS}, {SEEDED} select id, seed_id, round(d2, 6) as d2 from seeded where rn = 1")
def nearest_seed(spark, d):
    p = c.points(spark, d)
    return rounded(spatial.nearest_seed(p, _seeds(p)), "d2")


@query("touching_seeds", f"with {c.POINTS}, {SEEDED}, {_near(0)} select a.seed_id as seed_a, b.seed_id as seed_b, count(*) as n from near join seeded a on a.id = a_id and a.rn = 1 join seeded b on b.id = b_id and b.rn = 1 where a.seed_id < b.seed_id group by 1, 2")
def touching_seeds(spark, d):
    p = c.points(spark, d)
    return spatial.touching_seeds(p.join(spatial.nearest_seed(p, _seeds(p)).select("id", "seed_id"), "id"), R)


@query(
    "knn_owners",
    f"""with {c.POINTS}, {_near(1)}, o as (
  select a.label as owner, b.label as other, min(d2) as d2 from near join points a on a.id = a_id join points b on b.id = b_id where a.label <> b.label group by 1, 2
), r as (select *, row_number() over (partition by owner order by d2, other)::int as rank from o) select owner, other, round(d2, 6) as d2, rank from r where rank <= 3""",
)
def knn_owners(spark, d):
    p = c.points(spark, d)
    return rounded(spatial.knn_owners(spatial.range_join(p, p, R, frame_step=1), p.select("id", F.col("label").alias("owner")), 3), "d2")


@query(
    "constellation_distance",
    f"""with {c.POINTS}, a as (select label, x, y, z from points where frame = 0), b as (select label, x, y, z from points where frame = 1), m as (
  select a.label as a_id, b.label as b_id, a.x, a.y, a.z, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as d2 from a join b on abs(a.label - b.label) <= 1 group by all
), r as (select *, row_number() over (partition by a_id, b_id order by d2) as rn from m) select a_id, b_id, round(sqrt(sum(d2)) / 3, 6) as distance from r where rn <= 3 group by a_id, b_id""",
)
def constellation_distance(spark, d):
    p = c.points(spark, d)
    one = lambda f: p.filter(F.col("frame") == f).select(F.col("label").alias("id"), "x", "y", "z")
    labels = p.select("label").distinct()
    pairs = labels.select(F.col("label").alias("a_id"), F.explode(F.array(*[F.col("label") + k for k in (-1, 0, 1)])).alias("b_id"))
    return rounded(spatial.constellation_distance(one(0), one(1), pairs, 3), "distance")


@query(
    "geometry_scalars",
    f"""with {c.POINTS}, w as (select *, 2 + x as xx, x * y as xy, x * z as xz, 2 + y as yy, y * z as yz, 2 + z as zz from points),
d as (select *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) as det from w)
select id, id % 7 as ix, (id // 7) % 5 as iy, id // 35 as iz, round(det, 6) as det, round((yy * zz - yz * yz) / det, 6) as inv_xx, round((xz * yz - xy * zz) / det, 6) as inv_xy,
  round(x * x * xx + y * y * yy + z * z * zz + 2 * (x * y * xy + x * z * xz + y * z * yz), 6) as maha,
  round((xx + yy) / 2 - sqrt((xx - yy) * (xx - yy) / 4 + xy * xy), 6) as eig_low,
  round(4.0 / 3.0 * pi() / sqrt(det * 8), 6) as volume, round(xz / 5, 6) as units_xz,
  case when id <= 1 then 1 else (2 ** length(bin(id - 1)))::bigint end as pad
from d""",
)
def geometry_scalars(spark, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    w = F.col("w")
    p = c.points(spark, d).withColumn("w", F.array(2 + x, x * y, x * z, 2 + y, y * z, 2 + z))
    ix = geometry.index_to_xyz(F.col("id"), 7, 5)
    out = p.select(
        "id", *[e.alias(n) for e, n in zip(ix, ("ix", "iy", "iz"))], geometry.determinant(w).alias("det"), geometry.inverse(w)[0].alias("inv_xx"), geometry.inverse(w)[1].alias("inv_xy"),
        geometry.quadratic_form([x, y, z], w).alias("maha"), geometry.eigenvalues2(w[0], w[1], w[3])[0].alias("eig_low"), geometry.ellipsoid_volume(w, F.lit(2.0)).alias("volume"),
        geometry.precision_to_units(w, (1, 1, 5))[2].alias("units_xz"), geometry.next_power_of_two(F.col("id")).alias("pad"),
    )
    return rounded(out, "det", "inv_xx", "inv_xy", "maha", "eig_low", "volume", "units_xz")


OVERLAP = f"""{c.region_sql('ra', 1)}, {c.region_sql('rb', 2)}, na as (select sv_id as a, count(*) as n_a from ra group by 1), nb as (select sv_id as b, count(*) as n_b from rb group by 1),
ov as (select ra.sv_id as a, rb.sv_id as b, count(*) as n_common from ra join rb using (voxel_id) group by 1, 2),
ovl as (select a, b, n_common, n_a, n_b, n_common / n_a as relative, n_common / (n_a + n_b - n_common) as jaccard from ov join na using (a) join nb using (b)),
best as (select b, max_by(a, (n_common, -a)) as a, max(n_common) as score from ovl group by b)"""


def _overlaps(spark, d):
    return rg.overlap(c.regions(spark, d, 1), c.regions(spark, d, 2))


@query("overlap", f"with {OVERLAP} select a, b, n_common, n_a, n_b, round(relative, 6) as relative, round(jaccard, 6) as jaccard from ovl")
def overlap(spark, d):
    return rounded(_overlaps(spark, d), "relative", "jaccard")


@query("best_candidate", f"with {OVERLAP} select b, a, score from best")
def best_candidate(spark, d):
    return rg.best_candidate(_overlaps(spark, d))


@query("mutual_best", f"with {OVERLAP}, back as (select a, max_by(b, (n_common, -b)) as b from ovl group by a) select a, b, score from best join back using (a, b)")
def mutual_best(spark, d):
    return rg.mutual_best(_overlaps(spark, d))


@query("one_to_many", f"with {OVERLAP}, t as (select b, max_by(a, (relative, -a)) as a, max(relative) as score from ovl where relative > 0.05 group by b), r as (select a, b, score, row_number() over (partition by a order by score desc, b)::int as rank from t) select a, b, round(score, 6) as score, rank from r where rank <= 2")
def one_to_many(spark, d):
    return rounded(rg.one_to_many(_overlaps(spark, d), 0.05, 2), "score")


@query("merge_regions", f"with {c.region_sql('r', None)} select sv_id // 2 as sv_id, count(*) as n, count(distinct voxel_id) as n_distinct from r group by 1")
def merge_regions(spark, d):
    r = c.regions(spark, d)
    into = r.select("sv_id").distinct().select("sv_id", F.floor(F.col("sv_id") / 2).alias("into"))
    return rg.merge_regions(r, into).groupBy("sv_id").agg(F.count("*").alias("n"), F.count_distinct("voxel_id").alias("n_distinct"))


@query("num_holes", f"with {c.region_sql('r', None)}, g as (select sv_id, voxel_id - lag(voxel_id) over (partition by sv_id order by voxel_id) - 1 as gap from r) select sv_id, sum(case when gap > 0 and gap * 3 < 60 then gap else 0 end)::bigint as n_holes from g group by sv_id")
def num_holes(spark, d):
    return rg.num_holes(c.regions(spark, d), 60)


@query(
    "weighted_moments",
    f"""with {c.POINTS}, m as (select label, sum(v) as weight, sum(v * x) / sum(v) as mx, sum(v * y) / sum(v) as my, sum(v * z) / sum(v) as mz, sum(v * x * x) / sum(v) as xx, sum(v * x * y) / sum(v) as xy, sum(v * z * z) / sum(v) as zz from points group by label)
select label, round(weight, 6) as weight, round(mx, 6) as x, round(my, 6) as y, round(mz, 6) as z, round(xx - mx * mx, 6) as cxx, round(xy - mx * my, 6) as cxy, round(zz - mz * mz, 6) as czz from m""",
)
def weighted_moments(spark, d):
    m = rg.weighted_moments(c.points(spark, d), "label")
    q = F.col("covariance")
    return rounded(m.select("label", "weight", "x", "y", "z", q[0].alias("cxx"), q[1].alias("cxy"), q[5].alias("czz")), "weight", "x", "y", "z", "cxx", "cxy", "czz")


@query("weighted_centroid", f"with {c.POINTS} select frame, label, round(sum(v), 6) as weight, round(sum(v * x) / sum(v), 6) as x, round(sum(v * y) / sum(v), 6) as y, round(sum(v * z) / sum(v), 6) as z from points group by frame, label")
def weighted_centroid(spark, d):
    return rounded(rg.weighted_centroid(c.points(spark, d), "frame", "label"), "weight", "x", "y", "z")


@query("region_shape", f"with {c.VOLUME} select sv_id, count(*) as n, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, (list_sort(list(z))[floor(count(*) * 0.95)::int + 1] - list_sort(list(z))[floor(count(*) * 0.05)::int + 1])::int as delta_z from volume where v > 150 group by sv_id")
def region_shape(spark, d):
    r = c.volume(spark, d).filter("v > 150")
    return r.groupBy("sv_id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).join(rg.delta_z(r), "sv_id")


OTSU = """lim as (select {k} as k, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by 1),
bins as (select k, lo, hi, floor((l_quantity - lo) * 255 / (hi - lo))::bigint as t, count(*) as n from lineitem join lim on k = {k} where hi > lo group by all),
sums as (select *, sum(n) over u as nb, sum(n * t) over u as sb, sum(n) over (partition by k) as na, sum(n * t) over (partition by k) as sa from bins window u as (partition by k order by t)),
sep as (select *, round(nb * (na - nb) * (sb / nb - (sa - sb) / (na - nb)) * (sb / nb - (sa - sb) / (na - nb)), 6) as s from sums where nb < na),
otsu as (select k, max_by(-t, (s, -t)) * -1 * (any_value(hi) - any_value(lo)) / 255 + any_value(lo) as threshold from sep group by k)"""


@query("otsu", f"with {OTSU.format(k='l_returnflag')} select lim.k as flag, round(threshold, 6) as threshold from lim left join otsu using (k)")
def otsu(spark, d):
    v = c.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("v"))
    return rounded(rg.otsu(v, "flag"), "threshold")


@query(
    "region_threshold",
    f"""with {OTSU.format(k='l_suppkey')}, s as (select l_suppkey as k, list_sort(list(l_quantity)) as vs from lineitem group by 1)
select k as sv_id, round(greatest(vs[greatest(len(vs) - 20, 0) + 1], vs[least(floor(len(vs) * (1 - 0.1))::int, len(vs) - 1) + 1], threshold), 6) as threshold from s left join otsu using (k)""",
)
def region_threshold(spark, d):
    v = c.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sv_id"), F.col("l_quantity").alias("v"))
    return rounded(rg.region_threshold(v, 20, 0.1), "threshold")


SIX = "off(dx, dy, dz) as (values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"
BRIGHT = f"{c.VOLUME}, bright as (select * from volume where v > 120), {SIX}"


@query("compactness", f"with {BRIGHT}, k as (select a.sv_id, count(*) as k from bright a, off join bright b on b.sv_id = a.sv_id and b.x = a.x + dx and b.y = a.y + dy and b.z = a.z + dz group by 1) select sv_id, count(*) as n, round(coalesce(any_value(k), 0) / count(*), 6) as mean_neighbours from bright left join k using (sv_id) group by sv_id")
def compactness(spark, d):
    return rounded(rg.compactness(c.volume(spark, d).filter("v > 120"), 6), "mean_neighbours")


@query("touching", f"with {BRIGHT}, f as (select * from bright where frame = 0) select a.sv_id as a, b.sv_id as b, count(distinct (a.x, a.y, a.z)) as n_border, count(distinct (b.x, b.y, b.z)) as n_border_b from f a, off join f b on b.x = a.x + dx and b.y = a.y + dy and b.z = a.z + dz where a.sv_id <> b.sv_id group by 1, 2")
def touching(spark, d):
    v = c.volume(spark, d).filter("v > 120 and frame = 0")
    return rg.touching(v, v, 6)


@query("border_voxels", f"with {BRIGHT}, k as (select a.sv_id, a.voxel_id, count(b.voxel_id) as k from bright a cross join off left join bright b on b.sv_id = a.sv_id and b.x = a.x + dx and b.y = a.y + dy and b.z = a.z + dz group by 1, 2) select sv_id, count(*) as n from k where k < 6 group by sv_id")
def border_voxels(spark, d):
    return rg.border_voxels(c.volume(spark, d).filter("v > 120"), 6).groupBy("sv_id").agg(F.count("*").alias("n"))


@query("overlap_shifted", f"""with {BRIGHT}, ce as (select sv_id, frame, avg(x) as x, avg(y) as y, avg(z) as z, count(*) as n from bright group by 1, 2),
pr as (select a.sv_id as a, b.sv_id as b, a.n as na, b.n as nb, trunc(b.x - a.x)::int as dx, trunc(b.y - a.y)::int as dy, trunc(b.z - a.z)::int as dz from ce a join ce b on a.frame = 0 and b.frame = 1 and b.sv_id = a.sv_id + 16),
cm as (select a, b, count(*) as n from pr join bright va on va.sv_id = a join bright vb on vb.sv_id = b and vb.x = va.x + dx and vb.y = va.y + dy and vb.z = va.z + dz group by 1, 2)
select a, b, round(coalesce(n, 0) / (na + nb - coalesce(n, 0)), 6) as jaccard from pr left join cm using (a, b)""")
def overlap_shifted(spark, d):
    v = c.volume(spark, d).filter("v > 120")
    pairs = v.filter("frame = 0").select(F.col("sv_id").alias("a"), (F.col("sv_id") + 16).alias("b")).distinct()
    return rounded(rg.overlap_shifted(v.filter("frame = 0"), v.filter("frame = 1"), pairs), "jaccard")


@query("trim")
def trim(spark, d):
    v = c.volume(spark, d).filter("frame = 0")
    out = rg.trim(v, rg.region_threshold(v, 60, 0.5), 6)
    return out.groupBy("sv_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


# forests

TREE, TREES = f"with recursive {c.FOREST}", f"with recursive {c.FOREST}, {c.BRANCHES}"


@query("tree_roots", f"{TREE} select id, arg_max(ancestor, steps) as root, max(steps)::bigint as depth from anc group by id")
def tree_roots(spark, d):
    return trees.roots(c.forest(spark, d))


@query("ancestor_at", f"{TREE}, w as (select a.id, a.ancestor, a.steps from anc a join nodes n on n.id = a.ancestor where n.frame <= 5), r as (select id, arg_max(ancestor, steps) as root from anc group by id) select r.id, coalesce(first, root) as ancestor from r left join (select id, arg_min(ancestor, steps) as first from w group by id) using (id)")
def ancestor_at(spark, d):
    return trees.ancestor_at(c.forest(spark, d), 5)


@query("subtree_sizes", f"{TREE} select ancestor as id, count(*) as n_nodes, count(*) filter (n_children = 0) as n_leaves, max(frame) as last_frame from anc join nodes using (id) join kids using (id) group by ancestor")
def subtree_sizes(spark, d):
    return trees.subtree_sizes(c.forest(spark, d))


@query("breadth_first", f"{TREE}, r as (select id, arg_max(ancestor, steps) as root, max(steps)::bigint as depth from anc group by id) select id, root, depth, row_number() over (partition by root order by depth, id) - 1 as position from r")
def breadth_first(spark, d):
    return trees.breadth_first(c.forest(spark, d))


@query("branches", f"{TREES} select branch, length, parent, last_id, last_frame, ends from tops")
def branches(spark, d):
    return trees.branch_summary(trees.branches(c.forest(spark, d))).drop("first_frame")


def _pairs(spark, d):
    return trees.daughters(trees.branches(c.forest(spark, d)))


@query("length_to_death", f"{TREES} select id, coalesce(least(case when l_ends = 'death' then l_length end, case when r_ends = 'death' then r_length end), -1) as length from pairs")
def length_to_death(spark, d):
    return trees.length_to_death(_pairs(spark, d))


@query("length_to_division", f"{TREES} select id, case when l_ends = 'death' then -l_length else l_length end as l_length, case when r_ends = 'death' then -r_length else r_length end as r_length from pairs")
def length_to_division(spark, d):
    return trees.length_to_division(_pairs(spark, d))


SHORT = "short as (select id, frame, case when l_ends = 'death' and l_last_frame - frame <= 2 then l_branch when r_ends = 'death' and r_last_frame - frame <= 2 then r_branch end as gone from pairs)"


@query("short_lived", f'{TREES}, {SHORT} select id, gone as "delete" from short where gone is not null')
def short_lived(spark, d):
    return trees.short_lived(_pairs(spark, d), 2)


@query("delete_short_lived", f"{TREES}, {SHORT} select id, parent, frame from nodes where id not in (select a.id from anc a join short on gone = ancestor where frame < 6)")
def delete_short_lived(spark, d):
    return trees.delete_short_lived(c.forest(spark, d), 2, 6).select("id", "parent", "frame")


@query(
    "merge_short_lived",
    f"""{TREES}, m as (select *, case when l_last_frame - frame > 2 then 1 when l_ends = 'death' then 0 else 2 end + case when r_last_frame - frame > 2 then 1 when r_ends = 'death' then 0 else 2 end as k from pairs)
select r.id, l.id as into from m join branched l on l.branch = l_branch join branched r on r.branch = r_branch and r.frame = l.frame where k <= 1""",
)
def merge_short_lived(spark, d):
    f = c.forest(spark, d)
    return trees.merge_daughters(f, trees.merge_short_lived(trees.daughters(trees.branches(f)), 2))


@query("dead_lineages", f"{TREES} select branch as root from tops where parent is null and ends = 'death' and last_frame < 8")
def dead_lineages(spark, d):
    return trees.dead_lineages(c.forest(spark, d), 8)


@query("short_background_lineages", f"{TREES} select branch as root from tops where parent is null and ends = 'death' and last_frame < 9 and length <= 3 and branch in (select branch from branched group by branch having min(score) >= 0.1)")
def short_background_lineages(spark, d):
    return trees.short_background_lineages(c.forest(spark, d), 3, 9, 0.1)


PLANE = """two as (select parent, min(id) as l, max(id) as r from nodes where parent is not null group by parent having count(*) = 2),
geo as (select m.id, l.id as lid, r.id as rid, m.x - (l.x + r.x) / 2 as px, m.y - (l.y + r.y) / 2 as py, m.z - (l.z + r.z) / 2 as pz, (l.x - r.x) / 2 as nx, (l.y - r.y) / 2 as ny, (l.z - r.z) / 2 as nz,
  (m.x - l.x) ** 2 + (m.y - l.y) ** 2 + (m.z - l.z) ** 2 as dl, (m.x - r.x) ** 2 + (m.y - r.y) ** 2 + (m.z - r.z) ** 2 as dr from two join nodes m on m.id = two.parent join nodes l on l.id = two.l join nodes r on r.id = two.r),
dist as (select *, abs(px * nx + py * ny + pz * nz) / sqrt(nx * nx + ny * ny + nz * nz) as distance from geo)"""


@query("division_plane", f"{TREE}, {PLANE} select id, round(distance, 6) as distance, distance > 0.1 as rejected, case when distance > 0.1 then case when dl >= dr then lid else rid end end as cut from dist")
def division_plane(spark, d):
    return rounded(trees.division_plane(c.forest(spark, d), 0.1), "distance")


@query("break_divisions", f"{TREE}, {PLANE}, cuts as (select case when dl >= dr then lid else rid end as cut from dist where distance > 0.1) select id, case when id not in (select cut from cuts) then parent end as parent from nodes")
def break_divisions(spark, d):
    f = c.forest(spark, d)
    return trees.break_divisions(f, trees.division_plane(f, 0.1)).select("id", "parent")


@query("branch_max", f"{TREES} select id, max(score) over (partition by branch) as branch_score, max(score) over (partition by branch) < 0.6 as kept from branched")
def branch_max(spark, d):
    return trees.branch_max(trees.branches(c.forest(spark, d)), 0.6)


@query("branch_mean", f"{TREES} select id, round(avg(score) over (partition by branch), 6) as branch_score, avg(score) over (partition by branch) < 0.35 as kept from branched")
def branch_mean(spark, d):
    return rounded(trees.branch_mean(trees.branches(c.forest(spark, d)), 0.35), "branch_score")


HYSTERESIS = """r as (select *, sum(case when score > {low} then 0 else 1 end) over (partition by {b} order by {p}) as run, score > {low} as inside from {t}),
dn as (select *, case when inside and max(score) over (partition by {b}, run, inside order by {p}) > {high} then max(score) over (partition by {b}, run, inside order by {p}) else score end as down from r),
up as (select *, case when inside and max(down) over (partition by {b}, run, inside order by {p} desc) > {high} then max(down) over (partition by {b}, run, inside order by {p} desc) else down end as raised from dn)"""


@query("hysteresis", f"{TREES}, {HYSTERESIS.format(low=0.2, high=0.6, b='branch', p='place', t='branched')} select id, score, raised, raised < 0.6 as kept from up")
def hysteresis(spark, d):
    return trees.hysteresis(trees.branches(c.forest(spark, d)), 0.2, 0.6)


@query("track_hysteresis", f"with {c.TRACKS}, {HYSTERESIS.format(low=20.0, high=80.0, b='track', p='frame', t='tracks')} select track, count(*) as n, round(sum(raised), 4) as total, count(*) filter (raised < 80) as n_kept from up group by track")
def track_hysteresis(spark, d):
    t = c.tracks(spark, d).select(F.struct("track", "frame").alias("id"), F.col("track").alias("branch"), F.col("frame").alias("place"), "score")
    h = trees.hysteresis(t, 20.0, 80.0)
    return rounded(h.groupBy(F.col("id.track").alias("track")).agg(F.count("*").alias("n"), F.sum("raised").alias("total"), F.count_if(F.col("raised") < 80).alias("n_kept")), "total", places=4)


@query("renumber", f"{TREE} select id, row_number() over (partition by frame order by id) - 1 as new_id, frame from nodes")
def renumber(spark, d):
    return trees.renumber(c.forest(spark, d))


@query("confidence", f"{TREE} select n.id, case when k.n_children = 1 and case when p.id is null then n.frame = 0 else (n.x - p.x) ** 2 + (n.y - p.y) ** 2 + (n.z - p.z) ** 2 <= 0.1 end then 3 else 0 end as confidence from nodes n join kids k using (id) left join nodes p on p.id = n.parent")
def confidence(spark, d):
    return trees.confidence(c.forest(spark, d), 0.1)


@query(
    "displacement_threshold",
    f"""{TREE}, mv as (select n.frame, sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y) + (n.z - p.z) * (n.z - p.z)) as d from nodes n join nodes p on p.id = n.parent),
md as (select frame, list_sort(list(d))[count(*) // 2 + 1] as med from mv group by frame), gp as (select frame, med, d, abs(d - med) as gap from mv join md using (frame)),
t as (select frame, count(*) as n, case when count(*) > 30 then (any_value(med) + 4 * 1.4826 * list_sort(list(gap))[count(*) // 2 + 1]) ** 2 end as threshold from gp group by frame)
select frame, any_value(n) as n, round(any_value(threshold), 6) as threshold, count(*) filter (d * d > 6.25 * threshold) as n_large from t join mv using (frame) group by frame""",
)
def displacement_threshold(spark, d):
    return rounded(trees.displacement_threshold(trees.displacement(c.forest(spark, d))), "threshold")


@query("cut_sublineages", f"{TREE} select a.ancestor as top, a.id, case when a.id <> a.ancestor then n.parent end as parent, n.frame - t.frame as frame from anc a join nodes n on n.id = a.id join nodes t on t.id = a.ancestor join kids k on k.id = a.ancestor where k.n_children = 2 and n.frame < t.frame + 3")
def cut_sublineages(spark, d):
    f = c.forest(spark, d)
    return trees.cut_sublineages(f, trees.children_count(f).filter("n_children = 2").select("id"), 3).select("top", "id", "parent", "frame")


@query("evict", f"{TREE} select id, case when frame > 4 then parent end as parent, frame from nodes where frame >= 4")
def evict(spark, d):
    return trees.evict(c.forest(spark, d), 4).select("id", "parent", "frame")


@query("integrity", f"{TREE} select 'duplicate id' as rule, 0::bigint as n union all select 'more than two children', count(*) from (select 1 from nodes where parent is not null group by parent having count(*) > 2) union all select 'missing parent', 0 union all select 'parent not one frame before', count(*) from nodes n join nodes p on p.id = n.parent where n.frame <> p.frame + 1")
def integrity(spark, d):
    return trees.integrity(c.forest(spark, d))


@query("tree_cut", f"{TREE}, thr as (select a.ancestor as id, max(n.score) as thr from anc a join nodes n using (id) group by 1), leaf as (select id from kids where n_children = 0), w as (select a.id as leaf, a.ancestor, a.steps from anc a join leaf l on l.id = a.id join thr t on t.id = a.ancestor where t.thr <= 0.5 or a.id = a.ancestor) select leaf, arg_max(ancestor, steps) as node from w group by leaf")
def tree_cut(spark, d):
    f = c.forest(spark, d)
    thr = trees.subtree_totals(f.select("id", "parent", F.col("score").alias("thr")), tops=("thr",))
    return trees.cut_at(f.select("id", "parent").join(thr, "id"), 0.5)


@query("window_features", f"""{TREE}, ft as (select id, abs(x) as size, abs(y) as intensity from nodes), ch as (select n.id, k.n_children, (f.size - p.size) / nullif(p.size, 0) as cs, (f.intensity - p.intensity) / nullif(p.intensity, 0) as ci from nodes n join kids k using (id) join ft f using (id) left join ft p on p.id = n.parent)
select a.ancestor as id, count(*) as n_nodes, count(*) filter (n_children = 2) as n_divisions, round((max(steps) + 1) / 4, 6) as length_share, round(avg(case when steps > 0 then cs end), 4) as mean_size, round(avg(case when steps > 0 then ci end), 4) as mean_intensity from anc a join ch on ch.id = a.id where steps < 4 group by 1""")
def window_features(spark, d):
    f = c.forest(spark, d)
    own = f.select("id", F.abs("x").alias("size"), F.abs("y").alias("intensity"), F.lit(1.0).alias("compactness"), F.lit(1.0).alias("displacement2"), F.lit(1.0).alias("knn_ratio"))
    out = features.window_features(f, own, 4).select("id", "n_nodes", "n_divisions", "length_share", "mean_size", "mean_intensity")
    return rounded(rounded(out, "length_share"), "mean_size", "mean_intensity", places=4)


@query("background_score", f"{TREE}, s as (select id, score from nodes where id % 3 <> 0) select n.id, coalesce(s.score, p.score, -1) as score from nodes n left join s using (id) left join s p on p.id = n.parent")
def background_score(spark, d):
    f = c.forest(spark, d)
    return features.background_score(f, f.filter("id % 3 <> 0").select("id", "score"))


# graphs

EDGES = f"{c.POINTS}, edges as (select a.id as u, b.id as v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as weight from points a join points b on a.frame = b.frame and a.id < b.id where (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 0.01)"


def _edges(spark, d):
    p = c.points(spark, d)
    return spatial.range_join(p, p, 0.1).filter("a_id < b_id").select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), F.sqrt("d2").alias("weight"))


@query("components", f"with recursive {EDGES}, both_ways as (select u, v from edges union all select v, u from edges), reach(id, seen) as (select id, id from points union select r.id, b.v from reach r join both_ways b on b.u = r.seen) select id as node, min(seen) as component from reach group by id")
def components(spark, d):
    return graph.components(_edges(spark, d), c.points(spark, d).select(F.col("id").alias("node")))


@query("degrees", f"with {EDGES} select node, count(*) as degree from (select u as node from edges union all select v from edges) group by node")
def degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query("contract", f"with {EDGES} select least(u % 40, v % 40) as u, greatest(u % 40, v % 40) as v, round(max(weight), 6) as weight from edges where u % 40 <> v % 40 group by 1, 2")
def contract(spark, d):
    nodes = c.points(spark, d).select(F.col("id").alias("node"), (F.col("id") % 40).alias("into"))
    return rounded(graph.contract(_edges(spark, d), nodes), "weight")


@query("shortest_paths")
def shortest_paths(spark, d):
    return rounded(graph.shortest_paths(_edges(spark, d), _labelled(c.points(spark, d)).select(F.col("id").alias("node"))), "distance")


@query("assign")
def assign_frames(spark, d):
    p = c.points(spark, d)
    cand = spatial.knn_forward(p, 4, R).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.col("d2").alias("cost"))
    return rounded(assign.assign(cand, 0.02), "cost")


@query("assign_by_hand", "select src::bigint as src, dst::bigint as dst, cost::double as cost from (values (0, 1, 0.5), (1, null, 0.85), (2, 3, 0.8)) t(src, dst, cost)")
def assign_by_hand(spark, d):
    """Three sources and four destinations, whose optimum by trying all is 2.15."""
    cand = spark.createDataFrame([(0, 0, 0.7), (0, 1, 0.5), (1, 1, 0.8), (2, 2, 0.9), (2, 3, 0.8)], "src long, dst long, cost double")
    return assign.assign(cand, 0.85)


@query("extend_one_to_one", f"with {c.POINTS}, {_near(1)}, f as (select a_id as src, b_id as dst, d2 as cost from near where d2 <= 0.03 and a_id % 3 > 0 and b_id % 3 > 0), r as (select *, row_number() over (partition by src order by cost, dst) as a, row_number() over (partition by dst order by cost, src) as b from f) select src, dst, round(cost, 6) as cost from r where a = 1 and b = 1")
def extend_one_to_one(spark, d):
    p = c.points(spark, d)
    cand = spatial.range_join(p, p, R, frame_step=1).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.col("d2").alias("cost"))
    done = p.filter("id % 3 = 0").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return rounded(assign.extend_one_to_one(done, cand, 0.03), "cost")


@query("prune_hypotheses", f"""with {c.POINTS}, {_near(1)}, h as (select a_id as parent, b_id as child1, case when rank % 2 = 0 then b_id + 1 end as child2, d2 - 0.05 as cost from ranked where d2 < 0.05 and rank <= 12),
b as (select *, min(cost) over (partition by parent) as best, row_number() over (partition by parent, child2 is null order by cost, child1, child2) as turn from h), k as (select * from b where cost / best >= 0.25 and turn <= case when child2 is null then 5 else 3 end)
select parent, child1, child2, round(cost, 6) as cost, row_number() over (partition by parent order by cost, child1, child2)::int as rank from k""")
def prune_hypotheses(spark, d):
    n = spatial.knn_forward(c.points(spark, d), 12, R).filter("d2 < 0.05")
    e = n.select(F.col("a_id").alias("parent"), F.col("b_id").alias("child1"), F.when(F.col("rank") % 2 == 0, F.col("b_id") + 1).alias("child2"), (F.col("d2") - 0.05).alias("cost"))
    return rounded(assign.prune_hypotheses(e), "cost")


# segmentation


@query("watershed")
def watershed(spark, d):
    return segment.watershed(c.volume(spark, d), 60, 30, 6)


@query("dendrogram")
def dendrogram(spark, d):
    return segment.dendrogram(c.volume(spark, d), 60, 10, 6)


@query("region_adjacency", f"with {BRIGHT}, f as (select * from bright where frame = 1) select a.sv_id as u, b.sv_id as v, count(distinct (a.x, a.y, a.z)) as n_border from f a, off join f b on b.x = a.x + dx and b.y = a.y + dy and b.z = a.z + dz where a.sv_id < b.sv_id group by 1, 2")
def region_adjacency(spark, d):
    return segment.region_adjacency(c.volume(spark, d).filter("v > 120 and frame = 1").withColumn("label", F.col("sv_id")), 6)


# filters and thresholds


@query("sliding", f"with {c.TRACKS} select track, frame, round(avg(score) over w, 6) as mean, round(sum(score) over w, 4) as total, min(score) over w as least, max(score) over w as most from tracks window w as (partition by track order by frame range between 3 preceding and 3 following)")
def sliding(spark, d):
    out = filters.sliding(c.tracks(spark, d).withColumnRenamed("score", "v"), ["track"], "frame", 3).select("track", "frame", "mean", "total", "least", "most")
    return rounded(rounded(out, "mean"), "total", places=4)


@query("convolve", f"with {c.VOLUME} select frame, voxel_id, round((coalesce(0.25 * lag(v) over w, 0) + 0.5 * v + coalesce(0.25 * lead(v) over w, 0))::double, 6) as convolved from volume window w as (partition by frame, y, z order by x)")
def convolve(spark, d):
    v = c.volume(spark, d).withColumn("v", F.col("v").cast("double"))
    return rounded(filters.convolve(v, ["frame", "y", "z"], "x", [0.25, 0.5, 0.25]).select("frame", "voxel_id", "convolved"), "convolved")


@query("derivative", f"with {c.TRACKS} select track, frame, round((lead(score) over w - lag(score) over w) / 2, 6) as d1, round(lead(score) over w - 2 * score + lag(score) over w, 6) as d2 from tracks window w as (partition by track order by frame)")
def derivative(spark, d):
    return rounded(filters.derivative(c.tracks(spark, d).withColumnRenamed("score", "v"), ["track"], "frame").select("track", "frame", "d1", "d2"), "d1", "d2")


@query("median2d", f"with {c.VOLUME}, s as (select a.frame, a.z, a.x, a.y, coalesce(b.v, 0) as v from volume a cross join range(-2, 3) i(dx) cross join range(-2, 3) j(dy) left join volume b on b.frame = a.frame and b.z = a.z and b.x = a.x + dx and b.y = a.y + dy) select frame, z, x, y, list_sort(list(v))[13] as median from s group by all")
def median2d(spark, d):
    return filters.median2d(c.volume(spark, d), 2, ["frame", "z"])


def _quantities(spark, d):
    return c.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("v"), F.col("l_extendedprice").alias("price"))


HIST = "h as (select l_returnflag as flag, floor((l_extendedprice - 0) / 2500)::bigint as bin, count(*) as n from lineitem group by 1, 2)"


def _histogram(spark, d):
    return filters.histogram(_quantities(spark, d).withColumn("v", F.col("price")), 2500, 0, "flag")


@query("histogram", f"with {HIST} select * from h")
def histogram(spark, d):
    return _histogram(spark, d)


@query("entropy", f"with {HIST}, p as (select flag, n / sum(n) over (partition by flag) as p from h) select flag, round(-sum(p * log2(p)), 6) as entropy from p group by flag")
def entropy(spark, d):
    return rounded(filters.entropy(_histogram(spark, d), "flag"), "entropy")


@query("cross_entropy", f"with {HIST}, a as (select bin, n / sum(n) over () as p from h where flag = 'A'), b as (select bin, n / sum(n) over () as q from h where flag = 'N') select round(-sum(p * log2(q)), 6) as cross_entropy, round(sum(p * log2(p / q)), 6) as relative_entropy from a join b using (bin)")
def cross_entropy(spark, d):
    h = _histogram(spark, d)
    return rounded(filters.cross_entropy(h.filter("flag = 'A'").drop("flag"), h.filter("flag = 'N'").drop("flag")), "cross_entropy", "relative_entropy")


@query("percentile_value", f"with {HIST}, u as (select flag, bin, sum(n) over (partition by flag order by bin) as c, sum(n) over (partition by flag) as t from h) select flag, min(bin) as bin from u where c >= 0.9 * t group by flag")
def percentile_value(spark, d):
    return filters.percentile_value(_histogram(spark, d), 0.9, "flag")


@query("triangle_threshold", f"""with {HIST}, p as (select flag, max(n) as top, max_by(bin, (n, -bin)) as peak, max(bin) as last, arg_max(n, bin) as tail from h group by flag),
e as (select p.*, b.bin, coalesce(h.n, 0) as n from p, unnest(range(peak, last + 1)) b(bin) left join h on h.flag = p.flag and h.bin = b.bin where last > peak),
g as (select flag, bin, floor(top + (tail - top) * (bin - peak) / (last - peak)) - n as g from e) select flag, max_by(bin, (g, -bin)) + 1 as threshold from g group by flag""")
def triangle_threshold(spark, d):
    return filters.triangle_threshold(_histogram(spark, d), "flag")


@query(
    "intermeans_threshold",
    f"with recursive {HIST}, r(flag, t, step) as (select flag, floor((min(bin) + max(bin)) / 2.0)::bigint, 0 from h group by flag union all select r.flag, floor(((select sum(bin * n) / sum(n) from h where h.flag = r.flag and h.bin <= r.t) + (select sum(bin * n) / sum(n) from h where h.flag = r.flag and h.bin > r.t)) / 2.0)::bigint, step + 1 from r where step < 40) select flag, t as threshold from r where step = 40",
)
def intermeans_threshold(spark, d):
    return filters.intermeans_threshold(_histogram(spark, d), "flag")


@query("rescale", "with q as (select l_returnflag as flag, l_quantity as v from lineitem), s as (select flag, v, 10 * (v - min(v) over (partition by flag)) / (max(v) over (partition by flag) - min(v) over (partition by flag)) as scaled from q) select flag, v, round(scaled, 6) as scaled, count(*) as n from s group by all")
def rescale(spark, d):
    return rounded(filters.rescale(_quantities(spark, d).drop("price"), 0.0, 10.0, "flag"), "scaled").groupBy("flag", "v", "scaled").agg(F.count("*").alias("n"))


@query("down_sample", f"with {c.VOLUME} select (x // 4)::bigint as x, (y // 4)::bigint as y, (z // 4)::bigint as z, round(avg(v), 6) as v, count(*) as n from volume where frame = 0 group by 1, 2, 3")
def down_sample(spark, d):
    return rounded(filters.down_sample(c.volume(spark, d).filter("frame = 0"), 4), "v")


@query("pad_clip", f"with {c.VOLUME} select gx::int as x, gy::int as y, gz::int as z, coalesce(v, 0) as v from range(-1, 4) a(gx) cross join range(-1, 3) b(gy) cross join range(0, 2) e(gz) left join (select * from volume where frame = 0 and x between 0 and 2) on x = gx and y = gy and z = gz")
def pad_clip(spark, d):
    v = filters.clip(c.volume(spark, d).filter("frame = 0").select("x", "y", "z", "v"), (0, -9, -9), (2, 99, 99))
    return filters.pad(v, (-1, -1, 0), (3, 2, 1))


@query("matrix_product", "with a as (select n_nationkey as i, n_regionkey as j, n_nationkey::double as v from nation) select x.i, y.i as j, sum(x.v * y.v) as v from a x join a y on x.j = y.j group by 1, 2")
def matrix_product(spark, d):
    a = c.table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), F.col("n_nationkey").cast("double").alias("v"))
    return filters.matrix_product(a, a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


@query("array_operations", "select l_orderkey, l_linenumber, l_quantity + 2 as added, l_quantity ** 2 as squared, (l_partkey << 2) as shifted, (l_partkey >> 1) as halved, least(l_quantity, 10) as low, greatest(l_quantity, 40) as high, (l_quantity >= 25)::int as on_ from lineitem")
def array_operations(spark, d):
    t = c.table(spark, d, "lineitem")
    q, p, x = F.col("l_quantity"), F.col("l_partkey"), filters.combine
    return t.select("l_orderkey", "l_linenumber", x(q, "add", F.lit(2)).alias("added"), x(q, "pow", F.lit(2)).alias("squared"), x(p, "lsh", F.lit(2)).alias("shifted"), x(p, "rsh", F.lit(1)).alias("halved"), x(q, "min", F.lit(10.0)).alias("low"), x(q, "max", F.lit(40.0)).alias("high"), (q >= 25).cast("int").alias("on_"))


@query("correlation", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r, round(covar_samp(l_quantity, l_extendedprice), 2) as cov, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by l_returnflag")
def correlation(spark, d):
    q, p = "l_quantity", "l_extendedprice"
    return c.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr(q, p), 6).alias("r"), F.round(F.covar_samp(q, p), 2).alias("cov"), F.round(F.regr_slope(p, q), 4).alias("slope"), F.round(F.regr_intercept(p, q), 2).alias("intercept"), F.round(F.regr_r2(p, q), 6).alias("r2"))


# mixtures


def _mixture(spark, d, chosen=_labelled):
    p = c.points(spark, d)
    voxels = p.select("frame", F.col("id").alias("sv_id"), "x", "y", "z", (F.col("v") + 0.01).alias("v"))
    seeds = chosen(p).select("frame", F.col("id").alias("k"), F.lit(1.0).alias("alpha0"), F.lit(1.0).alias("beta0"), F.lit(4.0).alias("nu0"), F.array("x", "y", "z").alias("m0"), F.array(*[F.lit(v) for v in (10.0, 0.0, 0.0, 10.0, 0.0, 10.0)]).alias("w0"))
    gmm = seeds.select("frame", "k", F.col("alpha0").alias("alpha"), F.col("beta0").alias("beta"), F.col("nu0").alias("nu"), F.col("m0").alias("m"), F.col("w0").alias("w"), "alpha0", "beta0", "nu0", "m0", "w0")
    near = spatial.knn_join(p, chosen(p), 3, 1.2)
    cand = near.join(p.select(F.col("id").alias("a_id"), "frame"), "a_id").select("frame", F.col("a_id").alias("sv_id"), F.col("b_id").alias("k"))
    return voxels, gmm, cand


@query(
    "em_step",
    f"""with {c.POINTS}, s as (select * from points where id in (select min(id) from points group by frame, label)), dd as (select p.frame, p.id, s.id as k, (p.x - s.x) ** 2 + (p.y - s.y) ** 2 + (p.z - s.z) ** 2 as d2, row_number() over (partition by p.id order by (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) + (p.z - s.z) * (p.z - s.z), s.id) as rn from points p join s on s.frame = p.frame),
e as (select frame, id, k, exp(-20 * d2) as e from dd where rn <= 3 and d2 < 1.44), r as (select frame, id, k, e / sum(e) over (partition by id) as r from e),
m as (select r.frame, r.k, sum(r * (v + 0.01)) as n, sum(r * (v + 0.01) * x) as sx, sum(r * (v + 0.01) * x * x) as sxx from r join points p on p.id = r.id group by 1, 2)
select frame, k, round(n, 6) as n_k, round(1 + n, 6) as alpha, round(4 + n, 6) as nu, round((s.x + sx) / (1 + n), 6) as mx, round(0.1 + sxx - sx * sx / n + n / (1 + n) * (sx / n - s.x) ** 2, 6) as wxx_inv from m join s using (frame) where s.id = k""",
)
def em_step(spark, d):
    """All components have the same priors, so the constants of the E step cancel in the soft-max."""
    voxels, gmm, cand = _mixture(spark, d)
    m = mixture.m_step(mixture.region_moments(voxels), mixture.e_step(voxels, gmm, cand), gmm)
    out = m.select("frame", "k", "n_k", "alpha", "nu", F.col("m")[0].alias("mx"), geometry.inverse(F.col("w"))[0].alias("wxx_inv"))
    return rounded(out, "n_k", "alpha", "nu", "mx", "wxx_inv")


@query("log_likelihood", f"""with {c.POINTS}, s as (select * from points where id in (select min(id) from points group by frame, label)), dd as (select p.frame, p.id, p.v, (p.x - s.x) ** 2 + (p.y - s.y) ** 2 + (p.z - s.z) ** 2 as d2, row_number() over (partition by p.id order by (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) + (p.z - s.z) * (p.z - s.z), s.id) as rn from points p join s on s.frame = p.frame),
k as (select frame, count(*) as k from s group by frame), q as (select frame, id, any_value(v) + 0.01 as v, sum(exp(-20 * d2)) / any_value(k) * sqrt(64000.0) * (2 * pi()) ** -1.5 as p from dd join k using (frame) where rn <= 3 and d2 < 1.44 group by frame, id) select frame, round(sum(v * ln(p)), 4) as ll from q group by frame""")
def log_likelihood(spark, d):
    return rounded(mixture.log_likelihood(*_mixture(spark, d)), "ll", places=4)


@query("mixture_fit")
def mixture_fit(spark, d):
    voxels, gmm, _ = _mixture(spark, d)
    f = mixture.fit(voxels, gmm.drop("alpha", "beta", "nu", "m", "w"), nearest=3, iterations=20)
    return mixture.strongest(f.select("frame", "sv_id", "k", "r"), 0.3)


@query(
    "kalman",
    f"""with recursive {c.TRACKS}, k(track, frame, p, s, a, b, e) as (select track, frame, score, 0.0::double, 4.0::double, 0.0::double, 1.0::double from tracks where frame = 0
union all select t.track, t.frame, k.p + k.s + (k.a + 2 * k.b + k.e + 0.25) / (k.a + 2 * k.b + k.e + 4.25) * (t.score - k.p - k.s), k.s + (k.b + k.e + 0.5) / (k.a + 2 * k.b + k.e + 4.25) * (t.score - k.p - k.s),
  4 * (k.a + 2 * k.b + k.e + 0.25) / (k.a + 2 * k.b + k.e + 4.25), 4 * (k.b + k.e + 0.5) / (k.a + 2 * k.b + k.e + 4.25), k.e + 1 - (k.b + k.e + 0.5) ** 2 / (k.a + 2 * k.b + k.e + 4.25) from k join tracks t on t.track = k.track and t.frame = k.frame + 1)
select track, frame, round(p, 6) as x, round(2 * p, 6) as y from k""",
)
def kalman(spark, d):
    t = c.tracks(spark, d).select("track", "frame", F.col("score").alias("x"), (F.col("score") * 2).alias("y"), F.lit(0.0).alias("z"))
    k = mixture.kalman(t, 1.0, 4.0)
    return rounded(k.select("track", "frame", F.col("filtered")[0].alias("x"), F.col("filtered")[1].alias("y")), "x", "y")


# learning


def _samples(spark, d):
    docs = c.table(spark, d, "documents").select("doc_id", F.length("text").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words"), F.size(F.split("text", "\n")).cast("double").alias("lines"))
    return c.table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("y"), "chars", "words", "lines")


SAMPLES = "samples as (select l.doc_id, case when quality = 1 then 1.0 else -1.0 end as y, length(text)::double as chars, len(string_split(text, ' '))::double as words, len(string_split(text, chr(10)))::double as lines from labels l join documents using (doc_id))"


@query(
    "best_stumps",
    f"""with {SAMPLES}, l as (select y, unnest([struct_pack(feature := 'chars', x := chars), struct_pack(feature := 'words', x := words), struct_pack(feature := 'lines', x := lines)], recursive := true) from samples),
b as (select feature, x, count(*) as w, sum(y) as s, sum(y * y) as q from l group by 1, 2), u as (select feature, x, lead(x) over o as nx, sum(w) over o as w0, sum(s) over o as s0, sum(w) over (partition by feature) as wt, sum(s) over (partition by feature) as st, sum(q) over (partition by feature) as qt from b window o as (partition by feature order by x)),
r as (select feature, (x + nx) / 2 as th, (st - s0) / (wt - w0) as a, s0 / w0 as b, round(qt - s0 * s0 / w0 - (st - s0) * (st - s0) / (wt - w0), 9) as loss from u where nx is not null)
select feature, arg_min(th, (loss, th)) as th, round(arg_min(a, (loss, th)), 6) as a, round(arg_min(b, (loss, th)), 6) as b, round(min(loss), 6) as loss from r group by feature""",
)
def best_stumps(spark, d):
    return rounded(features.best_stumps(_samples(spark, d).withColumn("w", F.lit(1.0)), ["chars", "words", "lines"]), "a", "b", "loss")


TREES_OF_STUMPS = [(0, 0, 0, 2000.0, 0.0, 1, 2), (0, 1, -1, 0.0, 0.5, -1, -1), (0, 2, 1, 100.0, 0.0, 3, 4), (0, 3, -1, 0.0, 0.25, -1, -1), (0, 4, -1, 0.0, -0.75, -1, -1), (1, 0, 2, 10.0, 0.0, 1, 2), (1, 1, -1, 0.0, 0.125, -1, -1), (1, 2, -1, 0.0, -0.5, -1, -1)]
SCORE = "case when chars > 2000 then 0.5 when words > 100 then 0.25 else -0.75 end + case when lines > 10 then 0.125 else -0.5 end"


@query("boosting_score", f"with {SAMPLES} select doc_id, ({SCORE})::double as score from samples")
def boosting_score(spark, d):
    s = _samples(spark, d).withColumn("features", F.array("chars", "words", "lines"))
    return features.boosting_score(s, TREES_OF_STUMPS).select("doc_id", "score")


@query("precision_recall", f"""with {SAMPLES}, s as (select y, ({SCORE})::double as score from samples), t as (select min(score) as lo, max(score) as hi from s), th as (select lo + b * 0.3 as threshold, lo, b from t, unnest(range(0, floor((hi - lo) / 0.3)::bigint + 1)) u(b)),
k as (select threshold, count(*) filter (y > 0 and floor((score - lo) / 0.3) >= b) as tp, count(*) filter (y < 0 and floor((score - lo) / 0.3) >= b) as fp, count(*) filter (y > 0 and floor((score - lo) / 0.3) < b) as fn, count(*) filter (y < 0 and floor((score - lo) / 0.3) < b) as tn from th cross join s group by threshold)
select round(threshold, 6) as threshold, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, tp, fp, fn, tn from k""")
def precision_recall(spark, d):
    s = features.boosting_score(_samples(spark, d).withColumn("features", F.array("chars", "words", "lines")), TREES_OF_STUMPS)
    return rounded(features.precision_recall(s), "threshold", "precision", "recall", "accuracy")


@query("gentle_boost")
def gentle_boost(spark, d):
    s = _samples(spark, d)
    names = ["chars", "words", "lines"]
    model = features.gentle_boost(s, names, 5)
    scored = features.boosting_score(s.withColumn("features", F.array(*names)), model)
    return rounded(features.calibrated(scored, features.platt(scored)).select("doc_id", "score", "probability"), "score", "probability", places=4)


_PER = 12 // features.RINGS


@query(
    "combined_features",
    f"""with e as (select vec_id, list_transform(embedding[1:12], lambda v: v::double) as cl, list_transform(embedding[13:15], lambda v: v::double) as ec from embeddings), r as (select *, list_transform(range({features.RINGS}), lambda i: list_sum(cl[i * {_PER} + 1:(i + 1) * {_PER}]) / {_PER}) as rg, list_transform(range(11), lambda i: cl[i + 1] + cl[i + 2]) as tw from e)
select vec_id, {3 + 12 + features.RINGS + features.RINGS * (features.RINGS - 1) // 2 + 66 + 55}::bigint as n, round(list_sum(ec) + list_sum(cl) + list_sum(rg) + list_sum(list_transform(range({features.RINGS}), lambda i: rg[i + 1] * ({features.RINGS} - 1 - 2 * i))) + list_sum(list_transform(range(12), lambda i: cl[i + 1] * (11 - 2 * i))) + list_sum(list_transform(range(11), lambda i: tw[i + 1] * (10 - 2 * i))), 6) as total from r""",
)
def combined_features(spark, d):
    e = c.table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("cells"), F.transform(F.slice("embedding", 13, 3), lambda x: x.cast("double")).alias("eccentricity"))
    f = features.combined_features(e)
    return rounded(f.select("vec_id", F.size("features").cast("long").alias("n"), F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


@query(
    "direction_cells",
    f"""with {c.POINTS}, d as (select id, z / sqrt(x * x + y * y + z * z) as c, case when atan2(y, x) < 0 then atan2(y, x) + 2 * pi() else atan2(y, x) end / (pi() / 2) as turn from points), b as (select *, floor(2 * (0.5 + turn - 0.75 * c))::bigint as jp, floor(2 * (0.5 + turn + 0.75 * c))::bigint as jm, least(3, floor(turn))::bigint as quarter, 2 * sqrt(3 * greatest(0, 1 - abs(c))) as t from d),
f as (select *, jp // 2 as fp, jm // 2 as fm, least(1, floor((turn - quarter) * t))::bigint as a, least(1, floor((1 - turn + quarter) * t))::bigint as bb from b),
g as (select case when abs(c) <= 2 / 3 then case when fp = fm then (fp & 3) + 4 when fp < fm then fp & 3 else (fm & 3) + 8 end when c >= 0 then quarter else quarter + 8 end as face, case when abs(c) <= 2 / 3 then jm % 2 when c >= 0 then 1 - bb else a end as u, case when abs(c) <= 2 / 3 then 1 - jp % 2 when c >= 0 then 1 - a else bb end as v from f)
select (face * 4 + (u & 1) + 2 * (v & 1))::bigint as cell, count(*) as n from g group by 1""",
)
def direction_cells(spark, d):
    return features.direction_cells(c.points(spark, d), 2).groupBy("cell").agg(F.count("*").alias("n"))


# sequences


@query("smooth_window", f"with {c.TRACKS} select track, frame, score, round(avg(score) over w, 6) as smooth, count(*) over w as n_window from tracks window w as (partition by track order by frame range between 2 preceding and 2 following)")
def smooth_window(spark, d):
    return rounded(tracker.smooth_batch(c.tracks(spark, d), 2), "smooth")


@query("tumbling_counts", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def tumbling_counts(spark, d):
    return rounded(tracker.divisions_by_window(c.table(spark, d, "events"), "1 hour", "10 minutes"), "mean")


@query("numbered_paths", "select event_id, '/data/TM' || case when length(event_id::varchar) >= 5 then event_id::varchar else lpad(event_id::varchar, 5, '0') end || '/ch_' || case when length(event_id::varchar) >= 2 then event_id::varchar else lpad(event_id::varchar, 2, '0') end || '.tif' as path from events")
def numbered_paths(spark, d):
    return c.table(spark, d, "events").select("event_id", numbered_path_column("/data/TM?????/ch_??.tif", F.col("event_id")).alias("path"))


@query("quantiles", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(median(l_extendedprice), 4) as q50, round(quantile_cont(l_extendedprice, 0.95), 4) as q95 from lineitem group by l_returnflag")
def quantiles(spark, d):
    p = F.col("l_extendedprice")
    return rounded(c.table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.percentile(p, q).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.95, "q95"))]), "q25", "q50", "q95", places=4)


@query("top_edges", f"with {c.POINTS}, {_near(1)} select a_id, b_id, round(d2, 6) as d2, rank::int as rank from ranked where rank <= 2 and d2 < 0.01")
def top_edges(spark, d):
    return rounded(spatial.knn_forward(c.points(spark, d), 2, R).filter("d2 < 0.01"), "d2")


@query("intern", "select event_type, dense_rank() over (order by event_type)::int - 1 as code from (select distinct event_type from events)")
def intern(spark, d):
    """Strings to numbers: the distinct strings only are ordered."""
    kinds = c.table(spark, d, "events").select("event_type").distinct()
    return kinds.select("event_type", (F.dense_rank().over(Window.orderBy("event_type")) - 1).alias("code"))
