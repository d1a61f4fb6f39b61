"""The test tables seen as points, forests, tracks, regions and a small volume: DataFrames, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelet.operators import trees


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten frames of points in space with a weight."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10).alias("frame"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], F.abs(e[3].cast("double")).alias("v"), "label")


POINTS = """points as (
  select vec_id as id, vec_id % 10 as frame, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, abs(embedding[4]::double) as v, label from embeddings
)"""


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heap-ordered binary trees, broken where some nodes are left out."""
    e = F.col("embedding")
    id_ = F.col("vec_id") + 1
    rows = table(spark, sf_dir, "embeddings").filter("label % 5 <> 3").select(
        id_.alias("id"), F.floor(id_ / 2).alias("parent"), (F.length(F.bin(id_)) - 1).cast("long").alias("frame"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], F.round(F.abs(e[3].cast("double")) * 3, 6).alias("score")
    )
    return trees.repaired(rows)


FOREST = """kept as (
  select vec_id + 1 as id, (vec_id + 1) // 2 as up, length(bin(vec_id + 1)) - 1 as frame, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z,
    round(abs(embedding[4]::double) * 3, 6) as score
  from embeddings where label % 5 <> 3
), nodes as (
  select k.id, p.id as parent, k.frame, k.x, k.y, k.z, k.score from kept k left join kept p on p.id = k.up
), kids as (
  select n.id, count(c.id) as n_children from nodes n left join nodes c on c.parent = n.id group by n.id
), anc(id, ancestor, steps) as (
  select id, id, 0 from nodes union all select a.id, n.parent, a.steps + 1 from anc a join nodes n on n.id = a.ancestor where n.parent is not null
)"""

BRANCHES = """heads as (
  select n.id, case when k.n_children = 1 then n.parent end as up from nodes n left join kids k on k.id = n.parent
), walk(id, head, steps) as (
  select id, id, 0 from heads union all select w.id, h.up, w.steps + 1 from walk w join heads h on h.id = w.head where h.up is not null
), branched as (
  select n.*, k.n_children, w.head as branch, w.steps as place from nodes n join kids k using (id)
  join (select id, arg_max(head, steps) as head, max(steps) as steps from walk group by id) w using (id)
), summary as (
  select branch, count(*) as length, arg_min(parent, place) as parent0, arg_max(id, place) as last_id, max(frame) as last_frame,
    case when arg_max(n_children, place) = 0 then 'death' else 'division' end as ends
  from branched group by branch
), tops as (
  select s.*, n.parent from summary s join nodes n on n.id = s.branch
), pairs as (
  select p.parent as id, n.frame, l.branch as l_branch, l.length as l_length, l.ends as l_ends, l.last_frame as l_last_frame,
    r.branch as r_branch, r.length as r_length, r.ends as r_ends, r.last_frame as r_last_frame
  from (select parent, min(branch) as l, max(branch) as r from tops where parent is not null group by parent having min(branch) <> max(branch)) p
  join tops l on l.branch = p.l join tops r on r.branch = p.r join nodes n on n.id = p.parent
)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in time order."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("value").alias("score"))


TRACKS = """tracks as (
  select user_id as track, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value as score from events
)"""


def regions(spark: SparkSession, sf_dir: str, line: int | None = None) -> DataFrame:
    """Suppliers as sets of parts: all lines, or those whose number is odd (1) or even (2)."""
    rows = table(spark, sf_dir, "lineitem")
    if line is not None:
        rows = rows.filter(F.col("l_linenumber") % 2 == line % 2)
    return rows.select(F.col("l_suppkey").alias("sv_id"), F.col("l_partkey").alias("voxel_id")).distinct()


def region_sql(name: str, line: int | None) -> str:
    return f"{name} as (select distinct l_suppkey as sv_id, l_partkey as voxel_id from lineitem" + (f" where l_linenumber % 2 = {line % 2}" if line is not None else "") + ")"


DX, DY, DZ = 24, 18, 4
VECTORS_A_FRAME = 250


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures: hills of whole numbers, cut into blocks sv_id, in a frame for every VECTORS_A_FRAME embeddings."""
    n = DX * DY * DZ
    i = F.col("voxel_id")
    frames = max(2, table(spark, sf_dir, "embeddings").count() // VECTORS_A_FRAME)
    g = spark.range(frames * n).select((F.col("id") / n).cast("int").alias("frame"), (F.col("id") % n).alias("voxel_id"))
    g = g.select("frame", "voxel_id", (i % DX).cast("int").alias("x"), ((i / DX).cast("int") % DY).cast("int").alias("y"), (i / (DX * DY)).cast("int").alias("z"))
    v = 40 * F.abs((F.col("x") + 3 * F.col("frame")) % 12 - 6) + 25 * F.abs(F.col("y") % 10 - 5) + 10 * F.col("z") + (F.col("x") * 7 + F.col("y") * 5 + F.col("z") * 3) % 11
    return g.select("*", v.cast("long").alias("v"), ((F.col("x") / 7).cast("int") + 4 * (F.col("y") / 5).cast("int") + 16 * F.col("frame")).alias("sv_id"))


VOLUME = f"""grid as (
  select (i // {DX * DY * DZ})::int as frame, i % {DX * DY * DZ} as voxel_id, (i % {DX})::int as x, ((i // {DX}) % {DY})::int as y, ((i % {DX * DY * DZ}) // {DX * DY})::int as z from (select unnest(range((select greatest(2, count(*) // {VECTORS_A_FRAME}) from embeddings) * {DX * DY * DZ})) as i)
), volume as (
  select *, (40 * abs((x + 3 * frame) % 12 - 6) + 25 * abs(y % 10 - 5) + 10 * z + (x * 7 + y * 5 + z * 3) % 11)::bigint as v, x // 7 + 4 * (y // 5) + 16 * frame as sv_id from grid
)"""
