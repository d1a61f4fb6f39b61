"""Queries that write the test tables as files of each format to the shared folder and read them again, beside SQL over the tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.operators import filters
from tracelet.operators import regions as rg
from tracelet.plans import carriers as c
from tracelet.plans.catalog import query
from tracelet.plans.durable import shared_folder
from tracelet.sources import binary, config, gmm_xml, tiff


def _place(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


REGIONS = """v as (select distinct l_suppkey % 3 as frame, l_suppkey as key, l_partkey as voxel from lineitem), r as (select frame, key, count(*) as n, list_sort(list(voxel)) as voxels from v group by 1, 2)"""


def _regions(spark, d) -> DataFrame:
    v = c.table(spark, d, "lineitem").select((F.col("l_suppkey") % 3).cast("int").alias("frame"), F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("voxel")).distinct()
    return v.groupBy("frame", "key").agg(F.array_sort(F.collect_list("voxel")).alias("voxels"))


@query("region_files", f"with {REGIONS} select frame::int as frame, (row_number() over (partition by frame order by key) - 1)::int as sv_id, n, voxels from r")
def region_files(spark, d):
    """A file of regions for each frame."""
    at = _place(spark)
    one = _regions(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("key", "voxels"))).alias("regions"))
    binary.write_files(one, at, lambda row: binary.write_regions([(row["frame"], 2, (9, 8, 7), r["voxels"]) for r in row["regions"]]))
    return binary.read_regions(spark, f"{at}/*").select("frame", "sv_id", "n", "voxels")


@query("label_regions", f"with {REGIONS} select key as sv_id, n, voxels from r where key > 0")
def label_regions(spark, d):
    """From a label image, whose voxels are numbered by region and place; labels without voxels give empty regions."""
    v = _regions(spark, d).select(F.col("key").alias("label"), F.explode("voxels").alias("voxel_id"))
    return rg.regions_of_labels(v).select("sv_id", F.size("voxels").cast("long").alias("n"), F.array_sort("voxels").alias("voxels")).filter("n > 0")


@query("sorted_regions", f"with {REGIONS} select key as sv_id, true as up, n < 2 as down from r")
def sorted_regions(spark, d):
    return _regions(spark, d).select(F.col("key").alias("sv_id"), rg.is_sorted(F.col("voxels")).alias("up"), rg.is_sorted(F.reverse("voxels")).alias("down"))


@query("dendrogram_files", "select (vec_id % 10)::int as frame, (vec_id // 10)::int as node, case when vec_id >= 10 then ((vec_id // 10 + 1) // 2 - 1)::int end as parent, label::double as thr, case when label < 5 then label::int end as region from embeddings")
def dendrogram_files(spark, d):
    """A segmentation file for each frame, without regions: a heap of nodes."""
    at = _place(spark)
    k = F.floor(F.col("vec_id") / 10)
    nodes = c.table(spark, d, "embeddings").select((F.col("vec_id") % 10).cast("int").alias("frame"), F.struct(k.cast("int").alias("node"), F.when(k > 0, F.floor((k + 1) / 2) - 1).cast("int").alias("parent"), F.col("label").cast("double").alias("thr"), F.when(F.col("label") < 5, F.col("label")).cast("int").alias("region")).alias("n"))
    one = nodes.groupBy("frame").agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    binary.write_files(one, at, lambda row: binary.write_segmentation([], [(n["node"], n["parent"], n["thr"], n["region"]) for n in row["nodes"]]))
    frame = F.regexp_extract("path", r"frame=(\d+)", 1).cast("int")
    return binary.read_dendrograms(spark, f"{at}/*").select(frame.alias("frame"), "node", "parent", "thr", "region")


POINT = "select (vec_id % 10)::int as frame, vec_id::double as id, label::double as kind, embedding[1]::float::double as x, embedding[2]::float::double as y, embedding[3]::float::double as z, 1.5::double as radius, case when vec_id >= 10 then (vec_id - 10)::double end as parent, 3.0::double as confidence from embeddings"


@query("lineage_files", POINT)
def lineage_files(spark, d):
    at, e = _place(spark), F.col("embedding")
    rows = c.table(spark, d, "embeddings").select((F.col("vec_id") % 10).cast("int").alias("frame"), F.col("vec_id").cast("double").alias("id"), F.col("label").cast("double").alias("kind"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")], F.lit(1.5).alias("radius"), F.when(F.col("vec_id") >= 10, F.col("vec_id") - 10).cast("double").alias("parent"), F.lit(3.0).alias("confidence"))
    one = rows.groupBy(F.lit(0).alias("run")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    binary.write_files(one, at, lambda row: binary.write_lineages([tuple(r.values()) for r in row["rows"]]))
    return binary.read_lineages(spark, f"{at}/*").drop("path")


@query("responsibility_files", "select (vec_id % 3)::int as slot, (vec_id // 3)::int as label, (label / 16)::double as r, label::int as component from embeddings where vec_id // 3 < (select count(*) // 3 from embeddings)")
def responsibility_files(spark, d):
    """Three slots for each label, in one file."""
    at = _place(spark)
    rows = c.table(spark, d, "embeddings").select("vec_id", "label")
    one = rows.groupBy(F.lit(0).alias("run")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "label"))).alias("rows"))

    def encoded(row):
        labels = np.array([r["label"] for r in row["rows"]])
        square = labels[: len(labels) // 3 * 3].reshape(-1, 3).T
        return binary.write_responsibilities(square / 16, square)

    binary.write_files(one, at, encoded)
    return binary.read_responsibilities(spark, f"{at}/*").drop("path")


@query("training_files", "select list_transform(embedding[1:4], lambda v: v::double) as features, case when label < 5 then 1 else -1 end::double as y, count(*) as n from embeddings group by 1, 2")
def training_files(spark, d):
    """A training file for each remainder of the ids."""
    at = _place(spark)
    rows = c.table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("part"), F.slice("embedding", 1, 4).alias("x"), F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"))
    one = rows.groupBy("part").agg(F.collect_list(F.struct("x", "y")).alias("rows"))
    binary.write_files(one, at, lambda row: binary.write_training(np.array([r["x"] for r in row["rows"]]), np.array([r["y"] for r in row["rows"]])))
    return binary.read_training(spark, f"{at}/*").groupBy("features", "y").agg(F.count("*").alias("n"))


@query("swc_files", "select vec_id::int as id, label::int as kind, round(embedding[1]::double, 3) as x, round(embedding[2]::double, 3) as y, round(embedding[3]::double, 3) as z, 1.5::double as r, case when vec_id > 0 then (vec_id // 2)::int end as parent from embeddings")
def swc_files(spark, d):
    at, e = _place(spark), F.col("embedding")
    parts = [F.col("vec_id"), F.col("label"), *[F.round(e[i].cast("double"), 3) for i in range(3)], F.lit(1.5), F.when(F.col("vec_id") > 0, F.floor(F.col("vec_id") / 2)).otherwise(-1)]
    lines = c.table(spark, d, "embeddings").select(F.concat_ws(" ", *[p.cast("string") for p in parts]).alias("value"))
    lines.unionByName(spark.createDataFrame([("# id kind x y z r parent",)], "value string")).write.text(at)
    return binary.read_swc(spark, f"{at}/*.txt").drop("path")


GMM = "select vec_id as id, label::bigint as lineage, case when vec_id >= 10 then vec_id - 10 end as parent, 3 as dims, case when vec_id % 2 = 0 then embedding[1]::double end as splitScore, list_transform(embedding[1:3], lambda v: v::double) as m, case when vec_id % 3 > 0 then [label::int, 7] end as svIdx from embeddings"


@query("gmm_files", GMM)
def gmm_files(spark, d):
    at, e, i = _place(spark), F.col("embedding"), F.col("vec_id")
    rows = c.table(spark, d, "embeddings").select(i.alias("id"), F.col("label").cast("long").alias("lineage"), F.when(i >= 10, i - 10).alias("parent"), F.lit(3).alias("dims"), F.when(i % 2 == 0, e[0].cast("double")).alias("splitScore"), F.transform(F.slice(e, 1, 3), lambda v: v.cast("double")).alias("m"), F.when(i % 3 > 0, F.array(F.col("label").cast("int"), F.lit(7))).alias("svIdx"))
    gmm_xml.write_gmm(rows, at)
    return gmm_xml.read_gmm(spark, at).select("id", "lineage", "parent", "dims", "splitScore", "m", "svIdx")


@query("annotation_files", "select list_transform(embedding[1:3], lambda v: v::double) as mu, 'TM' || (vec_id % 10) || '.tif' as img_filename, case when label < 5 then 'yes' else 'no' end as class_name, (label < 5)::int as class_val, [label::int] as sv_idx from embeddings")
def annotation_files(spark, d):
    at, e = _place(spark), F.col("embedding")
    rows = c.table(spark, d, "embeddings").select(
        F.transform(F.slice(e, 1, 3), lambda v: v.cast("double")).alias("mu"), F.array(*[F.lit(float(i)) for i in range(6)]).alias("W"), F.concat(F.lit("TM"), F.col("vec_id") % 10, F.lit(".tif")).alias("img_filename"),
        F.when(F.col("label") < 5, "yes").otherwise("no").alias("class_name"), (F.col("label") < 5).cast("int").alias("class_val"), F.lit("a.svb").alias("sv_filename"), F.array(F.col("label").cast("int")).alias("sv_idx"),
    )
    gmm_xml.write_annotations(rows, at)
    return gmm_xml.read_annotations(spark, at).select("mu", "img_filename", "class_name", "class_val", "sv_idx")


STACK = f"with {c.VOLUME} select frame, z, y, x, v::double as v from volume"


@query("picture_series", STACK)
def picture_series(spark, d):
    """A stack of pages for each frame, in files numbered by frame."""
    at = _place(spark)
    tiff.write_series(c.volume(spark, d), at, "TM???.tif")
    read = tiff.read_voxels(spark, f"{at}/*")
    return read.select(config.frame_of_path("TM???.tif", F.col("path")).alias("frame"), "z", "y", "x", "v")


@query("picture_values", f"with {c.VOLUME} select v, case when v % 2 = 0 then v // 2 end as mapped, (v >= 100)::int as on, count(*) as n from volume group by 1, 2, 3")
def picture_values(spark, d):
    """Values through a lookup table, and over a threshold."""
    v = c.volume(spark, d)
    table = v.select("v").distinct().filter("v % 2 = 0").select("v", F.floor(F.col("v") / 2).alias("to"))
    out = filters.apply_map(filters.threshold(v, 100).withColumn("was", F.col("v")), table)
    return out.groupBy(F.col("was").alias("v"), F.col("v").alias("mapped"), "on").agg(F.count("*").alias("n"))


OPTIONS = "# run\nimgFilePattern=/a/TM???.tif\ndebugPathPrefix=/out\nbackgroundThreshold=200\nmaxIterEM = 7 # few\nnonsense line\na=b=c\n"


@query("options_text", "select * from (values ('imgFilePattern', '/a/TM???.tif'), ('backgroundThreshold', '200.0'), ('maxIterEM', '7'), ('KmaxNumNNsupervoxel', '10'), ('persistanceSegmentationTau', '14.0')) t(name, value)")
def options_text(spark, d):
    """Options of a text in the shared folder."""
    at = _place(spark)
    spark.createDataFrame([(OPTIONS,)], "value string").coalesce(1).write.text(at)
    o = config.read_options(spark, at)
    return spark.createDataFrame([(k, str(getattr(o, k))) for k in ("imgFilePattern", "backgroundThreshold", "maxIterEM", "KmaxNumNNsupervoxel", "persistanceSegmentationTau")], "name string, value string")
