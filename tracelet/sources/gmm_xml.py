"""Mixture components as XML: one element a component, numbers as attribute lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW, ROOT = "GaussianMixtureModel", "document"
SCALARS = {"id": "long", "lineage": "long", "parent": "long", "dims": "int", "splitScore": "double", "nu": "double", "beta": "double", "alpha": "double", "nuPrior": "double", "betaPrior": "double", "alphaPrior": "double", "distMRFPrior": "double"}
ARRAYS = {"scale": "double", "m": "double", "W": "double", "mPrior": "double", "WPrior": "double", "svIdx": "int"}
NAMES = [*SCALARS, *ARRAYS]


def _array(c: Column, kind: str) -> Column:
    return F.when(c.isNotNull(), F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""), lambda x: x.cast(kind)))


def read_gmm(spark: SparkSession, path: str) -> DataFrame:
    """Components of the documents; a negative parent is null; splitScore and svIdx may be missing."""
    schema = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in NAMES])
    raw = spark.read.format("xml").option("rowTag", ROW).schema(schema).load(path)
    out = raw.select(*[F.col(f"_{n}").cast(k).alias(n) for n, k in SCALARS.items()], *[_array(F.col(f"_{n}"), k).alias(n) for n, k in ARRAYS.items()], F.col("_metadata.file_path").alias("path"))
    return out.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))


def write_gmm(components: DataFrame, path: str) -> None:
    """A null parent is written as -1; other nulls are left out."""
    have = set(components.columns)
    attributes = [F.coalesce(F.col(n), F.lit(-1)).cast("string").alias(f"_{n}") if n == "parent" else F.col(n).cast("string").alias(f"_{n}") for n in SCALARS if n in have]
    attributes += [F.array_join(F.transform(n, lambda x: x.cast("string")), " ").alias(f"_{n}") for n in ARRAYS if n in have]
    components.select(*attributes).write.format("xml").option("rootTag", ROOT).option("rowTag", ROW).save(path)


SURFACE, SURFACES = "Surface", "document"
SURFACE_TEXTS = {"imgFilename": "img_filename", "className": "class_name", "svFilename": "sv_filename"}


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(mu, W, img_filename, class_name, class_val, sv_filename, sv_idx) of annotated ellipsoids: an element each, whose covarianceMatrix holds the centre and the packed matrix."""
    names = ["covarianceMatrix", *SURFACE_TEXTS, "class", "svIdx"]
    raw = spark.read.format("xml").option("rowTag", SURFACE).schema(T.StructType([T.StructField(f"_{n}", T.StringType()) for n in names])).load(path)
    numbers = _array(F.col("_covarianceMatrix"), "double")
    return raw.select(F.slice(numbers, 1, 3).alias("mu"), F.slice(numbers, 4, 6).alias("W"), *[F.col(f"_{n}").alias(to) for n, to in SURFACE_TEXTS.items()], F.col("_class").cast("int").alias("class_val"), _array(F.col("_svIdx"), "int").alias("sv_idx"))


def write_annotations(annotations: DataFrame, path: str) -> None:
    joined = [F.array_join(F.transform(x, lambda v: v.cast("string")), " ") for x in (F.concat("mu", "W"), F.col("sv_idx"))]
    attributes = [joined[0].alias("_covarianceMatrix"), *[F.col(c).alias(f"_{n}") for n, c in SURFACE_TEXTS.items()], F.col("class_val").cast("string").alias("_class"), joined[1].alias("_svIdx")]
    annotations.select(*attributes).write.format("xml").option("rootTag", SURFACES).option("rowTag", SURFACE).save(path)
