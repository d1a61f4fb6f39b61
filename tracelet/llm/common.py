"""What the corpus operators share: table reading, the fold rule, salted lookups."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelet.functions.salts import explode_salts, salt_bits, salt_of  # noqa: F401
from tracelet.operators import graph
from tracelet.plans.durable import shared_folder

FOLDS = 5
BATCH_ROWS, ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Texts are long: where the session leaves Spark's default, Arrow batches are kept to ROWS_A_BATCH rows, for both sides hold a batch whole."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(ROWS_A_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


KEPT: dict = {}  # what a worker keeps from task to task of one operator


def frugal(run: Callable, keep: bool = False) -> Callable:
    """run, a function over a task's batches, such that its worker gives freed memory back when the task ends; workers are kept from stage to stage. Unless told to keep it, the task first drops what another operator has kept."""

    def task(batches):
        if not keep:
            KEPT.clear()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return task


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """Narrow: make() runs once in a task, and its result on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(frugal(run), schema)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that no later loss of an executor reaches behind it. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a long, b long): root is the least node that links reach."""
    return graph.roots(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), cut)
