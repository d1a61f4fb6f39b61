"""Binary and text artefacts of tracking runs: parsers of bytes, and readers that list files with Spark.

All are little-endian. Readers go through Spark's binaryFile source, so any
store that Spark reads will do; a file is one task's work.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

REGION = "frame int, sv_id int, dims array<long>, n long, voxels array<long>"
NODE = "node int, parent int, thr double, region int"
TRACK_POINT = "frame int, id double, kind double, x double, y double, z double, radius double, parent double, confidence double"


def _read_region(data: bytes, at: int) -> tuple[tuple, int]:
    frame, size = struct.unpack_from("<iQ", data, at)
    dims = struct.unpack_from("<3Q", data, at + 12)
    (n,) = struct.unpack_from("<I", data, at + 36)
    voxels = np.frombuffer(data, "<u8", n, at + 40).tolist()
    return (frame, size, dims, voxels), at + 40 + 8 * n


def write_region(frame: int, size: int, dims: tuple[int, int, int], voxels) -> bytes:
    return struct.pack("<iQ3QI", frame, size, *dims, len(voxels)) + np.asarray(voxels, "<u8").tobytes()


def parse_regions(data: bytes) -> Iterator[tuple]:
    """Region list: count, then records."""
    (count,) = struct.unpack_from("<i", data, 0)
    at = 4
    for sv in range(count):
        (frame, _, dims, voxels), at = _read_region(data, at)
        yield frame, sv, list(dims), len(voxels), voxels


def write_regions(regions: list[tuple]) -> bytes:
    """regions: (frame, bytes a voxel, dims, voxels)."""
    return struct.pack("<i", len(regions)) + b"".join(write_region(*r) for r in regions)


def parse_segmentation(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """Regions and dendrogram of a frame: nodes (node, parent or None, thr, region or None), breadth first, at most two children each."""
    (count,) = struct.unpack_from("<I", data, 0)
    at, regions = 4, []
    for sv in range(count):
        (frame, _, dims, voxels), at = _read_region(data, at)
        regions.append((frame, sv, list(dims), len(voxels), voxels))
    (n,) = struct.unpack_from("<i", data, at)
    rows = np.frombuffer(data, np.dtype([("thr", "<f4"), ("region", "<i4"), ("parent", "<i4")]), n, at + 4)
    nodes = [(i, int(r["parent"]) if r["parent"] >= 0 else None, float(r["thr"]), int(r["region"]) if r["region"] >= 0 else None) for i, r in enumerate(rows)]
    kids: dict[int | None, int] = {}
    for _, parent, _, _ in nodes:
        kids[parent] = kids.get(parent, 0) + 1
        if parent is not None and kids[parent] > 2:
            raise ValueError(f"node {parent} has more than two children")
    return regions, nodes


def write_segmentation(regions: list[tuple], nodes: list[tuple]) -> bytes:
    body = struct.pack("<I", len(regions)) + b"".join(write_region(*r) for r in regions)
    table = np.array([(t, -1 if g is None else g, -1 if p is None else p) for _, p, t, g in nodes], np.dtype([("thr", "<f4"), ("region", "<i4"), ("parent", "<i4")]))
    return body + struct.pack("<i", len(nodes)) + table.tobytes()


def parse_responsibilities(data: bytes) -> Iterator[tuple[int, int, float, int]]:
    """(slot, label, r, component): K weights and K components for each of n labels, slot by slot."""
    n, k = struct.unpack_from("<2i", data, 0)
    r = np.frombuffer(data, "<f4", n * k, 8).reshape(k, n)
    c = np.frombuffer(data, "<i4", n * k, 8 + 4 * n * k).reshape(k, n)
    for slot in range(k):
        for label in range(n):
            yield slot, label, float(r[slot, label]), int(c[slot, label])


def write_responsibilities(r: np.ndarray, component: np.ndarray) -> bytes:
    """Arrays K x n."""
    k, n = r.shape
    return struct.pack("<2i", n, k) + r.astype("<f4").tobytes() + component.astype("<i4").tobytes()


def parse_lineages(data: bytes) -> Iterator[tuple]:
    """Rows (frame, id, kind, x, y, z, radius, parent, confidence); parent is None for a root."""
    frames, _ = struct.unpack_from("<2i", data, 0)
    at = 8
    for frame in range(frames):
        (n,) = struct.unpack_from("<i", data, at)
        rows = np.frombuffer(data, "<f4", 9 * n, at + 4).reshape(n, 9)
        at += 4 + 36 * n
        for id_, kind, x, y, z, radius, parent, _, conf in rows.tolist():
            yield frame, id_, kind, x, y, z, radius, parent if parent >= 0 else None, conf


def write_lineages(rows: list[tuple]) -> bytes:
    """rows as parse_lineages gives them, in any order; frames without rows are empty."""
    frames = max((r[0] for r in rows), default=-1) + 1
    out = [struct.pack("<2i", frames, len(rows))]
    for f in range(frames):
        own = [(i, k, x, y, z, rad, -1 if p is None else p, f, c) for fr, i, k, x, y, z, rad, p, c in rows if fr == f]
        out.append(struct.pack("<i", len(own)) + np.array(own, "<f4").tobytes())
    return b"".join(out)


def parse_training(data: bytes) -> Iterator[tuple[list[float], float]]:
    """(features, y)."""
    nf, ns = struct.unpack_from("<2i", data, 0)
    x = np.frombuffer(data, "<f4", nf * ns, 8).reshape(ns, nf)
    y = np.frombuffer(data, "<f4", ns, 8 + 4 * nf * ns)
    for row, label in zip(x.tolist(), y.tolist()):
        yield row, label


def write_training(x: np.ndarray, y: np.ndarray) -> bytes:
    return struct.pack("<2i", x.shape[1], x.shape[0]) + x.astype("<f4").tobytes() + np.asarray(y, "<f4").tobytes()


def parse_flow(data: bytes, dims: tuple[int, int, int]) -> np.ndarray:
    """Rows x, y, z, vx, vy, vz of a raw float array dims + (3,), x fastest."""
    v = np.frombuffer(data, "<f4").reshape(3, *dims[::-1])
    z, y, x = np.meshgrid(*[np.arange(n) for n in dims[::-1]], indexing="ij")
    return np.column_stack([x.ravel(), y.ravel(), z.ravel(), *v.reshape(3, -1)])


def parse_drift(text: str) -> list[tuple[int, float, float, float]]:
    """Rows t x y z."""
    return [(int(a), float(x), float(y), float(z)) for a, x, y, z in (line.split() for line in text.splitlines() if line.strip())]


def parse_swc(text: str) -> list[tuple]:
    """Neuron morphology: (id, kind, x, y, z, r, parent or None); # starts a comment."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    return [(int(r[0]), int(r[1]), *map(float, r[2:6]), int(r[6]) if int(r[6]) >= 0 else None) for r in rows]


def read_files(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (path, schema...) of a parser over files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(name, *r) for r in parse(data.as_py())]
                for a in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[a : a + 5000])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = f"path string, {schema}"
    kinds = to_arrow_schema(_parse_datatype_string(full))

    def arrow(batches):
        for frame in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(frame[i].tolist(), kinds.field(i).type, from_pandas=True) for i in range(len(kinds))], kinds.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(arrow, full)


def write_files(rows: DataFrame, path: str, encode: Callable[[dict], bytes], name: Callable[[dict], str] | None = None) -> None:
    """A file for each row, in a folder of any store that Spark reaches; named after the row's plain values, or by name.

    Rows are encoded where they are; the bytes go through the driver to Hadoop's file system one file after another, since
    Spark has no sink for bare bytes, so the driver holds a file at a time.
    """
    named = name or (lambda row: "_".join(f"{k}={v}" for k, v in row.items() if not isinstance(v, (list, dict))) + ".bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pa.array([named(row)]), pa.array([encode(row)], pa.binary())], ["name", "content"])

    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(conf)
    for row in rows.mapInArrow(run, "name string, content binary").toLocalIterator():
        out = store.create(jvm.org.apache.hadoop.fs.Path(folder, row["name"]))
        out.write(bytearray(row["content"]))
        out.close()


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, parse_regions, REGION)


def read_dendrograms(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, lambda data: iter(parse_segmentation(data)[1]), NODE)


def read_lineages(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, parse_lineages, TRACK_POINT)


def read_responsibilities(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, parse_responsibilities, "slot int, label int, r double, component int")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, parse_training, "features array<double>, y double")


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, lambda data: iter(parse_swc(data.decode())), "id int, kind int, x double, y double, z double, r double, parent int")
