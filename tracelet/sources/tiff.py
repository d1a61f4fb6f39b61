"""Grey-scale TIFF stacks: a baseline reader and writer in numpy, and a Spark reader of voxels.

Strips, uncompressed or PackBits, 8, 16 or 32 bits a sample (unsigned or
float), either byte order; a page is a slice in z.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def read_pages(data: bytes) -> Iterator[np.ndarray]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    while at:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for e in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * e)
            if kind not in CODES:
                continue
            place = at + 10 + 12 * e
            if SIZES[kind] * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", data, place)
        if tags.get(SAMPLES, (1,))[0] != 1 or tags.get(COMPRESSION, (1,))[0] not in (1, 32773):
            raise ValueError("only grey-scale pages, plain or PackBits, are read")
        kind = "f" if tags.get(FORMAT, (1,))[0] == 3 else "u"
        dtype = np.dtype(f"{order}{kind}{tags[BITS][0] // 8}")
        strips = [data[o : o + c] for o, c in zip(tags[OFFSETS], tags[COUNTS])]
        if tags.get(COMPRESSION, (1,))[0] == 32773:
            strips = [_unpack_bits(s) for s in strips]
        w, h = tags[WIDTH][0], tags[LENGTH][0]
        yield np.frombuffer(b"".join(strips), dtype, w * h).reshape(h, w)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def write_pages(pages: list[np.ndarray]) -> bytes:
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        raw = np.ascontiguousarray(page).astype(page.dtype.newbyteorder("<")).tobytes()
        offset = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = [
            (WIDTH, 4, page.shape[1]),
            (LENGTH, 4, page.shape[0]),
            (BITS, 3, page.dtype.itemsize * 8),
            (COMPRESSION, 3, 1),
            (PHOTOMETRIC, 3, 1),
            (OFFSETS, 4, offset),
            (SAMPLES, 3, 1),
            (ROWS, 4, page.shape[0]),
            (COUNTS, 4, len(raw)),
            (FORMAT, 3, 3 if page.dtype.kind == "f" else 1),
        ]
        out += struct.pack("<H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack("<HHI", tag, kind, 1) + struct.pack("<I", value)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def promoted(stack: np.ndarray) -> np.ndarray:
    """8 bits shifted up to 16; a single slice doubled to depth 2."""
    if stack.dtype == np.uint8:
        stack = stack.astype(np.uint16) << 8
    return np.concatenate([stack, np.zeros_like(stack)]) if len(stack) == 1 else stack


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """(path, z, y, x, v) of every page of the files, a page at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for z, page in enumerate(read_pages(data.as_py())):
                    y, x = np.indices(page.shape, np.int32)
                    n = page.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(np.full(n, z, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(page.astype(np.float64).ravel())], ["path", "z", "y", "x", "v"]
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, z int, y int, x int, v double")


def write_series(voxels: DataFrame, path: str, pattern: str, kind: str = "float32") -> None:
    """A file of pages z for each frame of voxels (frame, z, y, x, v), named by the pattern; places without a voxel are 0."""
    from tracelet.sources.binary import write_files
    from tracelet.sources.config import numbered_path

    def encode(row: dict) -> bytes:
        z, y, x, v = (np.array([p[c] for p in row["places"]]) for c in ("z", "y", "x", "v"))
        stack = np.zeros((z.max() + 1, y.max() + 1, x.max() + 1), kind)
        stack[z, y, x] = v
        return write_pages(list(stack))

    write_files(voxels.groupBy("frame").agg(F.collect_list(F.struct("z", "y", "x", "v")).alias("places")), path, encode, lambda row: numbered_path(pattern, row["frame"]))
