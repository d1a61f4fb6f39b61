"""Options of a tracking run as key=value text, and numbered file names."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, fields

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass
class TrackingOptions:
    """Defaults are those that results depend on."""

    imgFilePattern: str = ""
    debugPathPrefix: str = ""
    backgroundThreshold: float = 0.0
    anisotropyZ: float = 1.0
    maxIterEM: int = 400
    tolLikelihood: float = 1e-6
    KmaxNumNNsupervoxel: int = 10
    KmaxDistKNNsupervoxel: float = 50.0
    persistanceSegmentationTau: float = 14.0
    thrCellDivisionPlaneDistance: float = 3.14
    temporalWindowForLogicalRules: int = 5


REQUIRED = ("imgFilePattern", "debugPathPrefix", "backgroundThreshold")


def parse_options(text: str) -> TrackingOptions:
    """Comments start with #; lines without exactly a key and a value are passed by; unknown keys warn; a missing required key is an error."""
    kinds = {f.name: f.type for f in fields(TrackingOptions)}
    given = {}
    for line in text.splitlines():
        parts = [p.strip() for p in line.split("#", 1)[0].split("=")]
        if len(parts) != 2 or not all(parts):
            continue
        key, value = parts
        if key not in kinds:
            warnings.warn(f"unknown option {key}", stacklevel=2)
            continue
        given[key] = {"int": lambda v: int(float(v)), "float": float, "str": str}[kinds[key]](value)
    if missing := [k for k in REQUIRED if k not in given]:
        raise ValueError(f"options missing: {', '.join(missing)}")
    return TrackingOptions(**given)


def read_options(spark: SparkSession, path: str) -> TrackingOptions:
    """Of the first file at a path of any store that Spark reads."""
    return parse_options(spark.read.text(path, wholetext=True).first()["value"])


MARKS = re.compile(r"\?{2,6}")


def numbered_path(pattern: str, frame: int) -> str:
    """Each run of 2 to 6 question marks becomes the frame with as many digits."""
    return MARKS.sub(lambda m: f"{frame:0{len(m[0])}d}", pattern)


def numbered_path_column(pattern: str, frame: Column) -> Column:
    pieces, at = [], 0
    for m in MARKS.finditer(pattern):
        digits = frame.cast("string")
        pieces += [F.lit(pattern[at : m.start()]), F.when(F.length(digits) >= len(m[0]), digits).otherwise(F.lpad(digits, len(m[0]), "0"))]
        at = m.end()
    return F.concat(*pieces, F.lit(pattern[at:]))


def frame_of_path(pattern: str, path: Column) -> Column:
    """The frame in a path made from a pattern."""
    m = MARKS.search(pattern)
    if m is None:
        raise ValueError("the pattern has no place for a frame")
    return F.regexp_extract(path, re.escape(pattern[: m.start()].rsplit("/", 1)[-1]) + r"(\d+)", 1).cast("int")
