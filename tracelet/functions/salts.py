"""Salts for joins with hot keys: a looked-up row is copied to the salts that occur among its partners, and to no others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SALTS = 64


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def salt_of(c: str | Column) -> Column:
    return F.pmod(F.xxhash64(_column(c)), F.lit(SALTS)).cast("int")


def salt_bits(c: str | Column) -> Column:
    """Aggregate: which salts occur in a group, as the bits of one long."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _column(c)))


def explode_salts(bits: str | Column) -> Column:
    """One row for each salt that occurs: at most 64, and at most as many as there are partners."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("getbit", _column(bits), s) == 1))
