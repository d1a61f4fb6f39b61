"""Order MinHash fingerprints of documents.

A text is words cut at ASCII white space, A-Z in lower case, and cut within a
word after any four bytes of it whose hash is one of sixteen: places that the
text itself sets, so a byte more in front moves no other cut, and text without
blanks has units too. Its k-mers are K such units in a row, each with its
occurrence number. Each of HASHES functions picks the L = 2 least numbered
k-mers; their hashes, in text order, are hashed to one value. The fingerprint
is these values. The likeness of two fingerprints is the square root of the
share of equal values: a value is equal only if both picks and their order are,
so the root is near the share of k-mers in common.

Defined cases: a null text is the empty text, whose fingerprint is all zeros;
a text of fewer than K words has one k-mer of all of them; equal texts have
equal fingerprints; two empty texts are alike by 1; very long texts are read
whole, in blocks. Rows with a null id come first in the order; rows of equal
ids are ordered by text; the only document is its own next. An empty table
gives no rows; other columns are ignored.

How it scales: fingerprints are narrow. For the next document in id order the
ids are cut into ranges at true ids, found by one small aggregate; each range
is one partition, with a copy of the first row of the next range. So the texts
are shuffled once and no partition waits for another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.llm.common import frugal
from tracelet.llm.words import MULTIPLIERS, WordHashes, mix, shingles

K, HASHES = 3, 48
BLOCK = 4096
CUT_BITS = 4
BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_odd = np.random.default_rng(11).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def units(text: str) -> list[bytes]:
    data = text.encode().lower()
    if len(data) > 4:
        b = np.frombuffer(data, np.uint8)
        four = b[:-3].astype(np.uint32)
        for j in (1, 2, 3):
            four |= b[j : len(b) - 3 + j].astype(np.uint32) << np.uint32(8 * j)
        at = np.flatnonzero((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - CUT_BITS) == 0)
        blank = BLANK[b]
        at = at[~(blank[at] | blank[at + 1] | blank[at + 2] | blank[at + 3])] + 4
        data = np.insert(b, at, 32).tobytes()
    return data.split()


def numbered(kmers: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number)."""
    n = len(kmers)
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    new = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    if new.all():
        return mix(kmers)
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    out = np.empty(n, np.uint64)
    out[order] = mix(s + (np.arange(n) - starts).astype(np.uint64) * MULTIPLIERS[2])
    return out


def two_least(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (HASHES x 2) and values of the two least under each function."""
    x = h[None, :] * _odd[:, None]
    rows = np.arange(HASHES)
    a = x.argmin(1)
    va = x[rows, a]
    if len(h) == 1:
        return np.stack([a, a], 1), np.stack([va, va], 1)
    x[rows, a] = np.iinfo(np.uint64).max
    b = x.argmin(1)
    return np.stack([a, b], 1), np.stack([va, x[rows, b]], 1)


def order_minhash(words: np.ndarray) -> np.ndarray:
    kmers = shingles(words, K)
    if not len(kmers):
        return np.zeros(HASHES, np.uint32)
    h = numbered(kmers)
    places, values = two_least(h[:BLOCK])
    for a in range(BLOCK, len(h), BLOCK):
        p, v = two_least(h[a : a + BLOCK])
        if len(h) - a == 1:
            p, v = p[:, :1], v[:, :1]
        p, v = np.concatenate([places, p + a], 1), np.concatenate([values, v], 1)
        best = np.argsort(v, 1, kind="stable")[:, :2]
        places, values = np.take_along_axis(p, best, 1), np.take_along_axis(v, best, 1)
    places = np.sort(places, 1)
    pair = mix(mix(kmers[places[:, 0]]) * MULTIPLIERS[3] + kmers[places[:, 1]] + _odd)
    return (pair >> np.uint64(32)).astype(np.uint32)


class Fingerprints:
    def __init__(self):
        self.hashes = WordHashes()

    def of(self, text: str) -> np.ndarray:
        words = units(text)
        return order_minhash(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt((a == b).mean()))


def spell(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprints()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spell(make.of(t.as_py() or "")) for t in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(frugal(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str, ranges: int | None = None) -> DataFrame:
    """(id long, text, halo boolean): partition k has the k-th range of ids in order, then with halo the first rows of the next range (after the last: the first)."""
    spark = docs.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select(id_col).rdd.getNumPartitions())
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = [k / ranges for k in range(1, ranges)] or [0.5]
    found = ids.agg(F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls"), F.percentile_approx("id", cuts, 100 * ranges).alias("cuts")).collect()[0]
    firsts = np.array(sorted({c for c in found["cuts"] or [] if c > found["least"]} if ranges > 1 else set()), np.int64)
    least, nulls, parts = found["least"], found["nulls"], len(firsts) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = np.array(batch.column(0).is_null())
            ids = np.where(null, np.iinfo(np.int64).min, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            part = np.searchsorted(firsts, ids, "right")
            first = null if nulls else ids == least
            if len(firsts):
                at = np.minimum(np.searchsorted(firsts, ids), len(firsts) - 1)
                starts = (firsts[at] == ids) & ~null
            else:
                at, starts = part, np.zeros(len(ids), bool)
            take = np.concatenate([np.arange(len(ids)), np.flatnonzero(starts), np.flatnonzero(first)])
            to = np.concatenate([part, at[starts], np.full(int(first.sum()), parts - 1)])
            halo = np.arange(len(take)) >= len(ids)
            for a in range(0, len(take), 2000):
                rows = batch.take(pa.array(take[a : a + 2000]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(halo[a : a + 2000]), pa.array(to[a : a + 2000], pa.int32())], ["id", "text", "halo", "part"])

    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(frugal(deal), "id long, text string, halo boolean, part int")
    return dealt.repartitionById(parts, F.col("part")).select("id", "text", "halo").sortWithinPartitions("halo", "id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Of each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half (rounded down) replaced by as many code points from the front of the next document.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprints()
        held = None
        for batch in batches:
            out = []
            for id_, text, halo in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if held is None and halo:
                    break
                text = text.as_py()
                mine = make.of(text)
                if held is not None:
                    before, said, theirs = held
                    half = len(said) // 2
                    edited = said[: len(said) - half] + text[:half]
                    other = make.of(edited)
                    out.append((before, len(said), hashlib.sha256(edited.encode()).hexdigest(), spell(theirs), spell(other), likeness(theirs, other), likeness(theirs, mine)))
                held = None if halo else (id_, text, mine)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col, ranges).mapInArrow(frugal(run), schema)
