"""Benchmark decontamination: n-gram seeds, then local alignment.

Words are lower-cased, cut at white space, without marks at both ends. A
benchmark item's seeds are its word n-grams, all of them: which ones an edited
copy has kept can't be told from how many documents have each. Where a document
has a seed, the passage around it, as wide as an alignment over the threshold
can be, is aligned with the whole item by Smith-Waterman over words; the score
is the best alignment's part of a perfect one. Passages at or over the
threshold are reported; one without any SEED words of the item in a row isn't
looked for.

Defined cases: a null or empty text or item has no words and matches nothing;
an item of fewer than SEED words is looked for as a whole; repeated items and
rows each count; of several items with the same id each is aligned, and the
best of a document and an item id is reported; very long texts are read whole;
an empty table gives no rows; other columns are ignored, or pass through in
drop_contaminated.

How it scales: the items are a stated query set, held against all rows in
blocks of at most BLOCK_BYTES of text, each of which is sent to the executors.
Documents are read once for each block, and only findings move. A seed that many
documents or items have costs an alignment for each pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.llm.common import frugal
from tracelet.llm.words import WordHashes, shingles

SEED = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 16_000_000
MARKS = b""".,;:!?"'()[]{}<>*#$%&|-_/\\"""
FILTER_BITS = 22
PAIRS_AT_ONCE = 256


class Items:
    """A block of items: words, seeds, and which items have a seed where."""

    def __init__(self, rows: list[tuple]):
        hashes = WordHashes(MARKS)
        self.ids = [r[0] for r in rows]
        self.words = [w[w != 0] for w in (hashes.of(r[1] or "") for r in rows)]
        self.sizes = sorted({min(len(w), SEED) for w in self.words if len(w)})
        at = [(s, i, j, k) for i, w in enumerate(self.words) if len(w) for k in [min(len(w), SEED)] for j, s in enumerate(shingles(w, k).tolist())]
        self.seed = np.array([x[0] for x in at], np.uint64)
        self.item = np.array([x[1] for x in at], np.int64)
        self.place = np.array([x[2] for x in at], np.int64)
        self.kept, runs = np.unique(self.seed, return_counts=True)
        self.by_seed = np.argsort(self.seed, kind="stable")
        self.runs = np.append(0, np.cumsum(runs))
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self.kept >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text, and the number in kept of the seed found there."""
        places, which = [], []
        for k in self.sizes:
            if len(words) >= k and len(self.kept):
                s = shingles(words, k)
                at = np.flatnonzero(self.bits[s >> np.uint64(64 - FILTER_BITS)])
                n = np.minimum(np.searchsorted(self.kept, s[at]), len(self.kept) - 1)
                ok = self.kept[n] == s[at]
                places.append(at[ok])
                which.append(n[ok])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(which)

    def passages(self, words: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(item, from, to): where the item may lie, joined where they overlap; with room for as many gaps as the threshold allows."""
        places, which = self.hits(words)
        spans: dict[int, list[int]] = {}
        for p, w in zip(places.tolist(), which.tolist()):
            for x in self.by_seed[self.runs[w] : self.runs[w + 1]].tolist():
                spans.setdefault(int(self.item[x]), []).append(p - int(self.place[x]))
        out = []
        for item, starts in spans.items():
            m = len(self.words[item])
            slack = int((1 - threshold) * MATCH * m / -GAP) + 2
            now = None
            for d in sorted(set(starts)):
                a, b = max(0, d - slack), min(len(words), d + m + slack)
                if now and a <= now[1] and b - now[0] <= 4 * (m + slack) + 64:
                    now[1] = b
                else:
                    if now:
                        out.append((item, *now))
                    now = [a, b]
            out.append((item, *now))
        return out


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of pairs, and where they end in the passages. Linear gaps."""
    rows, wide = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), rows), np.uint64)
    b = np.ones((len(items), wide), np.uint64)
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, : len(x)] = x
        b[i, : len(y)] = y
    real = np.arange(wide)[None, :] < np.array([len(y) for y in passages])[:, None]
    ramp = (np.arange(wide, dtype=np.int32) * -GAP)[None, :]
    before = np.zeros((len(items), wide), np.int32)
    best = np.zeros((len(items), wide), np.int32)
    for r in range(rows):
        now = np.where((a[:, r : r + 1] == b) & real, MATCH, MISMATCH).astype(np.int32)
        now[:, 1:] += before[:, :-1]
        np.maximum(now, before + GAP, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, 1) - ramp
        np.maximum(best, now, out=best)
        before = now
    end = best.argmax(1)
    return best[np.arange(len(items)), end], end


def _findings(items: Items, words: list[np.ndarray], threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, from word, to word) of the passages at or over the threshold, the best of each row and item."""
    todo = [(row, item, x, y) for row, w in enumerate(words) for item, x, y in items.passages(w, threshold)]
    todo.sort(key=lambda t: (len(items.words[t[1]]), t[3] - t[2]))
    best: dict[tuple[int, object], tuple] = {}
    at = 0
    while at < len(todo):
        n = max(1, min(PAIRS_AT_ONCE, 2_000_000 // max(1, todo[at][3] - todo[at][2])))
        part = todo[at : at + n]
        at += n
        score, end = align([items.words[i] for _, i, _, _ in part], [words[r][x:y] for r, _, x, y in part])
        for (row, item, x, y), s, e in zip(part, score.tolist(), end.tolist()):
            m = len(items.words[item])
            s /= MATCH * m
            if s >= threshold:
                key = row, items.ids[item]
                found = (s, max(x, x + e + 1 - m), x + e + 1)
                if key not in best or found > best[key][2]:
                    best[key] = row, item, found
    return [(row, item, *found) for row, item, found in best.values()]


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str) -> Iterator:
    """A broadcast Items for each block."""
    wanted = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).filter(F.length("text") > 0)
    total = wanted.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = -(-total // BLOCK_BYTES)
    context = docs.sparkSession.sparkContext
    for b in range(blocks):
        items = Items([(r["id"], r["text"]) for r in wanted.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()])
        yield context.broadcast(items)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, from_word, to_word: each document and item that align well enough, at their best passage."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, score double, from_word int, to_word int"
    out = spark.createDataFrame([], schema)
    for shared in _blocks(docs, benchmark, text_col, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes, items = WordHashes(MARKS), shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    words = [w[w != 0] for w in (hashes.of(t.as_py() or "") for t in part.column(1))]
                    found = _findings(items, words, threshold)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                            pa.array([items.ids[f[1]] for f in found], item_kind),
                            pa.array([f[2] for f in found], pa.float64()),
                            pa.array([f[3] for f in found], pa.int32()),
                            pa.array([f[4] for f in found], pa.int32()),
                        ],
                        ["doc_id", "item_id", "score", "from_word", "to_word"],
                    )

        item_kind = {"bigint": pa.int64(), "int": pa.int32()}.get(benchmark.schema[item_id].dataType.simpleString(), pa.string())
        out = out.unionAll(docs.select(id_col, text_col).mapInArrow(frugal(run), schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold a passage at or over the threshold; the same columns."""
    at = docs.columns.index(text_col)
    out = docs
    for shared in list(_blocks(docs, benchmark, text_col, item_id, item_text)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes, items = WordHashes(MARKS), shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    words = [w[w != 0] for w in (hashes.of(t.as_py() or "") for t in part.column(at))]
                    found = {f[0] for f in _findings(items, words, threshold)}
                    yield part.filter(pa.array([r not in found for r in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(frugal(run), docs.schema)
    return out
