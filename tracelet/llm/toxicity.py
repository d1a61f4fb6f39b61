"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A first dictionary of BASE_BYTES is trained on windows of ordinary documents;
most text of either kind is in it. What it lacks of ordinary documents, and
what it lacks of toxic ones, trains two further dictionaries of CLASS_BYTES,
and each follows the first: so both sides hold the same common text at the same
distance, and differ by their own. Nothing chooses text by its label before
training. A document is read in short overlapping windows; a window's gain is
the number of bytes that the toxic dictionary saves over the ordinary one. The
score is a logistic function, calibrated on labelled documents that the
dictionaries haven't seen, of how many windows, and how large a share of them,
reach each of the thresholds GAINS.

Labelled documents: for each label, about TRAIN_ROWS documents with the least
hashes of their ids, each read whole. Every window of every text is scored.

Defined cases: a null text is the empty text, which has no window and gets the
score of a document without gains; a document labelled more than once counts as
toxic if any label says so; null labels are not learnt from; without labels of
both kinds every score is 0; text that zstandard can't train on, as next to
none, is its own dictionary; repeated rows each get a row; an empty table gives
no rows; other columns are ignored, or pass through in reject_toxic.

How it scales: the sample is bounded in rows by a parameter and learnt from in
one task, the model is two dictionaries of 66 KB, and scoring is one narrow pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.llm.common import frugal, held_out

TRAIN_ROWS = 4000
WIDTH, STEP = 48, 36
BASE_BYTES, CLASS_BYTES = 65536, 2048
SEGMENT, PART = 20, 6  # zstandard's k and d
BASE_FED, CLASS_FED = 64, 256  # it fills a dictionary from so many times its size, so less text is given to it several times
GRAM, MARGIN = 5, 4
GAINS = (2, 3, 4, 5, 6, 8)
RIDGE = 0.5
LEVEL = 9
MIN_MATCH = 4


def windows(text: str) -> list[bytes]:
    data = text.lower().encode()
    return [data[a : a + WIDTH] for a in range(0, max(1, len(data) - (WIDTH - STEP)), STEP)] if data else []


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: tuple[float, ...] = (0.0,) * (1 + 2 * len(GAINS))):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def gains(self, text: str) -> np.ndarray:
        """By window: bytes that the toxic dictionary saves over the ordinary one."""
        if self._pair is None:
            params = zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_dict_id=False)
            self._pair = []
            for data in (self.ordinary, self.toxic):
                held = zstd.ZstdCompressionDict(data)
                held.precompute_compress(compression_params=params)
                self._pair.append(zstd.ZstdCompressor(dict_data=held, compression_params=params).compress)
        ordinary, toxic = self._pair
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.int64)

    @staticmethod
    def features(gains: np.ndarray) -> np.ndarray:
        """Of the windows at and above each threshold: how many, and how large a share."""
        hits = (gains[:, None] >= np.array(GAINS)).sum(axis=0)
        return np.concatenate([np.log1p(hits), np.log1p(100.0 * hits / max(1, len(gains)))])

    def score(self, text: str) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(self.gains(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _codes(data: bytes) -> np.ndarray:
    """The GRAM-byte stretches at each place, as numbers."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(x) - GRAM + 1), np.uint64)
    for j in range(GRAM):
        out |= x[j : j + len(out)] << np.uint64(8 * j)
    return out


def residue(text: str, known: np.ndarray) -> list[bytes]:
    """The stretches of a text that no known GRAM bytes reach, with a margin."""
    data = f" {text.lower()} ".encode()
    codes = _codes(data)
    reach = np.zeros(len(data) + 1, np.int64)
    if len(known):
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes)
        reach[at] += 1
        reach[at + GRAM] -= 1
    bare = np.cumsum(reach[:-1]) == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], bare.astype(np.int8), [0]])))
    return [data[max(0, a - MARGIN) : b + MARGIN] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def dictionary(samples: list[bytes], size: int, fed: int) -> bytes:
    """Trained by zstandard."""
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstd.train_dictionary(size, samples * -(-fed * size // total), k=SEGMENT, d=PART).as_bytes()
    except zstd.ZstdError:  # it finds nothing that recurs
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's steps with a ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [RIDGE] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge
        w = w + np.clip(np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge @ w), -2, 2)
    return w


def fit(sample: list[tuple[int, str]], share_toxic: float) -> Model | None:
    """sample: (label, text). Dictionaries from two thirds, thresholds from the rest."""
    if len({y for y, _ in sample}) < 2:
        return None
    learn = [s for i, s in enumerate(sample) if i % 3]
    rest = sample[::3]
    if min(len({y for y, _ in part}) for part in (learn, rest)) < 2:
        learn = rest = sample
    base = dictionary([w for y, t in learn if y == 0 for w in windows(t)], BASE_BYTES, BASE_FED)
    known = np.unique(_codes(base))
    own = [dictionary([r for y, t in learn if y == label for r in residue(t, known)], CLASS_BYTES, CLASS_FED) for label in (0, 1)]
    size = max(map(len, own))
    model = Model(*(base + d.rjust(size, b"\0") for d in own))
    labels = np.array([y for y, _ in rest], float)
    weight = np.where(labels == 1, share_toxic / max(labels.mean(), 1e-9), (1 - share_toxic) / max(1 - labels.mean(), 1e-9))
    model.weights = tuple(_logistic(np.array([Model.features(model.gains(t)) for _, t in rest]), labels, weight).tolist())
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[DataFrame, float] | None:
    """(id, y, text) of about `rows` documents of each label, and the share of toxic labels; nothing without labels of both kinds."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(~held_out("id") & F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    wanted = known.filter(hashed < F.when(F.col("y") == 1, min(1.0, rows / counts[1])).otherwise(min(1.0, rows / counts[0])))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(wanted), "id").select("id", "y", "text")  # wanted has about 2 * rows rows
    return sample, counts[1] / (counts[0] + counts[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model | None:
    if (chosen := training_rows(docs, labels, id_col, text_col, label_col, rows)) is None:
        return None
    sample, share = chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((str(i), y, t) for b in batches for i, y, t in zip(*[c.to_pylist() for c in b.columns]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(y, t) for _, y, t in found], share))], pa.binary())], ["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(frugal(run), "model binary").first()["model"])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [model.score(t.as_py() or "") if model else 0.0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(frugal(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is at least one half; the same columns."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py() or "") < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
