"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers of gated units read a window of bytes, one from each end.
At each position the two states together give a probability for each language;
a document's probabilities are the mean over all its positions. Training is by
backpropagation through time, in numpy, with every position labelled with its
window's language.

Training data: for each language, an expected TRAIN_ROWS documents with the
least hashes of their ids, one window of each at a place that its id picks.
Those bounds are parameters; nothing else about the corpus is sampled: every
byte of every text is labelled when documents are scored.

Defined cases: a null text or one without a letter is `und` with score 0; a
null language is never learnt from; with no labelled rows at all every document
is `und`; very long texts are read whole in windows; a null id counts as the
empty text in the fold rule; repeated rows each get a row; an empty table gives
no rows; other columns are ignored.

How it scales: training collects a bounded sample and the model is a few
thousand numbers; scoring is one narrow pass whose batches are windows of any
documents, so long texts don't make long loops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.llm.common import frugal, held_out

HIDDEN = 8
WINDOW = 64
TRAIN_ROWS = 400
TRAIN_CHARS = 192
EPOCHS = 8
BATCH = 64
RATE = 0.02
SEED = 5
UNKNOWN = "und"
ROWS_AT_ONCE = 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Weights of both directions are stacked: index 0 reads forwards, 1 backwards. Gates: update, reset, candidate."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        f = np.float32
        self.p = {
            "table": (rng.standard_normal((2, 257, 3 * hidden)) * 0.3).astype(f),  # of a byte and 256, the filler
            "gates": (rng.standard_normal((2, hidden, 2 * hidden)) / np.sqrt(hidden)).astype(f),
            "cand": (rng.standard_normal((2, hidden, hidden)) / np.sqrt(hidden)).astype(f),
            "out": (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(f),
            "bias": np.zeros(len(languages), f),
        }

    def states(self, codes: np.ndarray, keep: bool = False):
        """codes: rows x positions. States of both directions by position: positions x 2 x rows x hidden; what training needs if keep."""
        h, p = self.h, self.p
        rows, length = codes.shape
        both = np.stack([codes, codes[:, ::-1]])  # 2 x rows x positions
        states = np.zeros((length + 1, 2, rows, h), np.float32)
        memo = []
        for t in range(length):
            x = np.stack([p["table"][0].take(both[0, :, t], 0), p["table"][1].take(both[1, :, t], 0)])
            s = states[t]
            gates = sigmoid(s @ p["gates"] + x[:, :, : 2 * h])
            z, r = gates[:, :, :h], gates[:, :, h:]
            rs = r * s
            c = np.tanh(rs @ p["cand"] + x[:, :, 2 * h :])
            np.add(s, z * (c - s), out=states[t + 1])
            if keep:
                memo.append((gates, rs, c))
        return (both, states, memo) if keep else states[1:]

    def logits(self, states: np.ndarray) -> np.ndarray:
        """positions x rows x languages, from states in reading order of each direction."""
        h = self.h
        return states[:, 0] @ self.p["out"][:h] + states[::-1, 1] @ self.p["out"][h:] + self.p["bias"]

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h, p = self.h, self.p
        both, states, memo = self.states(codes, keep=True)
        length, real = len(memo), (codes != 256).T  # positions x rows
        logits = self.logits(states[1:])
        e = np.exp(logits - logits.max(-1, keepdims=True))
        prob = e / e.sum(-1, keepdims=True)
        n = max(1, real.sum())
        loss = -float((np.log(prob[:, np.arange(len(labels)), labels] + 1e-9) * real).sum() / n)
        d = prob
        d[:, np.arange(len(labels)), labels] -= 1
        d *= (real / n)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"] = d.sum((0, 1))
        g["out"][:h] = np.tensordot(states[1:, 0], d, ([0, 1], [0, 1]))
        g["out"][h:] = np.tensordot(states[:0:-1, 1], d, ([0, 1], [0, 1]))
        into = np.stack([d @ p["out"][:h].T, (d @ p["out"][h:].T)[::-1]], 1)  # positions x 2 x rows x hidden
        back = np.zeros_like(states[0])
        for t in reversed(range(length)):
            gates, rs, c = memo[t]
            s, z, r = states[t], gates[:, :, :h], gates[:, :, h:]
            ds = into[t] + back
            dc = ds * z * (1 - c * c)
            dz = ds * (c - s) * z * (1 - z)
            drs = dc @ p["cand"].transpose(0, 2, 1)
            dr = drs * s * r * (1 - r)
            dg = np.concatenate([dz, dr], -1)
            back = ds * (1 - z) + drs * r + dg @ p["gates"].transpose(0, 2, 1)
            g["cand"] += rs.transpose(0, 2, 1) @ dc
            g["gates"] += s.transpose(0, 2, 1) @ dg
            dx = np.concatenate([dg, dc], -1)
            for k in (0, 1):
                np.add.at(g["table"][k], both[k, :, t], dx[k])
        return loss, g

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> None:
        """Adam with a falling rate and clipped gradients."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(codes) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                _, g = self.gradients(codes[at], labels[at])
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k, v in self.p.items():
                    x = g[k] * min(1.0, 1 / (norm + 1e-9))
                    mean[k] += 0.1 * (x - mean[k])
                    square[k] += 0.001 * (x * x - square[k])
                    v -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def probabilities(self, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
        """Mean over all positions of each text: texts x languages. An empty text's row is zeros."""
        pooled = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts])
        rows = -(-sizes // window)
        owner = np.repeat(np.arange(len(texts)), rows)
        codes = np.full((len(owner), window), 256, np.int16)
        first = np.cumsum(rows) - rows
        flat = codes.reshape(-1)
        for i, t in enumerate(texts):
            flat[first[i] * window : first[i] * window + len(t)] = np.frombuffer(t, np.uint8)
        full = np.diff(np.append(owner, -1)) == 0  # not the last of its text
        for a in range(0, len(owner), ROWS_AT_ONCE):
            part = codes[a : a + ROWS_AT_ONCE]
            e = self.logits(self.states(part))
            np.exp(e, out=e)
            e /= e.sum(-1, keepdims=True)
            if not full[a : a + ROWS_AT_ONCE].all():
                e *= (part != 256).T[:, :, None]
            np.add.at(pooled, owner[a : a + ROWS_AT_ONCE], e.sum(0, dtype=np.float64))
        return pooled / np.maximum(sizes, 1)[:, None]


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, chars: int) -> list[tuple[str, str]]:
    """(language, window) of about per_language documents of each; which ones, their ids' hashes tell."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    taken = known.filter(hashed < F.element_at(share, F.col("lang")))
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    rows = taken.select("lang", F.substring("text", place.cast("int"), F.lit(chars)).alias("window"), "id").collect()
    return [(r["lang"], r["window"]) for r in sorted(rows, key=lambda r: (r["lang"], str(r["id"]), r["window"]))]


def train(windows: list[tuple[str, str]], hidden: int = HIDDEN, window: int = WINDOW, epochs: int = EPOCHS) -> Network | None:
    languages = sorted({lang for lang, _ in windows})
    if not languages:
        return None
    codes, labels = [], []
    for lang, text in windows:
        data = text.encode()
        for a in range(0, len(data), window):
            row = np.full(window, 256, np.int16)
            part = np.frombuffer(data[a : a + window], np.uint8)
            row[: len(part)] = part
            codes.append(row)
            labels.append(languages.index(lang))
    net = Network(languages, hidden)
    if codes and len(languages) > 1:
        net.fit(np.array(codes), np.array(labels), epochs)
    return net


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [t or "" for t in part.column(2).to_pylist()]
                lettered = [any(map(str.isalpha, t)) for t in texts]
                if net is None:
                    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                else:
                    prob = net.probabilities([t.encode() if ok else b"" for t, ok in zip(texts, lettered)])
                    best = prob.argmax(1)
                    pred = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
                    score = [min(1.0, float(x[k])) if ok else 0.0 for x, k, ok in zip(prob, best, lettered)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    net = train(training_windows(docs, id_col, text_col, lang_col, per_language, chars))
    return identify(docs, net, id_col, text_col)
