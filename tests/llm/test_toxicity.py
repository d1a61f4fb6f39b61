import zlib

import numpy as np
import pyarrow.parquet as pq

from tracelet.llm import toxicity
from tracelet.llm.common import held_out

SF = "/root/testdata/sf0.1"


def test_learns_from_whole_texts(spark):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(500 + 1500 * (i % 3)))) for i in range(60)]
    assert sum(len(t) > 4000 for _, t in rows) == 40
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sample, share = toxicity.training_rows(d, labels)
    learnt = {r["doc_id"] for r in d.filter(~held_out("doc_id")).collect()}
    assert sorted((r["y"], r["text"]) for r in sample.collect()) == sorted((i % 2, t) for i, t in rows if i in learnt)
    assert share == sum(i % 2 for i in learnt) / len(learnt)


def area(toxic, ordinary):
    return np.mean([(np.array(toxic)[:, None] > np.array(ordinary)).mean(), (np.array(toxic)[:, None] >= np.array(ordinary)).mean()])


def test_held_out_rows():
    text = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    rows = [(i, y, text[i] or "") for i, y in sorted(zip(labels["doc_id"], labels["toxic"])) if i in text and y is not None]
    fold = [zlib.crc32(str(i).encode()) % 5 for i, _, _ in rows]
    sample = [(y, t) for (_, y, t), f in zip(rows, fold) if f]
    rest = [(y, t) for (_, y, t), f in zip(rows, fold) if not f]
    model = toxicity.fit(sample, sum(y for y, _ in sample) / len(sample))
    assert area(*[[model.score(t) for y, t in rest if y == label] for label in (1, 0)]) > 0.72


def test_scores_equal_brute_force(spark):
    """Every window of every text compressed by itself, with compressors made anew."""
    import zstandard as zstd

    rows = [(i, (f"you are an idiot {i} and worthless " if i % 3 == 0 else f"a quiet walk {i} in the park ") * (1 + i % 4) + "plain words follow here") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "é" * 100), (103, "idiot " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    params = zstd.ZstdCompressionParameters.from_level(toxicity.LEVEL, min_match=toxicity.MIN_MATCH, write_content_size=False, write_dict_id=False)

    def length(data, held):
        return len(zstd.ZstdCompressor(dict_data=held, compression_params=params).compress(data))

    sides = [zstd.ZstdCompressionDict(x) for x in (model.ordinary, model.toxic)]
    for side in sides:
        side.precompute_compress(compression_params=params)
    for i, text in rows:
        data = (text or "").lower().encode()
        gains, at = [], 0
        while data and (at == 0 or len(data) - at > toxicity.WIDTH - toxicity.STEP):
            w = data[at : at + toxicity.WIDTH]
            gains.append(length(w, sides[0]) - length(w, sides[1]))
            at += toxicity.STEP
        hits = [sum(g >= t for g in gains) for t in toxicity.GAINS]
        x = [np.log1p(h) for h in hits] + [np.log1p(100 * h / max(1, len(gains))) for h in hits]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x))
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
