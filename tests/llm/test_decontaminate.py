import numpy as np

from tracelet.llm import decontaminate
from tracelet.llm.words import WordHashes


def planted(rng):
    """Items, and documents with one edited copy of each (10 to 25 % of words replaced, or words put in between), of a quarter of the items exact copies too."""
    common = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(common, int(rng.integers(15, 60))))) for i in range(160)]
    texts = []
    for i, item in items:
        w = item.split()
        if i % 8 == 7:
            texts.append(w[:4] + [f"in{k}" for k in range(int(0.8 * len(w)))] + w[4:])
        else:
            share = (0.1, 0.15, 0.2, 0.25)[i % 4]
            texts.append([f"new{rng.integers(1 << 40)}" if rng.random() < share else x for x in w])
        if i // 8 % 4 == 0:
            texts += [w, w]
    around = lambda: rng.choice(common, 40).tolist()
    return items, [(d, " ".join(around() + w + around())) for d, w in enumerate(texts)]


def test_equals_alignment_of_all_pairs(spark):
    items, rows = planted(np.random.default_rng(5))
    hashes = WordHashes(decontaminate.MARKS)
    want = {}
    for i, item in items:
        a = hashes.of(item)
        best, _ = decontaminate.align([a] * len(rows), [hashes.of(t) for _, t in rows])
        want |= {(d, i): s for (d, _), s in zip(rows, (best / (decontaminate.MATCH * len(a))).tolist()) if s >= decontaminate.THRESHOLD}
    assert len(want) > 150
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = decontaminate.find_contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()} == want
