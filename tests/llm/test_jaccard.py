import random

import pytest
from pyspark.sql import functions as F

from tracelet.llm import jaccard


def naive(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted((str(d), len(sets[i]), str(ids.get(root(i)))) for i, (d, _) in enumerate(rows))


def found(spark, rows, parts=3):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("n", F.lit(1)).withColumn("class", F.lit(1))
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.components(d.repartition(parts)).collect())


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    """Frequent classes from 3 documents on, so that combinations, kinds and pivots all have work."""
    monkeypatch.setattr(jaccard, "RARE", 3)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for size in (30, 60, 130):
        texts += near_copies(rng, [rng.choice(vocabulary) for _ in range(size)], 25, size // 12)
    for _ in range(25):  # one passage with more or less around it
        extra = [f"own{rng.random()}" for _ in range(rng.randint(0, 22))]
        texts.append(" ".join(extra[:5] + passage + extra[5:]))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += [texts[0], texts[0], texts[30], "one two", "one two", "ONE  two", "", None, "a b c d e f", "a b c d e f g", "a b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark, rows) == naive(rows)


def words(name, n):
    return [f"{name}{i}" for i in range(n)]


def test_larger_class_of_a_kind_in_frequent_lists(spark, monkeypatch):
    """a has the shared shingles of t, but links only with b, which t meets only in lists of frequent shingles that a pivot c has closed."""
    monkeypatch.setattr(jaccard, "RARE", 3)
    texts = []
    for k in range(8):  # other hashes, so other pivots
        s, c = words(f"s{k}.", 104), words(f"c{k}.", 10)
        texts += [s + words(f"t{k}.", 8), s + words(f"a{k}.", 26), s[:99], s + c]
        texts += [s + c + words(f"l{k}.{j}.", 300) for j in range(4)]
    rows = list(enumerate(" ".join(w) for w in texts))
    want = naive(rows)
    assert len({r[2] for r in want}) == 8 * 5
    for parts in (1, 3):
        assert found(spark, rows, parts) == want


def test_larger_class_links_through_frequent_shingles_only(spark, monkeypatch):
    """y has the shared shingles of t, but links only with x, which is the smallest class with their frequent ones."""
    monkeypatch.setattr(jaccard, "RARE", 3)
    texts = []
    for k in range(4):
        x = words(f"x{k}.", 104)
        r = x + words(f"r{k}.", 2)
        texts += [x, r + words(f"t{k}.", 8), r + words(f"y{k}.", 28)]
        texts += [x + words(f"l{k}.{j}.", 300) for j in range(4)]
    rows = list(enumerate(" ".join(w) for w in texts))
    want = naive(rows)
    assert len({r[2] for r in want}) == 4 * 5
    for parts in (1, 3):
        assert found(spark, rows, parts) == want


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(5, long), (4, long + " more"), (3, None), (2, ""), (7, "x"), (7, "x"), (None, "x"), (9, "x y z"), (8, None)]
    assert found(spark, rows) == naive(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.components(empty).count() == 0


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "other words in this one here"), (None, "a b c d e f g")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = jaccard.one_of_each(d)
    assert out.columns == d.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "4", "5", "None"]


def test_prefix_counts():
    import numpy as np

    tokens = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for wanted in (1, 5, 20):
        for groups in (1, 4):
            got = jaccard.frequent_prefix(tokens, wanted, groups)
            assert sum(len(g) - 1 for g in got) == wanted
