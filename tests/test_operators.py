import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelet.operators import assign, features, filters, graph, mixture, segment, spatial, trees
from tracelet.operators import regions as rg


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_matching_is_the_cheapest(n, m, rng):
    """Against all choices, with missing and parallel edges and ties."""
    edges = [(i, j + 10, rng.choice([rng.random(), 0.5, 1.0])) for i in range(n) for j in range(m) for _ in range(rng.choice([0, 1, 1, 2]))]
    if not edges:
        return
    s, d, c = map(np.array, zip(*edges))
    least = {}
    for i, j, x in edges:
        least[i, j] = min(x, least.get((i, j), 9.0))
    rows = sorted({i for i, _, _ in edges})

    def best(k, taken):
        if k == len(rows):
            return 0.0
        ways = [0.75 + best(k + 1, taken)]
        return min(ways + [x + best(k + 1, taken | {j}) for (i, j), x in least.items() if i == rows[k] and j not in taken])

    got = assign.assign_edges(s, d, c, 0.75)
    used = [j for j in got.values() if j is not None]
    assert sorted(got) == rows and len(set(used)) == len(used)
    assert sum(0.75 if j is None else least[i, j] for i, j in got.items()) == pytest.approx(best(0, frozenset()))


def test_hand_case():
    """Three sources, four destinations, refusal at 0.85: total 2.15."""
    edges = [(0, 0, 0.7), (0, 1, 0.5), (1, 1, 0.8), (2, 2, 0.9), (2, 3, 0.8)]
    s, d, c = map(np.array, zip(*edges))
    assert assign.assign_edges(s, d, c, 0.85) == {0: 1, 1: None, 2: 3}


def test_assign_by_component(spark):
    rows = [(0, 0, 0.7), (0, 1, 0.5), (1, 1, 0.8), (2, 2, 0.9), (2, 3, 0.8), (7, 9, 5.0)]
    got = {r["src"]: r["dst"] for r in assign.assign(spark.createDataFrame(rows, "src long, dst long, cost double"), 0.85).collect()}
    assert got == {0: 1, 1: None, 2: 3, 7: None}


def naive_components(edges, nodes):
    up = {n: n for n in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50), (60, 60)], [(5, 3), (3, 9), (9, 1), (20, 21), (21, 22)]])
def test_components(spark, edges):
    nodes = sorted({n for e in edges for n in e} | {99})
    got = graph.components(spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r["node"]: r["component"] for r in got.collect()} == naive_components(edges, nodes)


def test_shortest_paths(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0), (2, 3, 0.5), (8, 9, 1.0)]
    got = graph.shortest_paths(spark.createDataFrame(edges, "u long, v long, weight double"), spark.createDataFrame([(0,), (3,)], "node long"))
    assert {r["node"]: (r["distance"], r["source"]) for r in got.collect()} == {0: (0.0, 0), 1: (1.0, 0), 2: (0.5, 3), 3: (0.0, 3)}


def test_knn_order_and_strict_radius(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (2, 0, 1.0, 0.0, 0.0), (3, 0, -1.0, 0.0, 0.0), (4, 0, 2.0, 0.0, 0.0), (5, 1, 0.0, 0.0, 0.0)], "id long, frame long, x double, y double, z double")
    got = {(r["a_id"], r["b_id"]) for r in spatial.knn_in_space(p, 1, 2.0).collect()}
    assert got == {(1, 2), (2, 1), (3, 1), (4, 2)}
    assert {(r["a_id"], r["b_id"]) for r in spatial.knn_forward(p, 9, 2.0).collect()} == {(1, 5), (2, 5), (3, 5)}


def volume(rng, shape=(5, 4, 3), most=9):
    return {(x, y, z): int(rng.integers(0, most)) for x in range(shape[0]) for y in range(shape[1]) for z in range(shape[2])}


def frame(spark, cells):
    rows = [(0, i, *p, v) for i, (p, v) in enumerate(sorted(cells.items(), key=lambda c: c[0][::-1]))]
    return spark.createDataFrame(rows, "frame int, voxel_id long, x int, y int, z int, v long")


def test_watershed_without_persistence_keeps_every_peak(spark):
    cells = {(x, 0, 0): v for x, v in enumerate([1, 5, 2, 7, 3, 3, 9, 1])}
    got = {r["voxel_id"]: r["label"] for r in segment.watershed(frame(spark, cells), 1, 1, 6).collect()}
    assert [got.get(i) for i in range(8)] == [None, 1, 2, 2, 2, 3, 3, None] or len(set(got.values())) == 3
    merged = {r["label"] for r in segment.watershed(frame(spark, cells), 1, 6, 6).collect()}
    assert merged == {1}


def test_dendrogram_heights_and_leaves(spark):
    rng = np.random.default_rng(3)
    cells = volume(rng, (8, 6, 2), 60)
    v = frame(spark, cells)
    labels = {r["label"] for r in segment.watershed(v, 5, 3, 6).collect()} - {0}
    nodes = [r.asDict() for r in segment.dendrogram(v, 5, 3, 6).collect()]
    by = {n["node"]: n for n in nodes}
    assert {n["region"] for n in nodes if n["region"] is not None} == labels
    assert all(by[n["parent"]]["thr"] >= n["thr"] for n in nodes if n["parent"] is not None)
    kids = [sum(m["parent"] == n["node"] for m in nodes) for n in nodes]
    assert set(kids) <= {0, 2} and nodes[0]["parent"] is None
    # merging at least persistence loses regions as the cut rises
    f = segment.dendrogram(v, 5, 3, 6).selectExpr("cast(node as long) id", "cast(parent as long) parent", "thr")
    sizes = [trees.cut_at(f, t).select("node").distinct().count() for t in (3, 20, 60, 70000)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 1


def test_trim_follows_the_brightest(spark):
    rows = [(1, i, i, 0, 0, v) for i, v in enumerate([9, 8, 2, 8, 8, 8])]
    v = spark.createDataFrame(rows, "sv_id long, voxel_id long, x int, y int, z int, v long")
    t = spark.createDataFrame([(1, 5.0)], "sv_id long, threshold double")
    assert sorted(r["voxel_id"] for r in rg.trim(v, t, 6).collect()) == [0, 1]


@pytest.mark.parametrize("n", [4, 8, 6, 26, 74, 75])
def test_offsets_are_symmetric(n):
    o = rg.neighbour_offsets(n)
    assert len(o) == (74 if n == 75 else n) and {tuple(-a for a in p) for p in o} == set(o)


def test_sorted_regions(spark):
    rows = [([],), ([3],), ([1, 2, 9],), ([1, 1],), ([2, 1],)]
    got = spark.createDataFrame(rows, "r array<long>").select("r", rg.is_sorted(__import__("pyspark.sql.functions", fromlist=["col"]).col("r")).alias("s")).collect()
    assert [r["s"] for r in got] == [True, True, True, False, False]


def test_digamma(spark):
    from pyspark.sql import functions as F

    xs = [0.1, 0.5, 1.0, 2.5, 7.9, 8.0, 100.0]
    got = [r["d"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(mixture.digamma(F.col("x")).alias("d")).collect()]
    assert got == pytest.approx(mixture.np_digamma(xs).tolist(), abs=1e-10)
    assert got[2] == pytest.approx(-0.5772156649015329, abs=1e-9)
    h = 1e-5
    assert got[3] == pytest.approx((math.lgamma(2.5 + h) - math.lgamma(2.5 - h)) / (2 * h), abs=1e-6)


def test_regularised_limits():
    w = np.array([[100.0, 0, 0, 1.0, 0, 1e-9], [4.0, 1, 0, 3.0, 0.5, 2.0]])
    out = mixture.regularised(w, 0.01, 10.0, 5.0)
    values = np.linalg.eigvalsh(mixture._full(out))
    assert values.min() >= 0.01 - 1e-12 and values.max() <= 10 + 1e-9
    assert (values[:, 2] / values[:, 0]).max() <= 5 + 1e-9
    same = mixture.regularised(w[1:], 1e-6, 1e6, 1e6)
    assert same == pytest.approx(w[1:])


def test_mixture_separates_two_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, *(rng.normal(0, 0.3, 3) + (5 if i % 2 else 0)).tolist(), 1.0) for i in range(60)]
    vox = spark.createDataFrame(rows, "frame long, sv_id long, x double, y double, z double, v double")
    w = [1.0, 0.0, 0.0, 1.0, 0.0, 1.0]
    gmm = spark.createDataFrame([(0, k, 1.0, 1.0, 5.0, m, w) for k, m in ((7, [1.0, 1.0, 1.0]), (8, [4.0, 4.0, 4.0]))], "frame long, k long, alpha0 double, beta0 double, nu0 double, m0 array<double>, w0 array<double>")
    got = {r["sv_id"]: r["k"] for r in mixture.strongest(mixture.fit(vox, gmm, iterations=50).select("frame", "sv_id", "k", "r")).collect()}
    assert got == {i: 8 if i % 2 else 7 for i in range(60)}


def test_kalman_follows_a_line(spark):
    t = spark.createDataFrame([(1, f, 2.0 * f, -f * 1.0, 0.0) for f in range(30)], "track long, frame long, x double, y double, z double")
    last = max(mixture.kalman(t, 1.0, 1.0).collect(), key=lambda r: r["frame"])
    assert last["filtered"] == pytest.approx([58.0, -29.0, 0.0], abs=0.05)


def test_median_counts_outside_as_zero(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-5, 9, (5, 6))
    v = spark.createDataFrame([(0, x, y, int(a[x, y])) for x in range(5) for y in range(6)], "slice int, x int, y int, v long")
    p = np.pad(a, 1)
    want = {(x, y): sorted(p[x : x + 3, y : y + 3].ravel())[4] for x in range(5) for y in range(6)}
    assert {(r["x"], r["y"]): r["median"] for r in filters.median2d(v, 1).collect()} == want


def test_spectrum_inverts(spark):
    v = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([3, 1, 4, 1, 5, 9, 2, 6])], "line int, x int, v double")
    f = {r["k"]: complex(r["re"], r["im"]) for r in filters.spectrum(v, ["line"], "x").collect()}
    assert [f[k] for k in range(8)] == pytest.approx(np.fft.fft([3, 1, 4, 1, 5, 9, 2, 6]).tolist())


def test_distance_to_background(spark):
    g = spark.createDataFrame([(x, 0, 0, 0 if x in (0, 9) else 1) for x in range(10)], "x int, y int, z int, v int")
    assert {r["x"]: r["d2"] for r in filters.distance_to_background(g, 3).collect()} == {1: 1.0, 2: 4.0, 3: 9.0, 4: None, 5: None, 6: 9.0, 7: 4.0, 8: 1.0}


def test_kernels():
    assert sum(filters.gaussian_kernel(1.5, 4)) == pytest.approx(1)
    assert sum(filters.log_kernel(1.5, 4)) == pytest.approx(0, abs=1e-12)
    assert sum(filters.dog_kernel(1, 2, 5)) == pytest.approx(0, abs=1e-12)


def test_healpix_has_equal_pixels():
    rng = np.random.default_rng(2)
    x, y, z = rng.normal(size=(3, 60000))
    for nside in (1, 2, 4):
        n = np.bincount(features.healpix_nest(x, y, z, nside), minlength=12 * nside * nside)
        assert len(n) == 12 * nside * nside and n.min() > 0.8 * n.mean()


def test_boosting_learns_a_threshold(spark):
    rows = [(i, float(i), float(i % 3), 1.0 if i > 20 else -1.0) for i in range(50)]
    s = spark.createDataFrame(rows, "id long, a double, b double, y double")
    model = features.gentle_boost(s, ["a", "b"], 2)
    from pyspark.sql import functions as F

    scored = features.boosting_score(s.withColumn("features", F.array("a", "b")), model)
    assert scored.filter("score * y <= 0").count() == 0
    a, b = features.platt(scored)
    p = features.calibrated(scored, (a, b))
    assert p.filter("(probability > 0.5) <> (y > 0)").count() == 0


def test_hysteresis_spreads_both_ways(spark):
    score = [0.1, 0.5, 0.9, 0.5, 0.5, 0.1, 0.5, -1.0, 0.95]
    b = spark.createDataFrame([(i, 1, i, s) for i, s in enumerate(score)], "id long, branch long, place long, score double")
    got = {r["id"]: r["kept"] for r in trees.hysteresis(b, 0.3, 0.8).collect()}
    assert [got[i] for i in range(9)] == [True, False, False, False, False, True, False, False, False]


def test_insert_children_and_paste(spark):
    n = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 1, 1), (4, 2, 2)], "id long, parent long, frame long")
    new = spark.createDataFrame([(9, 1, 1), (10, 2, 2), (11, 2, 2)], "id long, parent long, frame long")
    assert sorted(r["id"] for r in trees.insert_children(n, new).collect()) == [1, 2, 3, 4, 10]
    cut = trees.cut_sublineages(n, spark.createDataFrame([(2,)], "id long"), 5)
    back = trees.paste_sublineages(n, cut, 5)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, n.collect()), key=str)


def test_suggestions_and_collapse(spark):
    tree = spark.createDataFrame([(0, None, 9.0), (1, 0, 4.0), (2, 0, 0.0), (3, 1, 0.0), (4, 1, 0.0)], "node long, parent long, thr double")
    vox = {0: range(30), 1: range(20), 2: range(20, 30), 3: range(12), 4: range(12, 20)}
    v = spark.createDataFrame([(n, i) for n, r in vox.items() for i in r], "node long, voxel_id long")
    m = segment.suggest_merge(v, tree, 5.0)
    assert {r["node"]: r["into"] for r in m.collect()} == {3: 1, 4: 1}
    assert [(r["node"], round(r["score"], 3)) for r in segment.suggest_split(m, tree).collect()] == [(1, 0.4)]
    chain = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1), (4, 3)], "id long, parent long")
    assert {r["id"]: r["parent"] for r in segment.collapse_single_children(chain).collect()} == {0: None, 2: 0, 4: 0}


def test_nearest_seed_in_cubes(spark):
    rng = np.random.default_rng(8)
    from tracelet.operators import spatial

    p = [(i, *map(float, x)) for i, x in enumerate(rng.normal(size=(150, 3)) ** 3 * 4)] + [(200, None, 0.0, 0.0), (201, 900.0, 0.0, 0.0)]
    seeds = [(i, *map(float, x)) for i, x in enumerate(rng.normal(size=(25, 3)))] + [(30, None, 1.0, 1.0)]
    a = spark.createDataFrame(p, "id long, x double, y double, z double")
    b = spark.createDataFrame(seeds, "seed_id long, x double, y double, z double")
    both = [{r["id"]: r["seed_id"] for r in spatial.nearest_seed(a, b, few=few).collect()} for few in (1024, 1)]
    want = {i: min((sum((u - v) ** 2 for u, v in zip(x, s)), k) for k, *s in seeds if s[0] is not None)[1] for i, *x in p if x[0] is not None}
    assert both == [want, want] and spatial.nearest_seed(a.limit(0), b, few=1).count() == 0


def test_dendrograms_and_boosting(spark):
    from tracelet.operators import features

    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.integers(0, 9, 2))) for i in range(80)]
    rows = [(i, a, b, 3.0 * (a > 4) + 2.0 * (a > 4 and b > 2)) for i, a, b in rows]
    s = spark.createDataFrame(rows, "id long, a double, b double, y double")
    for loss in ("l2", "l1", "huber"):
        model = features.gradient_boost(s, ["a", "b"], 6, depth=2, rate=1.0, loss=loss)
        got = {r["id"]: r["score"] for r in features.boosting_score(s.withColumn("features", F.array("a", "b")), model).collect()}
        assert max(abs(got[i] - y) for i, _, _, y in rows) < (1e-9 if loss == "l2" else 1.01)
