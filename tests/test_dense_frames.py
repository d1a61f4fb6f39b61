"""Queries of nearest neighbours on frames most of whose points lie within the radius of each other."""

import random

import pytest
from conftest import compare

from tracelet.operators import spatial
from tracelet.plans import registry

N = 3000


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    rng = random.Random(3)

    def vector(i):
        if i % 10 == 0:
            return [0.25, 0.0 if i % 20 else -0.0, 0.125, 0.5]  # one place
        if i % 10 == 1:
            return [0.125 * rng.randrange(4) for _ in range(4)]  # many at the same distance
        if i % 10 == 2:
            return [0.1 + rng.gauss(0, 1e-4) for _ in range(4)]
        return [rng.gauss(0, 2 if i % 100 == 3 else 0.13) for _ in range(4)]

    folder = tmp_path_factory.mktemp("dense")
    rows = [(i, vector(i), rng.randrange(10)) for i in range(N)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").toPandas().to_parquet(folder / "embeddings.parquet")
    return str(folder)


def rows_joined(spark, run):
    """The most rows that a join makes in a run."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, executions = 0, store.executionsList()
    for k in range(before, executions.size()):
        at = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for i in range(nodes.size()):
            if "Join" in nodes.apply(i).name():
                metrics = nodes.apply(i).metrics()
                for j in range(metrics.size()):
                    m = metrics.apply(j)
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("name", ["death_ratio", "death_then_division", "neighbour_division"])
def test_joins_grow_with_the_nodes(spark, dense, name):
    found = []
    most = rows_joined(spark, lambda: found.append(compare(spark, registry.QUERIES[name], registry.SQL[name], dense)))
    got, want = found[0]
    assert got == want
    assert 0 < most < 20 * N


@pytest.mark.parametrize("radius", [0.05, 0.6, 9.0])
def test_nearest_is_that_of_knn(spark, radius):
    rng, rows = random.Random(5), []
    for frame in range(3):
        rows += [(frame, *(rng.gauss(0, 0.15) for _ in range(3))) for _ in range(200)]
        rows += [(frame, *(0.1 + rng.gauss(0, 1e-6) for _ in range(3))) for _ in range(100)]
        rows += [(frame, 0.25, rng.choice([0.0, -0.0]), 0.5) for _ in range(80)]
        rows += [(frame, *(0.125 * rng.randrange(5) for _ in range(3))) for _ in range(150)]
        rows += [(frame, *(rng.gauss(0, 5) for _ in range(3))) for _ in range(20)]
        rows += [(frame, float("nan"), 0.0, 0.0), (frame, None, 0.0, 0.0), (frame, 1e15, 0.0, 0.0), (frame, 1e15 + 0.125, 0.0, 0.0)]
    rng.shuffle(rows)
    points = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, frame long, x double, y double, z double")
    want, got = [sorted(map(tuple, df.select("a_id", "b_id", "d2", "rank").collect())) for df in (spatial.knn_in_space(points, 1, radius), spatial.nearest_in_space(points, radius))]
    assert got == want
