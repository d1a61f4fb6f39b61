import itertools

import numpy as np
import pytest

from tracelet.functions import minimise
from tracelet.operators import programme


@pytest.mark.parametrize("seed", [1, 2])
def test_best_links_against_all_choices(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(a, 10 + b, float(rng.random()), 1) for a in range(3) for b in range(4) if rng.random() < 0.8]
    cand = spark.createDataFrame(rows, "a_id long, b_id long, d2 double, rank int")
    k = programme.links(cand, 0.6, 0.2)
    columns = [tuple(r) for r in k.select("edge", "parent", "child1", "child2", "cost").collect()]
    best = 0.0
    for n in range(4):
        for chosen in itertools.combinations(columns, n):
            ends = [x for _, p, a, b, _ in chosen for x in ((p, "p"), (a, "c"), *([(b, "c")] if b is not None else []))]
            if len(set(ends)) == len(ends):
                best = min(best, sum(x[4] for x in chosen))
    cost = {e: x for e, _, _, _, x in columns}
    got = [r["edge"] for r in programme.best_choice(cand, 0.6, 0.2).collect()]
    assert sum(cost[e] for e in got) == pytest.approx(best)
    likely = [r["edge"] for r in programme.likely_choice(k, seed, 0.3).collect()]
    assert programme.flow_faults(k, programme.likely_choice(k, seed, 0.3)).count() == 0 and sum(cost[e] for e in likely) >= best - 1e-9


def test_minimisers():
    assert minimise.least_1d(lambda x: (x - 3) ** 2, 0.0, 1.0) == pytest.approx(3, abs=1e-6)
    assert minimise.powell(lambda v: (v[0] - 1) ** 2 + 10 * (v[1] - v[0] ** 2) ** 2, [-1.0, 2.0]) == pytest.approx([1, 1], abs=1e-3)
    assert minimise.root(lambda x: x**3 - 2, 0.0, 2.0) == pytest.approx(2 ** (1 / 3))
    with pytest.raises(ValueError):
        minimise.root(lambda x: x * x + 1, 0.0, 1.0)
