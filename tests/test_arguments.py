import heapq
from collections import defaultdict

from tracelet.plans import carriers, registry

SMALL = "/root/testdata/sf0.001"


def seeds(points):
    least = {}
    for p in points:
        k = p["frame"], p["label"]
        least[k] = min(p["id"], least.get(k, p["id"]))
    return set(least.values())


def test_paths_start_from_one_of_each_label_and_frame(spark):
    points = carriers.points(spark, SMALL).collect()
    near = defaultdict(list)
    for a in points:
        for b in points:
            d2 = sum((a[c] - b[c]) ** 2 for c in "xyz")
            if a["frame"] == b["frame"] and a["id"] != b["id"] and d2 < 0.01:
                near[a["id"]].append((b["id"], d2**0.5))
    want, todo = {}, [(0.0, s, s) for s in seeds(points)]
    heapq.heapify(todo)
    while todo:
        d, s, i = heapq.heappop(todo)
        if i not in want:
            want[i] = round(d, 6), s
            for j, w in near[i]:
                heapq.heappush(todo, (d + w, s, j))
    got = {r["node"]: (r["distance"], r["source"]) for r in registry.QUERIES["shortest_paths"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i][0]) < 2e-6 and got[i][1] == want[i][1] for i in want)


def test_mixture_has_a_component_for_each_label_and_frame(spark):
    wanted = seeds(carriers.points(spark, SMALL).collect())
    got = {r["k"] for r in registry.QUERIES["mixture_fit"](spark, SMALL).collect()}
    assert got and got <= wanted and len(got) > len([i for i in wanted if i < 60])
