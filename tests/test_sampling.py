import math

import pytest
from pyspark.sql import functions as F

from tracelet.operators import sampling, trees


def test_moments_of_draws(spark):
    n = spark.range(40000)
    made = n.select(
        sampling.uniform(2, 4, 1).alias("u"), sampling.normal(3, 2, 2).alias("n"), sampling.exponential(0.5, 3).alias("e"), sampling.bernoulli(0.25, 4).alias("b"),
        sampling.geometric(0.25, 5).alias("g"), sampling.binomial(8, 0.5, 6).alias("k"), sampling.poisson(3.5, 7).alias("p"),
    )
    r = made.agg(*[F.avg(c).alias(c) for c in "unebgkp"], F.var_samp("p").alias("vp")).collect()[0]
    for c, want in (("u", 3), ("n", 3), ("e", 2), ("b", 0.25), ("g", 3), ("k", 4), ("p", 3.5), ("vp", 3.5)):
        assert r[c] == pytest.approx(want, rel=0.05), c


def test_matrix_draws_and_densities(spark):
    w = F.array(*[F.lit(x) for x in (2.0, 0.5, 0.0, 1.0, 0.0, 4.0)])
    d = spark.range(4000).select("id", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("m"), w.alias("w"), F.lit(6.0).alias("nu"), F.lit(4.0).alias("a"), F.lit(2.0).alias("b"))
    g = sampling.gamma(d, "a", "b", 1).agg(F.avg("draw").alias("x")).collect()[0]["x"]
    assert g == pytest.approx(2, rel=0.05)
    x = sampling.multinormal(d, "m", "w", 2).agg(F.avg(F.col("draw")[2]).alias("m"), F.var_samp(F.col("draw")[2]).alias("v")).collect()[0]
    assert x["m"] == pytest.approx(3, rel=0.05) and x["v"] == pytest.approx(0.25, rel=0.1)
    s = sampling.wishart(d, "w", "nu", 3).agg(F.avg(F.col("draw")[0]).alias("xx"), F.avg(F.col("draw")[1]).alias("xy")).collect()[0]
    assert s["xx"] == pytest.approx(12, rel=0.05) and s["xy"] == pytest.approx(3, rel=0.15)
    one = d.limit(1).select(sampling.multinormal_log_density([F.lit(1.0), F.lit(2.0), F.lit(3.0)], F.col("m"), F.col("w")).alias("n"), sampling.wishart_log_density(F.col("w"), F.col("w"), F.col("nu")).alias("w")).collect()[0]
    det = 4 * (2 * 1 - 0.25)
    assert one["n"] == pytest.approx(0.5 * math.log(det) - 1.5 * math.log(2 * math.pi))
    lg = 1.5 * math.log(math.pi) + sum(math.lgamma((6 - j) / 2) for j in range(3))
    assert one["w"] == pytest.approx(math.log(det) - 1.5 - 3 * math.log(det) - 9 * math.log(2) - lg)


def test_dead_nuclei_go_on(spark):
    nodes = spark.createDataFrame([(1, None, 0), (2, None, 0), (3, None, 0), (4, 3, 1)], "id long, parent long, frame long")
    owners = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (22, 4)], "sv_id long, id long")
    overlaps = spark.createDataFrame([(10, 20, 5), (11, 20, 7), (10, 21, 2), (12, 22, 9)], "a long, b long, n_common long")
    assert [tuple(r) for r in trees.extend_dead(nodes, owners, overlaps, 0).collect()] == [(2, 20, 7, None)]
    more = overlaps.union(spark.createDataFrame([(10, 22, 8)], "a long, b long, n_common long"))
    assert sorted(tuple(r) for r in trees.extend_dead(nodes, owners, more, 0).collect()) == [(1, 22, 8, 4), (2, 20, 7, None)]


def test_event_neighbourhoods(spark):
    nodes = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 2, 2), (5, None, 0), (6, 5, 1), (9, None, 0)], "id long, parent long, frame long")
    near = spark.createDataFrame([(6, 2), (2, 3)], "a_id long, b_id long")
    got = {}
    for r in trees.event_neighbourhoods(nodes, near, 1).collect():
        got.setdefault(r["event"], set()).add(r["id"])
    assert got == {6: {5, 6, 2, 3}, 9: {9}}


def test_division_of_nuclei_in_parts(spark):
    owners = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (20, 2), (21, 2), (30, 3), (31, 3)], "sv_id long, id long")
    touches = spark.createDataFrame([(10, 11, 12), (20, 21, 3), (30, 31, 50)], "a long, b long, n_border long")
    parts = trees.separated_parts(owners, touches, 10)
    assert {(r["sv_id"], r["part"], r["n_parts"]) for r in parts.collect()} == {(10, 10, 2), (11, 10, 2), (12, 12, 2), (20, 20, 2), (21, 21, 2), (30, 30, 1), (31, 30, 1)}
    nodes = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 0.0), (2, None, 1, 0.0, 0.0, 0.0), (0, None, 0, 0.0, 0.0, 0.0)], "id long, parent long, frame long, x double, y double, z double")
    centres = spark.createDataFrame([(10, 1.0, 0.0, 0.0), (12, -1.0, 0.0, 0.0), (20, 1.0, 0.0, 0.0), (21, 2.0, 0.0, 0.0)], "part long, x double, y double, z double")
    got = {(r["id"], r["part"]): r["role"] for r in trees.detect_divisions(nodes, parts, centres).collect()}
    assert got == {(1, 10): "first", (1, 12): "second", (2, 20): "first", (2, 21): "second"}
