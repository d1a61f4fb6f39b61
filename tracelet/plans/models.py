"""Queries of mixtures between frames, samplers, learning, linear algebra and pictures, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracelet.functions import geometry
from tracelet.operators import features, filters, graph, linear, mixture, sampling, segment, spatial, trees
from tracelet.operators import regions as rg
from tracelet.plans import carriers as c
from tracelet.plans.catalog import EDGES, SAMPLES, TREE, TREES_OF_STUMPS, _edges, _mixture, _samples, query, rounded
from tracelet.plans.durable import shared_folder

# mixtures

GMM = f"""{c.POINTS}, gmm as (select frame, id as k, 0.5::double + id % 7 as alpha, 1.0::double + id % 3 as beta, 4.0::double + id % 5 as nu, x, y, z, 4.0::double + id % 11 as wx, 3.0::double + id % 4 as wy, 2.0::double as wz, 0.5::double as wxy, (id % 9) * 1.5::double as n_k from points),
det as (select *, wz * (wx * wy - wxy * wxy) as det from gmm)"""


def _gmm(spark, d):
    p, i = c.points(spark, d), F.col("id")
    w = F.array(4.0 + i % 11, F.lit(0.5), F.lit(0.0), 3.0 + i % 4, F.lit(0.0), F.lit(2.0))
    return p.select("frame", i.alias("k"), (0.5 + i % 7).alias("alpha"), (1.0 + i % 3).alias("beta"), (4.0 + i % 5).alias("nu"), F.array("x", "y", "z").alias("m"), w.alias("w"), ((i % 9) * 1.5).alias("n_k"), F.lit(1.0).alias("alpha0"))


def _psi(x: str) -> str:
    y = f"(({x}) + 10)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8) - list_sum(list_transform(range(0, 10), lambda i: 1 / (({x}) + i))))"


@query("expectations", f"with {GMM} select frame, k, round({_psi('alpha')} - {_psi('total')}, 6) as e_log_pi, round({_psi('nu / 2')} + {_psi('(nu - 1) / 2')} + {_psi('(nu - 2) / 2')} + 3 * ln(2) + ln(det), 6) as e_log_det from (select *, sum(alpha) over (partition by frame) as total from det)")
def expectations(spark, d):
    return rounded(mixture.with_expectations(_gmm(spark, d)).select("frame", "k", "e_log_pi", "e_log_det"), "e_log_pi", "e_log_det")


@query(
    "responsibilities",
    f"""with {GMM}, e as (select *, {_psi('alpha')} - {_psi('total')} as pi_, {_psi('nu / 2')} + {_psi('(nu - 1) / 2')} + {_psi('(nu - 2) / 2')} + 3 * ln(2) + ln(det) as dt from (select *, sum(alpha) over (partition by frame) as total from det)),
near as (select p.frame, p.id, s.id as k, p.x - s.x as dx, p.y - s.y as dy, p.z - s.z as dz, row_number() over (partition by p.id order by (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) + (p.z - s.z) * (p.z - s.z), s.id) as rn from points p join points s on s.frame = p.frame),
t as (select n.frame, n.id as sv_id, n.k, pi_ + dt / 2 - (3 / beta + nu * (wx * dx * dx + wy * dy * dy + wz * dz * dz + 2 * wxy * dx * dy)) / 2 as s from near n join e using (frame, k) where rn <= 3 and dx * dx + dy * dy + dz * dz < 1.44)
select frame, sv_id, k, round(exp(s) / sum(exp(s)) over (partition by frame, sv_id), 6) as r from t""",
)
def responsibilities(spark, d):
    """Components of unequal weight, trust and shape, so that every expectation counts."""
    voxels, _, cand = _mixture(spark, d, lambda p: p)
    return rounded(mixture.e_step(voxels, _gmm(spark, d), cand).select("frame", "sv_id", "k", "r"), "r")


@query("dead_components", f"with {GMM} select frame, k, case when alpha / total < 1e-5 or k % 13 = 0 then 0::double else alpha end as alpha, alpha / total >= 1e-5 and k % 13 <> 0 as alive from (select *, sum(alpha) over (partition by frame) as total from gmm)")
def dead_components(spark, d):
    g = _gmm(spark, d).withColumn("w", F.when(F.col("k") % 13 != 0, F.col("w")))
    return mixture.kill_dead(g).select("frame", "k", "alpha", F.col("m").isNotNull().alias("alive"))


@query("next_priors", f"with {GMM} select frame, k, round(sum(alpha) over (partition by frame) * 0.8e-5, 12) as alpha0, greatest(0.1 * n_k, 1e-5) as beta0, round(greatest(0.5 * n_k, 3), 6) as nu0, round(wx * nu / greatest(0.5 * n_k, 3), 6) as wxx from gmm")
def next_priors(spark, d):
    g = mixture.update_priors(_gmm(spark, d), 0.8, 0.1, 0.5)
    return rounded(rounded(g.select("frame", "k", "alpha0", "beta0", "nu0", F.col("w0")[0].alias("wxx")), "nu0", "wxx"), "alpha0", places=12)


@query("split_priors", f"with {GMM} select frame, k, 1.0::double as alpha0, greatest(0.5 * n_k, 1e-5) as beta0, greatest(0.5 * n_k, 3) as nu0, round(wx * nu / greatest(0.5 * n_k, 3), 6) as wxx, x as mx from gmm")
def split_priors(spark, d):
    return rounded(mixture.priors_after_split(_gmm(spark, d)).select("frame", "k", "alpha0", "beta0", "nu0", F.col("w0")[0].alias("wxx"), F.col("m0")[0].alias("mx")), "wxx")


@query("copied_priors", f"with {GMM} select frame, k, beta as beta0, nu as nu0, wx as wxx, y as my from gmm")
def copied_priors(spark, d):
    return mixture.priors_as_found(_gmm(spark, d)).select("frame", "k", "beta0", "nu0", F.col("w0")[0].alias("wxx"), F.col("m0")[1].alias("my"))


@query("model_penalty", f"with {GMM}, l as (select frame, alpha / sum(alpha) over (partition by frame) as share from gmm) select frame, round(5 * sum(ln(1000 * share / 12)) + count(*) / 2 * ln(1000.0 / 12) + count(*) * 5.5, 4) as penalty from l group by frame")
def model_penalty(spark, d):
    return rounded(mixture.model_penalty(_gmm(spark, d), F.lit(1000.0)), "penalty", places=4)


RESP = "resp as (select frame, id as sv_id, case when id % 2 = 0 then label else label + 1 end as k, 0.25 + 0.5 * (id % 2) as r from points union all select frame, id, label + 2, 0.75 - 0.5 * (id % 2) from points)"


def _resp(p):
    i = F.col("id")
    one = p.select("frame", i.alias("sv_id"), F.when(i % 2 == 0, F.col("label")).otherwise(F.col("label") + 1).alias("k"), (0.25 + 0.5 * (i % 2)).alias("r"))
    return one.union(p.select("frame", i, F.col("label") + 2, 0.75 - 0.5 * (i % 2)))


@query("component_links", f"with {c.POINTS}, {RESP}, b as (select frame, sv_id, arg_max(k, (r, -k)) as best from resp group by 1, 2) select r.frame, r.sv_id, r.k, b.best from resp r join b using (frame, sv_id) where r.r > 0.5")
def component_links(spark, d):
    r = _resp(c.points(spark, d))
    return mixture.hard_links(r, 0.5).join(mixture.strongest(r, 0.3).withColumnRenamed("k", "best"), ["frame", "sv_id"])


KIND = f"{c.POINTS}, {RESP}, kg as (select frame, label as k, avg(x) as mx, avg(y) as my, avg(z) as mz, 1.0 + label as alpha from points group by 1, 2), vox as (select frame, id as sv_id, x, y, z, v + 0.01 as v from points)"


def _kinds(p):
    g = p.groupBy("frame", "label").agg(F.array(F.avg("x"), F.avg("y"), F.avg("z")).alias("m"))
    return g.select("frame", F.col("label").alias("k"), (1.0 + F.col("label")).alias("alpha"), F.lit(5.0).alias("nu"), "m", F.array(*[F.lit(x) for x in (4.0, 0.0, 0.0, 3.0, 0.0, 2.0)]).alias("w"))


QUAD = "5 * (4 * (x - mx) ** 2 + 3 * (y - my) ** 2 + 2 * (z - mz) ** 2)"


@query("divergence", f"with {KIND} select r.frame, r.k, round(sum(r * v * (ln(r * v) - (0.5 * ln(24 * 125.0) - 1.5 * ln(2 * pi()) - 0.5 * {QUAD}))) / sum(r * v) - ln(sum(r * v)), 5) as split_score from resp r join kg using (frame, k) join vox using (frame, sv_id) group by 1, 2")
def divergence(spark, d):
    p = c.points(spark, d)
    return rounded(mixture.divergence(_voxels(p), _resp(p), _kinds(p)), "split_score", places=5)


def _voxels(p):
    return p.select("frame", F.col("id").alias("sv_id"), "x", "y", "z", (F.col("v") + 0.01).alias("v"))


@query(
    "pair_divergence",
    f"""with {KIND}, pr as (select a.frame, a.k as k1, b.k as k2 from kg a join kg b on a.frame = b.frame and b.k = a.k + 1), held as (select p.frame, p.k1, p.k2, r.sv_id, sum(r.r) as r from pr p join resp r on r.frame = p.frame and r.k in (p.k1, p.k2) group by 1, 2, 3, 4),
dens as (select h.frame, h.k1, h.k2, h.sv_id, any_value(h.r * v) as q, sum(alpha / (2.0 + k1 + 1.0 + k2 - 1.0) * sqrt(24 * 125.0) * (2 * pi()) ** -1.5 * exp(-0.5 * {QUAD})) as p from held h join vox using (frame, sv_id) join kg on kg.frame = h.frame and kg.k in (h.k1, h.k2) group by 1, 2, 3, 4)
select frame, k1, k2, round(sum(q * (ln(q) - ln(p))) / sum(q) - ln(sum(q)), 5) as score from dens group by 1, 2, 3""",
)
def pair_divergence(spark, d):
    p = c.points(spark, d)
    g = _kinds(p)
    pairs = g.select("frame", F.col("k").alias("k1"), (F.col("k") + 1).alias("k2")).join(g.select("frame", F.col("k").alias("k2")), ["frame", "k2"])
    return rounded(mixture.pair_divergence(_voxels(p), _resp(p), g, pairs), "score", places=5)


@query("components_of_nuclei", f"with {c.POINTS}, m as (select frame, label as id, sum(v) as n, sum(v * x) / sum(v) as mx, sum(v * x * x) / sum(v) - (sum(v * x) / sum(v)) ** 2 as sxx from points group by 1, 2 having count(*) > 4) select frame, row_number() over (partition by frame order by id) - 1 as k, id, round(n, 6) as alpha, round(greatest(n, 4), 6) as nu, round(mx, 6) as mx, round(sxx, 6) as sxx from m")
def components_of_nuclei(spark, d):
    """The covariance that a component's precision nu * w stands for, of nuclei of more than four points."""
    p = c.points(spark, d)
    p = p.join(p.groupBy("frame", "label").agg(F.count("*").alias("size")).filter("size > 4"), ["frame", "label"])
    m = rg.precision(rg.weighted_moments(p, "frame", "label")).withColumnRenamed("label", "id")
    g = mixture.from_nuclei(m)
    back = geometry.inverse(F.transform("w", lambda x: x * F.col("nu")))[0]
    return rounded(g.select("frame", "k", "id", "alpha", "nu", F.col("m")[0].alias("mx"), back.alias("sxx")), "alpha", "nu", "mx", "sxx")


# symmetric matrices: those of second moments by label

MOMENT = f"{c.POINTS}, mo as (select label, avg(x * x) as a, avg(x * y) as b, avg(x * z) as c, avg(y * y) as d, avg(y * z) as e, avg(z * z) as f from points group by label), q as (select *, (a + d + f) / 3 as q from mo), pp as (select *, sqrt(((a - q) ** 2 + (d - q) ** 2 + (f - q) ** 2 + 2 * (b * b + c * c + e * e)) / 6) as p from q), rr as (select *, greatest(-1, least(1, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - c * e) + c * (b * e - c * (d - q))) / (2 * p ** 3))) as r from pp)"
ROOTS = ["q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3)", "q + 2 * p * cos(acos(r) / 3 + 4 * pi() / 3)", "q + 2 * p * cos(acos(r) / 3)"]


def _moments(spark, d):
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return c.points(spark, d).groupBy("label").agg(F.array(*[F.avg(F.col(a) * F.col(b)) for a, b in pairs]).alias("w"))


@query("eigenvalues", f"with {MOMENT} select label, {', '.join(f'round({r}, 8) as e{i}' for i, r in enumerate(ROOTS))} from rr")
def eigenvalues(spark, d):
    """The closed form for three rows, in SQL."""
    e = mixture.eigen3(_moments(spark, d))
    return rounded(e.select("label", *[F.col("eigenvalues")[i].alias(f"e{i}") for i in range(3)]), "e0", "e1", "e2", places=8)


@query("principal_direction", f"with {MOMENT} select label, round(({ROOTS[2]}) / (a + d + f), 6) as share, true as exact from rr")
def principal_direction(spark, d):
    """exact: the matrix leaves the direction as it is but for its length."""
    p = linear.principal_direction(c.points(spark, d), "label").join(_moments(spark, d), "label")
    v, w = F.col("direction"), F.col("w")
    rows = [w[a] * v[0] + w[b] * v[1] + w[e] * v[2] for a, b, e in ((0, 1, 2), (1, 3, 4), (2, 4, 5))]
    value = F.col("share") * (w[0] + w[3] + w[5])
    off = [F.abs(r - value * v[i]) < 1e-9 for i, r in enumerate(rows)]
    return rounded(p.select("label", "share", (off[0] & off[1] & off[2]).alias("exact")), "share")


@query("regularised", f"with {MOMENT}, l as (select label, {', '.join(f'greatest(0.09, least(0.12, {r})) as e{i}' for i, r in enumerate(ROOTS))} from rr) select label, round(e0 + e1 + e2, 8) as trace, round(e0 * e1 * e2, 8) as det from l")
def regularised(spark, d):
    """Eigenvalues kept to a range; the eccentricity allowed is never reached."""
    w = F.col("w")
    r = mixture.regularise(_moments(spark, d), 0.09, 0.12, 1e6)
    return rounded(r.select("label", (w[0] + w[3] + w[5]).alias("trace"), geometry.determinant(w).alias("det")), "trace", "det", places=8)


@query("split_components", f"with {c.POINTS}, h as (select unnest([0, 1]) as half) select frame, id as k, half, 1.0::double as alpha, round(x + (2 * half - 1) / sqrt(5.0), 6) as mx, y as my from points, h where id % 3 = 0")
def split_components(spark, d):
    g = c.points(spark, d).filter("id % 3 = 0").select("frame", F.col("id").alias("k"), F.lit(2.0).alias("alpha"), F.lit(5.0).alias("nu"), F.array("x", "y", "z").alias("m"), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 3.0, 0.0, 2.0)]).alias("w"))
    return rounded(mixture.split(g).select("frame", "k", "half", "alpha", F.col("m")[0].alias("mx"), F.col("m")[1].alias("my")), "mx")


# samplers and densities

DRAWS = {"uniform": (2.5, 0.75), "normal": (1.0, 4.0), "exponential": (0.5, 0.25), "bernoulli": (0.3, 0.21), "geometric": (3.0, 12.0), "weights": (1.1, 0.49), "binomial": (3.0, 2.1), "poisson": (4.0, 4.0), "gamma": (1.5, 0.75)}


@query("draw_moments", "select * from (values " + ", ".join(f"('{n}', true, true)" for n in DRAWS) + ") t(name, mean_fits, variance_fits)")
def draw_moments(spark, d):
    """Mean and variance of draws for each event, each within 5 % and a little of what the distribution says."""
    n = c.table(spark, d, "events").select(F.col("event_id").alias("id")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("id", F.col("id") * 100 + F.col("copy"))
    s = sampling
    n = n.select("id", s.uniform(1, 4, 1).alias("uniform"), s.normal(1, 2, 2).alias("normal"), s.exponential(2, 3).alias("exponential"), s.bernoulli(0.3, 4).alias("bernoulli"), s.geometric(0.25, 5).alias("geometric"), s.from_weights([2, 5, 3], 6).alias("weights"), s.binomial(10, 0.3, 7).alias("binomial"), s.poisson(4, 8).alias("poisson"))
    n = s.gamma(n.withColumns({"a": F.lit(3.0), "b": F.lit(2.0)}), "a", "b", 9, name="gamma")
    m = n.agg(*[F.array(F.avg(x), F.var_samp(x)).alias(x) for x in DRAWS])
    fits = lambda got, want: F.abs(got - want) < 0.05 * abs(want) + 0.02
    return m.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), fits(F.col(x)[0], mean).alias("mean_fits"), fits(F.col(x)[1], var).alias("variance_fits")) for x, (mean, var) in DRAWS.items()])).alias("r")).select("r.*")


@query("vector_draws", "select true as mean_fits, true as covariance_fits, true as wishart_fits")
def vector_draws(spark, d):
    """Normal vectors of precision diag(4, 1, 1) with 1 off it, and Wishart matrices, against what they are drawn from."""
    n = spark.range(20_000).withColumns({"m": F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), "p": F.array(*[F.lit(x) for x in (4.0, 1.0, 0.0, 1.0, 0.0, 1.0)]), "nu": F.lit(6.0)})
    n = sampling.wishart(sampling.multinormal(n, "m", "p", 1, name="v"), "p", "nu", 2, name="s")
    v, s = F.col("v"), F.col("s")
    near = lambda got, want: F.abs(got - want) < 0.05 * abs(want) + 0.05
    return n.agg((near(F.avg(v[0]), 1.0) & near(F.avg(v[2]), 3.0)).alias("mean_fits"), (near(F.var_samp(v[0]), 1 / 3) & near(F.covar_samp(v[0], v[1]), -1 / 3) & near(F.var_samp(v[1]), 4 / 3)).alias("covariance_fits"), (near(F.avg(s[0]), 24.0) & near(F.avg(s[1]), 6.0) & near(F.avg(s[5]), 6.0)).alias("wishart_fits"))


@query(
    "log_densities",
    f"with {c.POINTS} select id, round(0.5 * ln(24.0) - 1.5 * ln(2 * pi()) - 0.5 * (4 * x * x + 3 * y * y + 2 * z * z), 6) as normal, round(0.5 * (6.5 - 4) * ln((1 + abs(x)) * 2 * 3) - 0.5 * ((1 + abs(x)) / 4 + 2.0 / 3 + 3.0 / 2) - 3.25 * ln(24.0) - 6.5 * 1.5 * ln(2) - 1.5 * ln(pi()) - lgamma(3.25) - lgamma(2.75) - lgamma(2.25), 6) as wishart from points",
)
def log_densities(spark, d):
    scale, zero = F.array(*[F.lit(x) for x in (4.0, 0.0, 0.0, 3.0, 0.0, 2.0)]), F.array(*[F.lit(0.0)] * 3)
    w = F.array(1 + F.abs("x"), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(3.0))
    normal = sampling.multinormal_log_density([F.col(a) for a in "xyz"], zero, scale)
    return rounded(c.points(spark, d).select("id", normal.alias("normal"), sampling.wishart_log_density(w, scale, F.lit(6.5)).alias("wishart")), "normal", "wishart")


# learning


@query("losses", f"with {SAMPLES}, r as (select y, chars / 1000 - y as r from samples) select y::double as y, round(sum(abs(r)), 4) as l1, round(sum(case when abs(r) <= 1.5 then 0.5 * r * r else 1.5 * (abs(r) - 0.75) end), 4) as huber from r group by y")
def losses(spark, d):
    r = F.col("chars") / 1000 - F.col("y")
    huber = F.sum(F.when(F.abs(r) <= 1.5, 0.5 * r * r).otherwise(1.5 * (F.abs(r) - 0.75)))
    return rounded(_samples(spark, d).groupBy("y").agg(features.loss_l1(r).alias("l1"), huber.alias("huber")), "l1", "huber", places=4)


@query("complete_samples", f"with {SAMPLES} select doc_id from samples where chars < 1000 and words < 150")
def complete_samples(spark, d):
    x = F.array(F.when(F.col("chars") < 1000, F.col("chars")), F.when(F.col("words") < 150, F.col("words")).otherwise(F.lit(float("nan"))))
    return features.drop_incomplete(_samples(spark, d).withColumn("features", x)).select("doc_id")


@query("saved_model", "select tree, node, feature, th::double as th, value::double as value, gt, le from (values " + ", ".join(str(r) for r in TREES_OF_STUMPS) + ") t(tree, node, feature, th, value, gt, le)")
def saved_model(spark, d):
    at = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    features.save_model(spark, TREES_OF_STUMPS, at)
    return spark.createDataFrame(features.load_model(spark, at), features.MODEL)


@query(
    "gradient_boost",
    f"""with {SAMPLES}, b as (select chars as x, count(*) as w, sum(y) as s, sum(y * y) as q from samples group by 1), u as (select x, lead(x) over o as nx, sum(w) over o as w0, sum(s) over o as s0, sum(w) over () as wt, sum(s) over () as st, sum(q) over () as qt from b window o as (order by x)),
t as (select (x + nx) / 2 as th, 0.5 * (st - s0) / (wt - w0) as a, 0.5 * s0 / w0 as b from u where nx is not null order by round(qt - s0 * s0 / w0 - (st - s0) * (st - s0) / (wt - w0), 9), th limit 1),
r as (select chars as x, y - case when chars > th then a else b end as y, case when chars > th then a else b end as f from samples, t), b2 as (select x, count(*) as w, sum(y) as s, sum(y * y) as q from r group by 1), u2 as (select x, lead(x) over o as nx, sum(w) over o as w0, sum(s) over o as s0, sum(w) over () as wt, sum(s) over () as st, sum(q) over () as qt from b2 window o as (order by x)),
t2 as (select (x + nx) / 2 as th, 0.5 * (st - s0) / (wt - w0) as a, 0.5 * s0 / w0 as b from u2 where nx is not null order by round(qt - s0 * s0 / w0 - (st - s0) * (st - s0) / (wt - w0), 9), th limit 1)
select x as chars, round(f + case when x > th then a else b end, 6) as score, count(*) as n from r, t2 group by 1, 2""",
)
def gradient_boost(spark, d):
    """Two rounds of stumps on one feature, for the squared loss."""
    s = _samples(spark, d)
    model = features.gradient_boost(s, ["chars"], 2)
    return rounded(features.boosting_score(s.withColumn("features", F.array("chars")), model), "score").groupBy("chars", "score").agg(F.count("*").alias("n"))


@query("boosted_trees")
def boosted_trees(spark, d):
    s, names = _samples(spark, d), ["chars", "words", "lines"]
    model = features.gradient_boost(s, names, 3, depth=2, loss="huber")
    return rounded(features.boosting_score(s.withColumn("features", F.array(*names)), model), "score").select("doc_id", "score")


# linear algebra

SYSTEM = f"{c.POINTS}, sy as (select id, 2 + abs(x) as a, x as b, y as c, 2 + abs(y) as d, z as e, x as f from points)"


@query("solved", f"with {SYSTEM} select id, round((e * d - b * f) / (a * d - b * c), 8) as x0, round((a * f - c * e) / (a * d - b * c), 8) as x1 from sy")
def solved(spark, d):
    p = c.points(spark, d).select("id", F.array(2 + F.abs("x"), F.col("x"), F.col("y"), 2 + F.abs("y")).alias("a"), F.array("z", "x").alias("b"))
    return rounded(linear.solve(p, "a", "b").select("id", *[F.col("solution")[i].alias(f"x{i}") for i in range(2)]), "x0", "x1", places=8)


@query("solved_banded", f"with {SYSTEM} select id, round((e * d - b * f) / (a * d - b * c), 8) as x0, round((a * f - c * e) / (a * d - b * c), 8) as x1 from sy")
def solved_banded(spark, d):
    p = c.points(spark, d).select("id", F.array("y").alias("lo"), F.array(2 + F.abs("x"), 2 + F.abs("y")).alias("di"), F.array("x").alias("up"), F.array("z", "x").alias("b"))
    return rounded(linear.solve_banded(p, "lo", "di", "up", "b").select("id", *[F.col("solution")[i].alias(f"x{i}") for i in range(2)]), "x0", "x1", places=8)


@query("orthonormal", f"with {SYSTEM}, u as (select *, sqrt(a * a + b * b) as n from sy), w as (select *, c - (a * c + b * d) / n * a / n as p, d - (a * c + b * d) / n * b / n as q from u) select id, round(a / n, 8) as u0, round(b / n, 8) as u1, round(p / sqrt(p * p + q * q), 8) as v0, round(q / sqrt(p * p + q * q), 8) as v1 from w")
def orthonormal(spark, d):
    p = c.points(spark, d).select("id", F.array(2 + F.abs("x"), F.col("x"), F.col("y"), 2 + F.abs("y")).alias("a"))
    return rounded(linear.orthonormal(p, "a", 2).select("id", *[F.col("basis2")[i].alias(n) for i, n in enumerate(("u0", "u1", "v0", "v1"))]), "u0", "u1", "v0", "v1", places=8)


@query("ellipsoid_distance", f"with {c.POINTS} select a.id, round(greatest(0, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) - 0.1 - 0.05), 6) as distance from points a join points b on b.id = a.id + 1")
def ellipsoid_distance(spark, d):
    """Of balls, whose distance SQL can tell."""
    p = c.points(spark, d)
    ball = lambda r: F.array(*[F.lit(x / r**2) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 1.0)])
    a = p.select("id", F.array("x", "y", "z").alias("m1"), ball(0.1).alias("w1"))
    b = p.select((F.col("id") - 1).alias("id"), F.array("x", "y", "z").alias("m2"), ball(0.05).alias("w2"))
    return rounded(linear.ellipsoid_distance(a.join(b, "id"), "m1", "w1", "m2", "w2").select("id", "distance"), "distance")


@query(
    "mother_between",
    f"""{TREE}, tw as (select parent, min(id) as l, max(id) as r from nodes where parent is not null group by parent having count(*) = 2), g as (select m.id, l.x - r.x as ax, l.y - r.y as ay, 5 * (l.z - r.z) as az, (l.x + r.x) / 2 - m.x as ox, (l.y + r.y) / 2 - m.y as oy, 5 * ((l.z + r.z) / 2 - m.z) as oz from tw join nodes m on m.id = tw.parent join nodes l on l.id = tw.l join nodes r on r.id = tw.r),
q as (select id, ax * ax + ay * ay + az * az as d2, (ax * ox + ay * oy + az * oz) ** 2 / (ax * ax + ay * ay + az * az) as along, ox * ox + oy * oy + oz * oz as off from g), s as (select id, 16 * (along + 2 * (off - along)) / d2 as q from q) select id, round(case when q > 12 then 0 else exp(-q / 2) end, 6) as score from s""",
)
def mother_between(spark, d):
    n = c.forest(spark, d)
    kids = n.filter("parent is not null").groupBy("parent").agg(F.min(F.struct("id", *trees.AXES)).alias("l"), F.max(F.struct("id", *trees.AXES)).alias("r")).filter("l.id <> r.id")
    p = kids.join(n.select(F.col("id").alias("parent"), *trees.AXES), "parent")
    score = geometry.mother_between_daughters([F.col(a) for a in "xyz"], [F.col(f"l.{a}") for a in "xyz"], [F.col(f"r.{a}") for a in "xyz"], (1.0, 1.0, 5.0))
    return rounded(p.select(F.col("parent").alias("id"), score.alias("score")), "score")


@query("units", f"with {c.POINTS} select id, round(z * 5, 6) as up, round(z / 5, 6) as down, round(4 / 25.0::double, 6) as w_up, round(4 * 25.0::double, 6) as w_down from points")
def units(spark, d):
    s, w = (1.0, 1.0, 5.0), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 2.0, 0.0, 4.0)])
    m = [F.col(a) for a in "xyz"]
    return rounded(c.points(spark, d).select("id", geometry.to_units(m, s)[2].alias("up"), geometry.to_pixels(m, s)[2].alias("down"), geometry.precision_to_units(w, s)[5].alias("w_up"), geometry.precision_to_pixels(w, s)[5].alias("w_down")), "up", "down", "w_up", "w_down")


# pictures


@query(
    "gradient",
    f"""with {c.VOLUME}, n as (select frame, x, y, z, v, lag(v) over (partition by frame, y, z order by x) as xl, lead(v) over (partition by frame, y, z order by x) as xr, lag(v) over (partition by frame, x, z order by y) as yl, lead(v) over (partition by frame, x, z order by y) as yr, lag(v) over (partition by frame, x, y order by z) as zl, lead(v) over (partition by frame, x, y order by z) as zr from volume)
select frame, x, y, z, (xr - xl) / 2 as g_x, (xl + xr + yl + yr + zl + zr - 6.0 * v)::double as laplacian, round(sqrt(((xr - xl) ** 2 + (yr - yl) ** 2 + (zr - zl) ** 2) / 4), 6) as steepness from n""",
)
def gradient(spark, d):
    g = filters.gradient(c.volume(spark, d), line=("frame",))
    return rounded(g.select("frame", "x", "y", "z", "g_x", "laplacian", "steepness"), "steepness")


def _weights(kernel: list[float]) -> str:
    r = len(kernel) // 2
    return " + ".join(f"{w!r}::double * coalesce({'lag' if i < r else 'lead'}(v, {abs(i - r)}) over o, 0)" for i, w in enumerate(kernel))


@query("smoothed", f"with {c.VOLUME} select frame, x, y, z, round({_weights(filters.gaussian_kernel(1.5, 3))}, 4) as gauss, round({_weights(filters.log_kernel(1.0, 3))}, 4) as log, round({_weights(filters.box_kernel(2))}, 4) as box from volume window o as (partition by frame, y, z order by x)")
def smoothed(spark, d):
    v = c.volume(spark, d).select("frame", "x", "y", "z", "v")
    for name, kernel in (("gauss", filters.gaussian_kernel(1.5, 3)), ("log", filters.log_kernel(1.0, 3)), ("box", filters.box_kernel(2))):
        v = filters.convolve(v, ("frame", "y", "z"), "x", kernel, name)
    return rounded(v.drop("v"), "gauss", "log", "box", places=4)


@query("spectrum", f"with {c.VOLUME}, k as (select unnest(range(0, 32)) as k) select frame, y, z, k, round(sum(v * cos(2 * pi() * k * x / 32)), 4) + 0.0 as re, round(-sum(v * sin(2 * pi() * k * x / 32)), 4) + 0.0 as im from volume, k group by 1, 2, 3, 4")
def spectrum(spark, d):
    s = filters.spectrum(c.volume(spark, d).select("frame", "y", "z", "x", "v"), ("frame", "y", "z"), "x")
    return rounded(s, "re", "im", places=4)


@query("background_distance", f"with {c.VOLUME}, g as (select x, y, z, case when v % 7 = 0 then 0 else 1 end as v from volume where frame = 0), m as (select a.x, a.y, a.z, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d2 from g a, g b where a.v = 1 and b.v = 0 group by 1, 2, 3) select x, y, z, case when d2 < 12.25 then d2 end as d2 from m")
def background_distance(spark, d):
    g = c.volume(spark, d).filter("frame = 0").select("x", "y", "z", F.when(F.col("v") % 7 == 0, 0).otherwise(1).alias("v"))
    return filters.distance_to_background(g, 3)


@query("outer_product", "with a as (select n_nationkey as i, n_regionkey::double as v from nation) select a.i, b.i as j, a.v * b.v as v from a, a b")
def outer_product(spark, d):
    a = c.table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").cast("double").alias("v"))
    return filters.outer(a, a)


@query("mean_flow", f"with {c.POINTS}, fl as (select (i % 7 - 3) as bx, (i // 7) % 5 - 2 as by_, i // 35 - 1 as bz, i / 10.0 as vx from range(105) t(i)), m as (select p.id, avg(vx) as vx from points p join fl on abs(bx - round(p.x * 3)) <= 2 and abs(by_ - round(p.y * 3)) <= 2 and abs(bz - round(p.z * 3)) <= 1 group by 1) select p.id, round(p.x * 3 - coalesce(vx, 0), 6) as x from points p left join m using (id)")
def mean_flow(spark, d):
    p = c.points(spark, d).select("id", *[(F.col(a) * 3).alias(a) for a in "xyz"])
    i = F.col("id")
    flow = spark.range(105).select((i % 7 - 3).cast("int").alias("x"), (F.floor(i / 7) % 5 - 2).cast("int").alias("y"), (F.floor(i / 35) - 1).cast("int").alias("z"), (i / 10.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))
    return rounded(mixture.flow_prediction(p, flow, True).select("id", "x"), "x")


@query("bright_voxels", f"with {c.VOLUME} select frame, count(*) as n, sum(v) as total from volume where v - 60 > 0 group by frame")
def bright_voxels(spark, d):
    v = c.volume(spark, d).withColumn("v", F.greatest(F.col("v") - 60, F.lit(0)))
    return rg.remove_zeros(v).groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.col("v") + 60).alias("total"))


@query("dense_labels", "with l as (select l_suppkey % 4 as frame, l_orderkey * 8 + l_linenumber as voxel_id, l_partkey % 97 as label from lineitem), k as (select frame, label, row_number() over (partition by frame order by label) as new from l where label > 0 group by frame, label having count(*) >= 15) select frame, voxel_id, new::int as label from l join k using (frame, label)")
def dense_labels(spark, d):
    l = c.table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("frame"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("voxel_id"), (F.col("l_partkey") % 97).alias("label"))  # noqa: E741
    return segment.relabel_dense(l.filter("label > 0"), 15)


# graphs and trees of regions


@query("merge_order", f"with {EDGES}, pk as (select id, 1 + v as peak from points) select u, v, round(least(a.peak, b.peak) - weight, 6) as tau from edges join pk a on a.id = u join pk b on b.id = edges.v")
def merge_order(spark, d):
    peaks = c.points(spark, d).select(F.col("id").alias("node"), (1 + F.col("v")).alias("peak"))
    return rounded(graph.merge_order(_edges(spark, d), peaks), "tau")


@query("asymmetric_edges", f"with {EDGES}, dir as (select u, v from edges where u % 3 > 0 union all select v, u from edges where v % 2 = 0 union all select id, id from points where id % 50 = 0) select d.u, d.v, case when d.u = d.v then 'loop' else 'one-sided' end as fault from dir d left join dir e on e.u = d.v and e.v = d.u where d.u = d.v or e.u is null")
def asymmetric_edges(spark, d):
    e = _edges(spark, d).select("u", "v")
    loops = c.points(spark, d).filter("id % 50 = 0").select(F.col("id").alias("u"), F.col("id").alias("v"))
    return graph.asymmetric_edges(e.filter("u % 3 > 0").union(e.filter("v % 2 = 0").select("v", "u")).union(loops))


NODE_VOXELS = f"{TREE}, dt as (select a.ancestor as id, max(n.score) as thr, sum(1 + n.id % 5)::bigint as n from anc a join nodes n on n.id = a.id group by 1), mg as (select a.id as node, arg_min(a.ancestor, a.steps) as into_, arg_min(p.thr, a.steps) as thr, arg_min(s.n / p.n, a.steps) as score from anc a join dt s on s.id = a.id join dt p on p.id = a.ancestor where a.steps > 0 and 1 - s.n / p.n >= 0.1 group by 1), ok as (select * from mg where thr <= 0.9)"


def _node_voxels(spark, d):
    f = c.forest(spark, d)
    tree = f.select("id", "parent").join(trees.subtree_totals(f.select("id", "parent", F.col("score").alias("thr")), tops=("thr",)), "id").withColumnRenamed("id", "node")
    own = f.select("id", F.explode(F.sequence(F.lit(0), F.col("id") % 5)).alias("i"))
    voxels = trees.ancestors(f).join(own, "id").select(F.col("ancestor").alias("node"), (F.col("id") * 8 + F.col("i")).alias("voxel_id"))
    return voxels, tree


@query("suggest_merge", f"{NODE_VOXELS} select node, into_ as into, round(score, 6) as score from ok")
def suggest_merge(spark, d):
    return rounded(segment.suggest_merge(*_node_voxels(spark, d), 0.9), "score")


@query("suggest_split", f"{NODE_VOXELS}, ch as (select parent as node, min(id) as first, max(id) as second from nodes where parent is not null group by 1 having count(*) = 2) select ch.node, first, second, round(1 - greatest(a.score, b.score), 6) as score from ch join ok a on a.node = first and a.into_ = ch.node join ok b on b.node = second and b.into_ = ch.node")
def suggest_split(spark, d):
    voxels, tree = _node_voxels(spark, d)
    return rounded(segment.suggest_split(segment.suggest_merge(voxels, tree, 0.9), tree), "score")


@query("separated_parts", f"with recursive {EDGES}, own as (select id as sv_id, label as id from points), ed as (select u, v from edges join own a on a.sv_id = u join own b on b.sv_id = v where a.id = b.id), bo as (select u, v from ed union all select v, u from ed), re(s, t) as (select sv_id, sv_id from own union select re.s, bo.v from re join bo on bo.u = re.t), pt as (select s as sv_id, min(t) as part from re group by s) select own.id, own.sv_id, pt.part, count(distinct pt.part) over (partition by own.id) as n_parts from own join pt using (sv_id)")
def separated_parts(spark, d):
    p = c.points(spark, d)
    touches = _edges(spark, d).select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(3).alias("n_border"))
    return trees.separated_parts(p.select(F.col("id").alias("sv_id"), F.col("label").alias("id")), touches, 2)


@query("nucleus_features", f"""{TREE}, sq as (select a.id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2 from nodes a join nodes b on a.frame = b.frame and a.id <> b.id), nr as (select id, min(d2) / max(d2) as ratio from sq where d2 < 0.25 group by id)
select n.id, round(n.score, 6) as size, round(coalesce((n.x - p.x) ** 2 + (n.y - p.y) ** 2 + (n.z - p.z) ** 2, 0), 6) as displacement2, round(ratio, 6) as knn_ratio from nodes n left join nodes p on p.id = n.parent left join nr on nr.id = n.id""")
def nucleus_features(spark, d):
    f = c.forest(spark, d)
    shapes = f.select("id", F.col("score").alias("size"), F.lit(1.0).alias("intensity"), F.lit(1.0).alias("compactness"))
    out = features.nucleus_features(f, shapes, spatial.range_join(f, f, 0.5).filter("a_id <> b_id"))
    return rounded(out.select("id", "size", "displacement2", "knn_ratio"), "size", "displacement2", "knn_ratio")


@query("detect_divisions")
def detect_divisions(spark, d):
    f = c.forest(spark, d)
    parts = f.select("id", F.explode(F.array(F.col("id") * 4, F.col("id") * 4 + 1)).alias("part")).withColumn("n_parts", F.lit(2))
    where = parts.join(f, "id").select("part", *[(F.col(a) + F.col("part") % 4 * 0.1).alias(a) for a in "xyz"])
    return trees.detect_divisions(f, parts, where)


