import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.special import NUMPY, betainc, normal_cdf, normal_ppf
from gaugeworks.operators import design_based as db
from gaugeworks.operators import given_data as gd
from gaugeworks.operators import surrogates as sg
from gaugeworks.operators.joint import entropic
from gaugeworks.operators.frames import drop_invalid, long_inputs, ranked
from gaugeworks.problem import Beta, Categorical, Gaussian, Lognormal, Problem, Triangular, Uniform, Weibull, gate, repaired
from gaugeworks.sources import designs, models

NAMES = ["x1", "x2", "x3"]
PI = math.pi
ISHIGAMI = Problem({c: Uniform(-PI, PI) for c in NAMES})


def ishigami(df):
    return df.withColumn("y", models.ishigami(*map(F.col, NAMES)))


@pytest.fixture(scope="module")
def frozen(spark):
    base = designs.saltelli_units(spark, 4096, NAMES, seed=3)
    runs, layout = designs.saltelli(base.select("base_id", *[(-PI + 2 * PI * F.col(s + c)).alias(s + c) for s in ("a_", "b_") for c in NAMES]), NAMES)
    return db.pick_freeze(ishigami(runs).select("run_id", "y"), layout).cache()


@pytest.mark.parametrize("estimator", db.ESTIMATORS)
def test_sobol_known_indices(frozen, estimator):
    got = {r.param: r for r in db.sobol(frozen, estimator).collect()}
    want = models.ishigami_indices()
    for j, c in enumerate(NAMES):
        assert abs(got[c].s1 - want["s1"][j]) < 0.03 and abs(got[c].st - want["st"][j]) < 0.03


def test_second_order_known(frozen):
    got = {(r.param, r.param_j): r.s2 for r in db.sobol_second(frozen).collect()}
    assert abs(got["x1", "x3"] - 0.2437) < 0.03 and abs(got["x1", "x2"]) < 0.03


def test_constant_output_is_undefined(spark, frozen):
    flat = frozen.withColumns({c: F.lit(3.0) for c in ("a", "b", "ab", "ba")})
    assert all(math.isnan(r.s1) and math.isnan(r.st) for r in db.sobol(flat).collect())
    rows = spark.range(50).select(F.lit("x").alias("param"), F.col("id").cast("double").alias("x"), F.lit(2.0).alias("y"))
    assert math.isnan(gd.rank_index(rows).first().s1)
    assert gd.borgonovo(rows, 5).first().delta == 0 and gd.transport(rows, 5).first().ot == 0
    assert gd.pawn(rows.withColumn("u", F.col("x") / 50)).first().pawn == 0


def test_given_data_known(spark):
    runs = ishigami(ISHIGAMI.transform(designs.monte_carlo(spark, 20000, NAMES, 1)))
    rows = long_inputs(runs, NAMES, keep=("y",)).select("param", "x", "y").cache()
    s1 = {r.param: r.s1 for r in gd.rank_index(rows).collect()}
    want = models.ishigami_indices()["s1"]
    assert all(abs(s1[c] - w) < 0.03 for c, w in zip(NAMES, want))
    ot = {r.param: r.advective for r in gd.transport(rows, 25).collect()}
    assert abs(2 * ot["x1"] - want[0]) < 0.05


def test_ranked_equals_window(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 50).alias("v"), "id")
    got = {(r.id, r["rank"], r.n) for r in ranked(rows, ["g"], ["v", "id"]).collect()}
    from pyspark.sql import Window

    w = Window.partitionBy("g")
    want = {(r.id, r.k, r.n) for r in rows.select("id", (F.row_number().over(w.orderBy("v", "id")) - 1).alias("k"), F.count("*").over(w).alias("n")).collect()}
    assert got == want


def test_efast_and_morris_known(spark):
    curves, main = designs.efast_design(spark, NAMES, 2049)
    y = models.ishigami(*[-PI + 2 * PI * F.col("u_" + c) for c in NAMES])
    got = {r.param: r for r in db.efast(curves.select("param", "t", "n", y.alias("y")), main).collect()}
    want = models.ishigami_indices()
    assert all(abs(got[c].s1 - want["s1"][j]) < 0.08 for j, c in enumerate(NAMES))
    runs, steps = designs.morris_trajectories(spark, NAMES, 200, seed=4)
    assert steps.count() == 600 and runs.count() == 800
    lin = runs.select("run_id", models.linear([F.col("u_" + c) for c in NAMES]).alias("y"))
    ee = db.morris(db.elementary_effects(lin, steps)).collect()
    assert all(abs(r.mu_star - int(r.param[1])) < 1e-9 and abs(r.mu - r.mu_star) < 1e-9 and r.sigma < 1e-9 for r in ee)


def test_surrogates(spark):
    p = Problem({c: Uniform(0, 1) for c in NAMES})
    runs = p.transform(designs.monte_carlo(spark, 3000, NAMES, 7)).withColumn("y", models.linear([F.col(c) for c in NAMES]))
    want = models.linear_indices([1 / 12] * 3)
    got = sg.indices_from_variances(sg.pce(runs, p, order=2).variances(), NAMES)
    assert np.allclose(got.s1, want, atol=1e-6) and np.allclose(got.shapley, want, atol=1e-6)
    h = sg.hdmr(runs, p)
    assert np.allclose(h.terms.s[:3], want, atol=0.02) and h.explained > 0.999
    v = sg.vkoga(runs, p, gammas=(0.1, 1.0), ridges=(1e-10, 1e-6), max_centres=100, folds=4)
    k = sg.kernel_indices(v, spark, 256, 64, 1024).toPandas().set_index("param")
    assert np.allclose(k.s_tc[NAMES], want, atol=0.08) and np.allclose(k.s_tu[NAMES], want, atol=0.08) and (k.s_u <= k.s_tu).all()
    cost = (np.arange(5.0)[:, None] - np.arange(5.0)[None]) ** 2
    value, settled = entropic(cost, np.full(5, 0.2), np.full(5, 0.2), 0.05, 1e-9, 2000)
    assert value < 0.05 and settled


def test_marginals_round_trip(spark):
    u = np.linspace(0.01, 0.99, 25)
    for m in (Uniform(1, 4), Gaussian(2, 9), Gaussian(0, 1, -1, 2), Lognormal(0.2, 0.5), Weibull(1.5, 2), Triangular(0, 1, 3), Beta(2, 3, 1, 5)):
        x = m.ppf(u, NUMPY)
        assert np.allclose(m.cdf(x, NUMPY), u, atol=1e-9)
        col = [r[0] for r in spark.createDataFrame([(float(v),) for v in u], "u double").select(m.ppf(F.col("u"))).collect()]
        assert np.allclose(sorted(col), x, rtol=1e-9)
    assert list(Categorical((0.5, 0.3, 0.2)).ppf(np.array([0.0, 0.5, 0.79, 0.81]), NUMPY)) == [0, 1, 1, 2]
    assert np.allclose(normal_cdf(normal_ppf(u, NUMPY), NUMPY), u, atol=1e-14) and abs(float(betainc(2, 2, 0.5)) - 0.5) < 1e-14


def test_gates_and_policies(spark):
    dependent = Problem({"a": Gaussian(), "b": Gaussian()}, correlation=np.array([[1, 0.5], [0.5, 1]]))
    with pytest.raises(ValueError):
        gate(dependent, "pce", correlated=False, categorical=False)
    with pytest.raises(ValueError):
        repaired(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))
    rows = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0), (3, float("nan"))], "u int, y double")
    with pytest.raises(ValueError):
        drop_invalid(rows, ["u"])
    with pytest.warns(UserWarning):
        assert [r.u for r in drop_invalid(rows, ["u"], "drop").collect()] == [2]
    assert drop_invalid(rows, ["u"], "propagate").count() == 4


def test_dependent_sampling(spark):
    r = np.array([[1, 0.8], [0.8, 1]])
    u = designs.correlated(designs.monte_carlo(spark, 5000, ["a", "b"], 2), ["a", "b"], r)
    rho = designs.spearman(u.select(F.col("u_a").alias("a"), F.col("u_b").alias("b")), ["a", "b"])
    assert abs(2 * math.sin(math.pi * rho[0, 1] / 6) - 0.8) < 0.03
    with pytest.raises(ValueError):
        designs.aligned(u.select("run_id"), u.select("run_id").limit(10))
