"""Options of analyses, and effects of Kucherenko results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import design_based as db
from gaugeworks.operators import given_data as gd
from gaugeworks.operators.analyze import analyze
from gaugeworks.problem import Gaussian, Problem, Uniform
from gaugeworks.sources import dependent, designs

R = np.array([[1.0, 0.5, 0.0], [0.5, 1.0, 0.0], [0.0, 0.0, 1.0]])
NORMAL = Problem({c: Gaussian() for c in "abc"}, correlation=R)


@pytest.fixture(scope="module")
def result(spark):
    design = dependent.kucherenko_design(spark, NORMAL, 256, subsets="all", seed=3)
    parts = F.array(*[F.struct(F.lit(k).alias("o"), (F.col("a") + (k + 1) * F.col("b")).alias("y")) for k in range(2)])
    y = design.select("run_id", F.explode(parts).alias("s")).select("run_id", "s.*")
    return analyze("kucherenko", NORMAL, y, layout=design, slices=["o"], n_bootstrap=3, seed=2, keep=True)


def test_effects_of_subsets(result):
    total = result.table.toPandas()
    shapley, closed, pme = (r.table.toPandas().set_index(["o", "param"]) for r in (result.shapley(), result.shapley("closed"), result.pme()))
    for o in range(2):
        own = total[total.o == o].set_index("mask").total
        assert abs(shapley.shapley[o].sum() - 1) < 1e-9 and abs(pme.pme[o].sum() - 1) < 1e-9
        assert np.allclose(pme.loc[o].loc[list("abc"), "pme"], db.marginal_effects(own.to_dict(), 3))
        assert abs(pme.pme[o, "c"]) < 1e-12 and abs(shapley.shapley[o, "c"]) < 0.01  # the model doesn't use it
    assert np.allclose(shapley.shapley, closed.shapley[shapley.index], atol=0.15)
    assert (shapley.shapley_lower <= shapley.shapley_upper).all() and (pme.pme_lower <= pme.pme_upper).all()


def test_effects_need_all_subsets(spark):
    four = Problem({c: Gaussian() for c in "abcd"}, correlation=np.eye(4) + 0.2 * (1 - np.eye(4)))
    design = dependent.kucherenko_design(spark, four, 64, seed=3)
    got = analyze("kucherenko", four, design.select("run_id", (F.col("a") + F.col("b")).alias("y")), layout=design)
    with pytest.raises(ValueError, match="every subset"):
        got.shapley()
    with pytest.raises(ValueError, match="total or closed"):
        got.shapley("first")


def test_bandwidths_of_delta(spark):
    rng = np.random.default_rng(5)
    x = rng.random(300)
    rows = spark.createDataFrame([("x", k, float(v), float(np.floor(v * 4) + 0.001 * rng.normal())) for k, v in enumerate(x)], "param string, run_id int, x double, y double")
    wide, narrow, floor = (gd.borgonovo(rows, 4, **o).first().delta for o in ({}, {"bandwidth": 0.02}, {"least": 2.0}))
    assert narrow > wide > floor > 0
    for bad in ({"bandwidth": 0.0}, {"least": -1.0}, {"least": "none"}):
        with pytest.raises(ValueError):
            gd.borgonovo(rows, 4, **bad)


def test_standardised_outputs(spark):
    p = Problem({"a": Uniform(), "b": Uniform()})
    runs, steps = designs.morris_design(spark, p, 12, "radial", seed=2)
    y = runs.select("run_id", (100 + 7 * F.col("a") + F.col("b") * F.col("b")).alias("y"))
    deviation = y.agg(F.stddev_pop("y")).first()[0]
    plain, scaled = (analyze("morris", p, y, layout=steps, standardize_outputs=s).table.toPandas().set_index("param") for s in (False, True))
    assert np.allclose(plain.mu_star[["a", "b"]] / deviation, scaled.mu_star[["a", "b"]])
    inputs = p.transform(designs.monte_carlo(spark, 200, p.names, 1))
    plain, scaled = (analyze("dgsm", p, None, inputs, fn=lambda x: 7 * x[:, 0] + x[:, 1] ** 2, standardize_outputs=s).table.toPandas().set_index("param") for s in (False, True))
    assert np.allclose(plain.upper_bound[["a", "b"]], scaled.upper_bound[["a", "b"]]) and scaled.variance["a"] == pytest.approx(1)


def test_grids_of_replicates_are_the_samples(spark):
    """A resample that lacks the ends is summed on the whole sample's grid."""
    rng = np.random.default_rng(9)
    x = np.sort(rng.random(80))
    y = 3 * x + rng.normal(size=80)
    on = (y > y.min()) & (y < y.max())
    rows = spark.createDataFrame([("x", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y)) if on[k]], "param string, run_id int, x double, y double")
    bounds = spark.createDataFrame([(float(y.min()), float(y.max()))], "lo double, hi double")
    own, classes = y[on], np.repeat(np.arange(4), np.diff([k * 78 // 4 for k in range(5)]))
    grid = np.linspace(y.min(), y.max(), 100)

    def density(v):
        h = (0.75 * len(v)) ** -0.2 * v.std(ddof=1)
        return np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))

    want = sum((classes == c).mean() / 2 * np.trapezoid(np.abs(density(own) - density(own[classes == c])), grid) for c in range(4))
    assert gd.borgonovo(rows, 4, bounds=bounds).first().delta == pytest.approx(want, abs=1e-10)
    assert abs(gd.borgonovo(rows, 4).first().delta - want) > 1e-6
