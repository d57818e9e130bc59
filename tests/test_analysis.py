import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import design_based as db
from gaugeworks.operators import given_data as gd
from gaugeworks.operators import kernels
from gaugeworks.operators import surrogates as sg
from gaugeworks.operators.analyze import analyze, merged, with_intervals
from gaugeworks.problem import METHODS, Beta, Categorical, Gaussian, Lognormal, Problem, Uniform, gate, policy_for
from gaugeworks.sources import dependent, designs, files, models

NAMES = ["x1", "x2", "x3"]
PI = math.pi
UNIT = Problem({c: Uniform(0, 1) for c in NAMES})
#: Dependent normal inputs of a linear model, whose indices are known.
R = np.array([[1.0, 0.6, 0.0], [0.6, 1.0, 0.0], [0.0, 0.0, 1.0]])
NORMAL = Problem({c: Gaussian() for c in NAMES}, correlation=R)
COEFFICIENTS = np.array([2.0, 1.0, 0.5])


@pytest.fixture(scope="module")
def runs(spark):
    out = UNIT.transform(designs.monte_carlo(spark, 2000, NAMES, 7)).withColumn("y", models.linear([F.col(c) for c in NAMES]))
    return out.cache()


def known_closed(mask):
    """Closed index of a set for the linear model of NORMAL: the variance of the mean given it."""
    on = [i for i in range(3) if mask >> i & 1]
    cov = R @ COEFFICIENTS
    return float(cov[on] @ np.linalg.solve(R[np.ix_(on, on)], cov[on]) / (COEFFICIENTS @ R @ COEFFICIENTS))


@pytest.mark.parametrize("method", ["rank", "pawn", "borgonovo", "optimal_transport"])
def test_given_data_with_intervals(spark, runs, method):
    got = analyze(method, UNIT, runs.select("run_id", "y"), runs, n_bootstrap=6, seed=1, n_classes=8, dummy=method == "optimal_transport")
    table = got.to_pandas()
    f = got.fields[0]
    assert table.param.tolist() == NAMES and (table[f + "_lower"] <= table[f + "_upper"]).all() and table[f].is_monotonic_increasing
    assert method == "borgonovo" or (table[f + "_lower"] <= table[f] + 0.02).all()
    if method == "optimal_transport":
        assert (table.above_dummy <= table.ot).all() and (table.ot_dummy < table.ot).all()


def test_dependent_design_indices_and_effects(spark):
    design = dependent.kucherenko_design(spark, NORMAL, 1024, subsets="all", seed=3)
    y = design.select("run_id", models.linear([F.col(c) for c in NAMES], COEFFICIENTS).alias("y"))
    got = analyze("kucherenko", NORMAL, y, layout=design, n_bootstrap=5, seed=2, keep=True)
    table = got.to_pandas().set_index("mask")
    for m in range(1, 8):
        assert abs(table.closed[m] - known_closed(m)) < 0.05 and abs(table.total[m] - (1 - (known_closed(7 ^ m) if m < 7 else 0))) < 0.05
    assert (table.closed_lower <= table.closed_upper).all() and got.replicates.select("rep").distinct().count() == 5
    shapley = db.subset_effects(got.table.select("mask", F.col("total").alias("cost")).unionByName(spark.createDataFrame([(0, 0.0)], "mask int, cost double")), 3).toPandas()
    effects = db.marginal_effects(dict(table.total.items()), 3)
    assert abs(shapley.shapley.sum() - 1) < 1e-9 and abs(sum(effects) - 1) < 1e-9 and min(effects) > 0
    rows = design.where("mask = 0").toPandas()
    assert np.allclose(np.corrcoef(rows[NAMES].T), R, atol=0.03)
    with pytest.raises(ValueError):
        dependent.kucherenko_design(spark, NORMAL, 1000)


def test_custom_sampler(spark):
    def sampler(u, conditioning_rows=None, fixed_indices=None):
        x = u.copy()
        x[:, 1] = (x[:, 0] + x[:, 1]) / 2
        if fixed_indices:
            x[:, fixed_indices] = conditioning_rows
        return x

    p = Problem({c: Uniform() for c in ("a", "b")}, sampler=sampler)
    rows = dependent.kucherenko_design(spark, p, 32).toPandas()
    assert len(rows) == 96 and set(rows["mask"]) == {0, 1, 2}
    first = rows[rows["mask"] == 0].set_index("base_id")
    assert np.allclose(rows[rows["mask"] == 1].set_index("base_id").a, first.a)
    bad = Problem({c: Uniform() for c in ("a", "b")}, sampler=lambda u, **_: u[:, :1])
    with pytest.raises(Exception, match="sampler returned"):
        dependent.joint(bad, designs.monte_carlo(spark, 4, ["a", "b"], 1)).collect()


def test_policies_gates_and_warnings(spark, runs):
    assert set(METHODS) == {"sobol", "efast", "morris", "kucherenko", "borgonovo", "dgsm", "hdmr", "hsic", "optimal_transport", "pawn", "pce", "rank", "shapley", "vkoga"}
    for method, known in METHODS.items():
        for p, ok in ((NORMAL, known.correlated), (Problem({"c": Categorical((0.5, 0.5)), "u": Uniform()}), known.categorical), (Problem({"l": Lognormal(0, 1), "u": Uniform()}), not known.refused)):
            if ok:
                gate(p, method)
            else:
                with pytest.raises(ValueError):
                    gate(p, method)
    with pytest.raises(ValueError):
        policy_for("efast", "drop")
    y = runs.select("run_id", F.when(F.col("run_id") == 3, float("nan")).otherwise(F.col("y")).alias("y"))
    with pytest.raises(ValueError):
        analyze("rank", UNIT, y, runs)
    assert not any(math.isnan(r.s1) for r in analyze("rank", UNIT, y, runs, on_invalid="drop").table.collect())
    with pytest.raises(ValueError):
        analyze("rank", UNIT, runs.select("run_id", "y"), runs, n_bootstrap=3)  # no seed
    two = runs.select("run_id", F.explode(F.array(*[F.struct(F.lit(k).alias("o"), v.alias("y")) for k, v in enumerate((F.col("y"), F.lit(1.0), F.when(F.col("run_id") != 3, F.col("y"))))])).alias("s")).select("run_id", "s.*")
    with pytest.warns(UserWarning, match="constant"):
        got = analyze("rank", UNIT, two, runs, slices=["o"], on_invalid="skip")
    table = got.to_pandas()
    assert set(table.o) == {0, 1} and table[table.o == 1].s1.isna().all() and table[table.o == 0].s1.notna().all()
    with pytest.raises(ValueError):
        analyze("borgonovo", UNIT, runs.select("run_id", (F.col("run_id") % 3).cast("double").alias("y")), runs)


def test_fits_with_diagnostics_and_replicates(spark, runs):
    got = analyze("pce", UNIT, runs.select("run_id", "y"), runs, order=2, n_bootstrap=2, seed=5)
    table = got.to_pandas()
    want = models.linear_indices([1 / 12] * 3)
    assert np.allclose(table.s1, want, atol=1e-6) and (table.s1_upper - table.s1_lower).max() < 0.1
    fit = got.more["fit"]
    assert fit.quality["cv_rmse"] < 1e-6 and abs(fit.quality["explained_variance"] - 1) < 0.1
    assert "pce" in got.summary() and got.long().count() == 6 and {r.channel for r in merged({"a": got, "b": got}).collect()} == {"a", "b"}
    h = analyze("shapley", UNIT, runs.select("run_id", "y"), runs, backend="hdmr").to_pandas()
    assert np.allclose(h.shapley, want, atol=0.03)
    noise = runs.withColumn("y", F.rand(3))
    with pytest.warns(UserWarning):
        sg.pce(noise.withColumn("x3", F.lit(0.5)), UNIT, order=2)


def test_truncated_normal_polynomials_and_poincare():
    mean, scale, alpha, beta = sg.truncated_normal(-1.0, 2.0, 4)
    z = np.linspace(-1, 2, 200_001)
    w = np.exp(-z * z / 2)
    w /= w.sum()
    p = sg.recurrence((z - mean) / scale, alpha, beta)
    assert np.allclose((p * w[:, None]).T @ p, np.eye(5), atol=1e-4)
    wide = db.normal_poincare(1.0, 4.0, -15.0, 17.0)
    assert abs(wide - 4.0) < 0.01 and db.normal_poincare(0.0, 1e6, 0.0, 1.0) == pytest.approx(1 / PI**2, rel=1e-4)


def test_solvers():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 12))
    k, c = a.T @ a, rng.normal(size=12)
    assert np.allclose(sg.conjugate_gradient(k, c, 4), np.linalg.solve(k, c), atol=1e-6)
    assert np.allclose(sg.backfit(k, c, 4, 0.0, most=5000, tol=1e-13), np.linalg.solve(k, c), atol=1e-5)
    lifts = []
    low = dependent.cholesky(np.ones((2, 2)), lifts)
    assert np.allclose(low @ low.T, np.ones((2, 2)), atol=1e-6) and len(lifts) == 1


def test_kernel_model_under_dependence(spark):
    """For a linear model of dependent normal inputs the five indices are known."""
    units = designs.monte_carlo(spark, 1500, NAMES, 4)
    rows = dependent.joint(NORMAL, units).withColumn("y", models.linear([F.col(c) for c in NAMES], COEFFICIENTS))
    fit = sg.vkoga(rows, NORMAL, gammas=(0.3, 1.0), ridges=(1e-10, 1e-6), max_centres=120, folds=4)
    assert fit.cv_rmse < 0.3
    got = sg.kernel_indices(fit, spark, 256, 64, 2048).toPandas().set_index("param")
    v = COEFFICIENTS @ R @ COEFFICIENTS
    left = [COEFFICIENTS[0] ** 2 * (1 - 0.36) / v, COEFFICIENTS[1] ** 2 * (1 - 0.36) / v, COEFFICIENTS[2] ** 2 / v]
    for i, c in enumerate(NAMES):
        assert abs(got.s_tc[c] - known_closed(1 << i)) < 0.08 and abs(got.s_tu[c] - left[i]) < 0.08
        assert got.s_u[c] <= got.s_tu[c] and abs(got.s_tc[c] - got.s_u[c] - got.s_c[c]) < 1e-9


def test_designs(spark, tmp_path):
    points = designs.sobol_points(spark, 256, [f"d{i}" for i in range(70)], seed=9).toPandas()
    x = points[[f"u_d{i}" for i in range(70)]].to_numpy()
    assert all(sorted((x[:, i] * 256).astype(int)) == list(range(256)) for i in range(70))  # each dimension is stratified
    p = Problem({"a": Categorical((0.5, 0.5)), "b": Uniform(), "g": Gaussian()})
    design, layout, units = designs.sobol_design(spark, p, n_samples=70, seed=1, distinct=60)
    n = design.count()
    assert n >= 60 and layout.count() == units.count() * 8 and layout.select("run_id").distinct().count() == n
    moved = designs.retransformed(units, Problem({"a": Categorical((0.5, 0.5)), "b": Uniform(1, 2), "g": Gaussian()}))
    assert moved.agg(F.min("b")).first()[0] >= 1
    for method in ("trajectory", "radial"):
        walks, steps = designs.morris_design(spark, p, 8, method, seed=2)
        assert steps.count() == 24 and not walks.where(F.isnan("g") | (F.abs("g") > 4)).count()
        few, used = designs.downsample(steps, 3, walks.withColumn("y", F.col("b")), unit="traj_id")
        assert few.count() == 9 and used.count() == 12
    path = f"file://{tmp_path}/d"
    files.save_design(path, "efast", p, {"runs": design}, omega=12)
    again, tables, more = files.load_design(spark, path, "efast")
    assert again == p and more == {"omega": 12} and tables["runs"].count() == n
    with pytest.raises(ValueError):
        files.load_design(spark, path, "morris")


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.1, 2.0), (2, 0.3, None)], "run_id bigint, `q@0.5` double, q double")
    path = f"file://{tmp_path}/c"
    files.write_csv(rows, path)
    back = files.read_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == [(1, 0.1, 2.0), (2, 0.3, None)]
    assert {tuple(r) for r in files.timed_outputs(back, []).collect()} == {(1, "q", 0.5, 0.1), (1, "q", 0.0, 2.0), (2, "q", 0.5, 0.3)}
    with pytest.raises(ValueError):
        files.output_columns(["run_id", "x"], ["x"])
    one = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (2, 0.0, 3.0), (2, 1.0, 4.0)], "run_id bigint, time double, y double")
    assert files.channels({"a": one, "b": one.where("time = 0")}).count() == 6
    with pytest.raises(ValueError):
        files.channels({"a": one.union(one)})


def test_closed_forms():
    g = models.sobol_g_indices((0, 1, 4.5))
    assert abs(sum(g["shapley"]) - 1) < 1e-12 and abs(sum(g["s1"]) + sum(g["s2"]) - 1) < 0.02
    delta, ot = models.gaussian_linear_delta(), models.gaussian_linear_transport()
    assert delta == sorted(delta) and ot == sorted(ot) and models.gaussian_linear_delta((1.0,), (1.0,)) == [1.0]
    o = models.oakley_ohagan_indices((1, 2), (0.5, 0), (0, 1), np.array([[0.5, 1], [1, 0]]))
    assert abs(o["s1"].sum() + np.nansum(o["s2"]) / 2 - 1) < 1e-12 and (o["st"] >= o["s1"]).all()
    assert abs(models.ishigami_indices()["s2"][1] - 0.2437) < 1e-3


def test_known_transport_and_delta(spark):
    """The Gaussian linear model's indices, within the tolerance of estimates in classes."""
    p = Problem({c: Gaussian() for c in NAMES})
    rows = p.transform(designs.monte_carlo(spark, 8000, NAMES, 5)).withColumn("y", models.linear([F.col(c) for c in NAMES]))
    long = rows.unpivot(["y"], NAMES, "param", "x").select("param", "x", "y")
    ot = {r.param: r.ot for r in gd.transport(long).collect()}
    delta = {r.param: r.delta for r in gd.borgonovo(long, 24).collect()}
    for c, a, b in zip(NAMES, models.gaussian_linear_transport(), models.gaussian_linear_delta()):
        assert abs(ot[c] - a) < 0.05 and abs(delta[c] - b) < 0.06
    few = rows.limit(200).cache()
    two = few.select("run_id", F.explode(F.array(F.struct(F.lit(0).alias("o"), "y"), F.struct(F.lit(1).alias("o"), (F.col("y") * 2).alias("y")))).alias("s")).select("run_id", "s.*")
    joint = analyze("optimal_transport", p, two, few, slices=["o"], mode="multivariate", n_classes=4, epsilon=0.05).to_pandas().set_index("param")
    assert joint.ot["x3"] > joint.ot["x1"] and (joint.unconverged == 0).all()


def test_median_distance_without_one_task(spark, monkeypatch):
    monkeypatch.setattr(kernels, "PIECE", 16)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=101), 2)
    d = np.abs(np.subtract.outer(x, x))[np.triu_indices(101, 1)]
    d = np.sort(d[d > 0])
    got = kernels.median_distances(spark.createDataFrame(pd.DataFrame({"a": x, "b": 0.0})), ["a", "b"])
    assert abs(got["a"] - d[(len(d) + 1) // 2 - 1]) < 1e-9 and got["b"] == 0


def test_slopes_and_jacobian(spark):
    p = Problem({"a": Uniform(0, 2), "b": Gaussian()})
    rows = p.transform(designs.monte_carlo(spark, 500, ["a", "b"], 3))
    got = db.slopes(rows, p, lambda a, b: [a * a + 3 * b, b], outputs=("u", "v")).groupBy("param", "output_idx").agg(F.avg("d").alias("d")).toPandas().set_index(["param", "output_idx"]).d
    assert abs(got["b", 0] - 3) < 1e-6 and abs(got["a", 0] - 2) < 0.1 and abs(got["a", 1]) < 1e-9
    given = db.jacobian(rows.selectExpr("a AS y", "2 * a AS d_a", "3D AS d_b"), ["a", "b"])
    assert given.where("param = 'b'").agg(F.avg("d")).first()[0] == 3
    with pytest.raises(ValueError):
        db.poincare_constants(Problem({"b": Beta(2, 2)}))


def test_interval_hull(spark):
    point = spark.createDataFrame([("x", 1.0)], "param string, s1 double")
    draws = spark.createDataFrame([("x", k, 1.0 + d) for k, d in enumerate((-1.0, 0.0, 2.0, float("nan")))], "param string, rep int, s1 double")
    plain = with_intervals(point, draws, ["param"], ["s1"], 0.5, "quantile").first()
    scaled = with_intervals(point, draws, ["param"], ["s1"], 0.5, "quantile", scale=2.0).first()
    assert plain.s1_lower < 1 < plain.s1_upper and scaled.s1_lower < plain.s1_lower and scaled.s1_upper > plain.s1_upper
    warnings.simplefilter("default")
