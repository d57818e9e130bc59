"""Fits of many outputs and replicates in one pass equal fits one by one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import many, resampling
from gaugeworks.operators import surrogates as sg
from gaugeworks.operators.analyze import analyze
from gaugeworks.problem import Gaussian, Problem, Uniform

P = Problem({"a": Uniform(0, 1), "b": Uniform(-1, 1), "c": Gaussian(0, 1)})
N, S = 700, 11


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    f = pd.DataFrame({"run_id": rng.permutation(N), "a": rng.random(N), "b": rng.random(N) * 2 - 1, "c": rng.normal(size=N)})
    f["ys"] = [[float(k * r.a + r.b * r.c + (k % 3) * r.a * r.b + 0.1 * np.sin(7 * k + 11 * r.a) + (5.0 if k == 4 else 0.0)) for k in range(S)] for r in f.itertuples()]
    return f


@pytest.fixture(scope="module")
def runs(spark, frame):
    return spark.createDataFrame(frame).repartition(5).cache()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(many, "BLOCK", 4)


def test_outputs_of_one_pass_equal_single_fits(spark, runs):
    fits = many.pce(many.in_blocks(runs, "ys", S), P, S, order=2)
    c = fits.coefficients.toPandas()
    quality = fits.quality.toPandas().set_index("output_idx")
    indices = fits.indices().toPandas().set_index(["output_idx", "param"])
    second = fits.second_order().toPandas().set_index(["output_idx", "param", "param_j"]).s2
    assert c.rep.eq(0).all() and len(c) == S * len(fits.terms)
    for k in (0, 4, S - 1):
        one = sg.pce(runs.withColumn("y", F.col("ys")[k]), P, order=2)
        own = c[c.output_idx == k].sort_values("term").coefficient
        assert np.allclose(own, one.coefficients, atol=1e-10)
        assert quality.rmse[k] == pytest.approx(one.quality["rmse"], rel=1e-6) and quality.variance[k] == pytest.approx(one.quality["variance"])
        assert quality.explained_variance[k] == pytest.approx(one.quality["explained_variance"])
        want = one.indices().set_index("param")
        assert np.allclose(indices.loc[k].loc[P.names, ["s1", "st", "shapley"]], want.loc[P.names], atol=1e-9)
        for r in one.second_order().itertuples():
            assert second[k, r.param, r.param_j] == pytest.approx(r.s2, abs=1e-9)
    got = fits.predict(runs).where("output_idx = 4").join(runs, "run_id").agg(F.max(F.abs(F.col("prediction") - F.col("ys")[4])).alias("e")).first().e
    assert got < 1.0 and fits.predict(runs).count() == N * S


def test_splines_of_one_pass_equal_single_fits(runs):
    fits = many.hdmr(many.in_blocks(runs, "ys", S), P, S)
    terms = fits.terms.toPandas()
    for k in (0, 7):
        one = sg.hdmr(runs.withColumn("y", F.col("ys")[k]), P)
        own = terms[terms.output_idx == k].set_index("term").loc[one.terms.term]
        for c in ("sa", "sb", "s"):
            assert np.allclose(own[c], one.terms[c], atol=1e-9)
        assert own.selected.tolist() == one.terms.selected.tolist()
        shapley = fits.shapley().where(F.col("output_idx") == k).toPandas().set_index("param").shapley
        assert np.allclose(shapley[P.names], one.shapley().shapley, atol=1e-9)


@pytest.mark.parametrize("kept", [1 << 28, 1])
def test_replicates_of_one_pass_equal_refits(spark, runs, monkeypatch, kept):
    """Also where a task passes its matrices on after each one."""
    monkeypatch.setattr(many, "KEPT", kept)
    units = runs.select(F.col("run_id").alias("unit"), F.col("run_id").alias("pos"))
    w = resampling.weights(units, 3, 5).cache()
    rows = many.with_weights(many.in_blocks(runs, "ys", S), w, 3)
    c = many.pce(rows, P, S, order=2, size=N).coefficients.toPandas()
    h = many.hdmr(rows, P, S, order=1).terms.toPandas()
    assert set(c.rep) == set(h.rep) == {0, 1, 2, 3}
    for rep in (0, 2):
        again = runs.join(w.where(F.col("rep") == rep - 1), runs.run_id == F.col("unit")) if rep else runs.withColumn("w", F.lit(1))
        for k in (3, 10):
            one = sg.pce(again.withColumn("y", F.col("ys")[k]), P, order=2, weight="w", check=False)
            assert np.allclose(c[(c.rep == rep) & (c.output_idx == k)].sort_values("term").coefficient, one.coefficients, atol=1e-9)
            spline = sg.hdmr(again.withColumn("y", F.col("ys")[k]), P, order=1, weight="w")
            assert np.allclose(h[(h.rep == rep) & (h.output_idx == k)].set_index("term").loc[spline.terms.term].s, spline.terms.s, atol=1e-9)


def test_analyses_of_slices_with_intervals(spark, runs):
    long = runs.select("run_id", F.posexplode("ys").alias("o", "y"))
    inputs = runs.drop("ys")
    for method, options in (("shapley", {"order": 2}), ("hdmr", {"order": 1})):
        got = analyze(method, P, long, inputs, slices=["o"], n_bootstrap=2, seed=6, **options)
        table = got.table.toPandas().set_index(["o", "param"])
        field = got.fields[0]
        assert len(table) == 3 * S and (table[field + "_lower"] <= table[field + "_upper"] + 1e-12).all() and (table.variance > 0).all()
        alone = analyze(method, P, long.where("o = 6").drop("o"), inputs, n_bootstrap=2, seed=6, **options).table.toPandas().set_index("param")
        for c in ("", "_lower", "_upper"):
            assert np.allclose(table.loc[6].loc[P.names, field + c], alone.loc[P.names, field + c], atol=1e-8)
        assert got.aggregate().count() == 3


def test_jobs_do_not_grow_with_outputs_and_replicates(spark, runs):
    def jobs(outputs, replicates):
        spark.sparkContext.setJobGroup(name := f"fits-{outputs}-{replicates}", name)
        long = runs.select("run_id", F.posexplode("ys").alias("o", "y")).where(F.col("o") < outputs)
        analyze("pce", P, long, runs.drop("ys"), slices=["o"], n_bootstrap=replicates, seed=1, order=1).table.collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs(11, 12) <= jobs(2, 2) + 3  # larger shuffles may be read in one more query stage


def test_failed_runs_and_a_failed_output(spark, runs):
    long = runs.select("run_id", F.posexplode("ys").alias("o", "y"))
    bad = long.withColumn("y", F.when((F.col("o") == 2) & (F.col("run_id") == 5), float("nan")).otherwise(F.col("y")))
    dropped = analyze("pce", P, bad, runs.drop("ys"), slices=["o"], on_invalid="drop", order=2).table.toPandas()
    assert dropped.s1.notna().all() and len(dropped) == 3 * S
    passed = analyze("pce", P, bad, runs.drop("ys"), slices=["o"], on_invalid="propagate", order=2).table.toPandas().set_index("o")
    assert passed.loc[2].s1.isna().all() and passed.loc[3].s1.notna().all()


def test_units_of_a_design_need_one_shuffle_and_no_lists(spark):
    """Every unit's outputs meet in one shuffle; draws by unit are the weights."""
    from gaugeworks.operators import design_based as db
    from gaugeworks.operators import resampling as rs

    blocks = [("A", None), ("B", None), ("AB", "p"), ("BA", "p"), ("AB", "q"), ("BA", "q")]
    rows = [(i, b, p, k, float(10 * i + j)) for i in range(3) for k in "uv" for j, (b, p) in enumerate(blocks) if (i, b, p) != (2, "BA", "q")]
    got = db.units(spark.createDataFrame(rows, "base_id long, block string, param string, slice string, y double"), ["slice"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan
    want = {(i, k, p, 10.0 * i, 10.0 * i + 1, 10.0 * i + j, None if (i, p) == (2, "q") else 10.0 * i + j + 1) for i in range(3) for k in "uv" for p, j in (("p", 2), ("q", 4))}
    assert {(r.base_id, r.slice, r.param, r.a, r.b, r.ab, r.ba) for r in got.collect()} == want
    units = spark.range(40).select(F.col("id").alias("unit"), F.col("id").alias("pos"))
    drawn = rs.draws(units, 7, 3).withColumn("rep", F.explode("reps")).groupBy("rep", "unit").agg(F.count("*").alias("w"))
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, rs.weights(units, 7, 3).select("rep", "unit", "w").collect()))
