"""Slopes of models that are functions of matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import design_based as db
from gaugeworks.operators.analyze import analyze
from gaugeworks.problem import Gaussian, Problem, Uniform
from gaugeworks.sources import designs

P = Problem({"a": Uniform(0, 2), "b": Gaussian(0, 1, -1, 1)})


@pytest.fixture(scope="module")
def runs(spark):
    return P.transform(designs.monte_carlo(spark, 400, P.names, 3)).withColumn("note", F.lit("kept")).cache()


def _model():
    def fn(x):
        return np.stack([x[:, 0] ** 2 + 3 * x[:, 1], np.sin(x[:, 1])], 1)

    return fn


fn = _model()


def test_slopes_equal_those_of_columns(runs, monkeypatch):
    monkeypatch.setattr(db, "EVALUATED", 37)  # batches in pieces
    column = db.slopes(runs, P, lambda a, b: [a * a + 3 * b, F.sin(b)], outputs=("u", "v"))
    got = db.slopes_of(runs, P, fn)
    assert got.columns == column.columns
    met = got.alias("g").join(column.alias("c"), ["run_id", "param", "output_idx"])
    assert met.count() == 1600 and met.agg(F.max(F.abs(F.col("g.d") - F.col("c.d")))).first()[0] < 1e-8 and met.agg(F.max(F.abs(F.col("g.y") - F.col("c.y")))).first()[0] < 1e-12


def test_points_stay_inside_bounds(spark):
    seen = db.slopes_of(spark.createDataFrame([(1, 0.0, 1.0), (2, 2.0, -1.0)], "run_id int, a double, b double"), P, lambda x: np.where((x[:, 0] < 0) | (x[:, 0] > 2) | (np.abs(x[:, 1]) > 1), np.nan, x.sum(1)))
    assert all(abs(r.d - 1) < 1e-8 for r in seen.collect())


def test_jacobian_and_shapes(runs):
    def jac(x):
        z = np.zeros((len(x), 2, 2))
        z[:, 0, 0], z[:, 0, 1], z[:, 1, 1] = 2 * x[:, 0], 3, np.cos(x[:, 1])
        return z

    exact = db.slopes_of(runs, P, fn, jac=jac).groupBy("param", "output_idx").agg(F.avg("d").alias("d")).toPandas().set_index(["param", "output_idx"]).d
    near = db.slopes_of(runs, P, fn).groupBy("param", "output_idx").agg(F.avg("d").alias("d")).toPandas().set_index(["param", "output_idx"]).d
    assert np.allclose(exact.sort_index(), near.sort_index(), atol=1e-7)
    with pytest.raises(Exception, match="returned shape"):
        db.slopes_of(runs, P, lambda x: x[:3]).collect()
    values = db.evaluated(runs, P.names, fn).toPandas()
    assert len(values) == 800 and set(values.columns) == {"run_id", "note", "output_idx", "y"}


def test_analysis_of_a_function(runs):
    got = analyze("dgsm", P, None, runs, fn=fn, n_bootstrap=3, seed=1).table.toPandas().set_index(["param", "output_idx"])
    assert got.nu["b", 0] == pytest.approx(9, rel=1e-6) and got.nu["a", 1] == 0 and (got.nu_lower <= got.nu_upper + 1e-9).all()
    assert db.slopes_of(runs.limit(0), P, fn).count() == 0
