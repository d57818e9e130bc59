"""Pair functions solved for in the space of the runs equal those of the dense system."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import dual
from gaugeworks.operators import surrogates as sg
from gaugeworks.problem import Problem, Uniform

P = Problem({c: Uniform() for c in "abcd"})


def frame(spark, spread):
    rng = np.random.default_rng(7)
    f = pd.DataFrame(rng.random((130, 4)), columns=list("abcd"))
    f["d"] = 0.5 + spread * (f.d - 0.5)
    f["y"] = np.sin(3 * f.a) + f.b * f.c + 0.1 * rng.normal(size=130)
    f["w"] = rng.integers(0, 3, 130).astype(float)
    return spark.createDataFrame(f).repartition(3).cache()


@pytest.fixture(scope="module")
def runs(spark):
    return frame(spark, 1.0)


@pytest.mark.parametrize("weight", [None, "w"])
def test_dual_equals_dense(runs, monkeypatch, weight):
    monkeypatch.setattr(dual, "SIDE", 48)  # blocks of uneven size
    a, b = (sg.hdmr(runs, P, ridge=1e-4, weight=weight, solver=s) for s in ("dense", "dual"))
    assert np.allclose(a.terms[["sa", "sb", "s"]], b.terms[["sa", "sb", "s"]], atol=1e-9) and a.terms.selected.tolist() == b.terms.selected.tolist()
    assert abs(a.explained - b.explained) < 1e-9
    left = a.predict(runs).withColumnRenamed("prediction", "p").drop("w").join(b.predict(runs).drop("w"), [*"abcd", "y"]).agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0]
    assert left < 1e-8


def test_dead_pairs_are_dropped_alike(spark):
    """An input with almost no spread: its pairs hold nothing of their own."""
    runs = frame(spark, 1e-9)
    for solver in ("dense", "dual"):
        terms = sg.hdmr(runs, P, ridge=1e-4, solver=solver).terms.set_index("term")
        assert (terms.sa[["a*d", "b*d", "c*d"]] == 0).all() and terms.sa["b*c"] > 0.03 and abs(terms.sa["d"]) < 1e-4


def test_more_weights_than_runs_go_by_the_runs(runs, monkeypatch):
    called = []
    monkeypatch.setattr(dual, "dual_hdmr", lambda *a: called.append(1))
    sg.hdmr(runs, P)
    assert called  # 6 pairs of 25 weights, 130 runs
    monkeypatch.setattr(dual, "MOST", 100)
    assert sg.hdmr(runs, P).terms is not None
    with pytest.raises(ValueError):
        sg.hdmr(runs, P, solver="other")
