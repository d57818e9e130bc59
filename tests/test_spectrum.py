"""Transforms of curves in one task, by two steps, and by convolution are those of NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import design_based as db
from gaugeworks.operators import spectrum
from gaugeworks.sources import designs, models


@pytest.mark.parametrize("n", [1, 12, 1000, 97, 1021])
@pytest.mark.parametrize("inverse", [False, True])
def test_transform_of_any_length(spark, monkeypatch, n, inverse):
    monkeypatch.setattr(spectrum, "FITS", 64)  # 97 and 1021 are prime and go by convolution
    monkeypatch.setattr(spectrum, "GROUP", 80)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(2, n)) + 1j * rng.normal(size=(2, n))
    rows = spark.createDataFrame(pd.DataFrame([(c, t, x[c, t].real, x[c, t].imag) for c in range(2) for t in range(n)], columns=["c", "t", "re", "im"]))
    got = spectrum.transformed(rows, n, ["c"], inverse).toPandas().sort_values(["c", "k"])
    want = np.fft.ifft(x, axis=1) if inverse else np.fft.fft(x, axis=1)
    assert len(got) == 2 * n and np.allclose((got.re + 1j * got.im).to_numpy().reshape(2, n), want, atol=1e-9)


def test_long_curves_have_the_same_indices(spark, monkeypatch):
    names = ["x1", "x2", "x3"]
    for n in (1025, 1021):
        curves, main = designs.efast_design(spark, names, n)
        y = models.ishigami(*[-math.pi + 2 * math.pi * F.col("u_" + c) for c in names])
        rows = curves.select("param", F.lit(7).alias("o"), "t", "n", y.alias("y")).cache()
        short = db.efast(rows, main, slices=["o"]).toPandas().sort_values("param")
        monkeypatch.setattr(spectrum, "FITS", 128)
        long = db.efast(rows, main, slices=["o"]).toPandas().sort_values("param")
        monkeypatch.undo()
        assert np.allclose(short[["s1", "st"]], long[["s1", "st"]], atol=1e-10) and (short.o == 7).all()


def test_constant_curves_and_none(spark):
    rows = spark.range(129).select(F.lit("a").alias("param"), F.col("id").alias("t"), F.lit(129).cast("bigint").alias("n"), F.lit(2.0).alias("y"))
    got = db.efast(rows, 16).first()
    assert math.isnan(got.s1) and math.isnan(got.st)
    assert db.efast(rows.limit(0), 16).count() == 0


def test_poincare_constants_by_their_equation():
    """The constant is the reciprocal of the least positive eigenvalue of the density's Neumann problem, found by shooting."""
    def shot(lam, a, b, steps=20_000):
        f, g, h = 1.0, 0.0, (b - a) / steps  # f'' = z f' - lam f, with f' = 0 at both ends
        for k in range(steps):
            z = a + (k + 0.5) * h
            f2, g2 = f + h / 2 * g, g + h / 2 * ((a + k * h) * g - lam * f)
            f, g = f + h * g2, g + h * (z * g2 - lam * f2)
        return g

    for a, b in ((-1.0, 2.0), (0.5, 3.0)):
        lo, hi = 0.2, 1 / db.normal_poincare(0.0, 1.0, a, b) * 1.5
        grid = np.linspace(lo, hi, 60)
        at = next(k for k in range(59) if np.sign(shot(grid[k], a, b, 2000)) != np.sign(shot(grid[k + 1], a, b, 2000)))
        lo, hi = grid[at], grid[at + 1]
        for _ in range(30):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.sign(shot(mid, a, b, 2000)) == np.sign(shot(lo, a, b, 2000)) else (lo, mid)
        assert db.normal_poincare(0.0, 1.0, a, b) == pytest.approx(1 / lo, rel=1e-4)
