"""Test models with known indices, as Column expressions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.special import NUMPY, normal_cdf

# Fixed values of the test models.
SOBOL_G_A = (0.0, 1.0, 4.5, 9.0, 99.0, 99.0, 99.0, 99.0)


def ishigami(x1: Column, x2: Column, x3: Column, a: float = 7.0, b: float = 0.1) -> Column:
    """On three inputs from -pi to pi."""
    return F.sin(x1) + a * F.pow(F.sin(x2), F.lit(2.0)) + b * F.pow(x3, F.lit(4.0)) * F.sin(x1)


def ishigami_indices(a: float = 7.0, b: float = 0.1) -> dict[str, list[float]]:
    """``s1``, ``st`` and ``shapley`` by input, and ``s2`` by pair (1, 2), (1, 3), (2, 3)."""
    v1 = 0.5 * (1 + b * math.pi**4 / 5) ** 2
    v2 = a * a / 8
    v13 = b * b * math.pi**8 * (1 / 18 - 1 / 50)
    v = v1 + v2 + v13
    return {"s1": [v1 / v, v2 / v, 0.0], "st": [(v1 + v13) / v, v2 / v, v13 / v], "shapley": [(v1 + v13 / 2) / v, v2 / v, v13 / 2 / v], "s2": [0.0, v13 / v, 0.0]}


def sobol_g(xs: Sequence[Column], a: Sequence[float] = SOBOL_G_A) -> Column:
    """On inputs from 0 to 1."""
    return reduce(lambda p, q: p * q, [(F.abs(4 * x - 2) + c) / (1 + c) for x, c in zip(xs, a)])


def sobol_g_indices(a: Sequence[float] = SOBOL_G_A) -> dict[str, list[float]]:
    """``s1`` and ``st`` by input, ``s2`` by pair, and ``shapley``: a set's variance is a product, shared equally in it.

    The share needs the sums of products over sets of each size, which a polynomial's coefficients hold.
    """
    part = [1 / (3 * (1 + c) ** 2) for c in a]
    v = math.prod(1 + p for p in part) - 1
    others = [part[:i] + part[i + 1 :] for i in range(len(part))]
    by_size = [reduce(lambda c, p: np.convolve(c, [1.0, p]), o, np.ones(1)) for o in others]
    return {
        "s1": [p / v for p in part],
        "st": [p * math.prod(1 + q for q in o) / v for p, o in zip(part, others)],
        "s2": [p * q / v for p, q in itertools.combinations(part, 2)],
        "shapley": [float(p * (c / (1 + np.arange(len(c)))).sum()) / v for p, c in zip(part, by_size)],
    }


def linear(xs: Sequence[Column], coefficients: Sequence[float] = (1.0, 2.0, 3.0)) -> Column:
    return reduce(lambda p, q: p + q, [c * x for x, c in zip(xs, coefficients)])


def linear_indices(variances: Sequence[float], coefficients: Sequence[float] = (1.0, 2.0, 3.0)) -> list[float]:
    parts = np.array([c * c * v for c, v in zip(coefficients, variances)])
    return list(parts / parts.sum())


def gaussian_linear_delta(coefficients: Sequence[float] = (1.0, 2.0, 3.0), variances: Sequence[float] = (1.0, 1.0, 1.0), nodes: int = 61) -> list[float]:
    """Borgonovo's delta of a linear model of independent normal inputs.

    Given one input, the output is normal with a smaller variance and a moved mean. Two normal densities cross in two
    points, between which their difference keeps its sign, so the area between them is a difference of distribution
    functions; over the input it is averaged by Gauss-Hermite quadrature.
    """
    parts = np.array([c * c * v for c, v in zip(coefficients, variances)])
    whole = parts.sum()
    z, w = np.polynomial.hermite_e.hermegauss(nodes)
    cdf = lambda x, m, v: normal_cdf((x - m) / math.sqrt(v), NUMPY)
    out = []
    for p in parts:
        rest = whole - p
        if p <= 0 or rest <= 0:
            out.append(0.0 if p <= 0 else 1.0)
            continue
        m = math.sqrt(p) * z
        # rest * x^2 - whole * (x - m)^2 = whole * rest * log(rest / whole) at the crossings
        root = np.sqrt(m * m * whole * rest + p * whole * rest * math.log(whole / rest))
        low, high = (whole * m - root) / p, (whole * m + root) / p
        inside = (cdf(high, m, rest) - cdf(low, m, rest)) - (cdf(high, 0.0, whole) - cdf(low, 0.0, whole))
        out.append(float((w * inside).sum() / w.sum()))
    return out


def gaussian_linear_transport(coefficients: Sequence[float] = (1.0, 2.0, 3.0), variances: Sequence[float] = (1.0, 1.0, 1.0)) -> list[float]:
    """The transport index of the same model: squared distance of means and of deviations over twice the variance."""
    parts = np.array([c * c * v for c, v in zip(coefficients, variances)])
    whole = parts.sum()
    return [float((p + (math.sqrt(whole) - math.sqrt(whole - p)) ** 2) / (2 * whole)) for p in parts]


def oakley_ohagan(xs: Sequence[Column], linear_: Sequence[float], sines: Sequence[float], cosines: Sequence[float], matrix: np.ndarray) -> Column:
    """``a1'x + a2'sin(x) + a3'cos(x) + x'Mx``; the published coefficients are the caller's to load, the matrix has 225."""
    terms = [a * x + b * F.sin(x) + c * F.cos(x) for x, a, b, c in zip(xs, linear_, sines, cosines)]
    rows = [x * reduce(lambda p, q: p + q, [float(m) * y for m, y in zip(row, xs)]) for x, row in zip(xs, np.asarray(matrix))]
    return reduce(lambda p, q: p + q, terms + rows)


def oakley_ohagan_indices(linear_: Sequence[float], sines: Sequence[float], cosines: Sequence[float], matrix: np.ndarray, sigma: float = 1.0) -> dict[str, np.ndarray]:
    """``s1``, ``st`` and the matrix ``s2`` (NaN on its diagonal) for independent N(0, sigma^2) inputs, from normal moments."""
    m, v = np.asarray(matrix, float), sigma * sigma
    a, b, c, d = (np.asarray(x, float) for x in (linear_, sines, cosines, np.diag(m)))
    e = math.exp(-v / 2)
    odd = a * a * v + 2 * a * b * v * e + b * b * (1 - e**4) / 2
    even = c * c * ((1 + e**4) / 2 - e * e) - 2 * c * d * v * v * e + 2 * d * d * v * v
    pairs = ((m + m.T) * v) ** 2
    np.fill_diagonal(pairs, 0.0)
    total = (odd + even).sum() + pairs.sum() / 2
    s2 = pairs / total
    np.fill_diagonal(s2, np.nan)
    return {"s1": (odd + even) / total, "st": (odd + even + pairs.sum(1)) / total, "s2": s2}
