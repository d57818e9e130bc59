"""Normal distribution and incomplete beta function.

Each formula is written once and runs on Spark Columns as well as on NumPy arrays: ``SPARK`` and ``NUMPY``
bring the functions that differ.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: ``let`` names a value that an expression uses often, so that its own expression stands there once.
SPARK = SimpleNamespace(let=lambda x, f: F.element_at(F.transform(F.array(x), f), 1), exp=F.exp, log=F.log, sqrt=F.sqrt, abs=F.abs, pow=F.pow, expm1=F.expm1, log1p=F.log1p, where=lambda c, a, b: F.when(c, a).otherwise(b), clip=lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b)))
NUMPY = SimpleNamespace(let=lambda x, f: f(x), exp=np.exp, log=np.log, sqrt=np.sqrt, abs=np.abs, pow=np.power, expm1=np.expm1, log1p=np.log1p, where=np.where, clip=np.clip)

# Coefficients of Wichura's rational approximations to the normal quantile (AS 241, PPND16).
CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
SHOULDER = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def _poly(coefficients, x):
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_ppf(u, ops=SPARK):
    """The standard normal quantile at ``u`` in (0, 1)."""

    def at(u, r):
        q = u - 0.5
        inner = 0.180625 - q * q
        mid = q * _poly(CENTRE[0], inner) / _poly(CENTRE[1], inner)
        near, far = r - 1.6, r - 5.0
        side = ops.where(r <= 5.0, _poly(SHOULDER[0], near) / _poly(SHOULDER[1], near), _poly(TAIL[0], far) / _poly(TAIL[1], far))
        return ops.where(ops.abs(q) <= 0.425, mid, ops.where(q < 0, -side, side))

    tail = lambda u: ops.sqrt(-ops.log(ops.clip(ops.where(u < 0.5, u, 1.0 - u), 1e-300, 0.5)))
    return ops.let(u, lambda u: ops.let(tail(u), lambda r: at(u, r)))


# Coefficients of Cody's rational approximations to erf and erfc (1969).
ERF = (
    [3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02, 3.16112374387056560e00, 1.85777706184603153e-1],
    [2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02, 2.36012909523441209e01, 1.0],
)
ERFC = (
    [1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03, 8.81952221241769090e02, 2.98635138197400131e02, 6.61191906371416295e01, 8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8],
    [1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03, 3.29079923573345963e03, 1.62138957456669019e03, 5.37181101862009858e02, 1.17693950891312499e02, 1.57449261107098347e01, 1.0],
)
ERFC_FAR = (
    [-6.58749161529837803e-4, -1.60837851487422766e-2, -1.25781726111229246e-1, -3.60344899949804439e-1, -3.05326634961232344e-1, -1.63153871373020978e-2],
    [2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725e00, 2.56852019228982242e00, 1.0],
)


def normal_cdf(x, ops=SPARK):
    """The standard normal distribution function, by rational approximations to the error function in three ranges."""

    def at(x, a):
        near, mid, far = ops.clip(a, 0.0, 0.46875), ops.clip(a, 0.46875, 4.0), ops.clip(a, 4.0, 26.0)
        inner = near * _poly(ERF[0], near * near) / _poly(ERF[1], near * near)
        inverse = 1.0 / (far * far)
        upper = ops.where(a <= 4.0, ops.exp(-mid * mid) * _poly(ERFC[0], mid) / _poly(ERFC[1], mid), ops.exp(-far * far) / far * (1 / math.sqrt(math.pi) + inverse * _poly(ERFC_FAR[0], inverse) / _poly(ERFC_FAR[1], inverse)))
        half = ops.where(a <= 0.46875, 0.5 - 0.5 * inner, 0.5 * upper)
        return ops.where(x > 0, 1.0 - half, half)

    return ops.let(x, lambda x: ops.let(ops.abs(x) / math.sqrt(2), lambda a: at(x, a)))


def normal_ppf_sql(u: str) -> str:
    """The SQL of ``normal_ppf`` for an expression ``u``, for engines without one."""
    poly = lambda c, x: f"({repr(c[-1])})" if len(c) == 1 else f"(({repr(c[0])}) + ({x}) * {poly(c[1:], x)})"
    q, r = f"(({u}) - 0.5)", f"sqrt(-ln(least({u}, 1.0 - ({u}))))"
    part = lambda c, x: f"{poly(c[0], x)} / {poly(c[1], x)}"
    side = f"CASE WHEN {r} <= 5.0 THEN {part(SHOULDER, f'({r} - 1.6)')} ELSE {part(TAIL, f'({r} - 5.0)')} END"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {part(CENTRE, f'(0.180625 - {q} * {q})')} WHEN {q} < 0 THEN -({side}) ELSE {side} END)"


def betainc(a: float, b: float, x) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    x = np.asarray(x, float)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 0, 1)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d
    for m in range(1, 300):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log + p * np.log(z) + q * np.log1p(-z)) / p
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * f))
    return np.where(flip, 1 - out, out)


def betaincinv(a: float, b: float, u) -> np.ndarray:
    """The inverse of ``betainc`` by bisection to the last bit that matters."""
    u = np.asarray(u, float)
    low, high = np.zeros_like(u), np.ones_like(u)
    for _ in range(60):
        mid = 0.5 * (low + high)
        under = betainc(a, b, mid) < u
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return 0.5 * (low + high)


def f_ppf(p: float, d1: float, d2: float) -> float:
    """The quantile of the F distribution."""
    x = float(betaincinv(d1 / 2, d2 / 2, p))
    return d2 * x / (d1 * (1 - x))
