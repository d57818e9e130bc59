"""Surrogates fitted by one pass over the runs: polynomial chaos, HDMR, kernel expansion; Shapley effects from their terms.

Each partition reduces its rows to a small matrix, and these are merged in groups until one is left: a triangular
factor (least squares by tall QR) or a Gram matrix. Its size depends on the basis alone, never on the number of runs.
Fits of many outputs, and of replicates, are in ``many``.
"""

from __future__ import annotations

import functools
import itertools
import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import f_ppf, normal_cdf, normal_ppf
from ..plans.lineage import cut
from ..problem import NUMPY, Gaussian, Problem, gate

#: Partial matrices that one task merges.
MERGED = 32
#: What a task, or a key on its way, is known by: a matrix as bytes with its number of rows.
SHAPE = "k int, g bigint, rows int, m binary"


def partial_rows(kept: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    """A task's matrices by key, a row for each."""
    for k, m in kept.items():
        yield pd.DataFrame({"k": [k], "g": [TaskContext.get().partitionId()], "rows": [m.shape[0]], "m": [np.ascontiguousarray(m, float).tobytes()]})


def unpacked(row) -> np.ndarray:
    return np.frombuffer(row.m).reshape(row.rows, -1)


def together(parts: DataFrame, merge: Callable[[np.ndarray], np.ndarray], partitions: int) -> DataFrame:
    """One row of ``SHAPE`` for each key: matrices are merged ``MERGED`` at a time, level by level.

    Groups go by partition, so that no task receives all of a key, and nothing meets on the driver.
    """

    def one(f: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack([unpacked(r) for r in f.itertuples()])
        m = merge(stack) if len(stack) > 1 else stack[0]
        return pd.DataFrame({"k": f.k[:1], "g": f.g[:1], "rows": [m.shape[0]], "m": [np.ascontiguousarray(m, float).tobytes()]})

    left = partitions
    while True:
        left = -(-left // MERGED)
        parts = parts.withColumn("g", F.col("g") % left).groupBy("k", "g").applyInPandas(one, SHAPE)
        if left == 1:
            return parts


def reduced_by(runs: DataFrame, cols: Sequence[str], start: Callable[[np.ndarray], dict[int, np.ndarray]], merge: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Matrices over all rows by key: ``start`` makes one for each key of a batch of rows, ``merge`` one of a stack of them.

    Partitions merge their own, tasks merge these (``together``), and one matrix of each key comes to the driver.
    """

    def partial(frames):
        kept: dict[int, np.ndarray] = {}
        for f in frames:
            if len(f):
                for k, part in start(f.to_numpy(float)).items():
                    kept[k] = merge(np.stack([kept[k], part])) if k in kept else part
        yield from partial_rows(kept)

    parts = runs.select(*[F.col(c).cast("double") for c in cols]).mapInPandas(partial, SHAPE)
    return {r.k: unpacked(r) for r in together(parts, merge, runs.rdd.getNumPartitions()).collect()}


def reduced(runs: DataFrame, cols: Sequence[str], start: Callable[[np.ndarray], np.ndarray], merge: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """One matrix over all rows, as ``reduced_by``; None of none."""
    return reduced_by(runs, cols, lambda a: {0: start(a)}, merge).get(0)


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangular factor of rows, padded with zeros where there are too few."""
    p = rows.shape[1]
    return np.linalg.qr(np.concatenate([rows, np.zeros((max(0, p - len(rows)), p))]), mode="r")[:p]


def legendre(t: np.ndarray, order: int) -> np.ndarray:
    """Orthonormal Legendre polynomials on [-1, 1], a column for each degree."""
    out = [np.ones_like(t), t]
    for k in range(1, order):
        out.append(((2 * k + 1) * t * out[k] - k * out[k - 1]) / (k + 1))
    return np.stack([math.sqrt(2 * k + 1) * out[k] for k in range(order + 1)], 1)


def hermite(z: np.ndarray, order: int) -> np.ndarray:
    """Orthonormal probabilists' Hermite polynomials."""
    out = [np.ones_like(z), z]
    for k in range(1, order):
        out.append(z * out[k] - k * out[k - 1])
    return np.stack([out[k] / math.sqrt(math.factorial(k)) for k in range(order + 1)], 1)


def total_degree(d: int, order: int) -> list[tuple[int, ...]]:
    """Exponents of total degree up to ``order``, by degree, then in falling lexicographic order."""
    return sorted((e for e in itertools.product(range(order + 1), repeat=d) if sum(e) <= order), key=lambda e: (sum(e), [-x for x in e]))


def effective_order(d: int, n: int, order: int, fit_ratio: float = 0.5) -> int:
    """The largest order, up to ``order``, whose number of terms is at most ``fit_ratio`` of the runs."""
    while order > 1 and math.comb(d + order, order) > fit_ratio * n:
        order -= 1
    if d + 1 > int(fit_ratio * n):
        raise ValueError("too few runs for a fit of order 1")
    return order


@functools.cache
def truncated_normal(low: float, high: float, order: int) -> tuple[float, float, list[float], list[float]]:
    """Mean and deviation of a standard normal cut to [low, high], and the recurrence of its orthonormal polynomials.

    Stieltjes' procedure on Gauss-Legendre nodes: each next polynomial is the last one times the variable, made
    orthogonal to all before, twice. Open sides end nine deviations from the nearest point to zero.
    """
    nearest = min(max(0.0, low), high)
    a, b = max(low, nearest - 9), min(high, nearest + 9)
    t, w = np.polynomial.legendre.leggauss(400 + 25 * order)
    z = (b - a) / 2 * t + (b + a) / 2
    w = w * np.exp(-0.5 * (z * z - nearest * nearest))
    w /= w.sum()
    mean = float(w @ z)
    scale = math.sqrt(float(w @ (z - mean) ** 2))
    v, basis, alpha, beta = (z - mean) / scale, [np.sqrt(w)], [], []
    for _ in range(order):
        now = v * basis[-1]
        alpha.append(float(now @ basis[-1]))
        done = np.stack(basis)
        for _ in range(2):
            now = now - done.T @ (done @ now)
        beta.append(float(np.linalg.norm(now)))
        basis.append(now / beta[-1])
    return mean, scale, alpha, beta


def recurrence(v: np.ndarray, alpha: Sequence[float], beta: Sequence[float]) -> np.ndarray:
    """Polynomials of a three-term recurrence, a column for each degree."""
    out = [np.ones_like(v)]
    for k, (a, b) in enumerate(zip(alpha, beta)):
        out.append(((v - a) * out[-1] - (beta[k - 1] * out[-2] if k else 0.0)) / b)
    return np.stack(out, 1)


@dataclass
class Expansion:
    """Coefficients of terms; a term's exponents say which inputs it involves. ``quality`` has the diagnostics of the fit."""

    problem: Problem
    terms: list[tuple[int, ...]]
    coefficients: np.ndarray
    order: int
    quality: dict[str, float] = field(default_factory=dict)

    def design(self, x: np.ndarray) -> np.ndarray:
        """Each term at rows of values: Hermite polynomials of normal inputs, those of the cut normal of truncated ones, Legendre of all others' places."""
        one = []
        for j, m in enumerate(self.problem.inputs.values()):
            if not isinstance(m, Gaussian):
                one.append(legendre(2 * np.asarray(m.cdf(x[:, j], NUMPY)) - 1, self.order))
                continue
            s = math.sqrt(m.variance_)
            z = (x[:, j] - m.mean) / s
            if m.low is None and m.high is None:
                one.append(hermite(z, self.order))
            else:
                mean, scale, alpha, beta = truncated_normal(-math.inf if m.low is None else (m.low - m.mean) / s, math.inf if m.high is None else (m.high - m.mean) / s, self.order)
                one.append(recurrence((z - mean) / scale, alpha, beta))
        return np.stack([math.prod((one[j][:, e] for j, e in enumerate(t) if e), start=np.ones(len(x))) for t in self.terms], 1)

    def predict(self, runs: DataFrame) -> DataFrame:
        """``runs`` with ``prediction``; works on streams as well."""
        names, coefficients, design = self.problem.names, self.coefficients, self.design
        return predicted(runs, names, lambda x: design(x) @ coefficients)

    def variances(self) -> dict[tuple[int, ...], float]:
        """Variance of each set of inputs."""
        out: dict[tuple[int, ...], float] = {}
        for t, c in zip(self.terms, self.coefficients):
            if u := tuple(j for j, e in enumerate(t) if e):
                out[u] = out.get(u, 0.0) + float(c) ** 2
        return out

    def indices(self) -> pd.DataFrame:
        return indices_from_variances(self.variances(), self.problem.names)

    def second_order(self) -> pd.DataFrame:
        return second_order(self.variances(), self.problem.names)


def predicted(runs: DataFrame, names: Sequence[str], value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``runs`` with ``prediction``, ``value`` of batches of its inputs."""

    def kernel(frames):
        for f in frames:
            yield f.assign(prediction=value(f[list(names)].to_numpy(float)) if len(f) else pd.Series([], dtype=float))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    return runs.mapInPandas(kernel, f"{fields}, prediction double")


def default_ridge(r: np.ndarray) -> float:
    """The ridge of a fit without one: round-off of the Gram matrix, or 1e-12 of it where the design is singular to round-off."""
    pivots = np.abs(np.diag(r))
    singular = not len(pivots) or pivots.min() ** 2 <= len(r) * np.finfo(float).eps * (pivots.max() ** 2 or 1.0)
    return (1e-12 if singular else float(np.finfo(float).eps)) * float((r * r).sum()) / max(1, len(r))


def _solved(r: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and triangular factor of a ridge fit, from the factor of design and output."""
    p = r.shape[1] - 1
    low = math.sqrt(ridge) * np.eye(p)
    full = triangle(np.concatenate([r, np.column_stack([low, np.zeros(p)])]))
    return np.linalg.lstsq(full[:p, :p], full[:p, p], rcond=None)[0], full[:p, :p]


def pce(runs: DataFrame, problem: Problem, y: str = "y", order: int = 3, ridge: float | None = None, fit_ratio: float = 0.5, weight: str | None = None, check: bool = True) -> Expansion:
    """Polynomial chaos by ridge least squares over all rows, solved from merged triangular factors.

    Without ``ridge``, that of ``default_ridge``. ``weight`` counts each row so often, for a replicate. With ``check``, a
    second pass takes leave-one-out errors from each row's leverage, and warns of an input that is constant, of terms
    that the data can't tell apart, and of a fit that predicts worse than the mean.
    """
    gate(problem, "pce")
    wanted, order = order, effective_order(len(problem.names), runs.count(), order, fit_ratio)
    if order < wanted:
        warnings.warn(f"the order is {order} for {wanted}: there are too few runs", stacklevel=2)
    fit = Expansion(problem, total_degree(len(problem.names), order), np.zeros(0), order)
    design, cols = fit.design, [*problem.names, y, *([weight] if weight else [])]
    d = len(problem.names)

    def rows(a: np.ndarray) -> np.ndarray:
        whole = np.column_stack([design(a[:, :d]), a[:, d]])
        return whole * np.sqrt(a[:, d + 1])[:, None] if weight else whole

    r = reduced(runs, cols, lambda a: triangle(rows(a)), lambda s: triangle(s.reshape(-1, s.shape[2])))
    p = r.shape[1] - 1
    ridge = default_ridge(r[:p, :p]) if ridge is None else ridge
    fit.coefficients, factor = _solved(r, ridge)
    if not np.isfinite(fit.coefficients).all():
        raise ValueError("the fit is not finite")
    if check:
        coefficients, inverse = fit.coefficients, np.linalg.pinv(factor)

        def errors(a: np.ndarray) -> np.ndarray:
            phi = design(a[:, :d])
            left = a[:, d] - phi @ coefficients
            h = np.clip(((phi @ inverse) ** 2).sum(1), 0, 1 - 1e-9)
            return np.array([[len(a), (left**2).sum(), ((left / (1 - h)) ** 2).sum(), a[:, d].sum(), (a[:, d] ** 2).sum()]])

        n, sse, loo, t, q = reduced(runs, [*problem.names, y], errors, lambda s: s.sum(0))[0]
        var = q / n - (t / n) ** 2
        pivots = np.abs(np.diag(r[:p, :p]))
        fit.quality = {"n": n, "rmse": math.sqrt(sse / n), "cv_rmse": math.sqrt(loo / n), "variance": var, "explained_variance": sum(fit.variances().values()) / var if var > 0 else math.nan, "ridge": ridge, "pivot_share": float(pivots.min() / pivots.max())}
        spans = runs.agg(*[(F.max(c) - F.min(c)).alias(f"s{i}") for i, c in enumerate(problem.names)]).first()
        if still := [c for i, c in enumerate(problem.names) if not spans[f"s{i}"]]:
            warnings.warn(f"inputs {still} are constant", stacklevel=2)
        elif fit.quality["pivot_share"] < 1e-7:
            warnings.warn("some terms can't be told apart on these runs", stacklevel=2)
        if var > 0 and loo / n > var:
            warnings.warn("leave-one-out errors are larger than the output's deviation: the fit follows noise", stacklevel=2)
    return fit


def indices_from_variances(parts: dict[tuple[int, ...], float], names: Sequence[str]) -> pd.DataFrame:
    """``param, s1, st, shapley`` from the variance of each set of inputs; a total of zero gives NaN. A set's variance is shared equally for Shapley effects."""
    total = sum(parts.values())
    rows = []
    for j, n in enumerate(names):
        mine = {u: v for u, v in parts.items() if j in u}
        share = lambda x: x / total if total > 0 else math.nan
        rows.append((n, share(parts.get((j,), 0.0)), share(sum(mine.values())), share(sum(v / len(u) for u, v in mine.items()))))
    return pd.DataFrame(rows, columns=["param", "s1", "st", "shapley"])


def second_order(parts: dict[tuple[int, ...], float], names: Sequence[str]) -> pd.DataFrame:
    total = sum(parts.values()) or math.nan
    return pd.DataFrame([(names[i], names[j], parts.get((i, j), 0.0) / total) for i, j in itertools.combinations(range(len(names)), 2)], columns=["param", "param_j", "s2"])


def bsplines(u: np.ndarray, intervals: int) -> np.ndarray:
    """Cubic B-splines on [0, 1] over equal intervals, ``intervals + 3`` columns, by the recurrence on uniform knots."""
    u = np.clip(u, 0, 1)
    knots = np.arange(-3, intervals + 4) / intervals
    cell = np.minimum((u * intervals).astype(int), intervals - 1)
    out = (cell[:, None] + 3 == np.arange(intervals + 6)[None]).astype(float)
    for k in range(1, 4):
        left = (u[:, None] - knots[None, : -k - 1]) / (knots[k:-1] - knots[: -k - 1])[None]
        right = (knots[None, k + 1 :] - u[:, None]) / (knots[k + 1 :] - knots[1:-k])[None]
        out = left * out[:, :-1] + right * out[:, 1:]
    return out


@dataclass
class Hdmr:
    """Terms (sets of inputs), their structural (sa), correlative (sb) and total (s) shares, and whether an F test selects them."""

    names: list[str]
    terms: pd.DataFrame
    explained: float
    problem: Problem | None = None
    basis: Callable[[np.ndarray], np.ndarray] | None = None
    weights: np.ndarray | None = None
    offset: float = 0.0
    rmse: float = math.nan

    def totals(self) -> pd.DataFrame:
        return pd.DataFrame([(n, float(self.terms.s[[n in t.split("*") for t in self.terms.term]].sum())) for n in self.names], columns=["param", "st"])

    def variances(self, correlative: bool = False) -> dict[tuple[int, ...], float]:
        """Each set's structural share, with ``correlative`` its total one."""
        sets = [tuple(self.names.index(c) for c in t.split("*")) for t in self.terms.term]
        return dict(zip(sets, map(float, self.terms["s" if correlative else "sa"])))

    def first(self) -> pd.DataFrame:
        """``param, s1``: structural shares of single inputs."""
        v = self.variances()
        return pd.DataFrame([(n, v.get((i,), 0.0)) for i, n in enumerate(self.names)], columns=["param", "s1"])

    def second(self) -> pd.DataFrame:
        v = self.variances()
        return pd.DataFrame([(self.names[i], self.names[j], v.get((i, j), 0.0)) for i, j in itertools.combinations(range(len(self.names)), 2)], columns=["param", "param_j", "s2"])

    def shapley(self, correlative: bool = False) -> pd.DataFrame:
        return indices_from_variances(self.variances(correlative), self.names)

    def predict(self, runs: DataFrame) -> DataFrame:
        """``runs`` with ``prediction``."""
        basis, weights, offset = self.basis, self.weights, self.offset
        return predicted(runs, self.names, lambda x: basis(x) @ weights + offset)


def backfit(k: np.ndarray, c: np.ndarray, m: int, ridge: float, most: int = 100, tol: float = 1e-3) -> np.ndarray:
    """Functions of single inputs in turn, each fitted to what the others leave, until none changes by ``tol`` of the largest weight.

    ``c`` may have a column for each output; a column rests once it has settled.
    """
    one = c.ndim == 1
    c = c.reshape(len(c), -1)
    w, blocks, moving = np.zeros(c.shape), [slice(i, i + m) for i in range(0, len(c), m)], np.arange(c.shape[1])
    inner = [k[b, b] + ridge * np.trace(k[b, b]) / m * np.eye(m) for b in blocks]
    for _ in range(most):
        now = w[:, moving]
        before = now.copy()
        for b, own in zip(blocks, inner):
            now[b] = np.linalg.lstsq(own, c[b][:, moving] - k[b] @ now + k[b, b] @ now[b], rcond=None)[0]
        w[:, moving] = now
        moving = moving[np.abs(now - before).max(0, initial=0) > tol * np.abs(now).max(0, initial=1e-300)]
        if not len(moving):
            break
    return w[:, 0] if one else w


def conjugate_gradient(k: np.ndarray, c: np.ndarray, size: int, tol: float = 1e-10, most: int = 1000) -> np.ndarray:
    """The solution of ``k w = c`` by conjugate gradients, preconditioned by the inverses of its diagonal blocks."""
    blocks = [slice(i, i + size) for i in range(0, len(c), size)]
    inverse = [np.linalg.pinv(k[b, b]) for b in blocks]
    soft = lambda r: np.concatenate([p @ r[b] for p, b in zip(inverse, blocks)])
    w, r = np.zeros_like(c), c.copy()
    z = soft(r)
    p, rz, goal = z.copy(), r @ z, tol * np.linalg.norm(c)
    for _ in range(most):
        if np.linalg.norm(r) <= goal:
            break
        kp = k @ p
        step = rz / (p @ kp)
        w, r = w + step * p, r - step * kp
        z = soft(r)
        p, rz = z + (r @ z) / rz * p, r @ z
    return w


#: Pair weights beyond which they are solved for by conjugate gradients.
DENSE = 4000


def hdmr(runs: DataFrame, problem: Problem, y: str = "y", order: int = 2, intervals: int = 2, ridge: float = 1e-6, level: float = 0.95, most: int = 100, tol: float = 1e-3, weight: str | None = None, solver: str | None = None) -> Hdmr:
    """High-dimensional model representation by B-splines from one Gram matrix, with analysis of covariance for dependent inputs.

    First-order functions are fitted in turn (``backfit``); pair functions are made orthogonal to them and fitted to
    what they leave. ``ridge`` is relative to a block's mean diagonal, and at least the root of machine precision for
    pairs. ``weight`` counts each row so often, for a replicate. With more pair weights than runs, the pairs are solved for in the space of the
    runs (``dual``), with the same result; ``solver`` may name that or ``dense``.
    """
    gate(problem, "hdmr")
    if order not in (1, 2) or solver not in (None, "dense", "dual"):
        raise ValueError("order is 1 or 2, solver dense or dual")
    names, d, m = problem.names, len(problem.names), intervals + 3
    if (size := runs.count()) < m ** min(order, d) + 1:
        raise ValueError("too few runs")
    pairs = list(itertools.combinations(range(d), 2)) if order == 2 else []
    if solver is None:
        from .dual import MOST as fits

        solver = "dual" if len(pairs) * m * m > min(size, DENSE) and size <= fits else "dense"
    if solver == "dual" and pairs:
        from .dual import dual_hdmr

        return dual_hdmr(runs, problem, y, intervals, pairs, ridge, level, most, tol, weight)
    basis = hdmr_basis(problem, intervals, pairs)

    def gram(a: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.ones(len(a)), basis(a[:, :d]), a[:, d]])
        return b.T @ (b * a[:, d + 1][:, None] if weight else b)

    g = reduced(runs, [*names, y, *([weight] if weight else [])], gram, lambda s: s.sum(0))
    n = g[0, 0]
    cov = (g - np.outer(g[0], g[0]) / n)[1:, 1:] / n
    got = hdmr_terms(cov[:-1, :-1], cov[:-1, -1:], cov[-1:, -1], n, d, pairs, m, ridge, level, most, tol)
    table = pd.DataFrame({"term": term_names(names, pairs), **{c: got[c][0] for c in ("sa", "sb", "s", "selected")}})
    weights = got["weights"][:, 0]
    return Hdmr(names, table, float(got["explained"][0]), problem, basis, weights, float(g[0, -1] / n - g[0, 1:-1] / n @ weights), math.sqrt(got["left"][0]))


def term_names(names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> list[str]:
    return [*names, *[f"{names[i]}*{names[j]}" for i, j in pairs]]


def hdmr_basis(problem: Problem, intervals: int, pairs: Sequence[tuple[int, int]]) -> Callable[[np.ndarray], np.ndarray]:
    """B-splines of single inputs and products of two, at rows of values."""
    marginals = list(problem.inputs.values())

    def basis(x: np.ndarray) -> np.ndarray:
        one = [bsplines(np.asarray(marginal.cdf(x[:, j], NUMPY)), intervals) for j, marginal in enumerate(marginals)]
        two = [(one[i][:, :, None] * one[j][:, None, :]).reshape(len(x), -1) for i, j in pairs]
        return np.column_stack([*one, *two])

    return basis


def hdmr_terms(cov: np.ndarray, with_y: np.ndarray, var: np.ndarray, n: float, d: int, pairs: Sequence[tuple[int, int]], m: int, ridge: float, level: float, most: int, tol: float) -> dict[str, np.ndarray]:
    """Weights and analysis of covariance of each output, from covariances of the basis, with the outputs (a column each), and their variances.

    The basis alone is factored, once for all outputs. Gives ``sa``, ``sb``, ``s`` and ``selected`` (outputs x terms), ``weights`` (basis x
    outputs), and what is ``left`` of and ``explained`` of each output's variance.
    """
    q, size = d * m, m * m
    first, rest = slice(0, q), slice(q, q + len(pairs) * size)
    c1 = with_y[first]
    w1, shift, w2 = backfit(cov[first, first], c1, m, ridge, most, tol), np.zeros((q, 0)), np.zeros((0, with_y.shape[1]))
    if pairs:
        shift = projection(cov[first, first], cov[first, rest])
        k2 = cov[rest, rest] - cov[rest, first] @ shift
        mean = lambda a: np.diag(a).reshape(len(pairs), size).mean(1)
        ridges, alive = pair_ridges(mean(cov[rest, rest]), mean(k2), ridge)
        on = np.repeat(alive, size)
        k2 = k2[np.ix_(on, on)] + np.diag(np.repeat(ridges, size)[on])
        target = (with_y[rest] - shift.T @ c1)[on]
        w2 = np.zeros((len(on), with_y.shape[1]))
        w2[on] = np.linalg.lstsq(k2, target, rcond=None)[0] if len(k2) <= DENSE else np.stack([conjugate_gradient(k2, t, size) for t in target.T], 1)
    sizes = np.array([m] * d + [size] * len(pairs))
    out: dict[str, list] = {k: [] for k in ("sa", "sb", "s", "selected", "left", "explained")}
    bounds = f_bounds(level, sizes, n)
    weights = np.zeros((len(cov), with_y.shape[1]))
    for o in range(with_y.shape[1]):
        whole = np.zeros((len(cov), len(sizes)))  # a column for each term's function, in the joint basis
        for j in range(d):
            whole[j * m : (j + 1) * m, j] = w1[j * m : (j + 1) * m, o]
        for k in range(len(pairs)):
            own = slice(k * size, (k + 1) * size)
            whole[q:, d + k][own] = w2[own, o]
            whole[:q, d + k] = -shift[:, own] @ w2[own, o]
        one = ancova(whole.T @ cov @ whole, whole.T @ with_y[:, o], var[o], n, sizes, bounds)
        for k, v in one.items():
            out[k].append(v)
        weights[:, o] = whole.sum(1)
    return {k: np.array(v) for k, v in out.items()} | {"weights": weights}


def f_bounds(level: float, sizes: np.ndarray, n: float) -> np.ndarray:
    """What the F statistic of each term must be above to be selected."""
    free = float(n - sizes.sum())
    known = {int(k): f_ppf(level, int(k), free) if free > 0 else math.inf for k in set(sizes)}
    return np.array([known[int(k)] for k in sizes])


def ancova(inner: np.ndarray, covered: np.ndarray, var: float, n: float, sizes: np.ndarray, bounds: np.ndarray) -> dict[str, object]:
    """Shares of terms, and which an F test selects, from covariances of the terms' functions and of each with the output."""
    s, sa, free = inner.sum(1), np.diag(inner), n - sizes.sum()
    every = var - 2 * covered.sum() + inner.sum()
    full = max(every, 0.0)
    without = every + 2 * covered - 2 * s + sa  # what is left without each term
    f = (without - full) / sizes / max(full / free, 1e-300) if free > 0 else np.zeros(len(sizes))
    scale = var if var > 0 else math.nan
    return {"sa": sa / scale, "sb": (s - sa) / scale, "s": s / scale, "selected": (f > bounds) & (free > 0), "left": full, "explained": 1 - full / scale}


def projection(first: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights of single inputs' splines that pair functions have in common with them, by the spectrum above round-off."""
    values, vectors = np.linalg.eigh(first)
    keep = values > math.sqrt(np.finfo(float).eps) * values.max()
    return (vectors[:, keep] / values[keep]) @ vectors[:, keep].T @ cross


def pair_ridges(raw: np.ndarray, projected: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """The ridge of each pair's block, and which pairs are alive, from mean diagonals of the blocks and of what projection leaves of them.

    A ridge is at least the projection's round-off. A pair of which nothing is left beyond single inputs is dead: its functions are zero.
    """
    root = math.sqrt(np.finfo(float).eps)
    return np.maximum(ridge * projected, root * raw), projected > root * projected.max()


@dataclass
class Kernel:
    """A Gaussian kernel expansion over chosen centres in unit coordinates."""

    problem: Problem
    centres: np.ndarray
    weights: np.ndarray
    mean: float
    gamma: float
    ridge: float = 0.0
    rmse: float = math.nan
    cv_rmse: float = math.nan

    def at(self, u: np.ndarray) -> np.ndarray:
        return self.mean + gaussian_kernel(u, self.centres, self.gamma) @ self.weights

    def predict(self, runs: DataFrame) -> DataFrame:
        """``runs`` with ``prediction``."""
        marginals, at = list(self.problem.inputs.values()), self.at
        return predicted(runs, self.problem.names, lambda x: at(np.column_stack([np.asarray(m.cdf(x[:, j], NUMPY)) for j, m in enumerate(marginals)])))


def gaussian_kernel(u: np.ndarray, v: np.ndarray, gamma: float) -> np.ndarray:
    out = np.add.outer((u * u).sum(1), (v * v).sum(1))
    out -= 2 * u @ v.T
    np.maximum(out, 0, out=out)
    out *= -gamma
    return np.exp(out, out=out)


#: Grids of the search, powers of ten: gamma from 0.01 to 50, ridge from 1e-6 to 1e-2 and four smaller ones.
GAMMAS = tuple(float(g) for g in np.logspace(-2, math.log10(50), 10))
RIDGES = tuple(float(r) for r in [*np.logspace(-14, -8, 4), *np.logspace(-6, -2, 10)])
def vkoga(runs: DataFrame, problem: Problem, y: str = "y", gammas: Sequence[float] = GAMMAS, ridges: Sequence[float] = RIDGES, max_centres: int = 300, folds: int = 10, seed: int = 0, held: int | None = None) -> Kernel:
    """A greedy kernel expansion over all runs; gamma and ridge by cross-validation over all of them.

    Centres are chosen over all runs (``greedy``), for each fold over those of the others; weights follow from sums in the Newton
    basis. ``held`` says how many numbers of the table one task may hold: larger fits go by rounds over it.
    """
    from . import greedy

    gate(problem, "vkoga")
    names = problem.names
    if len(names) < 2:
        raise ValueError("two inputs at least")
    n, mean = runs.agg(F.count("*"), F.avg(y)).first()
    h = F.pmod(F.xxhash64(F.lit(seed), *names, y), F.lit(folds)).cast("double").alias("fold")
    values = runs.select(*[F.col(c).cast("double").alias(c) for c in names], (F.col(y).cast("double") - mean).alias("y"), h)
    units = cut(problem.units(values))
    fit, gamma, ridge, sse = greedy.searched(units, names, list(gammas), list(ridges), min(max_centres, n), folds, n, held)
    beta = greedy.coefficients(fit.chosen, fit.train, ridge)
    left = np.append(beta, -1.0)
    rmse = math.sqrt(max(0.0, float(left @ fit.train @ left)) / n)
    return Kernel(problem, fit.chosen.points, greedy.weights(fit.chosen, beta), mean, gamma, ridge, rmse, math.sqrt(sse / n))


def components(model: Kernel, joint: DataFrame, ridge: float = 1e-8) -> tuple[list[np.ndarray], Callable[[int, np.ndarray], np.ndarray]]:
    """Additive functions of single inputs fitted to the model over joint draws: coefficients by input, and their basis.

    Hermite polynomials to degree 6 for normal inputs, Legendre to 10 for others (6 where rows are few), all in one
    ridge fit from a merged Gram matrix.
    """
    names, marginals = model.problem.names, list(model.problem.inputs.values())
    normal = [isinstance(m, Gaussian) and m.low is None and m.high is None for m in marginals]
    n = joint.count()
    degrees = [6 if o else 10 for o in normal]
    if n < 2 * sum(degrees):
        degrees = [6] * len(names)

    def basis(j: int, u: np.ndarray) -> np.ndarray:
        if normal[j]:
            return hermite(normal_ppf(np.clip(u, 1e-12, 1 - 1e-12), NUMPY), degrees[j])[:, 1:]
        return legendre(2 * u - 1, degrees[j])[:, 1:]

    def gram(a: np.ndarray) -> np.ndarray:
        u = np.column_stack([np.asarray(m.cdf(a[:, j], NUMPY)) for j, m in enumerate(marginals)])
        b = np.column_stack([np.ones(len(a)), *[basis(j, u[:, j]) for j in range(len(names))], model.at(u)])
        return b.T @ b

    g = reduced(joint, names, gram, lambda s: s.sum(0))
    w = np.linalg.lstsq(g[:-1, :-1] + ridge * n * np.eye(len(g) - 1), g[:-1, -1], rcond=None)[0][1:]
    return [w[a : a + k] for a, k in zip(np.cumsum([0, *degrees[:-1]]), degrees)], basis


#: Largest block of inner points that travels to the tasks.
INNER = 1 << 16


def kernel_indices(model: Kernel, spark: SparkSession, n_outer: int = 512, n_inner: int = 128, n_variance: int = 8192, seed: int = 0) -> DataFrame:
    """``(param, s_tc, s_tu, s_u, s_c, s_iu, variance)`` of a fitted kernel model under the problem's dependence.

    ``s_tc`` is the variance of means given the input, ``s_tu`` the mean variance left given all others, ``s_u`` the part
    of that which an additive function of the input explains (``s_tc`` where inputs are independent), not above ``s_tu``;
    ``s_c`` and ``s_iu`` are what that leaves of them. Sample sizes are rounded up to powers of two. Outer points are
    rows; each task runs its points, a batch at a time, through the inner points, drawn conditionally.
    """
    from ..sources.dependent import conditional, joint
    from ..sources.designs import sobol_points

    problem = model.problem
    names, d = problem.names, len(problem.names)
    if problem.sampler is not None:
        raise ValueError("draw from a custom sampler by kucherenko_design")
    if not all(isinstance(n, int) and n > 0 for n in (n_outer, n_inner, n_variance)):
        raise ValueError("sample sizes are whole numbers above zero")
    up = lambda n: 1 << max(0, (n - 1).bit_length())
    n_outer, n_inner, n_variance = up(n_outer), up(n_inner), up(n_variance)
    if n_inner > INNER:
        raise ValueError("the inner block is too large")
    r = np.eye(d) if problem.correlation is None else np.asarray(problem.correlation)
    low = conditional(r, [])[2]
    inner = np.clip(_points(n_inner, d, seed + 2), 1e-12, 1 - 1e-12)
    e = normal_ppf(inner, NUMPY)
    rows = joint(problem, sobol_points(spark, n_variance, names, seed + 1))
    variance = reduced(rows, names, lambda a: _sums(model, problem, a), lambda s: s.sum(0))
    var = float(variance[0, 2] / variance[0, 0] - (variance[0, 1] / variance[0, 0]) ** 2)
    fitted, basis = components(model, rows) if problem.dependent else ([None] * d, None)
    plan = [(conditional(r, [i]), conditional(r, [j for j in range(d) if j != i])) for i in range(d)]
    cdf = lambda z: normal_cdf(z, NUMPY)

    def nested(frames):
        for f in frames:
            z = normal_ppf(np.clip(f[["u_" + c for c in names]].to_numpy(float), 1e-12, 1 - 1e-12), NUMPY) @ low.T
            for lo in range(0, len(z), 64):
                part = z[lo : lo + 64]
                for i, c in enumerate(names):
                    (others, weights, factor), (_, own, left) = plan[i]
                    drawn = np.empty((len(part), n_inner, d))
                    drawn[:, :, i] = part[:, i : i + 1]
                    drawn[:, :, others] = (part[:, [i]] @ weights.T)[:, None, :] + (e[:, : len(others)] @ factor.T)[None]
                    mean = model.at(cdf(drawn.reshape(-1, d))).reshape(len(part), -1).mean(1)
                    drawn = np.repeat(part[:, None], n_inner, 1)
                    drawn[:, :, i] = (part[:, others] @ own.T)[:, :1] + left[0, 0] * e[None, :, 0]
                    u = cdf(drawn.reshape(-1, d))
                    within = model.at(u).reshape(len(part), -1).var(1, ddof=1)
                    noise = np.zeros(len(part)) if fitted[i] is None else (basis(i, u[:, i]) @ fitted[i]).reshape(len(part), -1).var(1, ddof=1)
                    value = np.zeros(len(part)) if fitted[i] is None else basis(i, cdf(part[:, i])) @ fitted[i]
                    yield pd.DataFrame({"param": c, "mean": mean, "within": within, "noise": noise, "value": value})

    points = sobol_points(spark, n_outer, names, seed + 3)
    per = points.mapInPandas(nested, "param string, mean double, within double, noise double, value double")
    v = F.lit(var if var > 0 else math.nan)
    own = F.greatest(F.var_pop("value") - F.avg("noise"), F.lit(0.0)) if problem.dependent else F.var_pop("mean")
    got = per.groupBy("param").agg((F.var_pop("mean") / v).alias("s_tc"), (F.avg("within") / v).alias("s_tu"), (own / v).alias("raw"))
    got = got.withColumn("s_u", F.least("raw", "s_tu"))
    return got.select("param", "s_tc", "s_tu", "s_u", (F.col("s_tc") - F.col("s_u")).alias("s_c"), (F.col("s_tu") - F.col("s_u")).alias("s_iu"), F.lit(var).alias("variance"))


def _points(n: int, d: int, seed: int) -> np.ndarray:
    """The first ``n`` scrambled Sobol' points, on the driver."""
    from ..sources.designs import BITS, _seeded, scrambled_numbers

    i = np.arange(n, dtype=np.uint64)
    gray, out = i ^ (i >> np.uint64(1)), []
    for k in range(d):
        x = np.full(n, _seeded(seed, k), np.uint64)
        for b, v in enumerate(scrambled_numbers(k, seed)[: max(1, (n - 1).bit_length())]):
            x ^= ((gray >> np.uint64(b)) & np.uint64(1)) * np.uint64(v)
        out.append(x / float(1 << BITS) + 0.5 / (1 << BITS))
    return np.stack(out, 1)


def _sums(model: Kernel, problem: Problem, a: np.ndarray) -> np.ndarray:
    v = model.at(np.column_stack([np.asarray(m.cdf(a[:, j], NUMPY)) for j, m in enumerate(problem.inputs.values())]))
    return np.array([[len(v), v.sum(), (v * v).sum()]])
