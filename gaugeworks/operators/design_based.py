"""Estimators on designed runs: Sobol', Morris, Kucherenko, eFAST and derivative-based measures.

Each takes rows that already hold a unit's runs side by side and is one grouped sum, which Spark
combines before the shuffle. Variances are population variances unless said otherwise; nothing is clipped.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..problem import Gaussian, Problem
from .frames import ratio, undefined_if

NAN = float("nan")


def pick_freeze(outputs: DataFrame, layout: DataFrame, slices: Sequence[str] = ()) -> DataFrame:
    """``(base_id, param, *slices, a, b, ab, ba)`` from outputs by run and the layout ``(base_id, block, param, run_id)``.

    Blocks are A, B, AB and BA; A and B have no param and go to each of the unit's params. One join
    and one shuffle by unit, no self-join.
    """
    return units(layout.join(outputs, "run_id"), slices)


def units(rows: DataFrame, slices: Sequence[str] = ()) -> DataFrame:
    """What ``pick_freeze`` gives, from the layout with its outputs ``(base_id, block, param, *slices, y)``."""
    unit = Window.partitionBy("base_id", *slices)
    whole = lambda k: F.max(F.when(F.col("block") == k, F.col("y"))).over(unit)
    each = rows.select("base_id", *slices, "param", "block", "y", whole("A").alias("a"), whole("B").alias("b")).where(F.col("block").isin("AB", "BA"))
    pick = lambda k: F.max(F.when(F.col("block") == k, F.col("y")))
    return each.groupBy("base_id", *slices, "param").agg(F.max("a").alias("a"), F.max("b").alias("b"), pick("AB").alias("ab"), pick("BA").alias("ba"))


def standardised(rows: DataFrame, cols: Sequence[str], slices: Sequence[str] = ()) -> DataFrame:
    """``cols`` moved by the mean and divided by the deviation of all their values together; a constant slice keeps scale 1.

    Each value counts as often as it stands in the rows, so that A and B count once for each param.
    """
    values = F.array(*map(F.col, cols))
    stat = rows.select(*slices, F.explode(values).alias("v")).groupBy(*slices).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    joined = rows.join(F.broadcast(stat), list(slices)) if slices else rows.crossJoin(F.broadcast(stat))  # one row of moments for each slice
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return joined.withColumns({c: (F.col(c) - F.col("_m")) / scale for c in cols}).drop("_m", "_s")


Mean = Callable[[Column], Column]


def weighted(w: str | None) -> Mean:
    """The mean of an expression over a group's rows, each counted ``w`` times."""
    return F.avg if w is None else (lambda x: F.try_divide(F.sum(F.col(w) * x), F.sum(w)))


def _pooled(a: Column, b: Column, mean: Mean = F.avg) -> Column:
    """Population variance of two columns together."""
    m = mean((a + b) / 2)
    return mean((a * a + b * b) / 2) - m * m


def _corr(u: Column, v: Column, mean: Mean) -> Column:
    cov = mean(u * v) - mean(u) * mean(v)
    return ratio(cov, F.sqrt((mean(u * u) - mean(u) * mean(u)) * (mean(v * v) - mean(v) * mean(v))))


def _paired(u: Column, v: Column, mean: Mean) -> Column:
    m2 = mean((u + v) / 2) * mean((u + v) / 2)
    return ratio(mean(u * v) - m2, mean((u * u + v * v) / 2) - m2)


def sobol_terms(estimator: str, w: str | None = None) -> tuple[Column, Column]:
    """First-order and total index of an estimator over rows ``a, b, ab, ba``, each counted ``w`` times; all are means of products."""
    a, b, ab, ba = map(F.col, ("a", "b", "ab", "ba"))
    mean = weighted(w)
    v = _pooled(a, b, mean)
    if estimator == "saltelli-jansen":
        return ratio(mean(b * (ab - a)), v), ratio(mean((a - ab) * (a - ab)) / 2, v)
    if estimator == "jansen":
        return 1 - ratio(mean((b - ab) * (b - ab)) / 2, v), ratio(mean((a - ab) * (a - ab)) / 2, v)
    if estimator == "mauntz-kucherenko":
        return ratio(mean(b * (ab - a)), v), ratio(mean(a * (a - ab)), v)
    if estimator == "janon-monod":
        return _paired(b, ab, mean), 1 - _paired(a, ab, mean)
    if estimator == "martinez":
        return _corr(b, ab, mean), 1 - _corr(a, ab, mean)
    if estimator == "azzini-rosati":
        u, x = ab - a, b - ba
        q = mean((a - b) * (a - b) + (ba - ab) * (ba - ab))
        return ratio(2 * mean(u * x), q), ratio(mean(u * u + x * x), q)
    raise ValueError(f"unknown estimator {estimator}")


ESTIMATORS = ("saltelli-jansen", "jansen", "mauntz-kucherenko", "janon-monod", "martinez", "azzini-rosati")


def sobol(rows: DataFrame, estimator: str = "saltelli-jansen", slices: Sequence[str] = (), extra: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """``(param, *slices, s1, st, variance)``; a constant output gives NaN. ``extra`` are further keys, such as a replicate, ``w`` how often a row counts."""
    s1, st = sobol_terms(estimator, w)
    v = _pooled(F.col("a"), F.col("b"), weighted(w))
    flat = (F.greatest(F.max("a"), F.max("b")) == F.least(F.min("a"), F.min("b"))) | (v == 0)
    return rows.groupBy("param", *slices, *extra).agg(undefined_if(flat, s1).alias("s1"), undefined_if(flat, st).alias("st"), v.alias("variance"))


def sobol_second(rows: DataFrame, estimator: str = "saltelli-jansen", slices: Sequence[str] = ()) -> DataFrame:
    """``(param, param_j, *slices, s2)`` for pairs in order, from BA of one and AB of the other, both ways round."""
    first = sobol(rows, estimator, slices).select("param", *slices, "s1")
    keys = ["base_id", *slices]
    x = rows.select(*keys, "param", "a", "b", "ab", "ba")
    y = rows.select(*keys, F.col("param").alias("param_j"), F.col("ab").alias("ab_j"), F.col("ba").alias("ba_j"))
    pairs = x.join(y, keys).where("param < param_j")
    v = _pooled(F.col("a"), F.col("b"))
    closed = ratio(F.avg((F.col("ba") * F.col("ab_j") + F.col("ba_j") * F.col("ab")) / 2) - F.avg(F.col("a") * F.col("b")), v)
    both = pairs.groupBy("param", "param_j", *slices).agg(closed.alias("v"))
    one = both.join(first.withColumnRenamed("s1", "_i"), ["param", *slices])
    two = one.join(first.select(F.col("param").alias("param_j"), *slices, F.col("s1").alias("_j")), ["param_j", *slices])
    return two.select("param", "param_j", *slices, (F.col("v") - F.col("_i") - F.col("_j")).alias("s2"))


def elementary_effects(outputs: DataFrame, steps: DataFrame) -> DataFrame:
    """``ee`` of each step ``(traj_id, param, before, after, delta)``: two joins by run."""
    y = lambda name: outputs.withColumnsRenamed({"run_id": name, "y": f"y_{name}"})
    shared = [c for c in outputs.columns if c not in ("run_id", "y")]
    rows = steps.join(y("before"), "before").join(y("after"), ["after", *shared])
    return rows.select("traj_id", "param", *shared, ((F.col("y_after") - F.col("y_before")) / F.col("delta")).alias("ee"))


def morris(effects: DataFrame, slices: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """``(param, *slices, mu, mu_star, sigma)``; sigma is the sample deviation."""
    return effects.groupBy("param", *slices, *extra).agg(F.avg("ee").alias("mu"), F.avg(F.abs("ee")).alias("mu_star"), F.stddev_samp("ee").alias("sigma"))


def physical_units(measures: DataFrame, widths: dict[str, float]) -> DataFrame:
    """Morris measures divided by the width of each uniform input."""
    width = F.element_at(F.create_map(*[F.lit(x) for kv in widths.items() for x in kv]), F.col("param"))
    return measures.withColumns({c: F.col(c) / width for c in ("mu", "mu_star", "sigma")})


def kucherenko(rows: DataFrame, slices: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """``(param, *slices, s1, st, variance)`` from ``joint``, ``kept`` (the input kept, others redrawn) and ``redrawn`` (only it redrawn).

    Sums are of outputs moved by the joint mean of each slice, so that large means do not cancel.
    """
    shift = rows.groupBy(*slices).agg(F.avg("joint").alias("_m"))
    moved = rows.join(F.broadcast(shift), list(slices)) if slices else rows.crossJoin(F.broadcast(shift))  # one row for each slice
    moved = moved.withColumns({c: F.col(c) - F.col("_m") for c in ("joint", "kept", "redrawn")})
    v = F.var_pop("joint")
    flat = (F.max("joint") == F.min("joint")) | (F.var_pop("joint") == 0)
    return moved.groupBy("param", *slices, *extra).agg(
        undefined_if(flat, ratio(F.covar_pop("joint", "kept"), v)).alias("s1"),
        undefined_if(flat, ratio(F.avg(F.pow(F.col("joint") - F.col("redrawn"), F.lit(2.0))) / 2, v)).alias("st"),
        v.alias("variance"),
    )


def kucherenko_subsets(pairs: DataFrame, d: int, slices: Sequence[str] = (), extra: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """``(mask, *slices, closed, total, variance)`` of every set that ``pairs (mask, joint, kept)`` has the block of, and of all inputs.

    A set's closed index is the covariance of the joint output and the one with the set kept, over the variance; its
    total index is half the mean squared difference with all but the set kept, which is another row's mask. The
    full set explains everything. Variances are of both outputs together.
    """
    keys, mean, full = [*slices, *extra], weighted(w), (1 << d) - 1
    x, y = F.col("joint"), F.col("kept")
    v = _pooled(x, y, mean)
    flat = (F.greatest(F.max(x), F.max(y)) == F.least(F.min(x), F.min(y))) | (v == 0)
    m = mean((x + y) / 2)
    per = pairs.groupBy("mask", *keys).agg(undefined_if(flat, ratio(mean(x * y) - m * m, v)).alias("closed"), undefined_if(flat, ratio(mean((x - y) * (x - y)) / 2, v)).alias("_t"), v.alias("variance"))
    other = per.select(F.col("mask").bitwiseXOR(F.lit(full)).alias("mask"), *keys, F.col("_t").alias("total"))
    out = per.select("mask", *keys, "closed", "variance").join(other, ["mask", *keys])
    whole = per.groupBy(*keys).agg(F.avg("variance").alias("variance"), F.max(F.isnan("closed")).alias("_f"))
    one = undefined_if(F.col("_f"), F.lit(1.0))
    return out.select("mask", *keys, "closed", "total", "variance").unionByName(whole.select(F.lit(full).alias("mask"), *keys, one.alias("closed"), one.alias("total"), "variance"))


def marginal_effects(total: dict[int, float], d: int) -> list[float]:
    """Proportional marginal effects from the total index of each set (a mask of bits): the proportional values of that game.

    A set's potential is its value by the sum of the reciprocal potentials of the sets with one input fewer; an
    input's effect is the potential of all by that of all others. Sets of value zero are taken out first: of the
    largest ones, each is added to all others, and effects are averaged by reciprocal potentials; an input in all of
    them has none.
    """
    full = (1 << d) - 1
    value = {0: 0.0, **total}
    if any(math.isnan(v) for v in value.values()):
        return [math.nan] * d

    def potentials(ground: int, base: int) -> dict[int, float]:
        out = {0: 1.0}
        inputs = [i for i in range(d) if ground >> i & 1]
        for size in range(1, len(inputs) + 1):
            for s in itertools.combinations(inputs, size):
                m = sum(1 << i for i in s)
                out[m] = value[base | m] / sum(1 / out[m ^ (1 << i)] for i in s)
        return out

    nulls = [m for m, v in value.items() if v <= 0]
    largest = [m for m in nulls if m.bit_count() == max(n.bit_count() for n in nulls)]
    if full in largest:
        return [math.nan] * d
    up, down = [0.0] * d, 0.0
    for base in largest:
        ground = full ^ base
        r = potentials(ground, base)
        down += 1 / r[ground]
        for i in range(d):
            if ground >> i & 1:
                up[i] += 1 / r[ground ^ (1 << i)]
    return [u / down for u in up]


def subset_effects(closed: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Exact Shapley effects ``(i, *keys, shapley)`` from ``(mask, *keys, cost)`` of every subset of ``size`` inputs: a self-join on masks that differ by one bit."""
    if size > 12:
        raise ValueError("subsets are enumerated for up to 12 inputs")
    bits = closed.select(F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i"), *keys, F.col("mask").alias("without"), F.col("cost").alias("low"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("i"))
    bits = bits.where(F.col("without").bitwiseAND(bit) == 0).withColumn("mask", F.col("without").bitwiseOR(bit))
    k = F.bit_count("without")
    weights = F.array(*[F.lit(math.factorial(s) * math.factorial(size - s - 1) / math.factorial(size)) for s in range(size)])
    met = bits.join(closed.select("mask", *keys, "cost"), ["mask", *keys])
    return met.groupBy("i", *keys).agg(F.sum(F.element_at(weights, k + 1) * (F.col("cost") - F.col("low"))).alias("shapley"))


def subset_marginal_effects(total: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Proportional marginal effects ``(i, *keys, pme)`` from ``(mask, *keys, cost)`` of every subset: a game of at most 4,096 sets in each task."""
    if size > 12:
        raise ValueError("subsets are enumerated for up to 12 inputs")
    kinds = dict(total.dtypes)

    def effects(f: pd.DataFrame) -> pd.DataFrame:
        found = marginal_effects({int(m): float(c) for m, c in zip(f["mask"], f["cost"]) if m}, size)
        return pd.DataFrame({"i": np.arange(size), **{k: f[k].iloc[0] for k in keys}, "pme": found})

    shape = ", ".join(["i int", *[f"`{k}` {kinds[k]}" for k in keys], "pme double"])
    one = total.select("mask", *keys, "cost")
    return (one.groupBy(*keys) if keys else one.groupBy(F.lit(0))).applyInPandas(effects, shape)


def efast(curves: DataFrame, omega: int, harmonics: int = 4, slices: Sequence[str] = ()) -> DataFrame:
    """``(param, *slices, s1, st)`` from the Fourier transforms of curves ``(param, t, n, y)``, whose work grows with their points.

    ``t`` runs from 0 to n - 1. The first index takes the first ``harmonics`` multiples of ``omega``, the
    total one what lies above ``omega // 2``. A constant curve gives NaN.
    """
    from .spectrum import fourier_sums

    out = fourier_sums(curves, omega, harmonics, ["param", *slices])
    return out.select("param", *slices, undefined_if(F.col("flat"), ratio(F.col("own"), F.col("v"))).alias("s1"), undefined_if(F.col("flat"), 1 - ratio(F.col("rest"), F.col("v"))).alias("st"))


def zero_curves(curves: DataFrame, slices: Sequence[str] = ()) -> DataFrame:
    """``(*slices, n_flat, n_curves)``: how many search curves have a constant output, and so no spectrum."""
    per = curves.groupBy("param", *slices).agg(((F.max("y") == F.min("y")) | (F.var_pop("y") == 0)).alias("flat"))
    return per.groupBy(*slices).agg(F.count_if("flat").alias("n_flat"), F.count("*").alias("n_curves"))


def dgsm(slopes: DataFrame, poincare: dict[str, float], variances: dict[str, float], slices: Sequence[str] = (), extra: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """``(param, *slices, nu, mu, upper_bound, lower_bound, variance)`` from ``(param, d, y)``, slope and output of each run.

    ``poincare`` holds each input's Poincare constant and ``variances`` its variance.
    """
    look = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("param"))
    mean = weighted(w)
    v = F.var_pop("y") if w is None else mean(F.col("y") * F.col("y")) - mean(F.col("y")) * mean(F.col("y"))
    s = slopes.groupBy("param", *slices, *extra).agg(mean(F.col("d") * F.col("d")).alias("nu"), mean(F.col("d")).alias("mu"), v.alias("variance"), ((F.max("y") == F.min("y")) | (v == 0)).alias("flat"))
    upper = undefined_if(F.col("flat"), ratio(look(poincare) * F.col("nu"), F.col("variance")))
    lower = undefined_if(F.col("flat"), ratio(look(variances) * F.col("mu") * F.col("mu"), F.col("variance")))
    return s.select("param", *slices, *extra, "nu", "mu", upper.alias("upper_bound"), lower.alias("lower_bound"), "variance")


def slopes(runs: DataFrame, problem: Problem, fn: Callable[..., Column], step: float = 1e-4, outputs: Sequence[str] = ("y",)) -> DataFrame:
    """``(*keys, param, output_idx, d, y)`` by central differences of a model given as an expression of its inputs.

    ``fn`` takes a Column for each input and returns one Column, or one for each of ``outputs``. An input's step is
    ``step`` of its standard deviation, and one-sided at a bound that both steps would leave.
    """
    names = problem.names
    keys = [c for c in runs.columns if c not in names]
    listed = lambda y: list(y) if isinstance(y, (list, tuple)) else [y]
    at = {c: F.col(c).cast("double") for c in names}
    here, rows = listed(fn(*at.values())), []
    variances = problem.variances()
    for c, m in problem.inputs.items():
        h = step * math.sqrt(variances[c])
        low, high = getattr(m, "low", None), getattr(m, "high", None)
        up, down = at[c] + h, at[c] - h
        up = F.least(up, F.greatest(at[c], F.lit(float(high)))) if high is not None else up
        down = F.greatest(down, F.least(at[c], F.lit(float(low)))) if low is not None else down
        for k, (hi, lo, y) in enumerate(zip(listed(fn(*(at | {c: up}).values())), listed(fn(*(at | {c: down}).values())), here)):
            rows.append(F.struct(F.lit(c).alias("param"), F.lit(k).alias("output_idx"), ((hi - lo) / (up - down)).alias("d"), y.cast("double").alias("y")))
    return runs.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


#: Points of a model that are evaluated at once.
EVALUATED = 1 << 16


def evaluated(runs: DataFrame, names: Sequence[str], fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(*keys, output_idx, y)`` of a model that takes a matrix of runs and returns a column for each output, or one array."""
    keys = [c for c in runs.columns if c not in names]
    kinds = dict(runs.dtypes)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), EVALUATED):
                part = f.iloc[lo : lo + EVALUATED]
                y = _outputs(fn, part[list(names)].to_numpy(float))
                one = part[keys].loc[part.index.repeat(y.shape[1])].reset_index(drop=True)
                yield one.assign(output_idx=np.tile(np.arange(y.shape[1]), len(part)), y=y.ravel())

    shape = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "output_idx int, y double"])
    return runs.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(kernel, shape)


def _outputs(fn: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    y = np.asarray(fn(x), float)
    y = y[:, None] if y.ndim == 1 else y
    if y.ndim != 2 or len(y) != len(x):
        raise ValueError(f"the model returned shape {y.shape} for {len(x)} runs")
    return y


def slopes_of(runs: DataFrame, problem: Problem, fn: Callable[[np.ndarray], np.ndarray], step: float = 1e-4, jac: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(*keys, param, output_idx, d, y)`` of a model that is a function of matrices: as ``slopes``, for any code.

    A batch of runs is widened by the two steps of each input, evaluated in pieces of ``EVALUATED`` points, and differenced, all
    in its task; ``jac``, where the model has one, returns slopes (runs x outputs x inputs) and saves the steps.
    """
    names, variances = problem.names, problem.variances()
    keys = [c for c in runs.columns if c not in names]
    kinds, d = dict(runs.dtypes), len(names)
    h = np.array([step * math.sqrt(variances[c]) for c in names])
    low = np.array([-math.inf if getattr(m, "low", None) is None else m.low for m in problem.inputs.values()], float)
    high = np.array([math.inf if getattr(m, "high", None) is None else m.high for m in problem.inputs.values()], float)

    def differences(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs, and slopes by run, output and input; a step that would leave the support ends at its bound, or at the run if that lies outside."""
        up = np.minimum(x + h, np.maximum(x, high))
        down = np.maximum(x - h, np.minimum(x, low))
        points = np.repeat(x[None], 2 * d + 1, 0)
        for j in range(d):
            points[2 * j + 1, :, j], points[2 * j + 2, :, j] = up[:, j], down[:, j]
        y = _outputs(fn, points.reshape(-1, d)).reshape(2 * d + 1, len(x), -1)
        return y[0], np.stack([(y[2 * j + 1] - y[2 * j + 2]) / (up[:, j] - down[:, j])[:, None] for j in range(d)], 2)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = max(1, EVALUATED // (2 * d + 1))
        for f in frames:
            for lo in range(0, len(f), size):
                part = f.iloc[lo : lo + size]
                x = part[names].to_numpy(float)
                y, slope = (_outputs(fn, x), np.asarray(jac(x), float)) if jac else differences(x)
                slope = slope[:, None] if slope.ndim == 2 else slope
                if slope.shape != (*y.shape, d):
                    raise ValueError(f"slopes have shape {slope.shape} for {y.shape} outputs of {d} inputs")
                wide = part[keys].loc[part.index.repeat(y.shape[1] * d)].reset_index(drop=True)
                n, k = y.shape
                yield wide.assign(param=np.tile(names, n * k), output_idx=np.tile(np.repeat(np.arange(k), d), n), d=slope.ravel(), y=np.repeat(y.ravel(), d))

    shape = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "param string, output_idx int, d double, y double"])
    return runs.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(kernel, shape)


def jacobian(runs: DataFrame, names: Sequence[str], y: str = "y", prefix: str = "d_") -> DataFrame:
    """``(param, d, y)`` from slopes that the model gave as columns ``d_<name>``, one row for each run and input."""
    rows = F.array(*[F.struct(F.lit(c).alias("param"), F.col(prefix + c).cast("double").alias("d")) for c in names])
    return runs.select(F.col(y).cast("double").alias("y"), F.explode(rows).alias("x")).select("x.param", "x.d", "y")


def uniform_poincare(low: float, high: float) -> float:
    """The Poincare constant of a uniform input."""
    return ((high - low) / math.pi) ** 2


@functools.cache
def normal_poincare(mean: float, variance: float, low: float | None, high: float | None, degree: int = 60) -> float:
    """The Poincare constant of a normal input, truncated or not.

    The largest quotient of a function's variance by its mean squared slope. Over polynomials on the support this is a small
    eigenvalue problem, whose integrals Gauss quadrature takes; an open side ends eight deviations out. Among
    polynomials that are orthogonal to constants, variance is the unit matrix.
    """
    if low is None and high is None:
        return variance
    s = math.sqrt(variance)
    ends = [(mean - 8 * s if low is None else low), (mean + 8 * s if high is None else high)]
    half, centre = (ends[1] - ends[0]) / 2, sum(ends) / 2
    t, weight = np.polynomial.legendre.leggauss(8 * degree)
    z = (centre + half * t - mean) / s
    density = weight * np.exp(-0.5 * (z * z - (z * z).min()))
    root = np.sqrt(density / density.sum())[:, None]
    values = np.polynomial.legendre.legvander(t, degree)
    slopes_ = np.stack([np.polynomial.legendre.legval(t, np.polynomial.legendre.legder(np.eye(degree + 1)[k])) for k in range(1, degree + 1)], 1) / half
    one = root / np.linalg.norm(root)
    centred = root * values[:, 1:] - one @ (one.T @ (root * values[:, 1:]))
    u, spread, v = np.linalg.svd(centred, full_matrices=False)  # a basis that the density can't tell apart from less is cut
    keep = spread > spread[0] * 1e-10
    turned = root * slopes_ @ (v[keep].T / spread[keep])
    return float(1 / np.linalg.svd(turned, compute_uv=False).min() ** 2)


def poincare_constants(problem: Problem) -> dict[str, float]:
    """Each input's Poincare constant; families without one are refused by the method."""
    out = {}
    for n, m in problem.inputs.items():
        if isinstance(m, Gaussian):
            out[n] = normal_poincare(m.mean, m.variance_, m.low, m.high)
        elif m.family == "uniform":
            out[n] = uniform_poincare(m.low, m.high)
        else:
            raise ValueError(f"no Poincare constant for the {m.family} input {n}")
    return out
