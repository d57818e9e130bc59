"""The declared problem: named inputs with marginal distributions and, where they depend, a correlation."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.special import NUMPY, SPARK, betainc, betaincinv, normal_cdf, normal_ppf

#: Unit coordinates are kept this far from 0 and 1 for distributions that may be unbounded.
EDGE = 1e-12


class Marginal:
    """One input's distribution. ``ppf`` maps unit coordinates to values, ``cdf`` values to unit coordinates; both take Columns or arrays."""

    family = ""

    def ppf(self, u, ops=SPARK):
        raise NotImplementedError

    def cdf(self, x, ops=SPARK):
        raise NotImplementedError

    def _need(self, ok: bool, message: str) -> None:
        if not ok:
            raise ValueError(f"{self.family}: {message}")


@dataclass(frozen=True)
class Uniform(Marginal):
    low: float = 0.0
    high: float = 1.0
    family = "uniform"

    def __post_init__(self):
        self._need(math.isfinite(self.low) and math.isfinite(self.high) and self.low < self.high, "low must be below high")

    def ppf(self, u, ops=SPARK):
        return self.low + (self.high - self.low) * u

    def cdf(self, x, ops=SPARK):
        return (x - self.low) / (self.high - self.low)

    def variance(self) -> float:
        return (self.high - self.low) ** 2 / 12


@dataclass(frozen=True)
class Gaussian(Marginal):
    mean: float = 0.0
    variance_: float = 1.0
    low: float | None = None
    high: float | None = None
    family = "gaussian"

    def __post_init__(self):
        self._need(self.variance_ > 0, "variance must be positive")
        self._need(self.low is None or self.high is None or self.low < self.high, "low must be below high")

    @property
    def _bounds(self) -> tuple[float, float]:
        z = lambda v: float(normal_cdf(np.float64((v - self.mean) / math.sqrt(self.variance_)), NUMPY))
        return (0.0 if self.low is None else z(self.low)), (1.0 if self.high is None else z(self.high))

    def ppf(self, u, ops=SPARK):
        a, b = self._bounds
        x = self.mean + math.sqrt(self.variance_) * normal_ppf(a + (b - a) * ops.clip(u, EDGE, 1 - EDGE), ops)
        if self.low is not None or self.high is not None:
            x = ops.clip(x, -math.inf if self.low is None else self.low, math.inf if self.high is None else self.high)
        return x

    def cdf(self, x, ops=SPARK):
        a, b = self._bounds
        return (normal_cdf((x - self.mean) / math.sqrt(self.variance_), ops) - a) / (b - a)

    def truncated(self, q: float) -> Gaussian:
        """With open sides closed at their own ``q`` and ``1 - q`` quantiles."""
        z = float(normal_ppf(np.float64(q), NUMPY)) * math.sqrt(self.variance_)
        return Gaussian(self.mean, self.variance_, self.mean + z if self.low is None else self.low, self.mean - z if self.high is None else self.high)

    def variance(self) -> float:
        if self.low is None and self.high is None:
            return self.variance_
        u = (np.arange(20_000) + 0.5) / 20_000
        return float(np.var(self.ppf(u, NUMPY)))


@dataclass(frozen=True)
class Lognormal(Marginal):
    mu: float
    sigma: float
    family = "lognormal"

    def __post_init__(self):
        self._need(self.sigma > 0, "sigma must be positive")

    def ppf(self, u, ops=SPARK):
        return ops.exp(self.mu + self.sigma * normal_ppf(ops.clip(u, EDGE, 1 - EDGE), ops))

    def cdf(self, x, ops=SPARK):
        return ops.where(x > 0, normal_cdf((ops.log(ops.clip(x, 1e-300, math.inf)) - self.mu) / self.sigma, ops), x * 0.0)


@dataclass(frozen=True)
class Weibull(Marginal):
    shape: float
    scale: float
    family = "weibull"

    def __post_init__(self):
        self._need(self.shape > 0 and self.scale > 0, "shape and scale must be positive")

    def ppf(self, u, ops=SPARK):
        return self.scale * ops.pow(-ops.log1p(-ops.clip(u, EDGE, 1 - EDGE)), 1 / self.shape)

    def cdf(self, x, ops=SPARK):
        return -ops.expm1(-ops.pow(ops.clip(x, 0.0, math.inf) / self.scale, self.shape))


@dataclass(frozen=True)
class Triangular(Marginal):
    low: float
    mode: float
    high: float
    family = "triangular"

    def __post_init__(self):
        self._need(self.low <= self.mode <= self.high and self.low < self.high, "low, mode and high must be in order")

    def ppf(self, u, ops=SPARK):
        u, w = ops.clip(u, EDGE, 1 - EDGE), self.high - self.low
        c = (self.mode - self.low) / w
        return ops.where(u < c, self.low + w * ops.sqrt(u * c), self.high - w * ops.sqrt((1 - u) * (1 - c)))

    def cdf(self, x, ops=SPARK):
        w = self.high - self.low
        c, t = (self.mode - self.low) / w, (x - self.low) / w
        rise, fall = t * t / (c or 1.0), 1 - (1 - t) * (1 - t) / ((1 - c) or 1.0)
        return ops.where((t < 0) | (t > 1), t, ops.where(t < c, rise, fall))


@dataclass(frozen=True)
class Beta(Marginal):
    a: float
    b: float
    low: float = 0.0
    high: float = 1.0
    family = "beta"

    def __post_init__(self):
        self._need(self.a > 0 and self.b > 0 and self.low < self.high, "a and b must be positive and low below high")

    def ppf(self, u, ops=SPARK):
        a, b, low, high = self.a, self.b, self.low, self.high
        if ops is NUMPY:
            return low + (high - low) * betaincinv(a, b, np.clip(u, EDGE, 1 - EDGE))
        return F.pandas_udf(lambda s: pd.Series(low + (high - low) * betaincinv(a, b, np.clip(s.to_numpy(float), EDGE, 1 - EDGE))), "double")(u)

    def cdf(self, x, ops=SPARK):
        a, b, low, high = self.a, self.b, self.low, self.high

        def inside(v):
            t = (np.asarray(v, float) - low) / (high - low)
            return np.where((t < 0) | (t > 1), t, betainc(a, b, np.clip(t, 0, 1)))

        return inside(x) if ops is NUMPY else F.pandas_udf(lambda s: pd.Series(inside(s)), "double")(x)


@dataclass(frozen=True)
class Categorical(Marginal):
    probs: tuple[float, ...]
    labels: tuple[str, ...] = ()
    family = "categorical"

    def __post_init__(self):
        self._need(len(self.probs) > 0 and min(self.probs) >= 0 and abs(sum(self.probs) - 1) <= 1e-3, "probabilities must sum to 1")
        self._need(not self.labels or len(self.labels) == len(self.probs), "one label for each level")

    def ppf(self, u, ops=SPARK):
        """Level codes 0, 1, ... as doubles."""
        edges = np.cumsum(self.probs) / sum(self.probs)
        code = u * 0.0
        for e in edges[:-1]:
            code = code + ops.where(u >= float(e), 1.0, 0.0)
        return code


@dataclass(frozen=True)
class Problem:
    """Inputs in order, names of outputs, and a latent Gaussian correlation or a custom sampler, never both."""

    inputs: dict[str, Marginal]
    outputs: tuple[str, ...] = ()
    correlation: np.ndarray | None = field(default=None, compare=False)
    sampler: Callable | None = None

    def __post_init__(self):
        if not self.inputs or len(set(self.inputs)) != len(self.inputs):
            raise ValueError("a problem needs inputs with distinct names")
        if self.correlation is not None and self.sampler is not None:
            raise ValueError("give a correlation or a sampler, not both")
        if self.correlation is not None:
            r = repaired(np.asarray(self.correlation, float))
            for i, m in enumerate(self.inputs.values()):
                if isinstance(m, Categorical) and np.abs(np.delete(r[i], i)).max(initial=0) > 0:
                    raise ValueError("a categorical input can't be correlated")
            object.__setattr__(self, "correlation", r)

    @property
    def names(self) -> list[str]:
        return list(self.inputs)

    @property
    def dependent(self) -> bool:
        return self.sampler is not None or (self.correlation is not None and not np.allclose(self.correlation, np.eye(len(self.inputs))))

    def to_params(self, spark: SparkSession) -> DataFrame:
        """``(param_id, name, dist)`` as a small table."""
        return spark.createDataFrame([(i, n, m.family) for i, (n, m) in enumerate(self.inputs.items())], "param_id int, name string, dist string")

    def transform(self, units: DataFrame, prefix: str = "u_") -> DataFrame:
        """Unit-cube columns ``u_<name>`` mapped to columns of values; other columns stay."""
        made = [m.ppf(F.col(prefix + n)).alias(n) for n, m in self.inputs.items()]
        return units.select(*[c for c in units.columns if c not in {prefix + n for n in self.inputs}], *made)

    def truncated(self, q: float) -> Problem:
        """With the open sides of Gaussian inputs closed at their own ``q`` and ``1 - q`` quantiles."""
        inputs = {n: m.truncated(q) if isinstance(m, Gaussian) else m for n, m in self.inputs.items()}
        return Problem(inputs, self.outputs, self.correlation, self.sampler)

    def units(self, runs: DataFrame) -> DataFrame:
        """``runs`` with inputs replaced by their places on their distributions; what lies outside the support lies outside [0, 1]."""
        return runs.withColumns({n: m.cdf(F.col(n)) for n, m in self.inputs.items()})

    def variances(self) -> dict[str, float]:
        """Each input's variance; by 4,000 quantiles where no formula is at hand."""
        u = (np.arange(4000) + 0.5) / 4000
        return {n: m.variance() if hasattr(m, "variance") else float(np.var(m.ppf(u, NUMPY))) for n, m in self.inputs.items()}

    def to_json(self) -> str:
        """Inputs with their parameters, names of outputs and correlation, as JSON."""
        inputs = {n: {"family": m.family, **{k: list(v) if isinstance(v, tuple) else v for k, v in vars(m).items()}} for n, m in self.inputs.items()}
        return json.dumps({"inputs": inputs, "outputs": list(self.outputs), "correlation": None if self.correlation is None else np.asarray(self.correlation).tolist()})

    @classmethod
    def from_json(cls, text: str) -> Problem:
        """A problem from ``to_json``; a custom sampler isn't part of it."""
        spec, kinds = json.loads(text), {k.family: k for k in (Uniform, Gaussian, Lognormal, Weibull, Triangular, Beta, Categorical)}
        tuples = lambda v: tuple(v) if isinstance(v, list) else v
        inputs = {n: kinds[m["family"]](**{k: tuples(v) for k, v in m.items() if k != "family"}) for n, m in spec["inputs"].items()}
        return cls(inputs, tuple(spec["outputs"]), None if spec["correlation"] is None else np.array(spec["correlation"]))

    def to_unit(self, name: str, x: Column) -> Column:
        """A value's place on its input's distribution; outside the support it lies outside [0, 1]."""
        return self.inputs[name].cdf(x)


@dataclass(frozen=True)
class Method:
    """What a method takes: dependent and categorical inputs, refused families, its unit of failed runs, and how many must stay."""

    correlated: bool
    categorical: bool
    refused: tuple[str, ...] = ()
    unit: str = "row"
    min_kept: int = 1


#: The fourteen methods.
METHODS = {
    "sobol": Method(False, True, unit="group"),
    "efast": Method(False, False, ("lognormal", "weibull"), unit="curve"),
    "morris": Method(False, False, unit="trajectory"),
    "kucherenko": Method(True, False, unit="point"),
    "borgonovo": Method(True, True, min_kept=4),
    "dgsm": Method(False, False, ("lognormal", "weibull", "triangular", "beta")),
    "hdmr": Method(True, False, ("lognormal", "weibull")),
    "hsic": Method(True, False),
    "optimal_transport": Method(True, True, min_kept=4),
    "pawn": Method(True, True, min_kept=4),
    "pce": Method(False, False),
    "rank": Method(True, False, min_kept=3),
    "shapley": Method(False, False),
    "vkoga": Method(True, False, min_kept=10),
}


def gate(problem: Problem, method: str, correlated: bool | None = None, categorical: bool | None = None, refused: Sequence[str] | None = None) -> None:
    """Raises where a method can't take the problem's dependence or families; without limits of its own, by ``METHODS``."""
    known = METHODS.get(method, Method(True, True))
    correlated = known.correlated if correlated is None else correlated
    categorical = known.categorical if categorical is None else categorical
    refused = known.refused if refused is None else refused
    if problem.dependent and not correlated:
        raise ValueError(f"{method} needs independent inputs")
    for n, m in problem.inputs.items():
        if isinstance(m, Categorical) and not categorical and not (method == "kucherenko" and problem.sampler):
            raise ValueError(f"{method} can't take the categorical input {n}")
        if m.family in refused:
            raise ValueError(f"{method} can't take the {m.family} input {n}")


def policy_for(method: str, policy: str) -> str:
    """The policy for failed runs, checked: a curve of eFAST can't lose a run, so nothing can be dropped there."""
    if policy not in ("raise", "propagate", "drop", "skip"):
        raise ValueError(f"unknown policy {policy}")
    if policy == "drop" and METHODS[method].unit == "curve":
        raise ValueError(f"{method} can't drop runs: the Fourier sums need whole curves; use skip or propagate")
    return policy


def spearman_to_latent(rho: np.ndarray) -> np.ndarray:
    """The normal correlation behind rank correlations."""
    out = 2 * np.sin(np.pi * np.asarray(rho, float) / 6)
    np.fill_diagonal(out, 1.0)
    return out


def repaired(r: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """The nearest usable correlation matrix by clipping eigenvalues; a change of 0.05 or more raises."""
    if r.ndim != 2 or r.shape[0] != r.shape[1] or not np.allclose(r, r.T) or not np.allclose(np.diag(r), 1):
        raise ValueError("a correlation matrix is square and symmetric with a unit diagonal")
    values, vectors = np.linalg.eigh(r)
    if values.min() >= least:
        return r
    fixed = (vectors * np.maximum(values, least)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    fixed = fixed / np.outer(scale, scale)
    if np.abs(fixed - r).max() >= 0.05:
        raise ValueError("the correlation matrix is far from positive definite")
    return fixed
