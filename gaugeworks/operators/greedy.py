"""Centres of kernel expansions, chosen greedily over all runs, and least squares in their Newton basis.

A problem is a kernel width and a fold that is held out, or none. Its next centre is the run, outside the fold, where the squared
distance to the span of the centres so far (the power function) is largest, of equals the one with the smallest values. As a
power only falls when centres are added, a task that passes on its best few runs and the largest power among the others
bounds all that it keeps: centres are taken from the runs passed on for as long as their powers are above every bound, and
then all runs are looked at again. So the centres are those that one task with all runs would choose. Tables that
one task can hold are worked on there, a task for each problem, in the same way: a pool of the best runs is kept up to date
with each centre, and the basis of all runs, where a task can hold it, when the pool's best is no longer above the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import surrogates as sg

#: Numbers of a table that one task holds, runs that all tasks pass on together in a round, and runs that a task takes at once.
HELD, POOL, TAKEN = 2_000_000, 8192, 4096
#: Numbers of a basis that one task holds, and runs of its pool.
STORED, POOLED = 64_000_000, 4096
#: Runs whose powers are found at once, and centres after which the residual is tested for the first time.
LOOKED, FIRST = 1024, 32
#: Where a power's root, or what is left of the output relative to its norm, ends the choice; the share of the mean diagonal that a solution adds.
POWER, RESIDUAL, JITTER = 5e-8, 1e-4, 1e-8


@dataclass
class Chosen:
    """A problem's centres so far, their outputs, and the factor that turns kernels at them into the Newton basis."""

    gamma: float
    fold: int | None
    points: np.ndarray
    y: np.ndarray
    factor: np.ndarray
    done: bool = False

    @classmethod
    def none(cls, gamma: float, fold: int | None, d: int) -> Chosen:
        return cls(gamma, fold, np.zeros((0, d)), np.zeros(0), np.zeros((0, 0)))

    def basis(self, u: np.ndarray) -> np.ndarray:
        """The Newton basis at rows of unit coordinates."""
        if not len(self.points):
            return np.zeros((len(u), 0))
        return forward(self.factor, sg.gaussian_kernel(self.points, u, self.gamma)).T

    def powers(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The power function at rows; nothing is left at a centre itself."""
        left = np.maximum(1 - (v * v).sum(1), 0)
        near = np.flatnonzero(left < 1e-6)
        if len(near) and len(self.points):
            known = {p.tobytes() for p in self.points}
            left[[i for i in near if np.ascontiguousarray(u[i]).tobytes() in known]] = 0.0
        return left

    def add(self, u: np.ndarray, y: float, v: np.ndarray, power: float) -> None:
        m = len(self.y)
        factor = np.zeros((m + 1, m + 1))
        factor[:m, :m], factor[m, :m], factor[m, m] = self.factor, v, math.sqrt(power)
        self.points, self.y, self.factor = np.vstack([self.points, u]), np.append(self.y, y), factor

    def cut(self, m: int) -> None:
        self.points, self.y, self.factor = self.points[:m], self.y[:m], self.factor[:m, :m]


def forward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a lower triangular system, by halves, so that most of it is products."""
    n = len(low)
    if n <= 32:
        return np.linalg.inv(low) @ b if b.size > 4 * low.size else np.linalg.solve(low, b)
    k = n // 2
    top = forward(low[:k, :k], b[:k])
    return np.concatenate([top, forward(low[k:, k:], b[k:] - low[k:, :k] @ top)])


def _points(rows: np.ndarray) -> np.ndarray:
    """Rows ``(u, y)`` in the order of their values, the first of those at one point."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, (rows[1:, :-1] != rows[:-1, :-1]).any(1))[: len(rows)]]


def _take(chosen: Chosen, points: np.ndarray, most: int, bound: float, always: bool) -> bool:
    """Adds centres from ``_points`` while the best power is above ``bound``, up to ``most``; whether the powers ended it.

    A power only falls, so that one found for fewer centres is a bound: only points whose bound is not below the best power are looked at.
    """
    u, y, power = np.ascontiguousarray(points[:, :-1]), points[:, -1], np.ones(len(points))
    while len(chosen.y) < most and len(u):
        known, best, some = np.zeros(len(u), bool), -1.0, LOOKED
        while not known[i := int(power.argmax())]:
            old = np.flatnonzero(~known & (power >= best))
            if len(old) > some:
                old = old[np.argpartition(-power[old], some)[:some]]
            for lo in range(0, len(old), LOOKED):
                at = old[lo : lo + LOOKED]
                power[at] = np.minimum(power[at], chosen.powers(u[at], chosen.basis(u[at])))
            known[old], best, some = True, max(best, float(power[old].max())), 2 * some
        if math.sqrt(power[i]) <= POWER or (not always and power[i] <= bound):
            return True
        chosen.add(u[i], float(y[i]), chosen.basis(u[i : i + 1])[0], float(power[i]))
        power[i], always = 0.0, False
    return not len(u)


class Held:
    """The Newton basis of all points that centres are taken from, with how many rows stand at each and the sum of their outputs."""

    def __init__(self, chosen: Chosen, rows: np.ndarray, most: int):
        rows = rows[np.lexsort(rows.T[::-1])]
        starts = np.flatnonzero(np.append(True, (rows[1:, :-1] != rows[:-1, :-1]).any(1))[: len(rows)])
        self.chosen, self.u, self.y = chosen, np.ascontiguousarray(rows[starts, :-1]), rows[starts, -1]
        self.sums, self.square = np.add.reduceat(rows[:, -1], starts) if len(rows) else self.y, float(rows[:, -1] @ rows[:, -1])
        self.root = None if len(starts) == len(rows) else np.sqrt(np.diff(np.append(starts, len(rows))))
        self.v, self.known, self.used = np.empty((max(most, len(chosen.y)), len(starts))), 0, np.zeros(len(starts))  # memory is taken as rows are written
        self.power, self.taken = np.ones(len(starts)), [int(i) for c in chosen.points for i in np.flatnonzero((self.u == c).all(1))]

    def refresh(self) -> None:
        """Takes the centres since the last time into the basis and the powers of all points."""
        c, a, m = self.chosen, self.known, len(self.chosen.y)
        for lo in range(0, len(self.u), TAKEN):
            at = slice(lo, lo + TAKEN)
            left = sg.gaussian_kernel(c.points[a:], self.u[at], c.gamma) - c.factor[a:, :a] @ self.v[:a, at]
            self.v[a:m, at] = new = forward(c.factor[a:, a:], left)
            self.used[at] += np.einsum("ij,ij->j", new, new)
        self.known, self.power = m, np.maximum(1 - self.used, 0)
        self.power[self.taken] = 0.0

    def take(self, most: int) -> bool:
        """Adds the next centres, up to ``most``; whether the powers ended it."""
        c = self.chosen
        while len(c.y) < most and len(self.u):
            self.refresh()
            pool, bound, m = np.arange(len(self.u)), -1.0, self.known
            if len(pool) > POOLED:
                order = np.argpartition(-self.power, POOLED)
                pool, bound = np.sort(order[:POOLED]), float(self.power[order[POOLED:]].max())
            if (first := int(self.power.argmax())) not in pool:  # one of many equals
                pool = np.sort(np.append(pool, first))
            u, power, used, v = self.u[pool], self.power[pool], self.used[pool], np.empty((most, len(pool)))
            v[:m] = self.v[:m, pool]
            i, new = int(np.searchsorted(pool, first)), True
            while len(c.y) < most:
                if math.sqrt(power[i]) <= POWER:
                    return True
                if not new and power[i] <= bound:
                    break
                m, row, root = len(c.y), v[: len(c.y), i].copy(), math.sqrt(power[i])
                v[m] = (sg.gaussian_kernel(u[i : i + 1], u, c.gamma)[0] - row @ v[:m]) / root
                c.add(u[i], float(self.y[pool[i]]), row, float(power[i]))
                self.taken.append(int(pool[i]))
                used += v[m] ** 2  # one less the sum, as ``refresh`` has it, so that equal powers are equal here too
                power = np.maximum(1 - used, 0)
                power[np.isin(pool, self.taken)] = 0.0
                i, new = int(power.argmax()), False
        return not len(self.u)

    def gram(self) -> np.ndarray:
        """``summed`` over the rows."""
        self.refresh()
        m = self.known
        out = np.zeros((m + 1, m + 1))
        for lo in range(0, len(self.u), TAKEN):
            part = self.v[:m, lo : lo + TAKEN]
            part = part if self.root is None else part * self.root[lo : lo + TAKEN]
            out[:m, :m] += part @ part.T
        out[m, :m] = out[:m, m] = self.v[:m] @ self.sums
        out[m, m] = self.square
        return out


def choose(chosen: Chosen, rows: np.ndarray, most: int, bound: float = -1.0, always: bool = False) -> np.ndarray | None:
    """Adds centres from ``rows (u, y)`` while the best power is above ``bound``; the first one even if it is equal to it, with ``always``.

    Without a bound, rows are all there are: the residual is tested as well, and sums of the basis with the output over them are returned.
    """
    if bound >= 0:
        _take(chosen, _points(rows), most, bound, always)
        return None
    held = Held(chosen, rows, most) if len(rows) * most <= STORED else None
    points = None if held else _points(rows)
    ended, gram = False, held.gram() if held else summed(chosen, rows)
    while not ended and len(chosen.y) < most and gram[-1, -1] > 0:
        upto = min(most, max(FIRST, 4 * len(chosen.y)))
        ended = held.take(upto) if held else _take(chosen, points, upto, bound, always)
        gram = held.gram() if held else summed(chosen, rows)
        left = residuals(chosen, gram)
        if len(few := np.flatnonzero(left <= RESIDUAL**2 * left[0])):
            m, ended = int(few[0]), True
            chosen.cut(m)
            gram = gram[np.ix_([*range(m), -1], [*range(m), -1])]
    chosen.done = True
    return gram


def summed(chosen: Chosen, rows: np.ndarray) -> np.ndarray:
    """Sums of the basis with the output over ``rows (u, y)``."""
    out = np.zeros((len(chosen.y) + 1,) * 2)
    for lo in range(0, len(rows), TAKEN):
        part = rows[lo : lo + TAKEN]
        out += _gram(chosen.basis(np.ascontiguousarray(part[:, :-1])), part[:, -1])
    return out


def residuals(chosen: Chosen, gram: np.ndarray) -> np.ndarray:
    """Squares of what interpolation at the first centres leaves of the output, for none of them to all."""
    if not len(chosen.y):
        return gram[-1:, -1]
    w = forward(chosen.factor, chosen.y[:, None])[:, 0]
    both = (gram[:-1, :-1] * w[:, None] * w).cumsum(0).cumsum(1).diagonal()
    return np.maximum(np.append(gram[-1, -1], gram[-1, -1] - 2 * np.cumsum(w * gram[:-1, -1]) + both), 0)


def coefficients(chosen: Chosen, gram: np.ndarray, ridge: float) -> np.ndarray:
    """Weights in the Newton basis, from sums of the basis with the output as last column."""
    g, b = gram[:-1, :-1], gram[:-1, -1]
    return np.linalg.solve(g + (ridge + JITTER * (np.trace(g) / max(1, len(g)) + ridge)) * np.eye(len(g)), b)


def weights(chosen: Chosen, beta: np.ndarray) -> np.ndarray:
    """Weights of the kernels at the centres."""
    return forward(chosen.factor[::-1, ::-1].T, beta[::-1])[::-1] if len(beta) else beta


def _gram(v: np.ndarray, y: np.ndarray) -> np.ndarray:
    b = np.column_stack([v, y])
    return b.T @ b


def errors(chosen: Chosen, train: np.ndarray, held: np.ndarray, ridges: Sequence[float]) -> list[float]:
    """Squared errors on held-out rows under each ridge, from sums over both."""
    out = []
    for r in ridges:
        beta = np.append(coefficients(chosen, train, r), -1.0)
        out.append(float(max(beta @ held @ beta, 0.0)))
    return out


@dataclass
class Fold:
    """A problem's centres with the sums of its basis over the rows that it may use and over those held out."""

    chosen: Chosen
    train: np.ndarray
    held: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))


def solved(units: DataFrame, names: Sequence[str], problems: Sequence[tuple[float, int | None]], most: int, n: int, held: int | None = None) -> list[Fold]:
    """Centres and sums of each problem ``(gamma, fold)`` over ``units (<names>, y, fold)``, of ``n`` rows."""
    limit = HELD if held is None else held
    if n * (len(names) + 2) <= limit:
        return _in_tasks(units, names, problems, most)
    return _in_rounds(units, names, problems, most)


def _in_tasks(units: DataFrame, names: Sequence[str], problems: Sequence[tuple[float, int | None]], most: int, ridges: Sequence[float] = ()) -> list[Fold | list[float]]:
    """A task for each problem; with ``ridges``, of a problem that holds a fold out only its ``errors`` come back."""
    spark, d = units.sparkSession, len(names)
    whole = spark.sparkContext.broadcast(units.select(*names, "y", "fold").toPandas().to_numpy(float))  # of bounded size, by the check above

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in f.id:
                k = len(problems) - 1 - int(i)  # wide kernels, which need fewer centres, come last
                gamma, fold = problems[k]
                rows = whole.value
                on = np.ones(len(rows), bool) if fold is None else rows[:, -1] != fold
                chosen = Chosen.none(gamma, fold, d)
                train = choose(chosen, rows[on][:, : d + 1], most)
                left = summed(chosen, rows[~on][:, : d + 1])
                scored = bool(ridges) and fold is not None
                parts = [np.array(errors(chosen, train, left, ridges))] if scored else [chosen.points, chosen.y, chosen.factor, train, left]
                yield pd.DataFrame({"k": [k], "m": [-1 if scored else len(chosen.y)], "blob": [b"".join(np.ascontiguousarray(p, float).tobytes() for p in parts)]})

    rows = spark.range(0, len(problems), 1, len(problems)).mapInPandas(solve, "k bigint, m int, blob binary").collect()
    out: dict[int, Fold | list[float]] = {}
    for r in rows:
        m, flat = r.m, np.frombuffer(r.blob)
        if m < 0:
            out[r.k] = flat.tolist()
            continue
        ends = np.cumsum([m * d, m, m * m, (m + 1) ** 2, (m + 1) ** 2])
        p, y, factor, train, left = np.split(flat, ends[:-1])
        out[r.k] = Fold(Chosen(*problems[r.k], p.reshape(m, d), y, factor.reshape(m, m), True), train.reshape(m + 1, -1), left.reshape(m + 1, -1))
    return [out[k] for k in range(len(problems))]


def _in_rounds(units: DataFrame, names: Sequence[str], problems: Sequence[tuple[float, int | None]], most: int) -> list[Fold]:
    d, rows = len(names), units.select(*names, "y", "fold")
    states = [Chosen.none(g, f, d) for g, f in problems]
    each = max(4, POOL // max(1, rows.rdd.getNumPartitions()))
    while any(not s.done for s in states):
        for k, (points, y, factor, done) in _round(rows, d, states, most, each):
            s = states[k]
            s.points, s.y, s.factor, s.done = points, y, factor, done
    return [Fold(s, *sums) for s, sums in zip(states, _sums(rows, d, states))]


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for f in frames:
        a = f.to_numpy(float)
        for lo in range(0, len(a), TAKEN):
            yield a[lo : lo + TAKEN]


def _round(rows: DataFrame, d: int, states: Sequence[Chosen], most: int, each: int) -> Iterator[tuple[int, tuple]]:
    """Looks at all rows once, and takes as many next centres of each problem that is open as the bounds allow."""
    active = {k: s for k, s in enumerate(states) if not s.done}

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops = {k: np.zeros((0, d + 2)) for k in active}
        bounds, squares = dict.fromkeys(active, -1.0), {k: np.zeros(len(s.y) + 1) for k, s in active.items()}
        for a in _batches(frames):
            for k, s in active.items():
                part = a if s.fold is None else a[a[:, -1] != s.fold]
                u, y = np.ascontiguousarray(part[:, :d]), part[:, d]
                v = s.basis(u)
                newton = forward(s.factor, s.y[:, None])[:, 0] if len(s.y) else np.zeros(0)
                left = np.column_stack([y, y[:, None] - np.cumsum(v * newton, 1)])
                squares[k] += (left * left).sum(0)
                some = np.concatenate([tops[k], np.column_stack([s.powers(u, v), part[:, : d + 1]])])
                order = np.lexsort([*some[:, 1:].T[::-1], -some[:, 0]])
                tops[k], rest = some[order[:each]], some[order[each:]]
                bounds[k] = max(bounds[k], rest[:, 0].max(initial=-1.0))
        for k in active:
            yield pd.DataFrame({"k": [k], "bound": [bounds[k]], "top": [tops[k].tobytes()], "squares": [squares[k].tobytes()]})

    def extend(f: pd.DataFrame) -> pd.DataFrame:
        k = int(f.k.iloc[0])
        s = active[k]
        squares = np.sum([np.frombuffer(b) for b in f.squares], 0)
        if len(ended := np.flatnonzero(squares <= RESIDUAL**2 * squares[0])):
            s.cut(int(ended[0]))
            s.done = True
        else:
            pool = np.concatenate([np.frombuffer(b).reshape(-1, d + 2) for b in f.top])
            before = len(s.y)
            choose(s, pool[:, 1:], most, max(float(f.bound.max()), 0.0), True)
            s.done = len(s.y) == before  # else the next round tests what the new ones leave
        blob = b"".join(np.ascontiguousarray(p, float).tobytes() for p in (s.points, s.y, s.factor))
        return pd.DataFrame({"k": [k], "m": [len(s.y)], "done": [s.done], "blob": [blob]})

    found = rows.mapInPandas(best, "k int, bound double, top binary, squares binary").groupBy("k").applyInPandas(extend, "k int, m int, done boolean, blob binary")
    for r in found.collect():  # a row for each problem
        p, y, factor = np.split(np.frombuffer(r.blob), [r.m * d, r.m * d + r.m])
        yield r.k, (p.reshape(r.m, d), y, factor.reshape(r.m, r.m), r.done)


def _sums(rows: DataFrame, d: int, states: Sequence[Chosen]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sums of each problem's basis with the output over its rows, and over those held out."""

    def start(a: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for k, s in enumerate(states):
            for held, part in enumerate((a, a[:0]) if s.fold is None else (a[a[:, -1] != s.fold], a[a[:, -1] == s.fold])):
                if len(part):
                    out[2 * k + held] = _gram(s.basis(np.ascontiguousarray(part[:, :d])), part[:, d])
        return out

    got = sg.reduced_by(rows, rows.columns, start, lambda s: s.sum(0))
    zero = lambda s: np.zeros((len(s.y) + 1,) * 2)
    return [(got.get(2 * k, zero(s)), got.get(2 * k + 1, zero(s))) for k, s in enumerate(states)]


def searched(units: DataFrame, names: Sequence[str], gammas: Sequence[float], ridges: Sequence[float], most: int, folds: int, n: int, held: int | None = None) -> tuple[Fold, float, float, float]:
    """The fit of the best gamma and ridge, these two, and their squared error over all held-out rows.

    Each fold chooses its own centres without its rows. Nothing is searched where there is one of each.
    """
    if len(gammas) * len(ridges) == 1:
        return solved(units, names, [(gammas[0], None)], most, n, held)[0], gammas[0], ridges[0], math.nan
    problems = [(g, f) for g in gammas for f in range(folds)]
    fits: dict[float, Fold] = {}
    if n * (len(names) + 2) <= (HELD if held is None else held):  # fits of all rows go along, a task for each gamma
        every = [(g, f) for g in gammas for f in (None, *range(folds))]
        found = dict(zip(every, _in_tasks(units, names, every, most, ridges)))
        fits, scores = {g: found[g, None] for g in gammas}, [found[p] for p in problems]
    else:
        scores = [errors(f.chosen, f.train, f.held, ridges) for f in _in_rounds(units, names, problems, most)]
    best = (math.inf, gammas[0], ridges[0])
    for g in gammas:
        total = np.sum([s for (og, _), s in zip(problems, scores) if og == g], 0)
        i = int(np.argmin(total))
        if total[i] < best[0]:
            best = (float(total[i]), g, ridges[i])
    sse, gamma, ridge = best
    return fits.get(gamma) or _in_rounds(units, names, [(gamma, None)], most)[0], gamma, ridge, sse
