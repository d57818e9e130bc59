"""Fits of many outputs, and of all replicates, in one pass over the runs.

Outputs of a run stand in blocks, as arrays, so that a row has a bounded size. A task evaluates the basis once for a batch of
rows and reduces it for every replicate and block to one matrix: the factor of the basis with the block's outputs
turned by it, or a Gram matrix with the block's products. These are merged in a tree by replicate and block and
solved where they end up, so that coefficients are a table from the start and neither the number of outputs nor that of
replicates changes the number of jobs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..problem import Problem, gate
from . import surrogates as sg
from .frames import ranked

#: Outputs of a block, and bytes of matrices that a task keeps before it passes them on.
BLOCK, KEPT = 256, 256 << 20
#: Bytes of coefficients that travel to the tasks at once.
SENT = 32 << 20


def stacked(outputs: DataFrame, slices: Sequence[str], key: str = "run_id") -> tuple[DataFrame, DataFrame, int]:
    """Long outputs ``(run_id, *slices, y)`` as ``(run_id, block, ys)``, ``(*slices, _no)``, and their number; slices are numbered in order.

    Output ``i`` is element ``i % BLOCK`` of block ``i div BLOCK``. A run that lacks an output has null there.
    """
    if not slices:
        one = outputs.select(F.col(key).alias("run_id"), F.lit(0).alias("block"), F.array(F.col("y").cast("double")).alias("ys"))
        return one, outputs.sparkSession.createDataFrame([(0,)], "_no int"), 1
    distinct = outputs.select(*slices).distinct()
    numbers = cut(ranked(distinct.withColumn("_all", F.lit(0)), ["_all"], list(slices), "_no", "_n").select(*slices, F.col("_no").cast("int").alias("_no")))
    n = numbers.count()
    same = None
    for c in slices:
        eq = outputs[c].eqNullSafe(numbers[c])
        same = eq if same is None else same & eq
    rows = outputs.join(numbers, same).select(outputs[key].alias("run_id"), F.expr(f"_no div {BLOCK}").cast("int").alias("block"), (F.col("_no") % BLOCK).alias("_p"), F.col("y").cast("double").alias("y"))
    width = F.least(F.lit(BLOCK), F.lit(n) - F.col("block") * BLOCK)
    by_place = F.map_from_entries(F.collect_list(F.struct("_p", "y"))).alias("m")
    blocks = rows.groupBy("run_id", "block").agg(by_place)
    return blocks.select("run_id", "block", F.transform(F.sequence(F.lit(0), width.cast("int") - 1), lambda i: F.try_element_at("m", i)).alias("ys")), numbers, n


def in_blocks(runs: DataFrame, ys: str, n: int) -> DataFrame:
    """Rows with an array of ``n`` outputs as a row for each block, ``block`` and ``ys``."""
    parts = F.array(*[F.struct(F.lit(b).alias("block"), F.slice(F.col(ys), b * BLOCK + 1, min(BLOCK, n - b * BLOCK)).cast("array<double>").alias("ys")) for b in range(-(-n // BLOCK))])
    rest = [c for c in runs.columns if c != ys]
    return runs.select(*rest, F.explode(parts).alias("_b")).select(*rest, "_b.block", "_b.ys")


def with_weights(rows: DataFrame, weights: DataFrame | None, replicates: int) -> DataFrame:
    """``rows`` with ``ws``: one, as the rows themselves are replicate 0, and how often each further one draws the run by ``weights (rep, unit, w)``."""
    if weights is None:
        return rows
    by_rep = weights.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("rep", "w"))).alias("_m"))
    ws = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)).cast("double"))
    return rows.join(by_rep, rows["run_id"] == by_rep["unit"], "left").withColumn("ws", F.concat(F.array(F.lit(1.0)), ws)).drop("unit", "_m")


def _reduced(rows: DataFrame, names: Sequence[str], start: Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray], design: Callable[[np.ndarray], np.ndarray], merge: Callable[[np.ndarray], np.ndarray], blocks: int) -> DataFrame:
    """One row of matrices for each key ``rep * blocks + block``; without ``ws``, of one replicate that counts each run once."""
    weighted = "ws" in rows.columns

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        size = 0
        for f in frames:
            for block, part in f.groupby("block") if len(f) else ():
                phi, y = design(part[list(names)].to_numpy(float)), np.array(part.ys.tolist(), float)
                ws = np.array(part.ws.tolist(), float) if weighted else np.ones((len(part), 1))
                for rep in range(ws.shape[1]):
                    on = ws[:, rep] > 0
                    m = start(phi[on], y[on], ws[on, rep]) if weighted else start(phi, y, None)
                    k = rep * blocks + int(block)
                    if k in kept:
                        m = merge(np.stack([kept[k], m]))
                    else:
                        size += m.nbytes
                    kept[k] = m
                    if size > KEPT:
                        yield from sg.partial_rows(kept)
                        kept, size = {}, 0
        yield from sg.partial_rows(kept)

    parts = rows.select(*names, "block", "ys", *(["ws"] if weighted else [])).mapInPandas(partial, sg.SHAPE)
    return sg.together(parts, merge, rows.rdd.getNumPartitions())


@dataclass
class Fits:
    """Fits of many outputs: ``coefficients (rep, output_idx, term, coefficient)`` and ``quality (rep, output_idx, ...)``; ``terms`` are exponents."""

    problem: Problem
    terms: list[tuple[int, ...]]
    order: int
    outputs: int
    coefficients: DataFrame
    quality: DataFrame

    def variances(self) -> DataFrame:
        """``(rep, output_idx, mask, v)``: the variance of each set of inputs, a bit for each."""
        masks = [(i, sum(1 << j for j, e in enumerate(t) if e)) for i, t in enumerate(self.terms)]
        sets = self.coefficients.sparkSession.createDataFrame(masks, "term int, mask bigint")
        met = self.coefficients.join(F.broadcast(sets), "term").where("mask > 0")  # a row for each term of the basis
        return met.groupBy("rep", "output_idx", "mask").agg(F.sum(F.col("coefficient") * F.col("coefficient")).alias("v"))

    def indices(self) -> DataFrame:
        """``(rep, output_idx, param, s1, st, shapley, variance)``; a variance of zero gives NaN."""
        out = shares(self.variances(), self.problem.names, ["rep", "output_idx"])
        return out.join(self.quality.select("rep", "output_idx", "variance"), ["rep", "output_idx"])

    def second_order(self) -> DataFrame:
        """``(rep, output_idx, param, param_j, s2)``."""
        v, names = self.variances(), self.problem.names
        pairs = F.array(*[F.struct(F.lit(a).alias("param"), F.lit(b).alias("param_j"), F.sum(F.when(F.col("mask") == (1 << i | 1 << j), F.col("v")).otherwise(0.0)).alias("x")) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2)])
        per = v.groupBy("rep", "output_idx").agg(F.sum("v").alias("t"), pairs.alias("p")).select("rep", "output_idx", "t", F.explode("p").alias("p"))
        return per.select("rep", "output_idx", "p.param", "p.param_j", F.coalesce(F.try_divide("p.x", "t"), F.lit(float("nan"))).alias("s2"))

    def predict(self, runs: DataFrame, key: str = "run_id") -> DataFrame:
        """``(run_id, output_idx, prediction)`` of replicate 0; as many outputs at once as ``SENT`` bytes of coefficients allow."""
        names, p, out = self.problem.names, len(self.terms), None
        design, width = sg.Expansion(self.problem, self.terms, np.zeros(0), self.order).design, max(1, SENT // (8 * p))
        for lo in range(0, self.outputs, width):
            few = self.coefficients.where((F.col("rep") == 0) & F.col("output_idx").between(lo, min(lo + width, self.outputs) - 1)).orderBy("output_idx", "term").toPandas()
            idx, c = few.output_idx.to_numpy()[::p], few.coefficient.to_numpy().reshape(-1, p).T

            def kernel(frames, idx=idx, c=c):
                for f in frames:
                    if len(f):
                        value = design(f[names].to_numpy(float)) @ c
                        yield pd.DataFrame({"run_id": np.repeat(f.run_id.to_numpy(), len(idx)), "output_idx": np.tile(idx, len(f)), "prediction": value.ravel()})

            one = runs.select(F.col(key).alias("run_id"), *names).mapInPandas(kernel, f"run_id {dict(runs.dtypes)[key]}, output_idx int, prediction double")
            out = one if out is None else out.unionByName(one)
        return out


def shares(v: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``(*keys, param, s1, st, shapley)`` from ``(*keys, mask, v)``."""
    has = lambda j: F.col("mask").bitwiseAND(F.lit(1 << j)) > 0
    add = lambda on, x: F.sum(F.when(on, x).otherwise(0.0))
    each = [F.struct(F.lit(n).alias("param"), add(F.col("mask") == 1 << j, F.col("v")).alias("a"), add(has(j), F.col("v")).alias("b"), add(has(j), F.col("v") / F.bit_count("mask")).alias("c")) for j, n in enumerate(names)]
    per = v.groupBy(*keys).agg(F.sum("v").alias("t"), F.array(*each).alias("p")).select(*keys, "t", F.explode("p").alias("p"))
    over = lambda c: F.when(F.col("t") > 0, F.col(f"p.{c}") / F.col("t")).otherwise(F.lit(float("nan")))
    return per.select(*keys, "p.param", over("a").alias("s1"), over("b").alias("st"), over("c").alias("shapley"))


def _merged_factors(p: int) -> Callable[[np.ndarray], np.ndarray]:
    """Merges stacks of ``[R | Z]`` with two more rows: runs and squares outside the span, and sums of outputs."""

    def merge(stack: np.ndarray) -> np.ndarray:
        rows, more = stack[:, :p].reshape(-1, stack.shape[2]), stack[:, p:].sum(0)
        q, r = np.linalg.qr(rows[:, :p])
        z = q.T @ rows[:, p:]
        more[0, p:] += np.maximum((rows[:, p:] ** 2).sum(0) - (z**2).sum(0), 0)
        return np.concatenate([np.concatenate([r, z], 1), more])

    return merge


def pce(rows: DataFrame, problem: Problem, n_outputs: int, order: int = 3, ridge: float | None = None, fit_ratio: float = 0.5, size: int | None = None) -> Fits:
    """Polynomial chaos of every output and replicate of ``rows (<names>, block, ys, ws)``; ``ws`` may be missing.

    The same least squares as ``surrogates.pce``: tall triangular factors, with the outputs turned into their span, so that a block of
    outputs costs a product instead of a fit. ``size`` is the number of runs where it is known.
    """
    gate(problem, "pce")
    blocks = -(-n_outputs // BLOCK)
    n = size or rows.where("block = 0").count()
    order = sg.effective_order(len(problem.names), n, order, fit_ratio)
    fit = sg.Expansion(problem, sg.total_degree(len(problem.names), order), np.zeros(0), order)
    p, design = len(fit.terms), fit.design

    def start(phi: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        count, sums, squares = (len(y), y.sum(0), (y * y).sum(0)) if w is None else (w.sum(), w @ y, w @ (y * y))
        if w is not None:
            phi, y = phi * np.sqrt(w)[:, None], y * np.sqrt(w)[:, None]
        if len(phi) < p:
            phi, y = (np.concatenate([a, np.zeros((p - len(a), a.shape[1]))]) for a in (phi, y))
        q, r = np.linalg.qr(phi)
        z = q.T @ y
        more = np.zeros((2, p + y.shape[1]))
        more[0, 0], more[0, p:], more[1, p:] = count, np.maximum(squares - (z * z).sum(0), 0), sums
        return np.concatenate([np.concatenate([r, z], 1), more])

    found = cut(_reduced(rows, problem.names, start, design, _merged_factors(p), blocks))

    def solved(m: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        r, z, (left, sums) = m[:p, :p], m[:p, p:], m[p:, p:]
        runs, own = m[p, 0], sg.default_ridge(r) if ridge is None else ridge
        tall = np.concatenate([r, math.sqrt(own) * np.eye(p)])
        good = np.isfinite(z).all(0)
        c = np.full(z.shape, np.nan)
        c[:, good] = np.linalg.lstsq(tall, np.concatenate([z, np.zeros(z.shape)])[:, good], rcond=None)[0]
        sse = left + ((z - r @ c) ** 2).sum(0)
        var = (left + (z * z).sum(0)) / runs - (sums / runs) ** 2
        explained = (c[1:] ** 2).sum(0) / np.where(var > 0, var, np.nan)
        return c, pd.DataFrame({"n": runs, "rmse": np.sqrt(sse / runs), "variance": var, "explained_variance": explained, "ridge": own})

    def coefficients(frames):
        for f in frames:
            for row in f.itertuples():
                c, _ = solved(sg.unpacked(row))
                at = row.k % blocks * BLOCK + np.arange(c.shape[1])
                yield pd.DataFrame({"rep": row.k // blocks, "output_idx": np.repeat(at, p), "term": np.tile(np.arange(p), len(at)), "coefficient": c.T.ravel()})

    def quality(frames):
        for f in frames:
            for row in f.itertuples():
                _, q = solved(sg.unpacked(row))
                yield q.assign(rep=row.k // blocks, output_idx=row.k % blocks * BLOCK + np.arange(len(q)))[["rep", "output_idx", *q.columns]]

    shape = "rep int, output_idx int, n double, rmse double, variance double, explained_variance double, ridge double"
    return Fits(problem, fit.terms, order, n_outputs, found.mapInPandas(coefficients, "rep int, output_idx int, term int, coefficient double"), found.mapInPandas(quality, shape))


@dataclass
class Splines:
    """HDMR fits of many outputs: ``terms (rep, output_idx, term, mask, sa, sb, s, selected)`` and ``quality (rep, output_idx, variance, rmse, explained)``."""

    problem: Problem
    terms: DataFrame
    quality: DataFrame

    def first(self) -> DataFrame:
        """``(rep, output_idx, param, s1, st)``: structural shares of single inputs, and total shares of all terms with them."""
        names = self.problem.names
        has = lambda j: F.col("mask").bitwiseAND(F.lit(1 << j)) > 0
        each = [F.struct(F.lit(n).alias("param"), F.sum(F.when(F.col("mask") == 1 << j, F.col("sa"))).alias("s1"), F.sum(F.when(has(j), F.col("s"))).alias("st")) for j, n in enumerate(names)]
        per = self.terms.groupBy("rep", "output_idx").agg(F.array(*each).alias("p")).select("rep", "output_idx", F.explode("p").alias("p"))
        return per.select("rep", "output_idx", "p.*")

    def shapley(self, correlative: bool = False) -> DataFrame:
        """``(rep, output_idx, param, s1, st, shapley)`` from structural shares, with ``correlative`` from total ones."""
        return shares(self.terms.select("rep", "output_idx", "mask", F.col("s" if correlative else "sa").alias("v")), self.problem.names, ["rep", "output_idx"])


def hdmr(rows: DataFrame, problem: Problem, n_outputs: int, order: int = 2, intervals: int = 2, ridge: float = 1e-6, level: float = 0.95, most: int = 100, tol: float = 1e-3) -> Splines:
    """High-dimensional model representation of every output and replicate of ``rows (<names>, block, ys, ws)``, as ``surrogates.hdmr`` of each."""
    gate(problem, "hdmr")
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")
    names, d, m, blocks = problem.names, len(problem.names), intervals + 3, -(-n_outputs // BLOCK)
    pairs = list(itertools.combinations(range(d), 2)) if order == 2 else []
    basis = sg.hdmr_basis(problem, intervals, pairs)

    def design(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), basis(x)])

    def start(phi: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        left = phi if w is None else phi * w[:, None]
        squares = (y * y).sum(0) if w is None else w @ (y * y)
        top = np.column_stack([left.T @ phi, np.zeros(phi.shape[1])])
        return np.concatenate([top, np.column_stack([y.T @ left, squares])])

    found = _reduced(rows, names, start, design, lambda s: s.sum(0), blocks)
    labels, masks = sg.term_names(names, pairs), [*[1 << j for j in range(d)], *[1 << i | 1 << j for i, j in pairs]]
    least = m ** min(order, d) + 1

    def solved(frames):
        for f in frames:
            for row in f.itertuples():
                g = sg.unpacked(row)
                p = g.shape[1] - 1
                gram, with_y, squares, n = g[:p, :p], g[p:, :p], g[p:, p], g[0, 0]
                if n < least:
                    raise ValueError("too few runs")
                mean, means = gram[0] / n, with_y[:, 0] / n
                cov = (gram / n - np.outer(mean, mean))[1:, 1:]
                good = np.isfinite(with_y).all(1)
                var = squares / n - means**2
                got = sg.hdmr_terms(cov, (with_y / n - np.outer(means, mean))[good, 1:].T, var[good], n, d, pairs, m, ridge, level, most, tol)
                at = (row.k % blocks * BLOCK + np.arange(len(good)))[good]
                wide = {c: got[c].ravel() for c in ("sa", "sb", "s", "selected")}
                one = pd.DataFrame({"rep": row.k // blocks, "output_idx": np.repeat(at, len(labels)), "term": np.tile(labels, len(at)), "mask": np.tile(masks, len(at)), **wide})
                one["variance"], one["rmse"], one["explained"] = (np.repeat(x, len(labels)) for x in (var[good], np.sqrt(got["left"]), got["explained"]))
                yield one

    shape = "rep int, output_idx int, term string, mask bigint, sa double, sb double, s double, selected boolean, variance double, rmse double, explained double"
    table = cut(found.mapInPandas(solved, shape))
    quality = table.where(F.col("term") == names[0]).select("rep", "output_idx", "variance", "rmse", "explained")
    return Splines(problem, table.drop("variance", "rmse", "explained"), quality)
