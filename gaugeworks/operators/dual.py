"""Pair functions of HDMR in the space of the runs, where there are more weights than runs.

The same ridge problem as that of the weights, as a system with a row and a column for each run: its kernel is a sum over pairs
of products of the runs' splines, taken block of runs by block of runs. The Gram matrix of all pairs is never formed, only its
diagonal blocks and its products with the splines of single inputs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..problem import Problem
from . import surrogates as sg
from .frames import ranked

#: Runs whose system is solved, and runs of a block of its kernel.
MOST, SIDE = 4096, 512


def dual_hdmr(runs: DataFrame, problem: Problem, y: str, intervals: int, pairs: Sequence[tuple[int, int]], ridge: float, level: float, most: int, tol: float, weight: str | None) -> sg.Hdmr:
    """``surrogates.hdmr`` of second order by the system of the runs."""
    names, d, m = problem.names, len(problem.names), intervals + 3
    q, size = d * m, m * m
    basis = sg.hdmr_basis(problem, intervals, pairs)
    cols = [*names, y, *([weight] if weight else [])]
    values = runs.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    numbers = values.columns
    placed = cut(ranked(values.withColumn("_all", F.lit(0)), ["_all"], values.columns, "pos", "_n").select("pos", *values.columns))
    if (n_rows := placed.count()) > MOST:
        raise ValueError(f"{n_rows} runs are too many to be solved for together")

    def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Splines of single inputs, of pairs, outputs and weights of rows."""
        b = basis(a[:, :d])
        return b[:, :q], b[:, q:], a[:, d], a[:, d + 1] if weight else np.ones(len(a))

    def sums(a: np.ndarray) -> dict[int, np.ndarray]:
        b1, b2, out, w = split(a)
        one = np.column_stack([np.ones(len(a)), b1, out])
        diagonal = np.concatenate([b2[:, lo : lo + size].T @ (b2[:, lo : lo + size] * w[:, None]) for lo in range(0, b2.shape[1], size)])
        return {0: one.T @ (one * w[:, None]), 1: one.T @ (b2 * w[:, None]), 2: diagonal}

    got = sg.reduced_by(placed, numbers, sums, lambda s: s.sum(0))
    g, cross, diagonal = got[0], got[1], got[2]
    n = g[0, 0]
    mean, mean2 = g[0] / n, cross[0] / n
    cov, cross = g / n - np.outer(mean, mean), cross / n - np.outer(mean, mean2)
    first, with_y, var = cov[1:-1, 1:-1], cov[1:-1, -1], cov[-1, -1]
    shift = sg.projection(first, cross[1:-1])
    raw, left = np.zeros(len(pairs)), np.zeros(len(pairs))
    for t in range(len(pairs)):
        own = slice(t * size, (t + 1) * size)
        block = np.diag(diagonal[own]) / n - mean2[own] ** 2
        raw[t], left[t] = block.mean(), (block - np.einsum("ij,ij->j", cross[1:-1][:, own], shift[:, own])).mean()
    ridges, alive = sg.pair_ridges(raw, left, ridge)
    scale = np.repeat(np.where(alive, 1 / np.sqrt(ridges), 0.0), size)
    mean1 = mean[1:-1]

    def projected(a: np.ndarray) -> np.ndarray:
        """What single inputs leave of the pairs' splines, over the root of their ridge."""
        b1, b2, _, w = split(a)
        return ((b2 - mean2) - (b1 - mean1) @ shift) * scale * np.sqrt(w)[:, None]

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": f.b[:1], "rows": [f.sort_values("pos")[numbers].to_numpy(float).tobytes()]})

    blocks = cut(placed.withColumn("b", F.expr(f"pos div {SIDE}").cast("int")).groupBy("b").applyInPandas(pack, "b int, rows binary"))
    width = len(cols)
    unpack = lambda blob: np.frombuffer(blob).reshape(-1, width)

    def kernel(frames):
        for f in frames:
            for r in f.itertuples():
                yield pd.DataFrame({"i": [r.i], "j": [r.j], "k": [(projected(unpack(r.rows)) @ projected(unpack(r.other)).T).tobytes()]})

    count = -(-n_rows // SIDE)
    upper = blocks.withColumnRenamed("b", "i").withColumn("j", F.explode(F.sequence("i", F.lit(count - 1)))).join(blocks.select(F.col("b").alias("j"), F.col("rows").alias("other")), "j")
    whole = np.zeros((n_rows, n_rows))
    for r in upper.repartition(count * count, "i", "j").mapInPandas(kernel, "i int, j int, k binary").collect():  # at most MOST runs squared
        lo, to = r.i * SIDE, r.j * SIDE
        part = np.frombuffer(r.k).reshape(min(SIDE, n_rows - lo), -1)
        whole[lo : lo + len(part), to : to + part.shape[1]] = part
        whole[to : to + part.shape[1], lo : lo + len(part)] = part.T
    outputs = placed.orderBy("pos").select(f"c{d}", *([f"c{d + 1}"] if weight else [])).toPandas().to_numpy(float)  # one number of each run
    target = (outputs[:, 0] - mean[-1]) * (np.sqrt(outputs[:, 1]) if weight else 1.0)
    a = np.linalg.solve(whole + n * np.eye(n_rows), target)
    found = {r.b: r.rows for r in blocks.collect()}  # as many runs as the system has
    w2 = scale * sum(projected(unpack(found[b])).T @ a[b * SIDE : (b + 1) * SIDE] for b in sorted(found))
    w1 = sg.backfit(first, with_y, m, ridge, most, tol)
    turned = shift @ (w2[:, None] * np.repeat(np.eye(len(pairs)), size, 0))  # what each pair takes back from single inputs

    def functions(b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
        """Each term's function at rows, up to a constant."""
        one = [b1[:, j * m : (j + 1) * m] @ w1[j * m : (j + 1) * m] for j in range(d)]
        two = [b2[:, t * size : (t + 1) * size] @ w2[t * size : (t + 1) * size] for t in range(len(pairs))]
        return np.column_stack([*one, *two]) - np.column_stack([np.zeros((len(b1), d)), b1 @ turned])

    def moments(a: np.ndarray) -> np.ndarray:
        b1, b2, out, w = split(a)
        f = np.column_stack([np.ones(len(a)), functions(b1, b2), out])
        return f.T @ (f * w[:, None])

    f = sg.reduced(placed, numbers, moments, lambda s: s.sum(0))
    inner = f / n - np.outer(f[0], f[0]) / n**2
    sizes = np.array([m] * d + [size] * len(pairs))
    one = sg.ancova(inner[1:-1, 1:-1], inner[1:-1, -1], var, n, sizes, sg.f_bounds(level, sizes, n))
    table = pd.DataFrame({"term": sg.term_names(names, pairs), **{c: one[c] for c in ("sa", "sb", "s", "selected")}})
    weights = np.concatenate([w1 - turned.sum(1), w2])
    offset = float(mean[-1] - mean1 @ weights[:q] - mean2 @ w2)
    return sg.Hdmr(names, table, float(one["explained"]), problem, basis, weights, offset, math.sqrt(one["left"]))
