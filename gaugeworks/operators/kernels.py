"""Kernel dependence (HSIC) of inputs and an output: first order, total, and permutation tests, over blocks of pairs of runs.

All pairs of runs are compared by the method's definition. A Gaussian kernel of one variable whose bandwidth is a median
distance is, to its last digits, a product of a few dozen features, so that sums over pairs are squares of sums over runs.
Where it is not, or there are too many inputs, runs are dealt to blocks, a pair of blocks is one task, and what leaves it are
sums. Kernels are centred by their means, from a first pass, so that the sums don't cancel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .frames import ranked
from .resampling import hashed

#: Runs of a block, and values of a sorted piece in the search of a median.
BLOCK, PIECE = 1024, 1 << 16
#: Distances that one pass of that search tries, and passes.
TRIALS, PASSES = 64, 11
#: Points that a kernel is interpolated at, and numbers of the products of all kernels' features that a task sums.
NODES, TENSOR = (32, 64, 128), 500_000


def median_distances(rows: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """The median positive distance of pairs of a column's values, exactly; of a column whose values are equal, 0.

    Values are ranked and cut into sorted pieces. Pairs within a trial distance are counted piece by piece, by binary
    search, for many trial distances at once; the range that holds the median narrows by that factor in each pass.
    """
    long = rows.unpivot([], list(cols), "c", "v")
    placed = ranked(long, ["c"], ["v"], "r", "n")
    pieces = cut(placed.withColumn("p", F.expr(f"cast(r div {PIECE} as int)")).groupBy("c", "p").agg(F.array_sort(F.collect_list("v")).alias("v"), F.first("n").alias("n")))
    info = {r.c: r for r in pieces.groupBy("c").agg(F.first("n").alias("n"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).collect()}
    right = pieces.select("c", F.col("p").alias("q"), F.col("v").alias("w"))
    met = pieces.select("c", "p", "v").join(right, "c").where("q >= p").select("c", "p", "q", "v", "w")

    def within(bounds: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        def count(frames):
            for f in frames:
                for c, p, q, v, w in zip(f.c, f.p, f.q, f.v, f.w):
                    a, b = np.asarray(v, float), np.asarray(w, float)
                    n = [int(np.searchsorted(b, a + d, "right").sum() - (np.arange(1, len(a) + 1).sum() if p == q else 0)) for d in bounds[c]]
                    yield pd.DataFrame({"c": c, "t": np.arange(len(n)), "n": n})

        got = met.mapInPandas(count, "c string, t int, n bigint").groupBy("c", "t").agg(F.sum("n").alias("n")).collect()
        out = {c: np.zeros(len(b), np.int64) for c, b in bounds.items()}
        for r in got:
            out[r.c][r.t] = r.n
        return out

    zero = within({c: np.zeros(1) for c in info})
    target = {c: int(zero[c][0]) + (r.n * (r.n - 1) // 2 - int(zero[c][0]) + 1) // 2 for c, r in info.items()}
    low, high = {c: 0.0 for c in info}, {c: r.hi - r.lo for c, r in info.items()}
    for _ in range(PASSES):
        tried = {c: np.linspace(low[c], high[c], TRIALS + 1)[1:] for c in info}
        got = within(tried)
        for c in info:
            k = int(np.searchsorted(got[c], target[c]))
            low[c], high[c] = (tried[c][k - 1] if k else low[c]), float(tried[c][min(k, TRIALS - 1)])
    return {c: float(high[c]) for c in info}


def hsic(runs: DataFrame, names: Sequence[str], y: str = "y", key: str = "run_id", block: int = BLOCK, bandwidth: float = 1.0, permutations: int = 0, seed: int = 0, draw=hashed) -> DataFrame:
    """``(param, hsic_raw, r2, total, p_value)``: kernel dependence of each input and the output.

    Kernels are Gaussian with bandwidths from the median distance of pairs. ``total`` is one less the dependence on the
    product of all other inputs' kernels, each one plus its centred kernel, over that on the product of all. With
    ``permutations``, ``p_value`` is the share of them, and of the sample itself, whose dependence is as large; without,
    it is null. A constant output gives NaN, a constant input has ``r2`` 0.
    """
    n = runs.count()
    last = max(1, -(-n // block))
    cols = [*names, y]
    placed = ranked(runs.select(F.lit(0).alias("all"), F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in cols]), ["all"], ["key"], "pos").drop("all", "n")
    rows = cut(placed.withColumn("b", (F.col("pos") % last).cast("int")))
    scale = {c: max(v * v, 1e-20) * bandwidth**2 for c, v in median_distances(rows.select(*cols), cols).items()}
    ends = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("b", F.max))]).first()
    parts = [factor(ends[f"a{i}"], ends[f"b{i}"], scale[c]) for i, c in enumerate(cols)]
    if all(p is not None for p in parts) and math.prod(1 + p.rank for p in parts[:-1]) * parts[-1].rank <= TENSOR:
        got = _by_factors(rows, cols, parts, n, permutations, seed, draw)
    else:
        got = _by_pairs(rows, cols, scale, n, last, permutations, seed, draw)
    one = {r.what: r.v for r in got.where("i = -1").collect()}
    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("v")))
    raw = got.where("i >= 0 AND what = 'xy'").select("i", F.col("v").alias("raw"))
    per = got.where("i >= 0").join(raw, "i").groupBy("i").agg(pick("xy").alias("xy"), pick("xx").alias("xx"), pick("others").alias("others"), F.count_if(F.col("what").startswith("p") & (F.col("v") >= F.col("raw"))).alias("above"))
    eps, nan = float(np.finfo(float).eps), F.lit(float("nan"))
    flat = one.get("yy", 0.0) < eps
    r2 = F.when(F.col("xx") < eps, 0.0).otherwise(F.col("xy") / F.sqrt(F.greatest(F.col("xx") * one.get("yy", 0.0), F.lit(eps**2))))
    total = 1 - F.col("others") / one["full"] if abs(one.get("full", 0.0)) >= eps else nan
    p = (F.col("above") + 1) / (permutations + 1) if permutations else F.lit(None).cast("double")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    return per.select(name.alias("param"), F.col("xy").alias("hsic_raw"), *[(nan if flat else e).alias(c) for e, c in ((r2, "r2"), (total, "total"))], (nan if flat and permutations else p).alias("p_value"))


@dataclass
class Factor:
    """Features whose products are a Gaussian kernel on an interval, to its last digits: interpolation at ``nodes``, then ``turn``."""

    nodes: np.ndarray
    weights: np.ndarray
    turn: np.ndarray

    @property
    def rank(self) -> int:
        return self.turn.shape[1]

    def at(self, x: np.ndarray) -> np.ndarray:
        gap = x[:, None] - self.nodes[None]
        hit = gap == 0
        share = self.weights / np.where(hit, 1.0, gap)
        share = np.where(hit.any(1)[:, None], hit.astype(float), share)
        return (share / share.sum(1)[:, None]) @ self.turn


def factor(lo: float, hi: float, scale: float) -> Factor | None:
    """The factor of the kernel with squared bandwidth ``scale`` between ``lo`` and ``hi``; None where it is too narrow for ``NODES``."""
    if not (math.isfinite(lo) and math.isfinite(hi)):
        return None
    if lo == hi:
        return Factor(np.array([lo]), np.ones(1), np.ones((1, 1)))
    for m in NODES:
        angle = (np.arange(m) + 0.5) * math.pi / m
        nodes = (lo + hi) / 2 - (hi - lo) / 2 * np.cos(angle)
        gram = lambda a, b: np.exp(-(np.subtract.outer(a, b) ** 2) / (2 * scale))
        values, vectors = np.linalg.eigh(gram(nodes, nodes))
        on = values > 1e-16 * values.max()
        out = Factor(nodes, (-1.0) ** np.arange(m) * np.sin(angle), vectors[:, on] * np.sqrt(values[on]))
        x = np.linspace(lo, hi, 5 * m + 1)
        if np.abs(out.at(x) @ out.at(x).T - gram(x, x)).max() < 1e-13:
            return out
    return None


def _by_factors(rows: DataFrame, cols: Sequence[str], parts: Sequence[Factor], n: int, permutations: int, seed: int, draw) -> DataFrame:
    """``(i, what, v)``: sums over all pairs of runs, from sums over the runs of products of the kernels' features."""
    from .surrogates import reduced_by

    d, columns = len(cols) - 1, list(cols)
    if permutations:
        y = cols[-1]
        reps = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("rep")
        drawn = rows.select("pos", reps).withColumn("h", draw(F.col("rep"), F.col("pos"), seed))
        moved = ranked(drawn, ["rep"], ["h", "pos"], "to", "_n").select("pos", "rep", "to")
        taken = moved.join(rows.select(F.col("pos").alias("to"), F.col(y).alias("py")), "to")
        lists = taken.groupBy("pos").agg(*[F.max(F.when(F.col("rep") == r, F.col("py"))).alias(f"_p{r}") for r in range(permutations)])
        rows, columns = rows.join(lists, "pos"), [*cols, *[f"_p{r}" for r in range(permutations)]]
    rows = cut(rows.select(*columns))
    sums = reduced_by(rows, list(cols), lambda a: {i: p.at(a[:, i]).sum(0)[None] for i, p in enumerate(parts)}, lambda s: s.sum(0))
    means = {i: sums[i][0] / n for i in range(d + 1)}

    def start(a: np.ndarray) -> dict[int, np.ndarray]:
        f = [p.at(a[:, i]) - means[i] for i, p in enumerate(parts)]
        out = {i: x.T @ x for i, x in enumerate(f)}
        whole = np.ones((len(a), 1))
        for x in f[:-1]:
            whole = (whole[:, :, None] * np.column_stack([np.ones(len(a)), x])[:, None, :]).reshape(len(a), -1)
        out[d + 1] = whole.T @ f[-1]
        for r in range(permutations):
            moved = parts[-1].at(a[:, d + 1 + r]) - means[d]
            out[d + 2 + r] = np.concatenate([x.T @ moved for x in f[:-1]])
        return out

    got = reduced_by(rows, columns, start, lambda s: s.sum(0))
    square = lambda m: float((np.asarray(m) ** 2).sum()) / float(n) ** 2
    tensor = got[d + 1].reshape(*[1 + p.rank for p in parts[:-1]], parts[-1].rank)
    data = [(-1, "yy", square(got[d])), (-1, "full", square(tensor))]
    begin = np.concatenate([[0], np.cumsum([p.rank for p in parts[:-1]])])
    for i in range(d):
        alone = tuple(slice(1, None) if j == i else 0 for j in range(d))
        without = tuple(0 if j == i else slice(None) for j in range(d))
        data += [(i, "xy", square(tensor[alone])), (i, "xx", square(got[i])), (i, "others", square(tensor[without]))]
        data += [(i, f"p{r}", square(got[d + 2 + r][begin[i] : begin[i + 1]])) for r in range(permutations)]
    return rows.sparkSession.createDataFrame(data, "i int, what string, v double")


def _by_pairs(rows: DataFrame, cols: Sequence[str], scale: dict[str, float], n: int, last: int, permutations: int, seed: int, draw) -> DataFrame:
    """``(i, what, v)``: the same sums from blocks of pairs, for bandwidths that are tiny beside the range and for many inputs."""
    names, y = list(cols[:-1]), cols[-1]
    every = F.explode(F.sequence(F.lit(0), F.lit(last - 1)))
    aside = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns if c != "b"], F.col("b").alias("o")).withColumn("b", every)
    kernel = lambda p, q, c: np.exp(-(np.subtract.outer(p, q) ** 2) / (2 * scale[c]))

    def means(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"pos": [], **{f"m{i}": [] for i in range(len(cols))}})
        return pd.DataFrame({"pos": p.pos, **{f"m{i}": kernel(p[c].to_numpy(), q[c].to_numpy(), c).sum(1) / n for i, c in enumerate(cols)}})

    shape = ", ".join(["pos bigint", *[f"m{i} double" for i in range(len(cols))]])
    left = rows.withColumn("o", every)
    right = aside(rows)
    sums = left.groupBy("b", "o").cogroup(right.groupBy("b", "o")).applyInPandas(means, shape)
    centred = rows.join(sums.groupBy("pos").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(cols))]), "pos")
    if permutations:
        reps = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("rep")
        drawn = centred.select("pos", reps).withColumn("h", draw(F.col("rep"), F.col("pos"), seed))
        moved = ranked(drawn, ["rep"], ["h", "pos"], "to", "_n").select("pos", "rep", F.col("to"))
        taken = centred.select(F.col("pos").alias("to"), F.col(y).alias("py"), F.col(f"m{len(cols) - 1}").alias("pm"))
        lists = moved.join(taken, "to").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("rep", "py", "pm"))).alias("l"))
        centred = centred.join(lists.select("pos", F.transform("l", lambda x: x.py).alias("py"), F.transform("l", lambda x: x.pm).alias("pm")), "pos")
    centred = cut(centred)
    grand = centred.agg(*[F.avg(f"m{i}").alias(f"m{i}") for i in range(len(cols))]).first()

    def pairs(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"i": [], "what": [], "v": []}
        if not len(p) or not len(q):
            return pd.DataFrame(out)
        centre = lambda k, a, b, i: k - np.asarray(a)[:, None] - np.asarray(b)[None] + grand[f"m{i}"]
        ks = [centre(kernel(p[c].to_numpy(), q[c].to_numpy(), c), p[f"m{i}"], q[f"m{i}"], i) for i, c in enumerate(cols)]
        ly = ks.pop()
        add = lambda i, what, v: (out["i"].append(i), out["what"].append(what), out["v"].append(float(v)))
        add(-1, "yy", (ly * ly).sum())
        after = [np.ones_like(ly)]
        for k in reversed(ks):  # products of the kernels from each input on
            after.append(after[-1] * (1 + k))
        after.reverse()
        add(-1, "full", (after[0] * ly).sum())
        before = np.ones_like(ly)
        for i, k in enumerate(ks):
            add(i, "xy", (k * ly).sum())
            add(i, "xx", (k * k).sum())
            add(i, "others", (before * after[i + 1] * ly).sum())
            before = before * (1 + k)
        if permutations:
            py, qy, pm, qm = (np.stack(f[c].to_numpy()) for f, c in ((p, "py"), (q, "py"), (p, "pm"), (q, "pm")))
            for r in range(permutations):
                lp = centre(kernel(py[:, r], qy[:, r], y), pm[:, r], qm[:, r], len(names))
                for i, k in enumerate(ks):
                    add(i, f"p{r}", (k * lp).sum())
        return pd.DataFrame(out)

    left = centred.withColumn("o", every)
    right = aside(centred)
    found = left.groupBy("b", "o").cogroup(right.groupBy("b", "o")).applyInPandas(pairs, "i int, what string, v double")
    got = cut(found.groupBy("i", "what").agg((F.sum("v") / float(n) ** 2).alias("v")))
    return got
