"""Entropic optimal transport from a cloud of outputs to its classes, at any number of runs.

A cloud is several outputs, or the times of one, of each run. Plans run from all runs to the members of each class of each input. The
potentials of a plan are tables: blocks of runs have theirs, blocks of members theirs. A round takes costs between every
block of runs and every block of members, a pair at a time, and merges each block's maxima and scaled sums of
exponentials by grouping, once for the runs and once for the members; every ten rounds the marginals are tested and
plans that have settled rest. Small plans are solved by one task each, with the same rounds.

The kernel of a round is Gaussian, and where it is not narrow beside the cloud, to its last digits a product of a few dozen features of each
output. Sums over all members are then products with sums of their features, so that a round is linear in runs and members: it
passes on one vector for each plan. Plans of clouds that a task holds are rounds there, others passes over the blocks. Where
features are too many, or too coarse for what a plan's sums come to, pairs are compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .frames import ranked
from .kernels import Factor, factor
from .surrogates import SHAPE, partial_rows, together, unpacked

#: Runs or members of a block; costs of a plan, and numbers of a cloud, that one task takes.
SIDE, PLAN, CLOUD = 1024, 20_000_000, 4_000_000
#: Rounds between tests of the marginals.
TESTED = 10
#: Costs up to which a plan is not solved by features, features of all outputs together at most, numbers of plans' sums that the driver passes on, and of features that a task keeps.
DIRECT, TENSOR, FEATURES, KEPT = 1_000_000, 1 << 16, 4_000_000, 12_000_000
#: Errors that features may bring to a plan's marginals, in all and at any run or member.
COARSE, COARSEST = 1e-9, 1e-6


def clouds(outputs: DataFrame, keys: Sequence[str], coords: Sequence[str], standardise: bool = True) -> DataFrame:
    """``(*keys, run_id, z)`` from long outputs: the outputs of a run along ``coords``, in order, each divided by its deviation if asked.

    A constant output is only moved. Every run must have all of them.
    """
    rows = outputs.select("run_id", *keys, F.struct(*coords).alias("at") if coords else F.struct(F.lit(0).alias("o")).alias("at"), F.col("y").cast("double").alias("y"))
    if standardise:
        stats = rows.groupBy(*keys, "at").agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))
        rows = rows.join(stats, [*keys, "at"]).withColumn("y", (F.col("y") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))
    return rows.groupBy(*keys, "run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "y"))), lambda p: p["y"]).alias("z"))


def _packed(rows: DataFrame, ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``(*ids, b, pts, w)``: rows ``(*ids, ..., z, w)`` in blocks of ``SIDE``, points and weights as bytes."""
    types = dict(rows.dtypes)
    placed = ranked(rows, ids, order, "_place", "_size").withColumn("b", F.expr(f"_place div {SIDE}").cast("int"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: f[c].iloc[:1] for c in [*ids, "b"]}, "pts": [np.array(f.z.tolist(), float).tobytes()], "w": [f.w.to_numpy(float).tobytes()]})

    shape = ", ".join([*[f"`{c}` {types[c]}" for c in ids], "b int, pts binary, w binary"])
    return placed.select(*ids, "b", "z", "w").groupBy(*ids, "b").applyInPandas(pack, shape)


def soft(t: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Maxima along an axis, and sums of exponentials less them."""
    top = t.max(axis)
    return top, np.exp(t - np.expand_dims(top, axis)).sum(axis)


def costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def entropic(c: np.ndarray, a: np.ndarray, b: np.ndarray, epsilon: float, tol: float, most: int) -> tuple[float, bool]:
    """The transport part of the plan of costs ``c`` with marginals ``a`` and ``b``, and whether it settled within ``most`` rounds."""
    log_a, log_b, f, g, done = np.log(a), np.log(b), np.zeros(len(a)), np.zeros(len(b)), False
    for k in range(1, most + 1):
        top, total = soft((g[None] - c) / epsilon + log_b[None], 1)
        f = -epsilon * (top + np.log(total))
        top, total = soft((f[:, None] - c) / epsilon + log_a[:, None], 0)
        g = -epsilon * (top + np.log(total))
        if k % TESTED == 0 or k == most:
            plan = np.exp((f[:, None] + g[None] - c) / epsilon + log_a[:, None] + log_b[None])
            if np.abs(plan.sum(1) - a).sum() <= tol:
                done = True
                break
    plan = np.exp((f[:, None] + g[None] - c) / epsilon + log_a[:, None] + log_b[None])
    return float((plan * c).sum()), done


@dataclass
class Features:
    """The kernel ``exp(-costs / e)`` on a box, as sums of products of features of each output; ``error`` of its largest value."""

    parts: list[Factor]
    error: float

    @classmethod
    def of(cls, low: Sequence[float], high: Sequence[float], e: float) -> Features | None:
        """None where a coordinate is too wide for ``factor``, or the products are too many."""
        parts, error, size = [], 0.0, 1
        for a, b in zip(low, high):
            if (part := factor(a, b, e / 2)) is None or (size := size * part.rank) > TENSOR:
                return None
            x = np.linspace(a, b, 199)
            error += float(np.abs(part.at(x) @ part.at(x).T - np.exp(-np.subtract.outer(x, x) ** 2 / e)).max()) + np.finfo(float).eps
            parts.append(part)
        return cls(parts, error)

    @property
    def shape(self) -> tuple[int, int]:
        return math.prod(p.rank for p in self.parts[:-1]), self.parts[-1].rank

    def at(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of all outputs' features but the last one's, and those."""
        left = np.ones((len(z), 1))
        for j, p in enumerate(self.parts[:-1]):
            left = (left[:, :, None] * p.at(z[:, j])[:, None, :]).reshape(len(z), -1)
        return left, self.parts[-1].at(z[:, -1])

    def sums(self, f: tuple[np.ndarray, np.ndarray], u: np.ndarray) -> np.ndarray:
        """Features summed with weights."""
        return (f[0].T @ (f[1] * u[:, None])).ravel()

    def totals(self, f: tuple[np.ndarray, np.ndarray], m: np.ndarray) -> np.ndarray:
        """Kernels with points whose features sum to ``m``, summed."""
        return ((f[0] @ m[: math.prod(self.shape)].reshape(self.shape)) * f[1]).sum(1)


#: Blocks ``(z, w, features)`` of runs or members.
Blocks = Iterable[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]


def _first(k: Features, blocks: Blocks) -> np.ndarray:
    """What a half round passes on, of members whose potentials are 0: sums of features, of weights, and one over the least kernel sum."""
    return np.sum([[*k.sums(f, w), w.sum(), 0.0] for _, w, f in blocks], 0)


def _half(k: Features, blocks: Blocks, m: np.ndarray) -> np.ndarray:
    """The runs' half of a round from what the members' passed on, or the other way round."""
    out = np.zeros(len(m))
    for _, w, f in blocks:
        total = k.totals(f, m)
        u = w / np.where(total > 0, total, np.nan)
        out[:-2] += k.sums(f, u)
        out[-2] += u.sum()
        out[-1] = np.maximum(out[-1], np.max(1 / np.where(total > 0, total, np.nan)))
    return out


def _merged(stack: np.ndarray) -> np.ndarray:
    """Vectors of a half round together, each of one row."""
    return np.concatenate([stack[..., :-1].sum(0), stack[..., -1:].max(0)], -1)


def _pulls(k: Features, blocks: Blocks, m: np.ndarray) -> np.ndarray:
    """Of the members, from what the runs passed on: their squares' sum, and sums of features with each output."""
    out = 0.0
    for z, w, f in blocks:
        u = w / k.totals(f, m)
        out = out + np.concatenate([[(w * (z * z).sum(1)).sum()], *[k.sums(f, u * x) for x in z.T]])
    return out


def _ends(k: Features, blocks: Blocks, m: np.ndarray, new: np.ndarray) -> np.ndarray:
    """As ``_pulls`` of the runs, whose potentials are from ``m``, against members' from ``new``, and how far their marginals are off."""
    out = 0.0
    for z, w, f in blocks:
        before, after = k.totals(f, m), k.totals(f, new)
        u, share = w / before, w * after / before
        out = out + np.concatenate([[np.abs(share - w).sum(), (share * (z * z).sum(1)).sum()], *[k.sums(f, u * x) for x in z.T]])
    return out


def _cost(ends: np.ndarray, pulls: np.ndarray) -> float:
    return float(ends[1] + pulls[0] - 2 * ends[2:] @ pulls[1:])


def _lost(k: Features, m: np.ndarray, out: np.ndarray) -> bool:
    """Whether the features' errors could show in a half round ``out``: kernel sums are too small beside the weights of ``m``."""
    return not (k.error * m[-2] * out[-2] <= COARSE and k.error * m[-2] * out[-1] <= COARSEST)


def featured(k: Features, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, tol: float, most: int) -> tuple[float, bool] | None:
    """As ``entropic`` of runs ``x`` and members ``y``, by features; None where they are too coarse."""
    cut_ = lambda z, w: ((z[i : i + SIDE], w[i : i + SIDE], k.at(z[i : i + SIDE])) for i in range(0, len(z), SIDE))
    runs, members = (lambda: cut_(x, a)), (lambda: cut_(y, b))
    if (len(x) + len(y)) * sum(k.shape) <= KEPT:
        kept = list(runs()), list(members())
        runs, members = (lambda: kept[0]), (lambda: kept[1])
    new, done = _first(k, members()), False
    for r in range(1, most + 1):
        m = new
        n = _half(k, runs(), m)
        new = _half(k, members(), n)
        if _lost(k, m, n) or _lost(k, n, new):
            return None
        if r % TESTED == 0 or r == most:
            ends = _ends(k, runs(), m, new)
            if done := bool(ends[0] <= tol):
                break
    return _cost(ends, _pulls(k, members(), n)), done


def joint_transport(cloud: DataFrame, table: DataFrame, keys: Sequence[str] = (), epsilon: float = 0.03, most: int = 2000, tol: float = 1e-9, plan: int | None = None) -> DataFrame:
    """``(param, *keys, ot, advective, diffusive, s1, unconverged)`` of clouds ``(*keys, run_id, z)`` and classes ``(run_id, param, class)``.

    Both may have ``w``, how often a run counts, and ``table`` may have some of the keys, as a replicate's. ``epsilon`` is relative to
    twice a cloud's total variance; the cost is the transport part of the plan, what entropy adds to it is part of
    ``diffusive``. Plans that do not settle in ``most`` rounds keep their last state and are counted. A cloud
    without variance gives 0, one with a NaN gives NaN. Plans above ``plan`` costs are solved by features, or block by block.
    """
    keys, plan = list(keys), PLAN if plan is None else plan
    shared = ["run_id", *[k for k in keys if k in table.columns]]
    one = lambda df: df if "w" in df.columns else df.withColumn("w", F.lit(1.0))
    cloud, z = one(cloud), F.col("z")
    dims = cloud.agg(F.max(F.size("z"))).first()[0] or 1
    stats = cloud.groupBy(*keys).agg(F.sum("w").alias("n"), F.count("*").alias("_rows"), *[F.sum(F.col("w") * z[e]).alias(f"s{e}") for e in range(dims)], *[F.sum(F.col("w") * z[e] * z[e]).alias(f"q{e}") for e in range(dims)])
    total = sum((F.col(f"q{e}") - F.col(f"s{e}") * F.col(f"s{e}") / F.col("n") for e in range(dims)), F.lit(0.0))
    stats = stats.select(*keys, "n", "_rows", F.array(*[F.col(f"s{e}") / F.col("n") for e in range(dims)]).alias("mean"), (2 * F.greatest(total, F.lit(0.0)) / (F.col("n") - 1)).alias("v"))
    stats = cut(_numbered(stats, keys, "kid"))
    met = lambda df, on: df.join(stats.select(*keys, "kid", "mean"), on) if on else df.crossJoin(F.broadcast(stats.select("kid", "mean")))  # noqa: E731  one cloud
    centred = F.transform(F.arrays_zip("z", "mean"), lambda p: p["z"] - p["mean"])
    moved = cut(met(cloud, keys).select("kid", "run_id", "w", *keys, centred.alias("z")))
    members = one(table).groupBy(*shared, "param", "class").agg(F.sum("w").cast("double").alias("w")).where("class IS NOT NULL")
    placed = members.join(moved.drop("w"), shared)
    per = placed.groupBy("kid", "param", "class").agg(F.sum("w").alias("c"), F.count("*").alias("p"), *[F.sum(F.col("w") * z[e]).alias(f"s{e}") for e in range(dims)])
    adv = sum(((F.col(f"s{e}") / F.col("c")) ** 2 for e in range(dims)), F.lit(0.0))
    per = per.select("kid", "param", "class", "c", "p", adv.alias("a"))
    per = cut(_numbered(per.join(stats.select("kid", "n", "_rows", "v"), "kid"), ["kid", "param", "class"], "cid"))
    held = F.col("_rows") * dims <= CLOUD
    small = (F.col("p") * F.col("_rows") <= plan) & held
    blocks = cut(_packed(moved.select("kid", "run_id", "z", "w").join(stats.select("kid", "n"), "kid").select("kid", "run_id", "z", (F.col("w") / F.col("n")).alias("w")), ["kid"], ["run_id"]))
    own = cut(_packed(placed.join(per.select("kid", "param", "class", "cid", "c"), ["kid", "param", "class"]).select("cid", "run_id", "z", (F.col("w") / F.col("c")).alias("w")), ["cid"], ["run_id"]))
    known = per.where("v > 0 AND NOT isnan(v)").withColumns({"small": small, "held": held, "wide": F.col("p") * F.col("_rows") > DIRECT}).select("cid", "kid", (F.lit(epsilon) * F.col("v")).alias("e"), "small", "held", "wide")
    known = cut(known)
    solved = cut(_in_tasks(known.where("held AND (small OR wide)"), blocks, own, dims, tol, most))
    if not (large := known.where("NOT held")).isEmpty():
        bounds = moved.join(large.select("kid").distinct(), "kid").groupBy("kid").agg(*[F.array(*[end(z[e]) for e in range(dims)]).alias(c) for c, end in (("low", F.min), ("high", F.max))])
        solved = cut(solved.unionByName(_in_passes(large.join(bounds, "kid"), blocks, own, dims, tol, most)))
    left = cut(known.join(solved.where("w IS NOT NULL"), "cid", "left_anti"))
    if not left.isEmpty():
        solved = solved.where("w IS NOT NULL").unionByName(_in_rounds(left, blocks, own, dims, tol, most))
    got = per.join(solved, "cid", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    share, over = F.col("c") / F.col("n"), F.when(F.isnan("v"), F.col("v")).when(F.col("v") > 0, 1 / F.col("v")).otherwise(0.0)
    sums = got.groupBy("kid", "param").agg(F.sum(share * F.col("w") * over).alias("ot"), F.sum(share * F.col("a") * over).alias("advective"), F.sum(share * F.greatest(F.col("w") - F.col("a"), F.lit(0.0)) * over).alias("diffusive"), F.first("n").alias("n"), F.sum(F.coalesce("left", F.lit(0))).alias("unconverged"))
    sums = sums.withColumn("s1", 2 * F.col("n") / (F.col("n") - 1) * F.col("advective"))
    return sums.join(stats.select("kid", *keys), "kid").select("param", *keys, "ot", "advective", "diffusive", "s1", "unconverged")


def _numbered(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    if not by:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    return ranked(rows.withColumn("_all", F.lit(0)), ["_all"], list(by), name, "_n").drop("_all", "_n")


def _points(blob: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(blob).reshape(-1, dims)


def _in_tasks(known: DataFrame, blocks: DataFrame, own: DataFrame, dims: int, tol: float, most: int) -> DataFrame:
    """``(cid, w, left)`` of plans that one task holds: it gets the class and its cloud, whose sizes are bounded.

    Plans that are ``wide`` go by features; where these fail, ``w`` is null unless the plan is ``small``.
    """
    side = own.select("cid", F.lit(1).alias("side"), "b", "pts", "w").join(known.select("cid", "e", "small", "wide"), "cid")
    whole = blocks.join(known, "kid").select("cid", F.lit(0).alias("side"), "b", "pts", "w", "e", "small", "wide")

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("b")
        a, b = (np.concatenate([_points(p, dims) for p in f.pts[f.side == s]]) for s in (0, 1))
        wa, wb = (np.concatenate([np.frombuffer(w) for w in f.w[f.side == s]]) for s in (0, 1))
        e, got = float(f.e.iloc[0]), None
        if f.wide.iloc[0] and (k := Features.of(a.min(0), a.max(0), e)):
            got = featured(k, a, b, wa, wb, tol, most)
        if got is None and f.small.iloc[0]:
            got = entropic(costs(a, b), wa, wb, e, tol, most)
        value, done = got or (None, False)
        return pd.DataFrame({"cid": f.cid[:1], "w": [value], "left": [int(not done)]})

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small inputs of long tasks, which are not to be put together
    return side.unionByName(whole).repartition(parts, "cid").groupBy("cid").applyInPandas(solve, "cid bigint, w double, left int")


def _in_passes(known: DataFrame, blocks: DataFrame, own: DataFrame, dims: int, tol: float, most: int) -> DataFrame:
    """``(cid, w, left)`` of plans ``(cid, kid, e, low, high)`` of large clouds, by features: half a round is a pass over the blocks, of which one vector for each plan is left.

    Plans without features, or for which these are too coarse, have no row.
    """
    spark = blocks.sparkSession
    kernels: dict[int, Features] = {}
    for r in known.select("kid", "e", "low", "high").distinct().collect():  # a row for each cloud
        if k := Features.of(r.low, r.high, r.e):
            kernels[r.kid] = k
    of = {r.cid: r.kid for r in known.select("cid", "kid").collect() if r.kid in kernels}  # a row for each plan
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out, rest = [], sorted(of)
    runs = cut(blocks.join(known.select("kid").distinct(), "kid").select("kid", F.lit(-1).cast("bigint").alias("cid"), "pts", "w").repartition(parts))
    members = cut(own.join(known.select("cid", "kid"), "cid").select("kid", "cid", "pts", "w").repartition(parts))

    def over(side: DataFrame, plans: set[int], merge: Callable, use: Callable[[int, Features, Blocks], np.ndarray]) -> dict[int, np.ndarray]:
        """What ``use`` makes of the blocks of each plan, merged."""
        both: dict[int, list[int]] = {}
        for c in plans:
            both.setdefault(of[c], []).append(c)

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for r in itertools.chain.from_iterable(f.itertuples() for f in frames):
                mine = both.get(r.kid, []) if r.cid < 0 else [c for c in (r.cid,) if c in plans]
                if mine:
                    k, z = kernels[r.kid], _points(r.pts, dims)
                    block = [(z, np.frombuffer(r.w), k.at(z))]
                for c in mine:
                    part = use(c, k, block)[None]
                    sums[c] = merge(np.stack([sums[c], part])) if c in sums else part
            yield from partial_rows(sums)

        return {r.k: unpacked(r)[0] for r in together(side.mapInPandas(partial, SHAPE), merge, parts).collect()}

    add = lambda s: s.sum(0)
    while rest:
        plans, size = set(), 0
        while rest and size + (one := math.prod(kernels[of[rest[-1]]].shape) * (dims + 3)) <= max(FEATURES, one):
            plans.add(rest.pop())
            size += one
        new, rounds = over(members, plans, _merged, lambda c, k, b: _first(k, b)), 0
        while plans and rounds < most:
            m, rounds = new, rounds + 1
            n = over(runs, plans, _merged, lambda c, k, b, m=m: _half(k, b, m[c]))
            new = over(members, plans, _merged, lambda c, k, b, n=n: _half(k, b, n[c]))
            plans = {c for c in plans if not (_lost(kernels[of[c]], m[c], n[c]) or _lost(kernels[of[c]], n[c], new[c]))}
            if rounds % TESTED == 0 or rounds == most:
                ends = over(runs, plans, add, lambda c, k, b, m=m, new=new: _ends(k, b, m[c], new[c]))
                settled = {c for c in plans if ends[c][0] <= tol or rounds == most}
                pulls = over(members, settled, add, lambda c, k, b, n=n: _pulls(k, b, n[c])) if settled else {}
                out += [(c, _cost(ends[c], pulls[c]), int(ends[c][0] > tol)) for c in settled]
                plans -= settled
    return spark.createDataFrame(out, "cid bigint, w double, left int")


def _in_rounds(known: DataFrame, blocks: DataFrame, own: DataFrame, dims: int, tol: float, most: int) -> DataFrame:
    """``(cid, w, left)`` of large plans, by rounds over all of them."""
    known = known.select("cid", "kid", "e")
    count = blocks.groupBy("kid").agg((F.max("b") + 1).alias("_k"))
    pairs = own.withColumnsRenamed({"b": "j", "pts": "q", "w": "wq"}).join(known.select("cid", "kid", "e"), "cid").join(count, "kid").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") - 1))).drop("_k")
    pairs = pairs.join(blocks.withColumnsRenamed({"b": "i", "pts": "p", "w": "wp"}), ["kid", "i"])  # every block of runs with every block of members
    zeros = F.udf(lambda w: bytes(len(w)), "binary")
    shape = "cid bigint, b int, top binary, total binary"

    def half(potentials: DataFrame, of: str) -> DataFrame:
        """The potentials of the runs (``of`` is i) from those of the members, or the other way round."""
        other = "j" if of == "i" else "i"
        met = pairs.join(potentials.withColumnsRenamed({"b": other, "f": "pot"}), ["cid", other]).select("cid", F.col(of).alias("b"), "p", "q", F.col("wq" if of == "i" else "wp").alias("w"), "e", "pot")

        def partial(frames):
            for f in frames:
                for r in f.itertuples():
                    c = costs(_points(r.p, dims), _points(r.q, dims))
                    t = np.frombuffer(r.pot) / r.e + np.log(np.frombuffer(r.w))
                    top, total = soft(t[None] - c / r.e, 1) if of == "i" else soft(t[:, None] - c / r.e, 0)
                    yield pd.DataFrame({"cid": [r.cid], "b": [r.b], "e": [r.e], "top": [top.tobytes()], "total": [total.tobytes()]})

        def merged(f: pd.DataFrame) -> pd.DataFrame:
            tops, totals = (np.stack([np.frombuffer(x) for x in f[c]]) for c in ("top", "total"))
            top = tops.max(0)
            f_ = -f.e.iloc[0] * (top + np.log((totals * np.exp(tops - top)).sum(0)))
            return pd.DataFrame({"cid": f.cid[:1], "b": f.b[:1], "f": [f_.tobytes()]})

        return met.mapInPandas(partial, shape + ", e double").groupBy("cid", "b").applyInPandas(merged, "cid bigint, b int, f binary")

    def moved(now: DataFrame, again: DataFrame) -> DataFrame:
        """How far a plan's marginals are from the runs' weights, from two potentials of the runs in a row."""
        both = known.select("cid", "kid", "e").join(now, "cid").join(again.withColumnRenamed("f", "f2"), ["cid", "b"]).join(blocks.select("kid", "b", "w"), ["kid", "b"])
        off = F.udf(lambda f, f2, w, e: float(np.abs(np.frombuffer(w) * np.expm1((np.frombuffer(f) - np.frombuffer(f2)) / e)).sum()), "double")
        return both.select("cid", off("f", "f2", "w", "e").alias("off")).groupBy("cid").agg((F.sum("off") > tol).alias("open"))

    g = cut(own.join(known.select("cid"), "cid").select("cid", "b", zeros("w").alias("f")))
    settled, rounds = None, 0
    while rounds < most:
        for left in reversed(range(min(TESTED, most - rounds))):
            f = half(g, "i")
            f = f if left else cut(f)  # before the members' half, which would run all rounds again
            g = half(f, "j")
            rounds += 1
        g = cut(g)
        state = cut(moved(f, half(g, "i")))
        ended = state if rounds >= most else state.where("NOT open")
        rest = g.join(ended.select("cid", F.col("open").cast("int").alias("left")), "cid").join(f.select("cid", F.col("b").alias("i"), F.col("f").alias("fi")), "cid")

        def value(frames):
            for part in frames:
                for r in part.itertuples():
                    c = costs(_points(r.p, dims), _points(r.q, dims))
                    t = (np.frombuffer(r.fi)[:, None] + np.frombuffer(r.f)[None] - c) / r.e
                    yield pd.DataFrame({"cid": [r.cid], "w": [float((np.exp(t) * np.frombuffer(r.wp)[:, None] * np.frombuffer(r.wq)[None] * c).sum())], "left": [r.left]})

        worth = rest.withColumnRenamed("b", "j").join(pairs, ["cid", "i", "j"]).select("cid", "p", "q", "wp", "wq", "e", "f", "fi", "left").mapInPandas(value, "cid bigint, w double, left int")
        worth = cut(worth.groupBy("cid").agg(F.sum("w").alias("w"), F.max("left").alias("left")))
        settled = worth if settled is None else settled.unionByName(worth)
        g = cut(g.join(state.where("open").select("cid"), "cid"))
        if g.isEmpty():
            break
    return settled
