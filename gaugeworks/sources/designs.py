"""Sampling designs as lazy tables: every row follows from its number, so partitions need nothing from each other."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import ranked

# Primitive polynomials and initial direction numbers of Sobol' points (Joe and Kuo), for
# dimensions 2 to 21: coefficients of the polynomial as an integer, then the first odd numbers.
DIRECTIONS = [
    (0, [1]), (1, [1, 3]), (1, [1, 3, 1]), (2, [1, 1, 1]), (1, [1, 1, 3, 3]), (4, [1, 3, 5, 13]), (2, [1, 1, 5, 5, 17]),
    (4, [1, 1, 5, 5, 5]), (7, [1, 1, 7, 11, 19]), (11, [1, 1, 5, 1, 1]), (13, [1, 1, 1, 3, 11]), (14, [1, 3, 5, 5, 31]),
    (1, [1, 3, 3, 9, 7, 49]), (13, [1, 1, 1, 15, 21, 21]), (16, [1, 3, 1, 13, 27, 49]), (19, [1, 1, 1, 15, 7, 5]),
    (22, [1, 3, 1, 15, 13, 25]), (25, [1, 1, 5, 5, 19, 61]), (1, [1, 3, 7, 11, 23, 15, 103]), (4, [1, 3, 7, 13, 13, 15, 69]),
]
BITS = 32
#: Dimensions whose points are expressions; more are computed in Arrow batches, where expressions would be too long.
UNROLLED = 32


def _irreducible(degree: int) -> Iterator[int]:
    """Primitive polynomials over two elements of a degree, as integers with all their coefficients, in rising order."""
    order = (1 << degree) - 1
    factors = [p for p in range(2, order + 1) if order % p == 0 and all(p % q for q in range(2, math.isqrt(p) + 1))]

    def power(x: int, n: int, poly: int) -> int:
        out = 1
        while n:
            if n & 1:
                out = _times(out, x, poly, degree)
            x, n = _times(x, x, poly, degree), n >> 1
        return out

    for low in range(1, 1 << degree, 2):
        poly = (1 << degree) | low
        if power(2, order, poly) == 1 and all(power(2, order // f, poly) != 1 for f in factors):
            yield poly


def _times(a: int, b: int, poly: int, degree: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
        if a >> degree & 1:
            a ^= poly
    return out


@functools.cache
def _further(count: int) -> list[tuple[int, list[int]]]:
    """Polynomials and first odd numbers for dimensions beyond the table, by rule: the next primitive polynomials, numbers from a fixed draw."""
    known, out = {(len(m), a) for a, m in DIRECTIONS}, []
    rng = np.random.default_rng(20240)
    for degree in itertools.count(1):
        for poly in _irreducible(degree) if degree > 1 else [3]:
            inner = (poly >> 1) & ((1 << (degree - 1)) - 1)
            if (degree, inner) not in known:
                out.append((inner, [int(2 * rng.integers(1 << k) + 1) for k in range(degree)]))
                if len(out) >= count:
                    return out
    return out


def direction_numbers(dim: int) -> list[int]:
    """The ``BITS`` direction numbers of a dimension from 0, as integers below ``2**BITS``."""
    if dim == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    a, m = DIRECTIONS[dim - 1] if dim <= len(DIRECTIONS) else _further(64 * (dim // 64 + 1))[dim - 1 - len(DIRECTIONS)]
    s, v = len(m), [x << (BITS - 1 - k) for k, x in enumerate(m)]
    for k in range(s, BITS):
        x = v[k - s] ^ (v[k - s] >> s)
        for j in range(1, s):
            if (a >> (s - 1 - j)) & 1:
                x ^= v[k - j]
        v.append(x)
    return v


def _seeded(seed: int, *parts: int) -> int:
    return int(np.random.default_rng([seed, *parts]).integers(1 << BITS))


def scrambled_numbers(dim: int, seed: int) -> list[int]:
    """Direction numbers after a random lower triangular matrix with a unit diagonal over two elements, which keeps the points' net."""
    rng = np.random.default_rng([seed, dim, 1])
    masks = [int(rng.integers(1 << BITS)) & ~((1 << (BITS - r)) - 1) | (1 << (BITS - 1 - r)) for r in range(BITS)]  # row r reads the bits above its own
    return [sum((((v & m).bit_count() & 1) << (BITS - 1 - r)) for r, m in enumerate(masks)) for v in direction_numbers(dim)]


def sobol_column(i: Column, dim: int, seed: int | None = None, bits: int = BITS) -> Column:
    """The ``dim``-th coordinate of point ``i`` (below ``2**bits``) in Gray-code order; with a seed, scrambled by a matrix and a shift."""
    gray = i.bitwiseXOR(F.shiftright(i, 1))
    x = F.lit(0 if seed is None else _seeded(seed, dim)).cast("bigint")
    numbers = direction_numbers(dim) if seed is None else scrambled_numbers(dim, seed)
    for k, v in enumerate(numbers[:bits]):
        x = x.bitwiseXOR(F.shiftright(gray, k).bitwiseAND(F.lit(1)) * F.lit(v))
    return x / F.lit(float(1 << BITS)) + F.lit(0.0 if seed is None else 0.5 / (1 << BITS))


def sobol_points(spark: SparkSession, n: int, names: Sequence[str], seed: int | None = None, prefix: str = "u_") -> DataFrame:
    """``(base_id, u_<name>...)``: the first ``n`` Sobol' points in any number of dimensions."""
    bits, i = max(1, (n - 1).bit_length()), F.col("id")
    if len(names) <= UNROLLED:
        return spark.range(n).select(i.alias("base_id"), *[sobol_column(i, d, seed, bits).alias(prefix + c) for d, c in enumerate(names)])
    numbers = np.array([(direction_numbers(d) if seed is None else scrambled_numbers(d, seed))[:bits] for d in range(len(names))], np.uint64).T
    start = np.array([0 if seed is None else _seeded(seed, d) for d in range(len(names))], np.uint64)
    half = 0.0 if seed is None else 0.5 / (1 << BITS)

    def points(frames):
        for f in frames:
            g = f.id.to_numpy(np.uint64)
            g, x = g ^ (g >> np.uint64(1)), np.repeat(start[None], len(f), 0)
            for k in range(bits):
                x ^= ((g >> np.uint64(k)) & np.uint64(1))[:, None] * numbers[k][None]
            yield pd.DataFrame(x / float(1 << BITS) + half, columns=[prefix + c for c in names]).assign(base_id=f.id.to_numpy())[["base_id", *[prefix + c for c in names]]]

    return spark.range(n).mapInPandas(points, ", ".join(["base_id bigint", *[f"`{prefix}{c}` double" for c in names]]))


def portable_unit(d: int, i: Column, seed: int) -> Column:
    """A number from 0 to 1 for an input and a row by whole numbers that other engines can repeat."""
    from ..operators.resampling import MODULUS, portable

    return (portable(F.lit(d), i, seed) + F.lit(0.5)) / F.lit(float(MODULUS))


def monte_carlo(spark: SparkSession, n: int, names: Sequence[str], seed: int, prefix: str = "u_", portable: bool = False) -> DataFrame:
    """``(run_id, u_<name>...)``: uniforms from a hash of seed, input and row, the same on any partitioning."""
    draw = lambda d: portable_unit(d, F.col("id"), seed) if portable else (F.pmod(F.xxhash64(F.lit(seed), F.lit(d), "id"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return spark.range(n).select(F.col("id").alias("run_id"), *[draw(d).alias(prefix + c) for d, c in enumerate(names)])


def correlated(units: DataFrame, names: Sequence[str], r: np.ndarray, prefix: str = "u_") -> DataFrame:
    """Unit-cube columns with a Gaussian copula of latent correlation ``r``: normal scores mixed by a Cholesky factor, all in Columns."""
    from ..functions.special import normal_cdf, normal_ppf

    low = np.linalg.cholesky(r)
    z = [normal_ppf(F.col(prefix + c)) for c in names]
    mixed = [normal_cdf(sum((float(low[i, j]) * z[j] for j in range(1, i + 1)), float(low[i, 0]) * z[0])).alias(prefix + c) for i, c in enumerate(names)]
    return units.select(*[c for c in units.columns if c not in {prefix + n for n in names}], *mixed)


def saltelli(base: DataFrame, names: Sequence[str], second: bool = True, key: str = "base_id") -> tuple[DataFrame, DataFrame]:
    """Runs ``(run_id, <names>)`` and layout ``(base_id, block, param, run_id)`` from base rows with ``a_<name>`` and ``b_<name>``.

    Blocks A, AB_1 .. AB_D, BA_1 .. BA_D (with ``second``) and B; a run's number follows from base and block.
    """
    d = len(names)
    blocks = [("A", None)] + [("AB", j) for j in range(d)] + ([("BA", j) for j in range(d)] if second else []) + [("B", None)]
    from_b = lambda kind, j, i: kind == "B" or (kind == "AB" and i == j) or (kind == "BA" and i != j)
    rows = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(kind).alias("block"), F.lit(None if j is None else names[j]).cast("string").alias("param"), *[F.col(("b_" if from_b(kind, j, i) else "a_") + c).alias(c) for i, c in enumerate(names)])
        for k, (kind, j) in enumerate(blocks)
    ])
    each = base.select(key, F.explode(rows).alias("r")).select(key, (F.col(key) * len(blocks) + F.col("r.k")).alias("run_id"), "r.block", "r.param", *[F.col(f"r.{c}") for c in names])
    return each.select("run_id", *names), each.select(F.col(key).alias("base_id"), "block", "param", "run_id")


def saltelli_units(spark: SparkSession, base_n: int, names: Sequence[str], seed: int | None = None) -> DataFrame:
    """``(base_id, a_<name>, b_<name>)`` from Sobol' points in twice the dimensions; ``base_n`` is a power of two."""
    if base_n < 1 or base_n & (base_n - 1):
        raise ValueError("base_n must be a power of two")
    return sobol_points(spark, base_n, ["a_" + c for c in names] + ["b_" + c for c in names], seed, prefix="")


def base_points(d: int, n_samples: int, second: bool = True) -> int:
    """The largest power of two of base points whose runs fit in a budget of ``n_samples``."""
    per = 2 * d + 2 if second else d + 2
    if n_samples < per:
        raise ValueError(f"a budget of {n_samples} runs is below the {per} of one base point")
    return 1 << ((n_samples // per).bit_length() - 1)


def sobol_design(spark: SparkSession, problem, base_n: int | None = None, n_samples: int | None = None, second: bool = True, seed: int | None = None, distinct: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(runs, layout, units)`` of a pick-freeze design: inputs of each distinct run, the layout that says which run each place of the design uses, and base points on the unit cube.

    Exactly one of ``base_n`` (a power of two) and ``n_samples`` (a budget of runs) is given. Categorical inputs
    repeat rows; with ``distinct``, base points are doubled until there are so many distinct runs.
    """
    if (base_n is None) == (n_samples is None):
        raise ValueError("give either base_n or n_samples")
    names = problem.names
    n = base_n if base_n is not None else base_points(len(names), n_samples, second)
    while True:
        units = saltelli_units(spark, n, names, seed)
        values = units.select("base_id", *[m.ppf(F.col(s + c)).alias(s + c) for s in ("a_", "b_") for c, m in problem.inputs.items()])
        placed, layout = saltelli(values, names, second)
        runs, of = distinct_runs(placed, names, "run_id", "unique_id")
        if distinct is None or n >= 1 << 24 or runs.count() >= distinct:
            return runs.withColumnRenamed("unique_id", "run_id"), layout.join(of, "run_id").drop("run_id").withColumnRenamed("unique_id", "run_id"), units
        n *= 2


def retransformed(units: DataFrame, problem, second: bool = True) -> DataFrame:
    """Inputs of every place of a pick-freeze design under other distributions, from the same base points."""
    values = units.select("base_id", *[m.ppf(F.col(s + c)).alias(s + c) for s in ("a_", "b_") for c, m in problem.inputs.items()])
    return saltelli(values, problem.names, second)[0]


def morris_steps(layout: DataFrame, units: DataFrame, names: Sequence[str]) -> DataFrame:
    """Steps ``(traj_id, param, before, after, delta)`` of a pick-freeze design's blocks A and AB: each base point is a star.

    ``delta`` is a step on the unit cube; steps of length zero are left out.
    """
    a = layout.where("block = 'A'").select("base_id", F.col("run_id").alias("before"))
    ab = layout.where("block = 'AB'").select("base_id", "param", F.col("run_id").alias("after"))
    sizes = F.create_map(*[x for c in names for x in (F.lit(c), F.col("b_" + c) - F.col("a_" + c))])
    steps = ab.join(a, "base_id").join(units.select("base_id", sizes.alias("sizes")), "base_id")
    return steps.select(F.col("base_id").alias("traj_id"), "param", "before", "after", F.element_at("sizes", F.col("param")).alias("delta")).where("delta <> 0")


def efast_plan(d: int, n: int, harmonics: int = 4) -> tuple[int, list[list[int]]]:
    """The main frequency, and for each curve the frequency of each input."""
    if n < 4 * harmonics**2 * max(d - 1, 1) + 1:
        raise ValueError("too few runs for each curve")
    main = (n - 1) // (2 * harmonics)
    top = max(1, main // (2 * harmonics))
    others = [int(x) for x in (np.floor(np.linspace(1, top, d - 1)) if top >= d - 1 else np.arange(d - 1) % top + 1)]
    return main, [[main if j == i else others[j - (j > i)] for j in range(d)] for i in range(d)]


def efast_design(spark: SparkSession, names: Sequence[str], n: int, harmonics: int = 4, phases: Sequence[Sequence[float]] | None = None, prefix: str = "u_") -> tuple[DataFrame, int]:
    """``(param, t, n, u_<name>...)`` search curves and the main frequency; a phase for each curve and input, zero without."""
    main, freq = efast_plan(len(names), n, harmonics)
    curve, t = (F.col("id") / n).cast("int"), F.col("id") % n
    pick = lambda table: F.element_at(F.array(*map(F.lit, table)), curve + 1)
    angle = lambda j: pick([float(f[j]) for f in freq]) * (2 * math.pi * t / n) + pick([float(p[j]) for p in phases] if phases else [0.0] * len(names))
    rows = spark.range(n * len(names))
    return rows.select(pick(list(names)).alias("param"), t.alias("t"), F.lit(n).cast("bigint").alias("n"), *[(0.5 + F.asin(F.sin(angle(j))) / math.pi).alias(prefix + c) for j, c in enumerate(names)]), main


def morris_trajectories(spark: SparkSession, names: Sequence[str], count: int, levels: int = 4, seed: int = 0, prefix: str = "u_") -> tuple[DataFrame, DataFrame]:
    """Runs ``(run_id, u_<name>)`` and steps ``(traj_id, param, before, after, delta)`` of walks on the level grid.

    A walk starts on a random level, moves each input once by ``levels / (2 (levels - 1))`` in a random order; all
    of it is a hash of seed, walk and input.
    """
    d, delta = len(names), levels / (2 * (levels - 1))
    h = lambda what, j: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.lit(j), "id"), F.lit(1 << 40))
    order = F.array_sort(F.array(*[F.struct(h("order", j).alias("h"), F.lit(j).alias("j")) for j in range(d)]))
    walk = spark.range(count).select(F.col("id"), F.transform(order, lambda x: x.j).alias("order"), *[(h("start", j) % (levels // 2) / (levels - 1)).alias(f"s{j}") for j in range(d)], *[(h("sign", j) % 2).alias(f"g{j}") for j in range(d)])
    step = walk.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step"))
    moved = [F.array_position("order", F.lit(j)) <= F.col("step") for j in range(d)]
    value = [F.when(moved[j] == (F.col(f"g{j}") == 0), F.col(f"s{j}") + delta).otherwise(F.col(f"s{j}")) for j in range(d)]
    run = F.col("id") * (d + 1) + F.col("step")
    runs = step.select(run.alias("run_id"), *[v.alias(prefix + c) for v, c in zip(value, names)])
    which = F.element_at("order", F.col("step"))
    pick = lambda xs: F.element_at(F.array(*xs), which + 1)
    signed = F.when(pick([F.col(f"g{j}") for j in range(d)]) == 0, delta).otherwise(-delta)
    steps = step.where("step > 0").select(F.col("id").alias("traj_id"), pick([F.lit(c) for c in names]).alias("param"), (run - 1).alias("before"), run.alias("after"), signed.alias("delta"))
    return runs, steps


#: How far the second point of a radial pair is ahead of the first in the sequence.
AHEAD = 4


def morris_radial(spark: SparkSession, names: Sequence[str], count: int, seed: int = 0, prefix: str = "u_", least: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """Runs and steps of stars: a Sobol' point, and for each input the point with that coordinate from a point further on.

    Both come from one sequence in twice the dimensions, joined on its numbers. A step shorter than ``least`` raises
    when it is computed.
    """
    both = sobol_points(spark, count + AHEAD, [f"a{j}" for j in range(len(names))] + [f"b{j}" for j in range(len(names))], seed, prefix="")
    a = both.where(F.col("base_id") < count).select("base_id", *[f"a{j}" for j in range(len(names))])
    b = both.where(F.col("base_id") >= AHEAD).select((F.col("base_id") - AHEAD).alias("base_id"), *[f"b{j}" for j in range(len(names))])
    each = a.join(b, "base_id").select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names)))).alias("k"))
    first = F.col("base_id") * (len(names) + 1)
    runs = each.select((first + F.col("k")).alias("run_id"), *[F.when(F.col("k") == j + 1, F.col(f"b{j}")).otherwise(F.col(f"a{j}")).alias(prefix + c) for j, c in enumerate(names)])
    delta = F.element_at(F.array(*[F.col(f"b{j}") - F.col(f"a{j}") for j in range(len(names))]), F.col("k"))
    delta = F.when(F.abs(delta) >= least, delta).otherwise(F.raise_error(F.lit("a step is too short; take another seed")).cast("double"))
    steps = each.where("k > 0").select(F.col("base_id").alias("traj_id"), F.element_at(F.array(*map(F.lit, names)), F.col("k")).alias("param"), first.alias("before"), (first + F.col("k")).alias("after"), delta.alias("delta"))
    return runs, steps


def morris_design(spark: SparkSession, problem, count: int, method: str = "trajectory", levels: int = 4, seed: int = 0, truncation: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Runs ``(run_id, <names>)`` and steps for a problem; open Gaussian sides are closed at ``truncation``, where a level would be infinite."""
    if method not in ("trajectory", "radial"):
        raise ValueError("method is trajectory or radial")
    if count < 1 or levels < 2 or levels % 2:
        raise ValueError("a design needs a walk, and an even number of levels")
    names = problem.names
    runs, steps = morris_trajectories(spark, names, count, levels, seed) if method == "trajectory" else morris_radial(spark, names, count, seed)
    return problem.truncated(truncation).transform(runs), steps


def downsample(layout: DataFrame, base_n: int, outputs: DataFrame | None = None, unit: str = "base_id") -> tuple[DataFrame, DataFrame | None]:
    """The layout of the first ``base_n`` base points (or steps of so many walks, ``unit`` traj_id), and the outputs of the runs that it uses."""
    kept = layout.where(F.col(unit) < base_n)
    if outputs is None:
        return kept, None
    ids = [c for c in ("run_id", "before", "after") if c in kept.columns]
    used = kept.select(F.explode(F.array(*ids)).alias("run_id")).distinct()
    return kept, outputs.join(used, "run_id", "left_semi")


def distinct_runs(rows: DataFrame, names: Sequence[str], position: str, key: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """Distinct input rows with ids ``key`` in order of first occurrence, and each position's id."""
    firsts = rows.groupBy(*names).agg(F.min(position).alias("first"))
    ids = ranked(firsts.withColumn("_all", F.lit(0)), ["_all"], ["first", *names], key, "_n").drop("_all", "_n")
    same = None
    for c in names:
        same = rows[c].eqNullSafe(ids[c]) if same is None else same & rows[c].eqNullSafe(ids[c])
    return ids.select(key, *names), rows.join(ids, same).select(rows[position], ids[key])


def aligned(runs: DataFrame, outputs: DataFrame, key: str = "run_id") -> DataFrame:
    """Inputs joined with outputs by run; a repeated or missing run raises."""
    for side, name in ((runs, "inputs"), (outputs, "outputs")):
        if not side.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{name} repeat a run")
    if not runs.join(outputs, key, "left_anti").isEmpty():
        raise ValueError("runs without an output")
    return runs.join(outputs, key)


def spearman(rows: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Rank correlations of columns over rows without a null, ties by their mean rank.

    Ranks come from counts by value, never from a window over a whole column; each row looks its ranks up.
    """
    from ..operators.given_data import _running

    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    long = rows.unpivot([], list(names), "param", "x")
    counted = long.groupBy("param", F.col("x").alias("y")).agg(F.count("*").alias("c"))
    mid = _running(counted, ["param"]).select("param", "y", ((F.col("upto") + F.col("below") + 1) / 2).alias("r"))
    joined = rows
    for c in names:
        one = mid.where(F.col("param") == c).select(F.col("y").alias(c), F.col("r").alias("_r_" + c))
        joined = joined.join(one, c)
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    got = joined.agg(*[F.corr("_r_" + names[i], "_r_" + names[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    out = np.eye(len(names))
    for i, j in pairs:
        value = got[f"{i}_{j}"]
        out[i, j] = out[j, i] = math.nan if value is None else value
    return out


def fit_correlation(rows: DataFrame, names: Sequence[str]) -> np.ndarray:
    """The latent normal correlation of a Gaussian copula behind columns: their rank correlations turned, and repaired."""
    from ..problem import repaired, spearman_to_latent

    return repaired(spearman_to_latent(spearman(rows, names)))


def iman_conover(rows: DataFrame, names: Sequence[str], r: np.ndarray, seed: int, key: str = "run_id", portable: bool = False) -> DataFrame:
    """Columns put in new orders so that their rank correlations follow ``r``; each column keeps its values.

    Normal scores with the wanted correlation are drawn for every row; each column's value of rank k goes to the
    row whose score has rank k, by an equal join on rank.
    """
    low = np.linalg.cholesky(r)
    from ..functions.special import normal_ppf

    hashed = lambda d: (F.pmod(F.xxhash64(F.lit(seed), F.lit(d), F.col(key)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    z = [normal_ppf(portable_unit(d, F.col(key), seed) if portable else hashed(d)) for d in range(len(names))]
    score = [sum((float(low[i, j]) * z[j] for j in range(1, i + 1)), float(low[i, 0]) * z[0]) for i in range(len(names))]
    scores = rows.select(key, *[s.alias(c) for s, c in zip(score, names)]).unpivot([key], list(names), "param", "s")
    values = rows.select(key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([key], list(names), "param", "x")
    placed = ranked(scores, ["param"], ["s", key]).select("param", "rank", key)
    sorted_ = ranked(values, ["param"], ["x", key]).select("param", "rank", "x")
    return placed.join(sorted_, ["param", "rank"]).groupBy(key).pivot("param", list(names)).agg(F.first("x"))
