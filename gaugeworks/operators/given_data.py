"""Estimators on any table of runs: rank, PAWN, Borgonovo's delta, optimal transport (kernel independence is in ``kernels``).

Rows are ``(run_id, param, x)`` joined with an output, long; all params and slices are worked on in one
job. Rows that come from a ``Partition`` bring their places and classes; others are placed here, equal values of x in
order of their runs. Ranks come from ``ranked``, so that no window holds a whole param.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, kept
from .frames import class_of, ratio, undefined_if
from .order import classed, distances, quantile_products
from .partition import equal_width, in_order, matched


#: A bin's width in bandwidths at most, powers of the place in it, and bins of a grid's step up to which sums go by bins.
NARROW, POWERS, BINS = 0.5, 16, 64


def rank_index(rows: DataFrame, slices: Sequence[str] = ()) -> DataFrame:
    """``(param, *slices, s1)``: mean product of neighbours in order of x, the last with the first, over the variance.

    Rows are ``(run_id, param, x, y)``, or placed ones. They are sorted once: a range of the order is one task, of which the sum of
    its neighbours' products and its ends are left, and the ends of ranges in a row are the neighbours between them.
    """
    keys = ["param", *slices]
    stats = cut(rows.groupBy(*keys).agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"), (F.max("y") == F.min("y")).alias("flat"), F.count("*").alias("n")))
    order = ["rank"] if "rank" in rows.columns else ["x", "_tie"]
    tie = F.col("run_id") if "run_id" in rows.columns else F.xxhash64(*keys, "x", "y")
    placed = rows if "rank" in rows.columns else rows.withColumn("_tie", tie)
    moved = placed.join(F.broadcast(stats.select(*keys, "m")), keys).select(*keys, *order, (F.col("y") - F.col("m")).alias("d"))  # a row for each param and slice
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = moved.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).select(*keys, "d", F.spark_partition_id().alias("part"))
    shape = ", ".join([*[f"`{k}` {t}" for k, t in dealt.dtypes if k in keys], "part int, at int, first double, last double, products double"])

    def runs(frames):
        """A row for each group of a range's batch, in order."""
        at = 0
        for f in frames:
            if not len(f):
                continue
            change = np.zeros(len(f), bool)
            for k in keys:
                v = f[k].to_numpy()
                change[1:] |= (v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1]))
            starts, d = np.concatenate([[0], np.flatnonzero(change)]), f.d.to_numpy(float)
            ends = np.append(starts[1:], len(f))
            sums = np.concatenate([[0.0], (d[1:] * d[:-1]).cumsum()])
            heads = f.iloc[starts]
            inner = [float((d[i + 1 : j] * d[i : j - 1]).sum()) for i, j in zip(starts, ends)] if len(starts) < 64 else sums[ends - 1] - sums[starts]
            yield pd.DataFrame({**{k: heads[k].to_numpy() for k in keys}, "part": heads.part.to_numpy(), "at": np.arange(at, at + len(starts)), "first": d[starts], "last": d[ends - 1], "products": inner})
            at += len(starts)

    ranges = cut(dealt.mapInPandas(runs, shape))
    within = Window.partitionBy(*keys).orderBy("part", "at")
    following = F.coalesce(F.lead("first").over(within), F.first("first").over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sums = ranges.withColumn("f", following).groupBy(*keys).agg(F.sum(F.col("products") + F.col("last") * F.col("f")).alias("c"))
    return stats.join(sums, keys).select(*keys, undefined_if(F.col("flat"), ratio(F.col("c") / F.col("n"), F.col("v"))).alias("s1"))


def class_index(rows: DataFrame, classes: int, slices: Sequence[str] = ()) -> DataFrame:
    """``(param, *slices, s1)``: variance of class means over the variance, in equal-frequency classes of x; a constant output gives 0."""
    keys = ["param", *slices]
    placed = _classed(rows, keys, classes)
    per = cut(placed.groupBy(*keys, "class").agg(F.count("*").alias("c"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")))
    whole = per.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("s").alias("t"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("b"))
    mean2 = F.col("t") * F.col("t") / F.col("n")
    return whole.select(*keys, F.coalesce(F.try_divide(F.col("b") - mean2, F.col("q") - mean2), F.lit(0.0)).alias("s1"))


def _classed(rows: DataFrame, keys: Sequence[str], classes: int | None) -> DataFrame:
    """``(*keys, class, y)``: rows with the classes that they bring, or those of equal frequency in x."""
    if "class" in rows.columns:
        return rows.select(*keys, "class", "y")
    if "rank" not in rows.columns and "run_id" in rows.columns and (found := classed(rows, keys, "run_id", classes)) is not None:
        return found.select(*keys, "class", "y")
    return in_order(rows, keys).select(*keys, class_of("rank", "n", classes).alias("class"), "y")


def _counted(rows: DataFrame, keys: Sequence[str], groups: DataFrame, y: Column) -> DataFrame:
    """``(_g, class, y, c)``: how often each value occurs in each class of each of the numbered groups ``(*keys, _g, ...)``."""
    met = rows.join(F.broadcast(groups), list(keys))  # a row for each param and slice
    return kept(met.select("_g", F.col("class").cast("int").alias("class"), y.alias("y"), *[c for c in ("w",) if c in rows.columns]).groupBy("_g", "class", "y").agg((F.sum("w") if "w" in rows.columns else F.count("*")).cast("bigint").alias("c")))


def pawn(rows: DataFrame, bins: int = 10, statistic: str = "median", slices: Sequence[str] = ()) -> DataFrame:
    """``(param, *slices, pawn, n_bins)`` from rows ``(param, u, y)``, ``u`` the input's unit coordinate, or ``(param, class, y)``.

    Bins are equally wide in u, half open, the last one closed; rows outside [0, 1] count in the whole
    distribution only. A bin of fewer than two rows is left out. Distances are taken at a bin's own
    values from both sides, which is where their maximum lies. A constant output gives 0.
    """
    if statistic not in ("median", "max", "mean"):
        raise ValueError("statistic is median, max or mean")
    keys = ["param", *slices]
    bin_ = F.col("class") if "class" in rows.columns else equal_width(F.col("u"), bins)
    groups = kept(rows.select(*keys).distinct().withColumn("_g", F.monotonically_increasing_id()))
    values = _counted(rows.select(*keys, F.coalesce(bin_, F.lit(-1)).alias("class"), "y"), keys, groups, F.col("y"))
    sizes = values.groupBy("_g", "class").agg(F.sum("c").alias("n"))
    ks = distances(values).join(sizes, ["_g", "class"]).where("n >= 2").join(F.broadcast(groups), "_g")
    summary = {"median": F.percentile("ks", F.lit(0.5)), "max": F.max("ks"), "mean": F.avg("ks")}[statistic]
    return ks.groupBy(*keys).agg(summary.alias("pawn"), F.count("*").cast("int").alias("n_bins"))


def _running(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted values ``(*keys, y, c)`` with counts up to and below y and in total; ranges of y are summed first, so no window holds a whole key."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(values.repartitionByRange(parts, *keys, "y").withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_p").agg(F.sum("c").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"), F.sum("_s").over(Window.partitionBy(*keys)).alias("total"))
    run = F.sum("c").over(Window.partitionBy("_p", *keys).orderBy("y").rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_r", run).join(F.broadcast(base), [*keys, "_p"])  # partitions times keys
    return out.withColumns({"upto": F.col("_r") + F.col("_o"), "below": F.col("_r") + F.col("_o") - F.col("c")}).drop("_r", "_o", "_p")


def default_classes(n: int) -> int:
    """The number of classes for delta at ``n`` rows."""
    return max(1, int(min(math.ceil(n ** (2 / (7 + math.tanh((1500 - n) / 500)))), 48)))


def borgonovo(rows: DataFrame, classes: int, grid: int = 100, slices: Sequence[str] = (), narrow: float = 1e-2, bandwidth: float | None = None, least: float | str = "auto", bounds: DataFrame | None = None) -> DataFrame:
    """``(param, *slices, delta, s1)``: half the mean area between the output's density and its density in each class.

    Densities are Gaussian kernel sums on ``grid`` points from the least to the largest output, from powers of the rows'
    places in fine bins (``_by_moments``). Bandwidths are
    ``(0.75 n)^(-1/5)`` sample deviations, or ``bandwidth`` of them; a class narrower than ``narrow`` of the whole gets a floor, a tenth of
    the whole's and the grid's step at least, or ``least`` of the whole's. A constant output gives 0. ``bounds``, with some of the
    keys, ``lo`` and ``hi``, sets the grids' ends: those of replicates are the ends of what they are drawn from.
    """
    if (bandwidth is not None and bandwidth <= 0) or (least != "auto" and not (isinstance(least, (int, float)) and least > 0)):
        raise ValueError("bandwidths are above zero")
    keys = ["param", *slices]
    placed = kept(_classed(rows, keys, classes))
    factor = (lambda: F.pow(0.75 * F.count("*"), F.lit(-0.2))) if bandwidth is None else (lambda: F.lit(float(bandwidth)))
    width = lambda: factor() * F.coalesce(F.stddev_samp("y"), F.lit(0.0))
    whole = cut(placed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("m"), F.var_pop("y").alias("v"), width().alias("h")))
    if bounds is not None:
        on = [k for k in keys if k in bounds.columns]
        rest = whole.drop("lo", "hi")
        whole = cut(rest.join(bounds, on) if on else rest.crossJoin(F.broadcast(bounds)))  # one row without keys
    per = placed.groupBy(*keys, "class").agg(F.count("*").alias("c"), F.avg("y").alias("cm"), width().alias("ch"))
    step = (F.col("hi") - F.col("lo")) / (grid - 1)
    floor = F.when(F.col("ch") < narrow * F.col("h"), F.greatest(0.1 * F.col("h"), step) if least == "auto" else least * F.col("h")).otherwise(F.col("ch"))
    per = cut(per.join(F.broadcast(whole), keys).withColumn("ch", floor))
    cell, types = [*keys, "class"], dict(placed.dtypes)
    # Bins of a step's fraction, narrow beside every bandwidth, so that a few powers of the place in a bin give the kernel sums.
    least_h = F.least(F.min("ch"), F.first("h"))
    fine = cut(per.groupBy(*keys).agg(F.ceil(F.first(step) / (NARROW * least_h)).cast("double").alias("bins")).join(whole.select(*keys, "h", "lo", "hi"), keys).where("hi > lo"))
    if fine.where(f"bins IS NULL OR bins < 1 OR bins > {BINS}").isEmpty():
        sums = cut(_by_moments(placed, per, fine, cell, grid))
    else:
        sums = cut(_by_rows(placed, per, cell, types, grid))
    density = sums.groupBy(*keys, "g").agg(F.sum("part").alias("all"))
    rows_ = sums.join(density, [*keys, "g"]).join(per, [*keys, "class"])
    root = math.sqrt(2 * math.pi)
    gap = F.abs(F.col("all") / (F.col("n") * F.col("h") * root) - F.col("own") / (F.col("c") * F.col("ch") * root))
    end = F.when(F.col("g").isin(0, grid - 1), 0.5).otherwise(1.0)
    delta = rows_.groupBy(*keys).agg(F.sum(F.col("c") / (2 * F.col("n")) * gap * end * step).alias("delta"))
    s1 = per.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("c") / F.col("n") * F.pow(F.col("cm") - F.col("m"), F.lit(2.0))), F.first("v")), F.lit(0.0)).alias("s1"))
    return s1.join(delta, keys, "left").select(*keys, F.coalesce("delta", F.lit(0.0)).alias("delta"), "s1")


def _by_moments(placed: DataFrame, per: DataFrame, fine: DataFrame, cell: Sequence[str], grid: int) -> DataFrame:
    """``(*cell, g, own, part)``: kernel sums on the grid from powers of the outputs' places in bins.

    A Gaussian at a distance a + e is its Hermite series in e; e is at most ``NARROW`` / 2 bandwidths, where ``POWERS`` terms
    leave less than a double's last digit. Bins know no bandwidth, so that the same powers serve the class's and the whole's.
    """
    keys, types = cell[:-1], dict(placed.dtypes)
    wide = (F.col("hi") - F.col("lo")) / (grid - 1) / F.col("bins")
    met = placed.join(F.broadcast(fine.select(*keys, "lo", wide.alias("wide"))), keys).where("y IS NOT NULL")
    at = (F.col("y") - F.col("lo")) / F.col("wide")
    met = met.select(*cell, F.round(at).cast("bigint").alias("bin"), (at - F.round(at)).alias("t"))
    power, powers = F.lit(1.0), []
    for _ in range(POWERS):
        powers.append(power)
        power = power * F.col("t")
    moments = met.groupBy(*cell, "bin").agg(*[F.sum(e).alias(f"m{p}") for p, e in enumerate(powers)])
    rows = moments.join(F.broadcast(per.select(*cell, "ch", "h", "lo", "hi")), cell).join(F.broadcast(fine.select(*keys, "bins")), keys)

    def sums(f: pd.DataFrame) -> pd.DataFrame:
        lo, hi, k = (float(f[c].iloc[0]) for c in ("lo", "hi", "bins"))
        w = (hi - lo) / (grid - 1) / k
        m = f[[f"m{p}" for p in range(POWERS)]].to_numpy()
        out = {}
        for name, h in (("own", float(f.ch.iloc[0])), ("part", float(f.h.iloc[0]))):
            a = (np.arange(grid)[:, None] * k - f.bin.to_numpy()[None]) * (w / h)
            before, now, total, scale = np.zeros_like(a), np.ones_like(a), np.zeros_like(a), 1.0
            for p in range(POWERS):  # Hermite polynomials by their recurrence
                total += now * (m[:, p] * scale)
                before, now, scale = now, a * now - p * before, scale * (w / h) / (p + 1)
            out[name] = (total * np.exp(-0.5 * a * a)).sum(1)
        return pd.DataFrame({**{c: [f[c].iloc[0]] * grid for c in cell}, "g": np.arange(grid), **out})

    return rows.groupBy(*cell).applyInPandas(sums, ", ".join([*[f"`{c}` {types[c]}" for c in cell], "g int, own double, part double"]))


def _by_rows(placed: DataFrame, per: DataFrame, cell: Sequence[str], types: dict[str, str], grid: int) -> DataFrame:
    """``(*cell, g, own, part)``: kernel sums on the grid, a batch of rows at a time, for bandwidths that are tiny beside the range."""
    points = placed.join(F.broadcast(per.select(*cell, "ch", "h", "lo", "hi")), cell).where("hi > lo")

    def bumps(frames):
        """Kernel sums over a batch's rows on the grid, a row for each class and point."""
        for f in frames:
            for k, part in f.groupby(cell) if len(f) else ():
                h, ch, lo, hi = (part[c].iloc[0] for c in ("h", "ch", "lo", "hi"))
                z = np.linspace(lo, hi, grid)[:, None] - part.y.to_numpy()[None]
                yield pd.DataFrame({**dict(zip(cell, k)), "g": np.arange(grid), "own": np.exp(-0.5 * (z / ch) ** 2).sum(1), "part": np.exp(-0.5 * (z / h) ** 2).sum(1)})

    shape = ", ".join([*[f"`{c}` {types[c]}" for c in cell], "g int, own double, part double"])
    return points.mapInPandas(bumps, shape).groupBy(*cell, "g").agg(F.sum("own").alias("own"), F.sum("part").alias("part"))


def discrete_output(rows: DataFrame, slices: Sequence[str] = (), most: int = 20, each: int = 5) -> DataFrame:
    """Slices whose output has ``most`` distinct values or fewer, each at least ``each`` times: no density can be estimated there."""
    per = rows.groupBy(*slices, "y").agg(F.count("*").alias("c")).groupBy(*slices).agg(F.count("*").alias("values"), F.min("c").alias("least"))
    return per.where((F.col("values") > 1) & (F.col("values") <= most) & (F.col("least") >= each))


def transport_classes(n: int) -> int:
    """The number of classes for transport at ``n`` rows."""
    return max(1, min(25, n // 2))


def transport(rows: DataFrame, classes: int | None = None, slices: Sequence[str] = (), member: str | None = None) -> DataFrame:
    """``(param, *slices, ot, advective, diffusive, s1)``: mean squared transport cost from the output to its classes over twice its variance.

    One-dimensional transport couples quantiles: member k of c meets the full sample's ranks from k n / c to
    (k + 1) n / c. Of these only the sum counts. Equal outputs of a class are counted first, and both quantile functions
    are met by ranges of probability (``quantile_products``). Rows may have ``w``, how often they count. ``member`` names a column with each row's class, for categories or
    random ones; without it, classes are of equal frequency in x.
    """
    keys = ["param", *slices]
    if weighted := "w" in rows.columns:
        n = F.sum("w")
        stats = rows.groupBy(*keys).agg((F.sum(F.col("w") * F.col("y")) / n).alias("m"), (F.max("y") == F.min("y")).alias("flat"), n.alias("n"))
    else:
        stats = rows.groupBy(*keys).agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"), F.count("*").alias("n"))
    stats = kept(stats.withColumn("_g", F.monotonically_increasing_id()))
    rows = rows.withColumn("class", F.col(member)) if member else rows
    if "class" not in rows.columns:
        classes = classes or transport_classes(stats.agg(F.min("n")).first()[0] or 1)
    values = _counted(rows.select(*keys, "class", "y", "w") if weighted else _classed(rows, keys, classes), keys, stats.select(*keys, "_g", "m"), F.col("y") - F.col("m"))
    y, c = F.col("y"), F.col("c")
    per = values.groupBy("_g", "class").agg(F.sum(c).alias("c"), (F.sum(c * y) / F.sum(c)).alias("cm"), (F.sum(c * y * y) / F.sum(c)).alias("cq"))
    whole = values.groupBy("_g").agg((F.sum(c * y * y) / F.sum(c)).alias("q"))
    whole = whole.join(stats, "_g")
    if weighted:
        whole = whole.withColumn("v", F.when(F.col("flat"), 0.0).otherwise(F.col("q") * F.col("n") / (F.col("n") - 1)))
    per = per.join(quantile_products(values), ["_g", "class"], "left").join(F.broadcast(whole), "_g")
    w2 = F.greatest(F.col("q") + F.col("cq") - 2 * F.coalesce("cross", F.lit(0.0)) / F.col("n"), F.lit(0.0))
    adv = F.col("cm") * F.col("cm")
    share = F.col("c") / F.col("n")
    sums = per.groupBy(*keys).agg(F.sum(share * w2).alias("w"), F.sum(share * adv).alias("a"), F.sum(share * F.greatest(w2 - adv, F.lit(0.0))).alias("d"), F.first("v").alias("v"), F.first("n").alias("n"))
    over = lambda c: F.when(F.coalesce("v", F.lit(0.0)) <= 0, 0.0).otherwise(ratio(F.col(c), 2 * F.col("v")))
    return sums.select(*keys, over("w").alias("ot"), over("a").alias("advective"), over("d").alias("diffusive"), (2 * F.col("n") / (F.col("n") - 1) * over("a")).alias("s1"))


def dummy_transport(rows: DataFrame, classes: int | None = None, slices: Sequence[str] = (), seed: int = 0, draw=None, key: str = "run_id") -> DataFrame:
    """``(*slices, ot_dummy)``: the index of an input that has nothing to do with the output, by classes of a random order of the rows.

    ``rows`` are of one input, ``(run_id, y)``; what an index has above this floor, ``above_dummy``, isn't noise of the estimate.
    """
    from .resampling import hashed

    noise = (draw or hashed)(F.lit(0), F.col(key), seed)
    one = rows.select(F.lit("dummy").alias("param"), F.col(key).alias("run_id"), *slices, noise.cast("double").alias("x"), "y")
    return transport(one, classes, slices).select(*slices, F.col("ot").alias("ot_dummy"))


def matched_dummies(rows: DataFrame, sizes: dict[str, Sequence[int]], slices: Sequence[str] = (), seed: int = 0, draw=None) -> DataFrame:
    """``(param, *slices, ot_dummy)``: for each name a floor of random classes with its sizes, as of a categorical input's levels.

    The noise of an index grows with the number of classes and falls with their sizes, so that a floor has to match both. ``rows`` are
    ``(run_id, *slices, y)``; one random order of the runs serves all names and slices.
    """
    from .resampling import hashed

    table = matched(rows.select("run_id").distinct(), sizes, (draw or hashed)(F.lit(0), F.col("run_id"), seed))
    return transport(rows.join(table, "run_id"), None, slices).select("param", *slices, F.col("ot").alias("ot_dummy"))
