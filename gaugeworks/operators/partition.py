"""The partition of runs by each input: ranks and conditioning classes, built once and shared.

A class table has a row for each run and input. It knows nothing of outputs, so that one table serves every output slice, every
estimator and, through weights, every replicate. Continuous inputs have ranks by value, equal values in order of
their runs, and classes of equal frequency; categorical ones have a class for each level.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, kept
from ..problem import Categorical, Problem
from .frames import class_of, long_inputs, ranked
from .order import classed

#: Ranks that one window sums over, and counts of ranks in replicates that one task holds.
BLOCK, COUNTS = 1 << 16, 1 << 18


def in_order(rows: DataFrame, keys: Sequence[str], key: str = "run_id", keep: Sequence[str] = ("y",)) -> DataFrame:
    """``(*keys, rank, n, *keep)``: rows placed by x within ``keys``, equal values in order of their runs.

    Rows that have places stay as they are. Where there is no ``key``, equal values go in order of a hash of the row, which
    has nothing to do with the output's order.
    """
    if "rank" in rows.columns:
        return rows.select(*keys, "rank", "n", *keep)
    tie = F.col(key) if key in rows.columns else F.xxhash64(*keys, "x", *keep)
    return ranked(rows.select(*keys, "x", tie.alias("_tie"), *[c for c in keep if c != "x"]), keys, ["x", "_tie"]).select(*keys, "rank", "n", *keep)


def level_counts(problem: Problem, inputs: DataFrame, method: str = "") -> dict[str, list[int]]:
    """Runs at each level of each categorical input; values that are no level code raise, levels without runs are warned of."""
    levels = {n: len(m.probs) for n, m in problem.inputs.items() if isinstance(m, Categorical)}
    if not levels:
        return {}
    code = lambda n, size: F.coalesce((F.col(n) == F.floor(n)) & (F.col(n) >= 0) & (F.col(n) < size), F.lit(False))
    counts = [F.count_if(~code(n, s)).alias(f"bad_{i}") for i, (n, s) in enumerate(levels.items())]
    counts += [F.count_if(F.col(n) == k).alias(f"n_{i}_{k}") for i, (n, s) in enumerate(levels.items()) for k in range(s)]
    got, out = inputs.agg(*counts).first(), {}
    for i, (n, size) in enumerate(levels.items()):
        if got[f"bad_{i}"]:
            raise ValueError(f"{n} is categorical: its values are the codes 0 to {size - 1}")
        out[n] = [got[f"n_{i}_{k}"] for k in range(size)]
        if empty := [k for k, c in enumerate(out[n]) if not c]:
            warnings.warn(f"{method}: {n} has no runs at levels {empty}, which have no weight", stacklevel=3)
    return out


@dataclass
class Partition:
    """``table (run_id, param, rank, n, class)``, of ``size`` runs; inputs without an order have no rank."""

    table: DataFrame
    size: int
    classes: int | None
    levels: dict[str, list[int]] = field(default_factory=dict)

    def of(self, outputs: DataFrame) -> DataFrame:
        """Outputs of any slices with the places of their runs."""
        return outputs.join(self.table, "run_id")

    def replicated(self, weights: DataFrame, size: int | None = None) -> DataFrame:
        """The class table of each replicate ``rep``: runs as often as ``weights (rep, unit, w)`` say, placed anew among ``size`` of them.

        No value is sorted again: a run's copies stand where the weights of all lower ranks end, and classes follow from
        there, so that copies of one run may fall into two. Sums over ranks go block by block.
        """
        size = size or self.size
        met = self.table.join(weights, self.table["run_id"] == weights["unit"]).drop("unit").withColumn("_b", F.expr(f"rank div {BLOCK}"))
        block = met.groupBy("rep", "param", "_b").agg(F.sum("w").alias("_w"))
        before = Window.partitionBy("rep", "param").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        base = block.select("rep", "param", "_b", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_o"))
        here = Window.partitionBy("rep", "param", "_b").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        placed = met.withColumn("_r", F.coalesce(F.sum("w").over(here), F.lit(0))).join(base, ["rep", "param", "_b"])
        copies = placed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("w").cast("int") - 1)))
        ordered, rank = ~F.col("param").isin(list(self.levels)), F.col("_o") + F.col("_r") + F.col("_i")
        out = copies.select("rep", "run_id", "param", rank.alias("rank"), F.lit(size).cast("bigint").alias("n"), "class")
        return out.withColumn("class", F.when(ordered, class_of("rank", "n", self.classes)).otherwise(F.col("class"))) if self.classes else out


    def weighted(self, rows: DataFrame, drawn: DataFrame, slices: Sequence[str], replicates: int) -> DataFrame:
        """``(rep, *slices, param, class, y, w)``: the rows of ``of`` in each replicate, a row for each class that a run's copies fall into.

        ``drawn (unit, counts)`` has a run's counts in all replicates in one row, so that a run is met once, not once for each replicate. A block of ranks is one
        task, which places its copies in all replicates at once from where the blocks before it end.
        """
        classes, levels, size = self.classes, list(self.levels), self.size
        keys, block = [*slices, "param"], max(1 << 8, min(BLOCK, COUNTS // max(1, replicates)))
        groups = kept(rows.select(*keys).distinct().withColumn("_k", F.row_number().over(Window.orderBy(*keys))))  # a row for each param and slice
        met = rows.join(F.broadcast(groups), keys).join(drawn, rows["run_id"] == drawn["unit"])
        met = kept(met.select("_k", "param", "rank", "class", "y", "counts").withColumn("_b", F.expr(f"cast(rank div {block} as int)")))
        matrix = lambda c: np.frombuffer(b"".join(c), "<i4").reshape(-1, replicates)

        def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A row for each block of a batch of rows, with its counts in all replicates."""
            for f in frames:
                if len(f):
                    at, c = (f["_k"].to_numpy(np.int64) << 32) | f["_b"].to_numpy(np.int64), matrix(f.counts)
                    order = at.argsort(kind="stable")
                    starts = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
                    sums = np.add.reduceat(c[order].astype(np.int64), starts)
                    yield pd.DataFrame({"_k": at[order][starts] >> 32, "_b": at[order][starts] & (2**32 - 1), "c": list(sums)})

        long = met.select("_k", "_b", "counts").mapInPandas(summed, "_k int, _b int, c array<bigint>")
        long = long.select("_k", "_b", F.posexplode("c").alias("rep", "_c")).groupBy("_k", "_b", "rep").agg(F.sum("_c").alias("_c"))
        before = Window.partitionBy("_k", "rep").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        base = long.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).groupBy("_k", "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "_o"))), lambda x: x["_o"]).alias("_os"))

        def place(f: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("rank")
            c = matrix(f.counts).T.astype(np.int64)
            rep, i = np.nonzero(c)
            w, low = c[rep, i], (c.cumsum(1) - c + np.asarray(first._os.iloc[0], np.int64)[:, None])[rep, i]
            if f.param.iloc[0] in levels:
                own = f["class"].to_numpy()[i]
            else:
                own = ((low + 1) * classes - 1) // size
                more = ((low + w) * classes - 1) // size - own + 1
                if (more > 1).any():  # copies of one run in several classes
                    step = np.arange(more.sum()) - np.repeat(more.cumsum() - more, more)
                    rep, i, w, low, own = (np.repeat(x, more) for x in (rep, i, w, low, own))
                    own = own + step
                    w = np.minimum(low + w, (own + 1) * size // classes) - np.maximum(low, own * size // classes)
            return pd.DataFrame({"_k": f["_k"].iloc[0], "rep": rep, "class": own, "y": f.y.to_numpy()[i], "w": w})

        placed = met.groupBy("_k", "_b").cogroup(base.groupBy("_k", "_b")).applyInPandas(place, "_k int, rep int, class int, y double, w bigint")
        return kept(placed).join(F.broadcast(groups), "_k").drop("_k")


def plan(problem: Problem, inputs: DataFrame, classes: int | None = None, key: str = "run_id", method: str = "") -> Partition:
    """The partition of ``inputs (run_id, <names>)``, with ``classes`` of equal frequency for continuous inputs, or ranks alone."""
    inputs = kept(inputs.select(F.col(key).alias("run_id"), *[F.col(n).cast("double").alias(n) for n in problem.names]))
    levels = level_counts(problem, inputs, method)
    long = inputs.unpivot(["run_id"], problem.names, "param", "x")
    placed = in_order(long, ["param"], keep=("run_id", "x"))
    level = F.when(F.col("param").isin(list(levels)), F.col("x").cast("int"))
    own = class_of("rank", "n", classes) if classes else F.lit(None).cast("int")
    table = placed.select("run_id", "param", "rank", "n", F.coalesce(level, own).alias("class"))
    return Partition(kept(table), inputs.count(), classes, levels)


def direct(problem: Problem, runs: DataFrame, classes: int, method: str = "") -> tuple[DataFrame, dict[str, list[int]]]:
    """``(param, class, y)`` of one output ``runs (run_id, <names>, y)``, and the levels: no place is kept, and nothing met by run."""
    levels = level_counts(problem, runs, method)
    ordered = [n for n in problem.names if n not in levels]
    out = None
    if levels:
        own = [F.struct(F.lit(n).alias("param"), F.col(n).cast("int").alias("class")) for n in levels]
        out = runs.select("y", F.explode(F.array(*own)).alias("p")).select("p.param", "p.class", "y")
    if ordered:
        long = long_inputs(runs, ordered, keep=("run_id", "y"))
        found = classed(long, ["param"], "run_id", classes)
        if found is None:
            found = in_order(long, ["param"]).withColumn("class", class_of("rank", "n", classes))
        found = found.select("param", "class", "y")
        out = found if out is None else out.unionByName(found)
    return out, levels


def direct_bins(problem: Problem, runs: DataFrame, bins: int = 10, method: str = "") -> tuple[DataFrame, dict[str, list[int]]]:
    """As ``direct``, by classes of equal width on each input's distribution."""
    levels = level_counts(problem, runs, method)
    x = lambda n: F.col(n).cast("double")
    own = [F.struct(F.lit(n).alias("param"), (F.col(n).cast("int") if n in levels else equal_width(m.cdf(x(n)), bins)).alias("class")) for n, m in problem.inputs.items()]
    return runs.select("y", F.explode(F.array(*own)).alias("p")).select("p.param", "p.class", "y"), levels


def equal_width(u: Column, bins: int) -> Column:
    """The bin of a unit coordinate: half open, the last one closed; null outside [0, 1]."""
    bin_ = F.lit(0)
    for k in range(1, bins):
        bin_ = F.when(u >= k / bins, k).otherwise(bin_)
    return F.when((u >= 0) & (u <= 1), bin_)


def plan_bins(problem: Problem, inputs: DataFrame, bins: int = 10, key: str = "run_id", method: str = "") -> Partition:
    """Classes of equal width on each input's distribution, or by level; they are the same in every replicate."""
    inputs = cut(inputs.select(F.col(key).alias("run_id"), *[F.col(n).cast("double").alias(n) for n in problem.names]))
    levels = level_counts(problem, inputs, method)
    own = [F.struct(F.lit(n).alias("param"), (F.col(n).cast("int") if n in levels else equal_width(m.cdf(F.col(n)), bins)).alias("class")) for n, m in problem.inputs.items()]
    rows = inputs.select("run_id", F.explode(F.array(*own)).alias("p")).select("run_id", "p.param", F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("n"), "p.class")
    return Partition(cut(rows), inputs.count(), None, levels)


def drawn(table: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows of ``table (run_id, ...)`` as often as each replicate draws their runs."""
    met = table.join(weights, table["run_id"] == weights["unit"]).drop("unit")
    return met.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).drop("_i", "w")


def matched(runs: DataFrame, sizes: dict[str, Sequence[int]], noise: Column) -> DataFrame:
    """``(run_id, param, class)``: for each name, random classes of the sizes given, by one random order of the runs."""
    order = cut(ranked(runs.select(F.lit(0).alias("_all"), "run_id", noise.cast("double").alias("x")), ["_all"], ["x", "run_id"], "r", "_n"))
    rows = []
    for name, counts in sizes.items():
        at, end = F.lit(0), 0
        for c in list(counts)[:-1]:
            end += c
            at = at + (F.col("r") >= end).cast("int")
        rows.append(F.struct(F.lit(name).alias("param"), at.alias("class")))
    return order.select("run_id", F.explode(F.array(*rows)).alias("p")).select("run_id", "p.param", "p.class")
