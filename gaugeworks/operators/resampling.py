"""Bootstrap weights, intervals, and aggregation of indices over output slices."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import NUMPY, normal_ppf

#: Modulus and multipliers of the portable generator, which other engines can repeat in whole numbers (fixed values).
MODULUS, M1, M2 = 2147483647, 48271, 69621
#: Counts of units in replicates that one task holds at once.
COUNTS = 1 << 18


def portable(rep: Column, i: Column, seed: int) -> Column:
    """A number below ``MODULUS`` from replicate and draw, in integers only."""
    x = (F.lit(M1) * (rep + 1) + F.lit(M2) * (i + 1) + F.lit(seed)) % MODULUS
    return (x * F.lit(M1)) % MODULUS


def hashed(rep: Column, i: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), rep, i), F.lit(MODULUS))


def weights(units: DataFrame, replicates: int, seed: int, draw=hashed) -> DataFrame:
    """``(rep, unit, w)``: how often each unit is drawn in each replicate of as many draws with replacement.

    ``units`` is ``(unit, pos)`` with positions from 0. Counts follow from grouped draws, joined on position.
    """
    n = units.count()
    if not n:
        raise ValueError("there is nothing to resample")
    draws = units.select(F.col("pos").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    counts = draws.groupBy("rep", (draw(F.col("rep"), F.col("i"), seed) % n).alias("pos")).agg(F.count("*").alias("w"))
    return counts.join(units, "pos").select("rep", "unit", "w")


def draws(units: DataFrame, replicates: int, seed: int, draw=hashed) -> DataFrame:
    """``(unit, reps)``: the draws of ``weights`` as one row for each unit drawn, with a replicate as often as it draws the unit."""
    n = units.count()
    if not n:
        raise ValueError("there is nothing to resample")
    each = units.select(F.col("pos").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    found = each.select((draw(F.col("rep"), F.col("i"), seed) % n).alias("pos"), "rep").groupBy("pos").agg(F.collect_list("rep").alias("reps"))
    return found.join(units, "pos").select("unit", "reps")


def counts(units: DataFrame, replicates: int, seed: int, draw=hashed) -> DataFrame:
    """``(unit, counts)``: the draws of ``weights`` as one row for each unit drawn, with 32-bit counts by replicate as bytes.

    A range of positions is one task, which counts all draws that fall into it.
    """
    n, block = units.count(), max(1, COUNTS // max(1, replicates))
    if not n:
        raise ValueError("there is nothing to resample")
    each = units.select(F.col("pos").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    found = each.select("rep", (draw(F.col("rep"), F.col("i"), seed) % n).cast("bigint").alias("pos")).withColumn("b", F.expr(f"cast(pos div {block} as int)"))

    def count(f: pd.DataFrame) -> pd.DataFrame:
        first = int(f.b.iloc[0]) * block
        c = np.bincount((f.pos.to_numpy() - first) * replicates + f.rep.to_numpy(), minlength=replicates * block).reshape(-1, replicates).astype("<i4")
        on = np.flatnonzero(c.any(1))
        return pd.DataFrame({"pos": first + on, "counts": [x.tobytes() for x in c[on]]})

    return found.groupBy("b").applyInPandas(count, "pos bigint, counts binary").join(units, "pos").select("unit", "counts")


def intervals(replicates: DataFrame, keys: Sequence[str], value: str, level: float = 0.95, method: str = "quantile") -> DataFrame:
    """``(*keys, lower, upper)`` over replicates, NaN left out: interpolated percentiles, or z sample deviations around the mean."""
    if method not in ("quantile", "gaussian"):
        raise ValueError("method is quantile or gaussian")
    a = (1 - level) / 2
    v = F.when(~F.isnan(value), F.col(value))
    if method == "quantile":
        pair = F.percentile(v, F.array(F.lit(a), F.lit(1 - a)))
        return replicates.groupBy(*keys).agg(pair.alias("p")).select(*keys, F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper"))
    z = float(normal_ppf(np.float64(1 - a), NUMPY))
    stats = replicates.groupBy(*keys).agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    return stats.select(*keys, (F.col("m") - z * F.col("s")).alias("lower"), (F.col("m") + z * F.col("s")).alias("upper"))


def subsample_scale(n: int, share: float = 0.8) -> tuple[int, float]:
    """Rows of a subsample without replacement, and the factor that scales its spread to the full sample's."""
    m = math.floor(share * n)
    return m, math.sqrt(m / (n - m)) if n > m else math.nan


def aggregated(result: DataFrame, fields: Sequence[str], by: str = "variance", keys: Sequence[str] = ("param",)) -> DataFrame:
    """One index per input over all slices, weighted by ``variance`` or equally; a slice of weight zero adds nothing, NaN or not."""
    if by not in ("variance", "equal"):
        raise ValueError("weights are variance or equal")
    w = F.col("variance") if by == "variance" else F.lit(1.0)
    term = lambda f: F.sum(F.when(w != 0, w * F.col(f)).otherwise(0.0))
    return result.groupBy(*keys).agg(*[F.coalesce(F.try_divide(term(f), F.sum(w)), F.lit(float("nan"))).alias(f) for f in fields])
