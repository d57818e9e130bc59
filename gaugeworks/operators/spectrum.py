"""Fourier transforms of curves of any length.

A curve that fits into a task is transformed there. A longer one is laid out as a matrix: its columns are transformed, turned by their
place, and then its rows, two shuffles of as many rows as the curve has points. A length without fitting factors
is turned into a convolution of a length that has them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Points of a curve, or of columns and rows of one, that a task takes at once.
FITS, GROUP = 1 << 18, 1 << 16


def factors(n: int) -> tuple[int, int] | None:
    """Two factors of ``n``, as near to each other as can be; None where the larger one does not fit."""
    a = next(a for a in range(math.isqrt(n), 0, -1) if n % a == 0)
    return (a, n // a) if n // a <= FITS else None


def _types(rows: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(rows.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def transformed(rows: DataFrame, n: int, keys: Sequence[str] = (), inverse: bool = False) -> DataFrame:
    """``(*keys, k, re, im)`` from ``(*keys, t, re, im)``, ``t`` from 0 to ``n - 1``: sums of values times ``exp(-2 pi i k t / n)``.

    With ``inverse``, the signs are turned and sums divided by ``n``.
    """
    keys, shape = list(keys), factors(n)
    if shape is None:
        return _by_convolution(rows, n, keys, inverse)
    n1, n2 = shape
    sign = 1 if inverse else -1
    way = (lambda m: np.fft.ifft(m, axis=1) * m.shape[1]) if inverse else (lambda m: np.fft.fft(m, axis=1))
    wide1, wide2 = max(1, GROUP // n1), max(1, GROUP // n2)

    def matrix(f: pd.DataFrame, line: str, place: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        lines = np.sort(f[line].unique())
        m = np.full((len(lines), width), np.nan, complex)
        m[np.searchsorted(lines, f[line]), f[place]] = f.re.to_numpy() + 1j * f.im.to_numpy()
        return lines, m

    def out(f: pd.DataFrame, m: np.ndarray, **places: np.ndarray) -> pd.DataFrame:
        own = {k: f[k].iloc[0] for k in keys}
        return pd.DataFrame({**own, **places, "re": m.real.ravel(), "im": m.imag.ravel()})

    def columns(f: pd.DataFrame) -> pd.DataFrame:
        t2, m = matrix(f, "t2", "t1", n1)
        k1 = np.arange(n1)
        m = way(m) * np.exp(sign * 2j * np.pi * (t2[:, None] * k1[None] % n) / n)
        return out(f, m, k1=np.tile(k1, len(t2)), t2=np.repeat(t2, n1))

    def lines(f: pd.DataFrame) -> pd.DataFrame:
        k1, m = matrix(f, "k1", "t2", n2)
        m = way(m) / (n if inverse else 1)
        return out(f, m, k=(k1[:, None] + n1 * np.arange(n2)[None]).ravel())

    types = _types(rows, keys)
    first = rows.select(*keys, F.expr(f"t div {n2}").alias("t1"), (F.col("t") % n2).alias("t2"), "re", "im")
    first = first.withColumn("_g", F.expr(f"t2 div {wide1}")).groupBy(*keys, "_g").applyInPandas(columns, types + "k1 bigint, t2 bigint, re double, im double")
    second = first.withColumn("_g", F.expr(f"k1 div {wide2}")).groupBy(*keys, "_g")
    return second.applyInPandas(lines, types + "k bigint, re double, im double")


def _by_convolution(rows: DataFrame, n: int, keys: list[str], inverse: bool) -> DataFrame:
    """The transform as a convolution with ``exp(pi i t^2 / n)``, of the next power of two that holds it."""
    size, spark = 1 << (2 * n - 2).bit_length(), rows.sparkSession
    sign = -1.0 if inverse else 1.0
    turn = lambda t: F.lit(math.pi) * ((F.col(t) * F.col(t)) % (2 * n)) / n
    times = lambda a, b, c, d: (a * c - b * d, a * d + b * c)  # noqa: E731  of complex numbers
    re, im, c, s = F.col("re"), F.col("im"), F.cos(turn("t")), -sign * F.sin(turn("t"))
    x, y = times(re, im, c, s)
    own = rows.select(*keys, F.col("t").cast("bigint").alias("t"), x.alias("re"), y.alias("im"))
    # Places up to the size of the convolution are filled with zeros.
    zeros = spark.range(n, size).select(F.col("id").alias("t"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    if keys:
        each = cut(rows.select(*keys).distinct())  # a row for each curve
        zeros = zeros.join(F.broadcast(each), F.lit(True)).select(*keys, "t", "re", "im")
    chirp = spark.range(size).select(F.col("id").alias("t"), F.least("id", F.lit(size) - F.col("id")).alias("_t"))
    on = F.col("_t") < n
    chirp = chirp.select("t", F.when(on, F.cos(turn("_t"))).otherwise(0.0).alias("re"), F.when(on, sign * F.sin(turn("_t"))).otherwise(0.0).alias("im"))
    a = transformed(own.unionByName(zeros), size, keys)
    b = transformed(chirp, size).withColumnsRenamed({"re": "_c", "im": "_d"})
    x, y = times(F.col("re"), F.col("im"), F.col("_c"), F.col("_d"))
    back = transformed(cut(a.join(b, "k").select(*keys, F.col("k").alias("t"), x.alias("re"), y.alias("im"))), size, keys, True).where(F.col("k") < n)
    x, y = times(re, im, F.cos(turn("k")), -sign * F.sin(turn("k")))
    over = float(n if inverse else 1)
    return back.select(*keys, "k", (x / over).alias("re"), (y / over).alias("im"))


def fourier_sums(curves: DataFrame, omega: int, harmonics: int, keys: Sequence[str]) -> DataFrame:
    """``(*keys, own, rest, m, v, flat)`` of curves ``(*keys, t, n, y)``: the power at the first multiples of ``omega``, that up to ``omega // 2``, and the mean, variance and constancy of y.

    Powers are of the frequency and its negative together. Curves of up to ``FITS`` points are one task's work each.
    """
    keys, main = list(keys), [p * omega for p in range(1, harmonics + 1)]
    lengths = [r.n for r in curves.select("n").distinct().collect()]  # few: a design's curves are equally long
    types, out = _types(curves, keys), None

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        y, n = f.sort_values("t").y.to_numpy(float), len(f)
        both = np.abs(np.fft.fft(y - y.mean()) / n) ** 2
        both *= np.where(2 * np.arange(n) == n, 1.0, 2.0)
        row = {"own": both[np.array(main) % n].sum(), "rest": both[1 : omega // 2 + 1].sum(), "m": y.mean(), "v": y.var(), "flat": bool(y.max() == y.min())}
        return pd.DataFrame({**{k: f[k].iloc[:1] for k in keys}, **{k: [x] for k, x in row.items()}})

    if any(n <= FITS for n in lengths):
        out = curves.where(F.col("n") <= FITS).groupBy(*keys).applyInPandas(whole, types + "own double, rest double, m double, v double, flat boolean")
    for n in sorted(n for n in lengths if n > FITS):
        one = curves.where(F.col("n") == n)
        stats = cut(one.groupBy(*keys).agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"), (F.max("y") == F.min("y")).alias("flat")))
        centred = one.join(F.broadcast(stats.select(*keys, "m")), keys).select(*keys, "t", (F.col("y") - F.col("m")).alias("re"), F.lit(0.0).alias("im"))  # a row for each curve
        power = transformed(centred, n, keys).where((F.col("k") > 0) & ((F.col("k") <= omega // 2) | F.col("k").isin(main)))
        both = F.when(2 * F.col("k") == n, 1.0).otherwise(2.0) * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / float(n) ** 2
        sums = power.groupBy(*keys).agg(F.sum(F.when(F.col("k").isin(main), both).otherwise(0.0)).alias("own"), F.sum(F.when(F.col("k") <= omega // 2, both).otherwise(0.0)).alias("rest"))
        sums = sums.join(stats, keys).select(*keys, "own", "rest", "m", "v", "flat")
        out = sums if out is None else out.unionByName(sums)
    return out if out is not None else curves.sparkSession.createDataFrame([], types + "own double, rest double, m double, v double, flat boolean")
