"""Classes, quantile products and distances of large groups, without a place for every row.

An equal-frequency class needs the few rows at which classes begin. They are found by looking at one column of the
order after the other: approximate percentiles bracket an edge, exact counts confirm it, and only rows in a bracket are sorted.
What is compared by value is counted first, and dealt by ranges of the value: a range is sorted in one task, and the
counts of all ranges, which are few, give its place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import ranked

#: Rows from which edges are looked for, groups that they are looked for in, and counted values of a range.
LEAST, GROUPS, HELD = 500_000, 64, 1_000_000
#: Percentiles that bracket edges, and rows of a bracket that is sorted as it is.
GRID, FEW = 500, 20_000


def classed(rows: DataFrame, keys: Sequence[str], tie: str, classes: int, least: int | None = None) -> DataFrame | None:
    """``rows`` with ``class``, of equal frequency in order of (x, tie) within ``keys``; None where rows have to be placed one by one.

    That is so for few rows or many groups, values that are null or NaN, and equal rows at an edge.
    """
    types = {f.name: f.dataType for f in rows.schema}
    ties = [f"{tie}.{f}" for f in types[tie].names] if isinstance(types[tie], T.StructType) else [tie]
    order = [F.col(c) for c in ("x", *ties)]
    cols = [f"_o{i}" for i in range(len(order))]
    flat = rows.select(*keys, *[c.alias(o) for c, o in zip(order, cols)])
    kinds = {f.name: f.dataType for f in flat.schema}
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            bad = bad | F.isnan(c)
    info = flat.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(bad).alias("_bad")).limit(GROUPS + 1).collect()
    if len(info) > GROUPS or sum(r._n for r in info) < (LEAST if least is None else least) or any(r._bad or None in r for r in info):
        return None
    edges = _edges(flat, keys, cols, kinds, {tuple(r[k] for k in keys): r._n for r in info}, classes)
    if edges is None:
        return None
    table = [(*g, {c: [edges[g, m][i] for m in range(1, classes)] for i, c in enumerate(cols)}) for g in {g for g, _ in edges}] if classes > 1 else []
    if not table:
        return rows.withColumn("class", F.lit(0))
    shape = T.StructType([*[T.StructField(k, types[k]) for k in keys], T.StructField("_e", T.StructType([T.StructField(c, T.ArrayType(kinds[c])) for c in cols]))])
    met = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, shape)), list(keys))  # a row for each group

    def after(m: int) -> Column:
        """Whether a row is the first of class m + 1 or comes after it."""
        out = F.lit(True)
        for c, o in reversed(list(zip(order, cols))):
            edge = F.col(f"_e.{o}")[m]
            out = (c > edge) | ((c == edge) & out)
        return out

    exact = sum((after(m).cast("int") for m in range(classes - 1)), F.lit(0))
    apart = sum(((F.col("x") > F.col("_e._o0")[m]).cast("int") for m in range(classes - 1)), F.lit(0))
    return met.withColumn("class", F.when(F.array_contains("_e._o0", F.col("x")), exact).otherwise(apart)).drop("_e")


def _edges(flat: DataFrame, keys: Sequence[str], cols: Sequence[str], kinds: dict[str, T.DataType], sizes: dict[tuple, int], classes: int) -> dict[tuple, tuple] | None:
    """The values of ``cols`` at the first row of each class from 1 on, by group and class."""
    spark, found = flat.sparkSession, {}
    key_fields = [T.StructField(k, next(f.dataType for f in flat.schema if f.name == k)) for k in keys]
    # A node is a group and values of the first columns: its rows, and the places of the edges among them.
    nodes = {(g, ()): (n, {m: m * n // classes for m in range(1, classes)}) for g, n in sizes.items()}
    sorted_, wanted = None, {}

    def leaf(level: int, items: list[tuple]) -> None:
        """Rows of nodes within brackets ``(group, prefix, lo, hi, {class: place})`` go to be sorted."""
        nonlocal sorted_
        if not items:
            return
        fields = [*key_fields, *[T.StructField(f"_p{i}", kinds[cols[i]]) for i in range(level)], T.StructField("_lo", kinds[cols[level]]), T.StructField("_hi", kinds[cols[level]]), T.StructField("_edge", T.IntegerType())]
        data = []
        for g, prefix, lo, hi, places in items:
            e = len(wanted)
            wanted[e] = (g, places)
            data.append((*g, *prefix, lo, hi, e))
        table = spark.createDataFrame(data, T.StructType(fields))
        met = _met(flat, table, keys, cols, level)
        c = F.col(cols[level])
        some = met.where((F.col("_lo").isNull() | (c >= F.col("_lo"))) & (F.col("_hi").isNull() | (c <= F.col("_hi")))).select("_edge", *cols)
        sorted_ = some if sorted_ is None else sorted_.unionByName(some)

    for level, c in enumerate(cols):
        few = {k: v for k, v in nodes.items() if v[0] <= FEW or not isinstance(kinds[c], (T.NumericType, T.DateType, T.TimestampType))}
        leaf(level, [(g, p, None, None, places) for (g, p), (_, places) in few.items()])
        nodes = {k: v for k, v in nodes.items() if k not in few}
        if not nodes:
            break
        ids = list(nodes)
        fields = [*key_fields, *[T.StructField(f"_p{i}", kinds[cols[i]]) for i in range(level)], T.StructField("_node", T.IntegerType())]
        met = _met(flat, spark.createDataFrame([(*g, *p, i) for i, (g, p) in enumerate(ids)], T.StructType(fields)), keys, cols, level)
        share = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
        grid = {r._node: r.q for r in met.groupBy("_node").agg(F.percentile_approx(c, share, 20 * GRID).alias("q")).collect()}
        tried = {}
        for i, k in enumerate(ids):
            n, places = nodes[k]
            for m, t in places.items():
                f = (t + 0.5) / n * GRID
                tried[i, m] = (grid[i][max(0, int(f) - 1)], grid[i][min(GRID, int(f) + 2)])
        fields = [T.StructField("_node", T.IntegerType()), *[T.StructField(s, T.ArrayType(kinds[c])) for s in ("_lo", "_hi")]]
        most = max(len(v[1]) for v in nodes.values())
        bounds = [(i, *[[tried[i, m][s] for m in nodes[k][1]] for s in (0, 1)]) for i, k in enumerate(ids)]
        counted = met.join(F.broadcast(spark.createDataFrame(bounds, T.StructType(fields))), "_node")
        one = lambda a, j, below: F.count_if(F.col(c) < F.get(a, F.lit(j)) if below else F.col(c) <= F.get(a, F.lit(j)))
        got = counted.groupBy("_node").agg(*[one("_lo", j, True).alias(f"a{j}") for j in range(most)], *[one("_hi", j, False).alias(f"b{j}") for j in range(most)]).collect()
        following, brackets = {}, []
        for r in got:
            g, p = ids[r._node]
            n, places = nodes[g, p]
            for j, (m, t) in enumerate(places.items()):
                (lo, hi), below, upto = tried[r._node, m], r[f"a{j}"], r[f"b{j}"]
                if not below <= t < upto:  # the percentiles were off: all of the node
                    brackets.append((g, p, None, None, {m: t}))
                elif lo == hi:
                    following.setdefault((g, (*p, lo)), (upto - below, {}))[1][m] = t - below
                else:
                    brackets.append((g, p, lo, hi, {m: t - below}))
        leaf(level, brackets)
        nodes = following
    for (g, p), (n, places) in nodes.items():
        if n > 1:
            return None
        found |= {(g, m): p for m in places}
    if sorted_ is not None:
        near = [(e, int(t) + d, m if d == 0 else None) for e, (_, places) in wanted.items() for m, t in places.items() for d in (-1, 0, 1)]
        table = spark.createDataFrame(near, "_edge int, _at bigint, _m int")
        placed = ranked(sorted_, ["_edge"], cols, "_at", "_n").join(F.broadcast(table), ["_edge", "_at"]).collect()
        at = {(r._edge, r._at): tuple(r[c] for c in cols) for r in placed}
        for r in placed:
            if r._m is not None:
                here = at[r._edge, r._at]
                if here in (at.get((r._edge, r._at - 1)), at.get((r._edge, r._at + 1))):
                    return None
                found[wanted[r._edge][0], r._m] = here
    return found


def _met(flat: DataFrame, nodes: DataFrame, keys: Sequence[str], cols: Sequence[str], level: int) -> DataFrame:
    on = [flat[k] == nodes[k] for k in keys] + [flat[cols[i]] == nodes[f"_p{i}"] for i in range(level)]
    return flat.join(F.broadcast(nodes), on).drop(*[nodes[k] for k in keys])


#: Where the ranges of a group begin, in its order and in that of each of its classes.
Places = tuple[np.ndarray, dict[int, np.ndarray]]


def value_ranges(values: DataFrame, held: int | None = None) -> tuple[Column, dict[int, Places]]:
    """The range of y of each of the counted values ``(_g, class, y, c)``, and where the ranges begin.

    Groups of up to ``held`` values are one range and need no such places.
    """
    held = HELD if held is None else held
    parts = {r._g: -(-r.k // held) for r in values.groupBy("_g").agg(F.count("*").alias("k")).where(F.col("k") > held).collect()}
    if not parts:
        return F.lit(0), {}
    most = max(parts.values())
    share = F.array(*[F.lit(k / most) for k in range(1, most)])
    large = values.where(F.col("_g").isin(list(parts)))
    got = large.groupBy("_g").agg(F.percentile_approx("y", share, max(10_000, 20 * most)).alias("q")).collect()
    edges = {r._g: np.unique(np.array(r.q)[np.linspace(0, most - 2, parts[r._g] - 1).round().astype(int)]) for r in got}

    @F.pandas_udf("int")
    def bucket(g: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(g), np.int32)
        for k in g.unique():
            if k in edges:
                on = (g == k).to_numpy()
                out[on] = np.searchsorted(edges[k], y.to_numpy()[on], "right")
        return pd.Series(out)

    b = bucket("_g", "y")
    sums: dict[int, Places] = {}
    for r in large.groupBy("_g", b.alias("b"), "class").agg(F.sum("c").alias("c")).collect():
        n = len(edges[r._g]) + 2
        whole, own = sums.setdefault(r._g, (np.zeros(n, np.int64), {}))
        whole[r.b + 1] += r.c
        own.setdefault(r["class"], np.zeros(n, np.int64))[r.b + 1] += r.c
    return b, {g: (whole.cumsum(), {k: a.cumsum() for k, a in own.items()}) for g, (whole, own) in sums.items()}


def _places(known: dict[int, Places], g: int, f: pd.DataFrame) -> Places:
    """The places of a group, whose only range may be ``f``."""
    if g in known:
        return known[g]
    sums = f.groupby("class").c.sum()
    return np.array([0, sums.sum()]), {k: np.array([0, v]) for k, v in sums.items()}


def _counts(y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and their counts."""
    values, at = np.unique(y, return_inverse=True)
    return values, np.bincount(at, c, len(values)).astype(np.int64)


def distances(values: DataFrame, held: int | None = None) -> DataFrame:
    """``(_g, class, ks)``: the largest distance of each class's distribution of y from its group's, from counted values; class -1 counts in the group only."""
    bucket, known = value_ranges(values, held)

    def gaps(f: pd.DataFrame) -> pd.DataFrame:
        g, b, out = int(f._g.iloc[0]), int(f.b.iloc[0]), []
        whole, own = _places(known, g, f)
        y, c = _counts(f.y.to_numpy(), f.c.to_numpy())
        upto = whole[b] + c.cumsum()
        for k, part in f.groupby("class"):
            if k < 0:
                continue
            part = part.sort_values("y")
            at, d = np.searchsorted(y, part.y.to_numpy()), part.c.to_numpy()
            here = own[k][b] + d.cumsum()
            gap = np.maximum(np.abs(here / own[k][-1] - upto[at] / whole[-1]), np.abs((here - d) / own[k][-1] - (upto[at] - c[at]) / whole[-1]))
            out.append((g, int(k), gap.max()))
        return pd.DataFrame(out, columns=["_g", "class", "ks"])

    found = values.withColumn("b", bucket).groupBy("_g", "b").applyInPandas(gaps, "_g bigint, class int, ks double")
    return found.groupBy("_g", "class").agg(F.max("ks").alias("ks"))


def quantile_products(values: DataFrame, held: int | None = None) -> DataFrame:
    """``(_g, class, cross)``: the integral of the group's quantile function times the class's, times the group's size, from counted values.

    Ranges of y are sorted and placed, and cut anew where the group's ranges begin on the scale of probabilities; there the
    two step functions are met.
    """
    bucket, known = value_ranges(values, held)

    def pieces(f: pd.DataFrame) -> pd.DataFrame:
        g, b, out = int(f._g.iloc[0]), int(f.b.iloc[0]), []
        whole, own = _places(known, g, f)
        y, c = _counts(f.y.to_numpy(), f.c.to_numpy())
        out.append((g, b, -1, 0, y.tobytes(), c.tobytes()))
        for k, part in f.groupby("class"):
            part = part.sort_values("y")
            y, c, size = part.y.to_numpy(float), part.c.to_numpy(np.int64), int(own[k][-1])
            ends = own[k][b] + c.cumsum()
            # A run of equal members lies in range u where whole[u] size < end n and start n < whole[u + 1] size.
            n = int(whole[-1])
            low = np.searchsorted(whole * size, (ends - c) * n, "right") - 1
            high = np.searchsorted(whole * size, ends * n, "left") - 1
            for u in range(int(low[0]), int(high[-1]) + 1):
                i, j = int(np.searchsorted(high, u, "left")), int(np.searchsorted(low, u, "right"))
                if i < j and whole[u] < whole[u + 1]:
                    out.append((g, u, int(k), int(ends[i] - c[i]), y[i:j].tobytes(), c[i:j].tobytes()))
        return pd.DataFrame(out, columns=["_g", "u", "k", "start", "ys", "cs"]).assign(lo=lambda d: whole[d.u], hi=lambda d: whole[d.u + 1], n=whole[-1], size=[0 if k < 0 else int(own[k][-1]) for k in [o[2] for o in out]])

    def products(f: pd.DataFrame) -> pd.DataFrame:
        g, lo, hi, n = (int(f[c].iloc[0]) for c in ("_g", "lo", "hi", "n"))
        own = f[f.k < 0].iloc[0]
        y, c = np.frombuffer(own.ys), np.frombuffer(own.cs, np.int64)
        begin = np.concatenate([[0], c.cumsum()])
        sums = np.concatenate([[0.0], (y * c).cumsum()])
        out = []
        for r in f[f.k >= 0].itertuples():
            v, d = np.frombuffer(r.ys), np.frombuffer(r.cs, np.int64)
            ends = np.concatenate([[r.start], r.start + d.cumsum()]) * n
            at, part = np.clip(ends // r.size, lo, hi) - lo, np.where((ends // r.size >= lo) & (ends // r.size < hi), (ends % r.size) / r.size, 0.0)
            i = np.minimum(np.searchsorted(begin, at, "right") - 1, len(y) - 1)
            upto = sums[i] + y[i] * (at - begin[i] + part)
            out.append((g, int(r.k), float((v * np.diff(upto)).sum())))
        return pd.DataFrame(out, columns=["_g", "class", "cross"])

    shape = "_g bigint, u int, k int, start bigint, ys binary, cs binary, lo bigint, hi bigint, n bigint, size bigint"
    cut_anew = values.withColumn("b", bucket).groupBy("_g", "b").applyInPandas(pieces, shape)
    found = cut_anew.groupBy("_g", "u").applyInPandas(products, "_g bigint, class int, cross double")
    return found.groupBy("_g", "class").agg(F.sum("cross").alias("cross"))
