"""Edges of classes, quantile products and distances against plain versions, with ranges and brackets that are small."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import given_data as gd
from gaugeworks.operators import order
from gaugeworks.operators.analyze import analyze
from gaugeworks.problem import Categorical, Problem, Uniform


def _rows(spark, n=4000):
    rng = np.random.default_rng(3)
    f = pd.DataFrame({"a": rng.integers(0, 700, n), "b": np.arange(n), "few": rng.integers(0, 4, n) / 4, "many": rng.random(n), "one": 1.0, "y": np.round(rng.random(n), 2)})
    df = spark.createDataFrame(f).repartition(5)
    return f, df.select(F.struct("a", "b").alias("run_id"), "few", "many", "one", "y").unpivot(["run_id", "y"], ["few", "many", "one"], "param", "x")


def test_classes_by_edges_are_those_of_ranks(spark, monkeypatch):
    """No row but those near an edge is placed."""
    f, rows = _rows(spark)
    monkeypatch.setattr(order, "FEW", 300)
    placed = []
    monkeypatch.setattr(order, "ranked", lambda r, *a, **k: placed.append(r.count()) or gd_ranked(r, *a, **k))
    gd_ranked = __import__("gaugeworks.operators.frames", fromlist=["ranked"]).ranked
    got = order.classed(rows, ["param"], "run_id", 7, least=0).toPandas()
    assert sum(placed) < 3000
    got["b"] = [r["b"] for r in got.run_id]
    for p in ("few", "many", "one"):
        o = f.sort_values([p, "a", "b"]).reset_index(drop=True)
        want = dict(zip(o.b, ((np.arange(len(o)) + 1) * 7 - 1) // len(o)))
        mine = got[got.param == p]
        assert len(mine) == len(f) and all(want[b] == c for b, c in zip(mine.b, mine["class"]))


def test_equal_rows_are_placed_one_by_one(spark):
    rows = spark.createDataFrame([("p", 1.0, 1, 0.0)] * 50 + [("p", 2.0, 2, 0.0)], "param string, x double, run_id int, y double")
    assert order.classed(rows, ["param"], "run_id", 3, least=0) is None


@pytest.mark.parametrize("held", [1_000_000, 40])
def test_ranges_of_values(spark, held):
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"_g": rng.integers(0, 2, 3000), "class": rng.integers(0, 3, 3000), "y": np.where(rng.random(3000) < 0.3, 0.5, np.round(rng.normal(size=3000), 2))})
    f["y"] += f["class"] * 0.7
    values = spark.createDataFrame(f).withColumn("class", F.col("class").cast("int")).groupBy("_g", "class", "y").agg(F.count("*").alias("c"))
    cross = {(r._g, r["class"]): r.cross for r in order.quantile_products(values, held).collect()}
    ks = {(r._g, r["class"]): r.ks for r in order.distances(values, held).collect()}
    for g, whole in f.groupby("_g"):
        w = np.sort(whole.y.to_numpy())
        for k, own in whole.groupby("class"):
            v = np.sort(own.y.to_numpy())
            n, c = len(w), len(v)
            want = (np.repeat(w, c) * np.repeat(v, n)).sum() / c
            assert cross[g, k] == pytest.approx(want, rel=1e-10)
            at = np.unique(w)
            gap = np.abs(np.searchsorted(w, at, "right") / n - np.searchsorted(v, at, "right") / c).max()
            assert ks[g, k] == pytest.approx(gap, abs=1e-12)


def test_named_output_needs_no_join(spark):
    """An output that is a column of the inputs is not met with them by run, and nothing is written for each run."""
    runs = spark.range(3000).select(F.struct("id").alias("run_id"), (F.col("id") % 51).cast("double").alias("q"), (F.col("id") % 3).cast("double").alias("f"), (F.col("id") * 7919 % 3001 / 3001 + F.col("id") % 3).alias("y"))
    p = Problem({"q": Uniform(0, 51), "f": Categorical((0.3, 0.4, 0.3), ("a", "b", "c"))})
    for method, o in (("optimal_transport", {"n_classes": 10}), ("borgonovo", {"n_classes": 10}), ("pawn", {})):
        one = {r.param: r for r in analyze(method, p, "y", runs, **o).table.collect()}
        two = {r.param: r for r in analyze(method, p, runs.select("run_id", "y"), runs, **o).table.collect()}
        for k in ("q", "f"):
            assert all(a == pytest.approx(b, abs=1e-12) for a, b in zip(one[k], two[k]) if not isinstance(a, str))
    with pytest.raises(ValueError):
        analyze("pawn", p, "y", runs, slices=["o"])


@pytest.mark.parametrize("least", ["auto", 0.5])
def test_kernel_sums_by_bins(spark, monkeypatch, least):
    """Sums from powers are the rows' own to the last digits, and no row goes to Python."""
    rng = np.random.default_rng(9)
    f = pd.DataFrame({"param": "p", "class": rng.integers(0, 3, 900), "y": rng.gamma(2.0, size=900)})
    f.loc[f["class"] == 2, "y"] = 1.5 + 1e-7 * rng.random((f["class"] == 2).sum())
    rows = spark.createDataFrame(f).withColumn("class", F.col("class").cast("int"))
    direct, called = gd._by_rows, []
    monkeypatch.setattr(gd, "_by_rows", lambda *a: called.append(1) or direct(*a))
    got = gd.borgonovo(rows, 3, least=least).first()
    assert not called
    monkeypatch.setattr(gd, "BINS", 0)
    want = gd.borgonovo(rows, 3, least=least).first()
    assert called and got.delta == pytest.approx(want.delta, rel=1e-11) and got.s1 == pytest.approx(want.s1, rel=1e-12)


def test_rank_index_sorts_once(spark, monkeypatch):
    """Neighbours are met in the range that is sorted and at its ends; no row is placed or joined by rank."""
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"run_id": np.arange(500), "param": np.where(np.arange(500) % 5 == 0, "a", "b"), "x": rng.integers(0, 9, 500) / 9.0, "y": rng.random(500)})
    monkeypatch.setattr(gd, "in_order", None)
    got = {r.param: r.s1 for r in gd.rank_index(spark.createDataFrame(f).repartition(4)).collect()}
    for p, part in f.groupby("param"):
        y = part.sort_values(["x", "run_id"]).y.to_numpy()
        d = y - y.mean()
        assert got[p] == pytest.approx((d * np.roll(d, -1)).mean() / y.var(), abs=1e-12)


def test_places_are_kept_as_columns(spark, monkeypatch):
    """No checkpoint holds a row for each run."""
    from gaugeworks.operators.frames import ranked
    from gaugeworks.plans import lineage

    seen, real = [], lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda d: seen.append(d.count()) or real(d))
    assert ranked(spark.range(2000).withColumn("g", F.lit(1)), ["g"], ["id"]).where("rank <> id OR n <> 2000").isEmpty()
    assert max(seen) < 2000


def test_kernel_sums_by_factors(spark, monkeypatch):
    """Sums from features are those over all pairs, and no pair of blocks is made."""
    from gaugeworks.operators import kernels

    rng = np.random.default_rng(4)
    x = rng.random((300, 2))
    f = pd.DataFrame({"run_id": np.arange(300), "a": x[:, 0], "b": np.floor(9 * x[:, 1]), "y": x[:, 0] ** 2 + x[:, 1]})
    rows, pairs, called = spark.createDataFrame(f), kernels._by_pairs, []
    monkeypatch.setattr(kernels, "_by_pairs", lambda *a: called.append(1) or pairs(*a))
    one = {r.param: r for r in kernels.hsic(rows, ["a", "b"], permutations=5, seed=1).collect()}
    assert not called
    monkeypatch.setattr(kernels, "TENSOR", 0)
    two = {r.param: r for r in kernels.hsic(rows, ["a", "b"], permutations=5, seed=1).collect()}
    assert called
    for k in ("a", "b"):
        for c in ("hsic_raw", "r2", "total", "p_value"):
            assert one[k][c] == pytest.approx(two[k][c], rel=1e-9, abs=1e-12)
    assert kernels.factor(0.0, 1.0, 1e-20) is None
