"""The partition of runs: equal values in order of runs, classes by level, replicates placed by weights."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import given_data as gd
from gaugeworks.operators import partition
from gaugeworks.operators import resampling as rs
from gaugeworks.operators.analyze import analyze
from gaugeworks.problem import Categorical, Problem, Uniform


def frame(n=4000, seed=2):
    """Inputs of few values, one of which moves the output, and an input of levels; the output is theirs and noise."""
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"run_id": rng.permutation(n), "few": rng.integers(0, 5, n) / 5, "idle": rng.integers(0, 4, n) / 4, "level": rng.integers(0, 3, n).astype(float), "wide": rng.random(n)})
    f["y"] = 3 * f.few + 2.0 * (f.level == 1) + rng.normal(size=n)
    return f


P = Problem({"few": Uniform(), "idle": Uniform(), "level": Categorical((0.3, 0.3, 0.4)), "wide": Uniform()})
PLAIN = Problem({"few": Uniform(), "idle": Uniform(), "wide": Uniform()})


def places(f, x):
    """Stable order by value of rows in order of their runs."""
    f = f.sort_values("run_id").reset_index(drop=True)
    return f.iloc[np.argsort(f[x].to_numpy(), kind="stable")].reset_index(drop=True)


def classes_of(n, m):
    return np.repeat(np.arange(m), np.diff([k * n // m for k in range(m + 1)]))


def test_tied_inputs_without_effect_have_no_index(spark):
    f = frame()
    runs = spark.createDataFrame(f).repartition(5)
    rank = {r.param: r.s1 for r in analyze("rank", PLAIN, runs.select("run_id", "y"), runs).table.collect()}
    for x in PLAIN.names:
        y = places(f, x).y.to_numpy()
        want = np.mean((y - y.mean()) * (np.roll(y, -1) - y.mean())) / y.var()
        assert abs(rank[x] - want) < 1e-9
    assert abs(rank["idle"]) < 0.05 and rank["few"] > 0.2
    delta = {r.param: r.delta for r in analyze("borgonovo", P, runs.select("run_id", "y"), runs, n_classes=8).table.collect()}
    assert delta["idle"] < 0.08 < 0.15 < delta["few"]


def test_classes_by_order_and_by_level(spark):
    f = frame(997)
    got = partition.plan(P, spark.createDataFrame(f).repartition(3), 16).table.toPandas()
    for x in ("few", "idle", "wide"):
        want = places(f, x)
        own = got[got.param == x].sort_values("rank")
        assert own.run_id.tolist() == want.run_id.tolist() and own["class"].tolist() == classes_of(997, 16).tolist()
    level = got[got.param == "level"].set_index("run_id")["class"]
    assert (level.sort_index() == f.set_index("run_id").level.sort_index()).all()


def transport_by_hand(y, classes):
    """Mean squared transport by coupling quantiles on a grid as fine as all sizes together."""
    n, w = len(y), 0.0
    whole = np.sort(y)
    for c in np.unique(classes):
        own = np.sort(y[classes == c])
        cuts = np.unique(np.concatenate([np.arange(n + 1) / n, np.arange(len(own) + 1) / len(own)]))
        mid = (cuts[1:] + cuts[:-1]) / 2
        w += len(own) / n * np.sum(np.diff(cuts) * (whole[(mid * n).astype(int)] - own[(mid * len(own)).astype(int)]) ** 2)
    return w / (2 * y.var(ddof=1))


def test_transport_of_levels_with_matched_floor(spark):
    f = frame(600)
    runs = spark.createDataFrame(f)
    got = {r.param: r for r in analyze("optimal_transport", P, runs.select("run_id", "y"), runs, n_classes=6, dummy=True, seed=4).table.collect()}
    for x in ("few", "wide"):
        assert abs(got[x].ot - transport_by_hand(places(f, x).y.to_numpy(), classes_of(600, 6))) < 1e-9
    assert abs(got["level"].ot - transport_by_hand(f.y.to_numpy(), f.level.to_numpy())) < 1e-9
    assert got["few"].ot_dummy == got["idle"].ot_dummy != got["level"].ot_dummy  # fewer and larger classes have less noise
    assert got["level"].ot_dummy < got["few"].ot_dummy < 0.05 and got["level"].above_dummy > 0.1


def test_pawn_of_levels(spark):
    f = frame(900)
    runs = spark.createDataFrame(f)
    got = {r.param: r for r in analyze("pawn", P, runs.select("run_id", "y"), runs, statistic="max", n_bootstrap=4, seed=1).table.collect()}
    y = np.sort(f.y.to_numpy())
    cdf = lambda v, at: np.searchsorted(np.sort(v), at, side="right") / len(v)
    want = max(np.abs(cdf(f.y[f.level == k].to_numpy(), y) - cdf(y, y)).max() for k in range(3))
    assert abs(got["level"].pawn - want) < 1e-9 and got["level"].n_bins == 3
    assert got["level"].pawn_lower <= got["level"].pawn <= got["level"].pawn_upper + 1e-9 and got["idle"].pawn < 0.2


def test_codes_are_checked(spark):
    f = frame(100)
    for bad in (0.5, 3.0, -1.0, float("nan"), None):
        runs = spark.createDataFrame(f).withColumn("level", F.when(F.col("run_id") == 7, F.lit(bad).cast("double")).otherwise(F.col("level")))
        with pytest.raises(ValueError, match="codes 0 to 2"):
            partition.level_counts(P, runs)
    for method in ("pawn", "borgonovo", "optimal_transport"):
        with pytest.raises(ValueError, match="codes 0 to 2"):
            analyze(method, P, runs.select("run_id", "y"), runs)
    with pytest.warns(UserWarning, match=r"levels \[2\]"):
        runs = spark.createDataFrame(f).withColumn("level", F.least("level", F.lit(1.0)))
        table = analyze("optimal_transport", P, runs.select("run_id", "y"), runs, dummy=True).to_pandas()
        assert table.ot.notna().all() and table.ot_dummy.notna().all()


def test_replicates_equal_a_new_partition_of_the_copies(spark, monkeypatch):
    monkeypatch.setattr(partition, "BLOCK", 32)
    f = frame(300)
    plan = partition.plan(P, spark.createDataFrame(f), 7)
    rng = np.random.default_rng(1)
    w = pd.DataFrame([(r, u, c) for r in range(3) for u, c in zip(*np.unique(rng.integers(0, 300, 300), return_counts=True))], columns=["rep", "unit", "w"])
    got = plan.replicated(spark.createDataFrame(w)).toPandas()
    for r in range(3):
        again = f.merge(w[w.rep == r], left_on="run_id", right_on="unit")
        again = again.loc[again.index.repeat(again.w)]
        for x in ("few", "wide"):
            own = got[(got.rep == r) & (got.param == x)].sort_values("rank")
            assert own["rank"].tolist() == list(range(300)) and own.run_id.tolist() == places(again, x).run_id.tolist()
            assert own["class"].tolist() == classes_of(300, 7).tolist()
        level = got[(got.rep == r) & (got.param == "level")]
        assert sorted(zip(level.run_id, level["class"])) == sorted(zip(again.run_id, again.level.astype(int)))


def test_slices_share_a_partition_and_irregular_ones_have_their_own(spark):
    f = frame(400)
    runs = spark.createDataFrame(f).cache()
    two = runs.select("run_id", F.explode(F.array(*[F.struct(F.lit(k).alias("o"), (F.col("y") * (k + 1) - F.col("wide") * 4 * k).alias("y")) for k in range(2)])).alias("s")).select("run_id", "s.*")
    uneven = two.where("o = 0 OR run_id % 3 > 0")
    for outputs, method, options in ((two, "optimal_transport", {"n_classes": 5}), (uneven, "rank", {}), (two, "borgonovo", {"n_classes": 5})):
        p = PLAIN if method == "rank" else P
        got = analyze(method, p, outputs, runs, slices=["o"], n_bootstrap=3 if method == "rank" else 0, seed=3, **options)
        field = got.fields[0]
        table = got.table.toPandas().set_index(["param", "o"])
        alone = analyze(method, p, outputs.where("o = 1").drop("o"), runs, **options).table.toPandas().set_index("param")
        assert len(table) == 2 * len(p.names) and np.allclose(table.xs(1, level="o").loc[p.names, field], alone.loc[p.names, field], atol=1e-9)
        assert method != "rank" or (table.s1_lower <= table.s1_upper).all()


def test_rows_without_an_id_are_ordered_by_a_hash(spark):
    f = frame()
    long = spark.createDataFrame(f).select(F.lit("idle").alias("param"), F.col("idle").alias("x"), "y")
    assert abs(gd.rank_index(long).first().s1) < 0.06


def test_weighted_replicates_are_the_copies(spark, monkeypatch):
    """Rows by weight are the copies of ``replicated``, class by class, over blocks of ranks, slices and levels, and transport of both is the same."""
    monkeypatch.setattr(partition, "COUNTS", 1)
    monkeypatch.setattr(rs, "COUNTS", 300)
    rng = np.random.default_rng(3)
    n, reps = 700, 3
    f = pd.DataFrame({"run_id": np.arange(n), "a": rng.integers(0, 9, n) / 9, "level": rng.integers(0, 2, n).astype(float)})
    p = Problem({"a": Uniform(), "level": Categorical((0.5, 0.5))})
    rows = spark.createDataFrame(pd.concat([f[["run_id"]].assign(o=o, y=rng.normal(size=n).round(2)) for o in (0, 1)]))
    shared = partition.plan(p, spark.createDataFrame(f), 300)
    units = spark.createDataFrame(f[["run_id"]].assign(pos=f.run_id)).withColumnRenamed("run_id", "unit")
    for draw in (rs.portable, lambda rep, i, seed: F.lit(5) + 0 * i):  # all draws are one unit, in many classes
        copies = rows.join(shared.replicated(rs.weights(units, reps, 4, draw)), "run_id")
        weighted = shared.weighted(shared.of(rows), rs.counts(units, reps, 4, draw), ["o"], reps).cache()
        by = ["rep", "o", "param", "class", "y"]
        want = copies.groupBy(*by).agg(F.count("*").alias("w")).toPandas().sort_values(by).reset_index(drop=True)
        got = weighted.groupBy(*by).agg(F.sum("w").alias("w")).toPandas().sort_values(by).reset_index(drop=True)
        pd.testing.assert_frame_equal(want, got, check_dtype=False)
        a, b = (gd.transport(r, 300, ["o", "rep"]).toPandas().sort_values(["rep", "o", "param"]).reset_index(drop=True) for r in (copies, weighted))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-12)
