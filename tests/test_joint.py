"""Entropic transport of several outputs: plans in one task, plans in rounds over blocks, and plain ones by hand are the same."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import joint, partition
from gaugeworks.operators.analyze import analyze
from gaugeworks.problem import Categorical, Problem, Uniform

P = Problem({"a": Uniform(), "b": Uniform(), "level": Categorical((0.5, 0.5))})


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(12)
    n = 60
    f = pd.DataFrame({"run_id": np.arange(n), "a": rng.random(n), "b": rng.integers(0, 4, n) / 4, "level": rng.integers(0, 2, n).astype(float)})
    f["y0"], f["y1"], f["y2"] = f.a + 0.1 * rng.normal(size=n), 3 * f.level + rng.normal(size=n), 100 * f.a * f.b
    return f


@pytest.fixture(scope="module")
def outputs(spark, frame):
    rows = spark.createDataFrame(frame)
    parts = [F.struct(F.lit(k // 2).alias("o"), F.lit(k % 2).alias("t"), F.col(f"y{min(k, 2)}").alias("y")) for k in range(4)]
    return rows.select("run_id", F.explode(F.array(*parts)).alias("s")).select("run_id", "s.*").cache()


def by_hand(z, classes, epsilon, tol=1e-9, most=2000):
    """Indices from whole plans, multiplied out."""
    z = z - z.mean(0)
    v, n, ot, adv = 2 * np.cov(z.T, ddof=1).trace(), len(z), 0.0, 0.0
    for k in np.unique(classes):
        own = z[classes == k]
        c = ((z[:, None] - own[None]) ** 2).sum(2)
        kernel = np.exp(-c / (epsilon * v))
        u, w = np.ones(n), np.ones(len(own))
        for _ in range(most):
            u = 1 / n / (kernel @ w)
            w = 1 / len(own) / (kernel.T @ u)
        ot += len(own) / n * (u[:, None] * kernel * w[None] * c).sum() / v
        adv += len(own) / n * (own.mean(0) ** 2).sum() / v
    return ot, adv


def classes_by_hand(frame, x, m):
    order = np.argsort(frame[x].to_numpy(), kind="stable")
    out = np.empty(len(frame), int)
    out[order] = np.repeat(np.arange(m), np.diff([k * len(frame) // m for k in range(m + 1)]))
    return out


def test_clouds_against_plain_plans(spark, frame, outputs):
    inputs = spark.createDataFrame(frame)
    z = frame[["y0", "y1", "y2", "y2"]].to_numpy()
    z = z / z.std(0)
    got = analyze("optimal_transport", P, outputs, inputs, slices=["o", "t"], mode="multivariate", n_classes=3, epsilon=0.2).to_pandas().set_index("param")
    for x in ("a", "b", "level"):
        ot, adv = by_hand(z, frame.level.to_numpy() if x == "level" else classes_by_hand(frame, x, 3), 0.2)
        assert got.ot[x] == pytest.approx(ot, abs=1e-7) and got.advective[x] == pytest.approx(adv, abs=1e-12) and got.unconverged[x] == 0
        assert got.s1[x] == pytest.approx(2 * 60 / 59 * adv)
    paths = analyze("optimal_transport", P, outputs, inputs, slices=["o", "t"], mode="trajectory", time="t", n_classes=3, epsilon=0.2).to_pandas().set_index(["o", "param"])
    for o, cols in ((0, [0, 1]), (1, [2, 3])):
        assert paths.ot[o, "a"] == pytest.approx(by_hand(z[:, cols], classes_by_hand(frame, "a", 3), 0.2)[0], abs=1e-7)


def test_rounds_over_blocks_equal_single_tasks(spark, frame, outputs, monkeypatch):
    """With weights and clouds of replicates, and plans that settle at different rounds."""
    monkeypatch.setattr(joint, "SIDE", 32)
    table = partition.plan(P, spark.createDataFrame(frame), 4)
    rng = np.random.default_rng(2)
    w = spark.createDataFrame([(r, int(u), int(c)) for r in range(2) for u, c in zip(*np.unique(rng.integers(0, 60, 60), return_counts=True))], "rep int, unit bigint, w bigint")
    cloud = joint.clouds(outputs.where("o = 0"), [], ["t"])
    again = cloud.join(w, F.col("run_id") == F.col("unit")).drop("unit").cache()
    copies = table.replicated(w).cache()
    a, b = (joint.joint_transport(again, copies, ["rep"], epsilon=0.8, most=13, tol=1e-3, plan=p).toPandas().set_index(["rep", "param"]).sort_index() for p in (10**9, 0))
    assert np.allclose(a[["ot", "advective", "diffusive", "s1"]], b[["ot", "advective", "diffusive", "s1"]], atol=1e-10) and a.unconverged.tolist() == b.unconverged.tolist()
    a = joint.joint_transport(again, copies, ["rep"], epsilon=0.1).toPandas().set_index(["rep", "param"])
    whole = again.where("rep = 1").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).select("run_id", "z").toPandas()
    codes = frame.set_index("run_id").level[whole.run_id].to_numpy()
    assert a.ot[1, "level"] == pytest.approx(by_hand(np.array(whole.z.tolist()), codes, 0.1)[0], abs=1e-6)


def test_odd_clouds(spark, frame, outputs):
    inputs = spark.createDataFrame(frame)
    flat = outputs.withColumn("y", F.lit(2.0))
    with pytest.warns(UserWarning, match="constant"):
        got = analyze("optimal_transport", P, flat, inputs, slices=["o", "t"], mode="multivariate", n_classes=3).to_pandas()
    assert (got.ot == 0).all()
    nan = outputs.withColumn("y", F.when((F.col("run_id") == 3) & (F.col("t") == 0), float("nan")).otherwise(F.col("y")))
    assert analyze("optimal_transport", P, nan, inputs, slices=["o", "t"], mode="multivariate", n_classes=3, on_invalid="propagate").to_pandas().ot.isna().all()
    with pytest.raises(ValueError, match="every output"):
        analyze("optimal_transport", P, outputs.where("run_id > 4 OR t = 0"), inputs, slices=["o", "t"], mode="multivariate")
    with pytest.raises(ValueError, match="time"):
        analyze("optimal_transport", P, outputs, inputs, slices=["o", "t"], mode="trajectory", time="x")
    got = analyze("optimal_transport", P, outputs, inputs, slices=["o", "t"], mode="trajectory", time="t", n_classes=3, epsilon=0.3, n_bootstrap=2, seed=1).to_pandas()
    assert len(got) == 6 and (got.ot_lower <= got.ot_upper).all()


def test_features_equal_pairs(spark, frame, outputs, monkeypatch):
    """Plans by features, in tasks and in passes over blocks, are those of pairs; where features don't serve, pairs are compared."""
    table = partition.plan(P, spark.createDataFrame(frame), 4).table.cache()
    cloud = joint.clouds(outputs.where("o = 0"), [], ["t"]).cache()
    solve = lambda: joint.joint_transport(cloud, table, epsilon=0.3, most=13, tol=1e-4, plan=0).toPandas().set_index("param").sort_index()
    want = joint.joint_transport(cloud, table, epsilon=0.3, most=13, tol=1e-4).toPandas().set_index("param").sort_index()
    rounds, asked = joint._in_rounds, []
    monkeypatch.setattr(joint, "_in_rounds", lambda known, *rest: asked.append(known.count()) or rounds(known, *rest))
    for limits in ({"SIDE": 16, "DIRECT": 0}, {"SIDE": 16, "DIRECT": 0, "CLOUD": 0}, {"SIDE": 32, "DIRECT": 0, "CLOUD": 0, "TENSOR": 1}):
        for name, value in limits.items():
            monkeypatch.setattr(joint, name, value)
        got = solve()
        assert np.allclose(got.drop(columns="unconverged"), want.drop(columns="unconverged"), atol=1e-8) and got.unconverged.tolist() == want.unconverged.tolist()
    assert asked == [10]


def test_features_know_their_errors():
    """Members far from most runs leave kernel sums that features can't give: those plans are refused, others equal whole ones."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-1.7, 1.7, (3000, 2))
    near, far = x[:700], x[np.argsort(x[:, 1])[-40:]]
    a = np.full(len(x), 1 / len(x))
    b = np.full(len(near), 1 / len(near))
    for e in (0.8, 0.3):
        got = joint.featured(joint.Features.of(x.min(0), x.max(0), e), x, near, a, b, 0.0, 20)
        assert got == (pytest.approx(joint.entropic(joint.costs(x, near), a, b, e, 0.0, 20)[0], rel=1e-8), False)
    assert joint.featured(joint.Features.of(x.min(0), x.max(0), 0.8), x, far, a, np.full(40, 1 / 40), 0.0, 20) is None
    assert joint.Features.of([0.0], [1e6], 0.1) is None


def test_large_clouds_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(joint, "_in_rounds", None)
    monkeypatch.setattr(joint, "entropic", None)
    runs = spark.range(20_000).select(F.col("id").alias("run_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.lit(0.0).alias("level"), F.rand(3).alias("u"))
    y = F.explode(F.array(F.struct(F.lit(0).alias("o"), (F.col("a") + F.col("u")).alias("y")), F.struct(F.lit(1).alias("o"), (F.col("b") - F.col("u")).alias("y")))).alias("s")
    outputs = runs.select("run_id", y).select("run_id", "s.*")
    p = Problem({"a": Uniform(), "b": Uniform()})
    with pytest.warns(UserWarning, match="settle"):
        got = analyze("optimal_transport", p, outputs, runs, slices=["o"], mode="multivariate", n_classes=3, epsilon=0.2, max_iter=12, tol=0.0).to_pandas().set_index("param")
    assert (got.ot > got.advective).all() and got.unconverged.tolist() == [3, 3]
