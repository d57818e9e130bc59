"""Centres of kernel fits: rounds over the table choose what one task with all rows chooses, and plain code agrees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import greedy
from gaugeworks.operators import surrogates as sg
from gaugeworks.problem import Problem, Uniform

P = Problem({"a": Uniform(), "b": Uniform(), "c": Uniform()})


def frame(n=500, seed=4):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame(rng.random((n, 3)), columns=P.names)
    f.loc[n // 2 : n // 2 + 20, P.names] = f.loc[3, P.names].to_numpy()  # copies of a run
    f["y"] = f.a + np.sin(5 * f.b) + f.a * f.c + 0.01 * rng.normal(size=n)
    f["fold"] = rng.integers(0, 4, n).astype(float)
    return f


def plain(u, gamma, most):
    """The power function of every row anew for each centre, from whole kernel matrices."""
    order = np.lexsort(u.T[::-1])
    chosen = []
    for _ in range(most):
        if chosen:
            k = sg.gaussian_kernel(u[chosen], u[chosen], gamma)
            at = sg.gaussian_kernel(u, u[chosen], gamma)
            power = 1 - (at * np.linalg.solve(k, at.T).T).sum(1)
        else:
            power = np.ones(len(u))
        chosen.append(int(order[np.argmax(power[order])]))
    return u[chosen]


@pytest.mark.parametrize("gamma", [0.5, 6.0, 40.0])
def test_rounds_choose_the_centres_of_one_task(spark, monkeypatch, gamma):
    monkeypatch.setattr(greedy, "POOL", 60)
    f = frame()
    units = spark.createDataFrame(f).repartition(5)
    problems = [(gamma, None), (gamma, 2)]
    one = greedy.solved(units, P.names, problems, 14, len(f))
    many = greedy.solved(units, P.names, problems, 14, len(f), held=0)
    for (_, fold), a, b in zip(problems, one, many):
        own = f if fold is None else f[f.fold != fold]
        assert np.array_equal(a.chosen.points, b.chosen.points) and np.array_equal(a.chosen.points, plain(own[P.names].to_numpy(), gamma, 14)[: len(a.chosen.y)])
        assert np.allclose(a.train, b.train, atol=1e-6) and np.allclose(a.held, b.held, atol=1e-6)
        assert len(np.unique(a.chosen.points, axis=0)) == len(a.chosen.points) == 14


def test_choice_ends_when_nothing_is_left(spark, monkeypatch):
    monkeypatch.setattr(greedy, "POOL", 40)
    f = frame(200)
    f["y"] = np.exp(-0.3 * ((f[P.names] - 0.4) ** 2).sum(1)) * 3  # a kernel's own shape is met by few centres
    units = spark.createDataFrame(f).repartition(3)
    one, many = (greedy.solved(units, P.names, [(0.3, None)], 150, 200, held=h)[0].chosen for h in (None, 0))
    assert len(one.y) == len(many.y) < 60 and np.array_equal(one.points, many.points)
    v = one.basis(f[P.names].to_numpy())
    newton = greedy.forward(one.factor, one.y[:, None])[:, 0]
    left = [np.linalg.norm(f.y - v[:, :m] @ newton[:m]) / np.linalg.norm(f.y) for m in (len(one.y) - 1, len(one.y))]
    assert left[1] <= greedy.RESIDUAL < left[0]


def test_few_and_equal_rows(spark):
    f = frame(60)
    f[P.names] = f[P.names].iloc[0].to_numpy()
    units = spark.createDataFrame(f)
    for held in (None, 0):
        got = greedy.solved(units, P.names, [(1.0, None), (1.0, 9)], 30, 60, held=held)
        assert [len(g.chosen.y) for g in got] == [1, 1]


def test_search_holds_folds_out(spark):
    """Held-out rows are no centres, and the chosen pair has the least error of plain fits."""
    f = frame(240)
    runs = spark.createDataFrame(f.drop(columns="fold"))
    gammas, ridges = (0.3, 3.0), (1e-8, 1e-2)
    fit = sg.vkoga(runs, P, gammas=gammas, ridges=ridges, max_centres=40, folds=4, seed=1)
    again = sg.vkoga(runs, P, gammas=gammas, ridges=ridges, max_centres=40, folds=4, seed=1, held=0)
    assert (fit.gamma, fit.ridge) == (again.gamma, again.ridge) and fit.cv_rmse == pytest.approx(again.cv_rmse, rel=1e-5)
    folds = runs.select("*", F.pmod(F.xxhash64(F.lit(1), *P.names, "y"), F.lit(4)).alias("fold")).toPandas()
    u, y = folds[P.names].to_numpy(), (folds.y - folds.y.mean()).to_numpy()
    scores = {}
    for g in gammas:
        for r in ridges:
            sse = 0.0
            for k in range(4):
                on = (folds.fold != k).to_numpy()
                c = greedy.Chosen.none(g, k, 3)
                greedy.choose(c, np.column_stack([u, y])[on], 40)
                v = c.basis(u)
                beta = np.linalg.solve(v[on].T @ v[on] + r * np.eye(v.shape[1]), v[on].T @ y[on])
                sse += ((y - v @ beta)[~on] ** 2).sum()
            scores[g, r] = sse
    assert min(scores, key=scores.get) == (fit.gamma, fit.ridge) and fit.cv_rmse == pytest.approx(np.sqrt(min(scores.values()) / len(y)), rel=1e-3)
    alone = sg.vkoga(runs, P, gammas=(fit.gamma,), ridges=(fit.ridge,), max_centres=40)
    assert np.allclose(alone.weights, fit.weights) and np.isnan(alone.cv_rmse)
    value = alone.predict(runs).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), F.lit(2.0)))).alias("e")).first().e
    assert value == pytest.approx(alone.rmse, rel=1e-4)


def test_large_search_is_done_in_tasks(spark, monkeypatch):
    """Rows that a task can hold need no rounds, however many numbers their basis has; few powers are looked at for each centre."""
    monkeypatch.setattr(greedy, "_in_rounds", None)
    looked, powers = [], greedy.Chosen.powers
    monkeypatch.setattr(greedy.Chosen, "powers", lambda self, u, v: looked.append(len(u)) or powers(self, u, v))
    rng = np.random.default_rng(7)
    rows = np.column_stack([rng.random((40_000, 3)), rng.normal(size=40_000)])
    c = greedy.Chosen.none(20.0, None, 3)
    gram = greedy.choose(c, rows, 100)
    assert len(c.y) == 100 and sum(looked) < 0.2 * 100 * len(rows)
    assert np.array_equal(c.points[:8], plain(rows[:, :3], 20.0, 8)) and np.allclose(gram, greedy.summed(c, rows))
    units = spark.range(150_000).select(*[F.rand(k).alias(p) for k, p in enumerate(P.names)], F.rand(9).alias("y"), F.lit(0.0).alias("fold"))
    assert len(greedy.solved(units, P.names, [(5.0, None)], 200, 150_000)[0].chosen.y) == 200


@pytest.mark.parametrize("gamma", [0.05, 5.0, 60.0])
def test_stored_basis_chooses_the_same(monkeypatch, gamma):
    """Centres from a pool beside a stored basis are those of looks at single powers, with copies of rows and small pools."""
    rows = frame(3000, 8)[[*P.names, "y"]].to_numpy()
    monkeypatch.setattr(greedy, "_take", None)
    made = []
    for pooled in (40, 5000):
        monkeypatch.setattr(greedy, "POOLED", pooled)
        made.append(greedy.Chosen.none(gamma, None, 3))
        gram = greedy.choose(made[-1], rows, 60)
        assert np.allclose(gram, greedy.summed(made[-1], rows), rtol=1e-6, atol=1e-6)
    monkeypatch.undo()
    monkeypatch.setattr(greedy, "STORED", 0)
    looked = greedy.Chosen.none(gamma, None, 3)
    greedy.choose(looked, rows, 60)
    for c in made:
        assert len(c.y) == len(looked.y) and np.array_equal(c.points[:25], looked.points[:25])
        if gamma > 1:
            assert np.array_equal(c.points, looked.points) and np.allclose(c.factor, looked.factor)


def test_search_passes_errors_on(spark, monkeypatch):
    """Tasks of a search give back errors of held-out rows, not the sums of their folds; one job has the fit of all rows too."""
    f = frame(240)
    units, calls, tasks = spark.createDataFrame(f), [], greedy._in_tasks
    monkeypatch.setattr(greedy, "_in_tasks", lambda *a: calls.append(tasks(*a)) or calls[-1])
    fit, gamma, ridge, sse = greedy.searched(units, P.names, [0.3, 3.0], [1e-8, 1e-2], 40, 4, 240)
    (found,) = calls
    assert len(found) == 10 and sum(isinstance(x, list) for x in found) == 8
    many = greedy.searched(units, P.names, [0.3, 3.0], [1e-8, 1e-2], 40, 4, 240, held=0)
    assert (gamma, ridge) == many[1:3] and sse == pytest.approx(many[3], rel=1e-5) and np.array_equal(fit.chosen.points, many[0].chosen.points)
