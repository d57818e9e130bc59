import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import same_rows

from gaugeworks.llm import ann, queries, topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, id int"
NAN, INF = float("nan"), float("inf")


def odd(spark):
    """Good rows, ties and a repeated vector, and rows that take no part."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    rows += [(i, rows[3][1]) for i in range(100, 140)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [NAN, 0.0, 0.0, 1.0]), (203, [INF, 0.0, 0.0, 1.0]), (None, rows[0][1]), (204, [])]
    return rows, spark.createDataFrame([(*r, None, 1.0, 2) for r in rows], SCHEMA)


def good(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]


def first(scores, k):
    return [(r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]


def test_top_k_against_brute_force(spark):
    rows, df = odd(spark)
    whole = [(i, np.floor(1024 * v).astype(int)) for i, v in good(rows)]
    want = {(q, *x) for q, a in whole if q % 10 == 0 for x in first([(int(a @ b), i) for i, b in whole if i != q], 10)}
    assert {tuple(r) for r in topk.highest(df, F.col("id") % 10 == 0).collect()} == want
    assert topk.highest(df.limit(0), F.col("id") % 10 == 0).count() == 0


@pytest.mark.parametrize("n", [5, 300, 3000])
def test_no_random_access_is_exact(n):
    rng = np.random.default_rng(n)
    x = np.floor(rng.normal(size=(n, 8)) * 20).astype(np.int64)
    x[n // 2 :] = x[: n - n // 2]
    order = np.ascontiguousarray(np.argsort(x, 0, kind="stable").T)
    values = np.stack([x[order[d], d] for d in range(8)])
    for q in [*x[:20], x[0] * 0]:
        got, score = topk.nra(order, values, q, 10, np.arange(n))
        want = np.lexsort((np.arange(n), -(x @ q)))[:10]
        assert got.tolist() == want.tolist() and score.tolist() == (x @ q)[want].tolist()
        floor = int(score[len(score) // 2])  # what reaches a bound that is known before stays
        some, reached = topk.nra(order, values, q, 10, np.arange(n), floor)
        assert some[reached >= floor].tolist() == want[score >= floor].tolist()


def test_shards_and_rounds(spark, monkeypatch):
    """Many shards and batches, a first round whose scores bound the others, and columns with clashing names."""
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 1, "x") for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id int, `a.b` string")
    whole = np.floor(1024 * np.array([r[1] for r in rows])).astype(int)
    want = {(q, *x) for q in range(0, 700, 10) for x in first([(int(whole[q] @ whole[i]), i) for i in range(700) if i != q], 10)}
    assert {tuple(r) for r in topk.highest(df, F.col("id") % 10 == 0).collect()} == want


def test_top_k_against_sql(spark, sf):
    same_rows(queries.QUERIES["op8_exact_top_k"](spark, sf), queries.ORACLE_SQL["op8_exact_top_k"], sf)


def test_pseudo_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(20, 50))
    y = ann.rotated(x, 3)
    assert y.shape == (20, 64) and np.allclose((y * y).sum(1), (x * x).sum(1))
    h = ann.heights(x, 1, 2, ann.SEED)
    code = ann.buckets(x, 1, 2)
    assert len(h) == 2 and (code // 128 == h[0].argmax(1)).all() and (code % 128 == h[1].argmax(1)).all()
    sums = (h[0][0][:, None] + h[1][0][None]).ravel()
    order = np.argsort(-sums)
    assert set(ann.probed([y[0] for y in h], 50)) == set(order[:50]) and code[0] == order[0]
    assert [ann.place([y[0] for y in h], int(order[i])) for i in (0, 7, 300)] == [1, 8, 301]


def test_nearest_odd_rows(spark):
    rows, df = odd(spark)
    df = df.union(spark.createDataFrame([(300, [0.0] * 4, None, 1.0, 2)], SCHEMA))
    some = good(rows)
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    got = {}
    for r in ann.nearest(df, F.col("id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i, _ in some if i % 10 == 0}
    by = dict(some)
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(i != q and abs(s - cos(by[q], by[i])) < 1e-12 for _, i, s in found)
    # A query that equals forty others has the five of them with the smallest ids.
    assert [i for _, i, _ in sorted(got[100])] == [3, 101, 102, 103, 104]
    assert ann.nearest(df.limit(0), F.col("id") % 10 == 0).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    """Over all queries of a table, none of which was left out of the search."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(rows.embedding).astype(float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ids = rows.vec_id.to_numpy()
    got = {(r.query_id, r.vec_id) for r in queries.QUERIES["op5_nearest_neighbours"](spark, folder).collect()}
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        near = ids[np.lexsort((ids, -s))[:5]]
        hits, total = hits + sum((ids[i], j) in got for j in near), total + 5
    assert len(got) == total and hits >= 0.9 * total


def test_structured_vectors_need_few_probes(spark):
    """Clusters of 256-dimensional vectors: few probes are fitted, a query meets a small part, and recall holds."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 256))
    x = np.repeat(centres, 20, 0) + 0.15 * rng.normal(size=(3000, 256))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, `a.b` string")
    kinds = df.selectExpr("vec_id AS c", "embedding AS v")
    asked = df.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS v")
    probes = ann.fitted(asked, kinds, 5, ann.TABLES, 2, ann.SEED, ann.RECALL, ann.FITTED)
    assert probes < 512**2 / 100
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("id") % 50 == 0).collect()}
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = unit[::50] @ unit.T
    s[np.arange(60), np.arange(0, 3000, 50)] = -9
    near = [(50 * q, int(i)) for q in range(60) for i in np.argsort(-s[q])[:5]]
    assert sum(p in got for p in near) >= 0.9 * len(near)
