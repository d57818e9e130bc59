import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import same_rows

from gaugeworks.llm import centroids, queries


def brute(vectors, k, rounds, scale, salt="2:"):
    """``{(id, copy): (cluster, distance, ...)}`` with every distance in full."""
    q = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in vectors]
    starts = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in q if i is not None)[:k]
    at = [v for _, v in starts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(v, c), n) for n, c in enumerate(at)) for _, v in q]
    for _ in range(rounds):
        own = assign()
        for n in range(len(at)):
            if part := [v for (_, v), (_, c) in zip(q, own) if c == n]:
                at[n] = [sum(x) // len(part) for x in zip(*part)]
    own = assign()
    inertia = [sum(d for d, c in own if c == n) for n in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((str(i), c, d, inertia[c], sum(inertia), sha[c], at[c]) for (i, _), (d, c) in zip(q, own)))


def test_partial_distances_are_exact():
    rng = np.random.default_rng(5)
    for n, k, dims, spread in ((500, 40, 64, 300), (300, 7, 64, 2), (50, 1, 8, 5), (64, 30, 20, 1)):
        v, c = (rng.integers(-spread, spread + 1, (m, dims)) for m in (n, k))
        c[k // 2] = c[0]  # a tie
        whole = ((v[:, None] - c[None]) ** 2).sum(2)
        own, d = centroids.nearest(v, c)
        assert (own == whole.argmin(1)).all() and (d == whole.min(1)).all()


def test_query_matches_sql(spark, sf):
    same_rows(queries.op12_centroid_clustering(spark, sf), queries.ORACLE_SQL["op12_centroid_clustering"], sf)


@pytest.mark.parametrize("k", [3, 60])
def test_odd_rows_against_brute_force(spark, k):
    rng = np.random.default_rng(6)
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(x) for x in np.float32(rng.normal(size=10))]) for i in range(30)]
    good += [(i, good[3][1]) for i in range(40, 50)] + [good[5], good[5], (None, good[7][1]), (4, good[8][1])]  # copies, repeated rows, a null id, an id twice
    bad = [(90, None), (91, []), (92, [0.5] * 9), (93, [None, *[0.5] * 9]), (94, [nan, *[0.5] * 9]), (95, [inf, *[0.5] * 9])]
    df = spark.createDataFrame([(*r, "x", 3, 1) for r in good + bad], "vec_id bigint, embedding array<float>, label string, cluster int, `a.b` int")
    got = sorted((str(r.vec_id), *tuple(r)[1:]) for r in centroids.clustered(df, k, 4, 16, 10).collect())
    assert got == brute(good, k, 4, 16)
    assert centroids.clustered(df.limit(0), k, 4, 16, 10).count() == 0


def test_too_large_raises(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(df, 2, 1, 16, 2).collect()
