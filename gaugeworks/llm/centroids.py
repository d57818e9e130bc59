"""Centroid clustering of whole-number vectors by partial-distance search.

Vectors are rounded down to multiples of a step, so that distances, sums and means are exact whole numbers and no result depends on the
order of rows. A task takes squared differences over a few dimensions at a time, those of highest variance first, and
abandons a centroid for a vector once its sum so far is strictly above the vector's best whole distance; what
survives finishes all dimensions. Only sums and counts by cluster leave a task in a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sheltered, written

#: Dimensions summed before centroids are abandoned, and vectors compared at once.
STEP, BLOCK = 8, 2048
#: Components beyond this, in steps, would take a squared distance out of the range of 64 bits.
MOST = 1 << 27


def whole_vectors(rows: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``(id, q)``: vectors with exactly ``dims`` components, none null or not finite, each as ``floor(scale * x)``, ``x`` as double."""
    inner, of = sheltered(rows)
    x = F.col(of[vec_col])
    good = (F.size(x) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    q = F.transform(x, lambda c: F.when(F.abs(c) < MOST / scale, F.floor(c.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large"))).cast("int"))
    return inner.where(x.isNotNull() & good).select(F.col(of[id_col]).cast("bigint").alias("id"), q.alias("q"))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its squared distance, ties to the smaller number; dimensions come in the order given."""
    n, dims = vectors.shape
    part = np.zeros((n, len(centroids)), np.int64)
    for lo in range(0, min(STEP, dims)):
        part += (vectors[:, lo, None] - centroids[None, :, lo]) ** 2
    # The centroid that is best so far is finished first: it bounds the others.
    guess = part.argmin(1)
    rest = vectors[:, STEP:] - centroids[guess, STEP:]
    best = part[np.arange(n), guess] + (rest * rest).sum(1)
    row, own = np.nonzero(part <= best[:, None])
    sums = part[row, own]
    for lo in range(STEP, dims, STEP):
        d = vectors[row, lo : lo + STEP] - centroids[own, lo : lo + STEP]
        sums = sums + (d * d).sum(1)
        stays = sums <= best[row]
        row, own, sums = row[stays], own[stays], sums[stays]
    # Survivors stand in order of vector and centroid, all with whole distances of at most the bound.
    order = np.lexsort((own, sums, row))
    first = order[np.searchsorted(row[order], np.arange(n))]
    return own[first], sums[first]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _order(vectors: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by falling variance; sums of a whole table, a row for each dimension."""
    per = vectors.select(F.posexplode("q").alias("d", "x")).groupBy("d").agg(F.var_pop("x").alias("v")).collect()
    v = {r.d: r.v for r in per}
    return np.array(sorted(range(dims), key=lambda d: (-(v.get(d) or 0.0), d)))


def clustered(rows: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each vector's cluster after ``rounds`` of assigning vectors and moving centroids, and a last assignment.

    Centroids 0, 1, ... start as the ``k`` vectors with the smallest hashes of ``salt`` and id; each round moves those with
    vectors to the floor of their mean, the others stay. Columns: ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all), ``centroid_sha256`` (of the final centroid's
    components, joined by commas), ``centroid`` (array<bigint>, as whole numbers).

    Vectors that are null, of other length, or hold null or non-finite components are left out; a component of 2^27 steps or more raises, as
    distances would leave 64 bits. Fewer vectors than ``k`` give as many centroids. A null id is clustered and never a start;
    repeated rows count each, and of starts with one id those with smaller components come first. An empty table gives no
    row. Other columns are not carried.
    """
    spark = rows.sparkSession
    vectors = written(whole_vectors(rows, dims, scale, id_col, vec_col), "vectors")
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    starts = vectors.where("id IS NOT NULL").orderBy(hashed, "q").limit(k).collect()  # k vectors
    order = _order(vectors, dims)
    at = np.array([r.q for r in starts], np.int64).reshape(-1, dims)
    clusters = len(at)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts and sums by cluster."""
        counts, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dims), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                v = _matrix(b.slice(lo, BLOCK))
                own, _ = nearest(v[:, order], at[:, order])
                counts += np.bincount(own, minlength=clusters)
                np.add.at(sums, own, v)
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen]), pa.array(list(sums[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                own, distance = nearest(_matrix(part)[:, order], at[:, order])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    for _ in range(rounds if clusters else 0):
        per = vectors.mapInArrow(summed, "cluster int, n bigint, s array<bigint>")
        total = per.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims)])
        moved = at.copy()
        for r in total.collect():  # a row for each cluster
            moved[r.cluster] = [r[f"s{d}"] // r.n for d in range(dims)]
        at = moved
    shape = "vec_id bigint, cluster int, distance bigint"
    out = written(vectors.mapInArrow(assigned, shape), "assigned") if clusters else spark.createDataFrame([], shape)
    inertia = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    final = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest(), [int(x) for x in at[c]]) for c in sorted(inertia)]
    of = spark.createDataFrame(final, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return out.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")  # a row for each cluster


def sql(k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, salt: str = "2:") -> str:
    """The same rows in SQL, by whole distances to every centroid."""
    assign = lambda r: (
        f"d{r} AS (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM long v JOIN c{r} c USING (d) GROUP BY ALL),\n"
        f"a{r} AS (SELECT row, min(distance) AS distance, arg_min(cluster, distance * {k} + cluster) AS cluster FROM d{r} GROUP BY row)"
    )
    steps = [f"c0 AS (SELECT s.cluster, l.d, l.x FROM starts s JOIN long l USING (row))"]
    for r in range(rounds):
        moved = f"m{r} AS (SELECT a.cluster, l.d, floor(sum(l.x) / count(*))::BIGINT AS x FROM a{r} a JOIN long l USING (row) GROUP BY ALL)"
        steps += [assign(r), moved, f"c{r + 1} AS (SELECT c.cluster, c.d, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster, d))"]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
long AS MATERIALIZED (SELECT row, unnest(range({dims})) AS d, unnest(q) AS x FROM kept),
starts AS (SELECT row, (row_number() OVER (ORDER BY sha256('{salt}' || vec_id::VARCHAR), q) - 1)::INT AS cluster FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k}),
{", ".join(steps)},
{assign(rounds)},
final AS (SELECT cluster, list(x ORDER BY d) AS centroid FROM c{rounds} GROUP BY cluster)
SELECT k.vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia,
  sha256(list_aggregate(f.centroid, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (row) JOIN final f USING (cluster)"""
