"""Exact top-k by inner product with no-random-access aggregation.

Rows are dealt to shards, each of which is sorted once and kept: in a shard, each dimension is a list of its
rows in order of value. For a query, reading a list from the end that the sign of the query's component says
gives contributions in falling order. All lists are read in step, and nothing is looked up. A row's score lies
between bounds: what has been read of it, plus, for each list that has not shown it, that list's least
contribution, or the one read last. Reading stops when no outsider's upper bound reaches the k-th lower bound;
then the scores of the few rows left are resolved.

Shards are read in rounds. The k-th score that a query has after a round is a lower bound for all later ones,
so that lists of later shards are left early, most of them where no row can reach it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .vectors import best, usable

#: Rows of a shard, and queries that meet it in one task; of so many shards, one is read in the first round.
SHARD, QUERIES, FIRST = 8192, 1024, 4
#: Steps in which a list is read; of a shard's rows, one in so many may be left when reading stops, to be resolved.
STEPS, FEW = 10, 16
#: Shards, if there are so many times ``QUERIES`` rows, so that small tables are no few tasks' work.
LEAST = 16
NONE = -(1 << 62)


def nra(order: np.ndarray, values: np.ndarray, q: np.ndarray, k: int, ids: np.ndarray, floor: int = NONE) -> tuple[np.ndarray, np.ndarray]:
    """``(places, scores)`` of the ``k`` rows with the highest inner product with ``q``, ties to smaller ``ids``.

    ``order`` and ``values`` are, for each dimension, the places in rising order of value and the values in that
    order. Rows below ``floor`` may be left out. A row whose upper bound equals the bound that it must reach may tie,
    and stays. Scores of the rows that are left when no other can qualify are resolved from all lists, in whole numbers.
    """
    n, used = order.shape[1], np.flatnonzero(q)
    k = min(k, n)
    if not len(used):
        return _top(np.arange(n), np.zeros(n, np.int64), ids, k)
    # Each list is read from the end that has its largest contributions: these by rising, those by falling value.
    up, down = used[q[used] < 0], used[q[used] > 0]
    weight = np.concatenate([q[up], q[down]]).astype(float)[:, None]
    read = lambda lists, at, upto: np.concatenate([lists[up, at:upto], lists[down, n - upto : n - at][:, ::-1]])
    least = read(values, n - 1, n) * weight
    low, shown = np.full(n, float(least.sum())), np.zeros((len(used), n), np.float32)
    slack = 1 + 1e-5 * float((read(values, 0, 1) * weight - least).sum()) + 1e-9 * abs(low[0])  # of the bounds' sums
    at, step, rows = 0, max(64, n // STEPS), np.arange(len(used))[:, None]
    while at < n:
        upto = min(n, at + step)
        places, extra = read(order, at, upto), read(values, at, upto) * weight - least
        low += np.bincount(places.ravel(), extra.ravel(), n)
        shown[rows, places] = 1.0
        kth = max(float(floor), float(np.partition(low, n - k)[n - k]))
        front = extra[:, -1] if upto < n else np.zeros(len(used))
        high = low + (front.sum() - front.astype(np.float32) @ shown)
        hopeful = np.flatnonzero(high >= kth - slack)
        at, step = upto, step + step // 2
        if len(hopeful) <= max(4 * k, n // FEW):
            break
    wanted = np.zeros(n, bool)
    wanted[hopeful] = True
    d, i = np.nonzero(wanted[order[used]])
    score = np.zeros(n, np.int64)
    np.add.at(score, order[used[d], i], values[used[d], i] * q[used[d]])
    return _top(hopeful, score[hopeful], ids, k)


def _top(places: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.lexsort((ids[places], -score))[:k]
    return places[first], score[first]


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """``(s, size, n, ids, order, sorted)``: shards of rows ``(id, v, size)``, each with its sorted lists."""

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(f.v.to_numpy()).astype(np.int64), f.id.to_numpy(np.int64)
        order = np.ascontiguousarray(np.argsort(x, 0, kind="stable").T)
        lists = np.stack([x[order[d], d] for d in range(x.shape[1])])
        narrow = np.min_scalar_type(int(max(lists.max(), -lists.min() - 1))) if len(lists) else np.dtype("u1")
        kind = {1: "<i2", 2: "<i4", 4: "<i8", 8: "<i8"}[narrow.itemsize]
        return pd.DataFrame({"s": f.s[:1], "size": f["size"][:1], "n": [len(f)], "kind": [kind], "ids": [ids.tobytes()], "order": [order.astype("<u4").tobytes()], "sorted": [lists.astype(kind).tobytes()]})

    dealt = rows.withColumn("s", F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    schema = "s int, size int, n int, kind string, ids binary, order binary, sorted binary"
    return written(dealt.groupBy("s", "size").applyInPandas(pack, schema), "shards")


def _searched(shards: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the best rows of each shard for each query of batches ``(b, size, ids, floors, vectors)``."""
    # A task for each shard: a number of partitions that is asked for isn't made less, however few bytes there are.
    each = queries.withColumnRenamed("ids", "asked").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, "s")
    pairs = shards.repartition(n, "s").join(each, ["s", "size"])

    def search(frames):
        for f in frames:
            for r in f.itertuples():
                ids, d = np.frombuffer(r.ids, "<i8"), r.size_
                order, values = np.frombuffer(r.order, "<u4").reshape(d, -1), np.frombuffer(r.sorted, r.kind).reshape(d, -1).astype(np.int64)
                asked, floors = np.frombuffer(r.asked, "<i8"), np.frombuffer(r.floors, "<i8")
                own, found = pd.Series(ids).value_counts(), []
                for qid, floor, q in zip(asked.tolist(), floors.tolist(), np.frombuffer(r.vectors, "<i8").reshape(-1, d)):
                    places, score = nra(order, values, q, k + int(own.get(qid, 0)), ids, floor)
                    keep = (ids[places] != qid) & (score >= floor)
                    found.append((np.full(keep.sum(), qid)[:k], ids[places[keep]][:k], score[keep][:k]))
                if found:
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    cols = ["n", "kind", F.col("size").alias("size_"), "ids", "order", "sorted", "asked", "floors", "vectors"]
    return pairs.select(*cols).mapInPandas(search, "query_id bigint, vec_id bigint, score bigint")


def highest(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query`` (a condition on ``id``) holds, the ``k`` others of the highest score.

    Components become ``floor(scale * x)``; the score is the integer inner product, ties go to the smaller id.
    Batches of queries meet all rows shard by shard, and each shard returns ``k`` rows at most for a query. Rows
    with a null id or a vector that is null, empty or has null or non-finite components take no part; vectors of
    another length than the query's are no candidates. A row is never its own id's candidate. Rows that repeat an
    id are candidates of their own, and queries that repeat one are asked once if equal. An empty table gives no
    rows; other columns are not read.
    """
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    rows = cut(usable(rows, id_col, vec_col).select("id", whole.alias("v"), F.size("v").alias("size")))
    total = rows.count()
    n = max(1, -(-total // SHARD), min(LEAST, -(-total // QUERIES)))
    shards = _packed(rows, n)
    asked = cut(rows.where(is_query).dropDuplicates(["id", "v"]))
    m = max(1, -(-asked.count() // QUERIES))
    batch = F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(m)).cast("int")

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f.v.to_numpy()).astype("<i8")
        return pd.DataFrame({"b": f.b[:1], "size": f["size"][:1], "ids": [f.id.to_numpy("<i8").tobytes()], "floors": [f.floor.to_numpy("<i8").tobytes()], "vectors": [x.tobytes()]})

    def batches(floors: DataFrame | None) -> DataFrame:
        known = asked.withColumn("floor", F.lit(NONE)) if floors is None else asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
        return known.withColumn("b", batch).groupBy("b", "size").applyInPandas(pack, "b int, size int, ids binary, floors binary, vectors binary")

    first = F.col("s") < max(1, n // FIRST)
    begun = cut(best(_searched(shards.where(first), batches(None), n, k), k))
    floors = begun.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    later = _searched(shards.where(~first), batches(floors), n, k)
    return best(begun.drop("rank").unionByName(later), k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL with the rows of ``highest`` where an id is divisible by 100.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
