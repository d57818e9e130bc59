"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by fast pseudo-rotations (three rounds of random signs and a Hadamard
transform) and files a vector under the nearest signed axes of ``POLYTOPES`` of them together. A query probes
the buckets whose axes are nearest in sum; what it meets there is ranked by exact cosine. Every row is filed;
equal vectors are filed once for all. How many buckets a query probes is fitted: on a bounded sample of the
queries, whose nearest rows are found by brute force, so that tables of any width or structure reach the
wanted recall, and structured ones with few probes.

Buckets are dealt to blocks of neighbouring buckets. A query travels to the blocks that hold one of its
buckets, compares itself with the rows of those buckets only, and only its best rows of a block leave the task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import best, classes, usable

TABLES, POLYTOPES, SEED = 4, 2, 20
#: Most vectors of a block; queries that the number of probes is fitted on, and the recall that it should have there.
BLOCK, FITTED, RECALL = 16_384, 128, 0.97


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row, by halving steps; rows have a power of two of entries."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Rows of ``x`` after pseudo-rotation number ``table``, padded with zeros to a power of two."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, n))
    for s in signs:
        out = hadamard(out * s)
    return out


def heights(x: np.ndarray, table: int, polytopes: int, seed: int) -> list[np.ndarray]:
    """For each polytope of a table, each row's heights over all signed axes: the axis, plus the dimension if it is negative."""
    turned = [rotated(x, table * polytopes + k, seed) for k in range(polytopes)]
    return [np.concatenate([y, -y], 1) for y in turned]


def buckets(x: np.ndarray, table: int, polytopes: int = POLYTOPES, seed: int = SEED) -> np.ndarray:
    """The bucket of each row: its nearest axes, as one number."""
    code = np.zeros(len(x), np.int64)
    for h in heights(x, table, polytopes, seed):
        code = code * h.shape[1] + h.argmax(1)
    return code


def probed(h: list[np.ndarray], probes: int) -> np.ndarray:
    """The ``probes`` buckets whose axes have the largest sums of heights, for one query's heights by polytope."""
    total, code = np.zeros(1), np.zeros(1, np.int64)
    for own in h:
        total = (total[:, None] + own[None]).ravel()
        code = (code[:, None] * len(own) + np.arange(len(own))[None]).ravel()
        if len(total) > probes:  # the best sums extend the best of the sums before
            keep = np.argpartition(-total, probes - 1)[:probes]
            total, code = total[keep], code[keep]
    return code


def place(h: list[np.ndarray], code: int) -> int:
    """How many probes a query needs until it meets a bucket."""
    wide, axes = len(h[0]), []
    for _ in h:
        axes.insert(0, code % wide)
        code //= wide
    target = sum(own[a] for own, a in zip(h, axes))
    sums = np.zeros(1)
    for own in h[:-1]:
        sums = (sums[:, None] + own[None]).ravel()
    last = np.sort(h[-1])
    return 1 + int((len(last) - np.searchsorted(last, target - sums + 1e-12, "right")).sum())


def _unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(1, keepdims=True)
    v = v / top
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, each summed in the same order."""
    return np.clip((_unit(rows) * _unit(q[None])).sum(1), -1.0, 1.0)


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def fitted(asked: DataFrame, kinds: DataFrame, k: int, tables: int, polytopes: int, seed: int, recall: float, most: int) -> int:
    """Probes for each table with which about ``most`` of the queries, picked by a hash, meet ``recall`` of their ``k`` nearest rows.

    Their nearest rows are found by brute force: what reaches the driver are ``most`` queries and ``k`` vectors for
    each.
    """
    sample = asked.orderBy(F.xxhash64(F.lit(seed), "query_id", "v")).limit(most).toPandas()
    if not len(sample):
        return 1
    sizes, kind = sample.v.map(len), dict(kinds.dtypes)["v"]

    def nearest_of(frames):
        for f in frames:
            for size in set(f.v.map(len)) & set(sizes) if len(f) else ():
                part, own = f[f.v.map(len) == size], sample[sizes == size]
                score = _unit(_stack(own.v)) @ _unit(_stack(part.v)).T
                for i, (s, q) in enumerate(zip(score, own.index)):
                    at = np.argsort(-s)[: k + 1]
                    yield pd.DataFrame({"q": q, "score": s[at], "v": part.v.iloc[at].tolist()})

    rows = best(kinds.select("v").mapInPandas(nearest_of, f"q bigint, score double, v {kind}").withColumn("vec_id", F.xxhash64("v")), k + 1, by=("q",)).toPandas()
    need = []
    for q, part in rows.groupby("q"):
        own = np.asarray(sample.v[q], float)[None]
        near = _stack(part.sort_values("rank").v)
        near = near[~(near == own).all(1)][:k]
        if len(near):
            h = [[y[0] for y in heights(_unit(own), t, polytopes, seed)] for t in range(tables)]
            codes = [buckets(_unit(near), t, polytopes, seed) for t in range(tables)]
            need += [min(place(h[t], int(codes[t][i])) for t in range(tables)) for i in range(len(near))]
    return sorted(need)[min(len(need) - 1, math.ceil(recall * len(need)))] if need else 1


def _filed(kinds: DataFrame, tables: int, groups: int, polytopes: int, seed: int) -> DataFrame:
    """Rows ``(c, v)`` for each table, with ``(t, g)``, the group of buckets that theirs is in, and ``size``."""
    kind = dict(kinds.dtypes)["v"]

    def kernel(frames):
        for f in frames:
            for size, part in f.groupby(f.v.map(len)) if len(f) else ():
                x = _unit(_stack(part.v))
                wide = 2 << max(0, (int(size) - 1).bit_length())
                for t in range(tables):
                    yield pd.DataFrame({"c": part.c, "v": part.v, "size": int(size), "t": t, "g": buckets(x, t, polytopes, seed) * groups // wide**polytopes})

    return kinds.select("c", "v").mapInPandas(kernel, f"c bigint, v {kind}, size int, t int, g bigint")


def _sent(asked: DataFrame, tables: int, groups: int, probes: int, polytopes: int, seed: int) -> DataFrame:
    """Queries ``(query_id, v)`` for each table and group of buckets that they probe one of."""
    kind = dict(asked.dtypes)["v"]

    def kernel(frames):
        for f in frames:
            for size, part in f.groupby(f.v.map(len)) if len(f) else ():
                x = _unit(_stack(part.v))
                for t in range(tables):
                    h = heights(x, t, polytopes, seed)
                    wide = h[0].shape[1]
                    to = [np.unique(probed([y[i] for y in h], probes) * groups // wide**polytopes) for i in range(len(part))]
                    at = np.repeat(np.arange(len(part)), [len(g) for g in to])
                    yield pd.DataFrame({"query_id": part.query_id.to_numpy()[at], "v": part.v.to_numpy()[at], "size": int(size), "t": t, "g": np.concatenate(to)})

    return asked.mapInPandas(kernel, f"query_id bigint, v {kind}, size int, t int, g bigint")


def _ranked(queries: DataFrame, index: DataFrame, k: int, probes: int | None, polytopes: int, seed: int) -> DataFrame:
    """``(query_id, c, score, met)``: of each block, each query's ``k`` classes with the largest cosine, ties included, and how many it met.

    A query meets the rows of the buckets that it probes, or all of the block if ``probes`` is None.
    """

    def rank(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "c": [], "score": [], "met": []}
        if len(left) and len(right):
            rows, qs, cs = _stack(right.v), _stack(left.v), right.c.to_numpy()
            units, t = _unit(rows), int(key[1])
            own = _unit(qs)
            if probes is not None:
                code, h = buckets(units, t, polytopes, seed), heights(own, t, polytopes, seed)
            for i, qid in enumerate(left.query_id):
                at = np.arange(len(rows)) if probes is None else np.flatnonzero(np.isin(code, probed([y[i] for y in h], probes)))
                if not len(at):
                    continue
                near, met = units[at] @ own[i], len(at)
                if met > k:
                    at = at[near >= np.partition(near, -k)[-k] - 1e-9]
                out["query_id"] += [qid] * len(at)
                out["c"] += cs[at].tolist()
                out["score"] += cosines(qs[i], rows[at]).tolist()
                out["met"] += [met] * len(at)
        return pd.DataFrame(out)

    keys = ["size", "t", "g", "block"]
    return queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(rank, "query_id bigint, c bigint, score double, met bigint")


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int | None = None, polytopes: int = POLYTOPES, seed: int = SEED, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query`` (a condition on ``id``) holds, its ``k`` nearest found among all other rows.

    Without ``probes``, their number is ``fitted`` to ``recall``. Larger tables take more ``polytopes``, so that
    buckets stay small. Largest cosine first, ties to the smaller id. Rows with a null id, a vector that is null,
    empty, zero or of another length than a query's, or a component that is null or not finite, take no part. Rows
    that repeat an id are rows of their own, but none is its own id's neighbour. A query that met fewer than ``k``
    rows is searched against all of them, so fewer come back only where there are fewer. An empty table
    gives no rows; other columns are not read.
    """
    rows = usable(rows, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    kinds = cut(classes(rows, k + 1))
    kinds = kinds.select(F.xxhash64("key").alias("c"), "v", "ids")
    asked = cut(rows.where(is_query).select(F.col("id").alias("query_id"), "v").dropDuplicates(["query_id", "v"]))
    if probes is None:
        probes = fitted(asked, kinds, k, tables, polytopes, seed, recall, FITTED)
    groups = max(1, math.ceil(kinds.count() / BLOCK))
    index = _filed(kinds, tables, groups, polytopes, seed)
    blocks = cut(index.groupBy("size", "t", "g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    filed = index.join(blocks, ["size", "t", "g"]).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = _sent(asked, tables, groups, probes, polytopes, seed).join(blocks, ["size", "t", "g"]).withColumn("block", every)
    out = cut(_members(_ranked(sent, filed, k + 1, probes, polytopes, seed), kinds, k))
    # Queries that met too few are searched in every bucket of one table, where each class is filed once.
    there = rows.count() - 1
    have = out.groupBy("query_id").agg(F.count("*").alias("n"))
    short = cut(asked.join(have, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(k, there)).drop("n"))
    if there > 0 and short.count():
        whole = short.withColumn("size", F.size("v")).join(blocks.where("t = 0"), "size").withColumn("block", every)
        more = _ranked(whole, filed.where("t = 0"), k + 1, None, polytopes, seed)
        out = out.join(short.select("query_id"), "query_id", "left_anti").unionByName(_members(more, kinds, k))
    return out


def _members(found: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """Rows behind the classes found, without the query's own, and the best of them."""
    once = found.groupBy("query_id", "c").agg(F.max("score").alias("score"))
    few = best(once.withColumnRenamed("c", "vec_id"), k + 1).withColumnRenamed("vec_id", "c").drop("rank")
    # Ties between classes at the end of the list go by their rows' ids, so classes as near as the last one stay.
    last = few.groupBy("query_id").agg(F.min("score").alias("last"))
    tied = once.join(last, "query_id").where("score >= last").drop("last")
    rows = tied.join(kinds.select("c", "ids"), "c").select("query_id", F.explode("ids").alias("vec_id"), "score")
    return best(rows.where("vec_id <> query_id"), k).select("query_id", "rank", "vec_id", "score")
