"""Vector tables: rows that take part in a search, classes of equal vectors, and the best rows of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an equal class are first ranked in so many parts, so that one hot vector is no single task's work.
PARTS = 64


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` with ``v`` as doubles (floats stay), without null ids, null or empty vectors, and null or non-finite components."""
    rows, (id_, vec) = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]), [f"c{rows.columns.index(c)}" for c in (id_col, vec_col)]
    v = F.col(vec) if dict(rows.dtypes)[vec] == "array<float>" else F.col(vec).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_).cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(~odd)


def classes(rows: DataFrame, most: int) -> DataFrame:
    """Rows ``(id, v)`` by equal vector: ``(key, v, ids)`` with the ``most`` smallest ids, ascending.

    No result that takes ``most`` rows or fewer can need more of one class.
    """
    keyed = rows.withColumn("key", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(5), "v")))
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    some = keyed.withColumn("r", F.row_number().over(Window.partitionBy("key", part).orderBy("id"))).where(F.col("r") <= most)
    few = some.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= most)
    return few.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def best(found: DataFrame, k: int, score: str = "score", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The ``k`` rows of each query with the highest score, ties to the smaller ``vec_id``, with ``rank`` from 1."""
    order: list[Column] = [F.col(score).desc(), F.col("vec_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col("rank") <= k)
