"""Tables that the estimators work on: long inputs and outputs, ranks at any size, classes, failed runs."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = ["time_idx", "output_idx"]
#: Rows of a small table that is sent to every task.
SMALL = 200_000


def long_inputs(runs: DataFrame, names: Sequence[str], keep: Sequence[str] = ("run_id",)) -> DataFrame:
    """``(*keep, param, x)``: one row for each run and input."""
    return runs.unpivot(list(keep), list(names), "param", "x").withColumn("x", F.col("x").cast("double"))


def long_outputs(runs: DataFrame, outputs: Sequence[str], key: str = "run_id") -> DataFrame:
    """``(key, output_idx, y)`` from wide output columns; the index is the column's place."""
    rows = F.array(*[F.struct(F.lit(k).alias("output_idx"), F.col(c).cast("double").alias("y")) for k, c in enumerate(outputs)])
    return runs.select(key, F.explode(rows).alias("o")).select(key, "o.output_idx", "o.y")


def finite(y: str | Column) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))


def drop_invalid(rows: DataFrame, unit: Sequence[str], policy: str = "raise", min_kept: int = 1, y: str = "y") -> DataFrame:
    """Applies a policy to units of runs that hold an output that is null, NaN or infinite.

    ``raise`` raises if there is one, ``propagate`` keeps all, ``drop`` and ``skip`` leave whole units out by
    an anti join; fewer than ``min_kept`` units left raises, fewer than 10 warns.
    """
    if policy not in ("raise", "propagate", "drop", "skip"):
        raise ValueError(f"unknown policy {policy}")
    if policy == "propagate":
        return rows
    bad = rows.where(~finite(y)).select(*unit).distinct()
    if policy == "raise":
        if not bad.isEmpty():
            raise ValueError("outputs hold values that are not finite; choose another policy to go on")
        return rows
    left = rows if bad.isEmpty() else rows.join(bad, list(unit), "left_anti")
    n = left.select(*unit).distinct().count()
    if n < min_kept:
        raise ValueError(f"{n} units are left, {min_kept} are needed")
    if n < 10:
        warnings.warn(f"only {n} units are left", stacklevel=2)
    return left


def zero_variance(rows: DataFrame, slices: Sequence[str] = (), y: str = "y") -> DataFrame:
    """``(*slices, flat)``: whether all outputs of a slice are equal, or so near that their variance is zero."""
    flat = (F.max(y) == F.min(y)) | (F.var_pop(y) == 0)
    return rows.groupBy(*slices).agg(flat.alias("flat"))


def warn_flat(rows: DataFrame, method: str, slices: Sequence[str] = (), y: str = "y", most: int = 5) -> int:
    """Warns of constant slices, naming ``most`` of them, and returns their number."""
    flat = zero_variance(rows, slices, y).where("flat")
    n = flat.count()
    if n:
        names = ", ".join(str(tuple(r[c] for c in slices)) for r in flat.orderBy(*slices).limit(most).collect()) if slices else "the output"
        warnings.warn(f"{method}: {n} constant output slice{'s' if n > 1 else ''} ({names}); indices there are undefined", stacklevel=3)
    return n


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], rank: str = "rank", size: str = "n", finer: str | None = None, total: str | None = None) -> DataFrame:
    """``rows`` with ``rank`` from 0 within ``by`` in ``order``, and the group's ``size``, at any group size.

    A window over a few large groups would be a few tasks. Here rows are dealt by range of (by, order), ranked
    within a partition, and moved up by the sizes of the partitions before. Equal rows get ranks in any order.
    With ``finer``, a further column, also ``fine_rank`` and ``fine_size`` within (by, finer), from the same
    partitions; with ``total``, a number, also ``before``, its sum over the group's rows of lower rank.
    """
    from ..plans.lineage import cut, kept

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write = kept if len({c.lower() for c in rows.columns}) == len(rows.columns) else cut  # columns need names of their own
    dealt = write(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    out = dealt
    for keys, r, n, value in [(list(by), rank, size, total), *([([*by, finer], "fine_rank", "fine_size", None)] if finer else [])]:
        within = Window.partitionBy("_part", *keys).orderBy(*order)
        counts = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_c"), (F.sum(value) if value else F.lit(0)).alias("_t"))
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        moved = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in (("_c", "_o"), ("_t", "_b"))]
        offsets = cut(counts.select("_part", *keys, *moved, F.sum("_c").over(Window.partitionBy(*keys)).alias(n)))
        small = offsets.count() <= SMALL  # partitions and groups: as many groups as there are slices
        out = out.withColumn("_r", F.row_number().over(within) - 1)
        if value:
            out = out.withColumn("_s", F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        out = out.join(F.broadcast(offsets) if small else offsets, ["_part", *keys]).withColumn(r, F.col("_r") + F.col("_o"))
        out = out.withColumn("before", F.col("_s") + F.col("_b")) if value else out
        out = out.drop("_r", "_o", "_b", "_s")
    return out.drop("_part")


def class_of(rank: str, size: str, classes: int) -> Column:
    """Equal-frequency class of a rank from 0: class m holds ranks from floor(m n / M) on."""
    return F.floor(((F.col(rank) + 1) * classes - 1) / F.col(size)).cast("int")


def undefined_if(flat: Column, value: Column) -> Column:
    """NaN where the output is constant."""
    return F.when(flat, F.lit(float("nan"))).otherwise(value)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NaN where ``b`` is zero."""
    return F.coalesce(F.try_divide(a, b), F.lit(float("nan")))
