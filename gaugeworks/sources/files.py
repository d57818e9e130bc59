"""Designs, runs and results as files: Parquet with a JSON sidecar, CSV, and output columns named ``name@time``."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..problem import Problem

#: ``name@time``; a name without one is at time 0.
TIMED = re.compile(r"^(?P<name>.+?)@(?P<time>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)$")


def save_design(path: str, kind: str, problem: Problem, tables: dict[str, DataFrame], **more) -> None:
    """Tables as Parquet below ``path``, and problem, kind of design and ``more`` (such as eFAST's main frequency) as JSON beside them."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = json.dumps({"kind": kind, "problem": problem.to_json(), "tables": sorted(tables), "more": more})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/design")


def load_design(spark: SparkSession, path: str, kind: str | None = None) -> tuple[Problem, dict[str, DataFrame], dict]:
    """What ``save_design`` wrote: problem, tables and what else was saved; another ``kind`` than the one asked for raises."""
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/design").collect()))
    if kind is not None and meta["kind"] != kind:
        raise ValueError(f"the design is one of {meta['kind']}, not of {kind}")
    return Problem.from_json(meta["problem"]), {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]}, meta["more"]


def write_csv(df: DataFrame, path: str) -> None:
    """A design or result as CSV files with a header; numbers keep all their digits, and NaN is written as such."""
    df.write.mode("overwrite").option("header", True).option("nanValue", "NaN").csv(path)


def read_csv(spark: SparkSession, path: str, key: str = "run_id") -> DataFrame:
    """Runs from CSV with a header: trimmed names, the key as a whole number, all else as doubles.

    A repeated name raises, as does a field that is no number; an empty field is null.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = [c.strip() for c in raw.columns]
    if len(set(names)) != len(names):
        raise ValueError("a column's name is repeated")
    plain = raw.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{i}").cast("bigint" if c == key else "double").alias(c) for i, c in enumerate(names)])


def output_columns(columns: Sequence[str], inputs: Sequence[str], key: str = "run_id") -> list[tuple[str, str, float]]:
    """``(column, output, time)`` of each column that is neither key nor input; none, or one twice, raises."""
    found = []
    for c in columns:
        if c != key and c not in inputs:
            m = TIMED.match(c)
            found.append((c, m["name"], float(m["time"])) if m else (c, c, 0.0))
    if not found:
        raise ValueError("there is no output column")
    if len({x[1:] for x in found}) != len(found):
        raise ValueError("an output is repeated at a time")
    return found


def timed_outputs(runs: DataFrame, inputs: Sequence[str], key: str = "run_id") -> DataFrame:
    """``(key, output, time, y)`` from wide columns ``name`` or ``name@time``; fields that are null are no rows."""
    plain = runs.toDF(*[f"c{i}" for i in range(len(runs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(runs.columns)}
    rows = F.array(*[F.struct(F.lit(n).alias("output"), F.lit(t).alias("time"), F.col(at[c]).cast("double").alias("y")) for c, n, t in output_columns(runs.columns, inputs, key)])
    return plain.select(F.col(at[key]).alias(key), F.explode(rows).alias("o")).select(key, "o.*").where("y IS NOT NULL")


def channels(tables: dict[str, DataFrame], key: str = "run_id", time: str = "time") -> DataFrame:
    """Irregular outputs ``(key, time, y)`` of each channel as one table with ``output``, in order of nothing.

    Every run must have a channel's every time once: a repeated or missing one, or a time that is not finite, raises.
    """
    out = None
    for name, df in tables.items():
        if not df.where(F.col(time).isNull() | F.isnan(time) | (F.abs(time) == float("inf"))).isEmpty():
            raise ValueError(f"{name} has a time that is not finite")
        n = df.select(key).distinct().count() * df.select(time).distinct().count()
        if not df.groupBy(key, time).count().where("count > 1").isEmpty() or df.count() != n:
            raise ValueError(f"{name} repeats or misses a run's time")
        one = df.select(F.col(key), F.lit(name).alias("output"), F.col(time).cast("double").alias(time), F.col("y").cast("double").alias("y"))
        out = one if out is None else out.unionByName(one)
    return out
