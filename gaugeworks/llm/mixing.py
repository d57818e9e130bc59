"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed by cell (source, language, topic). Each round scales the cells' weights so that their
sums agree with the targets of one dimension after the other. A cell's weight per token is then the
calibrated rate, up to one factor for all, at which its documents are taken: a document is kept if a
number drawn from its id by a hash lies below it.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, restored, sheltered, written

#: Most rows of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rounds before shares are held against the targets, and then again; most rounds, and how far a share may be from its target.
ROUNDS, MOST_ROUNDS, TOLERANCE = 4, 120, 1e-4
ADDED = ("topic", "n_tokens", "weight", "p")
#: Targets of the queries: shares of tokens raised to these powers, so that large values give way to small ones.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Times its own share that a tempered target is at most. Without it, the tokens of one odd document are a value whose target,
#: and so whose rate, is hundreds of times its share, and all other documents are taken at one in hundreds.
GROWTH = 5.0
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's form: table, licensed, contact, long, medium or short."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("Licensed under"), "licensed")
        .when(t.rlike(r"[0-9]{3}|@"), "contact")
        .when(F.length(t) >= 4000, "long")
        .when(F.length(t) >= 800, "medium")
        .otherwise("short")
    )


def draw(id_: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 fixed by the id and the seed (by the text where the id is null)."""
    key = F.coalesce(id_.cast("string"), F.md5(text.cast("string").cast("binary")), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**13))


def _joined(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", size: int | None = None) -> DataFrame:
    """``rows`` joined null-safely with ``table``, which is broadcast if it is small (``size`` rows, else counted)."""
    named = table.withColumnsRenamed({c: f"_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & rows[c].eqNullSafe(named[f"_{c}"])
    small = (table.count() if size is None else size) <= BROADCAST_ROWS
    return rows.join(F.broadcast(named) if small else named, condition, how).drop(*[f"_{c}" for c in on])


def tempered(cells: DataFrame, dims: dict[str, float], growth: float = GROWTH) -> dict[str, DataFrame]:
    """Target tables ``(dim, target)``, shares that sum to 1: each value's share of tokens to a power.

    Shares are first held to ``growth`` times what they were; what that leaves goes to all values in proportion.
    """
    out, total = {}, float(cells.agg(F.sum("tokens")).first()[0] or 1)
    for d, power in dims.items():
        tokens = F.sum("tokens").cast("double")
        sums = cut(cells.groupBy(d).agg(F.pow(tokens, F.lit(power)).alias("t"), (tokens / F.lit(total) * growth).alias("most")))
        bounded = cut(sums.select(d, F.least(F.col("t") / F.lit(sums.agg(F.sum("t")).first()[0] or 1.0), F.col("most")).alias("t")))
        out[d] = cut(bounded.select(d, (F.col("t") / F.lit(bounded.agg(F.sum("t")).first()[0] or 1.0)).alias("target")))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (a column for each dimension, ``tokens``) with ``weight``, tokens raked to the targets.

    A target table has its dimension and ``target``, a share; a value without one keeps no weight. Cells
    without tokens weigh nothing. Cells that have a ``weight`` are raked on from it. Sums agree exactly with
    the last dimension's targets and with the others' as far as the rounds converge.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells = cells if "weight" in cells.columns else cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, target in targets.items():
        cells = _joined(cells, target.withColumnRenamed("target", f"_{d}_target"), [d], "left")
    cells = cut(cells)
    small = cells.count() <= BROADCAST_ROWS
    cells = cells.coalesce(1) if small else cells  # a table of a checked size is one partition, where sums need no shuffle
    values = {d: 0 if small else cells.select(d).distinct().count() for d in targets}
    for _ in range(rounds):
        for d in targets:
            share = F.coalesce(f"_{d}_target", F.lit(0.0)) * total / F.col("_have")
            if small:
                cells = cells.withColumn("_have", F.sum("weight").over(Window.partitionBy(d)))
            else:
                cells = _joined(cells, cells.groupBy(d).agg(F.sum("weight").alias("_have")), [d], size=values[d])
            cells = cells.withColumn("weight", F.when(F.col("_have") > 0, F.col("weight") * share).otherwise(0.0)).drop("_have")
        cells = cells if small else written(cells, "cells")  # a file, for what Spark infers of a checkpoint's values grows with each
    return cut(cells.drop(*[f"_{d}_target" for d in targets]))


def gap(raked: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest distance of a value's share of ``weight`` from its target; nan if nothing has weight."""
    total, worst = raked.agg(F.sum("weight")).first()[0] or float("nan"), 0.0
    for d, target in targets.items():
        have = raked.groupBy(d).agg((F.sum("weight") / F.lit(total)).alias("_have")).withColumnRenamed(d, "_value")
        both = have.join(target, F.col("_value").eqNullSafe(F.col(d)), "full")
        off = both.agg(F.max(F.abs(F.coalesce("_have", F.lit(0.0)) - F.coalesce("target", F.lit(0.0))))).first()[0]
        worst = max(worst, float(off or 0.0)) if total == total else total
    return worst


def raked_until(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS, most: int = MOST_ROUNDS) -> DataFrame:
    """``rake`` in steps of ``rounds`` until all shares are within ``tolerance`` of their targets; warns if they are not after ``most``.

    Targets that no weights can reach, such as one for a value without tokens, end in that warning too, once
    shares come no nearer.
    """
    raked, done, before = rake(cells, targets, rounds), rounds, math.inf
    while (off := gap(raked, targets)) > tolerance and done < most and off < 0.9 * before:
        raked, done, before = rake(raked, targets, rounds), done + rounds, off
    if off > tolerance:
        warnings.warn(f"after {done} rounds a share is {off:.2g} from its target", stacklevel=2)
    return raked


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, seed: int = 42, topic: Column | None = None) -> DataFrame:
    """The documents that the calibrated sample takes: ``docs`` with ``topic``, ``n_tokens``, ``weight`` and ``p``.

    ``weight`` is the raked tokens per token of the document's cell. A document is taken once at most, so all
    weights are scaled by the largest: ``p`` is that share, and the sample is as large as it can be with one
    rate for each cell and the target shares. Raking goes on, ``rounds`` at a time, until shares agree with the
    targets. Dimensions are ``source``, ``lang`` and ``topic`` (by default ``topic_of`` the text; pass a
    classifier's column instead); without ``targets``, the tempered shares of ``TEMPER``,
    held to ``GROWTH`` times what they were. Columns ``topic``, ``n_tokens``, ``weight`` and ``p`` are replaced; others
    pass through, whatever their names.

    Null source or language is a value like any other; null text is an empty one, without tokens, and a
    cell without tokens has weight and ``p`` 1 (its documents move no mixture). Rows that repeat an id are
    taken together. An empty table gives no rows.
    """
    inner, name = sheltered(docs, () if topic is not None else ADDED)
    if topic is not None:  # an expression over the caller's columns, some of which may be replaced
        inner, name = sheltered(docs.withColumn("topic", topic), ADDED[1:])
    text = F.coalesce(F.col(name[text_col]).cast("string"), F.lit(""))
    rows = inner.withColumns({"source": F.col(name["source"]), "lang": F.col(name["lang"]), "topic": F.col(name["topic"]) if topic is not None else topic_of(text)})
    rows = rows.withColumn("n_tokens", F.regexp_count(text, F.lit(WORD)).cast("bigint"))
    dims = list(TEMPER)
    cells = cut(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")))
    targets = targets or tempered(cells, TEMPER)
    raked = raked_until(cells, targets, rounds=rounds)
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    most = raked.agg(F.max(rate)).first()[0] or 1.0
    rates = cut(raked.select(*dims, F.coalesce(rate, F.lit(1.0)).alias("weight"), F.coalesce(rate / F.lit(most), F.lit(1.0)).alias("p")))
    out = _joined(rows, rates, dims)
    out = out.where(draw(F.col(name[id_col]), text, seed) < F.col("p"))
    return restored(out, docs, ADDED)


def sql(rounds: int = ROUNDS, seed: int = 42, source: str = "documents") -> str:
    """DuckDB SQL with ``doc_id, source, lang, topic, n_tokens, p`` of the rows of ``mixed`` where ``rounds`` suffice."""
    steps, last = [], "cells"
    for d, power in TEMPER.items():
        share = f"pow(sum(tokens)::DOUBLE, {power}) / sum(pow(sum(tokens)::DOUBLE, {power})) OVER ()"
        steps.append(f"b_{d} AS (SELECT {d}, least({share}, {GROWTH} * sum(tokens) / sum(sum(tokens)) OVER ()) AS bounded FROM cells GROUP BY {d})")
        steps.append(f"t_{d} AS (SELECT {d}, bounded / sum(bounded) OVER () AS target FROM b_{d})")
    for k in range(rounds):
        for d in TEMPER:
            now = f"r{k}_{d}"
            steps.append(
                f"{now} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, CASE WHEN sum(weight) OVER (PARTITION BY c.{d}) > 0 THEN weight * target * (SELECT sum(tokens) FROM cells) / sum(weight) OVER (PARTITION BY c.{d}) ELSE 0 END AS weight"
                f" FROM {last} c JOIN t_{d} t ON c.{d} IS NOT DISTINCT FROM t.{d})"
            )
            last = now
    return rf"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
    CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'Licensed under') THEN 'licensed'
      WHEN regexp_matches(text, '[0-9]{{3}}|@') THEN 'contact' WHEN length(text) >= 4000 THEN 'long' WHEN length(text) >= 800 THEN 'medium' ELSE 'short' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens
  FROM {source}
), cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens, sum(n_tokens)::DOUBLE AS weight FROM d GROUP BY ALL),
{", ".join(steps)},
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens / max(CASE WHEN tokens > 0 THEN weight / tokens END) OVER () ELSE 1 END AS p FROM {last})
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.p, 6) AS p
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic
WHERE ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, md5(d.text))), 1, 13))::BIGINT / {float(16**13)} < p.p
"""
