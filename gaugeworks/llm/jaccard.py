"""Links that fingerprints of 64 bits are too short for: documents by the Jaccard similarity of their word shingles.

Documents link where their sets of shingles have a similarity of ``least`` or more, computed in full.
Candidates come from MinHash: ``BANDS`` keys of ``ROWS`` minima each, of which a pair at a similarity of
0.8 shares none with a probability of 1.3e-7. Equal sets are one class, which is what is keyed and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, needed, written
from .components import connected

BANDS, ROWS = 40, 5
#: Shingles whose minima are taken at once, which bounds a task's memory on very long texts.
BLOCK = 1 << 12
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles: A-Z lower-cased, words between ASCII white space.

    Fewer than ``width`` words are one shingle, no word gives none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    width = min(width, len(words))
    flat, hashed, ends = b" ".join(words), xxhash.xxh64_intdigest, np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    starts = ends - [len(w) + 1 for w in words]
    pairs = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist()) if words else ()
    return np.unique(np.array([hashed(flat[a:b], 42) for a, b in pairs], np.uint64))


def keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its minima and its number; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[at : at + BLOCK] ^ _FLIP) * _TIMES).min(1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


def _class(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id_col, t, cls, size, keys)`` of each row; ``t`` is a hash of id and text, ``cls`` one of the set.

    With the id in it, many copies of one text are no large group where rows meet by ``t``.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, width) for x in b.column(2).to_pylist()]
            cls = np.array([_class(s) for s in sets], np.uint64).view(np.int64)
            out = [pa.array(cls), pa.array([len(s) for s in sets], pa.int64()), pa.array([keys(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], names=[id_col, "t", "cls", "size", "keys"])

    kind, text = dict(docs.dtypes)[id_col], F.col(text_col).cast("string")
    return docs.select(F.col(id_col), F.xxhash64(F.col(id_col), text).alias("t"), text).mapInArrow(kernel, f"`{id_col}` {kind}, t bigint, cls bigint, size bigint, keys array<bigint>")


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """``(cls, s)`` of the classes of ``wanted (t)``, read from one row of each."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, width) for x in b.column(0).to_pylist()]
            cls = np.array([_class(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cls", "s"])

    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(F.col(id_col), text).alias("t"), text.alias("text"))
    one = texts.join(wanted, "t", "left_semi").dropDuplicates(["t"]).select("text")
    return one.mapInArrow(kernel, "cls bigint, s array<bigint>").dropDuplicates(["cls"])


def _leaders(full: DataFrame, parts: int) -> DataFrame:
    """``(key, a)``: of each bucket, the class that shares most buckets with most others, as what others are copies of does."""
    score = cut(full.groupBy("cls").agg(F.sum("n").alias("score")), parts)
    top = full.join(score, "cls").groupBy("key").agg(F.max(F.struct("score", "cls")).alias("top"))
    return cut(top.select("key", F.col("top.cls").alias("a")), parts)


def links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, least: float, direct: int = 16, rounds: int = 3) -> DataFrame:
    """Edges ``(a, b)`` among ``classes (cls, t, size, keys)``, enough to join all that link and share a key.

    In buckets of up to ``direct`` classes each pair is compared. In a fuller one, as a large group of near
    copies makes it, a leader is compared with all others, for which it then needs no further look; pairs that
    links have joined need none either. After ``rounds`` leaders, or once few pairs are left, all that are
    not joined are compared. No pair is dropped. Members of full buckets and edges are kept in few partitions
    where they are few.
    """
    named = classes.select("cls", "size", F.explode("keys").alias("key"))
    shared = cut(named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(named.join(shared, "key"))
    wanted = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("t").distinct()
    sets = written(_sets(docs, id_col, text_col, width, wanted), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        near = F.least("sa", "sb") >= F.greatest("sa", "sb") * F.lit(least) - F.lit(1e-6)
        pairs = pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return held(both.where(common >= F.lit(least) * (F.size("x") + F.size("y") - common) - F.lit(1e-6)).select("a", "b"))

    def ends(rows: DataFrame, name: str, *more: str) -> DataFrame:
        return rows.select("key", F.col("cls").alias(name), F.col("size").alias(f"s{name}"), *more)

    few = members.where(F.col("n") <= direct)
    edges = verified(ends(few, "a").join(ends(few, "b"), "key").where("a < b"))
    full = held(members.where(F.col("n") > direct))
    parts = needed(full.count())
    for left in range(rounds, -1, -1):
        found = connected(edges).select(F.col("node").alias("cls"), "component")
        full = full.drop("component").join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        joined = cut(full.groupBy("key", "component").agg(F.count("*").alias("m")), parts)
        per = joined.groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("same"), F.max(F.struct("m", "component")).alias("top"))
        per = cut(per.where("n * n > same").select("key", "n", "same", F.col("top.component").alias("most")), parts)
        full = cut(full.drop("n").join(per, "key"), parts)
        total, open_ = per.agg(F.sum("n"), F.sum(F.expr("(n * n - same) / 2"))).first()
        if not total:
            return edges
        if left == 0 or open_ <= 8 * total:
            break
        full = full.drop("same", "most")
        lead = _leaders(full, parts)
        sized = lead.join(full.select("key", F.col("cls").alias("a"), F.col("size").alias("sa")), ["key", "a"])
        edges = edges.unionByName(verified(sized.join(ends(full, "b"), "key").where("a <> b")))
        full = cut(full.join(lead.withColumnRenamed("a", "cls"), ["key", "cls"], "left_anti"), parts)
    full = full.repartition("key")  # pairs may be many more than rows
    rest = ends(full.where("component <> most"), "a", F.col("component").alias("ca"))
    pairs = rest.join(ends(full, "b", F.col("component").alias("cb")), "key").where("ca <> cb")
    return edges.unionByName(verified(pairs))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, direct: int = 16) -> DataFrame:
    """``(id_col, component_id)`` of each row of ``docs``: the smallest id that can be reached over links.

    Texts without words have equal, empty sets and link. Rows with a null id take the component's smallest
    id, null if it has none; repeated rows are repeated. An empty table gives no rows.
    """
    prints = written(_prints(docs, id_col, text_col, width), "prints")
    classes = cut(prints.groupBy("cls").agg(F.min(id_col).alias("least"), F.min("t").alias("t"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    found = connected(links(classes, docs, id_col, text_col, width, least, direct)).select(F.col("node").alias("cls"), "component")
    named = cut(classes.select("cls", "least").join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    ids = cut(named.groupBy("component").agg(F.min("least").alias("component_id")))
    labels = cut(named.join(ids, "component").select("cls", "component_id"))
    return prints.select(id_col, "cls").join(labels, "cls").select(id_col, "component_id")
