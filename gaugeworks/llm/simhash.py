"""SimHash near-duplicate detection with deletion-variant signatures.

A fingerprint has 64 bits and two documents link at two or fewer differing bits. The fingerprint is
cut into two segments of 32 bits, fewer than the three that exact matching of a segment would need:
of two differing bits, one segment holds at most one. Each segment is indexed under its 32
one-wildcard variants (the segment with one bit masked, and which), so that two segments which differ
by at most one bit share a variant. Fingerprints that share a variant are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import cut, restored, sheltered
from .components import connected

#: Shingles whose bits are counted at once, which bounds a task's memory on very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, words between ASCII white space.

    Shingles are ``width`` words joined by spaces, repeats included; fewer words are one shingle, no
    word gives zero. A bit is 1 if it is set in over half of the shingles' XXH64.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    width = min(width, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        upto = min(n, at + BLOCK)
        pairs = zip(starts[at:upto].tolist(), (ends[at + width - 1 : upto + width - 1] - 1).tolist())
        h = np.array([hashed(flat[a:b], seed) for a, b in pairs], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(id_col, fp)`` of each document; ``fp`` holds the 64 bits as a signed long."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, width, seed) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(kernel, f"`{id_col}` {kind}, fp bigint")


def forest(fps: np.ndarray, own: int, offset: int) -> list[tuple[int, int]]:
    """Links that join what links in one bucket, one fewer than the members joined.

    ``fps`` are the bucket's fingerprints, ``own`` the bit that it masks, ``offset`` where the other segment
    starts. Fingerprints that agree but for two wildcards link; for each choice of those, equal rests are
    joined to the first of them. Two wildcards in the other segment are tried where nothing is
    masked twice: in the bucket of a segment's first bit.
    """
    bits = [1 << (offset + q) for q in range(32)]
    masks = [(1 << own) | b for b in bits] + [b | c for k, b in enumerate(bits) for c in bits[:k] if own in (0, 32)]
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for m in masks:
        _, first, group = np.unique(fps & np.uint64(~m & (1 << 64) - 1), return_index=True, return_inverse=True)
        for i in np.flatnonzero(first[group] != np.arange(len(fps))).tolist():
            x, y = find(int(first[group[i]])), find(i)
            if x != y:
                root[y] = x
                out.append((int(first[group[i]]), i))
    return out


def links(fps: DataFrame, direct: int = 16, local: int = 50_000) -> DataFrame:
    """Edges ``(a, b)`` among distinct fingerprints ``fp``, enough to join all that link at two or fewer bits.

    Buckets of up to ``direct`` fingerprints are self-joined and each pair verified. A fuller bucket, as a
    large group of near copies makes it, would give a pair for each two; ``forest`` reduces it to links that
    join the same fingerprints, in time linear in its members. A bucket of over ``local`` members, too many for
    one task, does the same by grouped minima over wildcard keys. No link is lost: two linked
    fingerprints that share a full bucket either differ by at most one bit in each segment, or agree on
    that segment and differ by two bits in the other.
    """
    low = F.lit(0xFFFFFFFF)
    halves = fps.select("fp", F.col("fp").bitwiseAND(low).alias("s0"), F.shiftrightunsigned("fp", 32).alias("s1"))
    keys = [
        F.col(f"s{s}").bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << p))).bitwiseOR(F.lit((s << 37) | (p << 32)))
        for s in (0, 1)
        for p in range(32)
    ]
    variants = halves.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = cut(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(variants.join(shared, "key"))
    few = members.where(F.col("n") <= direct)
    x, y = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = x.join(y, "key").where(F.col("a") < F.col("b")).where(close).select("a", "b")

    def joined(bucket: pd.DataFrame) -> pd.DataFrame:
        key, values = int(bucket.key.iloc[0]), bucket.fp.sort_values().to_numpy()
        own = ((key >> 32) & 31) + 32 * (key >> 37)
        ends = forest(values.view(np.uint64), own, 0 if key >> 37 else 32)
        return pd.DataFrame({"a": [values[i] for i, _ in ends], "b": [values[j] for _, j in ends]}, dtype="int64")

    full = members.where(F.col("n") > direct)
    trees = full.where(F.col("n") <= local).select("key", "fp").groupBy("key").applyInPandas(joined, "a bigint, b bigint")
    return pairs.unionByName(trees).unionByName(_stars(full.where(F.col("n") > local))).distinct()


def _stars(full: DataFrame) -> DataFrame:
    """Edges for buckets ``(key, fp)`` of any size: each fingerprint with two wildcards, and the least of those that agree."""
    segment = F.shiftrightunsigned("key", 37)
    place = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(31))
    full = full.select("fp", segment.alias("seg"), place.cast("int").alias("pos"))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p)
    own = F.col("pos") + F.col("seg").cast("int") * 32
    other = F.lit(32) - F.col("seg").cast("int") * 32
    one_each = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda q: bit(own).bitwiseOR(bit(q + other)))
    two = [(1 << p) | (1 << q) for p in range(32) for q in range(p)]
    two_there = F.when(F.col("pos") == 0, F.transform(F.array(*map(F.lit, two)), lambda m: F.call_function("shiftleft", m, other)))
    masks = F.concat(one_each, F.coalesce(two_there, F.expr("cast(array() as array<bigint>)")))
    wild = full.select("fp", F.explode(masks).alias("mask")).distinct()
    wild = wild.select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    least = cut(wild.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return wild.join(least, ["mask", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, fingerprint, component_id)``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id that can be reached
    over links, the row's own included. Equal fingerprints are one class, which is what is indexed and
    linked; copies are never expanded into pairs.

    Null or empty text has fingerprint zero and links like any other. Rows with a null id are kept and
    take the component's smallest id, null if it has none. Repeated rows are repeated in the result.
    An empty table gives no rows. Columns besides the two named are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width, seed))
    classes = cut(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = connected(links(classes.select("fp"))).select(F.col("node").alias("fp"), "component")
    named = cut(classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    ids = cut(named.groupBy("component").agg(F.min("least").alias("component_id")))
    labels = cut(named.join(ids, "component").select("fp", "component_id"))
    return fps.join(labels, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``(id_col, kept)`` of each row whose id isn't null: the smallest id of its group of near duplicates.

    Documents link where their fingerprints of ``width``-word shingles differ by two bits or fewer, or where their
    sets of shingles have a Jaccard similarity of ``least`` or more. At a similarity of 0.8, fingerprints of 64 bits
    differ by about ten, which no index of segments can cover; so sets are compared in full for these (``jaccard``).
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    found = [near_groups(rows, "id", "text", width).select("id", "component_id"), jaccard.near_groups(rows, "id", "text", width, least)]
    ends = found[0].unionByName(found[1])
    groups = connected(ends.select(F.col("id").alias("a"), F.col("component_id").alias("b")))
    return groups.select(F.col("node").alias(id_col), F.col("component").alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates (``copies``): the one with the smallest id.

    Rows that repeat that id all stay, as one document; rows with a null id stay. Null or empty texts link like
    any others. An empty table gives no rows; further columns pass through, whatever their names. Ids are integers.
    """
    inner, name = sheltered(docs)
    id_ = name[id_col]
    losers = copies(inner, id_, name[text_col], width, least).where(F.col(id_) != F.col("kept")).select(F.col(id_).alias("lost"))
    return restored(inner.join(losers, F.col(id_).cast("bigint") == F.col("lost"), "left_anti"), docs, ())
