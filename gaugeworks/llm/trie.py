"""The prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Each node is owned by its
smallest member. Members of a deeper node are among those above it, so what a conversation owns of its path is a
suffix, told by one depth. Sums over a subtree then need no walk: each member brings the tokens of its
path from the node on (every occurrence) less those on the part that it owns (every node once), a flag if it owns a
leaf, and a flag if it owns the node below; one group-by on prefixes sums them.

A prefix is known by its depth and the sum of 256-bit digests of its turns, each salted with its depth. Sums along a path are
running sums over ranges of rows, so that no conversation, however long, and no prefix, however common, is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Words of a digest; each is a number of 32 bits, so that 2^31 of them can be summed.
WORDS = 8
#: Ids that are joined into one text before a hash takes them in order.
CHUNK = 20_000


def running(rows: DataFrame, key: str, order: Sequence[str | Column], values: Sequence[str]) -> DataFrame:
    """``rows`` with ``<value>_upto``, the sum of each value over the key's rows up to this one, at any number of rows of a key.

    Rows are dealt by range of key and order and summed within a range. Only a range's first key can have begun in ranges before,
    so that what is added is a table of at most a row for each range. Equal rows are summed in any order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = written(rows.repartitionByRange(partitions(rows.sparkSession), F.col(key), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    first = dealt.groupBy("_part").agg(F.min(key).alias(key))
    shared = dealt.join(F.broadcast(first.select(key).distinct()), key)  # a row for each range
    sums = shared.groupBy("_part", key).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = sums.select("_part", key, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    here = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"{v}_upto": F.sum(v).over(here) for v in values}).join(F.broadcast(moved), ["_part", key], "left")
    return out.withColumns({f"{v}_upto": F.col(f"{v}_upto") + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop("_part", *[f"_{v}" for v in values])


def turns_in_order(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, pos, role, text)``: turns from place 0 on, by turn with null first, turns of one number by role and text; null role and text are empty.

    Rows with a null id belong to no conversation and go; rows that repeat are turns of their own.
    """
    cols = [conversations.columns.index(c) for c in (id_col, turn_col, role_col, text_col)]
    inner = conversations.toDF(*[f"c{i}" for i in range(len(conversations.columns))])
    c, turn, role, text = (F.col(f"c{i}") for i in cols)
    rows = inner.where(c.isNotNull()).select(c.cast("bigint").alias("conv_id"), turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.lit(1).cast("bigint").alias("one"))
    placed = running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["one"])
    return placed.select("conv_id", (F.col("one_upto") - 1).alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their hundred does: ``(conv_id, length)`` and their turns ``(conv_id, depth, role, text)``.

    Of conversation c, the first ``h = crc32(c) % most`` turns are those of ``c - c % group`` (all if it has fewer, none if it is
    not there), and its own turns after the first ``h`` follow.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", (F.col("n") + 1).alias("n"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"), (c - c % group).alias("base"))
    sizes = written(sizes, "sizes")
    heads = turns.where((c % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    kept = sizes.where(c % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0))).alias("taken")
    convs = sizes.join(kept, "base", "left").select("conv_id", "base", "n", "h", taken)
    begin = convs.where("taken > 0").join(heads, "base").where("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "role", "text")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return convs.select("conv_id", length.alias("length")), begin.unionByName(own)


def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations ``members (conv_id, length)`` with turns ``(conv_id, depth, role, text)``, depth from 1.

    Columns: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``
    (nodes without a child in the subtree, the node included), ``saved_tokens`` (summed over the subtree, the node included: members
    but one, times code points of the last text) and ``ends_sha256`` (of the ids of members that end here, ascending, joined by
    commas). A node's last turn is the turn of ``conv_id`` at ``depth``.

    A conversation without turns is a member of the root alone; without any conversation there is no node.
    """
    salted = F.sha2(F.concat_ws(":", "depth", F.length("role"), "role", "text"), 256)
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"w{i}") for i in range(WORDS)]
    steps = turns.select("conv_id", "depth", F.length("text").cast("bigint").alias("tokens"), salted.alias("h")).select("conv_id", "depth", "tokens", *words)
    zero = [F.lit(0).cast("bigint").alias(f"w{i}") for i in range(WORDS)]
    root = members.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("tokens"), *zero)
    sums = running(root.unionByName(steps), "conv_id", ["depth"], ["tokens", *[f"w{i}" for i in range(WORDS)]])
    key = F.unhex(F.sha2(F.concat_ws(",", "depth", *[f"w{i}_upto" for i in range(WORDS)]), 256)).alias("node")
    paths = written(sums.select("conv_id", "depth", "tokens", F.col("tokens_upto").alias("upto"), key).join(members, "conv_id"), "paths")

    # Written, so that the join deals both sides anew and can split what a common prefix or a long conversation brings.
    owners = written(paths.groupBy("node").agg(F.min("conv_id").alias("owner"), F.max(F.col("length") > F.col("depth")).alias("inner")), "owners")
    marked = written(paths.join(owners, "node").withColumn("owns", F.col("conv_id") == F.col("owner")), "marked")
    # Of each conversation: where the part that it owns begins, the tokens before it, whose the node before it is, and if it owns a leaf.
    above = F.when(~F.col("owns"), F.struct("depth", "upto", "owner"))
    suffix = written(
        marked.groupBy("conv_id").agg(
            F.min(F.when(F.col("owns"), F.col("depth"))).alias("since"), F.max(above).alias("above"), F.max(F.col("owns") & ~F.col("inner") & (F.col("depth") == F.col("length"))).alias("leaf")
        ),
        "suffixes",
    )
    shared = F.when(F.col("owns"), F.lit(0)).otherwise(F.col("above.upto") - F.col("upto") + F.col("tokens"))
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") == F.col("since"), F.col("above.owner")).otherwise(F.col("conv_id")))
    below = (F.col("depth") < F.col("length")) & (F.col("since") <= F.col("depth") + 1)
    rows = marked.join(suffix, "conv_id").select("node", "conv_id", "depth", "owns", parent.alias("parent"), shared.alias("saved"), F.col("leaf").cast("bigint").alias("leaf"), F.coalesce(below, F.lit(False)).cast("bigint").alias("below"))
    nodes = rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max(F.when(F.col("owns"), F.col("parent"))).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum("below").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    ends = joined_hashes(marked.where("depth = length").select("node", "conv_id"))
    return nodes.join(ends, "node", "left").drop("node").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def joined_hashes(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of each node's ids ``(node, conv_id)``, ascending and joined by commas.

    Ranges of sorted ids become long texts first. One hash reads a node's texts in order, as the hash is defined, and
    holds one batch of them at a time.
    """
    n = partitions(ends.sparkSession)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, rows = None, [], []
        for b in batches:
            for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (key != node or len(ids) >= CHUNK):
                    rows.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = key
                ids.append(i)
            yield batch(rows)
            rows = []
        if ids:
            yield batch([(node, ids[0], ",".join(map(str, ids)))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for key, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if key == node:
                    state.update(b"," + text.encode())
                else:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
            yield out(done)
        if state:
            yield out([(node, state.hexdigest())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string()))], names=["node", "ends_sha256"])

    texts = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(chunks, "node binary, first bigint, ids string")
    return texts.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table's rebuilt conversations: see ``turns_in_order``, ``rebuilt`` and ``prefix_trie``."""
    members, turns = rebuilt(written(turns_in_order(conversations), "turns"))
    return prefix_trie(written(members, "members"), turns)


#: The same rows in SQL, with whole sequences of turns as keys and subtrees by comparing prefixes.
SQL = """
WITH crc AS (
  SELECT conv_id, (xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 6)::BIGINT AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
built AS (
  SELECT c.conv_id, 0 AS own, p.pos, p.role, p.text FROM crc c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 100 AND p.pos < c.h
  UNION ALL SELECT p.conv_id, 1, p.pos, p.role, p.text FROM placed p JOIN crc c USING (conv_id) WHERE p.pos >= c.h),
paths AS (
  SELECT c.conv_id, coalesce(list({'r': b.role, 't': b.text} ORDER BY b.own, b.pos) FILTER (b.pos IS NOT NULL), []) AS path
  FROM crc c LEFT JOIN built b USING (conv_id) GROUP BY c.conv_id),
steps AS (SELECT conv_id, len(path) AS n, unnest(range(len(path) + 1)) AS depth, path FROM paths),
members AS (SELECT conv_id, n, depth, path[1:depth] AS key FROM steps),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
  FROM members GROUP BY key, depth),
below AS (
  SELECT p.key, p.depth, count(*) FILTER (q.depth = p.depth + 1) AS n_children, count(*) FILTER (q.leaf) AS n_leaves,
    sum((q.n_convs - 1) * CASE WHEN q.depth > 0 THEN length(q.key[q.depth].t) ELSE 0 END) AS saved_tokens
  FROM nodes p JOIN nodes q ON q.depth >= p.depth AND q.key[1:p.depth] = p.key GROUP BY p.key, p.depth)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b USING (key, depth) LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.key = n.key[1:n.depth - 1]"""
