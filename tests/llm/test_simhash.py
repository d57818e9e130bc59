import random
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeworks.llm import queries, simhash


def plain_fingerprint(text):
    """Straight from the contract."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    least = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, f in fps:
            for j, g in fps:
                if (f ^ g).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return {(i, f"{f:016x}", least[i]) for i, f in fps}


def test_query_against_brute_force(spark, sf):
    got = {tuple(r) for r in queries.op1_simhash_near_dedup(spark, sf).select("doc_id", "fingerprint", "component_id").collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows)


@pytest.mark.parametrize("local", [50_000, 8])
def test_full_buckets_lose_no_link(spark, local):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in set(rng.sample(range(64), rng.randint(0, 4)))) for c in centres for _ in range(120)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), direct=4, local=local)
    from gaugeworks.llm.components import connected

    got = {r.node: r.component for r in connected(edges).collect()}
    values = [s for (s,) in signed]
    least = {v: v for v in values}
    for _ in range(20):
        for v in values:
            for w in values:
                if ((v ^ w) & (1 << 64) - 1).bit_count() <= 2:
                    least[v] = min(least[v], least[w])
    assert {v: got.get(v, v) for v in values} == least
    for e in edges.collect():
        assert ((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (6, "x " * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit(1)).withColumn("key", F.lit("k"))
    got = sorted(simhash.near_groups(docs).collect(), key=str)
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by_id[1] == by_id[2] == by_id[3] == {("0" * 16, 1)}
    assert by_id[4] == by_id[5] == by_id[None] and {c for _, c in by_id[4]} == {4}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 4, 6]
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_few_edges_are_kept_in_few_files(spark):
    """Rounds over few edges write few files, whatever the number of shuffle partitions."""
    from gaugeworks.llm import common, components

    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    folder = Path(common.shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("links-*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 30 == 29, 0).otherwise(1)).alias("b"))
        got = {r.node: r.component for r in components.connected(edges).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 30 for i in range(300)}
    written = set(folder.glob("links-*")) - before
    assert len(written) > 1 and all(len(list(p.glob("part-*"))) == 1 for p in written)


def test_rounds_over_few_edges_run_few_tasks(spark):
    """The number of shuffle partitions counts once, where edges are made distinct, not in each round."""
    from gaugeworks.llm import components

    context, old = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("few-edges", "")
        edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 30 == 29, 0).otherwise(1)).alias("b"))
        assert components.connected(edges).count() == 300
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))) < 1000
