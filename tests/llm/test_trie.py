import hashlib
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import same_rows

from gaugeworks.llm import queries, trie


def brute(rows):
    convs = {}
    for c, t, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        convs.setdefault(c, []).append((role, text))
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, more=()):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns(dict(more))
    return sorted((tuple(r) for r in trie.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_query_matches_sql(spark, sf):
    same_rows(queries.op13_prefix_trie(spark, sf), queries.ORACLE_SQL["op13_prefix_trie"], sf)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_odd_rows(spark, monkeypatch, chunk):
    """Null turns, roles and texts, ties, repeated rows, one long conversation, many copies, short ones that lose all turns, clashing columns."""
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = [(c, t, "u" if t % 2 else "a", f"text {t}") for c in range(250, 320) for t in range(c % 4 + 1)]
    rows += [(5, t, "u", "é🙂" * (t % 7)) for t in range(300)]
    rows += [(c, t, "u", "same") for c in range(400, 480) for t in range(3)]
    rows += [(600, 1, None, "x"), (600, None, "u", None), (600, 1, "u", "x"), (600, 1, "u", "x"), (None, 1, "u", "gone"), (601, None, None, None), (777, 2, "u:1", "a"), (778, 2, "u", "1:a"), (779, 0, "", "")]
    assert got(spark, rows, [("node", F.lit(1)), ("pos", F.lit("x")), ("a.b", F.lit(2)), ("length", F.lit(0))]) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_running_sums_over_ranges(spark):
    """A key that fills most ranges, and keys of one row."""
    rows = [(1, i, i % 5) for i in range(5000)] + [(k, 0, k) for k in range(2, 200)]
    out = trie.running(spark.createDataFrame(rows, "k bigint, o bigint, v bigint"), "k", ["o"], ["v"])
    want, total = {}, 0
    for k, o, v in rows:
        total = v if o == 0 else total + v
        want[k, o] = total
    assert {(r.k, r.o): r.v_upto for r in out.collect()} == want
