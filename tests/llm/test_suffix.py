import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import queries, suffix


def brute(rows, length):
    """Straight from the contract; rows of distinct ids."""
    seen, out = set(), set()
    for i, text in sorted(((i, (t or "").encode()) for i, t in rows)):
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            s = text[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(text) else 0
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.add((i, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return {tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}


@pytest.mark.parametrize(("length", "unit", "batch"), [(8, 64, 300), (20, 500, 200), (40, 1 << 20, 1 << 20)])
def test_against_brute_force(spark, length, unit, batch):
    rng = random.Random(length)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(length // 2, 3 * length))) for _ in range(12)]
    rows = [(i * 7, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(1000, None), (1001, "a" * 900), (1002, rows[5][1]), (1003, rows[5][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("batch", F.lit("clash")).repartition(5)
    got = suffix.without_repeats(docs, length=length, unit=unit, batch=batch, texts=True)
    assert result(got) == brute(rows, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op4_suffix_dedup(spark, sf)) == brute(rows, 100)


def test_odd_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, "short"), (2, "short"), (3, "")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(1, 300, 0), (1, 300, 0), (None, 300, 300), (None, 0, 0), (2, 5, 0), (2, 5, 0), (3, 0, 0)], key=str)
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hot_ids_are_several_batches(spark):
    """Many texts of one id and many without one: batches stay small, in order of id and hash, and results are as in one batch."""
    edges = np.array([5, 9, 9, 9, 20])
    assert [suffix.slots(edges, i, 0, 3) for i in (4, 5, 7, 9, 10, 21)] == [0, 0, 1, 1, 4, 5]
    assert suffix.slots(edges, 9, (1 << 64) - 1, 3) == 4 and suffix.slots(edges, None, 0, 3) == 6 and suffix.slots(edges, None, (1 << 64) - 1, 3) == 8
    rng = random.Random(2)
    passages = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(8)]
    rows = [(rng.choice([7, 7, 7, None, None, 1, 30]), "".join(rng.choice(passages) + rng.choice("xyz") for _ in range(3))) for _ in range(120)]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id bigint, text string").repartition(4)
    got = [sorted(map(str, suffix.without_repeats(docs, length=20, unit=100, batch=b).collect())) for b in (400, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == 150


def test_rows_grow_as_the_input():
    rows = []
    for total in (10**9, 10**12, 10**14):
        plan = suffix.Plan(100, total)
        rows.append((1 + total // plan.batch) * (plan.name_ranges + plan.string_ranges) / total)
    assert rows[2] < 2 * rows[1] and suffix.Plan(100, 10**14).batch < 1 << 28


def test_codes_and_covers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        for top in (1 << 12, 1 << 63):
            v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            assert (suffix.decoded(suffix.coded(v)) == v).all()
    for period, cover in suffix.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
