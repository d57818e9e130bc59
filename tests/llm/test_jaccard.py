import random

import pytest

import corpus_pipeline
from gaugeworks.llm import jaccard, simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    """The least id of each component at a Jaccard similarity of 0.8 or more; empty sets are equal."""
    sets, least = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    near = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                changed = True
    return least


def test_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    least = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert got == {i for i, c in least.items() if i == c}


@pytest.mark.parametrize("direct", [16, 2])
def test_edited_copies(spark, direct):
    """Copies with edits around the bound, of one line and of several; full buckets lose no link."""
    rng = random.Random(3)
    rows = []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(60):
            words = list(base)
            for k in rng.sample(range(120), rng.randint(0, 5)):
                words[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    want = brute(rows)
    assert 3 < len(set(want.values())) < len(rows)
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), direct=direct)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (6, "x " * 70_000), (None, "null only")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 4, 6]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_copies_do_not_meet_in_one_task(spark):
    """What rows are dealt out by differs between copies, so that many copies of one text are no large group."""
    docs = spark.createDataFrame([(i, "the same words in each of them") for i in range(50)], "doc_id bigint, text string")
    assert jaccard._prints(docs, "doc_id", "text", 5).select("t").distinct().count() == 50
    assert {r.component_id for r in jaccard.near_groups(docs).collect()} == {0}
