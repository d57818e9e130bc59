import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from gaugeworks.llm import packing, queries
from gaugeworks.llm.packing import Limits

ODD = ["", "a", "<|endoftext|> x <|endoftext|>", "don't 你好 🙂", " " * 30_000, "a" * 30_000, "x\n" * 3000, "\x00", "word " * 9000]


@pytest.fixture(scope="module")
def lib():
    t = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    t.no_padding(), t.no_truncation()
    return t


def whole(rows, tokens):
    """Checks pieces against the documents' ids (by row order of an id's ids): every id once, sequences gapless and within limits."""
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["n_loss"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0) and len(parts) <= 256
    assert set(docs) == set(tokens)
    for d, parts in docs.items():
        ids, at = tokens[d], 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids) and sum(p["n_loss"] for p in parts) == len(ids) - 1
    return sequences


@pytest.mark.parametrize("group", [1 << 21, 5000])
def test_query_against_library(spark, sf, lib, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_TOKENS", group)
    rows = [r.asDict() for r in queries.op11_vector_packing(spark, sf).collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tokens = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    sequences = whole(rows, tokens)
    # Nearly all sequences are full: at most eleven shorter ones for each group.
    assert sum(sum(p[1] for p in s) == 2048 for s in sequences.values()) >= len(sequences) - 11 * (1 + sum(map(len, tokens.values())) // group)


def test_odd_rows(spark, lib):
    rows = [(i, t) for i, t in enumerate([None, *ODD])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"start": F.lit(7), "a.b": F.lit("x"), "ids": F.lit(None)})
    got = packing.pack_documents(docs, queries.VOCABULARY, digest=True)
    whole([r.asDict() for r in got.collect()], {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows})
    ids = {}
    for r in packing.pack_documents(docs, queries.VOCABULARY).orderBy("start").collect():
        ids[r.doc_id] = ids.get(r.doc_id, []) + list(r.ids)
    assert ids == {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    again = spark.createDataFrame([(None, "x y"), (None, "x y"), (3, "z"), (3, "z")], "doc_id bigint, text string")
    assert packing.pack_documents(again, queries.VOCABULARY).agg(F.sum("length")).first()[0] == 2 * 3 + 2 * 2
    assert packing.pack_documents(docs.limit(0), queries.VOCABULARY).count() == 0


def test_long_runs_of_blanks_and_letters(lib):
    encode = packing.Ids(queries.VOCABULARY)
    for text in (" " * 1_200_000 + "a", "\n " * 300_000):
        assert encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def plain(tokens, loss, limits, cut):
    """The heuristic again, over all items in each choice, without classes: lengths of the filled sequences."""
    items = [[t, n, i, 0] for i, (t, n) in enumerate(zip(tokens, loss)) if t]
    a, b, out = sum(tokens) / limits.tokens, sum(loss) / limits.loss, []
    while items:
        rest, bin_ = [limits.tokens, limits.segments, limits.loss], []
        value = lambda x: a * x[0] / limits.tokens * rest[0] / limits.tokens + b * x[1] / limits.loss * rest[2] / limits.loss
        while items and rest[0] and rest[1]:
            fits = [x for x in items if x[0] <= rest[0] and x[1] <= rest[2]]
            if not fits and not cut:
                break
            x = max(fits or items, key=value)
            take = x[0] if fits else min(rest[0], rest[2] + x[0] - x[1])
            if not take:
                break
            used = max(0, take - (x[0] - x[1]))
            bin_.append((take, used))
            rest = [rest[0] - take, rest[1] - 1, rest[2] - used]
            items.remove(x)
            if not fits:
                items.append([x[0] - take, x[1] - used, x[2], x[3] + take])
        out.append(sorted(bin_))
    return out


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("limits", [Limits(100, 4, 60), Limits(64, 100, 64), Limits(50, 2, 10)])
def test_heuristic_against_plain_version(cut, limits):
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 90, 120)
    loss = (tokens * rng.random(120)).astype(int)
    if not cut:
        tokens, loss = np.minimum(tokens, limits.tokens), np.minimum(loss, limits.loss)
    got = packing.fill(tokens, loss, limits, cut)
    if limits.loss > 10:  # with so little loss left, many examples are of equal value, and any may be cut
        assert [sorted((p[2], p[3]) for p in b) for b in got] == plain(tokens.tolist(), loss.tolist(), limits, cut)
    for b in got:
        assert sum(p[2] for p in b) <= limits.tokens and len(b) <= limits.segments and sum(p[3] for p in b) <= limits.loss
    assert sum(p[2] for b in got for p in b) == tokens.sum() and sum(p[3] for b in got for p in b) == loss.sum()


def test_instruction_data(spark, sf, lib):
    """Whole conversations, of which the assistant's turns bear loss."""
    count = F.udf(lambda t: len(lib.encode(t or "", add_special_tokens=False).ids), "bigint")
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("n", count("text"))
    examples = turns.groupBy("conv_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("n_loss"))
    odd = spark.createDataFrame([(-1, None, 3), (-2, 0, 0), (-3, 5000, 1), (-4, 10, 1900), (-5, 1900, 1700)], "conv_id bigint, n_tokens bigint, n_loss bigint")
    limits = Limits(2048, 3, 1500)
    got = packing.pack_examples(examples.unionByName(odd).withColumn("offset", F.lit("clash")).coalesce(1), limits).collect()
    placed = [r for r in got if r.sequence_id is not None]
    assert {r.conv_id for r in got} - {r.conv_id for r in placed} == {r.conv_id for r in got if not (r.n_tokens and r.n_tokens <= 2048 and r.n_loss <= 1500)}
    for s in {r.sequence_id for r in placed}:
        own = sorted((r for r in placed if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.n_tokens for x in own[:k]) for k in range(len(own))]
        assert sum(r.n_tokens for r in own) <= 2048 and len(own) <= 3 and sum(r.n_loss for r in own) <= 1500
    assert packing.pack_examples(examples.limit(0)).count() == 0
