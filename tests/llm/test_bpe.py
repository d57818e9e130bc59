import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeworks.llm import bpe, queries

ODD = ["", "a", "  lead", "tail \n\n ", "don't I'LL we're", "naïve Ünïcode ß ñ 你好 🙂👩‍👩‍👧", "x" * 5000, "ab" * 700, "<|endoftext|>", "a<|endoftext|>b <|endoftext|>",
       "\x00\x01​  ", "1234567890 12.5e-3", "!?*** &&&", "́é", "A\r\nB\tC", "ﬁ Ａ﻿"]


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(queries.VOCABULARY)
    t.no_padding(), t.no_truncation()
    return t


def test_codec_matches_library(lib):
    codec = bpe.Codec(queries.VOCABULARY)
    for text in ODD:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text[:40]
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert codec.decode([10, 200, 220, 50256, 187]) == lib.decode([10, 200, 220, 50256, 187], skip_special_tokens=False)


def test_scan_and_heap_agree():
    codec = bpe.Codec(queries.VOCABULARY)
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 90):
        for _ in range(30):
            data = bytes(rng.choice(list(b"aetnh oi"), n).tolist())
            assert codec._scan(data) == codec._heap(data)


def test_query_against_library(spark, sf, lib):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_bpe_round_trip(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        back = lib.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode()))


def test_odd_rows(spark, lib):
    rows = [(i, t) for i, t in enumerate([None, *ODD])] + [(1, ""), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = bpe.with_tokens(docs, queries.VOCABULARY).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == lib.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.decoded == (r.text or "")
    assert bpe.with_tokens(docs.limit(0), queries.VOCABULARY, digest=True).count() == 0
