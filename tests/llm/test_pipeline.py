import hashlib
import re

import pandas as pd
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import mixing, queries
from gaugeworks.llm.simhash import fingerprint

from test_line_dedup import brute as brute_lines
from test_quality import brute as brute_quality


def sha(data):
    return hashlib.sha256(data).hexdigest()


def shingles(text):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each(docs):
    """The least id of each component of fingerprints at two bits or fewer, or of shingle sets at 0.8 or more."""
    fps, root = {d: fingerprint(t, 5) for d, t in docs.items()}, {d: d for d in docs}
    sets = {d: shingles(t) for d, t in docs.items()}

    def find(d):
        return d if root[d] == d else find(root[d])

    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b])
            if a < b and ((fps[a] ^ fps[b]).bit_count() <= 2 or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in docs if find(d) == d}


def test_against_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    p = brute_quality([(i, r.text, r.lang, r.source) for i, r in docs.items()], labels)
    texts = {i: t for i, (t, _, _) in brute_lines([(i, docs[i].text) for i in docs if p[i] >= 0.5]).items()}
    left = one_of_each(texts)
    now = pd.DataFrame([(i, texts[i], docs[i].lang, docs[i].source) for i in sorted(left)], columns=["doc_id", "text", "lang", "source"])
    taken = {r.doc_id for r in mixing.mixed(spark.createDataFrame(now, "doc_id bigint, text string, lang string, source string")).select("doc_id").collect()}
    library = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    want = set()
    for i in taken:
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids
        raw = b"".join(k.to_bytes(4, "little") for k in ids)
        want.add((i, len(ids), sha(raw), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = corpus_pipeline.run(spark, sf)
    assert {tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
    assert 0 < len(want) < len(docs)


def test_stages_on_odd_rows(spark, sf):
    """Empty tables, nulls in every column, repeated rows and clashing names: each stage returns the columns of its input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words stand here", "en", None, 21), (3, "many words " * 3000, "en", "s", 33000), (3, "many words " * 3000, "en", "s", 33000)]
    odd = spark.createDataFrame(odd, docs.schema).withColumns({"_id": F.lit(1), "host": F.lit("h"), "site_rate.x": F.lit(2), "component": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.count() <= 5
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == 5
